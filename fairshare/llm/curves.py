"""Approximate nearest neighbours along several shifted Hilbert curves of projected vectors."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.llm.vectors import Best, _matrix, packed, search
from fairshare.operators.prefix import running_total
from fairshare.sources.tables import settle

AXES = 4
BITS = 10
SHARES = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 6, 1 / 4, 1 / 3, 1 / 2)
ROWS_AT_ONCE = 256
#: Queries and candidates of a unit of work; larger windows are cut into more units.
QUERIES = 16_384
CANDIDATES = 131_072

log = logging.getLogger(__name__)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below ``2 ** bits``) along the Hilbert curve.

    The coordinates are brought, from the highest bit down, into the frame of the sub-cube they lie
    in: where a coordinate's bit is set the lower bits of the first are flipped, else they are
    swapped with the first's. The Gray code of the result, bits interleaved, is the place.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for k in range(n):
            turned = (x[k] >> np.uint64(b)) & one == one
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            place = (place << one) | ((x[k] >> np.uint64(b)) & one)
    return place.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """For each curve ``AXES`` directions and a shift; low and high bounds; the window's share.

    ``recall`` is what windows of that share find of the sample's own neighbours.
    """

    axes: np.ndarray
    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: float
    recall: float = 1.0

    def places(self, x: np.ndarray, curve: int) -> np.ndarray:
        z = (x @ self.axes[curve].T - self.low[curve]) / (self.high[curve] - self.low[curve])
        # the grid is twice as wide as the data, so that every shift leaves room
        cells = np.clip((z / 2 + self.shift[curve]) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert(cells.astype(np.int64), BITS)


def fit(sample: np.ndarray, curves: int, k: int, recall: float, seed: int) -> Curves:
    """Directions by chance, bounds from the sample, and the least window that gives ``recall`` on it."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    axes = np.stack([np.linalg.qr(rng.normal(size=(d, min(AXES, d))))[0].T for _ in range(curves)])
    shift = rng.uniform(0, 0.5, size=(curves, axes.shape[1]))
    z = np.einsum("cad,nd->cna", axes, sample)
    low, high = np.quantile(z, 0.001, axis=1), np.quantile(z, 0.999, axis=1)
    high = np.where(high > low, high, low + 1)
    made = Curves(axes, shift, low, high, 1.0)
    n = len(sample)
    asked = np.arange(0, n, max(1, n // 256))
    product = sample[asked] @ sample.T
    product[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-product, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)] if n > 1 else np.zeros((len(asked), 0), int)
    at = np.stack([np.argsort(np.argsort(made.places(sample, c), kind="stable")) for c in range(curves)])
    off = np.abs(at[:, asked, None] - at[:, near]).min(axis=0) if near.size else np.zeros((len(asked), 1))
    for share in SHARES:
        found = float((off <= share * n / 2).mean())
        if found >= recall:
            break
    else:
        log.warning("windows of half of all vectors find %.3f of the sample's neighbours, below %.3f", found, recall)
    return Curves(axes, shift, low, high, share, found)


def feed(best: Best, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    for at in range(0, len(best.rows), ROWS_AT_ONCE):
        q, bar = best.vectors[at : at + ROWS_AT_ONCE], best.bar[at : at + ROWS_AT_ONCE]
        product = q @ x.T
        # a product may come out differently by a rounding; the sums that count are made one way
        rough = 1e-12 * (1 + np.abs(product).max())
        for k in range(len(q)):
            hit = np.flatnonzero(product[k] >= bar[k] - rough)
            if len(hit) > best.k:
                last = np.partition(product[k, hit], len(hit) - best.k)[len(hit) - best.k]
                hit = hit[product[k, hit] >= last - rough]
            if len(hit):
                best.offer(at + k, (q[k] * x[hit]).sum(1), ids[hit], rows[hit])


def nearest(
    df: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    curves: int = 6,
    recall: float = 0.95,
    sample: int = 4_096,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` rows with the largest inner products.

    ``queries`` is a condition on the id, named ``id``; candidates are all rows but the query's
    own. Scores are exact on the original vectors; ties go to the smaller id. Null ids and vectors
    that are null, empty, zero, or hold null or non-finite components take no part.

    Equal vectors are searched once: each distinct vector keeps its ``k + 1`` smallest ids, since no
    more of them can be among the nearest. Distinct vectors are ordered along ``curves`` Hilbert
    curves, each through ``AXES`` directions of its own and shifted; each order is
    range-partitioned, and a place in it is exact. A window of the order is compared with the queries
    in its middle third; windows overlap so that a query sees at least ``share / 2`` of all vectors on
    either side. ``share`` is fitted, with the bounds of the grid, on at most ``sample`` vectors
    chosen by hash: the least that finds ``recall`` of the sample's own neighbours; if none up to a half does,
    a half is taken and a warning logged. Where the vectors have structure the share is small; on
    noise of many dimensions no order helps much and it is large.

    A window's queries are cut into blocks of about ``QUERIES``, counted in the fullest cell, and its candidates
    into shares of about ``CANDIDATES``, each pair of them a unit of work, so that tasks do not grow with the table.
    """
    rows = packed(df, key, vector, zero=False)
    first = Window.partitionBy("v").orderBy("id")
    held = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    held = held.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = settle(held.withColumn("node", F.monotonically_increasing_id()), "distinct")
    named = rows.where(queries).join(held, "v").select(F.col("id").alias("query_id"), "row", "node")
    named = settle(named, "queries")
    total = held.count()
    drawn = held.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow()["v"]
    if not len(drawn):
        return rows.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    # arrays travel inside the function; they are bounded by curves, axes and the vector's length
    made = fit(_matrix(drawn.combine_chunks()), curves, k, recall, seed)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            for c in range(curves):
                out = [pa.array(np.full(len(x), c, np.int32)), pa.array(made.places(x, c))]
                yield pa.RecordBatch.from_arrays(
                    [*out, *(batch.column(n) for n in ("node", "id", "v", "asked"))],
                    names=["curve", "place", "node", "id", "v", "asked"],
                )

    asked = named.select("node").distinct().withColumn("asked", F.lit(True))
    flagged = held.join(asked, "node", "left").select(
        "node", F.element_at("ids", 1).alias("id"), "v", F.coalesce("asked", F.lit(False)).alias("asked")
    )
    along = flagged.mapInArrow(placed, "curve int, place long, node long, id long, v binary, asked boolean")
    ranked = running_total(along.withColumn("one", F.lit(1.0)), [F.col("curve"), F.col("place"), F.col("node")], "one", "at")
    at = F.col("at").cast("long") - F.col("curve") * F.lit(total)
    grid = max(k + 1, int(np.ceil(made.share * total / 2)))
    cells = -(-total // grid)
    ranked = ranked.withColumn("cell", F.floor(at / grid).cast("long"))
    blocks = 1
    if grid > QUERIES:  # else no cell holds more
        fullest = ranked.where("asked").groupBy("curve", "cell").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-fullest // QUERIES))
    shares = -(-min(3 * grid, total) // CANDIDATES)
    block, share = F.pmod(F.xxhash64("node"), F.lit(blocks)), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shares))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    around = F.explode(F.sequence(F.greatest(F.col("cell") - 1, F.lit(0)), F.least(F.col("cell") + 1, F.lit(cells - 1))))
    left = ranked.where("asked").withColumn("block", block).withColumn("share", every(shares)).withColumn("near", F.col("cell"))
    right = ranked.withColumn("near", around).withColumn("share", share).withColumn("block", every(blocks))
    unit = ((F.col("curve") * cells + F.col("near")) * blocks + F.col("block")) * shares + F.col("share")
    shape = [unit.alias("unit"), "side", F.col("node").alias("row"), "id", "v"]
    left, right = (x.withColumn("side", F.lit(n)).select(*shape) for n, x in enumerate((left, right)))
    found = search(left.unionByName(right), feed, k + 1, "double")
    # what several curves and shares have found counts once
    found = found.groupBy("query", "row", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ids = held.select(F.col("node").alias("cand"), "ids")
    answers = found.withColumnRenamed("row", "cand").join(ids, "cand")
    answers = answers.select("query", "cand", "score", F.explode("ids").alias("vec_id"))
    last = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("n", F.row_number().over(last)).where(F.col("n") <= k + 1)
    pairs = named.join(answers.withColumnRenamed("query", "node"), "node")
    # one row with the query's own id and vector is the query itself
    alike = Window.partitionBy("row", "cand", "vec_id").orderBy("score")
    itself = (F.col("cand") == F.col("node")) & (F.col("vec_id") == F.col("query_id")) & (F.col("n") == 1)
    pairs = pairs.withColumn("n", F.row_number().over(alike)).where(~itself)
    own = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "score")

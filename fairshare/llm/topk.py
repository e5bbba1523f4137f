"""Exact largest inner products: bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.llm.vectors import Best, packed, search

SEGMENTS = (1, 4, 16)
#: Queries and candidates of a unit of work; a table of any size only makes more units.
QUERIES = 16_384
CANDIDATES = 131_072
UNITS = 24
ROWS_AT_ONCE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LONGEST = 1e300


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, times the root of its length.

    For two vectors cut alike, the squared distance is at least the squared distance of these
    statistics, since within a segment it is its length times the squared difference of the
    means plus that of the centred parts, whose lengths are the deviations.
    """
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    root = np.sqrt([len(p) for p in parts])
    mean = np.stack([x[:, p].mean(1) for p in parts], axis=1) * root
    spread = np.stack([x[:, p].std(1) for p in parts], axis=1) * root
    return np.concatenate([mean, spread], axis=1)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs; one beyond a long becomes the end it is beyond."""
    tops = [np.abs(y).max(1, initial=0.0) for y in (q, x)]
    if q.shape[1] * tops[0].max(initial=0.0) * tops[1].max(initial=0.0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    out = np.zeros((len(q), len(x)), np.int64)
    for i in range(len(q)):
        most = q.shape[1] * tops[0][i] * tops[1]
        small, large = most < 2.0**53, most >= 2.0**62
        out[i, small] = (x[small] @ q[i]).astype(np.int64)
        middle = ~small & ~large
        if middle.any():
            out[i, middle] = x[middle].astype(np.int64) @ q[i].astype(np.int64)
        if large.any():
            own = [int(a) for a in q[i]]
            for j in np.flatnonzero(large):
                total = sum(a * int(b) for a, b in zip(own, x[j]))
                out[i, j] = min(max(total, LEAST), MOST)
    return out


def feed(best: Best, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Offer to each query the candidates that its bounds leave, with their exact inner products.

    An inner product is half of the squared lengths less the squared distance, so a lower bound of
    the distance gives an upper bound of the product; a candidate whose bound is below the
    query's last place so far goes, at the coarsest resolution that tells.
    """
    levels = [statistics(x, n) for n in SEGMENTS]
    own = (x**2).sum(1)
    for at in range(0, len(best.rows), ROWS_AT_ONCE):
        q = best.vectors[at : at + ROWS_AT_ONCE]
        bar = best.bar[at : at + ROWS_AT_ONCE]
        lengths = (q**2).sum(1)
        alive = best.rows[at : at + ROWS_AT_ONCE, None] != rows
        i, j = np.arange(len(q)), np.arange(len(x))
        # lengths near the end of the doubles have no bounds
        bounded = max(own.max(initial=0.0), lengths.max(initial=0.0)) < LONGEST
        if bounded and np.isfinite(bar).all():
            for n, level in zip(SEGMENTS, levels):
                s = statistics(q[i], n)
                apart = (s**2).sum(1)[:, None] + (level[j] ** 2).sum(1) - 2 * (s @ level[j].T)
                most = (lengths[i][:, None] + own[j] - apart) / 2
                slack = 1e-9 * (lengths[i][:, None] + own[j]) + 1e-9
                alive &= most + slack >= bar[i][:, None]
                keep_i, keep_j = alive.any(1), alive.any(0)
                alive, i, j = alive[np.ix_(keep_i, keep_j)], i[keep_i], j[keep_j]
        if not alive.size:
            continue
        product = exact_products(q[i], x[j])
        alive &= product >= bar[i][:, None]
        for k in np.flatnonzero(alive.any(1)):
            hit = alive[k]
            best.offer(at + int(i[k]), product[k, hit], ids[j[hit]], rows[j[hit]])


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 x); a component for which that is no double raises an error."""
    y = np.floor(256 * x)
    if not np.isfinite(y).all():
        raise ValueError("a component is too large: 256 times it is no finite number")
    return y


def largest_products(
    df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest integer inner products.

    Components are floor(256 x). ``queries`` is a condition on the id, named ``id``; candidates are
    all rows but the query's own, other rows with the same id among them. Fewer candidates
    than ``k`` all return; ties go to the smaller id. Null ids and vectors that are null, empty, or
    hold null or non-finite components take no part. Scores are exact; one among the ``k`` largest
    that does not lie within the ends of a long raises an error, as does a component too large to scale.

    Queries form blocks and rows form shares, of about ``QUERIES`` and ``CANDIDATES`` by a hash of unique
    row numbers; each block and share is a unit of work, and the bests of the shares are ranked at the
    end. A task's work and memory do not grow with the table. Every row meets every block, which an exact
    search needs when bounds fail; nothing is broadcast.
    """
    rows = packed(df, key, vector, scaled)
    asked = rows.where(queries)
    blocks = max(1, -(-asked.count() // QUERIES))
    shares = max(-(-UNITS // blocks), -(-rows.count() // CANDIDATES))
    block, share = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shares))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("block", block).withColumn("share", every(shares)).withColumn("side", F.lit(0))
    right = rows.withColumn("share", share).withColumn("block", every(blocks)).withColumn("side", F.lit(1))
    units = left.unionByName(right).withColumn("unit", F.col("block") * shares + F.col("share"))
    found = search(units, feed, k, "long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = rows.select(F.col("row").alias("query"), F.col("id").alias("query_id")).where(F.col("query").isNotNull())
    named = ranked.join(names, "query")
    beyond = F.raise_error(F.lit("a score does not fit a long")).cast("long")
    score = F.when(F.col("score").isin(LEAST, MOST), beyond).otherwise(F.col("score"))
    return named.select("query_id", "rank", F.col("id").alias("vec_id"), score.alias("score"))

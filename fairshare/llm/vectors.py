"""Vectors as packed bytes, and searches that stream candidates past blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairshare.sources.tables import settle

CHUNK = 2_048


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from a binary column of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def packed(
    df: DataFrame, key: str, vector: str, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = True
) -> DataFrame:
    """(row, id, v): the usable vectors as bytes of doubles, numbered and written once.

    Null ids, null or empty vectors and those with null or non-finite components take no part, nor
    do zero vectors unless ``zero``. ``change`` may turn the components into other finite ones.
    Lengths that differ raise an error.
    """
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{vector} is no array")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, names = batch.column(0), [], []
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for one, end, size in zip(ids.to_pylist(), ends, sizes):
                x = flat[end - size : end]
                if one is None or not size or not np.isfinite(x).all():
                    continue
                x = change(x) if change else x
                if np.isfinite(x).all() and (zero or x.any()):
                    names.append(one)
                    out.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    own = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    rows = own.mapInArrow(pack, "id long, v binary").withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows.select("row", "id", "v"), "vectors")
    lengths = rows.agg(F.min(F.length("v")).alias("a"), F.max(F.length("v")).alias("b")).first()
    if lengths["a"] != lengths["b"]:
        raise ValueError("vectors of different lengths")
    return rows


class Best:
    """The ``k`` best candidates of every query so far: higher scores first, then smaller ids."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int, kind: type = np.float64):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.score: list[np.ndarray] = [np.zeros(0, kind)] * len(rows)
        self.id: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        self.row: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        self.bar = np.full(len(rows), -np.inf)

    def offer(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = np.concatenate([self.score[q], score])
        ids, rows = np.concatenate([self.id[q], ids]), np.concatenate([self.row[q], rows])
        # the complement turns every long around, the least one too
        first = np.lexsort((rows, ids, ~score if score.dtype == np.int64 else -score))[: self.k]
        self.score[q], self.id[q], self.row[q] = score[first], ids[first], rows[first]
        if len(first) == self.k:
            self.bar[q] = score[first[-1]]


Feed = Callable[[Best, np.ndarray, np.ndarray, np.ndarray], None]


def search(units: DataFrame, feed: Feed, k: int, score: str) -> DataFrame:
    """(query, row, id, score): for each unit of work, the ``k`` best candidates of its queries.

    ``units`` has (unit long, side 0 for queries and 1 for candidates, row, id, v). Rows are dealt
    out by unit and sorted, queries first, so a task holds the queries of one unit and streams the
    candidates past them, ``CHUNK`` at a time: memory does not depend on their number.
    """

    def finished(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is None or not sum(map(len, best.row)):
            return
        query = np.repeat(best.rows, [len(x) for x in best.row])
        columns = [query, *(np.concatenate(x) for x in (best.row, best.id, best.score))]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns[:3]), pa.array(columns[3]).cast(pa.int64() if score == "long" else pa.float64())],
            names=["query", "row", "id", "score"],
        )

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        open_unit, waiting = None, []
        for batch in batches:
            unit, side, row, ids = (batch.column(n).to_numpy() for n in ("unit", "side", "row", "id"))
            cuts = np.flatnonzero((np.diff(unit) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(unit)]):
                if lo == hi:
                    continue
                if unit[lo] != open_unit:
                    yield from finished(best)
                    best, waiting, open_unit = None, [], unit[lo]
                if side[lo] == 0:
                    waiting.append((row[lo:hi], _matrix(batch.column("v")[lo:hi])))
                    continue
                if best is None and waiting:
                    best = Best(*(np.concatenate(x) for x in zip(*waiting)), k, np.int64 if score == "long" else np.float64)
                for at in range(lo, hi if best else lo, CHUNK):
                    to = min(at + CHUNK, hi)
                    feed(best, _matrix(batch.column("v")[at:to]), ids[at:to], row[at:to])
        yield from finished(best)

    dealt = units.select("unit", "side", "row", "id", "v").repartition("unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(sweep, f"query long, row long, id long, score {score}")

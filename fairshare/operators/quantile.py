"""An exact quantile by narrowing: no sort, no shuffle of the values, nothing gathered unbounded."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATHER = 10_000
SLACK = 1e-3
#: Size of a value sketch: its ranks are off by about a thousandth, and it takes some tens of KB.
SKETCH = 4096


def _segments(x: Column, low: float, high: float) -> dict[str, Column]:
    """Cut the candidates at ``low`` and ``high``; both ends are segments of their own."""
    return {
        "s0": x < low,
        "s1": x == low,
        "s2": (x > low) & (x < high),
        "s3": (x == high) & (x > low),
        "s4": x > high,
    }


def _gathered(rows: DataFrame, ranks: list[int]) -> list[float]:
    """Values at the ranks of a frame known to be small."""
    wanted, seen, out = list(ranks), 0, []
    for row in rows.groupBy("x").count().orderBy("x").collect():
        seen += row["count"]
        while wanted and wanted[0] < seen:
            out.append(row["x"])
            wanted.pop(0)
    return out


def _numbers(df: DataFrame, column: str, keys: Iterable[str] = ()) -> DataFrame:
    """(keys…, x): what counts for a quantile, neither null nor NaN."""
    rows = df.select(*keys, F.col(column).cast("double").alias("x"))
    return rows.where("x is not null and not isnan(x)")


def value_sketches(
    df: DataFrame, column: str, keys: Iterable[str] = (), size: int = SKETCH
) -> DataFrame:
    """(keys…, rows, sketch): a quantile sketch of the numbers of each group, to be stored.

    One mergeable aggregate: a group, of any size, sends one sketch per task. Sketches of runs or
    partitions that are written one by one add up to those of the whole (``merged_sketch``). Null and
    NaN values are left out; a group without numbers has no row.
    """
    sketch = F.kll_sketch_agg_double("x", F.lit(size)).alias("sketch")
    counted = F.count(F.lit(1)).alias("rows")
    return _numbers(df, column, keys).groupBy(*keys).agg(counted, sketch).where("rows > 0")


def merged_sketch(sketches: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Stored sketches added up by coarser keys, or all of them: (keys…, rows, sketch).

    Merged by hash first, so a key with very many sketches sends few of them to its task.
    """
    keys = list(keys)
    part = F.pmod(F.xxhash64("sketch"), F.lit(64)).alias("_part")
    merge = [F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("sketch")]
    parts = sketches.select(*keys, "rows", "sketch", part).groupBy(*keys, "_part").agg(*merge)
    return parts.groupBy(*keys).agg(*merge)


def sketched_quantile(sketch: str, q: float) -> Column:
    """About the ``q`` quantile, from a sketch column and without the rows."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def _bracket(sketches: DataFrame, q: float, slack: float) -> tuple[int, float, float] | None:
    """(rows, low, high): how many numbers were sketched, and two that most likely enclose the quantile."""
    ends = [max(0.0, q - slack), min(1.0, q + slack)]
    found = merged_sketch(sketches).where("rows > 0")
    row = found.select("rows", *[sketched_quantile("sketch", e).alias(f"e{i}") for i, e in enumerate(ends)]).first()
    return tuple(row) if row else None


def exact_quantile(
    df: DataFrame,
    column: str,
    q: float,
    gather: int = GATHER,
    slack: float = SLACK,
    sketches: DataFrame | None = None,
) -> float | None:
    """The ``q`` quantile of a column, interpolated linearly between neighbours.

    With ``sketches`` of these very rows, as ``value_sketches`` made them for the whole or its parts, the
    first count and the first approximate quantiles come from them, without a scan; a sketch that is
    inexact costs a further round and never the result. Sketches that hold another number of rows than
    the column raise an error.

    Each round takes approximate quantiles just below and above the wanted rank, counts exactly how
    many values lie on each side, and goes on with the values between; a value that fills many rows
    is a segment of its own. Values reach the driver only when at most ``gather`` are left.
    """
    x = F.col("x")
    rows = _numbers(df, column)
    known = None if sketches is None else _bracket(sketches, q, 3 * slack)
    n = known[0] if known else rows.count()
    if n == 0:
        return None
    position = (n - 1) * q
    first = math.floor(position)
    ranks = [first, min(first + 1, n - 1)]
    while n > gather:
        if known:
            low, high = known[1:]
        else:
            ends = [max(0.0, ranks[0] / n - slack), min(1.0, (ranks[1] + 1) / n + slack)]
            low, high = rows.agg(F.percentile_approx("x", ends, 10_000)).first()[0]
        parts = _segments(x, low, high)
        measures = []
        for name, inside in parts.items():
            value = F.when(inside, x)
            measures += [F.count(value), F.min(value), F.max(value)]
        found = list(rows.agg(*measures).first())
        cuts = [tuple(found[i : i + 3]) for i in range(0, len(found), 3)]
        if known and sum(cut[0] for cut in cuts) != n:
            raise ValueError("the sketches are not of these rows")
        known = None
        below, spots = 0, []
        for count, least, most in cuts:
            for rank in ranks[len(spots) :]:
                if rank < below + count:
                    spots.append((below, count, least, most))
            below += count
        if spots[0] != spots[1]:
            low_value, high_value = spots[0][3], spots[1][1]
            break
        below, n, least, most = spots[0]
        if least == most:
            low_value = high_value = least
            break
        ranks = [rank - below for rank in ranks]
        rows = rows.where(x.between(least, most))
    else:
        low_value, high_value = _gathered(rows, ranks)
    if low_value == high_value or position == first:  # equal infinities have no difference
        return low_value
    if math.isinf(low_value) or math.isinf(high_value):  # nothing lies between, the nearer counts
        return low_value if position - first <= 0.5 else high_value
    return low_value + (high_value - low_value) * (position - first)

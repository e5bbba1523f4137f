"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) as Spark jobs.

Every tree sees a bounded sample of its own, drawn from all rows by a hash of key and tree in one
scan. Trees are built in parallel, one group per tree; scoring is one pass over the rows
with the forest broadcast, whose size is set by the number of trees and the sample size alone.

Splits are drawn between the smallest and largest value of a feature, so scaling the features
beforehand would not change them and is left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.operators.features import KEY
from fairshare.operators.quantile import exact_quantile
from fairshare.operators.sampling import key_digest
from fairshare.operators.scaling import ML_FEATURES

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42

TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "path array<double>"
)


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Node arrays of one tree over the sample ``x``; a leaf has feature -1 and its path length."""
    limit = height(len(x))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "path")}
    todo = [(np.arange(len(x)), 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = at
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (0.0, 0.0)
        choices = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(choices)
        feature, threshold = -1, 0.0
        if not leaf:
            feature = int(rng.choice(choices))
            threshold = float(rng.uniform(low[feature], high[feature]))
            goes_left = x[rows, feature] <= threshold
            todo.append((rows[~goes_left], depth + 1, at, "right"))
            todo.append((rows[goes_left], depth + 1, at, "left"))
        nodes["feature"].append(feature)
        nodes["threshold"].append(threshold)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["path"].append(depth + mean_path(len(rows)) if leaf else 0.0)
    return nodes


def height(n: int) -> int:
    """The depth at which trees over ``n`` rows stop."""
    return math.ceil(math.log2(max(n, 2)))


def _slots(tree, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, path) of a tree laid out level by level, children at 2i+1 and 2i+2.

    A leaf above the last level sends everything left, down to the slot that holds its path.
    """
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    path = np.zeros(inner + 1)
    todo = [(0, 0)]
    while todo:
        node, slot = todo.pop()
        if slot >= inner:
            path[slot - inner] = tree["path"][node]
        elif tree["feature"][node] < 0:
            todo.append((node, 2 * slot + 1))
        else:
            feature[slot], threshold[slot] = tree["feature"][node], tree["threshold"][node]
            todo.append((tree["left"][node], 2 * slot + 1))
            todo.append((tree["right"][node], 2 * slot + 2))
    return feature, threshold, path


#: Draws are numbers below this, a power of two.
DRAWS = 1 << 48


def draw_rows(
    df: DataFrame,
    features: Iterable[str] = ML_FEATURES,
    key: Iterable[str] = KEY,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """(tree, n, _digest, features…): for every tree the ``sample`` rows with the least draws, by rank ``n``.

    A row's draw for tree t is (a + t * b) modulo ``DRAWS``, a and b the first and next 12 hex
    digits of the key's digest, b made odd; equal draws go by the digest. Each task keeps, for every
    tree, the least ``sample`` of its rows and passes on no others, and the tasks' rows are merged by
    tree, so neither a row count nor a second scan is needed and all rows can be drawn. Fewer rows
    than ``sample`` are drawn whole.
    """
    names, key = list(features), list(key)
    digest = key_digest(key, seed)
    part = lambda at: F.conv(F.substring("_digest", at, 12), 16, 10).cast("long")
    rows = df.select(digest.alias("_digest"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = rows.select("_digest", part(1).alias("_a"), part(13).bitwiseOR(F.lit(1).cast("long")).alias("_b"), *names)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame | None] = [None] * trees
        worst = np.full(trees, DRAWS, np.int64)
        for batch in batches:
            a, b = batch["_a"].to_numpy(np.int64), batch["_b"].to_numpy(np.int64)
            batch = batch.drop(columns=["_a", "_b"])
            for tree in range(trees):
                # b is below 2 ** 48 and trees are few, so nothing overflows
                draw = (a + tree * b) % DRAWS
                good = np.flatnonzero(draw <= worst[tree])
                if not len(good):
                    continue
                new = batch.iloc[good].assign(_draw=draw[good])
                both = new if held[tree] is None else pd.concat([held[tree], new])
                if len(both) > sample:
                    both = both.sort_values(["_draw", "_digest"], kind="stable").iloc[:sample]
                    worst[tree] = both["_draw"].iloc[-1]
                held[tree] = both
        for tree, own in enumerate(held):
            if own is not None:
                yield own.assign(tree=tree)[["tree", "_draw", "_digest", *names]]

    if trees >= 1 << 15:
        raise ValueError(f"{trees} trees")
    schema = "tree int, _draw long, _digest string, " + ", ".join(f"`{c}` double" for c in names)
    drawn = rows.mapInPandas(least, schema)
    per_tree = Window.partitionBy("tree").orderBy("_draw", "_digest")
    return drawn.withColumn("n", F.row_number().over(per_tree)).where(F.col("n") <= sample).drop("_draw")


def fit_forest(
    df: DataFrame,
    rows: int,
    features: Iterable[str] = ML_FEATURES,
    key: Iterable[str] = KEY,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """One row per tree. ``key`` must tell the rows of ``df`` apart; the draw does not use ``rows``.

    Each tree takes the rows with the least draws (``draw_rows``), out of all rows, in their order,
    so the forest depends on keys, values and seed only.
    """
    names = list(features)
    chosen = draw_rows(df, names, key, trees, sample, seed)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("n")
        nodes = grow_tree(ordered[names].to_numpy(np.float64), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{k: [v] for k, v in nodes.items()}})

    return chosen.select("tree", "n", *names).groupBy("tree").applyInPandas(build, TREE_SCHEMA)


def score(
    df: DataFrame,
    forest: DataFrame,
    rows: int,
    features: Iterable[str] = ML_FEATURES,
    into: str = "raw_score",
    sample: int = SAMPLE,
) -> DataFrame:
    """Add ``2 ** (-mean path / c(sample))``: near 1 isolated, well below 0.5 ordinary.

    ``rows`` is the number of rows the forest was fitted on.
    """
    names = list(features)
    depth = height(min(sample, rows))
    # trees * 2 ** (depth + 1) slots, whatever the number of rows
    trees = [_slots(t, depth) for t in forest.orderBy("tree").collect()]
    norm = mean_path(min(sample, rows)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        values = np.concatenate([c.to_numpy(np.float64) for c in columns])
        rows = np.arange(len(columns[0]))
        total = np.zeros(len(rows))
        for start, threshold, path in shared.value:
            offset = start * len(rows)
            slot = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                right = values.take(offset.take(slot) + rows) > threshold.take(slot)
                slot = 2 * slot + 1 + right
            total += path.take(slot - len(start))
        return pd.Series(2.0 ** (-total / len(shared.value) / norm))

    return df.withColumn(into, isolation(*[F.col(c) for c in names]))


def score_in_engine(
    df: DataFrame,
    forest: DataFrame,
    rows: int,
    features: Iterable[str] = ML_FEATURES,
    into: str = "raw_score",
    sample: int = SAMPLE,
) -> DataFrame:
    """What ``score`` adds, by expressions alone, without a Python worker.

    The forest is a constant of the plan, parsed once when the plan is optimised; its size depends on
    the number of trees and the sample alone, as in ``score``. Every tree is walked over its node arrays
    from the root, as many steps as a tree is high; a leaf stays where it is. Null and NaN values
    go left, as in ``score``, and other scores are equal to the last digits.
    """
    names, nodes = list(features), TREE_SCHEMA.removeprefix("tree int, ")
    grown = [row.asDict() for row in forest.orderBy("tree").drop("tree").collect()]
    trees = F.from_json(F.lit(json.dumps(grown)), f"array<struct<{nodes}>>")
    levels = F.sequence(F.lit(1), F.lit(height(min(sample, rows))))
    norm = mean_path(min(sample, rows)) or 1.0

    def leaf(tree: Column, values: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], at)
            right = F.get(values, feature) > F.get(tree["threshold"], at)
            return (
                F.when(feature < 0, at)
                .when(right, F.get(tree["right"], at))
                .otherwise(F.get(tree["left"], at))
            )

        return F.aggregate(levels, F.lit(0), step)

    def isolation(values: Column) -> Column:
        total = F.aggregate(
            trees, F.lit(0.0), lambda sofar, tree: sofar + F.get(tree["path"], leaf(tree, values))
        )
        return F.pow(F.lit(2.0), -total / F.lit(len(grown)) / F.lit(norm))

    values = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))) for c in names])
    # bound by a lambda, the values are gathered once a row and not once a step
    return df.withColumn(into, F.get(F.transform(F.array(values), isolation), F.lit(0)))


def flag_by_contamination(
    df: DataFrame,
    column: str,
    contamination: float = CONTAMINATION,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Add ``anomaly_score`` (``column`` minus its threshold) and ``is_anomaly`` (above it).

    The threshold is the exact ``1 - contamination`` quantile of the numbers; null and NaN values are
    never flagged, and an infinite value is where it is above the threshold. Read ``df`` from storage: it is
    scanned a few times, two times fewer with ``sketches`` of the column (``value_sketches``).
    """
    return flag_above(df, column, exact_quantile(df, column, 1.0 - contamination, sketches=sketches))


def flag_above(df: DataFrame, column: str, threshold: float | None) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly`` by a threshold known before."""
    value = F.col(column)
    above = (value > F.lit(threshold)) & ~F.isnan(value.cast("double"))
    flags = {"anomaly_score": value - F.lit(threshold), "is_anomaly": F.when(above, 1).otherwise(0)}
    return df.withColumns(flags)


@dataclass(frozen=True)
class StoredForest:
    """A fitted forest with what it takes to score and flag new rows as the fit did."""

    trees: DataFrame
    rows: int
    sample: int
    threshold: float | None


def apply_forest(
    df: DataFrame,
    stored: StoredForest,
    features: Iterable[str] = ML_FEATURES,
    into: str = "raw_score",
    in_engine: bool = False,
) -> DataFrame:
    """Score ``df`` with a stored forest and flag it by the threshold of the fit.

    ``in_engine`` scores by expressions alone (``score_in_engine``).
    """
    walk = score_in_engine if in_engine else score
    scored = walk(df, stored.trees, stored.rows, features, into, stored.sample)
    return flag_above(scored, into, stored.threshold)

"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairshare.sources.tables import settle

Pattern = tuple[str | None, ...]

MOST_PATTERNS = 100_000
STEP_BITS = 16
#: Rows around the cut of a pattern of which some subset closes the gap.
NEAR = 12
TOP = -(1 << 63)


def by_code_point(name: str | None) -> tuple[bool, str]:
    """Sorts names by code point, null last."""
    return name is None, name or ""


def targets(
    capacity: Mapping[str | None, int], weight: Mapping[str | None, float], most: float, total: float | None = None
) -> dict[str | None, float]:
    """The share of ``total`` (all capacity if not given) of each source, by weight.

    No source gets over ``most`` times its capacity; what it would have had beyond goes to the others
    by weight, until none is above. If all are at their bounds the rest of ``total`` is not
    given out.
    """
    left = float(sum(capacity.values()) if total is None else total)
    out, free = {}, sorted(capacity, key=by_code_point)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most * capacity[s]]
        for s in full or free:
            out[s] = float(most * capacity[s]) if full else weight[s] * unit
        if not full:
            break
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


class _Network:
    """Residual network with integer capacities; arcs stand in pairs, one the other's reverse."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, u: int, v: int, room: int) -> int:
        self.arcs[u].append(len(self.to))
        self.arcs[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.room += [room, 0]
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int] | None:
        level = [-1] * len(self.arcs)
        level[start], queue = 0, deque([start])
        while queue:
            u = queue.popleft()
            for a in self.arcs[u]:
                if self.room[a] and level[self.to[a]] < 0:
                    level[self.to[a]] = level[u] + 1
                    queue.append(self.to[a])
        return level if level[end] >= 0 else None

    def fill(self, start: int, end: int) -> None:
        """Send as much as the room allows, along shortest paths first."""
        while (level := self._levels(start, end)) is not None:
            at, path, u = [0] * len(self.arcs), [], start
            while True:
                if u == end:
                    sent = min(self.room[a] for a in path)
                    for a in path:
                        self.room[a] -= sent
                        self.room[a ^ 1] += sent
                    path, u = [], start
                    continue
                while at[u] < len(self.arcs[u]):
                    a = self.arcs[u][at[u]]
                    if self.room[a] and level[self.to[a]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.arcs[u]):
                    path.append(a)
                    u = self.to[a]
                elif path:
                    a = path.pop()
                    u = self.to[a ^ 1]
                    at[u] += 1
                else:
                    break


def route(
    capacity: Mapping[Pattern, int], quota: Mapping[str | None, int], repeats: int
) -> dict[tuple[Pattern, str | None], int]:
    """Tokens of each pattern that go to each of its sources, at the least cost of repetition.

    A pattern's tokens can be taken up to ``repeats`` times; each further time costs more than the
    one before. Only the arcs into the patterns have a cost, so successive shortest paths are those
    through the arcs of the first time until no more flow passes, then the second, and so on.
    A flow that has gone through an arc never has to leave it again: what is taken for the first
    time stays taken, only its source may change. As much of the quotas is met as the repeats
    allow.
    """
    patterns = sorted(capacity, key=lambda p: [by_code_point(s) for s in p])
    sources = sorted(quota, key=by_code_point)
    start, end = 0, 1
    node = {s: 2 + k for k, s in enumerate(sources)}
    net = _Network(2 + len(sources) + len(patterns))
    for s in sources:
        net.add(node[s], end, quota[s])
    enter, routes = [], {}
    for k, p in enumerate(patterns):
        here = 2 + len(sources) + k
        enter.append(net.add(start, here, 0))
        for s in p:
            routes[p, s] = net.add(here, node[s], repeats * capacity[p])
    for _ in range(repeats):
        for arc, p in zip(enter, patterns):
            net.room[arc] += capacity[p]
        net.fill(start, end)
    return {key: net.room[arc ^ 1] for key, arc in routes.items()}


@dataclass(frozen=True)
class Mix:
    """``rows``: the input's columns in ``doc`` with ``size``, ``pattern`` and ``copies``.

    ``target`` and ``flow`` say what each source should and each (pattern, source) does get.
    """

    rows: DataFrame
    target: dict[str | None, float]
    source_size: dict[str | None, int]
    flow: dict[tuple[Pattern, str | None], int]


def mix(
    docs: DataFrame,
    size: Column,
    sources: Column,
    identity: Iterable[Column],
    weight,
    repeats: int = 3,
    total: float | None = None,
    seed: int = 11,
) -> Mix:
    """Choose how often each row of ``docs`` is taken so that every source comes near its target.

    ``size`` is a row's size (null: 0); ``sources`` an array of the sources it belongs to, where null
    is a source like any other (a null or empty array: one null source). ``weight`` maps
    the sorted sources to their weights. ``identity`` are the columns that tell rows apart: rows
    alike in them, such as repeated rows, share their fate.

    Rows are aggregated by membership pattern; the patterns, at most ``MOST_PATTERNS`` (more raise an
    error), meet the quotas in a flow on the driver. A pattern that gives f tokens takes all its rows
    f // capacity times and some once more: those whose seeded hash is least, up to what is
    left, but for a subset of the ``NEAR`` rows around that point, turned round where that closes the gap. The hash at which a
    pattern stops is found by narrowing: sizes are summed by the next bits of the hash until the
    part in question is fully narrowed, so no pattern is sorted or gathered, however large. The
    outcome depends on the rows, not on their order or partitions. An empty table gives an empty mix.
    """
    own = F.array_sort(F.array_distinct(sources), lambda a, b: (
        F.when(a.eqNullSafe(b), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).otherwise(1)
    ))
    none = F.array(F.lit(None).cast("string"))
    own = F.when(F.size(F.coalesce(own, F.array())) == 0, none).otherwise(own)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
        own.cast("array<string>").alias("pattern"),
        F.xxhash64(*identity, F.lit(seed)).alias("draw"),
    )
    light = settle(rows.select("size", "pattern", "draw"), "sizes")
    summed = light.groupBy("pattern").agg(F.sum("size").alias("size"))
    found = [(tuple(r["pattern"]), r["size"]) for r in summed.limit(MOST_PATTERNS + 1).collect()]
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = dict(found)
    source_size: dict[str | None, int] = {}
    for pattern, tokens in capacity.items():
        for s in pattern:
            source_size[s] = source_size.get(s, 0) + tokens
    names = sorted(source_size, key=by_code_point)
    whole = float(sum(capacity.values())) if total is None else total
    target = targets(source_size, weight(names), repeats, whole) if names else {}
    flow = route(capacity, {s: round(t) for s, t in target.items()}, repeats)
    given = {p: sum(flow[p, s] for s in p) for p in capacity}
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(list(p), *(divmod(given[p], c) if c else (1, 0))) for p, c in capacity.items()],
        "pattern array<string>, full long, rest long",
    )
    cuts = F.broadcast(_cuts(light, plan))
    # hashes below the cut are taken once more, but for those turned round to close the gap
    below = F.col("draw").bitwiseXOR(F.lit(TOP)) < F.col("cut")
    more = below != F.coalesce(F.array_contains("turned", F.col("draw")), F.lit(False))
    joined = rows.join(cuts.withColumnRenamed("pattern", "_p"), F.col("pattern").eqNullSafe(F.col("_p")))
    copies = F.col("full") + F.when(F.col("size") > 0, F.coalesce(more, F.lit(False)).cast("long")).otherwise(0)
    return Mix(joined.select("doc", "size", "pattern", copies.alias("copies")), target, source_size, flow)


def _cuts(light: DataFrame, plan: DataFrame) -> DataFrame:
    """(pattern, full, cut, turned): rows with draws below ``cut`` are within ``rest``; of the rows
    nearest to the cut, ``turned`` holds those that are to change sides to come nearest to ``rest``.

    Draws are compared unsigned, which is as signed with the top bit turned. Each round sums, per
    pattern, the sizes by the next ``STEP_BITS`` bits of the draws that begin as the edge so far,
    and moves the edge to the part in which the running sum passes ``rest``.
    """
    draws = light.where("size > 0").groupBy("pattern", "draw").agg(F.sum("size").alias("size"))
    draws = settle(draws, "draws")
    edges = plan.select("pattern", "full", "rest", F.lit(0).cast("long").alias("edge"))
    for shift in range(64 - STEP_BITS, -1, -STEP_BITS):
        part = F.shiftrightunsigned("draw", shift)
        inside = draws.join(F.broadcast(edges), "pattern")
        if shift < 64 - STEP_BITS:
            inside = inside.where(F.shiftrightunsigned(part, STEP_BITS) == F.col("edge"))
        sums = inside.groupBy("pattern", "full", "rest", part.alias("part")).agg(F.sum("size").alias("size"))
        # at most 2 ** STEP_BITS rows for each pattern
        along = Window.partitionBy("pattern").orderBy(
            *([F.col("part").bitwiseXOR(F.lit(TOP))] if shift == 0 else ["part"])
        )
        running = F.sum("size").over(along)
        sums = sums.withColumn("before", running - F.col("size"))
        passed = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
        moved = passed.select("pattern", "full", (F.col("rest") - F.col("before")).alias("rest"), F.col("part").alias("edge"))
        edges = settle(moved, "edges")
    cut = edges.select("pattern", F.col("rest").alias("gap"), F.col("edge").bitwiseXOR(F.lit(TOP)).alias("cut"))
    place = F.col("draw").bitwiseXOR(F.lit(TOP))
    sided = draws.join(F.broadcast(cut), "pattern").withColumn("below", place < F.col("cut"))
    # by distance from the cut; the limit is applied before rows are shuffled, too
    outward = Window.partitionBy("pattern", "below").orderBy(F.when(F.col("below"), -place - 1).otherwise(place))
    near = sided.withColumn("n", F.row_number().over(outward)).where(F.col("n") <= NEAR)

    def closest(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("n", "below", "draw", "size"))))[:NEAR]
        signed = [-size if below else size for _, below, _, size in rows]
        sums = np.zeros(1, np.int64)
        for x in signed:  # place k of the sums holds the subset with the bits of k
            sums = np.concatenate([sums, sums + x])
        off = np.abs(sums - table["gap"][0].as_py())
        best = min(np.flatnonzero(off == off.min()).tolist(), key=lambda k: (k.bit_count(), k))
        turned = [row[2] for k, row in enumerate(rows) if best >> k & 1]
        return pa.table({"pattern": table["pattern"][:1], "turned": pa.array([turned], pa.list_(pa.int64()))})

    turned = near.groupBy("pattern").applyInArrow(closest, "pattern array<string>, turned array<long>")
    out = plan.join(cut, "pattern", "left").join(turned, "pattern", "left")
    return settle(out.select("pattern", "full", "cut", "turned"), "cuts")


def repeated(mixed: Mix) -> DataFrame:
    """The input's rows, each as often as the mix takes it."""
    times = mixed.rows.where("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return times.select("doc.*")

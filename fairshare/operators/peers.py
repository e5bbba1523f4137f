"""Peer groups: k-means with restarts over a range of k, silhouette, and peer benchmarks.

All restarts of all k are fitted together: each step is one scan in which a task assigns its rows
to the centres of every run and adds them up, one shuffle of those sums, and new centres. A sweep
of 90 runs costs the scans of its slowest run, not of 90 fits. Runs that have settled drop out.
First centres come from candidates drawn over all rows, each with the weight of the rows next to
it. What reaches the driver is one row per centre and a bounded number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairshare.operators.features import KEY
from fairshare.operators.sampling import sample_rows_by_key
from fairshare.operators.scaling import ML_FEATURES

KS = tuple(range(4, 13))
RESTARTS = 10
DEFAULT_K = 8
SEED = 42
MAX_STEPS = 300
TOLERANCE = 1e-4
SEED_POOL = 2_048
SEED_ROUNDS = 4
MOST_GROUPS = 10_000
SILHOUETTE_ROWS = 5000
BLOCK = 500


def _squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    cross = x @ centers.T
    squares = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :]
    return np.maximum(squares - 2.0 * cross, 0.0)


def _matrix(columns: Iterable[pd.Series]) -> np.ndarray:
    return np.column_stack([c.to_numpy(np.float64) for c in columns])


def spread_centers(
    x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray | None = None
) -> np.ndarray:
    """k-means++ seeding (Arthur, Vassilvitskii 2007): far and heavy points are picked more often."""
    weight = np.ones(len(x)) if weight is None else weight
    chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
    nearest = _squared_distances(x, x[chosen[:1]])[:, 0]
    for _ in range(1, k):
        mass = nearest * weight
        odds = mass / mass.sum() if mass.sum() > 0 else None
        chosen.append(int(rng.choice(len(x), p=odds)))
        nearest = np.minimum(nearest, _squared_distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _summable(
    x: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows laid out for ``_sums``: one line per column, (1, squared length, columns…) by weight, weights."""
    weight = np.ones(len(x)) if weight is None else weight
    rows = np.column_stack([np.ones(len(x)), (x * x).sum(1), x]) * weight[:, None]
    return np.ascontiguousarray(x.T), rows, weight


def _sums(layout: tuple[np.ndarray, np.ndarray, np.ndarray], centers: np.ndarray) -> np.ndarray:
    """(n, cost, sums…) per centre over the rows nearest to it; ties go to the first centre."""
    lines, rows, weight = layout
    # squared distance less the squared length of the row, which does not change the order
    far = (centers * centers).sum(1)[:, None] - 2.0 * (centers @ lines)
    least = far.min(0)
    member = far == least
    if np.count_nonzero(member) != len(rows):
        member &= member.cumsum(0) == 1
    member = member.astype(np.float64)
    out = member @ rows
    out[:, 1] = np.maximum(out[:, 1] + member @ (weight * least), 0.0)
    return out


def _moved(sums: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, float]:
    """New centres, and by how much they moved; a centre without rows stays."""
    n = sums[:, :1]
    new = np.where(n > 0, sums[:, 2:] / np.maximum(n, 1.0), centers)
    return new, float(((new - centers) ** 2).sum())


def seed_candidates(
    df: DataFrame,
    columns: list[str],
    key: Iterable[str],
    most: int = SEED_POOL,
    rounds: int = SEED_ROUNDS,
    seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that stand for all rows (after Bahmani et al. 2012, k-means||).

    In each round rows are drawn in proportion to their squared distance from the candidates so far,
    without replacement: a row's priority is an exponential draw, by a hash of its key, over that
    distance, and the least of all rows stay. A task passes on no more than a round keeps. Rows then
    add up at their nearest candidate, and the sums' means and counts are the weighted points.
    """
    names, d = list(columns), len(columns)
    each = max(1, most // rounds)
    spark = df.sparkSession
    keyed = df.select(*names, *[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)])
    found = np.zeros((0, d))
    for turn in range(rounds + 1):
        place = F.pmod(F.xxhash64(*keyed.columns[d:], F.lit(seed), F.lit(turn)), F.lit(1 << 52))
        drawn = keyed.select(*names, ((place + 0.5) / float(1 << 52)).alias("_u"))
        size = each if turn else 1
        shared = spark.sparkContext.broadcast(found)

        def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((0, d + 1))
            for batch in batches:
                x = _matrix(batch[c] for c in names)
                far = np.ones(len(x))
                if len(shared.value):
                    near = _squared_distances(x, shared.value).argmin(1)
                    # by differences, so that a candidate's copies are at zero and never drawn again
                    far = ((x - shared.value[near]) ** 2).sum(1)
                away = far > 0
                rank = -np.log(batch["_u"].to_numpy()[away]) / far[away]
                held = np.concatenate([held, np.column_stack([rank, x[away]])])
                if len(held) > size:
                    held = held[np.argpartition(held[:, 0], size - 1)[:size]]
            yield pd.DataFrame(held, columns=["_rank", *names])

        schema = ", ".join(f"`{c}` double" for c in ["_rank", *names])
        best = drawn.mapInPandas(least, schema).orderBy("_rank", *names).limit(size).toPandas()
        shared.unpersist()
        new = np.unique(_matrix(best[c] for c in names), axis=0) if len(best) else np.zeros((0, d))
        found = np.concatenate([found, new])
        if not len(new):
            break
    if not len(found):
        return found, np.zeros(0)
    sums = _step(df, names, {0: found})[0]
    own = sums[:, 0] > 0
    return sums[own, 2:] / sums[own, :1], sums[own, 0]


def _first_centers(
    spark, points: np.ndarray, weight: np.ndarray, plan: list[tuple[int, int]], seed: int, max_steps: int
) -> dict[int, np.ndarray]:
    """Centres for every (k, restart), seeded and settled on the weighted points; runs in parallel."""
    context = spark.sparkContext
    shared = context.broadcast((points, weight))

    def settle_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, heavy = shared.value
        layout = _summable(x, heavy)
        for run in (int(i) for batch in batches for i in batch["id"]):
            k, restart = plan[run]
            rng = np.random.default_rng([seed, k, restart])
            centers, steps, shift = spread_centers(x, k, rng, heavy), 0, np.inf
            while shift > 0 and steps < max_steps:
                centers, shift = _moved(_sums(layout, centers), centers)
                steps += 1
            yield pd.DataFrame({"run": [run], "center": [centers.ravel().tolist()]})

    tasks = min(len(plan), context.defaultParallelism)
    found = spark.range(0, len(plan), 1, tasks).mapInPandas(settle_runs, "run int, center array<double>").collect()
    shared.unpersist()
    return {r["run"]: np.reshape(r["center"], (-1, points.shape[1])) for r in sorted(found)}


def _step(vectors: DataFrame, columns: list[str], runs: dict[int, np.ndarray]) -> dict:
    """(n, cost, sums…) per centre of every run: one scan, one shuffle of a row per centre."""
    measures = ["n", "cost", *[f"s{i}" for i in range(len(columns))]]
    where = [(run, center) for run, centers in runs.items() for center in range(len(centers))]
    shared = vectors.sparkSession.sparkContext.broadcast(runs)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {run: np.zeros((len(c), len(measures))) for run, c in shared.value.items()}
        for batch in batches:
            layout = _summable(_matrix(batch[c] for c in columns))
            for run, centers in shared.value.items():
                held[run] += _sums(layout, centers)
        part = pd.DataFrame(where, columns=["run", "center"], dtype=np.int32)
        yield part.join(pd.DataFrame(np.concatenate(list(held.values())), columns=measures))

    schema = "run int, center int, " + ", ".join(f"{c} double" for c in measures)
    partial = vectors.select(*columns).mapInPandas(add_up, schema)
    total = partial.groupBy("run", "center").agg(*[F.sum(c).alias(c) for c in measures])
    found = total.toPandas().sort_values(["run", "center"])
    shared.unpersist()
    return {run: part[measures].to_numpy(np.float64) for run, part in found.groupby("run")}


@dataclass(frozen=True)
class PeerModel:
    """Centres of one k in scaled space, ordered, with their total squared distance."""

    columns: list[str]
    centers: np.ndarray
    inertia: float
    steps: int
    converged: bool = True

    @property
    def k(self) -> int:
        return len(self.centers)


def _ordered(centers: np.ndarray) -> np.ndarray:
    """Centres in the order of their coordinates, so that labels do not depend on the run."""
    return centers[np.lexsort(np.round(centers, 9).T[::-1])]


def fit_peers(
    scaled: DataFrame,
    rows: int,
    columns: Iterable[str] = ML_FEATURES,
    key: Iterable[str] = KEY,
    ks: Iterable[int] = KS,
    restarts: int = RESTARTS,
    seed: int = SEED,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
    seed_pool: int = SEED_POOL,
) -> dict[int, PeerModel]:
    """The best of ``restarts`` fits for every k.

    First centres are seeded and settled on about ``seed_pool`` weighted candidates drawn over all rows
    (``seed_candidates``), which leaves few steps to do on the whole data; those run over all rows
    until nothing moves. ``scaled`` is kept in memory meanwhile; blocks that are lost are computed
    again. ``rows`` only tells which k are too large.
    """
    names = list(columns)
    plan = [(k, restart) for k in ks if k <= rows for restart in range(restarts)]
    if not plan:
        raise ValueError(f"{rows} rows are fewer than the smallest number of groups")
    keys = list(key)
    vectors = scaled.select(*names, *[F.col(c) for c in keys if c not in names]).persist()
    try:
        points, weight = seed_candidates(vectors, names, keys, seed_pool, seed=seed)
        if not len(points):
            raise ValueError("no rows to group")
        runs = _first_centers(scaled.sparkSession, points, weight, plan, seed, max_steps)
        steps = dict.fromkeys(runs, 0)
        active = dict(runs)
        for _ in range(max_steps):
            if not active:
                break
            for run, sums in _step(vectors, names, active).items():
                steps[run] += 1
                runs[run], shift = _moved(sums, runs[run])
                active[run] = runs[run]
                if shift <= tolerance:
                    del active[run]
        final = {run: sums[:, 1].sum() for run, sums in _step(vectors, names, runs).items()}
    finally:
        vectors.unpersist()
    best: dict[int, PeerModel] = {}
    for run, centers in runs.items():
        k, cost = len(centers), float(final[run])
        if k not in best or cost < best[k].inertia:
            best[k] = PeerModel(names, _ordered(centers), cost, steps[run], run not in active)
    return best


def refit_peers(
    scaled: DataFrame,
    centers: np.ndarray,
    columns: Iterable[str] = ML_FEATURES,
    max_steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
) -> PeerModel:
    """The groups of given centres after more or other rows: centre ``i`` stays ``i`` as it moves.

    Steps run over all rows, one scan each, until centres move by no more than ``tolerance`` or
    ``max_steps`` are done. A centre without rows stays where it is. Rows with a null or NaN feature
    take no part; without rows the centres come back as they are. Ties go to the first centre.
    """
    names, points = list(columns), np.array(centers, np.float64)
    vectors = scaled.select(*names).na.drop().persist()
    steps, shift = 0, np.inf
    try:
        while shift > tolerance and steps < max_steps:
            found = _step(vectors, names, {0: points}).get(0)
            if found is None:
                return PeerModel(names, points, 0.0, steps)
            points, shift = _moved(found, points)
            steps += 1
        last = _step(vectors, names, {0: points}).get(0)
    finally:
        vectors.unpersist()
    cost = 0.0 if last is None else float(last[:, 1].sum())
    return PeerModel(names, points, cost, steps, bool(shift <= tolerance))


def nearest_center(
    df: DataFrame,
    columns: Iterable[str] | str,
    centers: np.ndarray,
    label: str = "cluster_id",
    distance: str | None = None,
) -> DataFrame:
    """Add the index of the nearest centre and, if named, the squared distance to it.

    ``columns`` are number columns or the name of one array column. Ties go to the first centre. A
    row with a null or NaN feature, or a null vector, has neither label nor distance.
    """
    array = isinstance(columns, str)
    names = [columns] if array else list(columns)
    points = np.asarray(centers, np.float64)

    @F.pandas_udf("struct<label int, far double>")
    def nearest(*parts: pd.Series) -> pd.DataFrame:
        none = np.full(points.shape[1], np.nan)
        if array:
            rows = [none if v is None else np.asarray(v, np.float64) for v in parts[0]]
            x = np.stack(rows) if rows else np.zeros((0, points.shape[1]))
        else:
            x = _matrix(parts)
        whole = ~np.isnan(x).any(1)
        label_at, far_at = np.full(len(x), None, object), np.full(len(x), None, object)
        if whole.any():
            at = _squared_distances(x[whole], points).argmin(1)
            # the winner once more by differences, which loses no digits
            label_at[whole], far_at[whole] = at, ((x[whole] - points[at]) ** 2).sum(1)
        return pd.DataFrame(
            {"label": pd.array(label_at, "Int32"), "far": pd.array(far_at, "Float64")}
        )

    out = df.withColumn("_near", nearest(*[F.col(c) for c in names]))
    out = out.withColumn(label, F.col("_near.label"))
    if distance:
        out = out.withColumn(distance, F.col("_near.far"))
    return out.drop("_near")


def label_rows(scaled: DataFrame, model: PeerModel, label: str = "cluster_id") -> DataFrame:
    return nearest_center(scaled, model.columns, model.centers, label)


def inertia(assigned: DataFrame, distance: str) -> DataFrame:
    """The sum of squared distances to the nearest centres, one row."""
    return assigned.agg(F.coalesce(F.sum(distance), F.lit(0.0)).alias("inertia"))


def silhouette(
    df: DataFrame,
    columns: Iterable[str] | str,
    labels: Iterable[str],
    key: Iterable[str],
    rows: int | None = None,
    size: int = SILHOUETTE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(labels, silhouette): mean Euclidean silhouette of a sample, for several label columns.

    At most ``size`` rows are compared, so the sample is broadcast and each task measures its rows
    against it; no pairs are written out. Rows with a null label or feature are left out. A row alone in its group counts 0, and labels with a
    single group give null.
    """
    array = isinstance(columns, str)
    names, label_names, key = [columns] if array else list(columns), list(labels), list(key)
    usable = F.lit(True)
    for c in [*names, *label_names]:
        usable = usable & F.col(c).isNotNull()
    kept = df.where(usable)
    rows = kept.count() if rows is None else rows
    df = kept
    chosen = sample_rows_by_key(df, key, rows, size, seed).select("_digest", *names, *label_names)
    sample = chosen.toPandas().sort_values("_digest")

    def points(frame: pd.DataFrame) -> np.ndarray:
        if array:
            return np.stack(frame[columns].to_numpy()).astype(np.float64)
        return _matrix(frame[c] for c in names)

    nothing = ", ".join(f"'{name}'" for name in label_names)
    if sample.empty:
        spark = df.sparkSession
        return spark.sql(f"select explode(array({nothing})) labels, double(null) silhouette")
    codes = {name: np.unique(sample[name].to_numpy(), return_inverse=True) for name in label_names}
    context = df.sparkSession.sparkContext
    everyone = points(sample)
    # about the mean, where distances lose least
    shared = context.broadcast((everyone - everyone.mean(0), {n: c[1] for n, c in codes.items()}))
    tasks = min(len(sample), context.defaultParallelism)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everyone, groups = shared.value
        ids = (batch["id"].to_numpy() for batch in batches)
        for at in (part[i : i + BLOCK] for part in ids for i in range(0, len(part), BLOCK)):
            apart = np.sqrt(_squared_distances(everyone[at], everyone))
            apart[np.arange(len(at)), at] = 0.0
            for name, code in groups.items():
                member = np.eye(code.max() + 1)[code]
                sizes = member.sum(0)
                reach = apart @ member
                own = code[at]
                line = np.arange(len(at))
                near = reach[line, own] / np.maximum(sizes[own] - 1, 1)
                others = reach / sizes
                others[line, own] = np.inf
                far = others.min(1)
                widest = np.maximum(near, far)
                lone = (sizes[own] == 1) | (widest == 0)
                value = np.where(lone, 0.0, (far - near) / np.where(widest == 0, 1.0, widest))
                if len(sizes) > 1:
                    yield pd.DataFrame({"labels": [name], "s": [value.sum()], "n": [len(at)]})

    ids = df.sparkSession.range(0, len(sample), 1, tasks)
    parts = ids.mapInPandas(measure, "labels string, s double, n long")
    found = parts.groupBy("labels").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    wanted = df.sparkSession.sql(f"select explode(array({nothing})) labels")
    return wanted.join(found, "labels", "left")


@dataclass(frozen=True)
class Groups:
    """Count, mean and mean squared distance from the mean of each group."""

    sizes: np.ndarray
    means: np.ndarray
    spread: np.ndarray


def _row_silhouettes(x: np.ndarray, own: np.ndarray, groups: Groups) -> np.ndarray:
    """Silhouettes by squared distance: the mean squared distance to a group is that to its mean, plus its spread."""
    far = _squared_distances(x, groups.means) + groups.spread
    line = np.arange(len(x))
    size = groups.sizes[own]
    near = far[line, own] * size / np.maximum(size - 1, 1)
    far[line, own] = np.inf
    other = far.min(1)
    widest = np.maximum(near, other)
    lone = (size == 1) | (widest == 0)
    return np.where(lone, 0.0, (other - near) / np.where(widest == 0, 1.0, widest))


def group_moments(
    df: DataFrame, columns: Iterable[str] | str, labels: Iterable[str], most: int = MOST_GROUPS
) -> dict[str, tuple[list, Groups]]:
    """Groups of every label column, with their labels in order: one aggregate, a row per group.

    Means and variances merge, so tasks send one row for each of their groups. More than ``most``
    groups raise an error. Rows with a null label or feature are left out.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    array = isinstance(columns, str)
    vector = F.col(columns).cast("array<double>") if array else F.array(*[F.col(c).cast("double") for c in columns])
    whole = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)) & vector.isNotNull()
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("label")) for n in labels])
    rows = df.where(whole).select(F.explode(listed).alias("l"), array_to_vector(vector).alias("v"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("m")
    found = rows.where("l.label is not null").groupBy("l.name", "l.label").agg(summary).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} groups")
    out = {}
    for name in labels:
        own = sorted((r["label"], r["m"]) for r in found if r["name"] == name)
        sizes = np.array([m["count"] for _, m in own], np.float64)
        means = np.array([m["mean"].toArray() for _, m in own])
        spread = np.array([m["variance"].toArray().sum() for _, m in own])
        # that variance is the sample's
        out[name] = [g for g, _ in own], Groups(sizes, means, spread * (sizes - 1) / np.maximum(sizes, 1))
    return out


def silhouette_of_all(
    df: DataFrame, columns: Iterable[str] | str, labels: Iterable[str], most: int = MOST_GROUPS
) -> DataFrame:
    """(labels, silhouette): mean silhouette of all rows by squared Euclidean distance, for several label columns.

    Two passes whatever the number of rows: the groups' moments, then every row against the groups;
    no pairs of rows are met. Rows with a null label or feature are left out, a row alone in its
    group counts 0, and labels with a single group give null.
    """
    array = isinstance(columns, str)
    names, label_names = [columns] if array else list(columns), list(labels)
    moments = group_moments(df, columns, label_names, most)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(moments)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: [0.0, 0] for name in label_names}
        for batch in batches:
            if array:
                batch = batch[batch["v"].map(lambda v: v is not None and not np.isnan(np.asarray(v, np.float64)).any())]
                x = np.stack(batch["v"].to_numpy()).astype(np.float64) if len(batch) else np.zeros((0, 0))
            else:
                x = _matrix(batch[c] for c in names)
            for name, (known, groups) in shared.value.items():
                at = {g: n for n, g in enumerate(known)}
                own = batch[f"l_{name}"].map(lambda g: at.get(g, -1)).to_numpy(np.int64, na_value=-1)
                kept = (own >= 0) & ~np.isnan(x).any(1) if len(x) else np.zeros(0, bool)
                if kept.any() and len(known) > 1:
                    about = groups.sizes @ groups.means / groups.sizes.sum()
                    shifted = Groups(groups.sizes, groups.means - about, groups.spread)
                    value = _row_silhouettes(x[kept] - about, own[kept], shifted)
                    total[name][0] += value.sum()
                    total[name][1] += len(value)
        some = [(name, s, n) for name, (s, n) in total.items() if n]
        yield pd.DataFrame(some, columns=["labels", "s", "n"]).astype({"s": "float64", "n": "int64"})

    cells = [F.col(columns).cast("array<double>").alias("v")] if array else [F.col(c).cast("double").alias(c) for c in names]
    rows = df.select(*cells, *[F.col(n).cast("string").alias(f"l_{n}") for n in label_names])
    parts = rows.mapInPandas(measure, "labels string, s double, n long")
    found = parts.groupBy("labels").agg((F.sum("s") / F.sum("n")).alias("silhouette"))
    listed = ", ".join(f"'{name}'" for name in label_names)
    return spark.sql(f"select explode(array({listed})) labels").join(F.broadcast(found), "labels", "left")


def squared_silhouette(df: DataFrame, columns: Iterable[str], label: str) -> float:
    """Silhouette of all rows by squared Euclidean distance."""
    return silhouette_of_all(df, columns, [label]).first()["silhouette"]


def sweep(
    scaled: DataFrame, rows: int, models: dict[int, PeerModel], key: Iterable[str] = KEY
) -> list[tuple[int, float, float | None]]:
    """(k, inertia, silhouette) for every fitted k, over all rows and by squared distance.

    One scan adds up the groups of all k at once, a second measures the rows against them.
    """
    names = next(iter(models.values())).columns
    centers = {k: m.centers for k, m in models.items()}
    groups = {}
    for k, sums in _step(scaled, names, centers).items():
        n = np.maximum(sums[:, 0], 1)
        means = sums[:, 2:] / n[:, None]
        # squared distances are from the centre, which is next to the mean
        spread = np.maximum(sums[:, 1] / n - ((means - centers[k]) ** 2).sum(1), 0.0)
        there = sums[:, 0] > 0
        groups[k] = there, Groups(sums[there, 0], means[there], spread[there])
    shared = scaled.sparkSession.sparkContext.broadcast((centers, groups))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = shared.value
        total = dict.fromkeys(held, 0.0)
        n = 0
        for batch in batches:
            x = _matrix(batch[c] for c in names)
            n += len(x)
            for k, (there, own) in known.items():
                if there.sum() > 1 and len(x):
                    at = (np.cumsum(there) - 1)[_squared_distances(x, held[k]).argmin(1)]
                    total[k] += _row_silhouettes(x, at, own).sum()
        yield pd.DataFrame({"k": list(total), "s": list(total.values()), "n": n}).astype({"k": "int32", "n": "int64"})

    parts = scaled.select(*names).mapInPandas(measure, "k int, s double, n long")
    found = {r["k"]: (r["s"], r["n"]) for r in parts.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    shared.unpersist()
    return [
        (k, m.inertia, found[k][0] / found[k][1] if groups[k][0].sum() > 1 and found.get(k, (0, 0))[1] else None)
        for k, m in models.items()
    ]


def best_k(found: list[tuple[int, float, float | None]], default: int = DEFAULT_K) -> int:
    """The k with the highest silhouette, the smallest of equals."""
    valid = [(s, -k) for k, _, s in found if s is not None and s > -1]
    return -max(valid)[1] if valid else default


def group_sizes(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*(by or ("cluster_id",))).agg(F.count(F.lit(1)).alias("count"))


def peer_benchmark(
    df: DataFrame, features: Iterable[str] = ML_FEATURES, label: str = "cluster_id"
) -> DataFrame:
    """Each row's features minus the mean of its peer group, as ``<feature>_vs_peers``.

    A few groups hold all rows, so means are grouped and joined back; a window would put a whole
    group into one task. ``df`` is read twice, so labels should come from storage.
    """
    names = list(features)
    means = df.groupBy(label).agg(*[F.avg(c).alias(f"_mean_{c}") for c in names])
    gaps: dict[str, Column] = {f"{c}_vs_peers": F.col(c) - F.col(f"_mean_{c}") for c in names}
    joined = df.join(means, label, "left")
    return joined.withColumns(gaps).drop(*[f"_mean_{c}" for c in names])

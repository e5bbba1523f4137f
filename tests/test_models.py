import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairshare.operators import forest, peers, runs, scaling
from fairshare.operators.quantile import exact_quantile, merged_sketch, sketched_quantile, value_sketches
from fairshare.operators.sampling import key_digest, sample_rows_by_key
from fairshare.plans import tables

COLUMNS = ["a", "b", "c"]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["spread", "third", "ties", "wide"])
def test_exact_quantile(rows, kind, q):
    rng = random.Random(3)
    values = {
        "spread": lambda i: rng.gauss(0, 1),
        "third": lambda i: 7.0 if i % 3 == 0 else rng.random() * 20,
        "ties": lambda i: float(i % 5),
        "wide": lambda i: math.exp(rng.random() * 300),
    }[kind]
    data = [values(i) for i in range(3000)]
    df = rows("x double", *[(v,) for v in data], (None,), (float("nan"),)).repartition(5)
    got = exact_quantile(df, "x", q, gather=20, slack=0.01)
    assert got == pytest.approx(np.quantile(data, q), rel=1e-12)


def test_exact_quantile_of_little(rows):
    assert exact_quantile(rows("x double"), "x", 0.5) is None
    assert exact_quantile(rows("x double", (4.0,)), "x", 0.95) == 4.0
    assert exact_quantile(rows("x double", *[(2.0,)] * 500), "x", 0.95, gather=10) == 2.0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    one = sample_rows_by_key(df.repartition(3), ["id"], 5000, 100)
    two = sample_rows_by_key(df.coalesce(1), ["id"], 5000, 100)
    ids = sorted(r["id"] for r in one.collect())
    assert ids == sorted(r["id"] for r in two.collect()) and len(set(ids)) == 100
    assert sample_rows_by_key(df, ["id"], 5000, 9000).count() == 5000


def test_scaler(spark, rows):
    df = rows("a double, b double, c double", (1.0, 5.0, 0.1 * 3), (3.0, 5.0, 0.3))
    scaler = scaling.fit_scaler(df, COLUMNS)
    got = scaler.transform(df).orderBy("a").collect()
    assert [r["a"] for r in got] == [-1.0, 1.0] and [r["b"] for r in got] == [0.0, 0.0]
    assert all(abs(r["c"]) < 1e-9 for r in got)
    again = runs.scaler_from(runs.scaler_frame(spark, scaler))
    assert again == scaler
    assert scaling.moments(df, ["a"]).first() == ("a", 2.0, 1.0)


def cloud(n, outliers=10):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    x[:outliers] = 9.0 + rng.normal(size=(outliers, 3))
    return [(i, *map(float, p)) for i, p in enumerate(x)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(cloud(2000), "id int, a double, b double, c double")


def test_mean_path():
    assert forest.mean_path(1) == 0.0 and forest.mean_path(2) == 1.0
    assert forest.mean_path(256) == pytest.approx(10.244770920116851)


def test_tree_covers_every_row_once():
    x = np.random.default_rng(0).normal(size=(256, 3))
    tree = forest.grow_tree(x, np.random.default_rng(5))
    leaves = [i for i, f in enumerate(tree["feature"]) if f < 0]
    assert len(tree["feature"]) == 2 * len(leaves) - 1 <= 511
    inner = [i for i, f in enumerate(tree["feature"]) if f >= 0]
    below = sorted([tree["left"][i] for i in inner] + [tree["right"][i] for i in inner])
    assert below == list(range(1, len(tree["feature"])))
    same = forest.grow_tree(np.ones((5, 3)), np.random.default_rng(5))
    assert same["feature"] == [-1] and same["path"] == [forest.mean_path(5)]


def scores(df, n=2000):
    trees = forest.fit_forest(df, n, COLUMNS, ["id"], trees=40)
    return {r["id"]: r["raw_score"] for r in forest.score(df, trees, n, COLUMNS).collect()}


def test_forest_finds_planted_outliers_however_rows_are_partitioned(points):
    one = scores(points.repartition(7))
    two = scores(points.coalesce(1).orderBy(F.desc("a")))
    assert one == two and all(0 < s < 1 for s in one.values())
    top = sorted(one, key=one.get, reverse=True)[:10]
    assert set(top) == set(range(10))


def test_scaling_does_not_change_the_forest(points):
    scaled = points.withColumns({c: F.col(c) * 4 + 8 for c in COLUMNS})
    one, two = scores(points), scores(scaled)
    assert max(abs(one[i] - two[i]) for i in one) < 0.05


def test_flags_the_wanted_share(points):
    flagged = forest.flag_by_contamination(points, "a", 0.05)
    assert flagged.where("is_anomaly = 1").count() == 100
    assert flagged.where("(anomaly_score > 0) <> (is_anomaly = 1)").count() == 0


def test_peers_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    corners = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10.0]])
    x = np.concatenate([c + rng.normal(scale=0.3, size=(60, 3)) for c in corners])
    data = [(i, i // 60, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(data, "id int, corner int, a double, b double, c double")
    fitted = peers.fit_peers(df, 240, COLUMNS, ["id"], ks=range(3, 6), restarts=3)
    again = peers.fit_peers(df.repartition(9), 240, COLUMNS, ["id"], ks=[4], restarts=3)
    assert np.allclose(fitted[4].centers, again[4].centers)
    found = peers.sweep(df, 240, fitted, ["id"])
    assert peers.best_k(found) == 4 and fitted[3].inertia > fitted[4].inertia > fitted[5].inertia
    labelled = peers.label_rows(df, fitted[4])
    assert labelled.select("corner", "cluster_id").distinct().count() == 4
    centers = fitted[4].centers
    direct = ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()
    assert fitted[4].inertia == pytest.approx(direct)
    near = peers.nearest_center(df, COLUMNS, centers, distance="d")
    assert peers.inertia(near, "d").first()[0] == pytest.approx(direct)
    sizes = {r["cluster_id"]: r["count"] for r in peers.group_sizes(labelled).collect()}
    assert sizes == {0: 60, 1: 60, 2: 60, 3: 60}
    assert runs.peers_from(runs.peers_frame(spark, fitted[4])).inertia == fitted[4].inertia
    assert peers.squared_silhouette(labelled, COLUMNS, "cluster_id") > 0.95


def test_peers_settle_on_all_rows_not_on_the_pool(spark):
    df = spark.createDataFrame(cloud(600, 0), "id int, a double, b double, c double")
    settings = {"ks": [3], "restarts": 2, "tolerance": 0.0, "seed_pool": 50}
    model = peers.fit_peers(df, 600, COLUMNS, ["id"], **settings)[3]
    assert model.converged
    x = np.array([r[1:] for r in cloud(600, 0)])
    label = ((x[:, None] - model.centers[None]) ** 2).sum(2).argmin(1)
    means = np.array([x[label == i].mean(0) for i in range(3)])
    assert np.allclose(means, model.centers)


def test_candidates_come_from_all_rows_by_weight(spark):
    # a few far rows among very many copies, which a plain sample would miss
    data = [(i, 0.0, 0.0, 0.0) for i in range(4000)] + [(4000 + i, 50.0 * (i + 1), 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    points, weight = peers.seed_candidates(df, COLUMNS, ["id"], most=40)
    assert weight.sum() == 4005 and sorted(points[:, 0]) == [0, 50, 100, 150, 200, 250]
    assert sorted(weight) == [1, 1, 1, 1, 1, 4000]
    again, _ = peers.seed_candidates(df.repartition(11), COLUMNS, ["id"], most=40)
    assert np.allclose(np.sort(points, 0), np.sort(again, 0))
    model = peers.fit_peers(df, 4005, COLUMNS, ["id"], ks=[6], restarts=2, seed_pool=40)[6]
    assert model.inertia == pytest.approx(0, abs=1e-9)
    none, nothing = peers.seed_candidates(df.limit(0), COLUMNS, ["id"])
    assert len(none) == len(nothing) == 0
    big = spark.createDataFrame(cloud(3000, 4), "id int, a double, b double, c double")
    points, weight = peers.seed_candidates(big, COLUMNS, ["id"], most=64)
    assert 16 < len(points) <= 65 and weight.sum() == 3000


def test_fitted_centres_are_the_means_of_their_rows_by_sql(spark):
    df = spark.createDataFrame(cloud(2500, 6), "id int, a double, b double, c double")
    model = peers.fit_peers(df, 2500, COLUMNS, ["id"], ks=[5], restarts=2, tolerance=0.0, seed_pool=64)[5]
    peers.label_rows(df, model).createOrReplaceTempView("labelled")
    means = spark.sql("select avg(a) a, avg(b) b, avg(c) c from labelled group by cluster_id order by cluster_id").collect()
    assert model.converged and np.allclose([list(m) for m in means], model.centers)
    stored = runs.peers_from(runs.peers_frame(spark, model))
    assert stored.converged
    short = peers.fit_peers(df, 2500, COLUMNS, ["id"], ks=[5], restarts=1, tolerance=0.0, seed_pool=8, max_steps=1)[5]
    assert not short.converged and not runs.peers_from(runs.peers_frame(spark, short)).converged
    assert not runs.peers_from(runs.peers_frame(spark, model).drop("converged")).converged


def test_silhouette_of_all_rows(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(5)
    x = rng.normal(size=(7000, 3)) + 1000.0
    label = [int(g) for g in rng.integers(0, 6, 7000)]
    label[11] = 77
    data = [(i, g, 1, *map(float, p)) for i, (g, p) in enumerate(zip(label, x))]
    df = spark.createDataFrame(data, "id int, g int, one int, a double, b double, c double")
    got = {r[0]: r[1] for r in peers.silhouette_of_all(df, COLUMNS, ["g", "one"]).collect()}
    packed = VectorAssembler(inputCols=COLUMNS, outputCol="v").transform(df.withColumns({c: F.col(c) - 1000 for c in COLUMNS}))
    wanted = ClusteringEvaluator(featuresCol="v", predictionCol="g").evaluate(packed)
    assert got["g"] == pytest.approx(wanted, abs=1e-9) and got["one"] is None
    part = peers.silhouette_of_all(df.where("id < 90"), COLUMNS, ["g"]).first()["silhouette"]
    far = ((x[:90, None] - x[None, :90]) ** 2).sum(2)
    own = np.array(label[:90])
    values = []
    for i in range(90):
        same = (own == own[i]) & (np.arange(90) != i)
        other = min(far[i, own == o].mean() for o in set(own.tolist()) - {own[i]})
        values.append((other - far[i, same].mean()) / max(other, far[i, same].mean()) if same.any() else 0.0)
    assert part == pytest.approx(np.mean(values), abs=1e-9)
    model = peers.fit_peers(df, 7000, COLUMNS, ["id"], ks=[3, 4], restarts=1, seed_pool=64, max_steps=5)
    for k, _, s in peers.sweep(df, 7000, model, ["id"]):
        assert s == pytest.approx(peers.squared_silhouette(peers.label_rows(df, model[k]), COLUMNS, "cluster_id"), abs=1e-9)
    with pytest.raises(ValueError, match="groups"):
        peers.silhouette_of_all(df, COLUMNS, ["id"], most=50)


def test_silhouette_of_all_with_gaps(rows):
    df = rows("id int, v array<double>, g string", (1, [0.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [9.0, 9.0], "y"),
              (4, None, "x"), (5, [None, 1.0], "y"), (6, [9.0, 9.0], None), (7, [float("nan"), 0.0], "x"), (3, [9.0, 9.0], "y"))
    got = peers.silhouette_of_all(df, "v", ["g"]).first()["silhouette"]
    clean = peers.silhouette_of_all(df.where("id < 4"), "v", ["g"]).first()["silhouette"]
    near, far = 1.0, [162.0, 145.0]
    assert got == clean == pytest.approx(np.mean([1 - near / far[0], 1 - near / far[1], 1, 1]))
    assert peers.silhouette_of_all(df.limit(0), "v", ["g"]).first()["silhouette"] is None


def test_a_sample_is_whole_though_the_count_is_wrong(rows):
    df = rows("id int", *[(i,) for i in range(300)])
    wanted = [r[0] for r in sample_rows_by_key(df, ["id"], 300, 200).orderBy("_digest").collect()]
    assert len(wanted) == 200
    assert [r[0] for r in sample_rows_by_key(df, ["id"], 1_000_000, 200).orderBy("_digest").collect()] == wanted


def brute_silhouette(x, label):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i, own in enumerate(label):
        same = (label == own) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        near = far[i, same].mean()
        other = min(far[i, label == o].mean() for o in set(label) if o != own)
        out.append((other - near) / max(other, near))
    return float(np.mean(out))


def test_silhouette(spark):
    x = np.random.default_rng(3).normal(size=(120, 3))
    label = np.arange(120) % 4
    label[7] = 9
    data = [(i, int(g), 1, *map(float, p)) for i, (g, p) in enumerate(zip(label, x))]
    df = spark.createDataFrame(data, "id int, g int, one int, a double, b double, c double")
    got = {r[0]: r[1] for r in peers.silhouette(df, COLUMNS, ["g", "one"], ["id"]).collect()}
    assert got["g"] == pytest.approx(brute_silhouette(x, label)) and got["one"] is None
    part = peers.silhouette(df, COLUMNS, ["g"], ["id"], size=50).first()
    assert -1 <= part["silhouette"] <= 1
    assert peers.silhouette(df.limit(0), COLUMNS, ["g"], ["id"]).first()[1] is None


def test_best_k():
    assert peers.best_k([(4, 1.0, 0.2), (5, 1.0, 0.3), (6, 1.0, 0.3)]) == 5
    assert peers.best_k([(4, 1.0, None)]) == peers.DEFAULT_K


def test_peer_benchmark(rows):
    df = rows("cluster_id int, a double", (0, 1.0), (0, 3.0), (1, 5.0))
    got = sorted(r["a_vs_peers"] for r in peers.peer_benchmark(df, ["a"]).collect())
    assert got == [-1.0, 0.0, 1.0]


def test_features_to_published_models(spark):
    rng = np.random.default_rng(8)
    data = [
        (f"c{i % 9}", None if i % 50 == 0 else f"s{i % 6}", 2000 + i // 54, 10.0, 5.0,
         *[float(v) for v in rng.normal(size=9)])
        for i in range(400)
    ]
    names = ", ".join(f"{c} double" for c in scaling.ML_COLUMNS[3:] + scaling.ML_FEATURES)
    schema = "country_code string, cluster_name string, year int, " + names
    df = spark.createDataFrame(data, schema)
    models = tables.model(df, ks=range(4, 6), restarts=2, trees=20)
    got = models.anomalies
    assert got.columns == [*scaling.ML_COLUMNS, *scaling.ML_FEATURES, "anomaly_score",
                           "is_anomaly", "cluster_id"]
    assert got.count() == 400 and got.where("is_anomaly = 1").count() == 20
    spark.sql("create database if not exists models")
    tables.publish_models(spark, "models", models)
    tables.publish_models(spark, "models", models)
    log = spark.table("models.runs")
    assert log.count() == 18 and log.select("run_id").distinct().count() == 4
    assert {r["value"] for r in log.where("key = 'n_estimators'").collect()} == {"20"}
    metric = {r["key"]: r["number"] for r in log.where("kind = 'metric'").collect()}
    assert metric["anomaly_count"] == 20 and metric["anomaly_rate"] == 0.05
    assert metric["inertia"] > 0 and -1 <= metric["silhouette_score"] <= 1
    trees = spark.table("models.model_forest")
    stored = runs.forest_from(trees)
    again = forest.apply_forest(df, stored).where("is_anomaly = 1").select(*forest.KEY)
    flagged = got.where("is_anomaly = 1").select(*forest.KEY)
    assert trees.count() == 20 and again.exceptAll(flagged).isEmpty() and again.count() == 20


def test_a_run_that_is_written_again_stays_one(spark):
    spark.sql("create database if not exists logged")
    for value in (1.0, 2.0):
        runs.append_runs(runs.run_log(spark, "a", {"x": 1}, {"m": value, "none": None}, run_id="one"), "logged.runs")
        runs.append_runs(runs.run_log(spark, "b", {}, {"m": 5.0}, run_id="two/2's"), "logged.runs")
    got = spark.table("logged.runs")
    assert sorted((r["run_id"], r["key"], r["number"]) for r in got.collect() if r["kind"] == "metric") == [
        ("one", "m", 2.0), ("one", "none", None), ("two/2's", "m", 5.0)]
    assert got.count() == 4


def test_draws_are_whole_whatever_the_partitions(spark):
    df = spark.createDataFrame(cloud(900, 1), "id int, a double, b double, c double")
    settings = (COLUMNS, ["id"], 7, 40)
    one = sorted((r["tree"], r["n"], r["_digest"]) for r in forest.draw_rows(df.repartition(1), *settings).collect())
    many = sorted((r["tree"], r["n"], r["_digest"]) for r in forest.draw_rows(df.repartition(13), *settings).collect())
    assert one == many and len(one) == 7 * 40
    few = forest.draw_rows(df.where("id < 9").union(df.where("id < 9")), *settings)
    assert few.groupBy("tree").count().where("count <> 18").count() == 0
    assert forest.draw_rows(df.limit(0), *settings).count() == 0


def test_scores_follow_the_tree_node_by_node(spark, points):
    trees = forest.fit_forest(points, 2000, COLUMNS, ["id"], trees=5, sample=64)
    got = forest.score(points, trees, 2000, COLUMNS, sample=64).where("id < 50").collect()
    grown = trees.collect()
    for row in got:
        paths = []
        for tree in grown:
            node = 0
            while tree["feature"][node] >= 0:
                low = row[COLUMNS[tree["feature"][node]]] <= tree["threshold"][node]
                node = tree["left" if low else "right"][node]
            paths.append(tree["path"][node])
        wanted = 2 ** (-np.mean(paths) / forest.mean_path(64))
        assert row["raw_score"] == pytest.approx(wanted)


def test_engine_scores_equal_the_others_and_start_no_python(spark, points):
    trees = forest.fit_forest(points, 2000, COLUMNS, ["id"], trees=12, sample=64)
    given = points.withColumns(
        {
            "a": F.when(F.col("id") % 5 != 0, F.col("a")),
            "b": F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("b")),
            "c": F.when(F.col("id") % 11 == 0, float("inf")).otherwise(F.col("c")),
        }
    ).unionByName(points.limit(3))
    one = forest.score(given, trees, 2000, COLUMNS, sample=64)
    two = forest.score_in_engine(given, trees, 2000, COLUMNS, sample=64)
    assert "ArrowEvalPython" in one._jdf.queryExecution().toString()
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "from_json" not in plan
    a, b = (sorted((r["id"], r["raw_score"]) for r in df.collect()) for df in (one, two))
    assert len(a) == 2003 and [x for x, _ in a] == [x for x, _ in b]
    assert [x for _, x in a] == pytest.approx([x for _, x in b], rel=1e-14)
    assert forest.score_in_engine(points.limit(0), trees, 2000, COLUMNS, sample=64).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.3, 0.95, 1.0])
@pytest.mark.parametrize("values", ["abs(hash(id)) / 7.0", "id % 3", "if(id % 3 = 0, 5.0, cast(hash(id) as double))"])
def test_sketches_change_the_way_and_not_the_quantile(spark, values, q):
    df = spark.range(30_000).selectExpr("id % 11 run", "id % 4 kind", f"cast({values} as double) x")
    sketches = value_sketches(df, "x", ["run", "kind"], size=200)
    assert sketches.count() == 44
    assert exact_quantile(df, "x", q, gather=50, sketches=sketches) == exact_quantile(df, "x", q)
    coarse = merged_sketch(sketches, ["kind"]).select("kind", "rows", sketched_quantile("sketch", 0.5).alias("m"))
    for row in coarse.collect():
        own = df.where(F.col("kind") == row["kind"])
        below, upto = own.where(F.col("x") < row["m"]).count(), own.where(F.col("x") <= row["m"]).count()
        assert row["rows"] == own.count() and below <= row["rows"] * 0.55 and upto >= row["rows"] * 0.45


def test_sketches_of_gaps_nothing_and_other_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    df = rows("k string, x double", ("a", None), ("a", nan), (None, 1.0), (None, 3.0), ("b", inf), ("b", 2.0))
    sketches = value_sketches(df, "x", ["k"])
    assert sorted((r["k"] or "", r["rows"]) for r in sketches.collect()) == [("", 2), ("b", 2)]
    assert exact_quantile(df, "x", 0.5, sketches=sketches) == exact_quantile(df, "x", 0.5) == 2.5
    assert exact_quantile(df, "x", 1.0, gather=1, sketches=sketches) == inf
    empty = df.limit(0)
    assert value_sketches(empty, "x").count() == 0
    assert exact_quantile(empty, "x", 0.5, sketches=value_sketches(empty, "x")) is None
    with pytest.raises(ValueError, match="not of these rows"):
        exact_quantile(df.union(df), "x", 0.5, gather=1, sketches=sketches)
    flags = forest.flag_by_contamination(df, "x", 0.3, sketches).select("k", "is_anomaly").collect()
    assert sorted(flags, key=str) == sorted(forest.flag_by_contamination(df, "x", 0.3).select("k", "is_anomaly").collect(), key=str)


def test_task_functions_need_no_package_on_the_executors(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = tmp_path / "f"
    path.write_bytes(cloudpickle.dumps((peers._sums, peers._summable, forest.grow_tree)))
    code = (
        "import numpy as np\nfrom pyspark import cloudpickle\n"
        f"sums, lay, grow = cloudpickle.loads(open({str(path)!r}, 'rb').read())\n"
        "assert sums(lay(np.ones((3, 2))), np.zeros((1, 2)))[0, 0] == 3\n"
        "grow(np.random.rand(9, 2), np.random.default_rng(0))\n"
        "try:\n    import fairshare\nexcept ImportError:\n    print('done')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", code]
    ran = subprocess.run(
        command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100
    )
    assert ran.stdout.strip() == "done", ran.stderr


def test_rows_with_gaps_have_no_peer(rows):
    nan = float("nan")
    df = rows("id int, a double, b double", (1, 0.0, 0.0), (2, None, 0.0), (3, nan, 1.0), (4, 9.0, 9.0))
    centers = np.array([[0.0, 0.0], [9.0, 9.0]])
    got = peers.nearest_center(df, ["a", "b"], centers, distance="far").orderBy("id").collect()
    assert [r["cluster_id"] for r in got] == [0, None, None, 1]
    assert [r["far"] for r in got] == [0.0, None, None, 0.0]
    df = rows("id int, v array<double>", (1, None), (2, [8.0, 8.0]), (3, [None, 1.0]))
    got = peers.nearest_center(df, "v", centers).orderBy("id").collect()
    assert [r["cluster_id"] for r in got] == [None, 1, None]
    none = peers.nearest_center(df.where("id = 1"), "v", centers).collect()
    assert none[0]["cluster_id"] is None


def test_silhouette_leaves_out_rows_without_label(rows):
    data = [(1, 0.0, 0), (2, 0.1, 0), (3, 5.0, 1), (4, 5.1, 1), (5, 2.0, None)]
    df = rows("id int, x double, g int", *data)
    value = peers.silhouette(df, ["x"], ["g"], ["id"]).first()["silhouette"]
    assert value == pytest.approx(peers.silhouette(df.where("id < 5"), ["x"], ["g"], ["id"]).first()["silhouette"])


def test_no_flag_for_null_and_nan_and_finite_thresholds(rows):
    inf, nan = float("inf"), float("nan")
    df = rows("x double", (1.0,), (2.0,), (nan,), (None,), (inf,), (inf,))
    got = forest.flag_by_contamination(df, "x", 0.5).collect()
    assert [r["is_anomaly"] for r in got] == [0, 0, 0, 0, 1, 1]
    same = rows("x double", *[(inf,)] * 20)
    assert not any(r["is_anomaly"] for r in forest.flag_by_contamination(same, "x", 0.05).collect())


def test_peer_benchmark_query_labels_once(spark, sf_dir):
    from checks.queries import QUERIES

    plan = QUERIES["peer_benchmark"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # labels are read from what is stored


def test_key_digests_tell_keys_apart(rows):
    df = rows("a string, b string", ("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("", "c"))
    assert df.select(key_digest(["a", "b"], 1).alias("d")).distinct().count() == 5


def test_refit_moves_given_centers(spark):
    rows = [(float(x), float(y)) for x, y in ((0, 0), (0, 2), (10, 0), (10, 2), (10, 2))]
    odd = [(None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows + odd, "a double, b double")
    model = peers.refit_peers(df, [[9.0, 9.0], [1.0, 1.0], [-900.0, 0.0]], ["a", "b"])
    # in their places, the centre without rows too
    assert np.allclose(model.centers, [[10, 4 / 3], [0, 1], [-900, 0]]) and model.converged
    assert abs(model.inertia - (2 + 8 / 3)) < 1e-9
    once = peers.refit_peers(df, [[0.0, 0.0], [1.0, 0.0]], ["a", "b"], max_steps=1)
    assert once.steps == 1 and not once.converged
    tied = peers.refit_peers(df.limit(1), [[0.0, 1.0], [0.0, -1.0]], ["a", "b"])
    assert tied.centers.tolist() == [[0.0, 0.0], [0.0, -1.0]]
    none = peers.refit_peers(df.limit(0), [[1.0, 2.0]], ["a", "b"])
    assert none.centers.tolist() == [[1.0, 2.0]] and none.inertia == 0 and none.converged

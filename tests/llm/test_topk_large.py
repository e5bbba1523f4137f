"""Exact inner products of vectors with components too large for exact sums of doubles."""

import math

import pytest
from pyspark.sql import functions as F

from fairshare.llm import topk


def test_large_components_are_ranked_exactly(spark):
    d = 64
    large = [46_341.0, 46_341.00390625, -3e6, 123_456_789.25, 5e4 + 1 / 3]
    rows = [(n, [x] + [float((n * k) % 7) - 3.5 for k in range(1, d)]) for n, x in enumerate(large)]
    rows += [(n, [math.sin(n * k) for k in range(d)]) for n in range(5, 60)]
    rows += [(60, [1.5e7] * d), (61, [1.5e7] * (d - 1) + [1.5e7 + 1 / 256]), (62, [0.0] * (d - 1) + [3.0]), (63, rows[0][1])]
    whole = {n: [math.floor(256 * a) for a in x] for n, x in rows}
    wanted = []
    for q in whole:
        score = {n: sum(a * b for a, b in zip(whole[q], x)) for n, x in whole.items() if n != q}
        best = sorted(score, key=lambda n: (-score[n], n))[:5]
        wanted += [(q, k + 1, n, score[n]) for k, n in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [w[0] for w in wanted if w[1] == 1 and all(abs(v[3]) < 2**63 - 1 for v in wanted if v[0] == w[0])]
    got = topk.largest_products(df, F.col("id").isin(asked)).collect()
    assert {0, 1, 2, 5}.issubset(asked) and sorted(map(tuple, got)) == [w for w in sorted(wanted) if w[0] in asked]


def test_scores_beyond_a_long_raise(spark):
    df = spark.createDataFrame([(0, [1e8] * 64), (1, [1e8] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.largest_products(df, F.col("id") == 0).collect()

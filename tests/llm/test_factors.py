"""The factorisation machine and the samples it is fitted on."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairshare.llm import factors, queries, samples


def rows_of(texts, *metadata):
    """Features of every text, as {place: weight}."""
    out = []
    for ends, place, x in factors.features(pa.array(texts, pa.string()), list(metadata)):
        for start, end in zip(np.append(0, ends), ends):
            row = {}
            for p, w in zip(place[start:end], x[start:end]):
                row[int(p)] = row.get(int(p), 0.0) + float(w)
            out.append(row)
    return out


def statistics_of(text):
    """The statistics, character by character."""
    data = (text or "").encode()
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    found = [(m.start(), m.end(), m.group().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for m in word.finditer(data)]
    words = [f[2] for f in found]
    lines = [x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for x in data.split(b"\n") if x]
    n, w, triples = len(data), len(words), list(zip(words, words[1:], words[2:]))
    count = lambda pattern: len(re.findall(pattern, data))
    shares = [
        (count(rb"[A-Z]"), n), (count(rb"[0-9]"), n), (count(rb"[.,;:?]"), n), (count(rb"!"), n), (count(rb"[#$%&*|~^=<>{}\[\]\\@_+]"), n),
        (n - count(rb"[A-Za-z0-9.,;:?!#$%&*|~^=<>{}\[\]\\@_+\x80-\xff\x20\x09-\x0d]"), n), (count(rb"[\x20\x09-\x0d]"), n), (count(rb"[\x80-\xff]"), n),
        (len(set(words)), w), (max(Counter(words).values(), default=0), w), (sum(a == b for a, b in zip(words, words[1:])), w),
        (len(set(triples)), len(triples)), (len(set(lines)), len(lines)), (sum(data[e : e + 1] in (b".", b"!", b"?") for _, e, _ in found), w),
    ]
    sizes = [w, n, len(lines), n / max(w, 1), max((e - s for s, e, _ in found), default=0), w / max(len(lines), 1)]
    levels = [min(int(np.ceil(factors.SHARE_STEPS * np.sqrt(a / max(b, 1)))), factors.SHARE_STEPS) for a, b in shares]
    return levels + [min(int(np.ceil(2 * np.log2(1 + x))), factors.LEVELS - 1) for x in sizes]


def check(texts):
    for text, row in zip(texts, rows_of(texts), strict=True):
        places = sorted(p - factors.BUCKETS for p in row if p >= factors.BUCKETS)
        wanted = []
        for n, level in enumerate(statistics_of(text)):
            wanted += [n * factors.PLACES + level, n * factors.PLACES + factors.LEVELS + level // factors.COARSE]
        assert places == sorted(wanted)
        words = [w for p, w in row.items() if p < factors.BUCKETS]
        assert not words or sum(w * w for w in words) >= 0.99 * factors.WORDS_X**2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zZ09.,!#|\n\té日\x1c", max_size=40)), min_size=1, max_size=6))
def test_statistics_match_plain_python(texts):
    check(texts)


def test_long_texts_are_whole(monkeypatch):
    texts = ["a", None, "", "Word word. " * 400, "x" * 5000, "p q r s t\n" * 30, "", "last!"]
    check(texts)
    whole = rows_of(texts)
    monkeypatch.setattr(factors, "AT_ONCE", 64)
    assert rows_of(texts) == whole
    assert rows_of(["the cat", "The CAT."])[0].keys() & set(range(factors.BUCKETS)) == rows_of(["The CAT."])[0].keys() & set(range(factors.BUCKETS))


def test_metadata_levels():
    assert list(factors._meta_level(pa.array([None, -3, 0, 1, 10**18]))) == [0, 0, 1, 3, 40]
    strange = factors._meta_level(pa.array(["a", "b", None, "a", ""]))
    assert strange[0] == strange[3] != strange[1] and strange[2] == 0 and strange[4] > 0
    assert list(factors._meta_level(pa.array([float("nan"), float("inf")]))) == [0, 40]


def machine(rng, size=40, rank=3):
    return factors.Machine(rng.normal(size=size), rng.normal(size=(size, rank)), 0.3)


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    model, sizes = machine(rng), [1, 5, 12]
    place, x = rng.integers(0, 40, sum(sizes)), rng.normal(size=sum(sizes))
    got = factors.raw_scores(model, np.cumsum(sizes), place, x)
    start = 0
    for z, n in zip(got, sizes):
        p, w = place[start : start + n], x[start : start + n]
        pairs = sum(model.vectors[p[i]] @ model.vectors[p[j]] * w[i] * w[j] for i in range(n) for j in range(i))
        assert z == pytest.approx(model.bias + model.weights[p] @ w + pairs)
        start += n


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(2)
    model = machine(rng)
    ends, place, x = np.array([4, 9, 15]), rng.integers(0, 40, 15), rng.normal(size=15)
    y, weight = np.array([True, False, True]), np.array([1.0, 2.0, 0.5])
    loss, by_weight, by_vector, by_bias = factors.risk(model, ends, place, x, y, weight)
    e = 1e-6

    def moved(k=None, f=None, bias=0.0):
        w, v = model.weights.copy(), model.vectors.copy()
        if f is not None:
            v[k, f] += e
        elif k is not None:
            w[k] += e
        return (factors.risk(factors.Machine(w, v, model.bias + bias), ends, place, x, y, weight)[0] - loss) / e

    assert moved(bias=e) == pytest.approx(by_bias, abs=1e-4)
    for k in range(40):
        assert moved(k) == pytest.approx(by_weight[k], abs=1e-4)
        assert [moved(k, f) for f in range(3)] == pytest.approx(list(by_vector[k]), abs=1e-3)


def test_pairs_are_learned_that_no_linear_model_can():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, (2, 2000))
    place = np.stack([a, 2 + b], 1).ravel()
    ends, x = np.arange(2, 4001, 2), np.ones(4000)
    y = a != b
    model = factors.fit(ends, place, x, y, np.ones(2000), 4, passes=60)
    assert (((factors.raw_scores(model, ends, place, x)) > 0) == y).all()


DOCS = "doc_id long, text string, n_chars long, lang string, source string, key string, y string, score string"


def documents(spark, n=300):
    good = lambda k: " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(60)) + "."
    rows = [(k, good(k) if k % 3 else f"junk{k} | " * 40, 10, "en", "s", "k", "y", "z") for k in range(n)]
    odd = [(None, "x", None, None, None, None, None, None), (n, None, None, "e", "", "", "", ""), (n + 1, "", 0, "e", "", "", "", ""), (7, good(7), 10, "en", "s", "k", "y", "z")]
    odd += [(n + 2, "long " * 40_000, None, "e", "", "", "", "")]
    return spark.createDataFrame(rows + odd, DOCS)


def test_quality_is_learned_and_labels_stay_held_out(spark, tmp_path):
    docs = documents(spark)
    label = lambda k: int(k % 3 > 0)
    labels = [(k, label(k), "t") for k in range(0, 300)] + [(None, 1, "t"), (9, None, "t"), (5000, 0, "t"), (4, 0, "t")]
    known = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op12_quality(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    import zlib

    for r in got:
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == out and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    of = {r["doc_id"]: r for r in got}
    assert np.mean([of[k]["predicted"] == label(k) for k in range(300) if of[k]["held_out"]]) > 0.95
    # other labels of held-out rows change nothing
    turned = known.withColumn("quality", F.when(queries.quality_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    turned.write.parquet(f"{tmp_path}/b/labels.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/b/documents.parquet")
    again = {r["doc_id"]: r["score"] for r in queries.op12_quality(spark, f"{tmp_path}/b").collect()}
    assert again == {k: r["score"] for k, r in of.items()}


def test_quality_without_labels_or_rows(spark):
    docs = documents(spark, 20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in factors.score(docs, factors.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert min(r["score"] for r in factors.score(docs, factors.train(docs, one)).collect()) > 0.99
    two = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    model = factors.train(docs, two, metadata=("n_chars", "lang"))
    assert factors.score(docs.limit(0), model).count() == 0 and factors.score(docs, model).count() == docs.count()
    assert factors.score(docs, factors.train(docs.limit(0), two)).select("score").distinct().count() == 1


def test_draws_are_bounded_by_keys_and_rows(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("key"), F.lit("x").alias("text"))
    got = [r["key"] for r in samples.draw_keys(keys, 50, 7).collect()]
    assert len(got) == len(set(got)) == 50
    assert sorted(got) == sorted(r["key"] for r in samples.draw_keys(keys.repartition(3).union(keys), 50, 7).collect())
    drawn = spark.createDataFrame([(1, True), (1, False), (3, True)], "key long, toxic boolean")
    rows = samples.one_text_each(keys.withColumn("more", F.lit(2)), drawn, "key", "text", ["more"]).collect()
    assert sorted((r["key"], r["toxic"], r["doc"]["text"], r["doc"]["more"]) for r in rows) == [(1, False, "x", 2), (1, True, "x", 2), (3, True, "x", 2)]
    assert samples.draw_keys(keys.limit(0), 5, 7).count() == 0

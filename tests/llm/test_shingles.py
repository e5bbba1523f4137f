"""The pipeline's near-duplicates against brute force over exact shingle sets."""

import numpy as np
import pytest

import corpus_pipeline
from fairshare.llm import shingles, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(words, places):
    return [f"new{k}" if k in places else w for k, w in enumerate(words)]


def texts_of_all_similarities():
    rng, texts = np.random.default_rng(6), [None, "", " \n", "one two", "One  two", "one two three"]
    for n, edits in ((100, 1), (100, 2), (100, 3), (300, 6), (300, 9), (1000, 10), (1000, 30)):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts += [" ".join(words), " ".join(changed(words, set(rng.choice(n, edits, False).tolist())))]
    # copies of copies, so that a group holds pairs that are not near
    words = [f"c{k}" for k in range(120)]
    for k in range(0, 100, 10):
        words = changed(words, {k})
        texts.append(" ".join(words))
    return texts


def test_stage_keeps_one_of_each_group_at_four_fifths(spark):
    texts = texts_of_all_similarities()
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs.limit(9)).repartition(5), "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("stars", [0, 2])
def test_pairs_that_leaders_miss_are_still_checked(spark, monkeypatch, stars):
    monkeypatch.setattr(shingles, "STARS", stars)
    h = {1: range(0, 100), 2: range(500, 600), 3: range(505, 605), 4: range(5, 105), 5: range(900, 1000)}
    sets = spark.createDataFrame([(n, list(x)) for n, x in h.items()], "node long, h array<long>")
    members = spark.createDataFrame([(7, n, 100) for n in h], "bucket long, node long, size int")
    got = {r["node"]: r["root"] for r in shingles.linked(members, sets).collect()}
    assert got == {1: 1, 4: 1, 2: 2, 3: 2}


def test_fingerprints_have_the_bits_of_the_majority():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, simhash.AT_ONCE + 5):
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        bits = [2 * int(((hashes >> np.uint64(k)) & np.uint64(1)).sum()) > n for k in range(64)]
        assert int(simhash.majority(hashes)) % 2**64 == sum(1 << k for k in range(64) if bits[k])


def test_tries_over_fingerprints_link_near_copies_without_any_band(spark, monkeypatch):
    # no two sets share a bucket
    apart = lambda h: np.bitwise_xor.reduce(h) * np.uint64(64) + np.arange(shingles.BANDS, dtype=np.uint64)
    monkeypatch.setattr(shingles, "band_keys", apart)
    rng, texts = np.random.default_rng(2), []
    for k in range(8):
        words = [f"w{x}" for x in rng.integers(0, 9000, 3000)]
        texts += [" ".join(words), " ".join(changed(words, {100 * k}))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == list(range(0, 16, 2))


def test_links_of_fingerprints_stand_only_between_near_sets(spark):
    h = {1: range(0, 100), 2: range(5, 105), 3: range(60, 160), 4: range(300, 400)}
    sets = spark.createDataFrame([(n, list(x)) for n, x in h.items()], "node long, h array<long>")
    nodes = spark.createDataFrame([(1, 0), (2, 7), (3, 0), (4, 0)], "node long, fingerprint long")
    pairs = shingles.fingerprint_pairs(nodes)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2), (1, 3), (1, 4)]
    none = spark.createDataFrame([], "bucket long, node long, size int")
    assert {r["node"]: r["root"] for r in shingles.linked(none, sets, pairs).collect()} == {1: 1, 2: 1}


def test_near_sets_share_a_band():
    rng = np.random.default_rng(8)
    for n in (9, 90, 900):
        for _ in range(150):
            x = rng.integers(0, 1 << 63, n + n // 9 * 2, dtype=np.uint64)
            a, b = x[: n + n // 9], np.concatenate([x[:n], x[n + n // 9 :]])
            assert (shingles.band_keys(a) == shingles.band_keys(b)).any()


def test_maps_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(9)
    for n in (1, 40, 3000):
        a, b = (rng.integers(0, 4 * n, n).astype(np.uint64) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        bits = np.bitwise_count((shingles.parity_map(a) ^ shingles.parity_map(b)).view(np.uint64)).sum().astype(int)
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_a_passage_in_common_is_no_link_and_gives_few_pairs(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} " + " ".join(f"o{n}x{k}" for k in range(20 + n % 40)) for n in range(150)]
    texts += [f"{passage} tail", f"{passage} end", f"head {passage}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in shingles.keep_one(docs).collect())
    assert kept == [*range(150), 150]
    h = docs.select(docs["doc_id"].alias("node"), shingles.shingles(docs["text"]).alias("h"))
    members = h.selectExpr("1L as bucket", "node", "size(h) as size", "node as root")
    maps = h.mapInArrow(shingles._maps, "node long, size int, bits array<long>")
    assert shingles._other_pairs(members, h, maps).count() <= 200

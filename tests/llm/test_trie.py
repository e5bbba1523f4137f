"""The prefix trie, running totals and end lists against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fairshare.llm import queries, running, trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, key string, depth int"


def brute_force(rows):
    """{(conv_id, depth, ends): the contract's figures} by listing every prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(built[c]) == len(node)))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), len(childless),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)


def made(spark, rows, path, parts=3):
    conversations(spark, rows).repartition(parts).write.parquet(f"{path}/conversations.parquet")
    got = queries.op11_trie(spark, str(path))
    assert got.columns == COLUMNS and set(dict(got.dtypes).values()) == {"bigint", "string"}
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_trie_matches_listing_every_prefix(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 24), *range(95, 130), 200, 250, 251, -1, -57, -100, -130, 2**62]:
        for n in range(draw.choice([1, 1, 2, 3, 5, 7, 9])):
            rows.append((c, n, draw.choice(["user", "user", "assistant"]), draw.choice(["a", "a", "bé😀"])))
    rows += [(5, None, None, None), (5, None, "user", None), (7, 3, "x", "y"), (7, 3, "x", "y"), (None, 1, "user", "a"), (300, 0, "", "")]
    rows += [(301, None, "user", "long " * 20_000), (302, 0, "ab", "c"), (303, 0, "a", "bc")]
    draw.shuffle(rows)
    assert made(spark, rows, tmp_path / "a") == brute_force(rows)


def test_copies_and_a_conversation_with_a_third_of_all_rows(spark, tmp_path):
    rows = [(c, n, "user", f"t{n}") for c in range(1000, 1090) for n in range(4)]
    rows += [(77, n, "user", f"t{n % 3}") for n in range(200)] + [(78, 1, "same", "same")] * 100
    got = made(spark, rows, tmp_path / "b", 5)
    assert got == brute_force(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert made(spark, [], tmp_path / "c") == [] and made(spark, [(None, 1, "a", "b")], tmp_path / "d") == []


@pytest.mark.parametrize("parts", [1, 6])
def test_running_totals_in_groups_that_cross_ranges(spark, parts):
    rows = [(g, n, (g * 31 + n * 7) % 1000) for g, size in ((1, 3), (2, 400), (3, 1), (9, 50)) for n in range(size)]
    df = spark.createDataFrame(rows, "g long, n long, v long").repartition(parts)
    placed = running.in_order(df, [F.col("g"), F.col("n")], ["g", "n", "v"], "test")
    assert placed.select("_bucket").distinct().count() > 1
    got = {(r["g"], r["n"]): (r["s"], r["x"]) for r in running.running(placed, "g", {"s": ("v", "sum"), "x": ("v", "xor")}).collect()}
    total, mark, last = 0, 0, None
    for g, n, v in sorted(rows):
        total, mark = (total + v, mark ^ v) if g == last else (v, v)
        last = g
        assert got[g, n] == (total, mark)


def test_end_digests_of_a_large_group(spark):
    ends = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("conv"))
    got = {r["g"]: r["ends_sha256"] for r in trie.end_digests(ends.repartition(4), ["g"]).collect()}
    assert len(got) == 10_000
    large = ",".join(str(k) for k in range(30_000) if k % 3 or k == 0)
    assert got[0] == hashlib.sha256(large.encode()).hexdigest() and got[9] == hashlib.sha256(b"9").hexdigest()

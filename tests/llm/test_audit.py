"""The filter audit against counts row by row."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fairshare.llm import audit, queries

DOCS = "doc_id long, text string, lang string, source string, key string, part string, good boolean"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute_force(docs, labels):
    """The contract's rows, document by document."""
    fails, parts = [], []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = set()
        if len(words) < 100:
            own.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            own.add("C")
        if re.search(r"[#$%&*|]", t):
            own.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs):
            own.add("E")
        fails.append(own)
        parts.append(lang or "")
    mark = [[any(i == d[0] and i is not None and row[n] == 1 for i, *row in labels) for d in docs] for n in (0, 1)]
    out = {}
    for part in set(parts):
        rows = [n for n in range(len(docs)) if parts[n] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                there = [n for n in rows if not fails[n] & set(order[:step])]
                gone = [n for n in there if f in fails[n]]
                shapley[f] += len(gone)
                out[part, order, step + 1] = [
                    len(there) - len(gone), len(gone), sum(f in fails[n] for n in rows) - len(gone),
                    sum(fails[n] == {f} for n in rows), sum(mark[0][n] for n in gone), sum(mark[1][n] for n in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                out[part, order, step + 1].append(shapley[f])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_step(frame):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in frame.collect()}


def test_audit_matches_counts_row_by_row(spark, tmp_path):
    many = " ".join(f"w{n}" for n in range(120))
    docs = [
        (1, many, "en"), (2, many, "en"), (2, many, "en"), (3, None, "en"), (4, "", None), (5, "", ""), (None, many, "en"),
        (6, "the " * 200, "de"), (7, "LOUD " * 150, "de"), (8, f"{many} #", "de"), (9, f"{many} #", "fr"), (10, "ÄÖÜ éß 日本 x\x1cy", "fr"),
        (11, "  \t\r\n\x0b\x0c ", "fr"), (12, f"{many}\n", "fr"), (13, "A*" * 50_000, "en"), (13, "other", "en"), (14, "x y|z", None),
        (15, many.upper(), "en"), (1, "again", "de"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (7, 0, 1), (13, 1, 1), (None, 1, 1), (99, 1, 1), (8, None, None), (8, 1, 0)]
    df = spark.createDataFrame([(*d, "s", "k", "p", True) for d in docs], DOCS)
    known = spark.createDataFrame([(*x, "t") for x in labels], LABELS)
    wanted = brute_force(docs, labels)
    assert by_step(audit.audit_documents(df, known)) == wanted
    df.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_filters(spark, str(tmp_path))
    assert by_step(got) == wanted and dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["kept"] == "bigint"
    assert audit.audit_documents(df.limit(0), known).count() == 0
    bare = by_step(audit.audit_documents(df, known.limit(0)))
    assert {k: v[:4] for k, v in bare.items()} == {k: v[:4] for k, v in wanted.items()}
    assert all(v[4] == v[5] == 0 for v in bare.values())


def test_any_number_of_filters(spark):
    rows = spark.createDataFrame([(n, None if n % 5 == 0 else n % 2 == 0, n % 3 == 0, n % 7 == 0) for n in range(210)], "n int, x boolean, y boolean, z boolean")
    got = audit.audit(rows, {"x": F.col("x"), "y": F.col("y"), "z": F.col("z")}, F.lit(3), {"high": F.col("n") > 99}).collect()
    assert len(got) == 18
    for r in got:
        order, fails = r["filter_order"], {n: {f for f, by in (("x", 2), ("y", 3), ("z", 7)) if n % by == 0 and not (f == "x" and n % 5 == 0)} for n in range(210)}
        there = [n for n in fails if not fails[n] & set(order[: r["step"] - 1])]
        gone = [n for n in there if order[r["step"] - 1] in fails[n]]
        assert (r["removed"], r["kept"], r["high"]) == (len(gone), len(there) - len(gone), sum(n > 99 for n in gone))
    with pytest.raises(ValueError, match="filters"):
        audit.audit(rows, {str(n): F.lit(True) for n in range(8)}, F.lit(""), {})


def test_parts_beyond_a_batch_of_orders(spark):
    rows = spark.range(1000).select((F.col("id") % 150).alias("p"), (F.col("id") % 4 == 0).alias("f"))
    got = audit.audit(rows, {"f": F.col("f")}, F.col("p"), {})
    assert got.count() == 150 and got.agg(F.sum("removed"), F.sum("kept")).first()[:] == (250, 750)

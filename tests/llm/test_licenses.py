"""License statements, and the query against plain Python."""

import re

from fairshare.llm import licenses, queries


def test_statements_are_labelled_and_talk_is_not(spark, tmp_path):
    isc = dict(licenses.NOTICES)["isc"].split()
    texts = [
        ("This work is licensed under the GNU General Public License, version 3.", "", "gpl", 1.0),
        ("under the GNU Lesser General Public License", "", "lgpl", 1.0),
        ("(c) X. All rights\nreserved.", "", "reserved", 1.0),
        ("Released under the MIT License. All rights reserved", "mit", "mit,reserved", 1.0),
        ("Licensed under CC BY-NC 4.0 and CC BY-SA", "cc-by-nc", "cc-by-nc,cc-by-sa", 1.0),
        ("the general public has all the rights, reserved seats, under a licence", "", "", 0.0),
        ("all rights reserved " * 4000, "", "reserved", 1.0),
        (" ".join(isc[:19]), "", "isc", 19 / len(isc)),
        (None, "", "", 0.0), ("", "", "", 0.0), ("reserved all rights", "", "", 0.0),
    ]
    rows = [(n, t, "x") for n, (t, *_) in enumerate(texts)] + [(0, texts[0][0], "x"), (None, texts[2][0], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, label string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in got:
        text, base, labels, score = texts[2 if r["doc_id"] is None else r["doc_id"]]
        assert (r["base_labels"], r["labels"], round(r["score"], 9)) == (base, labels, round(score, 9))
        assert r["n_words"] == len(words.findall((text or "").lower())) and (r["n_base"] > 0) == bool(base)
        assert (r["first_word"] is None) == (not base)

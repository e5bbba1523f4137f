"""SimHash, license scan, personal data, toxicity and SentencePiece against plain Python."""

import random
import re
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fairshare.llm import licenses, pieces, pii, simhash, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{n % 977}" for n in range(60_000))
TEXTS = [
    (1, "A b c d e f g"), (2, "a B c d e f g"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, LONG),
    (7, LONG), (None, "a b c d e f g"), (8, LONG + " tail"), (9, "É é x y z"),
]
CLASHING = "doc_id long, text string, row string, doc string, w string, h string, i int, _key int, score string, key int, n int"


def clashing(spark):
    rows = [(i, t, "r", "d", "w", "h", 1, 2, "s", 3, 4) for i, t in TEXTS]
    return spark.createDataFrame(rows, CLASHING)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    h = np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], dtype=np.uint64)
    bits = [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    return sum(1 << b for b, n in enumerate(bits) if 2 * n > len(h))


def components(marks, errors):
    root = list(range(len(marks)))
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= errors:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_near_duplicates_match_brute_force(spark):
    marks = [fingerprint(t) for _, t in TEXTS]
    root = components(marks, 4)
    least = {}
    for (key, _), r in zip(TEXTS, root):
        least[r] = min((x for x in (least.get(r), key) if x is not None), default=None)
    wanted = sorted(((k, m, least[r]) for (k, _), m, r in zip(TEXTS, marks, root)), key=str)
    got = [(r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(clashing(spark)).collect()]
    assert sorted(got, key=str) == wanted


def test_one_of_each_group_stays(spark):
    docs = clashing(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.data())
def test_trie_links_connect_what_brute_force_connects(seeds, data):
    marks = list(seeds)
    for _ in range(60):
        x = data.draw(st.sampled_from(marks))
        for b in data.draw(st.lists(st.integers(0, 63), min_size=1, max_size=5)):
            x ^= 1 << b
        marks.append(x)
    marks = sorted(set(marks))
    a = np.array(marks, dtype=np.uint64)
    forest = simhash.Forest(len(a))
    u, v = simhash.trie_links(a, a)
    forest.unite(np.searchsorted(a, u), np.searchsorted(a, v))
    assert forest.root.tolist() == components(marks, 4)


def test_pieces_of_a_hot_node_still_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE_ROWS", 7)
    monkeypatch.setattr(simhash, "NODE_ROWS", 20)
    rng = np.random.default_rng(3)
    marks = [int(rng.integers(0, 2**63))]
    for _ in range(150):
        marks.append(marks[int(rng.integers(len(marks)))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), False)))
    marks = sorted(set(marks))
    df = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in marks], "fingerprint long")
    forest = simhash.Forest(len(marks))
    for r in simhash.hamming_links(df).collect():
        forest.unite(*(np.array([marks.index(x % 2**64)]) for x in (r["u"], r["v"])))
    assert forest.root.tolist() == components(marks, 4)


def places(text, phrase):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrase = phrase.split()
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def test_license_phrases_match_brute_force(spark):
    notice = dict((label, text) for label, text in licenses.NOTICES)["isc"]
    broken = notice.split()
    broken[9:9] = ["odd", "words"]
    texts = [
        None, "", "mit", "Under the MIT license, under the mit-license; Apache License Version 2",
        "under the mit license " * 300, "cc by nc cc by nc", "CC-BY-NC 4.0", "under the mıt license",
        notice.upper() + ".", " ".join(broken), " ".join(notice.split()[:9]), LONG + " cc by nc",
    ]
    rows = [(n, t, "row", "doc", "w", "g") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, doc string, w string, g string")
    got = {r["doc"]["doc_id"]: r for r in licenses.license_spans(docs.unionByName(docs)).collect()}
    assert len(got) == len(texts) and licenses.license_spans(docs.unionByName(docs)).count() == 2 * len(texts)
    for n, text in enumerate(texts):
        wanted = sorted((at, label) for label, p in licenses.PHRASES for at in places(text, p))
        assert sorted((s["start"], s["label"]) for s in got[n]["spans"] if s["exact"]) == wanted
    more = {n: [(s["label"], s["start"]) for s in got[n]["spans"] if not s["exact"]] for n in got}
    assert more[8] == [("isc", 0)] and more[9] == [("isc", 0)] and not any(more[n] for n in got if n not in (8, 9))
    assert licenses.license_spans(docs.limit(0)).count() == 0
    plan = licenses.license_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def base_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


ANCHORS = pii.automaton()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="01259.@+- ()ab:/%١é", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert [tuple(s) for s in pii.find(text, ANCHORS) if s.kind in pii.BASE] == base_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 10**18), min_size=1, max_size=4), st.sampled_from([" ", "-", "."]))
def test_base_spans_of_numbers_match_the_patterns(numbers, between):
    text = between.join(map(str, numbers))
    assert [tuple(s) for s in pii.find(text, ANCHORS) if s.kind in pii.BASE] == base_spans(text)


def test_added_spans_and_masks(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00 or http://bob:secret@host.org/x a@b.co 4111 1111 1111 1111"
    found = {s.kind: text[s.start : s.end] for s in pii.find(text, ANCHORS)}
    assert found["iban"] == "DE89 3704 0044 0532 0130 00" and found["login"] == "http://bob:secret@host.org/x"
    assert pii.mask(text, pii.find(text, ANCHORS)) == "IBAN: <IBAN> or <LOGIN> <EMAIL> <CARD>"
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, LONG + " a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()}
    assert spans[2] == spans[3] == [] and spans[4][0]["start"] == len(LONG) + 1
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[2] is None and masked[3] == "" and masked[4].endswith(" <EMAIL>")
    assert pii.redact(docs).columns == docs.columns and pii.find_spans(docs.limit(0)).count() == 0


def test_toxicity_learns_and_scores_unseen_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("lo", "ke", "mi", "ta", "su") for b in ("ra", "no", "pe", "vi")]
    rows = []
    for n in range(600):
        text = list(rng.choice(words, 40))
        if n % 5 == 0:
            for k in rng.choice(40, 3, False):
                text[k] = str(rng.choice(["vile", "rotten", "badword"]))
        rows.append((n, " ".join(text), "x"))
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "vile", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(n, int(n % 5 == 0), 0) for n in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, key int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[n] >= 0.7) == (n % 5 == 0) for n in range(400, 600))
    assert got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert again == model
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def transducer():
    from pathlib import Path

    if not Path(pieces.TOKENIZER).exists():
        pytest.skip("no tokenizer files")
    return pieces.Transducer(Path(pieces.TOKENIZER).read_bytes())


def test_pieces_match_the_library(transducer):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.TOKENIZER)
    chars, draw = list("aeiothnsr thlan  ▁é日本語ﬁ\t\n<0x>.,1234Ａ\x00😀"), random.Random(2)
    texts = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k + w + " " * j for k in range(40) for j in (0, 3, 17) for w in ("", "a", "hello")]
    texts += ["a" * 500, "日本" * 300, LONG[:20_000], "x" * 70 + "."]
    for text in texts:
        ids = transducer.encode(text)
        assert ids == library.encode(text)
        assert transducer.decode(ids) == text.replace("▁", " ")


def message(number, value):
    """A field of a protocol buffer message."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def small_model(rule, fallback, squeeze=True, prefix=True):
    """A unigram model of given pieces behind the library's normaliser of that name."""
    library = pytest.importorskip("sentencepiece")
    words = "a b c d ▁ ▁a ▁b ab abc bc cd ▁ab d▁ é fi 1 12 ア ▁ア aa aaa … ... ▁the th he e t h i n in ing".split()
    draw = random.Random(5)  # no two paths weigh the same
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(w, draw.uniform(-6, -1), 1) for w in words]
    pieces_ += [("xyz", -40.0, 1), ("zq", -2.0, 5)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback]
    normaliser = message(3, int(prefix)) + message(4, int(squeeze)) + message(5, 1)
    if rule:
        spec = dict(pieces._fields(library.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
        normaliser += message(2, dict(pieces._fields(spec))[2])
    data = b"".join(message(1, message(1, w) + message(2, s) + message(3, k)) for w, s, k in pieces_)
    return data + message(2, message(3, 1) + message(35, int(fallback))) + message(3, normaliser)


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("fallback", [True, False])
def test_normalisers_and_unigrams_match_the_library(rule, squeeze, fallback):
    library = pytest.importorskip("sentencepiece")
    for prefix in (True, False):
        model = small_model(rule, fallback, squeeze, prefix)
        theirs, ours = library.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
        draw = random.Random(3)
        chars = list("aaabbbccdeethin  ▁éxyzq12") + ["\t", "\u3000", "ﬁ", "Ａ", "Ⅷ", "e\u0301", "ｶﾞ", "ア", "…", "\u200b", "\u00ad", "ß", "İ", "각", "\u1100\u1161", "\u0301", "😀", "\u2047", "\u00a0"]
        texts = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 40))) for _ in range(600)]
        texts += ["", " ", "   ", "\u3000 \t", " a", "a ", "▁", "a" * 3000, "a  b" * 200, "\u00a8"]
        for text in texts:
            ids = theirs.encode(text)
            assert ours.encode(text) == ids, text
            if not (squeeze is False and prefix is False):
                assert ours.decode(ids) == theirs.decode(ids), text


def test_models_beyond_reach_are_refused():
    for extra in (message(2, message(3, 3)), message(1, message(1, "user") + message(3, 4)), message(2, message(3, 1) + message(24, 1))):
        with pytest.raises(ValueError, match="supported"):
            pieces.Transducer(small_model(None, True) + extra)


def test_encoding_and_decoding_frames(spark, transducer):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, LONG, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, back string")
    coded = pieces.encode(docs)
    back = pieces.decode(coded, into="back").collect()
    assert coded.columns == ["doc_id", "text", "back", "ids"] and len(back) == 5
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert {r["doc_id"]: len(r["ids"]) for r in back}[2] == 0
    assert pieces.encode(docs.limit(0)).count() == 0
    gaps = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["text"] for r in pieces.decode(gaps).collect()] == ["", ""]

import math

import pytest
from pyspark.sql import functions as F

from fairshare.functions import display
from fairshare.functions.labels import SECTOR_MAP, with_canonical_label
from fairshare.functions.parse import epsilon_ratio, guarded_ratio, safe_double, safe_int, typed
from fairshare.operators.clean import clamp_negatives, prepare


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("12", 12.0), ("-3.5", -3.5), ("+7", 7.0), (".5", 0.5), ("5.", 5.0), ("1e5", 1e5),
        ("1,234,567.5", 1234567.5), (" 9\t", 9.0), ("12345678.0", 12345678.0), ("1.2E7", 1.2e7),
        ("12d", None), ("12f", None), ("NaN", None), ("inf", None), ("-Infinity", None),
        ("0x10", None), ("1 2", None), ("", None), ("abc", None), (None, None), ("1e", None),
    ],
)
def test_safe_double(rows, text, value):
    assert rows("t string", (text,)).select(safe_double(F.col("t"))).first()[0] == value


def test_safe_int_cuts_fractions_and_refuses_overflow(rows):
    df = rows("t string", ("2021",), ("2021.9",), ("x",), ("99999999999",))
    assert [r[0] for r in df.select(safe_int(F.col("t"))).collect()] == [2021, 2021, None, None]


def test_typed_kinds(rows):
    df = rows("t string, d double", (" Foo ", 1.5), ("123", float("nan")), ("2020", 2020.0))
    got = df.select(*[typed(df, "t", k).alias(k) for k in ("label", "digits", "year", "number")])
    assert [tuple(r) for r in got.collect()] == [
        ("foo", None, None, None),
        ("123", "123", None, 123.0),
        ("2020", "2020", 2020, 2020.0),
    ]
    numbers = df.select(typed(df, "d", "double").alias("v"), typed(df, "d", "year").alias("y"))
    assert [tuple(r) for r in numbers.collect()] == [(1.5, None), (None, None), (2020.0, 2020)]
    with pytest.raises(ValueError):
        typed(df, "t", "other")


def test_number_refuses_exponents(rows):
    df = rows("t string", ("1e5",), ("-12.50",), ("1,200",))
    assert [r[0] for r in df.select(typed(df, "t", "number")).collect()] == [None, -12.5, 1200.0]


def test_ratios(rows):
    df = rows("a double, b double", (6.0, 3.0), (6.0, 0.0), (6.0, None), (6.0, -1.0))
    got = df.select(guarded_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r[0] for r in got] == [2.0, None, None, None]
    by_a = df.select(guarded_ratio(F.col("a"), F.col("b"), guard=F.col("a")).alias("r")).collect()
    assert [r[0] for r in by_a] == [2.0, None, None, -6.0]
    assert math.isclose(df.select(epsilon_ratio(F.col("a"), F.col("b"))).take(2)[1][0], 6e9)


def test_prepare_drops_rows_without_a_key(rows):
    df = rows("code string, n string", ("A", "1"), (None, "2"), ("B", "x"))
    got = prepare(df, [("code", "string", "k"), ("n", "int", "v")], ["k", "v"]).collect()
    assert [tuple(r) for r in got] == [("A", 1)]


def test_clamp_keeps_nulls(rows):
    df = clamp_negatives(rows("x double", (-1.0,), (2.0,), (None,)), ["x"])
    assert [r[0] for r in df.collect()] == [0.0, 2.0, None]


def test_labels(rows):
    assert len(SECTOR_MAP) == 105 and len(set(SECTOR_MAP.values())) == 19
    df = rows("i int, s string", (1, "  Santé "), (2, "WASH"), (3, "something else"), (4, None))
    got = with_canonical_label(df, "s", "c").orderBy("i").collect()
    assert [r["c"] for r in got] == ["health", "wash", None, None]
    assert got[0]["s"] == "  Santé "
    own = with_canonical_label(df, "s", "c", {"wash": "water"}).orderBy("i").collect()
    assert [r["c"] for r in own] == [None, "water", None, None]


def test_display(rows):
    df = rows("a double, n string", (1234567.4, "funding_gap_pct"))
    got = df.select(
        display.dollars(F.col("a")),
        display.percent(F.lit(12.345)),
        display.percent(F.lit(0.1234), 1, 100),
        display.decimals(F.lit(0.12345), 3),
        display.thousands(F.col("a")),
        display.prettify(F.col("n")),
    ).first()
    assert tuple(got) == ("$1,234,567", "12.3%", "12.3%", "0.123", "1,234,567", "Funding Gap Pct")


def test_white_space_around_numbers(rows):
    df = rows("t string", (" \t2020\r",), ("20 20",), ("2,020 ",))
    for kind in ("int", "year", "number", "double"):
        got = [r[0] for r in df.select(typed(df, "t", kind)).collect()]
        assert got == [2020, None, 2020]

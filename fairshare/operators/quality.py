"""Quality checks on the feature table.

Nulls, ranges, zeros and join coverage all come from one aggregate over one scan; its single row
is then spread into one row per check. Duplicate keys need a grouping of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairshare.operators.features import KEY

# Columns checked for nulls, bounds, zeros, and join coverage.
NULL_COLUMNS = (
    "country_code", "cluster_name", "year",
    "total_requirements_usd", "total_funding_usd",
    "total_inneed", "total_targeted", "total_population",
    "funding_gap_usd", "funding_gap_pct", "funding_coverage_rate",
    "beneficiary_to_funding_ratio", "need_to_requirements_ratio",
    "targeting_coverage_rate", "cost_per_beneficiary",
    "funding_per_capita", "requirement_per_capita",
    "disaster_severity_score", "sector_funding_efficiency_pct",
    "project_vs_sector_avg",
)
BOUNDS = {
    "funding_coverage_rate": (0.0, 10.0),
    "funding_gap_pct": (-10.0, 100.0),
    "targeting_coverage_rate": (0.0, 2.0),
    "total_funding_usd": (0.0, None),
    "total_requirements_usd": (0.0, None),
    "total_inneed": (0.0, None),
    "total_targeted": (0.0, None),
    "cost_per_beneficiary": (0.0, None),
    "disaster_severity_score": (0.0, None),
}
ZERO_COLUMNS = ("total_requirements_usd", "total_funding_usd", "total_population", "total_inneed")
JOIN_COLUMNS = {
    "HNO (total_inneed)": "total_inneed",
    "Population (total_population)": "total_population",
    "EMDAT (disaster_severity)": "disaster_severity_score",
}

SPREAD = {"min": "min", "max": "max", "avg": "avg", "std": "stddev"}

SAMPLE_COLUMNS = [
    "country_code", "cluster_name", "year",
    "total_requirements_usd", "total_funding_usd",
    "funding_gap_pct", "funding_coverage_rate",
    "beneficiary_to_funding_ratio", "disaster_severity_score",
]


# The checks are SQL texts: a profile holds many small expressions, and each is one call this way.


def _share(part: str) -> str:
    return f"coalesce(try_divide({part}, rows) * 100, 0D)"


def _grade(good: str, fair: str) -> str:
    return f"CASE WHEN {good} THEN 'ok' WHEN {fair} THEN 'warn' ELSE 'fail' END"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _profile(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """One row of measures."""
    return df.agg(
        F.expr("count(1) AS rows"), *[F.expr(f"{sql} AS {name}") for name, sql in measures.items()]
    )


def _spread(profile: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """One output row per dict of column name to SQL, all read from the single profile row."""
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in row.items()) + ")"
        for row in rows
    ]
    return profile.select(F.expr(f"inline(array({', '.join(structs)}))"))


def _null_measures(columns: Iterable[str]) -> dict[str, str]:
    return {f"nulls_{c}": f"count_if({c} IS NULL)" for c in columns}


def _range_measures(columns: Iterable[str]) -> dict[str, str]:
    out = {}
    for c in columns:
        value = f"CAST({c} AS double)"
        out |= {f"{name}_{c}": f"{fn}({value})" for name, fn in SPREAD.items()}
        out[f"neg_{c}"] = f"count_if({c} < 0)"
    return out


def _zero_measures(columns: Iterable[str]) -> dict[str, str]:
    return {f"zeros_{c}": f"count_if({c} IS NULL OR {c} = 0)" for c in columns}


def _match_measures(columns: Iterable[str]) -> dict[str, str]:
    return {f"matched_{c}": f"count_if({c} > 0)" for c in columns}


def _breaks(c: str, low: float | None, high: float | None) -> tuple[str, str]:
    """Whether the smallest and the largest value fall outside the bounds; null counts as inside."""
    below = "false" if low is None else f"coalesce(min_{c} < {low}D, false)"
    above = "false" if high is None else f"coalesce(max_{c} > {high}D, false)"
    return below, above


def null_profile(df: DataFrame, columns: Iterable[str] = NULL_COLUMNS) -> DataFrame:
    """(column, nulls, null_pct, status), most nulls first."""
    names = _present(df, columns)
    rows = []
    for c in names:
        pct = _share(f"nulls_{c}")
        status = _grade(f"{pct} < 20", f"{pct} < 60")
        rows.append(
            {"column": _text(c), "nulls": f"nulls_{c}", "null_pct": pct, "status": status}
        )
    return _spread(_profile(df, _null_measures(names)), rows).orderBy(F.desc("nulls"), "column")


def range_check(df: DataFrame, bounds: dict[str, tuple] = BOUNDS) -> DataFrame:
    """(column, min_val, max_val, avg_val, std_val, neg_count, status) per bounded column."""
    names = _present(df, bounds)
    rows = []
    for c in names:
        below, above = _breaks(c, *bounds[c])
        row = {"column": _text(c)} | {f"{name}_val": f"{name}_{c}" for name in SPREAD}
        row |= {"neg_count": f"neg_{c}", "status": f"if({below} OR {above}, 'fail', 'ok')"}
        rows.append(row)
    return _spread(_profile(df, _range_measures(names)), rows)


def zero_check(df: DataFrame, columns: Iterable[str] = ZERO_COLUMNS) -> DataFrame:
    """(column, zeros, zero_pct, status): zero or null."""
    names = _present(df, columns)
    rows = []
    for c in names:
        pct = _share(f"zeros_{c}")
        status = _grade(f"{pct} < 30", f"{pct} < 60")
        rows.append(
            {"column": _text(c), "zeros": f"zeros_{c}", "zero_pct": pct, "status": status}
        )
    return _spread(_profile(df, _zero_measures(names)), rows)


def join_coverage(df: DataFrame, checks: dict[str, str] = JOIN_COLUMNS) -> DataFrame:
    """(label, column, matched, match_pct, status): rows a join has given a value above zero."""
    present = {label: c for label, c in checks.items() if c in df.columns}
    rows = []
    for label, c in present.items():
        pct = _share(f"matched_{c}")
        row = {"label": _text(label), "column": _text(c), "matched": f"matched_{c}"}
        row |= {"match_pct": pct, "status": _grade(f"{pct} > 30", f"{pct} > 10")}
        rows.append(row)
    return _spread(_profile(df, _match_measures(present.values())), rows)


def duplicate_keys(df: DataFrame, keys: Iterable[str] = KEY) -> DataFrame:
    """(total_rows, distinct_keys, duplicates, status) from one grouping."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    distinct = F.count(F.lit(1))
    return groups.agg(
        total.alias("total_rows"),
        distinct.alias("distinct_keys"),
        (total - distinct).alias("duplicates"),
        F.when(total == distinct, "ok").otherwise("warn").alias("status"),
    )


def duplicate_groups(df: DataFrame, keys: Iterable[str] = KEY, n: int = 10) -> DataFrame:
    """The ``n`` keys that repeat most."""
    columns = list(keys)
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    return groups.where("count > 1").orderBy(F.desc("count"), *columns).limit(n)


def issues(df: DataFrame, keys: Iterable[str] = KEY) -> DataFrame:
    """(check, column, value, expected) of everything that needs attention; empty if nothing does.

    Zero rates are reported by ``zero_check`` but are not issues.
    """
    columns = list(keys)
    nulls, bounded = _present(df, NULL_COLUMNS), _present(df, BOUNDS)
    joins = {label: c for label, c in JOIN_COLUMNS.items() if c in df.columns}
    rows = []

    def add(check: str, column: str, value: str, expected: str, bad: str) -> None:
        row = {"check": _text(check), "column": _text(column), "value": f"CAST({value} AS double)"}
        rows.append(row | {"expected": _text(expected), "bad": bad})

    for c in nulls:
        pct = _share(f"nulls_{c}")
        add("high null rate", c, pct, "<60", f"{pct} >= 60")
    for c in bounded:
        low, high = BOUNDS[c]
        below, above = _breaks(c, low, high)
        if low is not None:
            add("out of range", c, f"min_{c}", f">={low}", below)
        if high is not None:
            add("out of range", c, f"max_{c}", f"<={high}", above)
    for label, c in joins.items():
        pct = _share(f"matched_{c}")
        add("low join coverage", label, pct, ">=10", f"{pct} < 10")

    measures = _null_measures(nulls) | _range_measures(bounded) | _match_measures(joins.values())
    found = _spread(_profile(df, measures), rows).where("bad").drop("bad")
    repeated = duplicate_keys(df, columns).where("duplicates > 0")
    return found.unionByName(
        repeated.selectExpr(
            "'duplicate keys' AS check",
            f"{_text(', '.join(columns))} AS column",
            "CAST(duplicates AS double) AS value",
            "'0' AS expected",
        )
    )


def sample_rows(df: DataFrame, n: int = 10, funded_only: bool = True) -> DataFrame:
    """The first ``n`` rows by key, for a look at the table."""
    if funded_only:
        df = df.where("total_funding_usd > 0")
    return df.select(*SAMPLE_COLUMNS).orderBy(*KEY).limit(n)

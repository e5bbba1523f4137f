"""Run the registered queries beside their SQL and report the differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(_cell(v) for v in row) for row in rows), key=repr)


def _cell(value):
    if isinstance(value, float):
        return value + 0.0
    return value.item() if hasattr(value, "item") else value


def _whole(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    """``ours`` with integer columns that hold nulls as such: they arrive as floats where ``theirs`` keeps integers."""
    for c in ours.columns.intersection(theirs.columns):
        if str(theirs[c].dtype) == "Int64" and ours[c].dtype == float:
            ours = ours.assign(**{c: ours[c].astype("Int64")})
    return ours


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""
    ours = _whole(ours, theirs)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    kinds = [
        f"{c}: {ours[c].dtype} and {theirs[c].dtype}"
        for c in ours.columns
        if ours[c].notna().all() and ours[c].dtype != theirs[c].dtype
    ]
    if kinds and len(ours):
        return "types " + "; ".join(kinds)
    a, b = _normal(ours), _normal(theirs)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} rows, first {bad[0]}" if bad else None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from checks.oracle import SQL
    from checks.queries import QUERIES
    from fairshare.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("compare")
    connection = tables(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            ours = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - started
            found = differences(ours, connection.sql(SQL[name]).df()) if name in SQL else None
        except Exception as error:
            took, found = time.time() - started, f"{type(error).__name__}: {str(error)[:1500]}"
            ours = ()
        failed += found is not None
        state = "FAIL" if found else ("ok" if name in SQL else "rows")
        print(f"{state:4} {took:6.2f}s {len(ours):7} {name} {found or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())

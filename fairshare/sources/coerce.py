"""Turning text columns into numbers where most cells are numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairshare.functions.parse import NUMBER, WHOLE, number_text, safe_double

# Code columns that stay text, compared in lower case.
ID_COLUMNS = (
    "country_code", "countrycode", "iso3", "iso", "cluster_code",
    "clustercode", "adm1_code", "adm2_code", "adm3_code",
    "chfprojectcode", "externalprojectcode", "pooledfundid",
    "chfid", "donorcode",
)


def whole_number(text: Column) -> Column:
    """Text to bigint where it is a whole number that fits, else null."""
    return F.when(text.rlike(WHOLE), text.try_cast("bigint"))


def safe_coerce(
    df: DataFrame, threshold: float = 0.8, id_columns: Iterable[str] = ID_COLUMNS
) -> DataFrame:
    """Cast a text column to a number if at least ``threshold`` of all rows parse.

    Nulls count as not parsed. Cells that do not parse become null; a column of whole numbers
    that all fit becomes ``bigint``, any other ``double``. One aggregate over all columns decides, one
    projection casts.
    """
    keep = {c.lower() for c in id_columns}
    texts = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name.lower() not in keep
    ]
    if not texts:
        return df
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(texts):
        text = number_text(F.col(f"`{name}`"))
        counts.append(F.count_if(text.rlike(NUMBER)).alias(f"n{i}"))
        counts.append(F.count(whole_number(text)).alias(f"w{i}"))
    found = df.agg(*counts).first()
    rows = max(found["rows"], 1)
    casts = {}
    for i, name in enumerate(texts):
        if found[f"n{i}"] / rows < threshold:
            continue
        c = F.col(f"`{name}`")
        whole = found[f"n{i}"] == found[f"w{i}"] > 0
        if whole:
            casts[name] = whole_number(number_text(c))
        else:
            casts[name] = safe_double(c)
    return df.select(*[casts.get(n, F.col(f"`{n}`")).alias(n) for n in df.columns])

"""Bounded samples that do not depend on how the rows are partitioned."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARE = 4


def key_digest(key: Iterable[str], seed: int) -> Column:
    """A hex digest per row key; null keys are told apart from empty ones."""
    texts = [F.col(c).cast("string") for c in key]
    # each part with its length before it, so that different keys never give the same text
    sized = [F.concat_ws(":", F.length(t).cast("string"), t) for t in texts]
    parts = [F.when(t.isNull(), "null").otherwise(s) for t, s in zip(texts, sized)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def sample_rows_by_key(
    df: DataFrame, key: Iterable[str], rows: int, size: int, seed: int = 42
) -> DataFrame:
    """The ``size`` rows with the smallest key digests; ``rows`` is the row count of ``df``.

    Digests under a threshold are picked first, so that a task passes on only its share of a few
    times ``size`` rows and not ``size`` rows of its own. Where ``rows`` is too high, or keys repeat,
    and too few pass, the threshold is dropped. Adds column ``_digest``.
    """
    digest = df.withColumn("_digest", key_digest(key, seed))
    if rows > SPARE * size:
        share = SPARE * size / rows
        limit = format(int(share * 16**12), "012x")
        few = digest.where(F.substring("_digest", 1, 12) < limit).orderBy("_digest", *key).limit(size)
        if few.select("_digest").count() == size:
            return few
    return digest.orderBy("_digest", *key).limit(size)

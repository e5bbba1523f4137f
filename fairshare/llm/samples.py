"""Bounded samples of labelled and unlabelled documents, for fits that read only a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under the hash threshold, in multiples of the keys wanted.
SPARE = 4
_GRID = 1 << 40


def _place(key: Column, seed: int) -> Column:
    """From 0 to 2 ** 40, by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_GRID))


def draw_keys(keys: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct values of ``keys.key``, those least by a seeded hash; nulls are left out.

    A threshold on the hash, set from the approximate number of distinct keys, comes first, so a
    task passes on only its share. A threshold that lets too few through is dropped.
    """
    keys = keys.where(F.col("key").isNotNull()).select("key")
    about = keys.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    order = (_place(F.col("key"), seed), F.col("key"))
    if about <= SPARE * most:
        return keys.distinct().orderBy(*order).limit(most)
    few = keys.where(_place(F.col("key"), seed) < int(_GRID * SPARE * most / about)).distinct().orderBy(*order).limit(most)
    return few if few.count() == most else keys.distinct().orderBy(*order).limit(most)


def one_text_each(docs: DataFrame, drawn: DataFrame, key: str, text: str, more: list[str] | None = None) -> DataFrame:
    """(key, doc, the other columns of ``drawn``): one row for every drawn key that ``docs`` has.

    ``doc`` holds the text and the columns ``more``. ``drawn`` has a bounded number of unique keys
    and is broadcast. Of several rows of a key the one with the least text hash is taken, on the map
    side first, so a key that repeats sends one row per task and gives one row.
    """
    doc = F.struct(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(c) for c in more or []])
    own = docs.select(F.col(f"`{key}`").alias("key"), doc.alias("doc"))
    rest = [c for c in drawn.columns if c != "key"]
    met = own.join(F.broadcast(drawn), "key")
    least = F.min_by("doc", F.struct(F.xxhash64("doc"), F.col("doc.text")))
    return met.groupBy("key", *rest).agg(least.alias("doc"))


def known_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, y): one row per key, the largest of its labels; null keys and labels say nothing."""
    known = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    return known.groupBy(F.col(f"`{key}`").alias("key")).agg((F.max(F.col(f"`{label}`")) == 1).alias("y"))

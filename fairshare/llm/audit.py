"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Rows are counted once by the pattern of filters that they fail. The counts of a part are a tensor
with one axis of two places (pass, fail) for every filter, and each figure of each step of each
order is a contraction of that tensor: along every axis it selects pass, fail, or all.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairshare.llm.texts import count_words, spaced_words
from fairshare.sources.tables import settle

#: What a contraction selects along an axis.
PASS, FAIL, ALL = 0, 1, 2
SELECT = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
#: All orders are listed, so their number bounds the number of filters.
MOST_FILTERS = 7
#: Parts whose orders are written out at once.
AT_ONCE = 64


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of single texts, null taken as empty.

    A: under 100 words. B: distinct words under 80 % of the words. C: ``[A-Z]`` over 10 % of the
    code points. D: holds any of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words, count = spaced_words(text), count_words(text)
    distinct = F.when(count == 0, 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.char_length(text) - F.char_length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": count < 100,
        "B": distinct * 100 < count * 80,
        "C": capitals * 100 > F.char_length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def later_copies(rows: DataFrame, key: str, digest: str, into: str) -> DataFrame:
    """``rows`` with ``into``: whether a row with a smaller ``key`` has the same ``digest``.

    A null key is smaller than none and larger than none; equal keys are no copies of each other.
    One row per digest and task is shuffled for the least keys, and only digests with two keys are
    joined back.
    """
    ends = rows.where(F.col(key).isNotNull()).groupBy(F.col(digest).alias("_digest"))
    ends = ends.agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first < _last")
    joined = rows.join(ends, F.col(digest) == F.col("_digest"), "left")
    return joined.withColumn(into, F.coalesce(F.col(key) > F.col("_first"), F.lit(False))).drop("_digest", "_first", "_last")


def pattern(fails: Mapping[str, Column]) -> Column:
    """The failed filters as bits, the first filter highest; a null failure counts as a pass."""
    bits = [F.shiftleft(F.coalesce(f, F.lit(False)).cast("int"), len(fails) - 1 - n) for n, f in enumerate(fails.values())]
    total = F.lit(0)
    for bit in bits:
        total = total + bit
    return total


@lru_cache
def _orders(names: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All orders, and for each step its filter and which places of the contracted tensor it reads.

    Those are the rows kept, removed, failing the filter at all, as flat places among 3 ** k.
    """
    k = len(names)
    axes = np.array(list(permutations(range(k))))
    named = ["".join(names[i] for i in order) for order in axes]
    kept = np.full((len(axes), k, k), ALL)
    removed = np.full((len(axes), k, k), ALL)
    for step in range(k):
        for after in range(step, k):
            np.put_along_axis(kept[:, after], axes[:, step : step + 1], PASS, 1)
        for after in range(step + 1, k):
            np.put_along_axis(removed[:, after], axes[:, step : step + 1], PASS, 1)
        np.put_along_axis(removed[:, step], axes[:, step : step + 1], FAIL, 1)
    places = (3,) * k
    failing = np.full((k, k), ALL)
    alone = np.full((k, k), PASS)
    np.fill_diagonal(failing, FAIL)
    np.fill_diagonal(alone, FAIL)
    flat = lambda x: np.ravel_multi_index(tuple(np.moveaxis(x, -1, 0)), places)
    return named, axes, flat(kept), flat(removed), np.stack([flat(failing), flat(alone)])


def contract(tensor: np.ndarray) -> np.ndarray:
    """(…, 2, 2, …) counts to (…, 3 ** k) sums over every choice of pass, fail or all along k axes.

    The first two axes (parts, measures) stay.
    """
    k = tensor.ndim - 2
    operands: list = [tensor, list(range(k + 2))]
    for axis in range(k):
        operands += [SELECT, [k + 2 + axis, axis + 2]]
    sums = np.einsum(*operands, [0, 1, *range(k + 2, 2 * k + 2)], optimize=True)
    return sums.reshape(*tensor.shape[:2], 3**k)


def step_figures(tensor: np.ndarray, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The figures of every part, order and step, from (part, measure, 2, 2, …); measure 0 counts rows."""
    _, axes, kept, removed, (failing, alone) = _orders(names)
    sums = contract(tensor)
    gone = sums[:, 0][:, removed]
    shapley = np.stack([(gone * (axes == f)).sum((1, 2)) for f in range(len(names))], 1)
    own = {
        "kept": sums[:, 0][:, kept],
        "removed": gone,
        "redundant": sums[:, 0][:, failing][:, axes] - gone,
        "unique_fails": sums[:, 0][:, alone][:, axes],
        "shapley": shapley[:, axes],
    }
    return own | {f"lost_{m}": sums[:, m][:, removed] for m in range(1, tensor.shape[1])}


def audit(rows: DataFrame, fails: Mapping[str, Column], part: Column, lost: Mapping[str, Column]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, shapley, …) of every order of the filters.

    ``fails`` maps filter names, a letter each, to whether a row fails; a null counts as a pass.
    Filters of an order apply from left to right, and ``step`` counts them from 1. ``kept`` rows
    are left after the step; ``removed`` go at it; ``redundant`` fail its filter but went before;
    ``unique_fails`` fail no other filter; ``shapley`` is what the filter removes, summed over all
    orders. For every entry of ``lost`` a column of that name counts the removed rows where it is
    true. A part without a row has none; parts are compared as strings, null as the empty one.

    Only 2 ** k counts per part are shuffled, after a sum on the map side, so neither a large part
    nor a common pattern weighs on a task. At most ``MOST_FILTERS`` filters.
    """
    names, measures = tuple(fails), list(lost)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"{len(names)} filters, not 1 to {MOST_FILTERS}")
    marked = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        pattern(fails).alias("pattern"),
        *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_{n}") for n, c in enumerate(lost.values())],
    )
    sums = [F.sum(f"_{n}").alias(f"_{n}") for n in range(len(lost))]
    cells = marked.groupBy("part", "pattern").agg(F.count(F.lit(1)).alias("_n"), *sums)
    # at most 2 ** k cells a part
    counts = F.array("_n", *[f"_{n}" for n in range(len(lost))])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("pattern", counts.alias("counts"))).alias("cells"))
    figures = ["kept", "removed", "redundant", "unique_fails", *measures, "shapley"]
    schema = T.StructType(
        [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
        + [T.StructField(f, T.LongType()) for f in figures]
    )
    inner = {m: f"lost_{n + 1}" for n, m in enumerate(measures)}
    shape = (1 + len(measures), 1 << len(names))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(names)[0]
        k = len(names)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                flat = np.zeros((some.num_rows, *shape), np.int64)
                for n, own in enumerate(some.column("cells").to_pylist()):
                    for cell in own:
                        flat[n, :, cell["pattern"]] = cell["counts"]
                found = step_figures(flat.reshape(some.num_rows, shape[0], *(2,) * k), names)
                each = len(orders) * k
                columns = [
                    some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), each))),
                    pa.array(orders * some.num_rows).take(pa.array(np.repeat(np.arange(len(orders) * some.num_rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * some.num_rows)),
                    *[pa.array(found[inner.get(f, f)].ravel()) for f in figures],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *figures])

    return parts.mapInArrow(written, schema)


def audit_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """The audit of five filters over whole documents: A to D of ``text_failures``, and E, later copies.

    E fails where a document with a smaller key has the same text, removed or not. ``good_lost``
    counts removed documents with a label ``quality`` of 1, ``toxic_lost`` those with ``toxic`` of 1;
    of several labels of a key the highest counts, and documents or labels without a key meet none.
    Null texts are empty, a null part is the empty string, repeated rows count each; without
    documents the result is empty.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    flags = [f.alias(f"fails_{name}") for name, f in text_failures(own).items()]
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").alias("part"), F.unhex(F.sha2(own, 256)).alias("digest"), *flags
    )
    marked = later_copies(settle(narrow, "marked"), "key", "digest", "fails_E").drop("digest")
    known = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = marked.join(known, "key", "left")
    fails = {name: F.col(f"fails_{name}") for name in "ABCDE"}
    return audit(rows, fails, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})

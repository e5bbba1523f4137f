"""CSV scans that keep every cell as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairshare.sources.names import plain_name, tag_name, unique_names

# Cell texts that stand for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


#: A cell of a record, with the comma before it: quoted, with doubled quotes inside, or plain.
CELL = r'(?:^|,)(?:"(?:[^"]++|"")*+"[^,]*+|[^,]*+)'


def _odd_lines(spark: SparkSession, path) -> DataFrame:
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return spark.read.text(path).where(quotes % 2 == 1)


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some record may run over several lines.

    A record that does opens a quote on its first line, so that line holds an odd number of them.
    Without such a line the files can be split, which a multi-line scan cannot.
    """
    return not _odd_lines(spark, path).isEmpty()


def parts_by_scan(spark: SparkSession, path: str) -> list[tuple[str | list[str], bool]]:
    """(files, whether their records may span lines): those that can be split, and the others.

    One scan for lines with an odd number of quotes tells them apart file by file, so an odd quote
    slows down one file and not the dataset.
    """
    odd = {r[0] for r in _odd_lines(spark, path).select(F.input_file_name()).distinct().collect()}
    if not odd:
        return [(path, False)]
    files = spark.read.text(path).inputFiles()
    even = [f for f in files if f not in odd]
    if not even or not odd <= set(files):
        return [(path, True)]
    return [([unquote(f) for f in even], False), ([unquote(f) for f in sorted(odd)], True)]


def _reader(spark: SparkSession, multi_line: bool):
    options = {"header": False, "quote": '"', "escape": '"', "multiLine": multi_line}
    return spark.read.options(**options)


def _scan(spark, parts, names, missing, tags=None) -> DataFrame:
    record = next(n for n in ("_record", "__record", "___record") if n not in names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, record]])
    found = []
    for files, multi_line in parts:
        # all cells are read, whatever columns are asked for, so that every line is judged whole
        reader = _reader(spark, multi_line).options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=record, columnPruning=False
        )
        found.append(reader.schema(schema).csv(files))
    raw = reduce(DataFrame.unionByName, found)
    # the record is kept where its number of cells is not that of the header
    text = F.col(f"`{record}`")
    whole = text.isNull() | (F.regexp_count(text, F.lit(CELL)) <= len(names))
    # naming the line by its first cell also keeps a cell in scans that need none, such as a count
    longer = F.raise_error(F.concat_ws("", F.lit("a line has more cells than its header: "), F.col(f"`{names[0]}`")))
    raw = raw.where(F.when(whole, True).otherwise(longer.cast("boolean")))
    if tags is not None:
        pairs = [F.col(f"`{n}`").eqNullSafe(F.lit(t)) for n, t in zip(names, tags)]
        raw = raw.where(~reduce(and_, pairs))
    cells = [F.when(~F.col(f"`{n}`").isin(missing), F.col(f"`{n}`")).alias(n) for n in names]
    return raw.select(*cells)


def _head(spark: SparkSession, path: str, multi_line: bool) -> list:
    head = _reader(spark, multi_line).csv(path).limit(2).collect()
    if not head:
        raise ValueError(f"no header line in {path}")
    return head


def load_csv(
    spark: SparkSession,
    path: str,
    clean: Callable[[str | None], str] = plain_name,
    multi_line: bool | None = None,
    missing: list[str] = MISSING,
) -> DataFrame:
    """Plain CSV: one header line, names cleaned by ``clean``, all columns text.

    Lines shorter than the header are filled with nulls; a longer one fails the read, also where the
    cells too many are empty, since there is no telling which of its cells belong to which column.

    ``multi_line=None`` looks whether records span lines and splits the files in which none does.
    """
    parts = parts_by_scan(spark, path) if multi_line is None else [(path, multi_line)]
    names = unique_names(clean(c) for c in _head(spark, path, parts[-1][1])[0])
    return _scan(spark, parts, names, missing)


def load_hxl(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    missing: list[str] = MISSING,
) -> DataFrame:
    """CSV with a label line and a ``#tag`` line; names come from the tags.

    Without a tag line the label line names the columns. The tag line is dropped by its whole
    content, so data whose first cell starts with ``#`` stays.
    """
    parts = parts_by_scan(spark, path) if multi_line is None else [(path, multi_line)]
    head = _head(spark, path, parts[-1][1])
    tags = head[1] if len(head) > 1 and (head[1][0] or "").startswith("#") else None
    names = unique_names(map(tag_name, head[0] if tags is None else tags))
    return _scan(spark, parts, names, missing, tags)

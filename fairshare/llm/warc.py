"""WARC archives as a Python data source: header-first reads, pushed-down filters, revisit records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from fairshare.sources.tables import settle

READ_SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
WRITE_SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload binary"
)
# The record headers that become columns.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
FILE_BYTES = 64 << 20
PIECE = 64 << 10
ROWS = 256
BATCH_BYTES = 8 << 20
MANIFEST = "_warc_files"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local file."""
    if path.startswith("file:/"):  # with one, two or three slashes
        path = "/" + path[5:].lstrip("/")
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path)


def record(row: dict) -> bytes:
    """One archive record as a gzip member.

    A response holds HTTP headers and the payload, a revisit the headers alone; both state the
    digest and length of the full payload. White space in header values becomes single spaces, so
    a value cannot end its header.
    """
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else payload)
    values = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"] and f"<{row['record_id']}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Refers-To": row["refers_to"] and f"<{row['refers_to']}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if row["record_type"] == "revisit":
        values["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = [f"{k}: {' '.join(v.split())}" for k, v in values.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


class _Bytes:
    """A file's bytes, unpacked member by member if it is gzipped, and skipped without being kept."""

    def __init__(self, file):
        self.file, self.raw, self.ready = file, b"", b""
        self.raw = file.read(PIECE)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.unpacker = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bytes:
        """Some next bytes; none at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(PIECE)
                if not self.raw:
                    return b""
            if not self.packed:
                out, self.raw = self.raw, b""
                return out
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(self.raw, PIECE)
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if out:
                return out

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark) + 1)
            more = self._more()
            if not more:
                if self.ready.strip():
                    raise ValueError("the archive ends within a header")
                return None
            self.ready += more
        out, self.ready = self.ready[: at + len(mark)], self.ready[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next ``n`` bytes, or nothing if they are only to be passed over.

        Plain files are passed over by seeking; packed ones have to be unpacked, but nothing is kept.
        """
        parts = []
        while n > len(self.ready):
            n -= len(self.ready)
            if keep:
                parts.append(self.ready)
            self.ready = b""
            if not keep and not self.packed and n > len(self.raw):
                self.file.seek(self.file.tell() + n - len(self.raw))
                self.raw, n = b"", 0
                break
            self.ready = self._more()
            if not self.ready:
                raise ValueError("the archive ends within a record")
        if keep:
            parts.append(self.ready[:n])
        self.ready = self.ready[n:]
        return b"".join(parts)


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(file, wanted, payloads: bool) -> Iterator[dict]:
    """The records of one archive whose header fields ``wanted`` accepts.

    The header is parsed first; the block of a record that is not wanted is passed over, and without
    ``payloads`` so is what follows the HTTP headers.
    """
    data = _Bytes(file)
    while (head := data.until(b"\r\n\r\n")) is not None:
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = headers(head.lstrip())
        length = int(fields["content-length"])
        row = {c: fields.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        row |= {"payload_bytes": None, "payload": None}
        if not wanted(row):
            data.take(length, keep=False)
        elif fields.get("content-type", "").startswith("application/http") and length:
            http = data.until(b"\r\n\r\n")
            size = headers(http).get("content-length")
            row["payload_bytes"] = int(size) if size is not None else length - len(http)
            body = data.take(length - len(http), keep=payloads)
            if payloads and row["record_type"] != "revisit":
                row["payload"] = body
                if row["payload_digest"] and digest(body) != row["payload_digest"]:
                    raise ValueError(f"the payload of {row['record_id']} does not have its digest")
            yield row
        else:
            body = data.take(length, keep=payloads)
            yield row | {"payload_bytes": length, "payload": body if payloads else None}
        data.take(4, keep=False)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    """Partitions are runs of whole files; filters on header columns are applied to the headers."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.bytes = int(options.get("partitionbytes", FILE_BYTES))
        self.kept: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(one, EqualTo) and isinstance(one.value, str):
                self.kept.append(("in", name, (one.value,)))
            elif name in HEADERS and isinstance(one, In):
                self.kept.append(("in", name, tuple(one.value)))
            elif name in HEADERS and isinstance(one, StringStartsWith):
                self.kept.append(("starts", name, (one.value,)))
            else:
                yield one

    def partitions(self) -> list[Files]:
        system, base = _place(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            return [Files([base])]
        listed = {f.path: f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file}
        names = [p for p in listed if p.rsplit("/", 1)[-1].startswith(MANIFEST)]
        if names:  # a folder that this source has written holds what its commits name, no more
            named = [line for p in names for line in system.open_input_file(p).read().decode().splitlines()]
            files = [listed[f"{base.rstrip('/')}/{name}"] for name in named]
        else:
            files = [f for p, f in listed.items() if p.endswith((".warc", ".warc.gz"))]
        runs: list[list[str]] = []
        room = 0
        for f in sorted(files, key=lambda f: f.path):
            if not runs or f.size > room:
                runs.append([])
                room = self.bytes
            runs[-1].append(f.path)
            room -= f.size
        return [Files(r) for r in runs]

    def _wanted(self, row: dict) -> bool:
        for how, name, values in self.kept:
            value = row[name]
            if value is None or not (value in values if how == "in" else value.startswith(values[0])):
                return False
        return True

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        # without files Spark asks for one partition that is None
        schema = pa.schema(
            [(f.name, {"long": pa.int64(), "binary": pa.binary()}.get(f.dataType.typeName(), pa.string())) for f in self.schema]
        )
        system, _ = _place(self.path)
        rows, size = [], 0
        for path in partition.paths if partition else []:
            with system.open_input_file(path) as file:
                for row in records(file, self._wanted, self.payloads):
                    rows.append({n: row[n] for n in schema.names})
                    size += len(row["payload"] or b"")
                    if len(rows) >= ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; the commit names those of the tasks that count."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.bytes:
                    if out:
                        out.close()
                    names.append(f"part-{uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{base.rstrip('/')}/{names[-1]}", compression=None), 0
                packed = record(row)
                out.write(packed)
                size += len(packed)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        system.create_dir(base, recursive=True)
        lines = "".join(f"{name}\n" for m in messages if m for name in m.files)
        with system.open_output_stream(f"{base.rstrip('/')}/{MANIFEST}-{uuid4().hex}", compression=None) as out:
            out.write(lines.encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        for name in [name for m in messages if m for name in m.files]:
            system.delete_file(f"{base.rstrip('/')}/{name}")


class WarcDataSource(DataSource):
    """``format("warc")``: options ``path``, ``payloads`` (true), ``partitionBytes``, ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to the session and let its filters be pushed down."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below ``path``, as a relation of its own.

    Spark 4.1 remembers the filters it has pushed into a Python source by relation: once a frame has
    been filtered and run, other frames from the same ``load`` see the filtered rows. So every
    query that filters takes a frame that this function has just made.
    """
    return spark.read.format("warc").options(**options).load(path)


#: Bits of the map of repeated payloads: 2 MB, whatever the number of pages.
MAP_BITS = 1 << 24
BUCKET_BITS = 1 << 15


def _marked(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only if their print is none of ``prints``.

    Each print sets one bit of ``MAP_BITS``; the map is built by tasks in buckets of 4 kB, and the
    buckets, of which there are at most 512, are broadcast.
    """
    slot = F.pmod(F.xxhash64("print"), F.lit(MAP_BITS))
    bucket, place = F.floor(slot / BUCKET_BITS).cast("int"), slot % BUCKET_BITS
    bits = prints.select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    met = rows.withColumn("bucket", bucket).withColumn("place", place.cast("int")).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, place div 8 + 1, 1)")), 16, 10).cast("int")
    met = met.withColumn("byte", byte)
    maybe = F.coalesce(F.expr("(shiftright(byte, place % 8) & 1) = 1"), F.lit(False))
    return met.withColumn("maybe", maybe).drop("bucket", "place", "bits", "byte")


def with_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, payload, record_type, refers_to) and ``carry``: of equal payloads one response, the others revisit it.

    The response is the row with the largest ``key``; rows that share that key all are responses,
    and where all keys of the group are null so are all its rows. Payloads shorter than
    ``least_bytes`` are responses all. A null payload is empty. ``carry`` names columns that come along.

    Digests alone are grouped. A bit map of those that repeat tells most rows that do not, and these stay
    where they are; payloads travel only of the others, to meet their group's largest key.
    """
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("").cast("binary")).alias("payload"),
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(None).alias("none")]).alias("carried"),
    ).withColumn("print", F.sha1("payload"))
    large = rows.where(F.length("payload") >= least_bytes).select("print", "key").groupBy("print")
    groups = large.agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    groups = settle(groups, "repeated")
    marked = _marked(rows, groups)
    none = F.lit(None).cast(groups.schema["last"].dataType)
    single = marked.where("not maybe").withColumn("last", none)
    met = marked.where("maybe").join(groups, "print", "left").select(*single.columns)
    again = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return single.unionByName(met).select(
        F.col("key").alias(key),
        F.col("payload").alias(payload),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )

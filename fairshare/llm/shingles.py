"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links by tries, exact checks, bands for the rest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairshare.llm.graph import components
from fairshare.llm.simhash import hamming_links, majority
from fairshare.llm.texts import lower_az, spaced_words
from fairshare.sources.tables import settle

SHINGLE = 5
#: Two sets are near when their Jaccard similarity is at least 4 / 5.
NEAR = (4, 5)
BANDS, BAND_ROWS = 50, 5
STARS = 2
#: Rounds in which sets go that share too little with all others together; more only save work.
CORES = 2
AT_ONCE = 512
#: Bits of a set's parity map, in longs.
WORDS = 16

_rng = np.random.default_rng(5)
_FLIPS = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)
_TURNS = _rng.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_MIXES = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: Column) -> Column:
    """The distinct hashes of every run of five words; a shorter text is one run, also if empty.

    Words are separated by white space after A-Z is lowered.
    """
    words = spaced_words(lower_az(F.coalesce(text, F.lit(""))))

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))

    # a variable of a lambda is evaluated once, an expression within one for every element
    return F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes; sets of Jaccard similarity j share a band's key with odds j ** BAND_ROWS."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), AT_ONCE):
        np.minimum(least, ((x[at : at + AT_ONCE, None] ^ _FLIPS) * _TURNS).min(0), out=least)
    return (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _MIXES).sum(1, dtype=np.uint64)


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """A bit for each place that an odd number of the hashes fall on.

    The maps of two sets differ in at most as many bits as the sets differ in elements.
    """
    odd = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, d1, d2, size, fingerprint, bands) from (key, print, h): a digest of 128 bits of the set ``h``."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy().view(np.uint64)
        sizes = lists.value_lengths().to_numpy()
        digests, bands = np.zeros((len(sizes), 2), np.int64), np.zeros((len(sizes), BANDS), np.uint64)
        prints = np.zeros(len(sizes), np.int64)
        for k, (end, size) in enumerate(zip(np.cumsum(sizes), sizes)):
            own = np.sort(flat[end - size : end])
            digests[k] = np.frombuffer(blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            prints[k], bands[k] = majority(own), band_keys(own)
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(BANDS)
        keys = pa.ListArray.from_arrays(ends, bands.ravel().view(np.int64))
        columns = [batch.column(0), batch.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes, pa.int32())]
        names = ["key", "print", "d1", "d2", "size", "fingerprint", "bands"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints), keys], names=names)


def _maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, bits) from (node, h)."""
    for batch in batches:
        lists = batch.column(1)
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
        maps = [parity_map(flat[end - size : end]) for end, size in zip(np.cumsum(sizes), sizes)]
        ends = np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(WORDS)
        bits = pa.ListArray.from_arrays(ends, np.concatenate(maps) if maps else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), bits], names=["node", "size", "bits"])


def _sizes_fit(a: Column, b: Column) -> Column:
    """Sets whose sizes alone rule out that they are near do not fit."""
    return F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]


def _may_be_near(a: str, b: str) -> Column:
    """Sets may be near by their sizes, and by their maps: near sets differ in (q - p) / (q + p) of their sizes at most."""
    differ = F.lit(0)
    for k in range(WORDS):
        differ = differ + F.bit_count(F.get(f"{a}.bits", F.lit(k)).bitwiseXOR(F.get(f"{b}.bits", F.lit(k))))
    most = (F.col(f"{a}.size") + F.col(f"{b}.size")) * (NEAR[1] - NEAR[0])
    return _sizes_fit(F.col(f"{a}.size"), F.col(f"{b}.size")) & (differ * (NEAR[0] + NEAR[1]) <= most)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) of ``nodes`` (node, fingerprint): SimHash groups, each held together by these pairs.

    Fingerprints are linked by the self-join of their tries, at 4 or fewer differing bits; nodes of
    one fingerprint are paired with the first of them, and so are the firsts of linked fingerprints.
    """
    firsts = settle(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "firsts")
    same = nodes.join(firsts, "fingerprint").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    u = firsts.select(F.col("fingerprint").alias("u"), F.col("first").alias("a"))
    v = firsts.select(F.col("fingerprint").alias("v"), F.col("first").alias("b"))
    links = hamming_links(firsts).join(u, "u").join(v, "v")
    return same.unionByName(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def _to_leaders(members: DataFrame, step: int) -> DataFrame:
    """(u, v): every member of a bucket with the bucket's leader, unless they are connected already."""
    # the leader is found on the map side first, so a crowded bucket sends a row per task
    led = F.min_by(F.struct("node", "size", "root"), F.xxhash64("node", F.lit(step)))
    leaders = members.groupBy("bucket").agg(led.alias("led"))
    apart = members.join(leaders, "bucket")
    apart = apart.where((F.col("root") != F.col("led.root")) & _sizes_fit(F.col("size"), F.col("led.size")))
    return apart.select(F.least("node", "led.node").alias("u"), F.greatest("node", "led.node").alias("v")).distinct()


def _core(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the nodes that share p / q of their set with the others together, as near sets must."""
    kept = nodes
    for _ in range(CORES):
        own = sets.join(kept.select("node"), "node").select("node", F.size("h").alias("size"), F.explode("h").alias("t"))
        common = own.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = own.join(common, "t").groupBy("node", "size").agg(F.count(F.lit(1)).alias("c"))
        kept = settle(shared.where(F.col("c") * NEAR[1] >= F.col("size") * NEAR[0]).select("node"), "core")
    return kept


def _other_pairs(members: DataFrame, sets: DataFrame, maps: DataFrame) -> DataFrame:
    """(u, v): pairs of a bucket that are not connected yet and may be near.

    Buckets whose members are all connected have no such pair. Texts that have only a passage in
    common fill a bucket without being near: those go first that share too little of their set with
    all others, and pairs are compared by sizes and maps as they are joined, before any is written.
    """
    split = members.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    split = settle(members.join(split.select("bucket"), "bucket"), "split")
    core = _core(split.select("node").distinct(), sets)
    left = settle(split.select("bucket", "node", "root").join(core, "node").join(maps, "node"), "members")
    a, b = left.alias("a"), left.alias("b")
    apart = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.root") < F.col("b.root"))
    pairs = a.join(b, apart & _may_be_near("a", "b"))
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _near(pairs: DataFrame, sets: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the pairs whose Jaccard similarity, counted exactly where the maps allow it, is high enough."""
    a = maps.select(F.struct("*").alias("a")).withColumn("u", F.col("a.node"))
    b = maps.select(F.struct("*").alias("b")).withColumn("v", F.col("b.node"))
    likely = pairs.join(a, "u").join(b, "v").where(_may_be_near("a", "b")).select("u", "v")
    sides = likely.join(sets.select(F.col("node").alias("u"), F.col("h").alias("x")), "u")
    sides = sides.join(sets.select(F.col("node").alias("v"), F.col("h").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    # shared / (x + y - shared) >= p / q
    enough = shared * (NEAR[0] + NEAR[1]) >= (F.size("x") + F.size("y")) * NEAR[0]
    return sides.where(enough).select("u", "v")


def linked(members: DataFrame, sets: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes that have a near one in a bucket of theirs or among the pairs ``first``.

    ``members`` has (bucket, node, size), ``sets`` (node, h), ``first`` (u, v). The pairs ``first``
    are checked before all others. Buckets are then checked against one leader each, and once more
    against another, which connects groups of many copies with few checks; what is still apart in
    a bucket and may be near is checked pair by pair, so none is passed over.
    """
    maps = settle(sets.select("node", "h").mapInArrow(_maps, "node long, size int, bits array<long>"), "maps")
    links = roots = None
    if first is not None:
        links = settle(_near(first, sets, maps), "near")
        roots = settle(components(links), "roots")
    for step in range(STARS + 1):
        if roots is None:
            named = members.withColumn("root", F.col("node"))
        else:
            named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = _to_leaders(named, step) if step < STARS else _other_pairs(named, sets, maps)
        found = settle(_near(pairs, sets, maps), "near")
        links = found if links is None else links.unionByName(found)
        roots = settle(components(links), "roots")
    return roots


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the least key, then the least text hash.

    Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are in one
    group, and so is what such links connect. SimHash fingerprints of the sets, joined by their tries,
    give the first candidates. Most pairs near 0.8 differ in more bits than tries can bear, so
    all pairs that these leave apart are candidates too if they agree in all
    ``BAND_ROWS`` least hashes of one of ``BANDS`` bands, which a pair at 0.8 fails to do with odds
    ``(1 - 0.8 ** 5) ** 50``, about 2e-9; every candidate is then checked by its whole sets, so
    no text goes that is not near. Texts without words are equal. A null key takes part but is the
    least only where all keys of the group are null.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("print"),
    )
    body = F.col(f"doc.`{text}`")
    fields = [("print", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("size", T.IntegerType()), ("fingerprint", T.LongType())]
    fields.append(("bands", T.ArrayType(T.LongType())))
    schema = T.StructType([own.schema["key"], *[T.StructField(*f) for f in fields]])
    marked = own.select("key", "print", shingles(body).alias("h")).mapInArrow(_marks, schema)
    marked = settle(marked, "shingles")
    # equal sets, by their digests, are one node; buckets with one node say nothing
    nodes = marked.select("d1", "d2", "size", "fingerprint", "bands").dropDuplicates(["d1", "d2"])
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    marked = marked.select("key", "print", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"])
    marked = settle(marked.select("key", "print", "node"), "named")
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = settle(members.join(crowded, "bucket"), "buckets")
    first = settle(fingerprint_pairs(nodes.select("node", "fingerprint")), "fingerprint_pairs")

    order = F.struct(F.col("key").isNull().alias("none"), "key", "print")
    same = F.col("d.key").eqNullSafe(F.col("c.key")) & (F.col("d.print") == F.col("c.print"))
    compared = members.select("node").unionByName(first.select(F.explode(F.array("u", "v")).alias("node")))
    drawn = marked.join(compared.distinct(), "node", "left_semi")
    drawn = drawn.groupBy("node").agg(F.min(order).alias("c")).select("node", "c.key", "c.print")
    sets = own.alias("d").join(drawn.alias("c"), same).select("node", shingles(body).alias("h"))
    roots = linked(members, settle(sets.dropDuplicates(["node"]), "sets"), first)

    classed = marked.select("key", "print", "node").join(roots, "node", "left")
    classed = classed.withColumn("root", F.coalesce("root", "node"))
    chosen = classed.groupBy("root").agg(F.min(order).alias("c")).select("c.key", "c.print").distinct()
    found = own.alias("d").join(chosen.alias("c"), same, "left_semi")
    return found.dropDuplicates(["key", "print"]).select("doc.*")

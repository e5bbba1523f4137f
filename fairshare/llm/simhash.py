"""SimHash near-duplicates, linked by a self-join of binary tries over the fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairshare.llm.graph import components
from fairshare.llm.texts import lower_az, spaced_words
from fairshare.sources.tables import settle

BITS = 64
ERRORS = 4
PIECE_ROWS = 32_768
NODE_ROWS = 8_192
DENSE = 64
CHUNK = 1 << 20
AT_ONCE = 1 << 14


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` without ``text``, with ``fingerprint`` (long).

    Words are separated by white space after A-Z is lowered; every run of ``shingle`` words counts,
    repeats included (a shorter text is one run); a bit is set if over half of the run hashes set
    it. Null and empty texts get fingerprint zero. Other columns, whatever their names, are kept
    inside one struct until the end, so they cannot clash.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        (F.struct(*kept) if kept else F.lit(None)).alias("kept"),
        spaced_words(lower_az(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("w"),
    )
    runs = words.select(
        "row", "kept", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - shingle, F.lit(0)))).alias("i")
    )
    run = F.concat_ws(" ", *[F.get("w", F.col("i") + j) for j in range(shingle)])
    # words have no empty one among them, so an empty run is a text without words
    hashed = runs.select("row", "kept", F.when(run == "", F.lit(0)).otherwise(F.xxhash64(run)).alias("h"))
    # a sum holds the counts of two bits, 32 apart
    pair = 1 | 1 << 32
    sums = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(pair))).alias(f"s{j}") for j in range(BITS // 2)]
    counted = hashed.groupBy("row", "kept").agg(F.count(F.lit(1)).alias("n"), *sums)

    def bit(j: int) -> Column:
        total = F.col(f"s{j % 32}")
        count = F.shiftrightunsigned(total, 32) if j >= 32 else total.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(count * 2 > F.col("n"), F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0))

    mark = bit(0)
    for j in range(1, BITS):
        mark = mark.bitwiseOR(bit(j))
    out = counted.select("kept", mark.cast("long").alias("fingerprint"))
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns if c != text], "fingerprint")


def majority(hashes: np.ndarray) -> np.int64:
    """The fingerprint of hashes in a task: a bit is set if over half of them set it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        own = np.unpackbits(hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        ones += own.sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0]


class Forest:
    """Which of the numbered items are connected so far; ``root`` is fully compressed."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[u], root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_links(
    a: np.ndarray, b: np.ndarray, errors: int = ERRORS, first: int = BITS, first_errors: int = ERRORS
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever items of ``a`` and ``b`` differ in at most ``errors`` bits.

    Two binary tries over the sorted, distinct 64-bit numbers are walked together, a level at a
    time from the top bit. A node is a slice of sorted numbers; a pair of nodes carries the bits
    in which its two paths differ, and goes as soon as they exceed ``first_errors`` within the
    ``first`` bits or ``errors`` in all. Small pairs are compared item by item. Pairs of items that are
    connected already are not linked again, so at most one link for each item but one returns.
    With ``a is b`` the pairs within one set are taken once.
    """
    same = a is b
    items = a if same else np.unique(np.concatenate([a, b]))
    at_a = np.arange(len(a)) if same else np.searchsorted(items, a)
    at_b = at_a if same else np.searchsorted(items, b)
    forest = Forest(len(items))

    def dense(lo_a, hi_a, lo_b, hi_b):
        wide = hi_b - lo_b
        cells = (hi_a - lo_a) * wide
        ends = np.cumsum(cells)
        for k in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            cell = np.arange(k, min(k + CHUNK, int(ends[-1])))
            pair = np.searchsorted(ends, cell, side="right")
            inner = cell - (ends[pair] - cells[pair])
            i, j = lo_a[pair] + inner // wide[pair], lo_b[pair] + inner % wide[pair]
            near = np.bitwise_count(a[i] ^ b[j]) <= errors
            forest.unite(at_a[i[near]], at_b[j[near]])

    # depth, slices of a and b, differing bits
    stack = [(0, *(np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        depth, lo_a, hi_a, lo_b, hi_b, wrong = stack.pop()
        few = ((hi_a - lo_a) * (hi_b - lo_b) <= DENSE) | (depth == BITS)
        dense(lo_a[few], hi_a[few], lo_b[few], hi_b[few])
        lo_a, hi_a, lo_b, hi_b, wrong = (x[~few] for x in (lo_a, hi_a, lo_b, hi_b, wrong))
        if not len(lo_a):
            continue
        mask = np.uint64(1 << (BITS - 1 - depth))
        ones_a = np.concatenate([[0], np.cumsum((a & mask) != 0)])
        ones_b = ones_a if same else np.concatenate([[0], np.cumsum((b & mask) != 0)])
        mid_a = hi_a - (ones_a[hi_a] - ones_a[lo_a])
        mid_b = hi_b - (ones_b[hi_b] - ones_b[lo_b])
        parts = [(lo_a, mid_a, lo_b, mid_b, wrong), (mid_a, hi_a, mid_b, hi_b, wrong)]
        parts += [(lo_a, mid_a, mid_b, hi_b, wrong + 1), (mid_a, hi_a, lo_b, mid_b, wrong + 1)]
        grown = [np.concatenate(x) for x in zip(*parts)]
        bound = min(errors, first_errors) if depth < first else errors
        keep = (grown[1] > grown[0]) & (grown[3] > grown[2]) & (grown[4] <= bound)
        if same:  # of (x, y) and (y, x) one is enough
            keep &= grown[0] <= grown[2]
        grown = [x[keep] for x in grown]
        for k in range(0, len(grown[0]), CHUNK):
            stack.append((depth + 1, *(x[k : k + CHUNK] for x in grown)))
    child = np.flatnonzero(forest.root != np.arange(len(items)))
    return items[child], items[forest.root[child]]


def _turned(x: Column, by: int) -> Column:
    """The bits of a long, the top ``by`` moved to the end."""
    if by == 0:
        return x
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, BITS - by))


def hamming_links(marks: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(u, v) links that connect all of ``marks.fingerprint`` within ``errors`` differing bits.

    The bits are cut into three parts. Of at most ``errors`` differing bits, one part holds at most
    ``errors // 3``, so three tries, each beginning with another part, find every pair while they
    prune far earlier than one trie would. The top levels of each trie are walked in Spark: a node
    is a prefix, and each fingerprint goes to the pairs of its own node with the nodes whose
    prefixes differ within the first part's budget. A node with more than ``PIECE_ROWS``
    fingerprints is cut into pieces and every pair of pieces is a task of its own, so no task holds
    more than two pieces. Links do not list all pairs but connect the same fingerprints. Equal
    fingerprints count once; null ones are left out.
    """
    if not 0 <= errors <= 5:
        raise ValueError("from 0 to 5 differing bits")
    marks = settle(marks.where("fingerprint IS NOT NULL").select("fingerprint").distinct(), "marks")
    rows = marks.count()
    depth = min(max(int(np.ceil(np.log2(max(rows, 1) / NODE_ROWS))), 0), 20)
    starts, lengths = (0, 22, 43), (22, 21, 21)
    budget = errors // 3
    turned = F.explode(
        F.array(*[F.struct(F.lit(r).alias("r"), _turned(F.col("fingerprint"), s).alias("x")) for r, s in enumerate(starts)])
    )
    top = F.shiftrightunsigned("x", BITS - depth).cast("int") if depth else F.lit(0)
    placed = marks.select(turned.alias("t")).select("t.r", "t.x").withColumn("node", top)
    sizes = placed.groupBy("r", "node").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces"))
    flips = [0] + ([1 << k for k in range(depth)] if budget else [])
    # each fingerprint once for each pair of nodes it takes part in, with the other node of the pair
    paired = placed.join(sizes, ["r", "node"]).withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    paired = paired.withColumn("other", F.col("node").bitwiseXOR(F.col("flip")))
    others = sizes.select("r", F.col("node").alias("other"), F.col("pieces").alias("other_pieces"))
    paired = paired.join(others, ["r", "other"])
    piece = F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int")
    paired = paired.withColumn("piece", piece).withColumn(
        "other_piece", F.explode(F.sequence(F.lit(0), F.col("other_pieces") - 1))
    )
    # the lesser (node, piece) of a pair is its left side
    mine, theirs = F.struct("node", "piece"), F.struct(F.col("other").alias("node"), F.col("other_piece").alias("piece"))
    sided = paired.select(
        "r", "x", F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"), (mine <= theirs).alias("left")
    )

    def walk(table: pa.Table) -> pa.Table:
        r = table["r"][0].as_py()
        x = table["x"].to_numpy().view(np.uint64)
        left = table["left"].to_numpy()
        if table["a"][0] == table["b"][0]:
            a = b = np.unique(x)
        else:
            a, b = np.unique(x[left]), np.unique(x[~left])
        none = np.zeros(0, np.uint64)
        u, v = trie_links(a, b, errors, lengths[r], budget) if len(a) and len(b) else (none, none)
        if starts[r]:
            by, back = np.uint64(starts[r]), np.uint64(BITS - starts[r])
            u, v = (y << back | y >> by for y in (u, v))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return sided.groupBy("r", "a", "b").applyInArrow(walk, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """One row per row of ``docs``: (key, fingerprint long, component_id).

    ``component_id`` is the least ``key`` of all rows whose fingerprints can be reached by links of
    at most ``errors`` differing bits, the row itself included. A null key takes part but is the
    least only where all keys of the component are null. Repeated rows stay. An empty table
    gives an empty result.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = settle(fingerprints(own), "fingerprints")
    least = marked.groupBy("fingerprint").agg(F.min("key").alias("least"))
    roots = components(hamming_links(marked, errors))
    rooted = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(firsts, "root").select("fingerprint", "component_id"), "components")
    return marked.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """``docs`` with one row of each component: that with the least key, then the least text hash.

    Where all keys of a component are null the row with the least text hash stays.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("print"),
    )
    pairs = own.select("key", "print", F.col(f"doc.`{text}`").alias("text"))
    marked = settle(fingerprints(pairs), "fingerprints")
    roots = components(hamming_links(marked, errors))
    classed = marked.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    classed = classed.withColumn("root", F.coalesce("root", "fingerprint"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "print")
    chosen = classed.groupBy("root").agg(F.min(order).alias("c")).select("c.key", "c.print").distinct()
    same = F.col("d.key").eqNullSafe(F.col("c.key")) & (F.col("d.print") == F.col("c.print"))
    found = own.alias("d").join(chosen.alias("c"), same, "left_semi")
    return found.dropDuplicates(["key", "print"]).select("doc.*")

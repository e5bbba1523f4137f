"""Conversation prefix trie: every shared beginning of conversations once, with what it saves.

Identical conversations collapse into one weighted sequence with the list of those that end there.
A sequence that is a proper prefix of another is no leaf. A node is a prefix: its figures are sums
over the weighted sequences that begin with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairshare.llm.running import in_order, running
from fairshare.sources.tables import settle

#: A prefix is named by its length and two hashes of 64 bits; texts are never compared.
NODE = ["depth", "n1", "n2"]


def numbered_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n, r1, r2, size) of every turn: its place from 1, two hashes of role and text, code points.

    Turns are ordered by ``turn``, null first, then by role and text; repeated rows are turns of
    their own. A null role or text is empty, and rows with a null key belong to no conversation.
    """
    own = turns.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    said = ["role", "text"]
    hashes = [F.xxhash64(F.lit(k), *said).alias(f"r{k}") for k in (1, 2)]
    keep = [F.col("conv"), *hashes, F.char_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("one")]
    placed = in_order(own, order, keep, "turns")
    return running(placed, "conv", {"n": ("one", "sum")}).select("conv", "n", "r1", "r2", "size")


def share_heads(numbered: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv, n, r1, r2, size) and all (conv).

    Conversation c takes the first h turns of c - c % ``every`` (all if fewer, none if absent) and then
    its own after the first h, where h is the unsigned crc32 of c's decimal form modulo ``most`` + 1.
    """
    numbered = settle(numbered, "numbered")
    head = lambda c: F.crc32(c.cast("string")) % (most + 1)
    convs = settle(numbered.select("conv").distinct(), "convs")
    heads = numbered.where((F.col("conv") % every == 0) & (F.col("n") <= most)).withColumnRenamed("conv", "base")
    named = convs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", head(F.col("conv")))
    # at most `most` rows a base, and 2 * every conversations
    taken = named.join(heads, "base").where("n <= h").select("conv", "n", "r1", "r2", "size")
    length = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    shift = named.join(length, "base", "left").select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"))
    own = numbered.join(shift, "conv").where("n > h")
    own = own.select("conv", (F.col("k") + F.col("n") - F.col("h")).alias("n"), "r1", "r2", "size")
    return taken.unionByName(own), convs


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, n1, n2, p1, p2, size): the node of every prefix of every conversation, and its parent.

    A node's hashes are the exclusive or of those of its turns, each hashed with its place, so they
    add up in any order and a conversation of any length is split among tasks.
    """
    hashes = [F.xxhash64(F.lit(k), "n", "r1", "r2").alias(f"x{k}") for k in (1, 2)]
    placed = in_order(rows, [F.col("conv"), F.col("n")], ["conv", "n", "size", *hashes], "rebuilt")
    summed = running(placed, "conv", {"n1": ("x1", "xor"), "n2": ("x2", "xor")})
    parent = [F.col(f"n{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)]
    return summed.select("conv", F.col("n").alias("depth"), "n1", "n2", *parent, "size")


def end_digests(ends: DataFrame, group: list[str], member: str = "conv", into: str = "ends_sha256") -> DataFrame:
    """(group columns, ``into``): the SHA-256 of each group's members, in decimal, ascending, comma-joined.

    Members are sorted in ranges, so a group of any size is sorted by many tasks, and each range is
    joined into pieces of text there. Only the pieces of a group meet in one task, which streams
    them through the hash, for SHA-256 has to read its input in order.
    """
    order = [*group, member]
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    of_group = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.select(*group).schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            new = np.flatnonzero(np.any([np.append(True, k[1:] != k[:-1]) for k in keys], 0))
            ends_at = np.append(new, batch.num_rows).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends_at), batch.columns[-1].cast(pa.string()))
            firsts = [c.take(pa.array(new)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*firsts, pc.binary_join(lists, ",")], names=[*order, "piece"])

    pieces = ranged.mapInArrow(joined, f"{of_group}, {member} long, piece string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([d[0][k] for d in done], ends_types[k]) for k in range(len(group))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string())], names=[*group, into])

        ends_types: list[pa.DataType] = []
        for batch in batches:
            ends_types = [c.type for c in batch.columns[: len(group)]]
            for key, piece in zip(zip(*[c.to_pylist() for c in batch.columns[: len(group)]]), batch.column("piece").to_pylist()):
                if key != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if len(done) > 10_000:
                yield flushed()
                done.clear()
        if state is not None:
            done.append((current, state.hexdigest()))
            yield flushed()

    together = pieces.repartition(n, *group).sortWithinPartitions(*order)
    return together.select(*group, "piece").mapInArrow(hashed, f"{of_group}, {into} string")


def _saved(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth, n1, n2, saved): ``own`` of every node summed over its subtree.

    A node belongs to the first leaf that it leads to, so a leaf's nodes are the lower end of its
    path, and each node counts once: it is summed upwards along its own leaf's nodes, and the sum of
    all of a leaf's nodes goes to each node above them on that leaf's path. The rows are those of
    the paths; nothing is listed by ancestor and descendant.
    """
    placed = in_order(nodes, [F.col("owner"), F.col("depth").desc()], [*NODE, "owner", "own"], "owned")
    summed = settle(running(placed, "owner", {"below": ("own", "sum")}).select(*NODE, "owner", "below"), "summed")
    tops = summed.groupBy("owner").agg(F.min("depth").alias("top"), F.max(F.struct(-F.col("depth"), "below")).alias("whole"))
    tops = tops.select(F.col("owner").alias("first"), "top", F.col("whole.below").alias("whole"))
    above = paths.where("leaf").join(tops, "first").where("depth < top")
    others = above.groupBy(*NODE).agg(F.sum("whole").alias("others"))
    joined = summed.join(others, NODE, "left")
    return joined.select(*NODE, (F.col("below") + F.coalesce("others", F.lit(0))).alias("saved"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all prefixes of conversations, from the root of depth 0.

    ``rows`` has (conv, n, r1, r2, size): turns numbered from 1, without gaps, their hashes and code
    points; ``convs`` has every (conv) once, those without turns too. The result has, per node,
    ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``, that of its parent (null for the
    root); ``n_convs``, the conversations that begin with it; ``n_children``; ``n_leaves``, the
    childless nodes of its subtree; ``saved_tokens``, over its subtree the code points of each
    node's last turn times one less than its members; ``ends_sha256``, the digest of the members that
    end there. Without conversations there is no node.
    """
    prefixes = settle(_prefixes(rows), "prefixes")
    last = prefixes.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("end")).select("conv", "end.*")
    zero = F.lit(0).cast("long")
    whole = convs.join(last, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in NODE])
    whole = settle(whole, "whole")
    # identical conversations collapse into one sequence
    sequences = whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("first"))
    sequences = settle(sequences, "sequences")
    kept = sequences.select(F.col("first").alias("conv"), F.col("depth").alias("length"), "weight")
    paths = prefixes.join(kept, "conv").unionByName(
        kept.select("conv", *[zero.alias(c) for c in ("depth", "n1", "n2", "p1", "p2", "size")], "length", "weight")
    )
    paths = settle(paths.withColumnRenamed("conv", "first"), "paths")
    inner = paths.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("first", F.lit(True).alias("leaf"))
    paths = paths.join(leaves, "first", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    paths = settle(paths.drop("length"), "weighted")

    nodes = paths.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"),
        F.min("first").alias("conv_id"),
        F.count_if("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("first"))).alias("owner"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("size").alias("size"),
    )
    nodes = settle(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")]
    below = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(named, ["depth", "p1", "p2"], "left").join(below, NODE, "left")
    joined = joined.join(_saved(nodes, paths), NODE).join(end_digests(whole, NODE), NODE, "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )

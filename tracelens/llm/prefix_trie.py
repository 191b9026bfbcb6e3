"""Trie of conversation prefixes in minimal-perfect-hash node tables.

Every prefix of a conversation has a digest of 128 bits, chained turn by turn; distinct digests are the nodes. Turns
shuffle as digests and word counts, never as texts; a task streams conversations in order and keeps one state, however
long one is. What a single conversation has for itself is one node of a table and a tail that follows from it. Nodes with
more than `limit` conversations (fewer than turns / limit, so that they fit a broadcast) form the upper table, all others
fall into subtrees below it, which are dealt to shards. In a shard, a minimal perfect hash (levels of bit arrays: digests
alone in their place stay, the others go one level down) gives each digest a slot, which is verified against the digest
stored there. Counts are scattered into flat arrays by slot, and children, leaves and saved tokens are
added through the array of parent slots, deepest level first. Tops of subtrees hand their sums to the upper table.

The digest of a node's ends is of one list by contract: ids are joined in blocks of neighbours by a grouped step, and a stream
of blocks in order feeds SHA-256 with constant memory.

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty; turns with a null number come
first; rows of one number go by the digest of role and text, and repeated rows are turns of their own; a conversation with
nothing left of its turns is a member of the root alone; an empty table gives no rows, not even a root; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored, text_of

ROOT = bytes(16)
#: A block of a node's ends has the ids that are equal but for so many bits.
BLOCK_BITS = 12
#: Nodes above `limit` are at most turns / limit: with the default fewer than this, 40 bytes each.
MOST_UPPER, LEAST_LIMIT = 1 << 20, 100
#: Nodes that a shard is meant to have.
SHARD_NODES = 200_000


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.left(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), F.lit(32)))


def table_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest and words of a table's turns."""
    role, text = text_of("role"), text_of("text")
    return rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"))


def rebuilt_turns(turns: DataFrame, modulo: int = 20, heads: int = 4) -> DataFrame:
    """Turns with `part` (0: borrowed from conversation c - c % modulo, 1: own) and `skip`, how many own turns fall away.

    A conversation borrows the first crc32(c) % heads turns of its base and loses as many of its own.
    """
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads
    base = F.col("conv_id") - F.col("conv_id") % modulo
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    first = turns.where(base == F.col("conv_id")).withColumn("at", F.row_number().over(order)).where(F.col("at") < heads)
    takers = turns.select("conv_id").distinct().where(base != F.col("conv_id")).select(F.col("conv_id").alias("taker"), base.alias("conv_id"), h.alias("h"))
    lent = takers.join(first, "conv_id").where(F.col("at") <= F.col("h")).select(F.col("taker").alias("conv_id"), F.lit(0).alias("part"), F.col("at").cast("long").alias("turn"), "digest", "words", F.lit(0).cast("long").alias("skip"))
    own = turns.select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "digest", "words", F.when(base == F.col("conv_id"), 0).otherwise(h).cast("long").alias("skip"))
    return lent.unionByName(own)


PREFIX = "conv_id LONG, depth LONG, digest BINARY, parent BINARY, words LONG, ends BOOLEAN"


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of conversations whose turns come in order; each is put out when the next turn shows whether it ends there."""
    now, digest, parent, depth, left, words = None, ROOT, None, 0, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for conv, part, turn, w, skip in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "digest", "words", "skip")), strict=True):
            if conv != now:
                if now is not None:
                    out.append((now, depth, digest, parent, words, True))
                now, digest, parent, depth, left, words = conv, ROOT, None, 0, None, 0
            if part == 1:
                left = skip if left is None else left
                if left > 0:
                    left -= 1
                    continue
            out.append((now, depth, digest, parent, words, False))
            parent, digest, depth, words = digest, hashlib.blake2b(digest + turn, digest_size=16).digest(), depth + 1, w
        if out:
            yield _prefixes(out)
    if now is not None:
        yield _prefixes([(now, depth, digest, parent, words, True)])


def _prefixes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "depth", "digest", "parent", "words", "ends"])


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")
    return ordered.select("conv_id", "part", "digest", "words", "skip").mapInArrow(chain, PREFIX)


class NodeTable:
    """Slots of distinct digests (rows of two 64-bit words), without gaps, by a minimal perfect hash."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = keys, 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("two equal digests in one shard")
            place = self._place(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(place, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before, left = before + int(alone.sum()), left[~alone[place]]
        self.keys = np.zeros((before, 2), np.uint64)
        slots = self._slots(keys)
        self.keys[slots] = keys
        if not (self.keys[slots] == keys).all():
            raise ValueError("a digest has lost its slot")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys[:, 0] + np.uint64(level + 1) * (keys[:, 1] | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            here = alone[place]
            found[open_[here]] = rank[place[here]]
            open_ = open_[~here]
        return found

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the digest stored there is another one or there is none."""
        slots = self._slots(keys)
        held = slots >= 0
        held[held] = (self.keys[slots[held]] == keys[held]).all(axis=1)
        return np.where(held, slots, -1)


def words_of(column: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of two 64-bit words; null as zeros."""
    return np.frombuffer(b"".join(d or ROOT for d in column.to_pylist()), np.uint64).reshape(-1, 2)


FOLDED = "digest BINARY, parent BINARY, depth LONG, conv_id LONG, parent_conv_id LONG, n_convs LONG, n_children LONG, n_leaves LONG, saved_tokens LONG, top BOOLEAN"


def fold_shard(table: pa.Table) -> pa.Table:
    """Children, leaves and saved tokens of a shard's nodes; `children`, `leaves` and `saved` of a row are what other shards gave it."""
    keys, parents = words_of(table["digest"]), words_of(table["parent"])
    column = lambda name: table[name].to_numpy().astype(np.int64)
    nodes = NodeTable(keys)
    slots, n = nodes.lookup(keys), len(keys)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[slots] = values
        return out

    conv, depth, children, leaves = (scattered(column(k)) for k in ("conv_id", "depth", "children", "leaves"))
    saved = scattered(column("saved") + (column("n_convs") - 1) * column("words"))
    parent = scattered(np.where(table["parent"].is_null().to_numpy(zero_copy_only=False), -1, nodes.lookup(parents)))
    inside = parent >= 0
    children += np.bincount(parent[inside], minlength=n)
    leaves[children == 0] = 1
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        level = order[a:b]
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    theirs = np.where(inside[slots], conv[parent[slots]], -1)
    above = table["parent_conv"].to_pylist()
    parent_conv = [int(t) if own else a for t, own, a in zip(theirs, inside[slots], above, strict=True)]
    return pa.table({
        "digest": table["digest"], "parent": table["parent"], "depth": table["depth"], "conv_id": table["conv_id"], "parent_conv_id": pa.array(parent_conv, pa.int64()), "n_convs": table["n_convs"],
        "n_children": pa.array(children[slots]), "n_leaves": pa.array(leaves[slots]), "saved_tokens": pa.array(saved[slots]), "top": pa.array(~inside[slots]),
    })


def hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's blocks, which come in order."""
    now, state = None, None
    for batch in batches:
        out = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _hashes(out)
    if now is not None:
        yield _hashes([(now, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["digest", "ends_sha256"])


def end_hashes(paths: DataFrame) -> DataFrame:
    """digest and ends_sha256 of the prefixes where conversations end; a block has at most 2^BLOCK_BITS ids."""
    blocks = paths.where("ends").groupBy("digest", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids")
    return ordered.mapInArrow(hash_stream, "digest BINARY, ends_sha256 STRING")


def prefix_trie(turns: DataFrame, *, limit: int | None = None, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    turns: conv_id, part, turn, digest, words, skip, as rebuilt_turns() gives them.
    """
    spark = turns.sparkSession
    paths = stored(prefixes(turns), "prefixes")
    nodes = stored(paths.groupBy("digest").agg(F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id")), "nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("n_convs").alias("rows")).first()
    limit = max(LEAST_LIMIT, (size.rows or 0) // MOST_UPPER) if limit is None else max(1, limit)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.nodes // shard_nodes)
    zero = F.lit(0).cast("long")

    # what one conversation has alone: its first node stands in a table for the rest, which follows from it
    tails = stored(nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last")), "tails")
    single = nodes.where("n_convs = 1").join(tails, "conv_id")
    more = (F.col("depth") < F.col("last")).cast("long")
    rest = single.where("depth > first").select("digest", "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", more.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    columns = ["digest", "parent", "depth", "words", "conv_id", "n_convs"]
    held = single.where("depth = first").select(*columns, more.alias("children"), more.alias("leaves")).unionByName(nodes.where("n_convs > 1").select(*columns, zero.alias("children"), zero.alias("leaves")))

    upper = nodes.where(F.col("n_convs") > limit)
    heavy = F.broadcast(upper.select(F.col("digest").alias("heavy"), F.col("conv_id").alias("parent_conv")))  # fewer than turns / limit
    # the shallowest light prefix of a node's smallest member is the top of the node's subtree
    tops = paths.join(heavy, paths["digest"] == F.col("heavy"), "left_anti").groupBy("conv_id").agg(F.min_by("digest", "depth").alias("subtree"))
    light = held.where(F.col("n_convs") <= limit).join(tops, "conv_id").join(heavy, F.col("parent") == F.col("heavy"), "left")
    dealt = light.select(F.pmod(F.xxhash64("subtree"), F.lit(shards)).alias("shard"), *columns, "parent_conv", "children", "leaves", zero.alias("saved"))
    below = stored(dealt.groupBy("shard").applyInArrow(fold_shard, FOLDED), "folded")
    given = below.where("top AND parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    table = upper.join(given, "digest", "left").select(F.lit(0).alias("shard"), *columns, F.lit(None).cast("long").alias("parent_conv"), *[F.coalesce(k, zero).alias(k) for k in ("children", "leaves", "saved")])
    above = table.groupBy("shard").applyInArrow(fold_shard, FOLDED)

    whole = below.unionByName(above).drop("parent", "top").unionByName(rest).join(end_hashes(paths), "digest", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, **options: int) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text), rebuilt as rebuilt_turns() does."""
    return prefix_trie(rebuilt_turns(table_turns(rows)), **options)

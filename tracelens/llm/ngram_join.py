"""N-gram Jaccard join with PartEnum signatures.

A text's set holds its distinct word shingles, hashed to 64 bits. Sets are banded by size so that similar sets lie in
the same or in adjacent bands. In a band whose largest size is r, similar sets differ in at most k elements. The hash
domain is cut into n1 = k // 2 + 1 + s first-level parts of three second-level parts each: in at least 1 + s of the
first-level parts similar sets differ in one element at most, so that two of the three second-level parts agree. A set's
signatures are all subsets of two of the three, for each first-level part.

Of the signatures that two similar sets share (1 + s at least), each drops its s smallest by (elements, hash): an order
that both sets see alike, so that the largest shared one stays. That takes away empty subsets and those of few elements,
which say little. A set with more than s first-level parts that have an empty subset also takes part in the next cut,
under another seed; in the last cut empty subsets count as signatures. So similar sets always share a signature.

A chunk of texts sends its signatures as packed, sorted lists to buckets of the signatures' range, each with the sets
that they belong to; a signature that many sets of a chunk have sends its least set alone, and the others travel spread
over all buckets. Sets that share a signature are candidates: each signature's members are first held against its leader,
then, where they still belong to different components, against each other in blocks of bounded size. Parity sketches of
the sets rule most pairs out; every link is checked on the whole sets. Sets that share many signatures are given out by one
of them, the least of a sample that both know; those that share none of the sample, by all. Of the pairs that sketches leave between
components, each set's nearest are checked first, then ever more, and those whose ends have met meanwhile never.

Equal sets are one node: that is, equal size and equal 64-bit hash of the sorted shingle hashes.

Null and empty texts have no shingles, are linked with nothing and are their own component; texts shorter than a shingle
are one shingle; rows with a null id have a null component and link nothing; repeated rows are rows of one component;
other columns are ignored; an empty table gives no rows. Rows that share an id and not a text are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, stored, texts_of
from .components import components

SIZE, SIMILAR, OF = 5, 80, 100  #: words in a shingle; similar at SIMILAR / OF
CUTS = 4
CHUNK, CHUNK_BYTES = 1_500, 6_000_000  #: texts, and bytes of them, that are packed together
CROWD = 4  #: sets of a chunk that share a signature, beyond which they travel spread
BUCKET_CHARS = 5_000_000  #: characters of text whose signatures (about 700,000) meet in a bucket
SMALL, BLOCK = 32, 1024  #: members of a signature up to which a task takes many signatures; members in a block beyond that
ROWS = 4_000  #: members that a task of many signatures takes at once
SAMPLE = 8  #: one signature in so many is known to its members, and may give a pair out for all that the pair shares
BROADCAST_ROWS = 1_000_000  #: rows of two or three long columns up to which a table is broadcast (24 MB); beyond, both sides are shuffled
ODD = 0x9E3779B97F4A7C15
ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: WordHashes, size: int = SIZE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.lower().split()
    n = len(found)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=size)], np.uint64)
    own = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(ODD) + own[k : n - size + 1 + k]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def bands(similar: int = SIMILAR, of: int = OF, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band and the most elements in which similar sets up to its largest size differ."""
    low, allowed, size = [], [], 1
    while size < largest:
        low.append(size)
        most = size * of // similar
        allowed.append(2 * most * (of - similar) // (of + similar))
        size = most + 1
    return np.array(low), np.array(allowed)


LOW, ALLOWED = bands()


def cut(own: np.ndarray, band: int, seed: int, allowed: int, last: bool) -> tuple[np.ndarray, bool]:
    """Signatures of a set in one cut of a band, and whether it has more first-level parts with an empty subset than the cut spares."""
    spare = allowed // 12
    first = allowed // 2 + 1 + spare
    mixed = mix(own + np.uint64((2 * seed + 1) * ODD & ALL))
    part = ((mixed >> np.uint64(32)) * np.uint64(3 * first) >> np.uint64(32)).astype(np.int64)
    total = np.zeros(3 * first, np.uint64)
    np.add.at(total, part, mixed)
    count = np.bincount(part, minlength=3 * first).reshape(first, 3)
    total = total.reshape(first, 3)
    # Subset j leaves part j out.
    n = (count.sum(axis=1)[:, None] - count).ravel()
    odd = np.uint64(ODD)
    sums = np.stack([total[:, 1] * odd + total[:, 2], total[:, 2] * odd + total[:, 0], total[:, 0] * odd + total[:, 1]], axis=1).ravel()
    found = mix(sums + np.arange(3 * first).astype(np.uint64) * odd + np.uint64((band * CUTS + seed) * 0xD6E8FEB86659FD93 & ALL)) >> np.uint64(16)
    over = int((n.reshape(first, 3).min(axis=1) == 0).sum()) > spare
    if spare:
        order = np.lexsort((found, n))[spare:]
        found, n = found[order], n[order]
    return (found if over and last else found[n > 0]), over


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    """The part of the range of 48-bit signatures that each is in, out of fewer than 2^31; rises with the signature."""
    n, low = np.uint64(buckets), np.uint64((1 << 24) - 1)
    return (((sig >> np.uint64(24)) * n + ((sig & low) * n >> np.uint64(24))) >> np.uint64(24)).astype(np.int64)


def signatures(own: np.ndarray) -> np.ndarray:
    """48-bit signatures of a set in its band and the next."""
    band = int(np.searchsorted(LOW, len(own), "right")) - 1
    out = []
    for b in (band, band + 1):
        if ALLOWED[b]:  # else only equal sets are similar
            for seed in range(CUTS):
                found, over = cut(own, b, seed, int(ALLOWED[b]), seed == CUTS - 1)
                out.append(found)
                if not over:
                    break
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_hash(own: np.ndarray) -> int:
    """The node of a set: its size goes into the hash."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) >> 1


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), texts_of(batch.column(1)))


def chunks_of(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[list[tuple[int | None, bytes]]]:
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += len(row[1] or b"")
        if len(chunk) == CHUNK or size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def sketch(own: np.ndarray) -> bytes:
    """A bit for the parity of the elements that fall on it, two to four bits an element.

    Two sets' sketches differ in no more bits than the sets have elements of one of them alone, so they rule pairs out.
    """
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def folded(rows: list[np.ndarray]) -> np.ndarray:
    """Sketches of different sizes as rows of words, all folded to the smallest size."""
    least = min(map(len, rows))
    return np.stack([x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in rows])


def apart(left: bytes, right: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    a, b = folded([np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)])
    return int(np.bitwise_count(a ^ b).sum())


#: What travels to a bucket. n >= 0: a document with its set size and sketch. PACKED: signatures and their sets.
#: SPREAD: signatures, their sets and leaders.
PACKED, SPREAD = -1, -2
SENT = "bucket int, id long, node long, n int, bits binary"
#: What comes back. n null: a set that shares a signature, with its leader.
KEPT = "sig long, node long, lead long, id long, n int, bits binary"


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned 64-bit integers, byte by byte."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def packed(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Sorted signatures as differences, and their sets as places in a list."""
    sets, place = np.unique(node, return_inverse=True)
    width = max(1, (len(sets) - 1).bit_length() + 7 >> 3)
    return np.array([len(sig), len(sets), width], "<u4").tobytes() + sets.astype("<i8").tobytes() + planes(np.diff(sig, prepend=np.uint64(0)), 6) + planes(place, width)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, sets, width = np.frombuffer(data, "<u4", 3).tolist()
    listed, at = np.frombuffer(data, "<i8", sets, 12), 12 + 8 * sets
    return np.cumsum(unplaned(data[at : at + 6 * n], 6)), listed[unplaned(data[at + 6 * n :], width).astype(np.int64)]


def table_of(schema: str, rows: int, **columns: np.ndarray | pa.Array) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind]) for name, kind in named})


def enumerate_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for chunk in chunks_of(rows_of(batches)):
        ids, sizes, nodes, bits, sigs, owner, seen = [], [], [], [], [], [], set()
        for doc_id, text in chunk:
            own = shingles(text or b"", words)
            node = set_hash(own) if len(own) and doc_id is not None else None
            ids.append(doc_id)
            sizes.append(len(own))
            nodes.append(node)
            bits.append(sketch(own) if node is not None else None)
            if node is not None and node not in seen:
                seen.add(node)
                found = signatures(own)
                sigs.append(found)
                owner.append(np.full(len(found), node, np.int64))
        spread = mix(np.array([(i or 0) & ALL for i in ids], np.uint64)) % np.uint64(buckets)
        yield from table_of(SENT, len(ids), bucket=spread.astype(np.int32), id=ids, node=nodes, n=sizes, bits=bits).to_batches()
        sig = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
        if not len(sig):
            continue
        order = np.argsort(sig)
        sig, node = sig[order], np.concatenate(owner)[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.diff(np.append(start, len(sig)))
        crowd = np.repeat(many > CROWD, many)
        lead = np.repeat(np.minimum.reduceat(node, start), many)
        plain = ~crowd | (node == lead)
        out: list[tuple[int, int, bytes]] = []
        own_sig, own_node = sig[plain], node[plain]
        where = bucket_of(own_sig, buckets)
        ends = np.flatnonzero(np.diff(where, prepend=-1, append=buckets))
        out += [(int(where[a]), PACKED, packed(own_sig[a:b], own_node[a:b])) for a, b in zip(ends[:-1], ends[1:])]
        at = np.flatnonzero(crowd)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            three = np.stack([sig[part].astype(np.int64), node[part], lead[part]])
            out.append((int(mix(three[:1, 0].astype(np.uint64) + three[1, :1].astype(np.uint64))[0] % np.uint64(buckets)), SPREAD, three.tobytes()))
        yield from table_of(SENT, len(out), bucket=[k for k, _, _ in out], n=[kind for _, kind, _ in out], bits=[x for _, _, x in out]).to_batches()


def meet(group: pa.Table) -> pa.Table:
    """The documents of a bucket, and the sets that share a signature."""
    n = group.column("n").to_numpy()
    documents = group.filter(pa.array(n >= 0))
    outs = [table_of(KEPT, len(documents), **{c: documents.column(c).combine_chunks() for c in ("node", "id", "n", "bits")})]
    lists = [unpacked(x.as_py()) for x in group.filter(pa.array(n == PACKED)).column("bits")]
    if lists:
        sig, node = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[new], node[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        many = np.diff(np.append(start, len(sig)))
        shared = np.repeat(many > 1, many)
        lead = np.repeat(node[start], many)
        outs.append(table_of(KEPT, int(shared.sum()), sig=sig[shared].astype(np.int64), node=node[shared], lead=lead[shared]))
    for x in group.filter(pa.array(n == SPREAD)).column("bits"):
        three = np.frombuffer(x.as_py(), "<i8").reshape(3, -1)
        outs.append(table_of(KEPT, three.shape[1], sig=three[0], node=three[1], lead=three[2]))
    return pa.concat_tables(outs)


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for chunk in chunks_of(rows_of(batches)):
        made = [shingles(text or b"", words) for _, text in chunk]
        flat = np.concatenate([m.view(np.int64) for m in made])
        ends = np.cumsum([0] + [len(m) for m in made]).astype(np.int32)
        nodes = pa.array([set_hash(m) if len(m) else None for m in made], pa.int64())
        yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "own"])


def shipped(small: DataFrame) -> DataFrame:
    """A stored table with the hint to broadcast it where its counted rows are few."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def possible(pairs: DataFrame, nodes: DataFrame, similar: int, of: int) -> DataFrame:
    """u, v and the sketches' distance d of the stored pairs that neither sizes nor sketches rule out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv, left, right = (batch.column(c).to_pylist() for c in ("nu", "nv", "bits_u", "bits_v"))
            d = np.array([apart(a, b) for a, b in zip(left, right)], np.int64)
            keep = pa.array(d * (of + similar) <= (np.array(nu, np.int64) + np.array(nv, np.int64)) * (of - similar))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep), pa.array(d, pa.int32()).filter(keep)], names=["u", "v", "d"])

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    close = of * F.least("nu", "nv") >= similar * F.greatest("nu", "nv")
    joined = side("v").join(shipped(pairs), "v").join(side("u"), "u").where(close)
    return joined.select("u", "v", "nu", "nv", "bits_u", "bits_v").mapInArrow(near, "u long, v long, d int")


def sets_of(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """node and own, the sorted shingle hashes, of every set in the pairs, made again from one text of each."""
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node").select("node", F.col("least").alias("id")), "wanted")
    few = texts.join(shipped(wanted.select("id").distinct()), "id", "left_semi")
    own = few.mapInArrow(sets, "node long, own array<long>").join(shipped(wanted.select("node")), "node", "left_semi")
    return own.dropDuplicates(["node"]) if repeated else own


def similar_pairs(pairs: DataFrame, own: DataFrame, similar: int, of: int) -> DataFrame:
    """The stored pairs (u, v) whose sets are similar."""
    right = own.select(F.col("node").alias("v"), F.col("own").alias("right"))
    left = own.select(F.col("node").alias("u"), F.col("own").alias("left"))
    both = F.size(F.array_intersect("left", "right"))
    return right.join(shipped(pairs), "v").join(left, "u").where(of * both >= similar * (F.size("left") + F.size("right") - both)).select("u", "v")


def offered(split: DataFrame, nodes: DataFrame, similar: int, of: int) -> DataFrame:
    """u, v, d of pairs of members of one signature, in different components, that sizes and sketches do not rule out.

    `split` has sig, node, root and members. Signatures of few members are taken many at a time. Beyond SMALL members
    they are dealt into blocks of about BLOCK; a task holds two blocks at a time. A pair turns up in all signatures that it
    shares. Each set knows those of its signatures that are in the sample: the least one that both sets know gives the pair
    out. What shares none of the sample shares few, and comes once from each task.
    """
    blocks = F.when(F.col("members") > SMALL, F.ceil(F.col("members") / BLOCK).cast("int")).otherwise(F.lit(1))
    many = max(1, -(-split.where(F.col("members") <= SMALL).count() // ROWS))
    known = split.where(F.pmod(F.xxhash64("sig"), F.lit(SAMPLE)) == 0).groupBy("node").agg(F.collect_set("sig").alias("known"))
    own = nodes.select("node", "n", "bits").join(split, "node").join(known, "node", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    lot = F.when(F.col("members") > SMALL, F.col("sig")).otherwise(F.pmod(F.xxhash64("sig"), F.lit(many)))
    dealt = own.select("*", lot.alias("lot"), (F.col("members") > SMALL).alias("big"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("sig", "node", "root", "n", "bits", "known", "block", "lot", "big", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def near(group: pa.Table) -> pa.Table:
        group = group.sort_by([("sig", "ascending"), ("node", "ascending")])
        sig, node, root, n, block = (group.column(c).to_numpy() for c in ("sig", "node", "root", "n", "block"))
        rows = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
        known = [frozenset(x or ()) for x in group.column("known").to_pylist()]
        within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        u, v, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        ends = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig)).tolist()
        for start, end in zip(ends[:-1], ends[1:]):
            words = folded(rows[start:end])
            step = end - start if end - start <= SMALL else 1
            for k in range(0, end - start - 1, step):
                a, b = (np.triu_indices(step, 1) if step > 1 else (np.full(end - start - k - 1, k), np.arange(k + 1, end - start)))
                ga, gb = a + start, b + start
                far_apart = root[ga] != root[gb]
                if not within:
                    far_apart &= block[ga] != block[gb]
                a, b, ga, gb = a[far_apart], b[far_apart], ga[far_apart], gb[far_apart]
                if not len(a):
                    continue
                far = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
                fits = (far * (of + similar) <= (n[ga] + n[gb]) * (of - similar)) & (of * np.minimum(n[ga], n[gb]) >= similar * np.maximum(n[ga], n[gb]))
                here = int(sig[start])
                fits[fits] = [min(known[x] & known[y], default=here) == here for x, y in zip(ga[fits].tolist(), gb[fits].tolist())]
                u.append(node[ga[fits]])
                v.append(node[gb[fits]])
                d.append(far[fits])
        pairs, first = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0, return_index=True)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1], "d": pa.array(np.concatenate(d)[first], pa.int32())})

    return dealt.groupBy("big", "lot", "i", "j").applyInArrow(near, "u long, v long, d int")


def between(split: DataFrame, nodes: DataFrame, similar: int, of: int) -> DataFrame:
    """The offered pairs, each once."""
    return offered(split, nodes, similar, of).groupBy("u", "v").agg(F.max("d").alias("d"))


def rooted(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """`rows` with root_x of each column x: the component's least node, or itself."""
    for c in columns:
        rows = rows.join(shipped(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return rows


def linked_documents(docs: DataFrame, similar: int, of: int, id_col: str, text_col: str) -> DataFrame:
    """id, node, n and root of every row; node and root are null for rows without words or id."""
    if (similar, of) != (SIMILAR, OF):
        raise ValueError("the bands are made for the module's threshold")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch()
    buckets = max(16, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS))
    sent = texts.mapInArrow(lambda b: enumerate_rows(b, buckets), SENT)
    kept = scratch.stored(sent.groupBy("bucket").applyInArrow(meet, KEPT), "signatures")
    documents, members = kept.where("n IS NOT NULL").select("id", "node", "n", "bits"), kept.where("n IS NULL").select("sig", "node", "lead")
    nodes = scratch.stored(documents.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    repeated = not documents.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()

    led = members.where("node != lead").select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct()
    pairs = scratch.stored(possible(scratch.stored(led, "led"), nodes, similar, of), "pairs")
    own = scratch.stored(sets_of(pairs, texts, nodes, repeated), "sets")
    links = scratch.stored(similar_pairs(pairs.select("u", "v"), own, similar, of), "links")
    roots = components(links)

    # What a leader has not joined: members of one signature in different components.
    placed = rooted(members.select("sig", "node"), roots, "node")
    sides = placed.groupBy("sig").agg(F.min("root_node").alias("a"), F.max("root_node").alias("b"), F.count("*").alias("members")).where("a != b AND members > 2")
    sides = scratch.stored(sides.select("sig", "members"), "sides")
    split = scratch.stored(placed.join(shipped(sides), "sig").select("sig", "node", F.col("root_node").alias("root"), "members"), "split")
    open_ = scratch.stored(between(split, nodes, similar, of).join(pairs.select("u", "v"), ["u", "v"], "left_anti"), "between")
    own = scratch.stored(sets_of(open_, texts, nodes, repeated), "sets")
    most = 1
    while not open_.isEmpty():
        order = Window.partitionBy("u").orderBy("d", "v")
        ranked = open_.select("*", F.row_number().over(order).alias("rank"))
        tried = scratch.stored(similar_pairs(scratch.stored(ranked.where(F.col("rank") <= most).select("u", "v"), "tried"), own, similar, of), "links")
        stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        before, roots = roots, components(stars.unionByName(tried))
        rest = ranked.where(F.col("rank") > most).select("u", "v", "d")
        open_ = scratch.stored(rooted(rest, roots, "u", "v").where("root_u != root_v").select("u", "v", "d"), "between")
        most *= 8

    out = stored(documents.select("id", "node", "n").join(shipped(roots), "node", "left").select("id", "node", "n", F.coalesce("root", "node").alias("root")), "linked")
    scratch.clear()
    return out


def similar_documents(docs: DataFrame, *, similar: int = SIMILAR, of: int = OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id, the least id that links reach."""
    linked = linked_documents(docs, similar, of, id_col, text_col)
    named = stored(linked.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "named")
    return linked.join(shipped(named), "root", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that with the least id, then set, then text.

    Rows without words or id stay. Rows that share an id are judged each by its own text.
    """
    scratch = Scratch()
    linked = linked_documents(docs, SIMILAR, OF, id_col, text_col)
    rows = linked.where("root IS NOT NULL")
    first = scratch.stored(rows.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("root", "first.id", "first.node"), "first")
    left = rows.join(shipped(first.select("root", F.col("id").alias("first_id"))), "root", "left")
    twice = stored(linked.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "twice")
    dropped = stored(left.where("id != first_id").select("id").distinct().join(shipped(twice), "id", "left_anti"), "dropped")
    key = docs[id_col].cast("long")
    once = docs.join(shipped(dropped.unionByName(twice).withColumnRenamed("id", "dropped_id")), key == F.col("dropped_id"), "left_anti")
    if twice.isEmpty():
        return once
    # Few rows: those whose id comes more than once. Each is placed by the set of its own text.
    packed_ = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(shipped(twice), "id", "left_semi")

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            made = [shingles(t or b"", words) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_hash(m) if len(m) else None for m in made], pa.int64())], names=[*batch.schema.names, "node"])

    own = packed_.mapInArrow(with_node, StructType([*packed_.schema.fields, StructField("node", LongType())]))
    chosen = stored(linked.select("id", "node", "root").distinct().join(shipped(first.select("root", F.struct("id", "node").alias("first"))), "root").where(F.struct("id", "node") != F.col("first")).select("id", "node"), "others")
    kept = own.join(shipped(chosen), ["id", "node"], "left_anti")
    place = F.row_number().over(Window.partitionBy("id", "node").orderBy("text"))
    return once.unionByName(kept.select("*", place.alias("place")).where("place = 1 OR node IS NULL").select("row.*"))

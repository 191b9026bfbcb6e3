"""Fixed virtual slots: ids hash into slots for good, a small versioned map says which shard a slot belongs to.

The first map of n shards depends on n and the slot count alone (law `key`): each added shard takes slots from
the fullest shards until all are even, so that growth moves rows only into the new shard. rebalance() edits a map
by the bytes of its slots. Maps stand in a folder of one part per version (version, slot, shard); append_map() adds a
version to it, load_map() reads one or the last. Rows are placed by a stored version; only an empty store gets a first map,
and a version is added only if it differs from the last. A record's place in its shard is the count of rows in the shard's
earlier slots and lots (parts of a slot by the text's CRC) plus its rank in its own lot, so that no task numbers a whole
shard, nor the slot of an id that many rows have.

Null ids share one slot; null texts have no bytes and CRC 0; repeated rows each get a place of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stored, text_of

SLOTS = 4096
#: Parts of a slot that are numbered apart.
LOTS = 16


def slot_of(id_col: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(slots)).cast("int")


def grown(owner: list[int]) -> list[int]:
    """The map with one more shard, which takes slots from the fullest shards (ties: the lowest number)."""
    shards = max(owner) + 1
    mine: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        mine[shard].append(slot)
    out = list(owner)
    for _ in range(len(owner) // (shards + 1)):
        giver = max(range(shards), key=lambda s: (len(mine[s]), -s))
        out[mine[giver].pop(len(mine[giver]) // 2)] = shards
    return out


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    owner = [0] * slots
    for _ in range(shards - 1):
        owner = grown(owner)
    return owner


def rebalance(owner: list[int], size: list[int]) -> list[int]:
    """Move slots from the heaviest shard to the lightest while that narrows their gap."""
    out, shards = list(owner), max(owner) + 1
    total = [0] * shards
    for slot, shard in enumerate(out):
        total[shard] += size[slot]
    while True:
        heavy, light = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        fit = [x for x, s in enumerate(out) if s == heavy and 0 < size[x] < total[heavy] - total[light]]
        if not fit:
            return out
        slot = min(fit, key=lambda x: (abs(2 * size[x] - (total[heavy] - total[light])), x))
        out[slot] = light
        total[heavy] -= size[slot]
        total[light] += size[slot]


def last_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def append_map(spark: SparkSession, path: str, owner: list[int]) -> int:
    """Write a map as the next version of the store at `path` (0 where there is none); versions before it stay as they are."""
    try:
        version = last_version(spark, path) + 1
    except AnalysisException:  # no such folder
        version = 0
    rows = spark.createDataFrame(list(enumerate(owner)), "slot INT, shard INT").coalesce(1)
    rows.write.parquet(f"{path}/version={version}")
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The shard of each slot in a version of the store, the last one by default; at most as many rows as slots."""
    version = last_version(spark, path) if version is None else version
    return [r.shard for r in spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()]


def open_map(spark: SparkSession, path: str, shards: int, slots: int, version: int | None = None) -> int:
    """The version (by default the last) of the store to place rows by; an empty store gets the first map, one of fewer shards grows by a version."""
    try:
        owner = load_map(spark, path, version)
    except AnalysisException:  # no such folder
        if version is not None:
            raise
        return append_map(spark, path, first_map(shards, slots))
    have = max(owner) + 1
    if len(owner) != slots or have > shards or (have < shards and version is not None):
        raise ValueError(f"the map has {len(owner)} slots and {have} shards")
    while max(owner) + 1 < shards:
        owner = grown(owner)
    return append_map(spark, path, owner) if have < shards else last_version(spark, path) if version is None else version


def rebalanced(spark: SparkSession, path: str, sizes: DataFrame, version: int | None = None) -> list[int]:
    """A stored map (by default the last) edited by the bytes of its slots (virtual_slot, bytes: at most one row per slot)."""
    owner = load_map(spark, path, version)
    found = {r.virtual_slot: r.bytes for r in sizes.collect()}
    return rebalance(owner, [found.get(slot, 0) for slot in range(len(owner))])


def append_rebalanced(spark: SparkSession, path: str, sizes: DataFrame) -> int:
    """The last map edited by the bytes of its slots, as the next version."""
    return append_map(spark, path, rebalanced(spark, path, sizes))


def shard_documents(docs: DataFrame, shards: int, *, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", maps: str | None = None, version: int | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, balanced_shard, virtual_slot and its bytes.

    Rows are placed by a version (by default the last) of the store of maps (`maps`, or a new folder): `shard`. `law` is `key` where
    that map is the first of its shards, else `map`. `grown_shard` is what one more shard would make of it, and `balanced_shard`
    what the bytes of its slots make of it, which is stored as the next version.
    """
    spark = docs.sparkSession
    path = maps or shared_path(spark, "slot-maps")
    raw = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(F.col(id_col), (F.length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), slot_of(id_col, slots).alias("virtual_slot"))
    rows = rows.withColumn("_lot", (F.col("text_crc32") % LOTS).cast("int"))
    lots = stored(rows.groupBy("virtual_slot", "_lot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "slot-bytes")
    version = open_map(spark, path, shards, slots, version)
    owner, more = load_map(spark, path, version), shared_path(spark, "grown-map")
    append_map(spark, more, grown(owner))
    edited = rebalanced(spark, path, lots.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")), version)
    balanced = last_version(spark, path) if edited == load_map(spark, path) else append_map(spark, path, edited)
    law = "key" if owner == first_map(shards, slots) else "map"
    read = lambda store, of, name: spark.read.parquet(f"{store}/version={of}").select(F.col("slot").alias("virtual_slot"), F.col("shard").alias(name))
    owners = read(path, version, "shard").join(read(more, 0, "grown_shard"), "virtual_slot").join(read(path, balanced, "balanced_shard"), "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot", "_lot").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("bytes").over(Window.partitionBy("virtual_slot")).alias("slot_bytes")
    placed = owners.join(lots, "virtual_slot").select("virtual_slot", "_lot", "shard", "grown_shard", "balanced_shard", whole, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "_lot").orderBy(id_col, "text_crc32", "size"))
    ranked = rows.select("*", rank.alias("rank"))
    return ranked.join(F.broadcast(placed), ["virtual_slot", "_lot"]).select(  # at most `slots` x LOTS rows
        id_col, "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard", "balanced_shard", "virtual_slot", "slot_bytes"
    )

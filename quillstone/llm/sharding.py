"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand slots, whatever the number of
shards. Bytes are summed per slot, and a versioned slot-to-shard map, one row
per slot, says where each slot lives. Rebalancing edits that map and moves no
other slot. Native throughout: the map, bounded by the number of slots, is laid
out by a higher-order aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty, utf8

SLOTS = 4096
LAW = "bytes"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the leading 32 bits of its MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(utf8(text)), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def record_bytes(text: str) -> Column:
    """Bytes a record takes: its UTF-8 text and one more."""
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def slotted_records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``_id, size, text_crc32, vslot``: a row per record without its text.

    A record hashes by its key. Records that share a key, NULL ones too, hash by
    the key and a stored number of their own, so that a key with a third of all
    rows fills all slots alike.
    """
    records = stored(docs.select(
        F.col(key).alias("_id"), record_bytes(text).alias("size"),
        F.crc32(utf8(text_or_empty(text))).alias("text_crc32"), F.monotonically_increasing_id().alias("_number")), "records")
    shared = stored(records.groupBy(F.col("_id").alias("_key")).agg(F.count("*").alias("_times")).filter(
        "_times > 1").select("_key", F.lit(True).alias("_shared")), "shared-keys")
    own = F.concat_ws("#", F.col("_id").cast("string"), F.col("_number").cast("string"))
    hashed = F.when(F.col("_shared"), own).otherwise(F.col("_id").cast("string"))
    return records.join(shared, F.col("_id").eqNullSafe(F.col("_key")), "left").select(
        "_id", "size", "text_crc32", virtual_slot(hashed, slots).alias("vslot"))


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, n``, summed in the tasks before the shuffle."""
    return _per_slot(slotted_records(docs, key, text, slots))


def _per_slot(records: DataFrame) -> DataFrame:
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def slot_map(sized: DataFrame, shards: int) -> DataFrame:
    """``version, vslot, bytes, n, shard``: the heaviest slot first, each to the lightest shard."""
    first = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("placed"))

    def place(state: Column, slot: Column) -> Column:
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(
            state["loads"], lambda x, i: x + F.when(i == lightest, slot["bytes"]).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.concat(state["placed"], F.array(lightest)).alias("placed"))

    heavy = F.sort_array(F.collect_list(F.struct(
        (-F.col("bytes")).alias("order"), "vslot", "bytes", "n")))
    return (
        sized.agg(heavy.alias("heavy"))
        .withColumn("placed", F.aggregate("heavy", first, place)["placed"])
        .select(F.posexplode("heavy").alias("i", "s"), "placed")
        .select(F.lit(1).alias("version"), "s.vslot", "s.bytes", "s.n",
                F.element_at("placed", F.col("i") + 1).alias("shard"))
    )


def rebalance(mapped: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards: slots move only into new shards.

    Every old shard gives up slots, lightest first, while what it gives stays
    within what it holds above the new even share; new shards take them in turn.
    Slots of equal bytes go by number; no more shards than before, or an empty
    map, moves nothing.
    """
    old = mapped.groupBy("shard").agg(F.sum("bytes").alias("load"))
    share = mapped.agg((F.sum("bytes") / shards).alias("share"), (F.max("shard") + 1).alias("old_shards"))
    given = Window.partitionBy("shard").orderBy("bytes", "vslot")
    turn = Window.partitionBy("leaves").orderBy(F.col("bytes").desc(), "vslot")
    moved = (
        mapped.join(old, "shard").join(F.broadcast(share))
        .withColumn("leaves", F.sum("bytes").over(given) <= F.col("load") - F.col("share"))
        .withColumn("taker", (F.col("old_shards") + F.pmod(
            F.row_number().over(turn) - 1, F.greatest(shards - F.col("old_shards"), F.lit(1)))).cast("int"))
    )
    return moved.select(
        (F.col("version") + 1).alias("version"), "vslot", "bytes", "n",
        F.when(F.col("leaves") & (F.col("old_shards") < shards), F.col("taker"))
        .otherwise(F.col("shard")).alias("shard"))


def save_map(mapped: DataFrame, path: str) -> int:
    """Publish a map below ``path`` as its version, and return that.

    A map is one small file, visible at once when its write commits. A version
    is never overwritten: one that is there already is an error. So is an empty
    map, which has no version.
    """
    first = mapped.select("version").first()
    if first is None:
        raise ValueError("an empty slot map has no version")
    mapped.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={first.version}")
    return first.version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map published as ``version`` below ``path``, the newest one by default; a version not there has no row."""
    found = spark.read.parquet(path).withColumn("version", F.col("version").cast("int"))
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.filter(F.col("version") == version).select("version", "vslot", "bytes", "n", "shard")


def place_records(records: DataFrame, mapped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, vslot, shard, slot``: a shard and a gapless place in it per record.

    ``records`` comes from :func:`slotted_records`. Records are numbered inside
    their slot, which hashing keeps even, and a slot starts where the slots
    before it in its shard end; so no task holds a shard. NULL texts count as
    one byte; equal rows get places of their own.
    """
    inside = Window.partitionBy("vslot").orderBy("_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.select(
        "vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return (
        records.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "vslot")  # one row per slot
        .select(F.col("_id").alias(key), "size", "text_crc32", "vslot", "shard",
                (F.col("_start") + F.col("_place")).cast("long").alias("slot"))
    )


def shard_documents(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS,
) -> DataFrame:
    """Records placed by a fresh map under the law of near equal bytes.

    NULL and empty texts are one byte; keys, NULL ones too, may repeat, and
    equal rows get places of their own; other columns are ignored; an empty
    table gives an empty result.
    """
    records = slotted_records(docs, key, text, slots)
    mapped = stored(slot_map(_per_slot(records), shards), "slot-map")
    placed = place_records(records, mapped, key)
    return placed.select(
        key, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")

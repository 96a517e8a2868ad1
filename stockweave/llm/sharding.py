"""Sharding by fixed virtual slots, with built-in functions only.

A record's slot is a hash of its id and text, modulo a fixed count of some thousand slots, and never
changes. A map gives each slot a shard; its versions are rows (version, slot, shard, bytes) of one
table, so earlier placements stay readable. A new version edits the last one: shards above their
share give up slots, the largest that fit kept first, and these go, largest first, to the shard
with the least bytes (or only to new shards, when the count grows). The first version is the
same edit of an empty map. Maps have as many rows as there are slots, so editing one is a
fold over a bounded array.

Places inside a shard are gapless: rows are dealt to 16 parts of each slot by a hash of their
place in the stored table, so no key, not even one that holds a third of the rows, makes a large
part; a part numbers its rows, and the counts of the parts before it, at most slots * 16 numbers,
are its offset.

Defined results: a null text has size 1; a null doc_id is hashed as such; rows that repeat are
placed each; an empty table gives no rows and a map of empty slots. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SLOTS, PARTS = 4096, 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("\0"), text), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes of every slot, empty ones too: slot, bytes. Tasks add up their own rows first."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(records.groupBy("slot").agg(F.sum("size").alias("bytes")), "slot", "left").select(
        "slot", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def edit_map(bytes_of: DataFrame, shards: int, before: DataFrame | None = None, only_new: bool = False) -> DataFrame:
    """The next version of a map for the slots' present bytes: version, slot, shard, bytes.

    `only_new` lets slots move into shards that the last version did not have, and nowhere else.
    """
    if before is None:
        held = bytes_of.withColumn("shard", F.lit(-1)).withColumn("version", F.lit(0))
        version, old = 1, 0
    else:
        version = before.agg(F.max("version")).first()[0]
        last = before.filter(F.col("version") == version)
        old = last.agg(F.max("shard")).first()[0] + 1
        held, version = last.drop("bytes", "version").join(bytes_of, "slot"), version + 1
    share = bytes_of.agg((F.sum("bytes") / shards).alias("share")).first()[0] or 0.0
    # Inside a shard the largest slots that fit under the share stay; a slot moves only if that leaves more than is due.
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    filled = held.withColumn("filled", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stays = (F.col("shard") >= 0) & (F.col("shard") < shards) & (F.col("filled") <= share)
    marked = filled.select("slot", "bytes", F.when(stays, F.col("shard")).otherwise(-1).alias("shard"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.aggregate(
        F.filter("kept", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda acc, x: acc + x["bytes"]))
    grouped = marked.agg(
        F.collect_list(F.when(F.col("shard") >= 0, F.struct("shard", "bytes", "slot"))).alias("kept"),
        F.sort_array(F.collect_list(F.when(F.col("shard") < 0, F.struct("bytes", (-F.col("slot")).alias("back")))), False).alias("free"))
    first = old if only_new and old < shards else 0

    def place(acc: Column, x: Column) -> Column:
        open_to = F.slice(acc["loads"], first + 1, shards - first)
        k = F.array_position(open_to, F.array_min(open_to)).cast("int") - 1 + first
        loads = F.transform(acc["loads"], lambda v, i: v + F.when(i == k, x["bytes"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(acc["out"], F.array(F.struct(
            k.alias("shard"), x["bytes"].alias("bytes"), (-x["back"]).cast("int").alias("slot")))).alias("out"))

    start = F.struct(F.col("loads"), F.array().cast("array<struct<shard:int,bytes:bigint,slot:int>>").alias("out"))
    placed = grouped.withColumn("loads", loads).select("kept", F.aggregate("free", start, place, lambda acc: acc["out"]).alias("placed"))
    return placed.select(F.explode(F.concat("kept", "placed")).alias("m")).select(
        F.lit(version).alias("version"), F.col("m.slot").alias("slot"), F.col("m.shard").alias("shard"), F.col("m.bytes").alias("bytes"))


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The stored narrow table that placing works on: doc_id, size, text_crc32, virtual_slot as slot, part."""
    text = F.col("text").cast("string")
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")
    return cut(docs.select("doc_id", record_size(text).alias("size"), F.crc32(text_or_empty()).alias("text_crc32"),
                           slot_of(F.col("doc_id"), text, slots).alias("slot"), part.alias("part")))


def place(records: DataFrame, shard_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Records with shard and position (gapless from 0 in each shard) by one version of a map."""
    where = F.broadcast(shard_map.select("slot", "shard"))  # one row a slot
    counts = records.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).join(where, "slot")
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset")))
    inside = Window.partitionBy("slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("_row", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["slot", "part"]).withColumn(  # at most slots * PARTS rows
        "position", (F.col("offset") + F.col("_row") - 1).cast("long")).drop("_row", "offset", "part")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, text_crc32, slot, shard, position per row; the map's first version)."""
    records = records_of(docs, slots)
    first = cut(edit_map(slot_bytes(records, slots), shards))
    return place(records, first, slots), first


def store_map(shard_map: DataFrame, path: str) -> None:
    """Append a version to the map's table."""
    shard_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the last one by default."""
    every = spark.read.parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.filter(F.col("version") == version)

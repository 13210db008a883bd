"""Sharding by fixed virtual slots (DataFrame and SQL functions only). Law: ``bytes``.

1. Every record hashes into one of ``slots`` virtual slots (4096), by doc_id,
   text checksum and copy number, so that no repeated id or text fills one slot.
2. Bytes and rows are summed per slot; that table has ``slots`` rows at any input size.
3. The slot-to-shard map is a stored table of versions. Version 0 deals slots
   out by number; ``rebalance`` edits it by the bytes: taken from the largest
   slot down, a slot stays where it is while its shard has room under the mean
   and otherwise moves to the least loaded shard. Records never rehash: adding
   a shard edits the map again (``rebalance(..., shards + 1)``).
4. Records join the map (broadcast; ``slots`` rows) and get a position inside
   their shard: a row number inside the virtual slot plus the rows of the
   shard's earlier slots. No task holds more than one virtual slot.

Defined cases: null text has size 1 and a null checksum; null doc_id hashes as
a value; repeated rows are counted, dealt out by copy number and returned as
often; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cropframe.llm.common import doc_rows, shared_path, stored

SLOTS = 4096
SHARDS = 8
LAW = "bytes"
#: Copies of one row that are numbered together.
RUN = 10_000


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) of every row."""
    rows = doc_rows(docs).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                                 F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    # copies are numbered in runs, so that no array is as long as the most repeated row
    rows = rows.select("doc_id", "size", "text_crc32", "copies", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("run"))
    rows = rows.select("doc_id", "size", "text_crc32", F.explode(F.sequence(
        F.col("run") * RUN + 1, F.least("copies", (F.col("run") + 1) * RUN))).alias("copy"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows): one row for every slot, empty ones too."""
    seen = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(seen), "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the slot-to-shard map: slots dealt out by number."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, edited for near-equal bytes over ``shards`` shards."""
    latest = slot_map.groupBy("virtual_slot").agg(F.max(F.struct("version", "shard")).alias("m"))
    rows = (sizes.join(F.broadcast(latest), "virtual_slot")
            .agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", F.col("m.shard").alias("shard"))), False)
                 .alias("s"), F.max("m.version").alias("version"),
                 F.ceil(F.sum("bytes") / F.lit(shards)).cast("long").alias("mean")))
    out_type = "array<struct<virtual_slot:int,shard:int>>"
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast(out_type).alias("out"))

    def place(acc, slot):
        stays = (slot["shard"] < shards) & (acc["loads"][slot["shard"]] + slot["bytes"] <= F.col("mean"))
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        to = F.when(stays, slot["shard"]).otherwise(least)
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard")))
                     .cast(out_type)).alias("out"))

    placed = rows.select((F.col("version") + 1).alias("version"), F.aggregate("s", zero, place)["out"].alias("out"))
    return placed.select("version", F.explode("out").alias("o")).select("version", "o.virtual_slot", "o.shard")


def stored_map(spark: SparkSession, path: str, slots: int = SLOTS) -> DataFrame | None:
    """All versions of the map at ``path``; None where nothing is stored yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if found.select("virtual_slot").distinct().count() != slots:
        raise ValueError(f"the map at {path} has another number of slots than {slots}")
    return found


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """Every row's shard, position in it, virtual slot and map version.

    The map's versions are stored at ``map_path`` (default: a new path in the shared folder). A path
    that holds a map keeps its history: the newest version is edited for these rows
    and appended as the next one, so slots move only where the bytes ask for it.
    """
    spark, path = docs.sparkSession, map_path or shared_path(docs.sparkSession, "sharding-map")
    rows = stored(slotted(docs, slots), "sharding-rows")
    sizes = slot_sizes(rows, slots)
    history = stored_map(spark, path, slots) if map_path else None
    known = first_map(spark, slots, shards) if history is None else history
    edited = rebalance(known, sizes, shards)
    (known.unionByName(edited) if history is None else edited).write.mode("append").parquet(path)
    maps = spark.read.schema(known.schema).parquet(path)
    now = maps.where(F.col("version") == maps.agg(F.max("version")).scalar()).join(F.broadcast(sizes), "virtual_slot")
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    now = now.select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    rows = rows.withColumn("place", F.row_number().over(place) - 1)
    return rows.join(F.broadcast(now), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.col("version").alias("map_version"))

"""Fixed virtual slots: records hash into thousands of slots, a small versioned map places slots on shards.

Law ``key``: a record's slot comes from its ``doc_id`` alone, and a slot's shard from the shard count alone: it
goes to the shard for which the hash of slot and shard is greatest. So equal ids and equal shard counts always
give the same shard, the map for n + 1 shards is the map for n with some slots moved into the new shard, and
``first_map(n + 1)`` equals ``grow_map(first_map(n))``. Law ``bytes``: ``rebalance_map`` edits that map by
the bytes aggregated for each slot, so that shards hold nearly the same. Versions are kept where later runs find them. Only
map rows (``n_slots`` at most) are ever broadcast.

Edge cases: a null id takes its slot from the text's hash; a null text has size 1 and the CRC of no
bytes; equal rows get different places in the same shard; a very long text is one row like any other, and a slot is never
cut, so ``bytes`` is as even as the largest slot allows; an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_root, staged

N_SLOTS = 4096


def virtual_slot(key: Column, otherwise: Column, n_slots: int = N_SLOTS) -> Column:
    """The record's fixed slot: a hash of the key, or of ``otherwise`` where the key is null."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(otherwise), F.lit(""))))), F.lit(n_slots)).cast("int")


def _weight(shard: Column) -> Column:
    return F.xxhash64(F.col("virtual_slot"), shard.cast("int"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: each slot on the shard of greatest hash. Columns: version, virtual_slot, shard."""
    slots = spark.range(0, n_slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"))
    bids = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.struct(_weight(k).alias("weight"), (-k).alias("back")))
    return slots.select("version", "virtual_slot", (-F.array_max(bids)["back"]).cast("int").alias("shard"))


def grow_map(slot_map: DataFrame, new_shard: int) -> DataFrame:
    """The next version with one more shard, which takes the slots for which it has the greatest hash; no other slot moves."""
    others = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(new_shard - 1)), _weight))
    shard_ = F.when(_weight(F.lit(new_shard)) > others, F.lit(new_shard)).otherwise(F.col("shard")).cast("int")
    return slot_map.select((F.col("version") + 1).alias("version"), "virtual_slot", shard_.alias("shard"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot, of records with columns virtual_slot and size."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def rebalance_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version, edited for even bytes: what a shard holds beyond its share goes to shards below theirs.

    Slots that fit their shard's share stay where they are. All windows here run over map rows only.
    """
    spark = slot_map.sparkSession
    one = Window.partitionBy(F.lit(0))
    held = slot_map.join(sizes, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("slot_bytes")
    )
    share = F.lit(float(sizes.agg(F.sum("slot_bytes")).first()[0] or 0) / n_shards)
    held = held.withColumn("share", share).withColumn("upto", F.sum("slot_bytes").over(Window.partitionBy("shard").orderBy("virtual_slot")))
    stays = held.where("upto <= share")
    loads = (
        spark.range(0, n_shards, 1, 1).select(F.col("id").cast("int").alias("to_shard"))
        .join(stays.groupBy("shard").agg(F.sum("slot_bytes").alias("kept")), F.col("to_shard") == F.col("shard"), "left")
        .select("to_shard", F.greatest(F.lit(0.0), share - F.coalesce("kept", F.lit(0))).alias("room"))
    )
    loads = loads.select(
        "to_shard", "room", F.sum("room").over(one.orderBy("to_shard")).alias("room_end"), F.sum("room").over(one).alias("rooms")
    )
    moves = held.where("upto > share").withColumn("end", F.sum("slot_bytes").over(one.orderBy("virtual_slot")))
    moves = moves.withColumn("middle", (F.col("end") - F.col("slot_bytes") / 2.0) / F.sum("slot_bytes").over(one))
    placed = moves.join(
        F.broadcast(loads), (F.col("middle") * F.col("rooms") >= F.col("room_end") - F.col("room")) & (F.col("middle") * F.col("rooms") < F.col("room_end")), "left"
    )
    return stays.select((F.col("version") + 1).alias("version"), "virtual_slot", "shard").unionByName(
        placed.select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to_shard", "shard").alias("shard"))
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map (Parquet, a folder for each version)."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored at ``path``, in order; none where nothing is."""
    try:
        stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r[0] for r in stored.select("version").distinct().collect())


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map; the latest where none is named. A version that two runs stored counts once."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = versions(spark, path)[-1]
    return stored.where(F.col("version") == F.lit(version)).select("version", "virtual_slot", "shard").distinct()


def map_folder(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> str:
    """Where all runs keep the map of law ``key``, which depends on these two numbers only."""
    return f"{shared_root(spark)}/slot-map-{n_slots}-{n_shards}"


def shard(docs: DataFrame, path: str, n_shards: int = 8, n_slots: int = N_SLOTS, law: str = "key") -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) by the map at ``path``, which is begun where there is none.

    Law ``key`` uses versions 1 and 2, for n and n + 1 shards. Law ``bytes`` stores and uses a next version, the
    latest one edited by the bytes of these records; its folder is for one corpus.
    Result: doc_id, size, text_crc32, law, shard, slot (place within the shard, gapless from 0),
    grown_shard, virtual_slot, slot_bytes, map_version.
    """
    if law not in ("key", "bytes"):
        raise ValueError(f"law {law} is neither key nor bytes")
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    records = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), F.col("text"), n_slots).alias("virtual_slot"),
    )
    sizes = slot_sizes(records)
    stored = versions(spark, path)
    if not stored:
        store_map(first_map(spark, n_shards, n_slots), path)
    if law == "key":
        if 2 not in stored:
            store_map(grow_map(load_map(spark, path, 1), n_shards), path)
        now, grown = load_map(spark, path, 1), load_map(spark, path, 2).select("virtual_slot", F.col("shard").alias("grown_shard"))
    else:
        sizes = staged(sizes, "slot-sizes")
        store_map(rebalance_map(load_map(spark, path), sizes, n_shards), path)
        now = load_map(spark, path)
        grown = now.select("virtual_slot", F.lit(None).cast("int").alias("grown_shard"))
    table = (
        now.join(grown, "virtual_slot")
        .join(sizes, "virtual_slot")
        .withColumn("before", F.coalesce(F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # n_slots rows at most, whatever the input
    placed = records.join(F.broadcast(table), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("before") + place - 1).cast("long").alias("slot"),
        "grown_shard", "virtual_slot", "slot_bytes", F.col("version").alias("map_version"),
    )

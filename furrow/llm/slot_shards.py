"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, bytes are summed per slot, and a versioned table says
which shard owns each slot. Rebalancing edits that table: a slot stays where it is while its shard is under its
share, and only the rest moves. Records never move one by one, and the table's size depends on the slot
count alone.

The law is ``bytes``: the shards' sizes are near equal. A record is its key and its text's checksum, or its text where the key is
null. Equal records share a slot unless together they exceed a slot's share: such a hot record's rows are dealt to as many
slots as it has shares. Null texts count one byte. Empty tables give an empty result. The input's other
columns are not read, so extra or clashing columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import let, new_path, stored

SLOTS = 4096
SHARDS = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Key, size, checksum and virtual slot of every record; stored, so that a hot record's rows keep their slots."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"))
    name = F.when(F.col("doc_id").isNull(), F.xxhash64("_text")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    # _row tells a hot record's rows apart
    named = stored(records.select("doc_id", "size", "text_crc32", name.alias("_name"), F.monotonically_increasing_id().alias("_row")), "records")
    share = named.agg((F.sum("size") / slots).alias("share"))
    hot = named.groupBy("_name").agg(F.sum("size").alias("_bytes")).crossJoin(F.broadcast(share)).where("_bytes > share")  # share is one row
    dealt = hot.select("_name", F.ceil(F.col("_bytes") / F.col("share")).alias("_parts"))  # fewer rows than slots: each has more than a slot's share
    part = F.coalesce(F.pmod("_row", F.col("_parts")), F.lit(0).cast("long"))
    slot = F.pmod(F.xxhash64("_name", part), F.lit(slots)).cast("int")
    return named.join(F.broadcast(dealt), "_name", "left").select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_bytes(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(spark, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 knows no bytes: slots go round robin."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(old: DataFrame, sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: slots above their shard's share go, largest first, to the lightest shard.

    ``old`` and ``sums`` have one row a slot, so the fold over the loose slots is bounded by the slot count.
    A shard number at or above ``shards`` gives all its slots away.
    """
    known = old.join(sums, "virtual_slot", "left").fillna(0, ["slot_bytes"])
    total = known.agg((F.sum("slot_bytes") / shards).alias("share"))
    order = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot")
    fits = (F.sum("slot_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("share")) & (F.col("shard") < shards)
    marked = known.crossJoin(F.broadcast(total)).withColumn("stays", fits)  # total is one row
    slot = F.struct(F.col("slot_bytes"), (-F.col("virtual_slot")).alias("back"), F.col("virtual_slot"))
    loose = F.sort_array(F.collect_list(F.when(~F.col("stays"), slot)), asc=False)
    load = F.struct(F.col("shard"), F.when(F.col("stays"), F.col("slot_bytes")).otherwise(F.lit(0)).alias("b"))
    zero = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda _: F.lit(0).cast("long"))

    def put(loads: Column, shard: Column, size: Column) -> Column:
        return F.transform(loads, lambda x, i: F.when(i == shard, x + size).otherwise(x))

    def step(state: Column, x: Column) -> Column:
        return let(
            (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"),
            lambda to: F.struct(put(state["loads"], to, x["slot_bytes"]).alias("loads"), F.concat(state["moved"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), to.alias("shard")))).alias("moved")),
        )

    start = F.aggregate(F.col("owned"), zero, lambda loads, x: put(loads, x["shard"], x["b"]))
    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    folded = F.aggregate(F.col("loose"), F.struct(start.alias("loads"), empty.alias("moved")), step)
    moved = marked.agg(F.collect_list(load).alias("owned"), loose.alias("loose")).select(F.explode(folded["moved"]).alias("m")).select("m.*")
    return marked.join(moved.withColumnRenamed("shard", "to_shard"), "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to_shard", "shard").alias("shard")
    )


def store_map(versions: list[DataFrame], path: str) -> None:
    """Append versions to the map's table, a folder each; older versions stay readable."""
    for v in versions:
        v.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map; the newest by default."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def place(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Shard of each record and its gapless place in it: its rank in the virtual slot after the slots before it."""
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = slot_bytes(records).join(owners.select("virtual_slot", "shard"), "virtual_slot")
    offsets = sums.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("rows_before"))
    ranked = records.withColumn("_rank", F.row_number().over(in_slot) - 1)
    return ranked.join(offsets, "virtual_slot").withColumn("slot", (F.col("rows_before") + F.col("_rank")).cast("long")).drop("_rank", "rows_before")


def op5(spark, sf_dir: str) -> DataFrame:
    records = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = new_path(spark, "slot-map")
    first = first_map(spark)
    store_map([first], path)
    store_map([rebalance(read_map(spark, path, 1), slot_bytes(records))], path)
    placed = place(records, read_map(spark, path))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )

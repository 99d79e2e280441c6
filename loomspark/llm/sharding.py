"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. Bytes and rows are summed up per slot (map-side first), and a
versioned table maps slots to shards. Version 0 deals the slots out in turn, whatever they hold; later versions edit
the one before: a rebalancing moves single slots from heavy to light shards, a new shard takes slots only into
itself. A slot that outgrows the mean (records of one key can't be told apart by a hash) is dealt out over further
slots by row. The slot table has a bounded size, whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS, SHARDS = 16_384, 40
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16
#: A slot of so many times the mean's rows, and of so many rows at least, is dealt out over more slots.
GROWN, LEAST_GROWN = 8, 1000

Sizes = dict[int, int]


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each row. Null texts have no bytes; null ids hash like any value."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame) -> tuple[Sizes, Sizes]:
    """(bytes, rows) by slot; as many entries as there are slots at most."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: r.bytes for r in found}, {r.vslot: r.n for r in found}


def split_slots(rows: DataFrame, counts: Sizes, slots: int = SLOTS) -> DataFrame:
    """rows of a stored table with the rows of slots that outgrow the mean (GROWN times, and LEAST_GROWN rows) dealt out
    over slots numbered from `slots` on, together at most slots / GROWN * 2 of them."""
    mean = max(sum(counts.values()) / slots, LEAST_GROWN / GROWN)
    grown, at = [], slots
    for slot in sorted(counts):
        if counts[slot] > GROWN * mean:
            pieces = math.ceil(counts[slot] / (GROWN * mean)) * 2
            grown.append((slot, at, pieces))
            at += pieces
    if not grown:
        return rows
    table = F.broadcast(rows.sparkSession.createDataFrame(grown, "vslot int, first int, pieces int"))
    nth = F.pmod(F.monotonically_increasing_id(), F.col("pieces")).cast("int")
    return rows.join(table, "vslot", "left").withColumn("vslot", F.coalesce(F.col("first") + nth, "vslot")).drop("first", "pieces")


def first_map(slots, shards: int = SHARDS) -> dict[int, int]:
    """slot -> shard, dealt out in turn."""
    return {slot: i % shards for i, slot in enumerate(sorted(slots))}


def rebalanced(placed: dict[int, int], sizes: Sizes, shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """An edited map: single slots move from the heaviest shard to the lightest until all are within the tolerance.

    With more shards than the map has, slots move into the new shards only.
    """
    out, load, held = dict(placed), dict.fromkeys(range(shards), 0), {s: {} for s in range(shards)}
    for slot, shard in placed.items():
        load[shard] += sizes.get(slot, 0)
        held[shard][slot] = sizes.get(slot, 0)
    mean = sum(load.values()) / shards
    new = set(range(shards)).difference(placed.values())
    while True:
        heavy, light = max(load, key=load.get), min(new or load, key=load.get)
        gap = load[heavy] - load[light]
        if load[light] >= mean * (1 - tolerance) and (new or load[heavy] <= mean * (1 + tolerance)):
            return out
        fits = [(abs(gap / 2 - size), slot) for slot, size in held[heavy].items() if 0 < size < gap]
        if not fits:
            return out
        slot = min(fits)[1]  # each move lessens the sum of squared loads, so moves come to an end
        size = held[heavy].pop(slot)
        held[light][slot] = size
        out[slot] = light
        load[heavy] -= size
        load[light] += size


def save_map(spark: SparkSession, folder: str, version: int, placed: dict[int, int]) -> DataFrame:
    """Stores a version of the map under folder (partition `version`) and returns it; versions are never overwritten."""
    table = spark.createDataFrame(sorted(placed.items()), "vslot int, shard int").coalesce(1)
    table.write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={version}")


def place(rows: DataFrame, placed: DataFrame, counts: Sizes) -> DataFrame:
    """rows of with_slot with shard and slot, the record's place in its shard, without gaps from 0.

    Records of a shard stand in order of virtual slot, then doc_id (nulls first), text_crc32 and size. The map and
    the first place of each slot are small tables of fixed size; rows are ranked slot by slot.
    """
    spark = rows.sparkSession
    table = {r.vslot: r.shard for r in placed.collect()}
    first, filled = [], {}
    for slot in sorted(table):
        shard = table[slot]
        first.append((slot, shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + counts.get(slot, 0)
    starts = F.broadcast(spark.createDataFrame(first, "vslot int, shard int, first bigint"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")))
    return ranked.join(starts, "vslot").withColumn("slot", F.col("first") + F.col("nth") - 1).drop("nth", "first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, vslot, shard, slot.

    Shards get nearly equal bytes. Under `folder` the slot map is stored twice: version 0, dealt out without regard to
    sizes, and version 1, edited so that shards are even, which is used. Repeated rows, null ids and null texts are
    records like others; other columns are not read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, folder or common.fresh(docs.sparkSession, "slot-map")
    rows = common.saved(with_slot(docs, slots), "slotted")
    sizes, counts = slot_sizes(rows)
    split = split_slots(rows, counts, slots)
    if split is not rows:
        rows = common.saved(split, "split-slots")
        sizes, counts = slot_sizes(rows)
    first = first_map(sorted({*range(slots), *counts}), shards)
    save_map(spark, folder, 0, first)
    return place(rows, save_map(spark, folder, 1, rebalanced(first, sizes, shards)), counts)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(common.read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

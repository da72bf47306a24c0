"""Sharding by fixed virtual slots, in DataFrame operations only.

A record's virtual slot is a hash of its identifier, one of ``SLOTS``; it never changes. Bytes are summed per slot,
and a table maps slots to shards. Only that table, of ``SLOTS`` rows whatever the corpus, changes when shards are
rebalanced or added; it is stored in versions. The law is ``bytes``: slots go to shards largest first, each to the
shard that is lightest so far, so shards differ by less than the bytes of a slot.

Defined cases: a null text has no bytes (8 remain for the identifier); records with a null doc_id are slotted by
their text; repeated rows are separate records; an empty table gives an empty result; a record heavier than a
shard's even share leaves its shard heavier than the others. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import new_path

SLOTS = 4096
SHARDS = 24
#: Parts of a slot that are numbered apart.
SALTS = 16


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    crc = F.crc32(raw)
    size = (F.octet_length(raw) + F.lit(8)).cast("long")
    place = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64(raw)).otherwise(F.lit(0)), F.lit(slots))
    return docs.select("doc_id", size.alias("size"), crc.cast("long").alias("text_crc32"), place.cast("int").alias("virtual_slot"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, slot_bytes, slot_rows: at most SLOTS rows, summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def balanced_map(loads: DataFrame, shards: int) -> DataFrame:
    """virtual_slot, slot_bytes, slot_rows, shard: each slot, heaviest first, to the lightest shard so far."""
    slots = F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot", "slot_rows")))
    empty = F.expr(f"transform(sequence(0, {shards - 1}), i -> named_struct('load', 0L, 'shard', i))")
    place = """
        aggregate(slots, named_struct('loads', empty, 'placed', cast(array() as array<int>)),
            (a, s) -> named_struct(
                'loads', transform(a.loads, l -> IF(l.shard = array_min(a.loads).shard, named_struct('load', l.load - s.less, 'shard', l.shard), l)),
                'placed', array_append(a.placed, array_min(a.loads).shard)),
            a -> a.placed)"""
    placed = loads.agg(slots.alias("slots")).withColumn("empty", empty).withColumn("placed", F.expr(place))
    one = placed.select(F.explode(F.arrays_zip("slots", "placed")).alias("x"))
    return one.select("x.slots.virtual_slot", (-F.col("x.slots.less")).alias("slot_bytes"), "x.slots.slot_rows", F.col("x.placed").alias("shard"))


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map edited for one more shard: every shard gives slots to the new one, and no other slot moves."""
    fair = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    total = Window.partitionBy("shard")
    edited = slot_map.withColumn("_before", F.sum("slot_bytes").over(fair) - F.col("slot_bytes")).withColumn("_give", F.sum("slot_bytes").over(total) / (shards + 1))
    move = F.col("_before") + F.col("slot_bytes") / 2 < F.col("_give")
    return edited.withColumn("shard", F.when(move, F.lit(shards)).otherwise(F.col("shard"))).drop("_before", "_give")


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of a slot map and read it back. A version is written once and never changed."""
    at = f"{path}/version={version}"
    slot_map.coalesce(1).write.mode("errorifexists").parquet(at)
    return slot_map.sparkSession.read.schema(slot_map.schema).parquet(at)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame, salts: int = SALTS) -> DataFrame:
    """records with their shard and a gapless position in it.

    Positions come in three steps, so no task sorts a whole shard or slot: a slot's first position is a sum over the map,
    a salt's first position in its slot is a sum over counts by (slot, salt), and rows are numbered inside those.
    """
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(salts)).cast("int"))
    shards = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(shards), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("virtual_slot").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("virtual_slot", "_salt").agg(F.count("*").alias("_n")).withColumn("_in", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    # SLOTS rows, and SLOTS * salts rows, of a few numbers: Spark's size check decides how they are joined.
    starts = counts.join(starts, "virtual_slot").select("virtual_slot", "_salt", "shard", (F.col("_start") + F.col("_in")).alias("_start"))
    inside = Window.partitionBy("virtual_slot", "_salt").orderBy("doc_id", "text_crc32", "size")
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["virtual_slot", "_salt"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_start", "_row", "_salt")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot for every row of docs."""
    records = slotted(docs, slots)
    path = path or new_path(docs.sparkSession, "slot-map")
    slot_map = store_map(balanced_map(slot_bytes(records), shards), path, 1)
    out = place(records, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

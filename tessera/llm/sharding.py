"""Sharding by fixed virtual slots (native: DataFrame and SQL functions only).

Records hash into thousands of slots; bytes are summed per slot; a versioned
slot-to-shard map places the slots, and rebalancing edits the map, never the hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stage

#: Virtual slots: three hexadecimal digits of the key's digest.
SLOTS = 4096


def slot_of(key: Column) -> Column:
    """Virtual slot of a record key, 0 to SLOTS - 1; a null key is the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) over records(vslot, size); at most SLOTS rows."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt in turn."""
    return loads.select(F.lit(1).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"), "bytes", "rows")


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version: each shard keeps its largest slots up to the mean load; the
    slots above it move, largest first, each to the shard with the least bytes then.
    Slots number SLOTS at most, so this plan over one array has a fixed size.
    """
    mean = F.sum("bytes").over(Window.partitionBy("version")) / F.lit(shards)
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = slot_map.select("*", mean.alias("mean"), held.alias("held")).select("*", (F.col("held") > F.col("mean")).alias("moves"))
    one = marked.agg(
        F.array(*[F.coalesce(F.sum(F.when((F.col("shard") == s) & ~F.col("moves"), F.col("bytes"))), F.lit(0)) for s in range(shards)]).alias("loads"),
        F.array_sort(F.collect_list(F.when(F.col("moves"), F.struct((-F.col("bytes")).alias("minus"), F.col("vslot"))))).alias("moving"),
    )
    placed = one.select(
        F.expr(
            """aggregate(moving,
                 named_struct('loads', loads, 'out', cast(array() as array<struct<vslot: int, to: int>>)),
                 (s, x) -> named_struct(
                   'loads', transform(s.loads, (v, i) -> if(i + 1 = array_position(s.loads, array_min(s.loads)), v - x.minus, v)),
                   'out', array_append(s.out, named_struct('vslot', x.vslot, 'to', cast(array_position(s.loads, array_min(s.loads)) - 1 as int)))),
                 s -> s.out)"""
        ).alias("out")
    ).select(F.inline("out"))
    return marked.join(F.broadcast(placed), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows")


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with shard number ``shards`` added: every old shard gives up
    slots, in digest order, worth at most its share; no slot moves between old shards."""
    w = Window.partitionBy("shard").orderBy(F.md5(F.col("vslot").cast("string")), "vslot")
    gives = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) * (shards + 1) <= F.sum("bytes").over(Window.partitionBy("shard"))
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(gives, F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def latest(slot_map: DataFrame) -> DataFrame:
    """The newest version of a stored map."""
    last = slot_map.agg(F.max("version").alias("last"))
    return slot_map.join(F.broadcast(last), F.col("version") == F.col("last")).drop("last")


def stored_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the map kept at ``path``."""
    return spark.read.parquet(path)


def edit_map(loads: DataFrame, shards: int, path: str) -> DataFrame:
    """Append the next version to the map at ``path``, for today's loads(vslot, bytes, rows),
    and return all versions. The first call writes the slots dealt in turn as version 1 and
    their rebalancing as version 2; later calls rebalance the newest one, in which slots
    without a place yet are dealt in turn. Old versions are never changed."""
    spark = loads.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        old = latest(stored_map(spark, path)).select("vslot", F.col("shard").alias("held"), "version")
        number = old.agg(F.max("version")).first()[0]
        now = loads.join(old.select("vslot", "held"), "vslot", "left")
        now = now.select(F.lit(number).alias("version"), "vslot", F.coalesce("held", (F.col("vslot") % shards).cast("int")).alias("shard"), "bytes", "rows")
    else:
        now = first_map(loads, shards)
        now.coalesce(1).write.parquet(path)
    stage(rebalanced(now, shards), "slot-map").coalesce(1).write.mode("append").parquet(path)
    return stored_map(spark, path)


#: Parts in which the rows of one slot are numbered.
PARTS = 32


def shard_records(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Place every row: (placed rows, versioned map).

    Placed rows: doc_id, size (UTF-8 bytes + 1; a null text counts as none),
    text_crc32 (of the null text: 0), vslot, shard, slot (the row's place in its shard,
    gapless from 0). Law ``bytes``: shard sizes come near equal, up to one slot's
    share or one row larger than the mean shard. A null key is the empty string;
    repeated rows are placed each on its own; an empty table gives no rows. Numbering
    runs per virtual slot and part, with an offset for each, so no task sees a whole
    shard, nor all rows of one key. The map is kept at ``path``, where later calls find and
    edit it; without one, beside the staged tables.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int")
    rows = stage(rows.withColumn("vslot", slot_of(F.col("doc_id"))).withColumn("part", part), "shard-rows")
    versions = edit_map(slot_bytes(rows), shards, path or f"{scratch_dir(docs.sparkSession)}/tessera/slot-map-{uuid.uuid4().hex}")
    now = latest(versions).select("vslot", "shard")
    parts = rows.groupBy("vslot", "part").agg(F.count("*").alias("rows")).join(F.broadcast(now), "vslot")  # SLOTS * PARTS rows at most
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("vslot", "part", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    n = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.join(F.broadcast(offsets), ["vslot", "part"]).select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("offset") + n - 1).alias("slot"))
    return placed, versions

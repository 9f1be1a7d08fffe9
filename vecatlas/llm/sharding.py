"""Sharding by sampled splitters, with DataFrame functions only.

The sort key of a record is the hash of its text, so equal texts stand together. A size-weighted
sample of keys gives quantile boundaries; records are ranged by them; the exact bytes of each range
are added up; ranges over twice their share (a hot text, for which boundaries fall together) are
subdivided by a hash of id and row. A running sum of bytes within each range, on top of the bytes before it,
tells where a record stands in the whole order and so its shard. Only the sample and the totals
of the ranges, both of bounded number, reach the driver.

Law ``bytes``: shard sizes differ by about one record. A group of equal texts stays together where
that moves a boundary by no more than ``together`` of a shard's share; a larger group may be divided.

Null texts have no bytes; null ids are ordinary; repeated rows are records of their own; an empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.common import stash

BUCKET_BITS = 10


def _splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> list[int]:
    """Quantile boundaries of a sample in which a record counts by its size."""
    step = max(1.0, total / (ranges * per_range))
    chance = F.pmod(F.xxhash64("d", "m", F.lit(17)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sample = rows.select("k", F.floor(F.col("size") / F.lit(step) + chance).alias("n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect()
    keys, before, cut = [], 0, per_range
    for k, n in sorted((r["k"], r["n"]) for r in sample):
        if before + n > cut:
            keys.append(k)
            if n >= 2 * per_range:  # a hot key gets a range of its own
                keys.append(min(k + 1, (1 << 63) - 1))
            cut = per_range * ((before + n) // per_range + 1)
        before += n
    return sorted(set(keys))


def _ranged(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """The number of boundaries at or below each key: those below its bucket, and those of the bucket that it reaches."""
    shift, half = 64 - BUCKET_BITS, 1 << (BUCKET_BITS - 1)
    table = []
    for b in range(-half, half):
        lo, hi = bisect.bisect_left(splitters, b << shift), bisect.bisect_left(splitters, (b + 1) << shift)
        table.append((b, lo, splitters[lo:hi]))
    small = rows.sparkSession.createDataFrame(table, "b long, base long, inside array<long>")
    return rows.withColumn("b", F.shiftright("k", shift)).join(F.broadcast(small), "b").withColumn("range", F.col("base") + F.size(F.filter("inside", lambda s: s <= F.col("k")))).drop("b", "base", "inside")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", *, ranges_per_shard: int = 16, per_range: int = 12, together: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every record; slot counts from 0 in each shard without gaps."""
    spark = docs.sparkSession
    has = F.col("has")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).isNotNull().alias("has"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text", has).alias("k"), F.xxhash64("doc_id").alias("d"), F.monotonically_increasing_id().alias("m"))
    rows = stash(rows, "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(1, total // shards)
    limit = max(1, 2 * share // ranges_per_shard)
    rows = _ranged(rows, _splitters(rows, total, shards * ranges_per_shard, per_range))
    full = {r["range"]: -(-r["bytes"] // limit) for r in rows.groupBy("range").agg(F.sum("size").alias("bytes")).collect() if r["bytes"] > limit}
    parts = spark.createDataFrame(sorted(full.items()), "range long, parts long")
    rows = rows.join(F.broadcast(parts), "range", "left").withColumn("sub", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("d", "m"), "parts"))).drop("parts")
    starts, at, first = [], 0, 0
    for r in sorted(rows.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()):
        starts.append((r["range"], r["sub"], at, first))
        at, first = at + r["bytes"], first + r["n"]
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, "range long, sub long, at long, first long")), ["range", "sub"])
    order, group = Window.partitionBy("range", "sub").orderBy("k", "d", "m"), Window.partitionBy("range", "sub", "k")
    rows = rows.withColumn("end", F.col("at") + F.sum("size").over(order)).withColumn("place", F.col("first") + F.row_number().over(order) - 1)
    rows = rows.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_end", F.max("end").over(group))
    twice = F.when(F.col("group_bytes") <= together * share, 2 * F.col("group_end") - F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size"))
    # twice the middle, times the shards, over twice the whole
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(twice.cast("decimal(38,0)") * shards / F.lit(max(1, 2 * total))).cast("int")))
    rows = stash(rows.select("doc_id", "size", "text_crc32", "shard", "place"), "shard-places")
    begins = rows.groupBy("shard").agg(F.min("place").alias("begin"))  # a row for each shard
    return rows.join(F.broadcast(begins), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The records themselves, a folder ``shard=...`` each; ids must be unique for this."""
    wanted = placed.select(F.col("doc_id").alias("__id"), "shard", "slot")
    docs.drop("shard", "slot").join(wanted, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id").write.partitionBy("shard").parquet(path)

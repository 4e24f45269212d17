"""Contiguous shards of nearly equal bytes, by prefix sums.

Rows are ordered by id. A range partitioning gives each part a contiguous stretch of ids; the
parts' totals, one row each, get a running sum, and inside each part a running sum starts from
there. A row belongs to the shard in whose equal share of all bytes its middle lies. The ordered
rows, numbers only, are written once to the shared folder, so that totals and rows come from the
same partitioning even if an executor is lost.

Null ids come first; rows of one id are ordered by checksum and size; equal rows in any order. A
null text has no bytes. With fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobloom.session import new_path

SHARDS = 40
ROW_BYTES = 16


def balanced_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(whole.cast("binary")).cast("bigint").alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    path = new_path(spark, "shards")
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # A row per part: their number is a setting, not the data's.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole_window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(whole_window).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum("size").over(inside).alias("upto"), F.count("*").over(inside).alias("nth"))
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    rows = rows.join(F.broadcast(totals), "part").select(
        *order,
        F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("all_bytes"))).cast("int").alias("shard"),
        (F.col("n_before") + F.col("nth") - 1).alias("place"),
    )
    # A row per shard.
    firsts = rows.groupBy("shard").agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

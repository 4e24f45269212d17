"""Structured Streaming jobs. Each has the column logic of its batch operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobloom.operators.calls import WINDOWS, alert_aggregates, call_aggregates, over_quota
from jobloom.operators.merge import folded
from jobloom.operators.ranking import first_per_key
from jobloom.operators.sketches import sketch_aggregates
from jobloom.session import new_path


def read_stream(
    spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None
) -> DataFrame:
    """Parquet files as they arrive, with the schema of a table."""
    reader = spark.readStream.schema(like.schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_dedup(postings: DataFrame, key: str = "id", delay: str = "7 days") -> DataFrame:
    """The first posting of each id; state is kept for the delay only."""
    return postings.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark([key])


def stream_dedup_both(
    postings: DataFrame, key: str = "id", delay: str = "7 days", title: str = "title", company: str = "company"
) -> DataFrame:
    """The first posting of each id, and of those the first of each title and company in any case.

    Each rule keeps its keys for the delay only; the second sees what the first lets through.
    """
    by_id = postings.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark([key])
    named = by_id.withColumns({"_title": folded(F.col(title)), "_company": folded(F.col(company))})
    return named.dropDuplicatesWithinWatermark(["_title", "_company"]).drop("_title", "_company")


def stream_daily_counts(postings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Postings per day."""
    window = F.window("scraped_at", "1 day")
    counts = postings.withWatermark("scraped_at", delay).groupBy(window).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "n")


def stream_hours(postings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Postings per hour: panes, each event counted in one."""
    window = F.window("scraped_at", "1 hour")
    counts = postings.withWatermark("scraped_at", delay).groupBy(window).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.end").alias("hour_end"), "n")


def recent_from_hours(panes: DataFrame, hours: int = 24) -> DataFrame:
    """(as_of, n): postings of the last hours at every full hour, added up from the panes."""
    later = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    spread = panes.select("hour_end", "n", later.alias("_later"))
    as_of = F.col("hour_end") + F.make_dt_interval(hours=F.col("_later"))
    return spread.groupBy(as_of.alias("as_of")).agg(F.sum("n").alias("n"))


def stream_call_stats(calls: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Call statistics per source and window."""
    grouped = calls.withWatermark("called_at", delay).groupBy(F.window("called_at", size), "provider")
    stats = grouped.agg(*call_aggregates())
    return stats.select(F.col("window.start").alias("window_start"), *[c for c in stats.columns if c != "window"])


def stream_latency(calls: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Calls, failures and a sketch of the latencies per source and window; the state of a hot source stays small."""
    grouped = calls.withWatermark("called_at", delay).groupBy("provider", F.window("called_at", size))
    told = grouped.agg(*sketch_aggregates())
    return told.select("provider", F.col("window.start").alias("window_start"), *told.columns[2:])


def stream_quota_breaches(
    calls: DataFrame, quotas: DataFrame, period: str, delay: str = "10 minutes"
) -> DataFrame:
    """Counts above quota for one period: minute, hour or day."""
    window = F.window("called_at", WINDOWS[period])
    counts = (
        calls.withWatermark("called_at", delay)
        .groupBy("provider", window)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("provider", F.lit(period).alias("period"), F.col("window.start").alias("window_start"), "n")
    )
    return over_quota(counts, quotas)


def stream_source_alerts(
    calls: DataFrame, size: str = "1 hour", delay: str = "10 minutes", **limits: float
) -> DataFrame:
    """Failure rate, 95th percentile of the latency and their flags per source and window."""
    grouped = calls.withWatermark("called_at", delay).groupBy("provider", F.window("called_at", size))
    alerts = grouped.agg(*alert_aggregates(**limits))
    return alerts.select("provider", F.col("window.start").alias("window_start"), *alerts.columns[2:])


def start_files(df: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object]) -> StreamingQuery:
    """Write a stream to Parquet files; both paths lie in a folder all executors share."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and give what it wrote."""
    spark = df.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    start_files(df, path, checkpoint, {"availableNow": True}).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_updates(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregate over all that is there now and give the last state of every window.

    Windows still open at the last event are in it. Each micro-batch writes what it has updated to a
    folder of its own, so a batch that is run again writes the same again.
    """
    spark = df.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    numbered = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    written = spark.read.schema(numbered).parquet(path)
    return first_per_key(written, [F.col(k) for k in keys], [F.desc("batch")]).drop("batch")

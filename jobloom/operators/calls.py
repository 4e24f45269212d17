"""Statistics over the log of source calls.

A call is (event_id, provider, called_at, ok, latency_ms, n_jobs).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import values as V


def call_aggregates() -> list[Column]:
    """Aggregates of call statistics, the same for batch and stream.

    Latencies are summed as whole nanoseconds, so the mean does not depend on the order.
    """
    exact = F.col("latency_ms").cast("decimal(20,6)")
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("ok")).alias("success_requests"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.sum(F.when(F.col("ok"), F.col("n_jobs")).otherwise(0)).alias("total_jobs"),
        F.avg(exact).cast("double").alias("average_latency_ms"),
        F.max("called_at").alias("last_used"),
    ]


def source_call_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(*call_aggregates())


def source_success_rate(calls: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Percentage of calls that went well; NULL for a listed provider without calls."""
    counts = calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok")).alias("good")
    )
    if providers is not None:
        counts = providers.select("provider").distinct().join(counts, "provider", "left")
    rate = F.try_divide(F.col("good") * 100.0, F.col("total"))
    return counts.select("provider", rate.alias("success_rate"))


def source_outcomes(calls: DataFrame) -> DataFrame:
    """Per source: good and failed collections, jobs, and its last error text.

    ``error`` is the text of a failed call, NULL for a good one.
    """
    return calls.groupBy(F.col("provider").alias("source")).agg(
        F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.sum(F.when(F.col("ok"), F.col("n_jobs")).otherwise(0)).alias("jobs"),
        F.max_by(
            F.col("error"),
            F.when(~F.col("ok"), F.struct(F.col("called_at"), F.col("event_id"))),
        ).alias("last_error"),
    )


def collection_verdict(outcomes: DataFrame) -> DataFrame:
    """One row: a collection failed if it brought no job and met an error."""
    return outcomes.agg(
        F.sum("jobs").alias("jobs"),
        F.sum("failed").alias("errors"),
        ((F.sum("jobs") == 0) & (F.sum("failed") > 0)).alias("all_failed"),
    )


WINDOWS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def quota_table(spark: SparkSession, quotas: Mapping[str, tuple[int, int, int]] = V.QUOTAS) -> DataFrame:
    """(provider, period, quota)."""
    rows = [
        (provider, period, limit)
        for provider, limits in quotas.items()
        for period, limit in zip(WINDOWS, limits, strict=True)
    ]
    return spark.createDataFrame(rows, "provider string, period string, quota bigint")


def calls_per_period(calls: DataFrame) -> DataFrame:
    """(provider, period, window_start, n), counted in one scan.

    Each call is spread to its minute, hour and day before one counted shuffle.
    """
    starts = F.array(
        *[
            F.struct(
                F.lit(period).alias("period"),
                F.date_trunc(period, "called_at").cast("timestamp_ntz").alias("window_start"),
            )
            for period in WINDOWS
        ]
    )
    return (
        calls.select("provider", F.inline(starts))
        .groupBy("provider", "period", "window_start")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def over_quota(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """Counts above the quota of their provider and period."""
    return counts.join(quotas, ["provider", "period"]).where(F.col("n") > F.col("quota"))


def quota_breaches(calls: DataFrame, quotas: DataFrame) -> DataFrame:
    return over_quota(calls_per_period(calls), quotas)


# A source is reported from this share of failed calls and this response time on.
MAX_FAILURE_RATE, MAX_LATENCY_MS = 0.2, 5000.0


def alert_aggregates(max_failure_rate: float = MAX_FAILURE_RATE, max_latency_ms: float = MAX_LATENCY_MS) -> list[Column]:
    """Share of failed calls, the 95th percentile of the latency, and whether either is too high."""
    rate = F.count_if(~F.col("ok")) / F.count(F.lit(1))
    slow = F.percentile("latency_ms", 0.95)
    return [
        F.count(F.lit(1)).alias("n"),
        rate.alias("failure_rate"),
        slow.alias("p95_latency_ms"),
        (rate > max_failure_rate).alias("failing"),
        (slow > max_latency_ms).alias("slow"),
    ]


def source_alerts(calls: DataFrame, size: str = "1 hour", **limits: float) -> DataFrame:
    """(provider, window_start, n, failure_rate, p95_latency_ms, failing, slow)."""
    grouped = calls.groupBy("provider", F.window("called_at", size)).agg(*alert_aggregates(**limits))
    return grouped.select("provider", F.col("window.start").alias("window_start"), *grouped.columns[2:])

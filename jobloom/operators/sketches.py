"""Counts and quantiles kept as sketches that can be merged: per day and source, per hour and provider.

A sketch table has a row per key with a bounded number of bytes, however hot the key is. Tables of
different days, stores or runs are merged by uniting the sketches of a key; a range of keys is
answered by uniting theirs. The answer is the same whichever way the rows were cut before.

Distinct counts are HyperLogLog sketches with ``2**lg`` registers: the standard error is about
``1.04 / sqrt(2**lg)``, 0.8 % at the default. Quantiles are KLL sketches: the value given for a share
of the rows has a rank within ``RANK_ERROR`` of that share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.calls import MAX_FAILURE_RATE, MAX_LATENCY_MS

LG = 14
KLL = 400
# Of KLL sketches of this size, with room to spare.
RANK_ERROR = 0.015
FACETS = ("company", "location")


def distinct_sketches(df: DataFrame, facets: Sequence[str] = FACETS, lg: int = LG) -> DataFrame:
    """(day, source, n, <facet>...): per day and source the rows, and a sketch of the values of each facet.

    Absent values are not counted.
    """
    sketches = [F.hll_sketch_agg(F.col(f), lg).alias(f) for f in facets]
    return df.groupBy(F.to_date("scraped_at").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"), *sketches)


def merge_distinct(*tables: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """One table of what several tables of sketches cover. Rows counted in two of them count twice in ``n``."""
    both = tables[0]
    for table in tables[1:]:
        both = both.unionByName(table)
    unions = [F.hll_union_agg(f, F.lit(True)).alias(f) for f in facets]
    return both.groupBy("day", "source").agg(F.sum("n").alias("n"), *unions)


def distinct_over(
    sketches: DataFrame, by: Sequence[str] = (), first_day: Column | None = None, last_day: Column | None = None,
    facets: Sequence[str] = FACETS,
) -> DataFrame:
    """(<by>..., n, <facet>...): rows and distinct values over a range of days, both ends included."""
    kept = sketches
    if first_day is not None:
        kept = kept.where(F.col("day") >= first_day)
    if last_day is not None:
        kept = kept.where(F.col("day") <= last_day)
    counts = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f, F.lit(True))), F.lit(0)).alias(f) for f in facets]
    return kept.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *counts)


def latency_sketch(k: int = KLL) -> Column:
    """The latencies of a group as a sketch of bounded size; the same in batch and stream."""
    return F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(k)).alias("latency")


def latency_sketches(calls: DataFrame, size: str = "1 hour", k: int = KLL) -> DataFrame:
    """(provider, window_start, n, failed, latency): per provider and window, with a sketch of the latencies."""
    grouped = calls.groupBy("provider", F.window("called_at", size)).agg(*sketch_aggregates(k))
    return grouped.select("provider", F.col("window.start").alias("window_start"), *grouped.columns[2:])


def sketch_aggregates(k: int = KLL) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), latency_sketch(k)]


def latency_over(
    sketches: DataFrame, by: Sequence[str] = ("provider",), shares: Sequence[float] = (0.5, 0.95, 0.99), k: int = KLL
) -> DataFrame:
    """(<by>..., n, failed, quantiles): the latency below which each share of the calls lies."""
    merged = F.kll_merge_agg_double("latency", F.lit(k))
    quantiles = F.array(*[F.kll_sketch_get_quantile_double(merged, F.lit(float(s))) for s in shares])
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), quantiles.alias("quantiles")
    )


def alerts_from_sketches(
    sketches: DataFrame, max_failure_rate: float = MAX_FAILURE_RATE, max_latency_ms: float = MAX_LATENCY_MS
) -> DataFrame:
    """The columns of ``source_alerts`` from kept sketches: the percentile is near, all else exact.

    Sketches of a provider and window from several runs are merged. A latency without value is not counted.
    """
    told = latency_over(sketches, ["provider", "window_start"], [0.95])
    rate, slow = F.col("failed") / F.col("n"), F.col("quantiles")[0]
    return told.select(
        "provider", "window_start", "n", rate.alias("failure_rate"), slow.alias("p95_latency_ms"),
        (rate > max_failure_rate).alias("failing"), (slow > max_latency_ms).alias("slow"),
    )

"""Streams, run over all the given data at once, and the alerts on sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import calls_from, on_calls, on_postings, postings_from, query, table
from jobloom.catalog.reports import SMALL_QUOTAS, quotas_sql
from jobloom.operators.calls import WINDOWS, quota_table, source_alerts
from jobloom.streaming import streams as X


def _postings(spark, sf):
    like = table(spark, sf, "documents")
    arriving = postings_from(X.read_stream(spark, f"{sf}/documents*.parquet", like))
    return arriving.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))


def _calls(spark, sf):
    like = table(spark, sf, "events")
    arriving = calls_from(X.read_stream(spark, f"{sf}/events*.parquet", like))
    return arriving.withColumn("called_at", F.col("called_at").cast("timestamp"))


def _plain(df, *stamps: str):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query("stream_dedup", on_postings("SELECT id, scraped_at FROM postings"))
def dedup(spark, sf):
    """Every posting arrives twice."""
    once, again = (_postings(spark, sf).select("id", "scraped_at") for _ in range(2))
    found = X.run_available(X.stream_dedup(once.unionByName(again)), "dedup")
    return _plain(found, "scraped_at")


@query(
    "stream_dedup_both",
    on_postings("SELECT DISTINCT lower(title) AS title, lower(company) AS company FROM postings"),
)
def dedup_both(spark, sf):
    """Every posting arrives twice, and its title and company under many ids."""
    once, again = (_postings(spark, sf).select("id", "title", "company", "scraped_at") for _ in range(2))
    found = X.run_available(X.stream_dedup_both(once.unionByName(again)), "dedup-both")
    return found.select(F.lower("title").alias("title"), F.lower("company").alias("company"))


@query(
    "stream_daily_counts",
    on_postings(
        """SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (
             SELECT date_trunc('day', scraped_at) AS day, count(*) AS n FROM postings GROUP BY 1)"""
    ),
)
def daily(spark, sf):
    found = X.run_updates(X.stream_daily_counts(_postings(spark, sf)), "daily", ["day"])
    return found.withColumn("day", F.col("day").cast("string"))


@query(
    "stream_recent_24h",
    on_postings(
        """SELECT as_of, count(*) AS n FROM (
             SELECT date_trunc('hour', scraped_at) + to_hours(CAST(unnest(range(1, 25)) AS INTEGER)) AS as_of
             FROM postings)
           GROUP BY as_of"""
    ),
)
def recent(spark, sf):
    """Each posting is counted in one hour; the hours are added up."""
    panes = X.run_updates(X.stream_hours(_postings(spark, sf)), "hours", ["hour_end"])
    return _plain(X.recent_from_hours(panes), "as_of")


@query(
    "stream_call_stats",
    on_calls(
        """SELECT window_start, provider, total_requests, success_requests, failed_requests, total_jobs,
             average_latency_ms, last_used FROM (
             SELECT date_trunc('hour', called_at) AS window_start, provider, count(*) AS total_requests,
               count_if(ok)::BIGINT AS success_requests, count_if(NOT ok)::BIGINT AS failed_requests,
               CAST(sum(CASE WHEN ok THEN n_jobs ELSE 0 END) AS BIGINT) AS total_jobs,
               round(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS average_latency_ms, max(called_at) AS last_used
             FROM calls GROUP BY ALL)"""
    ),
)
def call_stats(spark, sf):
    found = X.run_updates(X.stream_call_stats(_calls(spark, sf)), "call-stats", ["window_start", "provider"])
    found = found.withColumn("average_latency_ms", F.round("average_latency_ms", 6))
    return _plain(found, "window_start", "last_used")


@query(
    "stream_quota_breaches",
    on_calls(
        """SELECT provider, period, window_start, n, CAST(quota AS BIGINT) AS quota FROM (
             SELECT provider, 'minute' AS period, date_trunc('minute', called_at) AS window_start,
               INTERVAL 1 MINUTE AS size, count(*) AS n FROM calls GROUP BY ALL
             UNION ALL SELECT provider, 'hour', date_trunc('hour', called_at), INTERVAL 1 HOUR, count(*)
               FROM calls GROUP BY ALL
             UNION ALL SELECT provider, 'day', CAST(date_trunc('day', called_at) AS TIMESTAMP), INTERVAL 1 DAY,
               count(*) FROM calls GROUP BY ALL) JOIN quotas USING (provider, period)
           WHERE n > quota""",
        quotas_sql(),
    ),
)
def breaches(spark, sf):
    quotas = quota_table(spark, SMALL_QUOTAS)
    parts = [
        X.run_updates(
            X.stream_quota_breaches(_calls(spark, sf), quotas, period), f"quota-{period}", ["provider", "window_start"]
        )
        for period in WINDOWS
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _plain(found, "window_start")


ALERTS_SQL = """SELECT provider, window_start, n, round(bad / n, 9) AS failure_rate, round(p95, 6) AS p95_latency_ms,
    bad / n > 0.25 AS failing, p95 > 90 AS slow FROM (
      SELECT provider, date_trunc('hour', called_at) AS window_start, count(*) AS n, count_if(NOT ok) AS bad,
        quantile_cont(latency_ms, 0.95) AS p95 FROM calls GROUP BY ALL)"""


def _alerts(found):
    rounded = found.withColumn("failure_rate", F.round("failure_rate", 9)).withColumn(
        "p95_latency_ms", F.round("p95_latency_ms", 6)
    )
    return _plain(rounded, "window_start")


LIMITS = {"max_failure_rate": 0.25, "max_latency_ms": 90.0}


@query("source_alerts", on_calls(ALERTS_SQL))
def alerts(spark, sf):
    calls = calls_from(table(spark, sf, "events"))
    calls = calls.withColumn("called_at", F.col("called_at").cast("timestamp"))
    return _alerts(source_alerts(calls, **LIMITS))


@query("stream_source_alerts", on_calls(ALERTS_SQL))
def alerts_stream(spark, sf):
    found = X.stream_source_alerts(_calls(spark, sf), **LIMITS)
    return _alerts(X.run_updates(found, "alerts", ["provider", "window_start"]))

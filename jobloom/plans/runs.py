"""The runs: ingest into a store, export from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.relevance import relevance_ratio
from jobloom.operators.merge import union_sources
from jobloom.operators.querytext import process_query
from jobloom.sources import store
from jobloom.sources.files import write_postings_csv, write_postings_json, write_stats_csv
from jobloom.sources.providers import provider


def collect_sources(
    payloads: Mapping[str, DataFrame], others: Sequence[DataFrame] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Postings of all providers (name -> raw payloads), then of feeds and pages."""
    mapped = [provider(name)(raw, keep=keep) for name, raw in payloads.items()]
    return union_sources(*mapped, *others)


def score_with_query(postings: DataFrame, query: DataFrame, text: str = "text") -> DataFrame:
    """Replace the relevance by the ratio over the expanded terms of one query (a one-row table).

    The terms of the one query are read first, so that scoring the postings is generated code. A
    run has one query: none or several are an error.
    """
    found = process_query(query, text).select("keywords").take(2)
    if len(found) != 1:
        raise ValueError("an ingest run takes exactly one query")
    terms = found[0][0]
    return postings.withColumn(
        "relevance", relevance_ratio(F.col("title"), F.col("description"), terms)
    )


def ingest_run(
    spark: SparkSession,
    query: DataFrame,
    payloads: Mapping[str, DataFrame],
    store_path: str,
    others: Sequence[DataFrame] = (),
    buckets: int = store.BUCKETS,
) -> int:
    """Map, unite, score and merge into the store; the version this made.

    Only the buckets that the found postings fall into are rewritten.
    """
    found = score_with_query(collect_sources(payloads, others), query)
    return store.upsert(spark, store_path, found, buckets)


def export_run(
    spark: SparkSession, store_path: str, out_path: str, formats: Sequence[str], as_of: Column
) -> list[str]:
    """Write the last version of the store in each format; no rows or an unknown format is an error."""
    writers = {"csv": write_postings_csv, "json": write_postings_json}
    wanted = [f.lower() for f in formats]
    unknown = [f for f in wanted if f not in writers]
    if unknown:
        raise ValueError(f"unsupported export format: {unknown[0]}")
    postings = store.read_version(spark, store_path)
    if postings.isEmpty():
        raise ValueError("no jobs found to export")
    paths = []
    for name in wanted:
        path = f"{out_path}/postings_{name}"
        writers[name](postings, path)
        paths.append(path)
        if name == "csv":
            write_stats_csv(postings, as_of, f"{out_path}/stats_csv")
            paths.append(f"{out_path}/stats_csv")
    return paths

"""The searches: stored, by criteria, and hybrid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.advice import result_advice, strategy_advice
from jobloom.operators.filters import SearchSpec, filter_spec, match_criteria
from jobloom.operators.merge import combine_dedup, fallback_union
from jobloom.operators.ranking import (
    page,
    rank_combined,
    relevance_order,
    score_weighted,
    search_order,
    search_rank,
)
from jobloom.operators.stats import insights_agent, insights_hybrid, insights_search
from jobloom.session import shared_folder


@dataclass
class SearchResult:
    """Lazy tables of one search."""

    rows: DataFrame
    insights: DataFrame
    advice: DataFrame | None = None
    counts: DataFrame | None = None


def comma_keywords(keywords: str | Sequence[str]) -> list[str]:
    if not isinstance(keywords, str):
        return list(keywords)
    return [k.strip() for k in keywords.split(",")]


def search_stored(postings: DataFrame, spec: SearchSpec, key: str = "id") -> SearchResult:
    """Filter, newest first, one page; insights over the page."""
    rows = page(filter_spec(postings, spec), search_order(key), spec.limit, spec.offset)
    return SearchResult(rows, insights_search(rows))


def search_agent(
    postings: DataFrame,
    keywords: str | Sequence[str],
    experience_level: str | None = None,
    remote_preference: bool = False,
    key: str = "id",
) -> SearchResult:
    """Keep what fits the criteria and rank all of it."""
    words = [k.lower() for k in comma_keywords(keywords)]
    if not any(words):
        raise ValueError("keywords are required")
    kept = match_criteria(postings, experience_level, remote_preference)
    # insights and advice need no rank, so they do not pay for one
    advice = result_advice(score_weighted(kept, words), relevance_order(key), experience_level)
    return SearchResult(search_rank(kept, words, key), insights_agent(kept), advice)


def search_hybrid(
    stored: DataFrame,
    live: DataFrame,
    spec: SearchSpec,
    as_of: Column,
    threshold: int = 10,
    include_live: bool = True,
    key: str = "id",
) -> SearchResult:
    """Stored hits, live rows if the hits are few, one row per posting, best score first.

    The stored hits, one page at most, are found once, when this is called: rows, counts and the test for
    the fallback all read what was found.
    """
    shared_folder(stored.sparkSession)
    hits = search_stored(stored, spec, key).rows.checkpoint()
    asked = fallback_union(hits, live, threshold, include_live)
    merged = combine_dedup(hits, asked, spec.keywords, as_of, search_order(key))
    rows = rank_combined(merged, spec.limit, key)
    counts = rows.agg(F.count(F.lit(1)).alias("total_found")).select(
        "total_found",
        hits.agg(F.count(F.lit(1))).scalar().alias("database_count"),
        asked.agg(F.count(F.lit(1))).scalar().alias("scraping_count"),
    )
    triggered = F.lit(include_live) & (F.col("database_count") < threshold)
    counts = counts.withColumn("scraping_triggered", triggered)
    advice = counts.select(
        strategy_advice(
            F.col("database_count"), F.col("scraping_count"), F.col("scraping_triggered")
        ).alias("advice")
    )
    return SearchResult(rows, insights_hybrid(rows), advice, counts)

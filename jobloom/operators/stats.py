"""Counts and insights over postings, as long tables.

Counts per source, company, location or keyword all come from one scan: each row
is spread to (metric, key) pairs, which are counted with map-side combine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.text import filled, split_keywords, terms_in, title_and_description
from jobloom.operators.filters import recent_condition
from jobloom.operators.ranking import top_k, top_per_group

UNKNOWN = "Unknown"


def _named_pairs(name: str, values: Column) -> Column:
    some = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(some, lambda v: F.struct(F.lit(name).alias("metric"), v.alias("key")))


def facet_counts(
    df: DataFrame,
    facets: Mapping[str, Column] | None = None,
    lists: Mapping[str, Column] | None = None,
    **more: Column,
) -> DataFrame:
    """(metric, key, n): how often each value of each facet occurs; NULL is not counted.

    ``facets`` hold one value per row, ``lists`` an array. ``more`` are further
    aggregates per (metric, key).
    """
    singles = [
        F.struct(F.lit(name).alias("metric"), value.cast("string").alias("key"))
        for name, value in (facets or {}).items()
    ]
    arrays = [F.array(*singles)] if singles else []
    arrays += [_named_pairs(name, values) for name, values in (lists or {}).items()]
    pairs = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    kept = [c for c in df.columns if c in {"scraped_at", "relevance"}]
    return (
        df.select(*kept, F.inline(pairs))
        .where(F.col("key").isNotNull())
        .groupBy("metric", "key")
        .agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()])
    )


def cut_metrics(counts: DataFrame, limits: Mapping[str, int | None]) -> DataFrame:
    """Keep the top counts of each metric that has a limit, and all counts of the others.

    One window over one set of counts: filtering it metric by metric would let the
    filters sink below the count and read the input once per metric. A metric without
    limit gets a group per key, where every row is the first.
    """
    most = max([k for k in limits.values() if k is not None], default=1)
    unlimited = [m for m, k in limits.items() if k is None]
    group = F.when(F.col("metric").isin(unlimited), F.col("key"))
    own_limit = F.lit(most)
    for metric, k in limits.items():
        if k is not None and k < most:
            own_limit = F.when(F.col("metric") == metric, k).otherwise(own_limit)
    cut = top_per_group(
        counts.withColumn("_group", group), ["metric", "_group"], [F.desc("n"), F.asc("key")], most, "_rank"
    )
    return cut.where(F.col("_rank") <= own_limit).drop("_group", "_rank")


def posting_stats(df: DataFrame, as_of: Column) -> DataFrame:
    """(metric, key, value): totals, recent postings, last time, counts per facet."""
    fresh = recent_condition(F.col("scraped_at"), as_of)
    counts = facet_counts(
        df,
        {
            "total_jobs": F.lit(""),
            "recent_jobs": F.when(fresh, F.lit("")),
            "jobs_by_source": F.col("source"),
            "jobs_by_location": F.col("location"),
        },
        {"keywords": F.col("keywords")},
        last=F.max("scraped_at"),
    )
    number = F.struct("metric", "key", F.col("n").cast("string").alias("value"))
    last = F.struct(
        F.lit("last_scraped").alias("metric"),
        F.col("key"),
        F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("value"),
    )
    return counts.select(
        F.inline(F.array_compact(F.array(number, F.when(F.col("metric") == "total_jobs", last))))
    )


def stats_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_jobs"))


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def stats_by_source(df: DataFrame) -> DataFrame:
    return count_by(df, "source").orderBy(F.desc("n"), F.asc("source"))


def stats_top_locations(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(count_by(df.where(F.col("location").isNotNull()), "location"), k, key="location")


def stats_daily(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Postings per day over the last days, newest first."""
    fresh = df.where(F.col("scraped_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    return (
        fresh.groupBy(F.to_date("scraped_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("day"))
    )


def _or_unknown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def insights_search(df: DataFrame, k: int = 5) -> DataFrame:
    """(metric, key, n): total, top companies, top locations that are filled, all sources."""
    counts = facet_counts(
        df,
        {
            "total_results": F.lit(""),
            "top_companies": _or_unknown("company"),
            "top_locations": F.when(filled(F.col("location")), F.col("location")),
            "sources": _or_unknown("source"),
        },
    )
    return cut_metrics(
        counts, {"total_results": None, "sources": None, "top_companies": k, "top_locations": k}
    )


def insights_hybrid(df: DataFrame, k: int = 5, high: float = 5.0) -> DataFrame:
    """(metric, key, value): origin counts, top companies and locations, score figures."""
    score = F.coalesce(F.col("relevance"), F.lit(0.0))
    # the score figures are those of the row that counts everything
    counts = facet_counts(
        df.withColumn("relevance", score),
        {
            "total_results": F.lit(""),
            "source_distribution": F.coalesce(F.col("source_type"), F.lit("unknown")),
            "top_companies": _or_unknown("company"),
            "top_locations": F.when(filled(F.col("location")), F.col("location")),
        },
        average_score=F.avg("relevance"),
        max_score=F.max("relevance"),
        highly_relevant_jobs=F.count_if(F.col("relevance") >= high).cast("double"),
    )
    cut = cut_metrics(
        counts,
        {"total_results": None, "source_distribution": None, "top_companies": k, "top_locations": k},
    )

    def row(metric: Column, value: str) -> Column:
        return F.struct(metric.alias("metric"), "key", F.col(value).cast("double").alias("value"))

    figures = ["average_score", "max_score", "highly_relevant_jobs"]
    one = F.array(row(F.col("metric"), "n"))
    with_figures = F.concat(one, F.array(*[row(F.lit(name), name) for name in figures]))
    return cut.select(F.inline(F.when(F.col("metric") == "total_results", with_figures).otherwise(one)))


def skills_in(terms: Sequence[str] = V.SKILL_TERMS) -> Column:
    return terms_in(title_and_description(F.col("title"), F.col("description")), terms)


def insights_agent(df: DataFrame, terms: Sequence[str] = V.SKILL_TERMS) -> DataFrame:
    """(metric, key, n): all companies and locations, and the postings that name each skill."""
    return facet_counts(
        df,
        {"top_companies": _or_unknown("company"), "location_distribution": _or_unknown("location")},
        {"popular_skills": skills_in(terms)},
    )


def keyword_list(df: DataFrame) -> Column:
    """Keywords as an array, from an array or from a ``;`` text."""
    column = F.col("keywords")
    if df.schema["keywords"].dataType.typeName() == "string":
        return split_keywords(column)
    return column


def analyze_postings(df: DataFrame, k: int = 10, keyword_k: int = 15) -> DataFrame:
    """(metric, key, n): total, distinct companies and locations, top lists, all sources."""
    counts = facet_counts(
        df,
        {
            "total_jobs": F.lit(""),
            "top_companies": F.col("company"),
            "top_locations": F.col("location"),
            "sources": F.col("source"),
        },
        {"top_keywords": keyword_list(df)},
    )
    # distinct values of a facet are its count rows. The condition looks at the counts, so
    # that it is not moved below them and both parts read the same shuffle.
    names = {"top_companies": "unique_companies", "top_locations": "unique_locations"}
    distinct = (
        counts.groupBy("metric")
        .agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"))
        .where(F.when(F.col("metric").isin(list(names)), F.col("rows") > 0).otherwise(F.col("rows") < 0))
        .replace(names, subset=["metric"])
        .select("metric", F.lit("").alias("key"), F.col("distinct").alias("n"))
    )
    cut = cut_metrics(
        counts,
        {"total_jobs": None, "sources": None, "top_companies": k, "top_locations": k, "top_keywords": keyword_k},
    )
    return cut.unionByName(distinct)


def sample_summary(
    df: DataFrame, order: Sequence[Column], first: int = 20, k: int = 5
) -> DataFrame:
    """(metric, key, n): top lists over the first rows in order, and the total over all."""
    head = df.orderBy(*order).limit(first)
    counts = facet_counts(
        head,
        {"top_companies": _or_unknown("company"), "top_locations": _or_unknown("location")},
        {"top_keywords": F.col("keywords")},
    )
    cut = cut_metrics(counts, {"top_companies": k, "top_locations": k, "top_keywords": k})
    total = stats_total(df).select(
        F.lit("total_jobs").alias("metric"), F.lit("").alias("key"), F.col("total_jobs").alias("n")
    )
    return cut.unionByName(total)


def search_counts(
    found: DataFrame, kept: Column, origin: Column | None = None, threshold: int = 10
) -> DataFrame:
    """One row: found, kept by the filter, found per origin, and whether the live set is asked."""
    origin = F.lit("database") if origin is None else origin
    return found.agg(
        F.count(F.lit(1)).alias("total_found"),
        F.count_if(kept).alias("filtered_count"),
        F.count_if(origin == "database").alias("database_count"),
        F.count_if(origin == "live_scraping").alias("scraping_count"),
        (F.count_if(origin == "database") < threshold).alias("scraping_triggered"),
    )

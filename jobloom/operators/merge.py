"""Unions, duplicates and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.relevance import relevance_recency
from jobloom.functions.text import combined_key, text_of
from jobloom.operators.ranking import first_per_key
from jobloom.schema import POSTING_COLUMNS


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all sources; nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_dedup(
    stored: DataFrame,
    live: DataFrame,
    keywords: Sequence[str],
    as_of: Column,
    order: Sequence[Column | str] = ("id",),
) -> DataFrame:
    """Stored rows, then live rows not among them, one row per title, company and location.

    ``order`` says which row of the same origin was seen first. Live rows are
    scored here, stored rows keep their score.
    """
    score = relevance_recency(
        F.col("title"), F.col("description"), F.col("company"), F.col("scraped_at"), as_of, keywords
    )
    both = union_sources(
        stored.withColumn("source_type", F.lit("database")),
        live.withColumn("source_type", F.lit("live_scraping")).withColumn("relevance", score),
    )
    key = combined_key(F.col("title"), F.col("company"), F.col("location"))
    # "database" sorts before "live_scraping"
    return first_per_key(both, [key], [F.col("source_type"), *order])


def fallback_union(
    stored: DataFrame, live: DataFrame, threshold: int = 10, include_live: bool = True
) -> DataFrame:
    """The live rows, or none if the stored hits reach the threshold.

    The test is a scalar subquery over at most ``threshold`` stored rows, so the
    plan stays lazy.
    """
    if not include_live or threshold <= 0:
        return live.where(F.lit(False))
    hits = stored.limit(threshold).agg(F.count(F.lit(1))).scalar()
    return live.where(hits < threshold)


def folded(column: Column) -> Column:
    return F.lower(text_of(column))


def dedup_postings(
    df: DataFrame, order: Sequence[Column | str] = ("id",), id_column: str = "id"
) -> DataFrame:
    """One row per id, then one per title and company in any case; the first in order stays."""
    by_id = first_per_key(df, [F.col(id_column)], order)
    return first_per_key(by_id, [folded(F.col("title")), folded(F.col("company"))], order)


def is_duplicate(left: str, right: str) -> Column:
    """The duplicate test for two aliased rows: same id, or same title and company in any case."""

    def same(name: str) -> Column:
        return folded(F.col(f"{left}.{name}")) == folded(F.col(f"{right}.{name}"))

    return (F.col(f"{left}.id") == F.col(f"{right}.id")) | (same("title") & same("company"))


def _links(rows: DataFrame, key: str, group: Sequence[str], reason: str) -> DataFrame:
    first = rows.groupBy(*group).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("_n"))
    # only groups of two or more are looked up; adaptive execution splits a hot one
    groups = first.where(F.col("_n") > 1).select(*group, "first_key")
    return (
        rows.join(groups, list(group))
        .where(F.col(key) != F.col("first_key"))
        .select(F.col(key).alias("key"), "first_key", F.lit(reason).alias("reason"))
    )


def duplicate_links(df: DataFrame, key: str = "key") -> DataFrame:
    """Each repeated posting linked to the first of its group: (key, first_key, reason).

    Two rows are duplicates for a reason exactly if they link to the same first row
    (or one is that row). The links grow with the rows; the pairs of a group grow
    with its square and are never made.
    """
    rows = df.select(
        key, "id", folded(F.col("title")).alias("_title"), folded(F.col("company")).alias("_company")
    )
    same_id = _links(rows, key, ["id"], "id")
    same_name = _links(rows, key, ["_title", "_company"], "title_company")
    return same_id.unionByName(same_name)


def upsert_postings(new: DataFrame, old: DataFrame) -> DataFrame:
    """New and old rows, one per id: the one updated last, the new one on a tie."""
    both = union_sources(
        new.withColumn("_age", F.lit(0)),
        old.withColumn("_age", F.lit(1)),
    )
    changed = F.coalesce(F.col("updated_at"), F.col("scraped_at"))
    content = F.xxhash64(*[F.col(c) for c in POSTING_COLUMNS if c in both.columns])
    return first_per_key(
        both, [F.col("id")], [F.desc_nulls_last(changed), F.asc("_age"), content]
    ).drop("_age")

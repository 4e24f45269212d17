"""Unions, duplicates and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    as_of,
    full_postings,
    on_postings,
    postings,
    query,
    sql_fields,
)
from jobloom.catalog.filters import BONUS_SQL
from jobloom.operators import merge as M

KEY_SQL = "lower(trim(title)) || '|' || lower(trim(company)) || '|' || lower(trim(coalesce(location, '')))"


@query(
    "union_sources",
    on_postings(
        """SELECT key, source, location FROM postings UNION ALL
           SELECT key, 'again' AS source, NULL AS location FROM postings"""
    ),
)
def union_sources(spark, sf):
    rows = postings(spark, sf)
    again = rows.select("key", F.lit("again").alias("source"))
    return M.union_sources(rows.select("key", "source", "location"), again)


_LIVE = f"""live AS (SELECT *, {sql_fields((3.0, 1.5, 1.0), ['python', 'java'])}
    + CAST({BONUS_SQL} AS DOUBLE) AS score FROM postings)"""


def _halves(spark, sf):
    """Stored and live rows: two overlapping parts that together are the whole table."""
    rows = full_postings(spark, sf).select(
        "key", "title", "company", "location", "description", "scraped_at", "relevance"
    )
    return rows.where(F.col("key") % 3 < 2), rows.where(F.col("key") % 3 > 0)


@query(
    "combine_dedup",
    on_postings(
        f"""SELECT key, source_type, relevance FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL}
             ORDER BY source_type, key) AS n FROM (
               SELECT key, title, company, location, relevance, 'database' AS source_type
                 FROM postings WHERE key % 3 < 2
               UNION ALL
               SELECT key, title, company, location, score, 'live_scraping' FROM live WHERE key % 3 > 0))
           WHERE n = 1""",
        _LIVE,
    ),
)
def combine_dedup(spark, sf):
    stored, live = _halves(spark, sf)
    merged = M.combine_dedup(stored, live, ["python", "java"], as_of(), [F.asc("key")])
    return merged.select("key", "source_type", "relevance")


@query(
    "fallback_union",
    on_postings(
        """SELECT 'few' AS stored, key FROM postings
             WHERE (SELECT count(*) FROM postings WHERE key < 3) < 10
           UNION ALL SELECT 'many' AS stored, key FROM postings WHERE (SELECT count(*) FROM postings) < 10"""
    ),
)
def fallback_union(spark, sf):
    rows = postings(spark, sf).select("key")
    few = M.fallback_union(rows.where(F.col("key") < 3), rows, threshold=10)
    many = M.fallback_union(rows, rows, threshold=10)
    return few.select(F.lit("few").alias("stored"), "key").unionByName(
        many.select(F.lit("many").alias("stored"), "key")
    )


TWICE = """twice AS (SELECT key, id, title, company FROM postings
    UNION ALL SELECT key + 1000000000, id, upper(title), company FROM postings)"""


def _twice(spark, sf):
    rows = postings(spark, sf).select("key", "id", "title", "company")
    again = rows.select((F.col("key") + 1000000000).alias("key"), "id", F.upper("title").alias("title"), "company")
    return rows.unionByName(again)


@query(
    "dedup_postings",
    on_postings(
        """SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(company)
             ORDER BY key) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY key) AS n
               FROM twice) WHERE n = 1) WHERE m = 1""",
        TWICE,
    ),
)
def dedup_postings(spark, sf):
    return M.dedup_postings(_twice(spark, sf), [F.asc("key")]).select("key", "id")


@query(
    "duplicate_links",
    on_postings(
        """SELECT key, first_key, reason FROM (
             SELECT key, min(key) OVER (PARTITION BY id) AS first_key, 'id' AS reason FROM twice
             UNION ALL
             SELECT key, min(key) OVER (PARTITION BY lower(title), lower(company)), 'title_company' FROM twice)
           WHERE key <> first_key""",
        TWICE,
    ),
)
def duplicate_links(spark, sf):
    return M.duplicate_links(_twice(spark, sf))

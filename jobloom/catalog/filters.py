"""Filters, predicates and relevance formulas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    AS_OF_SQL,
    TEXT,
    as_of,
    full_postings,
    on_postings,
    postings,
    query,
    sql_any,
    sql_fields,
    sql_ratio,
)
from jobloom.catalog.columns import LEVEL_SQL, band_sql
from jobloom.functions import relevance as R
from jobloom.functions import values as V
from jobloom.functions.facets import experience_level, is_remote
from jobloom.functions.text import join_keywords
from jobloom.operators import filters as W


GAPS = """gaps AS (SELECT key, CASE WHEN key % 13 = 0 THEN '' ELSE title END AS title,
    CASE WHEN key % 17 <> 0 THEN company END AS company,
    CASE WHEN key % 19 = 0 THEN '' ELSE link END AS link FROM postings)"""


def _gaps(spark, sf):
    return postings(spark, sf).select(
        "key",
        F.when(F.col("key") % 13 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(F.col("key") % 17 != 0, F.col("company")).alias("company"),
        F.when(F.col("key") % 19 == 0, "").otherwise(F.col("link")).alias("link"),
    )


@query(
    "valid_postings",
    on_postings("SELECT key FROM gaps WHERE title <> '' AND company <> '' AND link <> ''", GAPS),
)
def valid_postings(spark, sf):
    return W.valid_postings(_gaps(spark, sf)).select("key")


@query("valid_scraped", on_postings("SELECT key FROM gaps WHERE title <> '' AND company <> ''", GAPS))
def valid_scraped(spark, sf):
    return W.valid_scraped(_gaps(spark, sf)).select("key")


FULL_SPEC = W.SearchSpec(
    keywords=["java", "de_ops"],
    location="mo",
    sources=["src1", "src2", "src3", "src5", "src8", "src13"],
    min_salary=60000,
    max_salary=110000,
    date_from=datetime(2024, 1, 2),
    date_to=datetime(2024, 1, 28, 12),
    is_active=True,
    experience_level="senior",
    is_remote=True,
)


@query(
    "filter_spec",
    on_postings(
        f"""SELECT key FROM postings WHERE source IN ('src1', 'src2', 'src3', 'src5', 'src8', 'src13')
             AND is_active AND scraped_at >= TIMESTAMP '2024-01-02 00:00:00'
             AND scraped_at <= TIMESTAMP '2024-01-28 12:00:00' AND location ILIKE '%mo%'
             AND {sql_any("lower(coalesce(location, ''))", V.REMOTE_WORDS)}
             AND {band_sql(0)} >= 60000 AND {band_sql(1)} > 0 AND {band_sql(1)} <= 110000
             AND {LEVEL_SQL} = 'senior'
             AND (title ILIKE '%java%' OR description ILIKE '%java%'
               OR array_to_string(keywords, '; ') ILIKE '%java%' OR title ILIKE '%de_ops%'
               OR description ILIKE '%de_ops%' OR array_to_string(keywords, '; ') ILIKE '%de_ops%')"""
    ),
)
def filter_spec(spark, sf):
    return W.filter_spec(full_postings(spark, sf), FULL_SPEC).select("key")


@query(
    "keyword_any",
    on_postings(
        """SELECT key FROM postings WHERE title ILIKE '%Python%' OR description ILIKE '%Python%'
             OR array_to_string(keywords, '; ') ILIKE '%Python%' OR title ILIKE '%th_s%nd%'
             OR description ILIKE '%th_s%nd%' OR array_to_string(keywords, '; ') ILIKE '%th_s%nd%'"""
    ),
)
def keyword_any(spark, sf):
    match = W.keyword_any(
        ["Python", "th_s%nd"], F.col("title"), F.col("description"), join_keywords(F.col("keywords"))
    )
    return full_postings(spark, sf).where(match).select("key")


@query("location_like", on_postings("SELECT key FROM postings WHERE location ILIKE '%w_rk%'"))
def location_like(spark, sf):
    return postings(spark, sf).where(W.location_like(F.col("location"), "W_rk")).select("key")


@query(
    "created_between",
    on_postings(
        """SELECT key FROM postings WHERE scraped_at >= TIMESTAMP '2024-01-05 00:00:00'
             AND scraped_at <= TIMESTAMP '2024-01-10 06:00:00'"""
    ),
)
def created_between(spark, sf):
    within = W.created_between(F.col("scraped_at"), datetime(2024, 1, 5), datetime(2024, 1, 10, 6))
    return postings(spark, sf).where(within).select("key")


@query("level_equals", on_postings(f"SELECT key FROM postings WHERE {LEVEL_SQL} = 'junior'"))
def level_equals(spark, sf):
    level = experience_level(F.col("title"), F.col("description"))
    return postings(spark, sf).where(W.level_equals(level, "junior")).select("key")


@query(
    "remote_equals",
    on_postings(
        f"""SELECT key FROM postings
             WHERE NOT {sql_any("lower(coalesce(location, ''))", V.REMOTE_WORDS)}"""
    ),
)
def remote_equals(spark, sf):
    remote = is_remote(F.col("location"))
    return postings(spark, sf).where(W.remote_equals(remote, False)).select("key")


@query(
    "match_criteria",
    on_postings(
        f"""SELECT key FROM postings WHERE NOT {sql_any('lower(title)', ['senior', 'lead', 'principal'])}
             AND {sql_any("lower(coalesce(location, ''))", V.CRITERIA_REMOTE_WORDS)}"""
    ),
)
def match_criteria(spark, sf):
    return W.match_criteria(postings(spark, sf), "Junior", True).select("key")


BOARD, SEARCHED, EXCLUDED = ["engineer", "Remote"], ["golang", "engineer"], ["intern", "SHWH"]


@query(
    "feed_match",
    on_postings(f"SELECT key FROM postings WHERE {sql_any(TEXT, ['engineer', 'remote', 'golang'])}"),
)
def feed_match(spark, sf):
    match = W.feed_match(F.col("title"), F.col("description"), BOARD, SEARCHED)
    return postings(spark, sf).where(match).select("key")


@query("feed_exclude", on_postings(f"SELECT key FROM postings WHERE NOT {sql_any(TEXT, ['intern', 'shwh'])}"))
def feed_exclude(spark, sf):
    kept = W.feed_exclude(F.col("title"), F.col("description"), EXCLUDED)
    return postings(spark, sf).where(kept).select("key")


@query(
    "recent",
    on_postings(
        f"""SELECT key, scraped_at FROM postings WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 24 HOUR
             ORDER BY scraped_at DESC, key LIMIT 20"""
    ),
)
def recent(spark, sf):
    return W.recent(postings(spark, sf), as_of(), order=["key"]).select("key", "scraped_at")


@query(
    "feed_filter",
    on_postings(
        f"""SELECT key, {sql_ratio('title', 'description', BOARD + SEARCHED)} AS relevance FROM postings
             WHERE {sql_any(TEXT, ['engineer', 'remote', 'golang'])}
               AND NOT {sql_any(TEXT, ['intern', 'shwh'])} ORDER BY key LIMIT 75"""
    ),
)
def feed_filter(spark, sf):
    kept = W.feed_filter(postings(spark, sf), BOARD, SEARCHED, EXCLUDED, 75, order=["key"])
    return kept.select("key", "relevance")


FEED_BOARDS = [
    ("src0", (["engineer", "Remote"], ["intern"], 5)),
    ("src1", ([], ["SHWH", "python"], 0)),
    ("src2", (["python", "java"], [], 3)),
]


def _feed_boards_sql() -> str:
    parts = []
    for name, (wanted, excluded, most) in [*FEED_BOARDS, (None, ([], [], 0))]:
        words = [w.lower() for w in (*wanted, "golang")]
        known = ", ".join(f"'{b}'" for b, _ in FEED_BOARDS)
        here = f"source = '{name}'" if name else f"(source IS NULL OR source NOT IN ({known}))"
        barred = f"AND NOT {sql_any(TEXT, [w.lower() for w in excluded])}" if excluded else ""
        cap = f"QUALIFY row_number() OVER (PARTITION BY source ORDER BY scraped_at DESC, key) <= {most}" if most else ""
        parts.append(
            f"""(SELECT key, source, {sql_ratio('title', 'description', words)} AS relevance FROM postings
                WHERE {here} AND {sql_any(TEXT, words)} {barred} {cap})"""
        )
    return " UNION ALL ".join(parts)


@query("feed_filter_boards", on_postings(_feed_boards_sql()))
def feed_filter_boards(spark, sf):
    """Boards with words and a maximum of their own, one without a maximum, and sources that are no board."""
    feed = "struct<keywords:array<string>,excludeWords:array<string>,maxResults:bigint>"
    boards = spark.createDataFrame(FEED_BOARDS, f"name string, feed {feed}")
    order = [F.desc("scraped_at"), F.asc("key")]
    kept = W.feed_filter_boards(postings(spark, sf), boards, ["golang"], order, salt_on="key")
    return kept.select("key", "source", "relevance")


@query(
    "quality_gate",
    on_postings(
        """SELECT key, concat_ws(',', CASE WHEN title = '' THEN 'required_title' END,
               CASE WHEN company IS NULL THEN 'required_company' END,
               CASE WHEN length(title) < 5 THEN 'title_min_length' END,
               CASE WHEN n > 5000 THEN 'description_max_length' END) AS failed_rules
           FROM (SELECT g.*, length(p.description) AS n FROM gaps g JOIN postings p USING (key))""",
        GAPS,
    ),
)
def quality_gate(spark, sf):
    rows = postings(spark, sf)
    rows = rows.withColumn("title", F.when(F.col("key") % 13 == 0, "").otherwise(F.col("title")))
    rows = rows.withColumn("company", F.when(F.col("key") % 17 != 0, F.col("company")))
    return W.mark_quality(rows).select("key", F.array_join("failed_rules", ",").alias("failed_rules"))


@query(
    "relevance_ratio",
    on_postings(
        f"SELECT key, {sql_ratio('title', 'description', ['Python', 'go', 'th'])} AS relevance FROM postings"
    ),
)
def relevance_ratio(spark, sf):
    score = R.relevance_ratio(F.col("title"), F.col("description"), ["Python", "go", "th"])
    return postings(spark, sf).select("key", score.alias("relevance"))


@query(
    "relevance_weighted",
    on_postings(
        f"""SELECT key, {sql_fields((3.0, 1.0, 0.5), ['python', 'go', 'company 1'])} / 3 AS relevance
             FROM postings"""
    ),
)
def relevance_weighted(spark, sf):
    score = R.relevance_weighted(
        F.col("title"), F.col("description"), F.col("company"), ["python", "go", "company 1"]
    )
    return postings(spark, sf).select("key", score.alias("relevance"))


BONUS_SQL = f"""CASE WHEN floor(epoch({AS_OF_SQL} - scraped_at) / 86400) <= 7 THEN 1.0
    WHEN floor(epoch({AS_OF_SQL} - scraped_at) / 86400) <= 30 THEN 0.5 ELSE 0.0 END"""


@query(
    "relevance_recency",
    on_postings(
        f"""SELECT key, {sql_fields((3.0, 1.5, 1.0), ['python', 'go', 'company 1'])}
             + CAST({BONUS_SQL} AS DOUBLE) AS relevance FROM postings"""
    ),
)
def relevance_recency(spark, sf):
    score = R.relevance_recency(
        F.col("title"), F.col("description"), F.col("company"), F.col("scraped_at"), as_of(),
        ["python", "go", "company 1"],
    )
    return postings(spark, sf).select("key", score.alias("relevance"))


@query(
    "relevance_feed",
    on_postings(f"SELECT key, {sql_ratio('title', 'description', BOARD + SEARCHED)} AS relevance FROM postings"),
)
def relevance_feed(spark, sf):
    score = R.relevance_feed(F.col("title"), F.col("description"), BOARD, SEARCHED)
    return postings(spark, sf).select("key", score.alias("relevance"))

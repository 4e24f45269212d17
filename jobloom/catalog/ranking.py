"""Order, rank, paging, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    full_postings,
    offers,
    on_offers,
    on_postings,
    postings,
    query,
    sql_fields,
)
from jobloom.operators import ranking as K
from jobloom.operators.stats import count_by
from jobloom.session import new_path
from jobloom.sources.ordered import ordered_page_info, read_page, write_ordered


@query(
    "cap_per_source",
    on_postings(
        """SELECT key, source FROM (SELECT key, source, row_number() OVER (PARTITION BY source
             ORDER BY scraped_at DESC, key) AS n FROM postings) WHERE n <= 7"""
    ),
)
def cap_per_source(spark, sf):
    order = [F.desc("scraped_at"), F.asc("key")]
    return K.cap_per_source(postings(spark, sf).select("key", "source", "scraped_at"), order, 7).select(
        "key", "source"
    )


@query(
    "cap_per_board",
    on_postings(
        """SELECT key, source FROM (SELECT key, source, row_number() OVER (PARTITION BY source
             ORDER BY scraped_at DESC, key) AS n FROM postings) LEFT JOIN boards ON source = name
           WHERE coalesce(max_results, 7) <= 0 OR n <= coalesce(max_results, 7)""",
        "boards AS (SELECT * FROM (VALUES ('src0', 3), ('src1', 0), ('src2', 12)) AS b(name, max_results))",
    ),
)
def cap_per_board(spark, sf):
    """Boards with a cap of their own, one without a limit, and the default for the rest."""
    boards = spark.createDataFrame([("src0", 3), ("src1", 0), ("src2", 12)], "name string, max_results bigint")
    order = [F.desc("scraped_at"), F.asc("key")]
    rows = postings(spark, sf).select("key", "source", "scraped_at")
    return K.cap_per_source(rows, order, 7, salt_on="key", caps=boards).select("key", "source")


_WEIGHTED = f"{sql_fields((3.0, 1.0, 0.5), ['python', 'data science', 'an'])} / 3"


@query(
    "search_rank",
    on_postings(
        f"""SELECT key, relevance, row_number() OVER (ORDER BY relevance DESC, key) AS search_rank
            FROM (SELECT key, {_WEIGHTED} AS relevance FROM postings)"""
    ),
)
def search_rank(spark, sf):
    ranked = K.search_rank(postings(spark, sf), "Python, data science , an", key="key")
    return ranked.select("key", "relevance", "search_rank")


@query(
    "order_search",
    on_postings(
        """SELECT key, scraped_at, relevance, row_number() OVER (ORDER BY scraped_at DESC NULLS FIRST,
             relevance DESC NULLS FIRST, key) AS place FROM (
             SELECT key, CASE WHEN key % 9 > 0 THEN scraped_at END AS scraped_at, relevance FROM postings)"""
    ),
)
def order_search(spark, sf):
    rows = full_postings(spark, sf).select(
        "key", F.when(F.col("key") % 9 > 0, F.col("scraped_at")).alias("scraped_at"), "relevance"
    )
    return K.place_search(rows, "key")


@query(
    "page",
    on_postings("SELECT key, title FROM postings ORDER BY scraped_at DESC, key LIMIT 25 OFFSET 50"),
)
def page(spark, sf):
    rows = postings(spark, sf).select("key", "title", "scraped_at")
    return K.page(rows, [F.desc("scraped_at"), F.asc("key")], limit=25, offset=50).select("key", "title")


@query(
    "page_by_rank",
    on_offers(
        """SELECT l_orderkey, salary, rank FROM (SELECT l_orderkey, salary,
             row_number() OVER (ORDER BY salary DESC, l_orderkey) AS rank FROM (
               SELECT l_orderkey, max(salary) AS salary FROM offers GROUP BY l_orderkey))
           WHERE rank > 500 AND rank <= 600"""
    ),
)
def page_by_rank(spark, sf):
    rows = offers(spark, sf).groupBy("l_orderkey").agg(F.max("salary").alias("salary"))
    return K.page_by_rank(rows, "salary", "l_orderkey", limit=100, offset=500).select(
        "l_orderkey", "salary", "rank"
    )


@query(
    "page_by_index",
    on_offers(
        """SELECT l_orderkey, l_linenumber, salary, rank FROM (SELECT *,
             row_number() OVER (ORDER BY salary DESC, l_orderkey, l_linenumber) AS rank FROM offers)
           WHERE rank > 4995 AND rank <= 5000"""
    ),
)
def page_by_index(spark, sf):
    """Page 1,000 of all offers, kept in the order of the salary."""
    rows = offers(spark, sf).select("l_orderkey", "l_linenumber", "salary")
    path = new_path(spark, "ordered")
    write_ordered(rows, [F.desc("salary"), F.asc("l_orderkey"), F.asc("l_linenumber")], path)
    return read_page(spark, path, limit=5, offset=4995)


@query(
    "page_info_by_index",
    on_postings(
        """SELECT n AS total, CAST(3 AS BIGINT) AS page, CAST(40 AS BIGINT) AS per_page,
             CAST(ceil(n / 40.0) AS BIGINT) AS total_pages, n - 80 >= 40 AND n > 120 AS has_more
           FROM (SELECT count(*) AS n FROM postings)"""
    ),
)
def page_info_by_index(spark, sf):
    path = new_path(spark, "ordered")
    write_ordered(full_postings(spark, sf).select("key", "scraped_at", "relevance"), K.search_order("key"), path)
    return ordered_page_info(spark, path, limit=40, offset=80)


@query(
    "page_info",
    on_postings(
        """SELECT n AS total, CAST(3 AS BIGINT) AS page, CAST(40 AS BIGINT) AS per_page,
             CAST(ceil(n / 40.0) AS BIGINT) AS total_pages, n - 80 >= 40 AND n > 120 AS has_more
           FROM (SELECT count(*) AS n FROM postings)"""
    ),
)
def page_info(spark, sf):
    return K.page_info_of(postings(spark, sf), limit=40, offset=80)


@query(
    "rank_combined",
    on_postings(
        """SELECT key, relevance FROM (SELECT key, CASE WHEN key % 4 > 0 THEN relevance END AS relevance
             FROM postings) ORDER BY coalesce(relevance, 0) DESC, key LIMIT 50"""
    ),
)
def rank_combined(spark, sf):
    rows = full_postings(spark, sf).select(
        "key", F.when(F.col("key") % 4 > 0, F.col("relevance")).alias("relevance")
    )
    return K.rank_combined(rows, 50, "key")


@query(
    "top_k",
    on_offers("SELECT company, count(*) AS n FROM offers GROUP BY company ORDER BY n DESC, company LIMIT 15"),
)
def top_k(spark, sf):
    return K.top_k(count_by(offers(spark, sf), "company"), 15, key="company")


@query(
    "top_per_group",
    on_offers(
        """SELECT location, company, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY location
             ORDER BY n DESC, company) AS rank FROM (
               SELECT location, company, count(*) AS n FROM offers GROUP BY ALL)) WHERE rank <= 3"""
    ),
)
def top_per_group(spark, sf):
    counts = offers(spark, sf).groupBy("location", "company").agg(F.count(F.lit(1)).alias("n"))
    return K.top_per_group(counts, ["location"], [F.desc("n"), F.asc("company")], 3)

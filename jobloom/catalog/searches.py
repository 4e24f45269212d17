"""The searches and runs, end to end."""

from __future__ import annotations

from jobloom.catalog.base import (
    TEXT,
    as_of,
    full_postings,
    on_postings,
    postings,
    query,
    sql_any,
    sql_fields,
    sql_list,
    sql_ratio,
)
from jobloom.catalog.columns import LEVEL_SQL, band_sql
from jobloom.catalog.filters import BONUS_SQL
from jobloom.catalog.merging import KEY_SQL
from jobloom.functions import values as V
from jobloom.functions.sqlfuncs import register_sql_functions
from jobloom.operators.filters import SearchSpec
from jobloom.plans import registry
from jobloom.plans.search import search_agent, search_hybrid, search_stored
from jobloom.plans.tables import register_search_functions

SPEC = SearchSpec(keywords=["python", "golang"], location="remote", limit=50)
HITS = """hits AS (SELECT * FROM postings WHERE (title ILIKE '%python%' OR description ILIKE '%python%'
    OR array_to_string(keywords, '; ') ILIKE '%python%' OR title ILIKE '%golang%'
    OR description ILIKE '%golang%' OR array_to_string(keywords, '; ') ILIKE '%golang%')
    AND location ILIKE '%remote%'
  ORDER BY scraped_at DESC NULLS FIRST, relevance DESC NULLS FIRST, key LIMIT 50)"""


@query(
    "search_stored",
    on_postings(
        """SELECT key, id, title, company, location, salary, link, source, scraped_at, relevance FROM hits""",
        HITS,
    ),
)
def stored(spark, sf):
    rows = search_stored(full_postings(spark, sf), SPEC, "key").rows
    return rows.select(
        "key", "id", "title", "company", "location", "salary", "link", "source", "scraped_at", "relevance"
    )


@query(
    "search_stored_insights",
    on_postings(
        """SELECT 'total_results' AS metric, '' AS key, count(*) AS n FROM hits
           UNION ALL SELECT 'sources', source, count(*) FROM hits GROUP BY source
           UNION ALL (SELECT 'top_companies', company, count(*) AS n FROM hits GROUP BY company
             ORDER BY n DESC, company LIMIT 5)
           UNION ALL (SELECT 'top_locations', location, count(*) AS n FROM hits GROUP BY location
             ORDER BY n DESC, location LIMIT 5)""",
        HITS,
    ),
)
def stored_insights(spark, sf):
    return search_stored(full_postings(spark, sf), SPEC, "key").insights


@query(
    "search_agent",
    on_postings(
        f"""SELECT key, title, relevance, row_number() OVER (ORDER BY relevance DESC, key) AS search_rank
           FROM (SELECT key, title, {sql_fields((3.0, 1.0, 0.5), ['java', 'react'])} / 2 AS relevance
             FROM postings WHERE NOT {sql_any('lower(title)', ['junior', 'intern', 'entry'])}
               AND {sql_any("lower(coalesce(location, ''))", V.CRITERIA_REMOTE_WORDS)})"""
    ),
)
def agent(spark, sf):
    found = search_agent(postings(spark, sf), "Java, react", "senior", True, key="key")
    return found.rows.select("key", "title", "relevance", "search_rank")


@query(
    "search_stored_sql",
    on_postings("SELECT key, id, title, company, location, scraped_at, relevance FROM hits", HITS),
)
def stored_by_name(spark, sf):
    """The stored search called by name in SQL."""
    register_search_functions(spark, full_postings(spark, sf), "key")
    return spark.sql(
        """SELECT key, id, title, company, location, scraped_at, relevance
           FROM search_stored(array('python', 'golang'), 'remote', 50)"""
    )


@query(
    "search_insights_sql",
    on_postings(
        """SELECT 'total_results' AS metric, '' AS key, count(*) AS n FROM hits
           UNION ALL SELECT 'sources', source, count(*) FROM hits GROUP BY source
           UNION ALL (SELECT 'top_companies', company, count(*) AS n FROM hits GROUP BY company
             ORDER BY n DESC, company LIMIT 5)
           UNION ALL (SELECT 'top_locations', location, count(*) AS n FROM hits GROUP BY location
             ORDER BY n DESC, location LIMIT 5)""",
        HITS,
    ),
)
def insights_by_name(spark, sf):
    register_search_functions(spark, full_postings(spark, sf), "key")
    return spark.sql("SELECT * FROM search_insights(array('python', 'golang'), 'remote', 50)")


HYBRID = [
    """stored AS (SELECT * FROM postings WHERE (title ILIKE '%data science%'
        OR description ILIKE '%data science%' OR array_to_string(keywords, '; ') ILIKE '%data science%')
        AND location ILIKE '%york%'
      ORDER BY scraped_at DESC NULLS FIRST, relevance DESC NULLS FIRST, key LIMIT 200)""",
    f"""live AS (SELECT *, {sql_fields((3.0, 1.5, 1.0), ['data science'])}
        + CAST({BONUS_SQL} AS DOUBLE) AS score FROM postings
      WHERE (SELECT count(*) FROM stored) < 100)""",
    """both_sets AS (SELECT key, title, company, location, scraped_at, relevance,
        'database' AS source_type FROM stored
      UNION ALL SELECT key, title, company, location, scraped_at, score, 'live_scraping' FROM live)""",
    f"""merged AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY source_type,
        scraped_at DESC NULLS FIRST, relevance DESC NULLS FIRST, key) AS n FROM both_sets)""",
    """best AS (SELECT * FROM merged WHERE n = 1 ORDER BY coalesce(relevance, 0) DESC, key LIMIT 200)""",
]


def _hybrid(spark, sf):
    rows = full_postings(spark, sf)
    spec = SearchSpec(keywords=["data science"], location="york", limit=200)
    return search_hybrid(rows, rows, spec, as_of(), threshold=100, key="key")


@query("search_hybrid", on_postings("SELECT key, source_type, relevance FROM best", *HYBRID))
def hybrid(spark, sf):
    return _hybrid(spark, sf).rows.select("key", "source_type", "relevance")


@query(
    "search_hybrid_counts",
    on_postings(
        """SELECT (SELECT count(*) FROM best) AS total_found, (SELECT count(*) FROM stored) AS database_count,
             (SELECT count(*) FROM live) AS scraping_count,
             (SELECT count(*) FROM stored) < 100 AS scraping_triggered""",
        *HYBRID,
    ),
)
def hybrid_counts(spark, sf):
    return _hybrid(spark, sf).counts


@query(
    "registry_run",
    on_postings(
        """SELECT key, title FROM postings WHERE title ILIKE '%devops%' OR description ILIKE '%devops%'
             OR array_to_string(keywords, '; ') ILIKE '%devops%'
           ORDER BY scraped_at DESC NULLS FIRST, relevance DESC NULLS FIRST, id LIMIT 25"""
    ),
)
def registry_run(spark, sf):
    found = registry.run("search_stored", postings=full_postings(spark, sf), keywords="devops")
    return found.rows.select("key", "title")


@query(
    "sql_functions",
    on_postings(
        f"""SELECT key, id, {sql_any("lower(coalesce(location, ''))", V.REMOTE_WORDS)} AS remote,
             {LEVEL_SQL} AS level, {band_sql(0)} AS low, {band_sql(1)} AS high,
             array_to_string(keywords, '|') AS words,
             array_to_string(list_filter({sql_list(V.PROVIDER_TERMS)}, lambda w: contains({TEXT}, w)), '|')
               AS provider_words,
             {sql_ratio('title', 'description', ['java', 'go'])} AS ratio,
             {sql_fields((3.0, 1.0, 0.5), ['java', 'go'])} / 2 AS weighted FROM postings"""
    ),
)
def sql_functions(spark, sf):
    register_sql_functions(spark)
    postings(spark, sf).createOrReplaceTempView("jobloom_postings")
    return spark.sql(
        """SELECT key, posting_id(title, company, link) AS id, is_remote(location) AS remote,
             experience_level(title, description) AS level, salary_min(salary) AS low,
             salary_max(salary) AS high, array_join(extract_keywords(title, description), '|') AS words,
             array_join(extract_keywords_provider(title, description), '|') AS provider_words,
             relevance_ratio(title, description, array('Java', 'go')) AS ratio,
             relevance_weighted(title, description, company, array('Java', 'go')) AS weighted
           FROM jobloom_postings"""
    )

"""The searches as table functions of Spark SQL.

``CREATE FUNCTION ... RETURNS TABLE`` over a view of postings: the stored search and its insights
are found by name in SQL, are part of the plan of the query that calls them, and take its pushed
filters and column choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.schema import POSTING_COLUMNS

VIEW = "jobloom_stored_postings"

# The words as patterns, once per call. An empty list of words and an absent place do not filter.
_HITS = f"""
    SELECT {{columns}} FROM (
      SELECT *, row_number() OVER (
          ORDER BY scraped_at DESC NULLS FIRST, relevance DESC NULLS FIRST, {{key}}) AS __place
      FROM {VIEW}
      WHERE (size(words) = 0 OR exists(words, w -> title ILIKE concat('%', w, '%')
          OR description ILIKE concat('%', w, '%') OR array_join(keywords, '; ') ILIKE concat('%', w, '%')))
        AND (place IS NULL OR location ILIKE concat('%', place, '%')))
    WHERE __place <= max_rows"""


def _top(metric: str, value: str, condition: str, k: int) -> str:
    ranked = f"""SELECT {value} AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {value}) AS __rank
        FROM hits WHERE {condition} GROUP BY 1"""
    return f"SELECT '{metric}' AS metric, key, n FROM ({ranked}) WHERE __rank <= {k}"


def register_search_functions(spark: SparkSession, postings: DataFrame, key: str = "id", k: int = 5) -> list[str]:
    """Create or replace ``search_stored`` and ``search_insights`` over the postings; their names.

    Both take (words, place, max_rows): words in any case of which one must stand in title, description or
    keywords, a part of the location, and the rows of the page. ``max_rows`` bounds what is sorted.
    """
    postings.createOrReplaceTempView(VIEW)
    fields = [f for f in postings.schema.fields if f.name == key or f.name in POSTING_COLUMNS]
    columns = ", ".join(f"`{f.name}`" for f in fields)
    returned = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    hits = _HITS.format(columns=columns, key=f"`{key}`")
    taken = "(words ARRAY<STRING>, place STRING, max_rows INT)"
    parts = [
        "SELECT 'total_results' AS metric, '' AS key, count(*) AS n FROM hits",
        "SELECT 'sources', coalesce(source, 'Unknown'), count(*) FROM hits GROUP BY 2",
        _top("top_companies", "coalesce(company, 'Unknown')", "true", k),
        _top("top_locations", "location", "location <> ''", k),
    ]
    bodies = {
        "search_stored": f"RETURNS TABLE ({returned}) RETURN {hits}",
        "search_insights": "RETURNS TABLE (metric STRING, key STRING, n BIGINT) RETURN "
        f"WITH hits AS ({hits}) {' UNION ALL '.join(parts)}",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{taken} {body}")
    return list(bodies)

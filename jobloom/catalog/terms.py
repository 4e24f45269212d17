"""Keyword queries, matching of many queries, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    full_postings,
    on_queries,
    POSTINGS,
    queries_view,
    query,
    quoted,
    sql_any,
    sql_list,
)
from jobloom.functions import values as V
from jobloom.operators import querytext as K
from jobloom.operators.frontier import crawl_frontier
from jobloom.operators.matching import match_queries, score_many
from jobloom.operators.scanning import count_many, search_many
from jobloom.operators.substrings import build_index, count_indexed, search_indexed
from jobloom.session import new_path


def _processed(spark, sf):
    return K.process_query(queries_view(spark, sf))


@query("tokenize_query", on_queries("SELECT query_id, array_to_string(tokens, '|') AS tokens FROM tokenized"))
def tokenize_query(spark, sf):
    tokens = K.tokenize_query(F.col("text"))
    return queries_view(spark, sf).select("query_id", F.array_join(tokens, "|").alias("tokens"))


@query("expand_synonyms", on_queries("SELECT query_id, array_to_string(keywords, '|') AS keywords FROM expanded"))
def expand_synonyms(spark, sf):
    terms = K.expand_synonyms(K.tokenize_query(F.col("text")))
    return queries_view(spark, sf).select("query_id", F.array_join(terms, "|").alias("keywords"))


MORE_EXCLUSIONS = ["Thth", "SCRIPT"]


@query(
    "drop_exclusions",
    on_queries(
        f"""SELECT query_id, array_to_string(list_filter(tokens,
              lambda w: NOT {sql_any('w', [*V.EXCLUSIONS, 'thth', 'script'])}), '|') AS keywords FROM tokenized"""
    ),
)
def drop_exclusions(spark, sf):
    kept = K.drop_exclusions(K.tokenize_query(F.col("text")), K.with_exclusions(MORE_EXCLUSIONS))
    return queries_view(spark, sf).select("query_id", F.array_join(kept, "|").alias("keywords"))


_HITS = ", ".join(f"regexp_extract_all(t, {quoted(p)}, 0)" for p in V.QUERY_PATTERNS)
PATTERNS_SQL = f"array_to_string(flatten([{_HITS}]), '|')"


@query(
    "job_patterns",
    on_queries(f"SELECT query_id, {PATTERNS_SQL} AS patterns FROM (SELECT query_id, text AS t FROM queries)"),
)
def job_patterns(spark, sf):
    found = K.job_patterns(F.col("text"))
    return queries_view(spark, sf).select("query_id", F.array_join(found, "|").alias("patterns"))


@query(
    "process_query",
    on_queries(
        f"""SELECT query_id, array_to_string(keywords, '|') AS keywords, {PATTERNS_SQL} AS patterns,
             {quoted('|'.join(V.EXCLUSIONS))} AS exclusions
           FROM processed JOIN (SELECT query_id, array_to_string(tokens, ' ') AS t FROM tokenized) USING (query_id)"""
    ),
)
def process_query(spark, sf):
    return _processed(spark, sf).select(
        "query_id", *[F.array_join(c, "|").alias(c) for c in ("keywords", "patterns", "exclusions")]
    )


@query(
    "query_variations",
    on_queries(
        """SELECT query_id, 'query' AS variation, array_to_string(keywords, '|') AS keywords FROM processed
           UNION ALL SELECT query_id, 'single', w FROM placed WHERE n > 1""",
        """placed AS (SELECT query_id, unnest(keywords) AS w, unnest(range(len(keywords))) AS pos,
             len(keywords) AS n FROM processed)""",
    ),
)
def query_variations(spark, sf):
    variations = K.query_variations(_processed(spark, sf))
    return variations.withColumn("keywords", F.array_join("keywords", "|"))


OVERRIDES = {"python": ["snake", "numpy"], "analyst": ["data analyst"]}


@query(
    "with_synonyms",
    on_queries(
        f"""SELECT query_id, array_to_string(list_sort(list_distinct(list(term))), '|') AS keywords FROM (
             SELECT query_id, term FROM token_rows
             UNION ALL SELECT query_id, unnest(words) FROM token_rows JOIN synonyms ON term = name
               WHERE name NOT IN ('python', 'analyst')
             UNION ALL SELECT query_id, unnest({sql_list(OVERRIDES['python'])}) FROM token_rows WHERE term = 'python'
             UNION ALL SELECT query_id, unnest({sql_list(OVERRIDES['analyst'])}) FROM token_rows WHERE term = 'analyst')
           GROUP BY query_id"""
    ),
)
def with_synonyms(spark, sf):
    table = K.with_synonyms(OVERRIDES)
    terms = K.expand_synonyms(K.tokenize_query(F.col("text")), table)
    return queries_view(spark, sf).select("query_id", F.array_join(terms, "|").alias("keywords"))


_PAIRS = """t AS (SELECT key, lower(title) AS title, lower(description) AS description,
    lower(company) AS company, lower(array_to_string(keywords, ' ; ')) AS words,
    lower(title || ' ' || description) AS both_texts FROM postings)"""


def _postings(spark, sf):
    return full_postings(spark, sf).select("key", "title", "description", "company", "keywords")


@query(
    "match_queries",
    on_queries(
        """SELECT DISTINCT query_id, key FROM terms JOIN t ON contains(title, term)
             OR contains(description, term) OR contains(words, term)""",
        POSTINGS,
        _PAIRS,
    ),
)
def match_many(spark, sf):
    return match_queries(_processed(spark, sf), _postings(spark, sf))


@query(
    "score_many",
    on_queries(
        """SELECT query_id, key, round(CAST(sum(1 + CAST(contains(title, term) AS INTEGER)) AS DOUBLE)
             / max(n_terms), 9) AS relevance
           FROM terms JOIN t ON contains(both_texts, term) GROUP BY query_id, key""",
        POSTINGS,
        _PAIRS,
    ),
)
def score(spark, sf):
    scores = score_many(_processed(spark, sf), _postings(spark, sf))
    return scores.withColumn("relevance", F.round("relevance", 9))


@query(
    "search_many",
    on_queries(
        """SELECT query_id, search_rank, key, relevance FROM (SELECT *, row_number() OVER (
             PARTITION BY query_id ORDER BY relevance DESC, key) AS search_rank FROM (
               SELECT query_id, key, sum(3.0 * CAST(contains(title, term) AS INTEGER)
                 + CAST(contains(description, term) AS INTEGER)
                 + 0.5 * CAST(contains(company, term) AS INTEGER))::DOUBLE / max(n_terms) AS relevance
               FROM terms JOIN t ON contains(title, term) OR contains(description, term)
                 OR contains(company, term) GROUP BY query_id, key)) WHERE search_rank <= 10""",
        POSTINGS,
        _PAIRS,
    ),
)
def search_each(spark, sf):
    return search_many(_processed(spark, sf), _postings(spark, sf), 10).select(
        "query_id", "search_rank", "key", "relevance"
    )


def _index(spark, postings):
    path = new_path(spark, "substrings")
    build_index(postings, path)
    return path


COUNTS = on_queries(
    """SELECT query_id, CAST(count(DISTINCT key) AS BIGINT) AS n FROM processed LEFT JOIN (
         SELECT query_id, key FROM terms JOIN t ON contains(title, term)
           OR contains(description, term) OR contains(words, term)) USING (query_id) GROUP BY query_id""",
    POSTINGS,
    _PAIRS,
)


@query("match_counts", COUNTS)
def match_counts(spark, sf):
    """The postings that match each query, counted in one pass over the texts."""
    return count_many(_processed(spark, sf), _postings(spark, sf))


@query("match_counts_indexed", COUNTS)
def match_counts_indexed(spark, sf):
    """The same from the substring index."""
    rows = _postings(spark, sf)
    return count_indexed(_index(spark, rows), _processed(spark, sf), rows)


@query(
    "search_indexed",
    on_queries(
        """SELECT query_id, search_rank, key, round(relevance, 9) AS relevance FROM (SELECT *, row_number() OVER (
             PARTITION BY query_id ORDER BY relevance DESC, key) AS search_rank FROM (
               SELECT query_id, key, CAST(sum(1 + CAST(contains(title, term) AS INTEGER)) AS DOUBLE)
                 / max(n_terms) AS relevance
               FROM terms JOIN t ON contains(both_texts, term) GROUP BY query_id, key)) WHERE search_rank <= 10""",
        POSTINGS,
        _PAIRS,
    ),
)
def search_by_index(spark, sf):
    """The best postings of each query by the ratio, from the substring index."""
    rows = _postings(spark, sf)
    found = search_indexed(_index(spark, rows), _processed(spark, sf), rows, 10, "ratio")
    return found.withColumn("relevance", F.round("relevance", 9))


BOARDS = [
    ("alpha", "scraping", "https://alpha.example", "/find",
     {"q": "{keywords}", "at": "{location}", "kind": "full"}, 75),
    ("Indeed-beta", "scraping", "https://beta.example", "/", {}, 20),
    ("gamma", "rss", None, None, None, 30),
    ("delta", "scraping", "https://Careers.delta.example", None, {"s": "x {keywords} y"}, 0),
]
BOARD_FIELDS = (
    "name string, method string, base_url string, search_path string, search_params map<string,string>, "
    "max_results bigint"
)


@query(
    "crawl_frontier",
    on_queries(
        """SELECT query_id, 'alpha' AS board, 'scraping' AS method, 'https://alpha.example/find?at='
             || coalesce(location, '') || '&kind=full&q=' || w AS url, CAST(75 AS BIGINT) AS cap,
             false AS requires_js FROM words WHERE query_id % 4 = 0
           UNION ALL SELECT query_id, 'Indeed-beta', 'scraping', 'https://beta.example/', 20, true
             FROM words WHERE query_id % 4 = 1
           UNION ALL SELECT query_id, 'gamma', 'rss', NULL, 30, false FROM words WHERE query_id % 4 = 2
           UNION ALL SELECT query_id, 'delta', 'scraping', 'https://Careers.delta.example?s=x ' || w || ' y', 0,
             true FROM words WHERE query_id % 4 = 3""",
        """words AS (SELECT query_id, location, array_to_string(keywords, ' ') AS w
             FROM processed JOIN queries USING (query_id))""",
    ),
)
def frontier(spark, sf):
    """Each query names one board."""
    names = F.array(*[F.lit(b[0]) for b in BOARDS])
    requests = _processed(spark, sf).withColumn("board", F.get(names, (F.col("query_id") % 4).cast("int")))
    return crawl_frontier(requests, spark.createDataFrame(BOARDS, BOARD_FIELDS))

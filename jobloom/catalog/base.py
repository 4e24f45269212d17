"""Test views over the given tables, and the list of checked queries.

Each view is defined twice, as a Spark table and as SQL, by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.relevance import relevance_ratio
from jobloom.functions.text import extract_keywords, posting_id
from jobloom.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """List a query under a name, with the SQL that gives the same rows."""

    def add(run: Query) -> Query:
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} already listed")
        QUERIES[name] = in_utc
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number + 1).cast("int"))


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


LEVELS = ["Senior ", "Junior ", "Lead ", "Sr. ", ""]
SKILLS = ["Python", "Java", "JavaScript", "Golang", "React", "Data Science", "DevOps"]
ROLES = [" Engineer", " Developer", " Analyst"]
LOCATIONS = ["Remote", "Bangalore", "Work From Home", "New York", "Anywhere"]
SALARIES = ["$100k", "80,000 USD", "60K-75K", ""]
SCORED_FOR = ["python", "java", "go"]


def postings_from(documents: DataFrame) -> DataFrame:
    """The posting view of a documents table (batch or stream)."""
    k = F.col("doc_id") % 150
    plain = F.concat(pick(LEVELS, k % 5), pick(SKILLS, k % 7), pick(ROLES, k % 3))
    title = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("  "), F.upper(plain), F.lit(" ")))
    hours = F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + hours
    texts = documents.select(
        F.col("doc_id").alias("key"),
        F.coalesce(title, plain).alias("title"),
        F.concat(F.lit("Company "), (k % 23).cast("string")).alias("company"),
        F.when(k % 6 < 5, pick(LOCATIONS, F.least(k % 6, F.lit(4)))).alias("location"),
        pick(SALARIES, F.col("doc_id") % 4).alias("salary"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://example.org/j/"), F.col("doc_id").cast("string")).alias("link"),
        "source",
        seen.alias("scraped_at"),
        seen.alias("updated_at"),
        (F.col("doc_id") % 7 != 0).alias("is_active"),
    )
    return texts.select(
        "*", posting_id(F.col("title"), F.col("company"), F.col("link")).alias("id")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_from(spread(table(spark, sf_dir, "documents")))


def scored(postings: DataFrame) -> DataFrame:
    title, description = F.col("title"), F.col("description")
    return postings.withColumns(
        {
            "keywords": extract_keywords(title, description),
            "relevance": relevance_ratio(title, description, SCORED_FOR),
        }
    )


def full_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting view with keywords and relevance."""
    return scored(postings(spark, sf_dir))


def _sql_pick(options: list[str], number: str) -> str:
    return f"({sql_list(options)})[({number}) + 1]"


_PLAIN = (
    f"{_sql_pick(LEVELS, 'k % 5')} || {_sql_pick(SKILLS, 'k % 7')} || {_sql_pick(ROLES, 'k % 3')}"
)


def sql_ratio(title: str, description: str, words: list[str]) -> str:
    text = f"lower(coalesce({title}, '') || ' ' || coalesce({description}, ''))"
    points = " + ".join(
        f"(CASE WHEN contains({text}, {quoted(w.lower())}) THEN 1 + "
        f"CASE WHEN contains(lower(coalesce({title}, '')), {quoted(w.lower())}) THEN 1 ELSE 0 END"
        " ELSE 0 END)"
        for w in words
    )
    return f"(CAST({points} AS DOUBLE) / {len(words)})"


def sql_fields(weights: tuple[float, float, float], words: list[str]) -> str:
    parts = [
        f"(CASE WHEN contains(lower(coalesce({field}, '')), {quoted(w.lower())}) THEN {weight} ELSE 0 END)"
        for w in words
        for field, weight in zip(("title", "description", "company"), weights, strict=True)
    ]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"

POSTINGS = f"""numbered AS (SELECT *, doc_id % 150 AS k FROM documents),
texts AS (
  SELECT doc_id AS key,
    CASE WHEN doc_id % 11 = 0 THEN '  ' || upper({_PLAIN}) || ' ' ELSE {_PLAIN} END AS title,
    'Company ' || CAST(k % 23 AS VARCHAR) AS company,
    CASE WHEN k % 6 < 5 THEN {_sql_pick(LOCATIONS, 'k % 6')} END AS location,
    {_sql_pick(SALARIES, 'doc_id % 4')} AS salary,
    text AS description,
    'https://example.org/j/' || CAST(doc_id AS VARCHAR) AS link,
    source,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS scraped_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS updated_at,
    doc_id % 7 <> 0 AS is_active
  FROM numbered),
postings AS (
  SELECT *, md5(lower(title) || '|' || lower(company) || '|' || link) AS id,
    list_filter({sql_list(V.TECH_TERMS)}, lambda w: contains({TEXT}, w)) AS keywords,
    {sql_ratio('title', 'description', SCORED_FOR)} AS relevance
  FROM texts)"""


def on_postings(select: str, *more: str) -> str:
    return f"WITH {', '.join([POSTINGS, *more])} {select}"


def calls_from(events: DataFrame) -> DataFrame:
    """The call log view of an events table (batch or stream)."""
    ok = F.col("event_type") != "error"
    jobs = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        F.col("ts").alias("called_at"),
        ok.alias("ok"),
        F.col("value").alias("latency_ms"),
        jobs.alias("n_jobs"),
        F.when(~ok, F.concat(F.lit("failed with code "), jobs.cast("string"))).alias("error"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(table(spark, sf_dir, "events"))


CALLS = """calls AS (
  SELECT event_id, 'p' || CAST(user_id % 5 AS VARCHAR) AS provider, ts AS called_at,
    event_type <> 'error' AS ok, value AS latency_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_jobs,
    CASE WHEN event_type = 'error'
      THEN 'failed with code ' || json_extract_string(props, '$.k') END AS error
  FROM events)"""


def on_calls(select: str, *more: str) -> str:
    return f"WITH {', '.join([CALLS, *more])} {select}"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting per line item. The joins are on unique keys; Spark picks their kind by size."""
    line = spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(
            "l_orderkey",
            "l_linenumber",
            F.col("p_name").alias("title"),
            F.col("s_name").alias("company"),
            F.col("n_name").alias("location"),
            F.col("n_regionkey").alias("regionkey"),
            F.col("l_returnflag").alias("source"),
            F.col("l_shipdate").alias("scraped_at"),
            F.col("l_extendedprice").alias("salary"),
            F.split("p_name", " ").alias("keywords"),
            F.lit(None).cast("string").alias("description"),
        )
    )


OFFERS = """offers AS (
  SELECT l_orderkey, l_linenumber, p_name AS title, s_name AS company, n_name AS location,
    n_regionkey AS regionkey, l_returnflag AS source, l_shipdate AS scraped_at,
    l_extendedprice AS salary, string_split(p_name, ' ') AS keywords,
    CAST(NULL AS VARCHAR) AS description
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey)"""


def on_offers(select: str, *more: str) -> str:
    return f"WITH {', '.join([OFFERS, *more])} {select}"


QUERY_EXTRAS = [" Remote; c++", ", internship", " | node.js, c#", " full-stack frontend", " Entry Level"]


def queries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword queries: role words and the whole text of a benchmark item."""
    n = F.col("item_id")
    text = F.concat(
        pick(LEVELS, n % 5), pick(SKILLS, n % 7), pick(ROLES, n % 3), pick(QUERY_EXTRAS, n % 5),
        F.lit(", "), F.col("text"),
    )
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), text.alias("text"),
        F.when(n % 4 < 3, pick(["Remote", "Bangalore", "New York"], F.least(n % 4, F.lit(2)))).alias("location"),
    )


def _sql_synonyms() -> str:
    rows = ", ".join(f"({quoted(k)}, {sql_list(v)})" for k, v in V.SYNONYMS.items())
    return f"synonyms(name, words) AS (VALUES {rows})"


QUERIES_VIEW = f"""queries AS (
  SELECT item_id AS query_id,
    {_sql_pick(LEVELS, 'item_id % 5')} || {_sql_pick(SKILLS, 'item_id % 7')}
      || {_sql_pick(ROLES, 'item_id % 3')} || {_sql_pick(QUERY_EXTRAS, 'item_id % 5')}
      || ', ' || text AS text,
    CASE WHEN item_id % 4 < 3 THEN {_sql_pick(["Remote", "Bangalore", "New York"], 'item_id % 4')} END
      AS location
  FROM benchmark),
tokenized AS (
  SELECT *, list_filter(string_split_regex(
      regexp_replace(lower(text), '[^A-Za-z0-9_\\t\\n\\f\\r \\-+.]', ' ', 'g'), '[\\t\\n\\f\\r ,;|]+'),
      lambda w: length(w) >= 2) AS tokens
  FROM queries),
{_sql_synonyms()},
token_rows AS (SELECT query_id, unnest(tokens) AS term FROM tokenized),
expanded AS (
  SELECT query_id, list_sort(list_distinct(list(term))) AS keywords FROM (
    SELECT query_id, term FROM token_rows
    UNION ALL
    SELECT query_id, unnest(words) FROM token_rows JOIN synonyms ON term = name)
  GROUP BY query_id),
processed AS (
  SELECT query_id, list_filter(keywords, lambda w: NOT {sql_any('w', V.EXCLUSIONS)}) AS keywords
  FROM expanded),
terms AS (
  SELECT query_id, term, len(keywords) AS n_terms
  FROM processed, unnest(keywords) AS u(term))"""


def on_queries(select: str, *more: str) -> str:
    return f"WITH {', '.join([QUERIES_VIEW, *more])} {select}"

"""Statistics, insights, trends, call statistics and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    AS_OF_SQL,
    TEXT,
    as_of,
    calls,
    full_postings,
    offers,
    on_calls,
    on_offers,
    on_postings,
    postings,
    query,
    quoted,
    sql_any,
    sql_list,
    table,
)
from jobloom.functions import values as V
from jobloom.operators import advice as G
from jobloom.operators import calls as C
from jobloom.operators import stats as A
from jobloom.operators import trends as T
from jobloom.operators.ranking import relevance_order, score_weighted


def _top(metric: str, column: str, k: int, source: str, where: str = "true") -> str:
    return (
        f"(SELECT '{metric}' AS metric, {column} AS key, count(*) AS n FROM {source} WHERE {where} "
        f"GROUP BY 2 ORDER BY n DESC, key LIMIT {k})"
    )


def _all(metric: str, column: str, source: str, where: str = "true") -> str:
    return f"(SELECT '{metric}' AS metric, {column} AS key, count(*) AS n FROM {source} WHERE {where} GROUP BY 2)"


def _total(metric: str, source: str) -> str:
    return f"(SELECT '{metric}' AS metric, '' AS key, count(*) AS n FROM {source})"


STATS = f"""counted AS ({_total('total_jobs', 'postings')}
    UNION ALL SELECT 'recent_jobs', '', count(*) FROM postings
      WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 24 HOUR HAVING count(*) > 0
    UNION ALL {_all('jobs_by_source', 'source', 'postings')}
    UNION ALL {_all('jobs_by_location', 'location', 'postings', 'location IS NOT NULL')}
    UNION ALL SELECT 'keywords', w, count(*) FROM (SELECT unnest(keywords) AS w FROM postings) GROUP BY w),
  stats AS (SELECT metric, key, CAST(n AS VARCHAR) AS value FROM counted
    UNION ALL SELECT 'last_scraped', '', strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') FROM postings)"""


@query("posting_stats", on_postings("SELECT metric, key, value FROM stats", STATS))
def posting_stats(spark, sf):
    return A.posting_stats(full_postings(spark, sf), as_of())


@query("stats_total", on_offers("SELECT count(*) AS total_jobs FROM offers"))
def stats_total(spark, sf):
    return A.stats_total(offers(spark, sf))


@query("stats_by_source", on_offers("SELECT source, count(*) AS n FROM offers GROUP BY source"))
def stats_by_source(spark, sf):
    return A.stats_by_source(offers(spark, sf))


@query(
    "stats_top_locations",
    on_offers(
        """SELECT location, count(*) AS n FROM offers WHERE location IS NOT NULL GROUP BY location
           ORDER BY n DESC, location LIMIT 10"""
    ),
)
def stats_top_locations(spark, sf):
    return A.stats_top_locations(offers(spark, sf))


@query(
    "stats_daily_7d",
    on_postings(
        f"""SELECT strftime(scraped_at, '%Y-%m-%d') AS day, count(*) AS n FROM postings
             WHERE scraped_at >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1"""
    ),
)
def stats_daily(spark, sf):
    daily = A.stats_daily(postings(spark, sf), as_of())
    return daily.select(F.col("day").cast("string").alias("day"), "n")


@query(
    "insights_search",
    on_postings(
        f"""{_total('total_results', 'postings')} UNION ALL {_all('sources', 'source', 'postings')}
          UNION ALL {_top('top_companies', 'company', 5, 'postings')}
          UNION ALL {_top('top_locations', 'location', 5, 'postings', 'location IS NOT NULL')}"""
    ),
)
def insights_search(spark, sf):
    return A.insights_search(postings(spark, sf))


@query(
    "insights_hybrid",
    on_postings(
        f"""SELECT metric, key, CAST(n AS DOUBLE) AS value FROM (
              {_total('total_results', 'origins')} UNION ALL {_all('source_distribution', 'origin', 'origins')}
              UNION ALL {_top('top_companies', 'company', 5, 'origins')}
              UNION ALL {_top('top_locations', 'location', 5, 'origins', 'location IS NOT NULL')})
            UNION ALL SELECT 'average_score', '', round(avg(score), 9) FROM origins
            UNION ALL SELECT 'max_score', '', max(score) FROM origins
            UNION ALL SELECT 'highly_relevant_jobs', '', CAST(count_if(score >= 5) AS DOUBLE) FROM origins""",
        """origins AS (SELECT *, coalesce(CASE WHEN key % 5 > 0 THEN relevance * 4 END, 0) AS score,
             CASE key % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'live_scraping' ELSE 'unknown' END AS origin
           FROM postings)""",
    ),
)
def insights_hybrid(spark, sf):
    rows = full_postings(spark, sf)
    origin = F.when(F.col("key") % 3 == 0, "database").when(F.col("key") % 3 == 1, "live_scraping")
    rows = rows.withColumn("source_type", origin).withColumn(
        "relevance", F.when(F.col("key") % 5 > 0, F.col("relevance") * 4)
    )
    found = A.insights_hybrid(rows)
    return found.withColumn(
        "value", F.when(F.col("metric") == "average_score", F.round("value", 9)).otherwise(F.col("value"))
    )


@query(
    "insights_agent",
    on_postings(
        f"""{_all('top_companies', 'company', 'postings')}
          UNION ALL {_all('location_distribution', "coalesce(location, 'Unknown')", 'postings')}
          UNION ALL SELECT 'popular_skills', w, count(*) FROM (SELECT unnest(list_filter(
              {sql_list(V.SKILL_TERMS)}, lambda w: contains({TEXT}, w))) AS w FROM postings) GROUP BY w"""
    ),
)
def insights_agent(spark, sf):
    return A.insights_agent(postings(spark, sf))


def _analysis(source: str) -> str:
    return f"""{_total('total_jobs', source)} UNION ALL {_all('sources', 'source', source)}
      UNION ALL {_top('top_companies', 'company', 10, source)}
      UNION ALL {_top('top_locations', 'location', 10, source, 'location IS NOT NULL')}
      UNION ALL {_top('top_keywords', 'w', 15, f'(SELECT unnest(keywords) AS w FROM {source})')}
      UNION ALL SELECT 'unique_companies', '', count(DISTINCT company) FROM {source}
      UNION ALL SELECT 'unique_locations', '', count(DISTINCT location) FROM {source}"""


@query("analyze_postings", on_postings(_analysis("postings")))
def analyze_postings(spark, sf):
    return A.analyze_postings(full_postings(spark, sf))


@query("analyze_offers", on_offers(_analysis("offers")))
def analyze_offers(spark, sf):
    """The same analysis with keywords as a ``;`` text."""
    rows = offers(spark, sf).withColumn("keywords", F.array_join("keywords", " ; "))
    return A.analyze_postings(rows)


@query(
    "sample_summary",
    on_postings(
        f"""{_total('total_jobs', 'postings')} UNION ALL {_top('top_companies', 'company', 5, 'head')}
          UNION ALL {_top('top_locations', "coalesce(location, 'Unknown')", 5, 'head')}
          UNION ALL {_top('top_keywords', 'w', 5, '(SELECT unnest(keywords) AS w FROM head)')}""",
        "head AS (SELECT * FROM postings ORDER BY scraped_at DESC, key LIMIT 20)",
    ),
)
def sample_summary(spark, sf):
    return A.sample_summary(full_postings(spark, sf), [F.desc("scraped_at"), F.asc("key")])


@query(
    "search_counts",
    on_postings(
        """SELECT count(*) AS total_found, count_if(is_active)::BIGINT AS filtered_count,
             count_if(key % 50 = 0)::BIGINT AS database_count, count_if(key % 50 <> 0)::BIGINT AS scraping_count,
             count_if(key % 50 = 0) < 10 AS scraping_triggered FROM postings"""
    ),
)
def search_counts(spark, sf):
    origin = F.when(F.col("key") % 50 == 0, "database").otherwise("live_scraping")
    return A.search_counts(postings(spark, sf), F.col("is_active"), origin)


def _trend_sql(source: str, terms: dict[str, list[str]], days: int) -> str:
    labels = " UNION ALL ".join(
        f"SELECT {quoted(name)} AS keyword, CAST(scraped_at AS DATE) AS day FROM {source} WHERE {sql_any(TEXT, words)}"
        for name, words in terms.items()
    )
    return f"""SELECT keyword, strftime(day, '%Y-%m-%d') AS day, n, round(now_n / {days}, 9) AS moving_average,
        round((now_n - before_n) * 100.0 / before_n, 6) AS growth_percent FROM (
      SELECT keyword, day, n,
        CAST(sum(n) OVER (PARTITION BY keyword ORDER BY day_no RANGE BETWEEN {days - 1} PRECEDING
          AND CURRENT ROW) AS DOUBLE) AS now_n,
        CAST(sum(n) OVER (PARTITION BY keyword ORDER BY day_no RANGE BETWEEN {2 * days - 1} PRECEDING
          AND {days} PRECEDING) AS DOUBLE) AS before_n
      FROM (SELECT keyword, day, date_diff('day', DATE '1970-01-01', day) AS day_no, count(*) AS n
        FROM ({labels}) GROUP BY ALL))"""


def _trend(df):
    return df.select(
        "keyword",
        F.col("day").cast("string").alias("day"),
        "n",
        F.round("moving_average", 9).alias("moving_average"),
        F.round("growth_percent", 6).cast("double").alias("growth_percent"),
    )


@query("keyword_trend", on_postings(_trend_sql("postings", V.TREND_TERMS, 7)))
def keyword_trend(spark, sf):
    return _trend(T.keyword_trend(postings(spark, sf), days=7))


OFFER_TERMS = {"Rings": ["ring"], "Small parts": ["bolt", "rod"], "Gadgets": ["widget", "gizmo"]}


@query("keyword_trend_offers", on_offers(_trend_sql("offers", OFFER_TERMS, 30)))
def keyword_trend_offers(spark, sf):
    return _trend(T.keyword_trend(offers(spark, sf), OFFER_TERMS))


def _region_sql(column: str) -> str:
    cases = " ".join(
        f"WHEN {sql_any(f'lower(coalesce({column}, ' + chr(39) * 2 + '))', words)} THEN {quoted(name)}"
        for name, words in V.REGIONS.items()
    )
    return f"CASE {cases} ELSE 'Other' END"


@query(
    "region_share",
    on_postings(
        f"""SELECT region, n, round(n * 100.0 / sum(n) OVER (), 9)::DOUBLE AS percent FROM (
             SELECT {_region_sql('location')} AS region, count(*) AS n FROM postings GROUP BY 1)"""
    ),
)
def region_share(spark, sf):
    shares = T.region_share(postings(spark, sf))
    return shares.select("region", "n", F.round(F.col("percent").cast("double"), 9).alias("percent"))


@query(
    "region_share_offers",
    on_offers(
        """SELECT r_name AS region, n, round(n * 100.0 / sum(n) OVER (), 9)::DOUBLE AS percent FROM (
             SELECT r_name, count(*) AS n FROM offers JOIN region ON regionkey = r_regionkey GROUP BY 1)"""
    ),
)
def region_share_offers(spark, sf):
    region = table(spark, sf, "region")
    rows = offers(spark, sf).join(region, F.col("regionkey") == F.col("r_regionkey"))
    shares = T.region_share(rows, F.col("r_name"))
    return shares.select("region", "n", F.round(F.col("percent").cast("double"), 9).alias("percent"))


@query(
    "source_call_stats",
    on_calls(
        """SELECT provider, count(*) AS total_requests, count_if(ok)::BIGINT AS success_requests,
             count_if(NOT ok)::BIGINT AS failed_requests,
             CAST(sum(CASE WHEN ok THEN n_jobs ELSE 0 END) AS BIGINT) AS total_jobs,
             round(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS average_latency_ms, max(called_at) AS last_used
           FROM calls GROUP BY provider"""
    ),
)
def source_call_stats(spark, sf):
    stats = C.source_call_stats(calls(spark, sf))
    return stats.withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(
    "source_success_rate",
    on_calls(
        """SELECT 'p' || n AS provider, round(100.0 * good / total, 9)::DOUBLE AS success_rate
           FROM (SELECT CAST(n_nationkey AS VARCHAR) AS n FROM nation) LEFT JOIN (
             SELECT provider, count(*) AS total, count_if(ok) AS good FROM calls GROUP BY provider)
           ON 'p' || n = provider"""
    ),
)
def source_success_rate(spark, sf):
    listed = table(spark, sf, "nation").select(
        F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("provider")
    )
    rates = C.source_success_rate(calls(spark, sf), listed)
    return rates.withColumn("success_rate", F.round(F.col("success_rate").cast("double"), 9))


@query(
    "source_outcomes",
    on_calls(
        """SELECT provider AS source, count_if(ok)::BIGINT AS succeeded, count_if(NOT ok)::BIGINT AS failed,
             CAST(sum(CASE WHEN ok THEN n_jobs ELSE 0 END) AS BIGINT) AS jobs,
             arg_max(error, (called_at, event_id)) FILTER (WHERE NOT ok) AS last_error
           FROM calls GROUP BY provider"""
    ),
)
def source_outcomes(spark, sf):
    return C.source_outcomes(calls(spark, sf))


@query(
    "collection_verdict",
    on_calls(
        """SELECT CAST(sum(CASE WHEN ok THEN n_jobs ELSE 0 END) AS BIGINT) AS jobs,
             count_if(NOT ok)::BIGINT AS errors,
             sum(CASE WHEN ok THEN n_jobs ELSE 0 END) = 0 AND count_if(NOT ok) > 0 AS all_failed FROM calls"""
    ),
)
def collection_verdict(spark, sf):
    return C.collection_verdict(C.source_outcomes(calls(spark, sf)))


SMALL_QUOTAS = {f"p{i}": (1, 5 + i, 60 + 2 * i) for i in range(5)}


def quotas_sql() -> str:
    rows = ", ".join(
        f"('{name}', '{period}', {limit})"
        for name, limits in SMALL_QUOTAS.items()
        for period, limit in zip(C.WINDOWS, limits, strict=True)
    )
    return f"quotas(provider, period, quota) AS (VALUES {rows})"


BREACHES = """SELECT provider, period, window_start, n, CAST(quota AS BIGINT) AS quota FROM (
    SELECT provider, 'minute' AS period, date_trunc('minute', called_at) AS window_start, count(*) AS n
      FROM calls GROUP BY ALL
    UNION ALL SELECT provider, 'hour', date_trunc('hour', called_at), count(*) FROM calls GROUP BY ALL
    UNION ALL SELECT provider, 'day', CAST(date_trunc('day', called_at) AS TIMESTAMP), count(*)
      FROM calls GROUP BY ALL) JOIN quotas USING (provider, period) WHERE n > quota"""


@query("quota_breaches", on_calls(BREACHES, quotas_sql()))
def quota_breaches(spark, sf):
    return C.quota_breaches(calls(spark, sf), C.quota_table(spark, SMALL_QUOTAS))


def _case_list(column: str, table_: dict[str, list[str]], other: list[str]) -> str:
    cases = " ".join(f"WHEN {column} = {quoted(k)} THEN {sql_list(v)}" for k, v in table_.items())
    return f"CASE {cases} ELSE {sql_list(other)} END"


PROFILES = """profiles AS (SELECT conv_id, turn,
    (['Python', 'javascript dev', 'DATA', 'devops js', 'none'])[conv_id % 5 + 1] || ' ' || text AS profile,
    (['junior', 'senior', 'mid', NULL])[turn % 4 + 1] AS level
  FROM conversations WHERE role = 'user')"""


def _profiles(spark, sf):
    users = table(spark, sf, "conversations").where(F.col("role") == "user")
    words = F.array(*[F.lit(w) for w in ["Python", "javascript dev", "DATA", "devops js", "none"]])
    level = F.array(F.lit("junior"), F.lit("senior"), F.lit("mid"), F.lit(None).cast("string"))
    return users.select(
        "conv_id", "turn",
        F.concat(words[(F.col("conv_id") % 5).cast("int")], F.lit(" "), F.col("text")).alias("profile"),
        level[(F.col("turn") % 4).cast("int")].alias("level"),
    )


def _recommended_sql() -> str:
    parts = [_case_list("level", V.LEVEL_KEYWORDS, V.OTHER_LEVEL_KEYWORDS)]
    parts += [
        f"CASE WHEN {sql_any('lower(profile)', words)} THEN {sql_list(added)} ELSE [] END"
        for words, added in V.PROFILE_KEYWORDS
    ]
    return f"flatten([{', '.join(parts)}])"


@query(
    "recommend_keywords",
    f"""WITH {PROFILES}, added AS (SELECT conv_id, turn, {_recommended_sql()} AS w FROM profiles),
      numbered AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM added),
      firsts AS (SELECT conv_id, turn, word, min(pos) AS pos FROM numbered GROUP BY ALL),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM firsts)
      SELECT conv_id, turn, string_agg(word, '|' ORDER BY pos) AS keywords FROM ranked WHERE n <= 10
      GROUP BY ALL""",
)
def recommend_keywords(spark, sf):
    words = G.recommend_keywords(F.col("profile"), F.col("level"))
    return _profiles(spark, sf).select("conv_id", "turn", F.array_join(words, "|").alias("keywords"))


@query(
    "recommend_tips",
    f"""WITH {PROFILES} SELECT conv_id, turn,
        array_to_string({_case_list('level', V.LEVEL_TIPS, V.OTHER_LEVEL_TIPS)}, '|') AS tips FROM profiles""",
)
def recommend_tips(spark, sf):
    tips = G.recommend_tips(F.col("level"))
    return _profiles(spark, sf).select("conv_id", "turn", F.array_join(tips, "|").alias("tips"))


@query(
    "result_advice",
    on_postings(
        f"""SELECT CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS position, advice FROM (
             SELECT 1 AS pos, {quoted(V.ADVICE_BROADEN)} AS advice WHERE (SELECT count(*) FROM postings) < 10
             UNION ALL SELECT 2, {quoted(V.ADVICE_SENIOR)} WHERE (SELECT count_if(contains(lower(title), 'senior'))
               FROM (SELECT * FROM postings ORDER BY (CASE WHEN contains(lower(title), 'python') THEN 3 ELSE 0 END)
                 + (CASE WHEN contains(lower(description), 'python') THEN 1 ELSE 0 END)
                 + (CASE WHEN contains(lower(company), 'python') THEN 0.5 ELSE 0 END) DESC, key LIMIT 5)) > 0
             UNION ALL SELECT 3, '''' || skill || {quoted(V.ADVICE_SKILL[1])} FROM (
               SELECT skill, count(*) AS n FROM (SELECT unnest(list_filter({sql_list(V.SKILL_TERMS)},
                 lambda w: contains({TEXT}, w))) AS skill FROM postings) GROUP BY skill
               ORDER BY n DESC, skill LIMIT 1))"""
    ),
)
def result_advice(spark, sf):
    scored = score_weighted(postings(spark, sf), ["python"])
    return G.result_advice(scored, relevance_order("key"), "junior")


@query(
    "strategy_advice",
    on_calls(
        f"""SELECT provider, CASE WHEN good >= 400 THEN {quoted(V.STRATEGY_STORED)}
             WHEN bad > 100 THEN {quoted(V.STRATEGY_LIVE)} ELSE {quoted(V.STRATEGY_LIMITED)} END AS advice
           FROM (SELECT provider, count_if(ok) AS good, count_if(NOT ok) AS bad FROM calls GROUP BY provider)"""
    ),
)
def strategy_advice(spark, sf):
    outcomes = C.source_outcomes(calls(spark, sf))
    stored = F.floor(F.col("succeeded") / 20)
    return outcomes.select(
        F.col("source").alias("provider"),
        G.strategy_advice(stored, F.col("failed"), F.col("failed") > 100).alias("advice"),
    )

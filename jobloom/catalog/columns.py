"""Projections: normalised and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.catalog.base import (
    AS_OF_SQL,
    TEXT,
    as_of,
    on_postings,
    pick,
    full_postings,
    postings,
    query,
    quoted,
    sql_any,
    sql_list,
    table,
)
from jobloom.functions import facets as C
from jobloom.functions import text as X
from jobloom.functions import values as V
from jobloom.sources.records import normalize_posting, posting_from_json, posting_json

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(12288)"


@query(
    "normalize_posting",
    on_postings(
        f"""SELECT key, md5(lower(trim(title, {WS})) || '|' || lower(company) || '|' || link) AS id,
          trim(title, {WS}) AS title, company, coalesce(location, '') AS location, salary,
          md5(trim(description, {WS})) AS description_md5, link, source,
          {AS_OF_SQL} AS scraped_at, {AS_OF_SQL} AS updated_at, true AS is_active,
          CAST(0 AS DOUBLE) AS relevance FROM postings"""
    ),
)
def normalize(spark, sf):
    raw = postings(spark, sf).select(
        "key",
        F.concat(F.lit(" \t "), F.col("title"), F.lit("\n ")).alias("title"),
        F.concat(F.col("company"), F.lit("\r\n ")).alias("company"),
        "location", "salary", "description", "link", "source",
    )
    done = normalize_posting(raw, as_of(), keep=["key"])
    return done.select(
        "key", "id", "title", "company", "location", "salary",
        F.md5("description").alias("description_md5"), "link", "source",
        F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "is_active", "relevance",
    )


@query("posting_id", on_postings("SELECT key, id FROM postings"))
def posting_id(spark, sf):
    p = postings(spark, sf)
    return p.select("key", X.posting_id(F.col("title"), F.col("company"), F.col("link")).alias("id"))


@query(
    "provider_id",
    on_postings(
        """SELECT key, 'reed_' || key AS reed, 'usajobs_' || link AS usajobs,
             'jsearch_' || id AS jsearch FROM postings"""
    ),
)
def provider_id(spark, sf):
    return postings(spark, sf).select(
        "key",
        X.provider_id("reed", F.col("key")).alias("reed"),
        X.provider_id("usajobs", F.col("link")).alias("usajobs"),
        X.provider_id("jsearch", F.col("id")).alias("jsearch"),
    )


_ONE_LINE = f"trim(regexp_replace(description, '[\\n\\r\\t ]+', ' ', 'g'), {WS})"


@query(
    "clean_description",
    on_postings(
        f"""SELECT key, CASE WHEN length(d) > 500 THEN substring(d, 1, 500) || '...' ELSE d END AS cleaned
          FROM (SELECT key, {_ONE_LINE} AS d FROM postings)"""
    ),
)
def clean_description(spark, sf):
    return postings(spark, sf).select("key", X.clean_description(F.col("description")).alias("cleaned"))


@query(
    "is_remote",
    on_postings(
        f"SELECT key, {sql_any('lower(coalesce(location, ' + chr(39) * 2 + '))', V.REMOTE_WORDS)} AS is_remote FROM postings"
    ),
)
def is_remote(spark, sf):
    return postings(spark, sf).select("key", C.is_remote(F.col("location")).alias("is_remote"))


LEVEL_SQL = (
    f"CASE WHEN {sql_any(TEXT, V.SENIOR_WORDS)} THEN 'senior' "
    f"WHEN {sql_any(TEXT, V.JUNIOR_WORDS)} THEN 'junior' ELSE 'mid' END"
)


@query("experience_level", on_postings(f"SELECT key, {LEVEL_SQL} AS experience_level FROM postings"))
def experience_level(spark, sf):
    p = postings(spark, sf)
    return p.select(
        "key", C.experience_level(F.col("title"), F.col("description")).alias("experience_level")
    )


def band_sql(end: int) -> str:
    cases = " ".join(
        f"WHEN {sql_any('lower(salary)', words)} THEN {band[end]}" for words, band in V.SALARY_BANDS
    )
    return f"CAST(CASE {cases} ELSE 0 END AS BIGINT)"


@query(
    "salary_range",
    on_postings(f"SELECT key, {band_sql(0)} AS min_salary, {band_sql(1)} AS max_salary FROM postings"),
)
def salary_range(spark, sf):
    found = postings(spark, sf).select("key", C.salary_range(F.col("salary")).alias("r"))
    return found.select("key", F.col("r.min").alias("min_salary"), F.col("r.max").alias("max_salary"))


_PAY = """pay AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity > 10 THEN l_extendedprice ELSE 0 END AS low,
    CASE WHEN l_quantity > 25 THEN l_extendedprice * 1.25 ELSE 0 END AS high,
    l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""


def _pay(spark, sf):
    line = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    return line.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(F.col("l_quantity") > 10, price).otherwise(F.lit(0.0)).alias("low"),
        F.when(F.col("l_quantity") > 25, price * 1.25).otherwise(F.lit(0.0)).alias("high"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def _n(name: str) -> str:
    return f"printf('%.0f', {name})"


@query(
    "format_salary_gbp",
    f"""WITH {_PAY} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      CASE WHEN low > 0 AND high > 0 THEN '£' || {_n('low')} || ' - £' || {_n('high')} || ' per year'
        WHEN low > 0 THEN '£' || {_n('low')} || '+ per year' ELSE '' END AS salary FROM pay""",
)
def format_salary_gbp(spark, sf):
    return _pay(spark, sf).select(
        "l_orderkey", "l_linenumber", C.format_salary_gbp(F.col("low"), F.col("high")).alias("salary")
    )


@query(
    "format_salary_usd",
    f"""WITH {_PAY}, texts AS (SELECT *, CASE WHEN low > 0 THEN {_n('low')} ELSE '' END AS lo,
        CASE WHEN high > 0 THEN {_n('high')} ELSE '' END AS hi FROM pay)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CASE WHEN lo <> '' AND hi <> '' THEN '$' || lo || ' - $' || hi || ' per year'
          WHEN lo <> '' THEN '$' || lo || '+ per year' ELSE '' END AS salary FROM texts""",
)
def format_salary_usd(spark, sf):
    def text(name):
        return F.when(F.col(name) > 0, C.whole_number(F.col(name))).otherwise("")

    return _pay(spark, sf).select(
        "l_orderkey", "l_linenumber", C.format_salary_usd(text("low"), text("high")).alias("salary")
    )


@query(
    "format_salary_ccy",
    f"""WITH {_PAY}, parts AS (SELECT *, nullif(low, 0) AS lo, nullif(high, 0) AS hi,
        CASE flag WHEN 'A' THEN 'EUR ' WHEN 'R' THEN 'GBP ' ELSE '$' END AS unit,
        'per ' || CASE status WHEN 'F' THEN 'month' ELSE 'year' END AS per FROM pay)
      SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CASE WHEN lo IS NOT NULL AND hi IS NOT NULL
            THEN unit || {_n('lo')} || ' - ' || unit || {_n('hi')} || ' ' || per
          WHEN lo IS NOT NULL THEN unit || {_n('lo')} || '+ ' || per ELSE '' END AS salary FROM parts""",
)
def format_salary_ccy(spark, sf):
    currency = F.when(F.col("flag") == "A", "EUR").when(F.col("flag") == "R", "GBP").otherwise("")
    period = F.when(F.col("status") == "F", "month")
    low, high = (F.nullif(F.col(c), F.lit(0.0)) for c in ("low", "high"))
    return _pay(spark, sf).select(
        "l_orderkey", "l_linenumber", C.format_salary_ccy(low, high, currency, period).alias("salary")
    )


@query(
    "join_locations",
    on_postings(
        """SELECT key, CASE WHEN key % 5 = 0 THEN 'Not specified'
             ELSE concat_ws(', ', location, company, source) END AS location FROM postings"""
    ),
)
def join_locations(spark, sf):
    listed = F.array_compact(F.array("location", "company", "source"))
    none = F.array().cast("array<string>")
    return postings(spark, sf).select(
        "key",
        X.join_locations(F.when(F.col("key") % 5 == 0, none).otherwise(listed)).alias("location"),
    )


@query(
    "city_state_country",
    on_postings(
        """SELECT key, CASE WHEN c = '' THEN 'Not specified' ELSE c END AS location FROM (
             SELECT key, concat_ws(', ', CASE WHEN key % 2 = 0 THEN location END,
               CASE WHEN key % 3 = 0 THEN company END, CASE WHEN key % 5 = 0 THEN source END) AS c
             FROM postings)"""
    ),
)
def city_state_country(spark, sf):
    city = F.when(F.col("key") % 2 == 0, F.col("location"))
    state = F.when(F.col("key") % 3 == 0, F.col("company")).otherwise("")
    country = F.when(F.col("key") % 5 == 0, F.col("source")).otherwise("")
    return postings(spark, sf).select("key", X.city_state_country(city, state, country).alias("location"))


@query(
    "parse_posted_date",
    on_postings(
        f"""SELECT key, CASE key % 4 WHEN 0 THEN CAST(CAST(scraped_at AS DATE) AS TIMESTAMP)
             WHEN 1 THEN scraped_at WHEN 2 THEN scraped_at - INTERVAL 330 MINUTE
             ELSE {AS_OF_SQL} END AS scraped_at FROM postings"""
    ),
)
def parse_posted_date(spark, sf):
    seen = F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("key") % 4 == 0, F.date_format("scraped_at", "dd/MM/yyyy"))
        .when(F.col("key") % 4 == 1, F.concat(seen, F.lit("Z")))
        .when(F.col("key") % 4 == 2, F.concat(seen, F.lit("+05:30")))
        .otherwise("3 days ago")
    )
    return postings(spark, sf).select(
        "key", C.parse_posted_date(text, as_of()).cast("timestamp_ntz").alias("scraped_at")
    )


TOKENS = ["1d", "Today", "3d", "7D", "week", "14d", "30d", "month", "soon"]


@query(
    "date_posted_days",
    on_postings(
        f"""SELECT key, token, CAST(CASE lower(token) WHEN '1d' THEN 1 WHEN 'today' THEN 1 WHEN '3d' THEN 3
             WHEN '7d' THEN 7 WHEN 'week' THEN 7 WHEN '14d' THEN 14 WHEN '30d' THEN 30
             WHEN 'month' THEN 30 ELSE 0 END AS BIGINT) AS days
           FROM (SELECT key, ({sql_list(TOKENS)})[key % 9 + 1] AS token FROM postings)"""
    ),
)
def date_posted_days(spark, sf):
    marked = postings(spark, sf).select("key", pick(TOKENS, F.col("key") % 9).alias("token"))
    return marked.select("key", "token", C.date_posted_days(F.col("token")).alias("days"))


@query(
    "tag_employment_type",
    on_postings(
        """SELECT key, md5(CASE key % 3 WHEN 0 THEN '[FULLTIME] ' WHEN 1 THEN '[INTERN] ' ELSE '' END
             || description) AS description_md5 FROM postings"""
    ),
)
def tag_employment_type(spark, sf):
    kind = pick(["FULLTIME", "INTERN", ""], F.col("key") % 3)
    tagged = X.tag_employment_type(kind, F.col("description"))
    return postings(spark, sf).select("key", F.md5(tagged).alias("description_md5"))


def company_sql(text: str) -> str:
    found = [
        "nullif(regexp_replace(regexp_extract("
        f"{text}, '{cue}\\s*(\\S+(?:\\s+\\S+){{0,2}})', 1), '\\s+', ' ', 'g'), '')"
        for cue in V.COMPANY_CUES
    ]
    return f"coalesce({', '.join(found)}, 'Unknown Company')"


@query(
    "extract_company",
    on_postings(f"SELECT key, {company_sql('t')} AS company FROM (SELECT key, {TEXT} AS t FROM postings)"),
)
def extract_company(spark, sf):
    return postings(spark, sf).select(
        "key", X.extract_company(F.col("title"), F.col("description")).alias("company")
    )


def place_sql(text: str) -> str:
    cases = " ".join(f"WHEN contains({text}, {quoted(p)}) THEN {quoted(p.title())}" for p in V.PLACES)
    return f"CASE {cases} ELSE 'Not Specified' END"


@query(
    "extract_location",
    on_postings(
        f"""SELECT key, {place_sql('t')} AS location FROM (SELECT key,
          lower(title || ' ' || coalesce(location, '') || ' ' || description) AS t FROM postings)"""
    ),
)
def extract_location(spark, sf):
    title = F.concat_ws(" ", "title", F.coalesce("location", F.lit("")))
    return postings(spark, sf).select(
        "key", X.extract_location(title, F.col("description")).alias("location")
    )


def terms_sql(words: list[str]) -> str:
    return f"array_to_string(list_filter({sql_list(words)}, lambda w: contains({TEXT}, w)), '|')"


@query("extract_keywords", on_postings(f"SELECT key, {terms_sql(V.TECH_TERMS)} AS keywords FROM postings"))
def extract_keywords(spark, sf):
    found = X.extract_keywords(F.col("title"), F.col("description"))
    return postings(spark, sf).select("key", F.array_join(found, "|").alias("keywords"))


@query(
    "extract_keywords_provider",
    on_postings(f"SELECT key, {terms_sql(V.PROVIDER_TERMS)} AS keywords FROM postings"),
)
def extract_keywords_provider(spark, sf):
    found = X.extract_keywords_provider(F.col("title"), F.col("description"))
    return postings(spark, sf).select("key", F.array_join(found, "|").alias("keywords"))


@query(
    "split_keywords",
    on_postings(
        """SELECT key, array_to_string(list_transform(string_split(t, ';'), lambda w: trim(w)), '|') AS keywords,
             CAST(len(string_split(t, ';')) AS BIGINT) AS n
           FROM (SELECT key, array_to_string(keywords, ' ; ') || ';' || location AS t FROM postings)"""
    ),
)
def split_keywords(spark, sf):
    text = F.concat(F.array_join("keywords", " ; "), F.lit(";"), F.col("location"))
    split = full_postings(spark, sf).select("key", X.split_keywords(text).alias("w"))
    return split.select(
        "key", F.array_join("w", "|").alias("keywords"), F.when(F.col("w").isNotNull(), F.size("w")).cast("bigint").alias("n")
    )


@query(
    "join_keywords",
    on_postings("SELECT key, coalesce(array_to_string(keywords, '; '), '') AS keywords FROM postings"),
)
def join_keywords(spark, sf):
    return full_postings(spark, sf).select("key", X.join_keywords(F.col("keywords")).alias("keywords"))


HREFS = (
    "SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"
)
ESCAPED = (
    "list_aggregate(list_transform(string_split(href, ''), lambda c: CASE WHEN "
    "regexp_matches(c, '[^A-Za-z0-9\\-_.~$&+,/:;=@%?#]') THEN url_encode(c) ELSE c END), "
    "'string_agg', '')"
)


@query(
    "resolve_link",
    f"""SELECT page_id, href, CASE WHEN href LIKE 'http%' THEN href ELSE
      regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || CASE WHEN regexp_matches(href,
        '[^A-Za-z0-9\\-_.~$&+,/:;=@%?#!''()*\\[\\]]') THEN {ESCAPED} ELSE href END END AS link
      FROM ({HREFS})""",
)
def resolve_link(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    links = table(spark, sf, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
    return links.select("page_id", "href", X.resolve_link(F.col("href"), F.col("url")).alias("link"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(
    "search_url",
    f"""SELECT page_id, 'https://' || host || '/jobs?a=' || host || ' dev&fixed=1&loc=' ||
          CASE page_id % 2 WHEN 0 THEN 'Remote' ELSE '' END AS url
        FROM (SELECT page_id, {_HOST} AS host FROM pages)""",
)
def search_url(spark, sf):
    pages = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    params = F.create_map(
        F.lit("loc"), F.lit("{location}"), F.lit("fixed"), F.lit("1"), F.lit("a"), F.lit("{keywords}")
    )
    place = F.when(F.col("page_id") % 2 == 0, "Remote")
    words = F.concat(F.col("host"), F.lit(" dev"))
    base = F.concat(F.lit("https://"), F.col("host"))
    return pages.select("page_id", C.search_url(base, F.lit("/jobs"), params, words, place).alias("url"))


NAMES = ["Indeed-", "plain-", "My-Lever-", "x-"]


@query(
    "requires_js",
    f"""SELECT page_id, {sql_any('lower(name)', V.JS_SOURCE_NAMES)}
          OR {sql_any('lower(base)', V.JS_URL_PARTS)} AS requires_js
        FROM (SELECT page_id, ({sql_list(NAMES)})[page_id % 4 + 1] || {_HOST} AS name,
          CASE WHEN page_id % 3 = 0 THEN 'https://Jobs.' ELSE 'https://' END || {_HOST} AS base FROM pages)""",
)
def requires_js(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    name = F.concat(pick(NAMES, F.col("page_id") % 4), host)
    base = F.concat(F.when(F.col("page_id") % 3 == 0, "https://Jobs.").otherwise("https://"), host)
    return table(spark, sf, "pages").select("page_id", C.requires_js(name, base).alias("requires_js"))


@query(
    "preview",
    on_postings(
        """SELECT key, CASE WHEN length(description) > 100 THEN substring(description, 1, 100) || '...'
             ELSE description END AS preview FROM postings"""
    ),
)
def preview(spark, sf):
    return postings(spark, sf).select("key", X.preview(F.col("description")).alias("preview"))


@query(
    "posting_json",
    on_postings(
        """SELECT key, id, title, location, md5(description) AS description_md5,
             array_to_string(keywords, '|') AS keywords, scraped_at, is_active, relevance FROM postings"""
    ),
)
def posting_json_both_ways(spark, sf):
    p = full_postings(spark, sf)
    texts = p.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    back = texts.select("key", posting_from_json(posting_json(texts)).alias("r"))
    return back.select(
        "key", "r.id", "r.title", "r.location", F.md5("r.description").alias("description_md5"),
        F.array_join("r.keywords", "|").alias("keywords"),
        F.col("r.scraped_at").cast("timestamp_ntz").alias("scraped_at"), "r.is_active", "r.relevance",
    )

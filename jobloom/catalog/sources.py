"""Sources and sinks: payloads, feeds, pages, files and the store.

Payloads are built by Spark from the whole tables and then mapped back; files are
written below the shared folder of the session and read again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.catalog.base import (
    AS_OF,
    AS_OF_SQL,
    TEXT,
    as_of,
    full_postings,
    on_postings,
    postings,
    query,
    sql_any,
    sql_list,
    sql_ratio,
    table,
)
from jobloom.catalog.columns import LEVEL_SQL, WS, company_sql, place_sql
from jobloom.catalog.reports import STATS
from jobloom.functions import values as V
from jobloom.plans.runs import export_run, ingest_run
from jobloom.schema import POSTING_COLUMNS
from jobloom.session import new_path
from jobloom.sources import files, store
from jobloom.sources.boards import CONFIG, boards_dim
from jobloom.sources.feeds import read_feed_atom, read_feed_rss
from jobloom.sources.pages import extract_postings_html
from jobloom.sources.providers import REED, map_by_paths, payload_page_info, provider

PROVIDER_WORDS = (
    f"array_to_string(list_filter({sql_list(V.PROVIDER_TERMS)}, lambda w: contains({TEXT}, w)), '|')"
)
SHOWN = ["key", "id", "title", "company", "location", "salary", "link", "source", "scraped_at", "is_active"]


def _shown(mapped, *more: str):
    """The compared columns: long texts as a hash, lists joined, times without zone."""
    return mapped.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz")).select(
        *SHOWN,
        F.md5("description").alias("description_md5"),
        F.coalesce(F.array_join("keywords", "|"), F.lit("")).alias("keywords"),
    )


def _raw(rows, payload: Column):
    return rows.select("key", F.to_json(payload).alias("payload"), as_of().cast("timestamp").alias("fetched_at"))


def _object(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def _provider_sql(ident: str, salary: str, scraped: str, source: str, location: str, words: str = PROVIDER_WORDS,
                  rows: str = "postings") -> str:
    return f"""SELECT key, {ident} AS id, title, company, {location} AS location, {salary} AS salary, link,
        '{source}' AS source, {scraped} AS scraped_at, false AS is_active,
        md5(description) AS description_md5, {words} AS keywords FROM {rows}"""


PAY = "CASE WHEN key % 3 > 0 THEN 1000.0 * key END"
TOP = "CASE WHEN key % 3 > 1 THEN 1500.0 * key END"


def _pay(rows):
    return rows.withColumn("low", F.when(F.col("key") % 3 > 0, 1000.0 * F.col("key"))).withColumn(
        "high", F.when(F.col("key") % 3 > 1, 1500.0 * F.col("key"))
    )


@query(
    "map_reed",
    on_postings(
        _provider_sql(
            "'reed_' || key",
            f"""CASE WHEN {TOP} > 0 THEN '£' || printf('%.0f', {PAY}) || ' - £' || printf('%.0f', {TOP}) || ' per year'
                WHEN {PAY} > 0 THEN '£' || printf('%.0f', {PAY}) || '+ per year' ELSE '' END""",
            f"CASE WHEN key % 2 = 0 THEN CAST(CAST(scraped_at AS DATE) AS TIMESTAMP) ELSE {AS_OF_SQL} END",
            "Reed",
            "coalesce(location, '')",
        )
    ),
)
def map_reed(spark, sf):
    day = F.when(F.col("key") % 2 == 0, F.date_format("scraped_at", "dd/MM/yyyy")).otherwise("yesterday")
    job = _object(
        jobId=F.col("key"), employerName=F.col("company"), jobTitle=F.col("title"),
        locationName=F.col("location"), minimumSalary=F.col("low"), maximumSalary=F.col("high"),
        date=day, jobDescription=F.col("description"), jobUrl=F.col("link"),
    )
    raw = _raw(_pay(postings(spark, sf)), _object(results=F.array(job), totalResults=F.lit(1)))
    return _shown(provider("reed")(raw, keep=["key"]))


@query(
    "map_usajobs",
    on_postings(
        _provider_sql(
            "'usajobs_' || key",
            f"""CASE WHEN {TOP} IS NOT NULL THEN '$' || printf('%.0f', {PAY}) || ' - $' || printf('%.0f', {TOP}) || ' per year'
                WHEN {PAY} IS NOT NULL THEN '$' || printf('%.0f', {PAY}) || '+ per year' ELSE '' END""",
            AS_OF_SQL,
            "USAJobs",
            "CASE WHEN location IS NULL THEN 'Not specified' ELSE location || ', ' || company END",
        )
    ),
)
def map_usajobs(spark, sf):
    rows = _pay(postings(spark, sf))

    def text(name: str) -> Column:
        return F.coalesce(F.format_string("%.0f", F.col(name)), F.lit(""))

    pay = F.when(
        F.col("low").isNotNull(), F.array(_object(
            MinimumRange=text("low"),
            MaximumRange=F.when(F.col("high").isNotNull(), text("high")).otherwise(""),
        ))
    )
    item = _object(
        MatchedObjectDescriptor=_object(
            PositionID=F.col("key").cast("string"), PositionTitle=F.col("title"),
            PositionURI=F.col("link"), OrganizationName=F.col("company"),
            PositionLocationDisplay=F.when(F.col("location").isNotNull(), F.array("location", "company")),
            PositionRemuneration=pay,
            UserArea=_object(Details=_object(JobSummary=F.col("description"))),
        )
    )
    raw = _raw(rows, _object(SearchResult=_object(SearchResultItems=F.array(item))))
    return _shown(provider("usajobs")(raw, keep=["key"]))


@query(
    "map_jsearch",
    on_postings(
        _provider_sql(
            "'jsearch_' || key",
            f"""CASE WHEN {TOP} IS NOT NULL THEN unit || printf('%.0f', {PAY}) || ' - ' || unit || printf('%.0f', {TOP}) || ' ' || per
                WHEN {PAY} IS NOT NULL THEN unit || printf('%.0f', {PAY}) || '+ ' || per ELSE '' END""",
            f"CASE WHEN key % 2 = 0 THEN scraped_at ELSE {AS_OF_SQL} END",
            "JSearch",
            "concat_ws(', ', location, company)",
            rows="tagged",
        ),
        """tagged AS (SELECT * REPLACE (CASE WHEN key % 4 < 2 THEN '[FULLTIME] ' || description ELSE description END
             AS description), CASE WHEN key % 2 = 0 THEN 'EUR ' ELSE '$' END AS unit,
             CASE WHEN key % 5 = 0 THEN 'per MONTH' ELSE 'per year' END AS per
           FROM postings WHERE key % 10 <> 3)""",
    ),
)
def map_jsearch(spark, sf):
    """Answers of every tenth posting carry a status that is not OK."""
    posted = F.when(F.col("key") % 2 == 0, F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    job = _object(
        job_id=F.col("key").cast("string"), employer_name=F.col("company"), job_title=F.col("title"),
        job_employment_type=F.when(F.col("key") % 4 < 2, "FULLTIME").otherwise(""),
        job_apply_link=F.col("link"), job_description=F.col("description"),
        job_posted_at_datetime_utc=posted, job_city=F.col("location"), job_state=F.lit(""),
        job_country=F.col("company"), job_min_salary=F.col("low"), job_max_salary=F.col("high"),
        job_salary_currency=F.when(F.col("key") % 2 == 0, "EUR"),
        job_salary_period=F.when(F.col("key") % 5 == 0, "MONTH"),
    )
    status = F.when(F.col("key") % 10 == 3, "ERROR").otherwise("OK")
    raw = _raw(_pay(postings(spark, sf)), _object(status=status, data=F.array(job)))
    return _shown(provider("jsearch")(raw, keep=["key"]))


def _new_sql(source: str, *, salary: str = "''", link: str = "link", company: str = "company",
             location: str = "coalesce(location, '')", keywords: str = "''", where: str = "true") -> str:
    return f"""SELECT key, md5(lower(trim(title, {WS})) || '|' || lower({company}) || '|' || {link}) AS id,
        trim(title, {WS}) AS title, {company} AS company, {location} AS location, {salary} AS salary,
        {link} AS link, '{source}' AS source, {AS_OF_SQL} AS scraped_at, true AS is_active,
        md5(trim(description, {WS})) AS description_md5, {keywords} AS keywords FROM postings WHERE {where}"""


def _usual() -> Column:
    return _object(
        title=F.col("title"), company=F.col("company"), location=F.col("location"),
        description=F.col("description"), url=F.col("link"),
    )


@query("map_github", on_postings(_new_sql("github-jobs-api")))
def map_github(spark, sf):
    return _shown(provider("github-jobs-api")(_raw(postings(spark, sf), F.array(_usual())), keep=["key"]))


@query(
    "map_remoteok",
    on_postings(
        _new_sql(
            "remoteok-api", link="'https://remoteok.io/remote-jobs/dev-' || key", keywords="source || '|tag'"
        )
    ),
)
def map_remoteok(spark, sf):
    job = _object(
        slug=F.concat(F.lit("dev-"), F.col("key").cast("string")), company=F.col("company"),
        position=F.col("title"), description=F.col("description"), location=F.col("location"),
        tags=F.array(F.col("source"), F.lit("tag")),
    )
    return _shown(provider("remoteok-api")(_raw(postings(spark, sf), F.array(job)), keep=["key"]))


@query(
    "map_usajobs_legacy",
    on_postings(
        _new_sql(
            "usajobs-api",
            salary="CASE WHEN key % 2 = 0 THEN '$' || key || ' - $' ELSE '' END",
            link="CASE WHEN key % 3 = 0 THEN link || '/apply' ELSE link END",
        )
    ),
)
def map_usajobs_legacy(spark, sf):
    item = _object(
        MatchedObjectDescriptor=_object(
            PositionTitle=F.col("title"), OrganizationName=F.col("company"),
            PositionLocation=F.when(
                F.col("location").isNotNull(), F.array(_object(LocationName=F.col("location")))
            ),
            PositionRemuneration=F.when(
                F.col("key") % 2 == 0, F.array(_object(MinimumRange=F.col("key").cast("string")))
            ),
            QualificationSummary=F.col("description"), PositionURI=F.col("link"),
            ApplyURI=F.when(
                F.col("key") % 3 == 0,
                F.array(_object(ApplyOnlineURL=F.concat(F.col("link"), F.lit("/apply")))),
            ),
        )
    )
    raw = _raw(postings(spark, sf), _object(SearchResult=_object(SearchResultItems=F.array(item))))
    return _shown(provider("usajobs-api")(raw, keep=["key"]))


@query(
    "map_hn",
    on_postings(
        _new_sql(
            "hn-jobs-api", company="'Various Companies (HN)'", location="'Remote/Various'", where="key % 6 > 0"
        )
    ),
)
def map_hn(spark, sf):
    item = _object(
        title=F.col("title"), text=F.when(F.col("key") % 6 > 0, F.col("description")), url=F.col("link")
    )
    return _shown(provider("hn-jobs-api")(_raw(postings(spark, sf), F.array(item)), keep=["key"]))


@query("map_generic", on_postings(_new_sql("generic", where="key % 6 > 0")))
def map_generic(spark, sf):
    rows = postings(spark, sf).withColumn("company", F.when(F.col("key") % 6 > 0, F.col("company")))
    return _shown(provider("generic")(_raw(rows, _object(jobs=F.array(_usual()))), keep=["key"]))


@query("map_by_paths", on_postings(_new_sql("paths", salary="salary")))
def map_paths(spark, sf):
    payload = _object(
        title=F.col("title"), company=_object(name=F.col("company")), pay=F.array(_object(range=F.col("salary"))),
        location=_object(display_name=F.col("location")), description=_object(text=F.col("description")),
        url=F.col("link"),
    )
    paths = {
        "title": "$.title", "company": "$.company.name", "location": "$.location.display_name",
        "salary": "$.pay[0].range", "description": "$.description.text", "link": "$.url",
    }
    return _shown(map_by_paths(_raw(postings(spark, sf), payload), paths, "paths", keep=["key"]))


def _escaped(text: Column) -> Column:
    for mark, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _element(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _escaped(text), F.lit(f"</{name}>"))


def _feed_sql(source: str) -> str:
    return on_postings(
        f"""SELECT key, md5(lower(title) || '|' || lower(company) || '|' || link) AS id, title, company, location,
             '' AS salary, link, '{source}' AS source, {AS_OF_SQL} AS scraped_at, true AS is_active,
             md5(description) AS description_md5, '' AS keywords FROM found WHERE title <> ''""",
        f"""found AS (SELECT key, trim(title, {WS}) AS title, link, trim(description, {WS}) AS description,
             {company_sql('t')} AS company, {place_sql('t')} AS location FROM (
               SELECT key, title, description, link, lower(trim(title, {WS}) || ' ' || trim(description, {WS})) AS t
               FROM (SELECT * REPLACE (CASE WHEN key % 12 = 0 THEN '' ELSE title END AS title) FROM postings)))""",
    )


def _feed_rows(spark, sf):
    """Every twelfth item has no title."""
    rows = postings(spark, sf)
    return rows.withColumn("title", F.when(F.col("key") % 12 == 0, "").otherwise(F.col("title")))


@query("read_feed_rss", _feed_sql("rss-board"))
def feed_rss(spark, sf):
    body = F.concat(
        F.lit("<rss><channel><title>Jobs</title><item>"),
        _element("title", F.col("title")), _element("description", F.col("description")),
        _element("link", F.col("link")), F.lit("<pubDate>x</pubDate></item></channel></rss>"),
    )
    feeds = _feed_rows(spark, sf).select("key", F.lit("rss-board").alias("source"), body.alias("body"))
    return _shown(read_feed_rss(feeds, as_of(), keep=["key"]))


@query("read_feed_atom", _feed_sql("atom-board"))
def feed_atom(spark, sf):
    body = F.concat(
        F.lit("<feed><title>Jobs</title><entry>"),
        _element("title", F.col("title")), _element("summary", F.col("description")),
        F.lit('<link href="'), _escaped(F.col("link")), F.lit('"/><id>x</id></entry></feed>'),
    )
    feeds = _feed_rows(spark, sf).select("key", F.lit("atom-board").alias("source"), body.alias("body"))
    return _shown(read_feed_atom(feeds, as_of(), keep=["key"]))


_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
# the end mark of an entity may be missing where a text was cut
_UNESCAPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&lt;?', '<', 'g'), "
    "'&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
)


@query(
    "extract_postings_html",
    f"""SELECT page_id, md5(lower(title) || '|' || lower(title) || '|' || href) AS id, title,
          title AS company, {_ORIGIN} || CASE WHEN regexp_matches(href, '[^A-Za-z0-9\\-_.~$&+,/:;=@%?#!''()*\\[\\]]')
            THEN list_aggregate(list_transform(string_split(href, ''), lambda c: CASE WHEN
              regexp_matches(c, '[^A-Za-z0-9\\-_.~$&+,/:;=@%?#]') THEN url_encode(c) ELSE c END), 'string_agg', '')
            ELSE href END AS link
        FROM (SELECT page_id, url, {_UNESCAPED.format("regexp_extract(item, '>([^<]*)</a>$', 1)")} AS title,
            {_UNESCAPED.format("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} AS href
          FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1)) AS item
            FROM pages)) WHERE trim(title) <> ''""",
)
def html_list(spark, sf):
    selectors = {"jobContainer": "nav li", "title": "a", "company": ".name, li a, a", "link": "a"}
    found = extract_postings_html(
        table(spark, sf, "pages"), selectors, F.lit("board"), as_of(), keep=["page_id"]
    )
    return found.select("page_id", "id", "title", "company", "link")


@query(
    "extract_postings_html_article",
    f"""SELECT page_id, title, company, md5(description) AS description_md5 FROM (
          SELECT page_id, trim({_UNESCAPED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}, {WS}) AS title,
            trim({_UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's')")}, {WS}) AS company,
            trim({_UNESCAPED.format("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')")}, {WS})
              AS description
          FROM pages) WHERE title <> '' AND company <> ''""",
)
def html_article(spark, sf):
    selectors = {"jobContainer": "body", "title": "article h1", "company": "div.ad", "description": "article"}
    found = extract_postings_html(
        table(spark, sf, "pages"), selectors, F.lit("board"), as_of(), keep=["page_id"]
    )
    return found.select("page_id", "title", "company", F.md5("description").alias("description_md5"))


BOARD_SELECTORS = [
    ("list", {"jobContainer": "nav li", "title": "a", "company": "a"}),
    ("article", {"jobContainer": "body", "title": "article h1", "company": "div.ad"}),
]


@query(
    "extract_postings_html_boards",
    f"""SELECT page_id, 'list' AS board, title, title AS company FROM (
          SELECT page_id, trim({_UNESCAPED.format("regexp_extract(item, '>([^<]*)</a>$', 1)")}, {WS}) AS title
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1)) AS item
            FROM pages WHERE page_id % 2 = 0)) WHERE title <> ''
        UNION ALL
        SELECT page_id, 'article', title, company FROM (
          SELECT page_id, trim({_UNESCAPED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}, {WS}) AS title,
            trim({_UNESCAPED.format("regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1, 's')")}, {WS}) AS company
          FROM pages WHERE page_id % 2 = 1) WHERE title <> '' AND company <> ''""",
)
def html_boards(spark, sf):
    """Every page is of one of two boards, each with selectors of its own."""
    boards = spark.createDataFrame(BOARD_SELECTORS, "board string, selectors map<string,string>")
    board = F.when(F.col("page_id") % 2 == 0, "list").otherwise("article")
    pages = table(spark, sf, "pages").withColumn("board", board).join(boards, "board")
    found = extract_postings_html(pages, F.col("selectors"), F.col("board"), as_of(), keep=["page_id", "board"])
    return found.select("page_id", "board", "title", "company")


def _storable(rows):
    """The posting view with times that files can hold."""
    stamps = {c: F.col(c).cast("timestamp") for c in ("scraped_at", "updated_at")}
    return rows.withColumns(stamps)


FILE_SQL = on_postings(
    """SELECT id, title, company, location, salary, link, source, md5(description) AS description_md5,
         array_to_string(keywords, '|') AS keywords, scraped_at, updated_at, is_active, relevance FROM postings"""
)


def _file_rows(rows):
    return rows.select(
        "id", "title", "company", "location", "salary", "link", "source",
        F.md5("description").alias("description_md5"), F.array_join("keywords", "|").alias("keywords"),
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("scraped_at", "updated_at")],
        "is_active", "relevance",
    )


@query("write_postings_json", FILE_SQL)
def json_both_ways(spark, sf):
    path = new_path(spark, "postings-json")
    files.write_postings_json(_storable(full_postings(spark, sf)), path)
    return _file_rows(files.read_postings_json(spark, path, multi_line=False))


@query("read_postings_json", FILE_SQL)
def json_wrapped(spark, sf):
    """Files of ``{"jobs": [...]}`` objects with keywords as a ``;`` text."""
    path = new_path(spark, "wrapped-json")
    rows = _storable(full_postings(spark, sf)).withColumn("keywords", F.array_join("keywords", ";"))
    wrapped = rows.select(F.array(F.struct(*POSTING_COLUMNS)).alias("jobs"))
    wrapped.write.json(path)
    read = files.read_postings_json(spark, path, multi_line=False)
    return _file_rows(read.withColumn("keywords", F.array_remove("keywords", "")))


@query("read_postings_json_array", FILE_SQL)
def json_array(spark, sf):
    """Files that are one array each, written over many lines, keywords as a list."""
    path = new_path(spark, "array-json")
    rows = _storable(full_postings(spark, sf)).withColumn("file", F.floor(F.col("key") / 500))
    arrays = rows.groupBy("file").agg(F.collect_list(F.struct(*POSTING_COLUMNS)).alias("jobs"))
    arrays.select("file", F.to_json("jobs", {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    return _file_rows(files.read_postings_json(spark, path))


@query(
    "payload_page_info",
    on_postings(
        """SELECT answer, total, CAST(3 AS BIGINT) AS page, CAST(25 AS BIGINT) AS per_page,
             CAST(ceil(total / 25.0) AS BIGINT) AS total_pages, n = 25 AND total > 75 AS has_more
           FROM (SELECT key // 25 AS answer, CAST(60 + (key // 25) % 40 AS BIGINT) AS total, count(*) AS n
             FROM postings GROUP BY ALL)"""
    ),
)
def reed_page_info(spark, sf):
    """Answers of up to 25 jobs, each with a total of its own."""
    rows = postings(spark, sf).withColumn("answer", F.floor(F.col("key") / 25))
    answers = rows.groupBy("answer").agg(F.collect_list(F.struct(F.col("key").alias("jobId"))).alias("results"))
    payload = F.to_json(F.struct("results", (60 + F.col("answer") % 40).alias("totalResults")))
    raw = answers.select("answer", payload.alias("payload"))
    return payload_page_info(raw, REED, "results", 25, 50, "totalResults", keep=["answer"])


@query("latest_snapshot", FILE_SQL)
def snapshot(spark, sf):
    """An older export with other titles, then a newer one: the newer counts."""
    base = new_path(spark, "snapshots")
    rows = _storable(full_postings(spark, sf))
    files.write_postings_json(rows.withColumn("title", F.lit("old")), f"{base}/exports/jobs_export_z.json")
    files.write_postings_json(rows, f"{base}/exports/jobs_export_a.json")
    return _file_rows(files.latest_snapshot(spark, base))


_CLEANED = f"trim(regexp_replace(description, '[\\n\\r\\t ]+', ' ', 'g'), {WS})"


@query(
    "write_postings_csv",
    on_postings(
        f"""SELECT id AS "ID", title AS "Title", company AS "Company", location AS "Location",
             nullif(salary, '') AS "Salary", CASE WHEN length({_CLEANED}) > 500
               THEN substring({_CLEANED}, 1, 500) || '...' ELSE {_CLEANED} END AS "Description",
             link AS "Link", source AS "Source", nullif(array_to_string(keywords, '; '), '') AS "Keywords",
             {LEVEL_SQL} AS "Experience Level",
             CAST({sql_any("lower(coalesce(location, ''))", V.REMOTE_WORDS)} AS VARCHAR) AS "Is Remote",
             printf('%.2f', relevance) AS "Relevance Score",
             strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS "Scraped At",
             strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS "Updated At",
             CAST(is_active AS VARCHAR) AS "Is Active" FROM postings"""
    ),
)
def csv_both_ways(spark, sf):
    path = new_path(spark, "postings-csv")
    files.write_postings_csv(_storable(full_postings(spark, sf)), path)
    schema = ", ".join(f"`{name}` string" for name in V.CSV_HEADER)
    return spark.read.schema(schema).options(**files.CSV_FORM).csv(path)


@query(
    "write_stats_csv",
    on_postings(
        """SELECT '1 Metric' AS section, CASE metric WHEN 'total_jobs' THEN 'Total Jobs'
             WHEN 'recent_jobs' THEN 'Recent Jobs (24h)' ELSE 'Last Scraped' END AS name, value
             FROM stats WHERE metric IN ('total_jobs', 'recent_jobs', 'last_scraped')
           UNION ALL SELECT '2 Source', key, value FROM stats WHERE metric = 'jobs_by_source'
           UNION ALL SELECT * FROM (SELECT '3 Location', key, value FROM stats WHERE metric = 'jobs_by_location'
             ORDER BY CAST(value AS BIGINT) DESC, key LIMIT 10)
           UNION ALL SELECT * FROM (SELECT '4 Keyword', key, value FROM stats WHERE metric = 'keywords'
             ORDER BY CAST(value AS BIGINT) DESC, key LIMIT 20)""",
        STATS,
    ),
)
def stats_csv(spark, sf):
    path = new_path(spark, "stats-csv")
    files.write_stats_csv(full_postings(spark, sf), as_of(), path)
    return spark.read.schema("section string, name string, value string").option("header", True).csv(path)


@query(
    "upsert_postings",
    on_postings(
        """SELECT id, CASE WHEN key % 4 = 0 THEN 'changed' ELSE title END AS title, source,
             CASE WHEN key % 4 = 0 THEN updated_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at,
             md5(description) AS description_md5 FROM postings"""
    ),
)
def upsert(spark, sf):
    """A stored version of all rows, then new versions of all: newer, older, and the same age."""
    rows = _storable(full_postings(spark, sf))
    first, second = new_path(spark, "store"), new_path(spark, "store")
    files.store_postings(spark, rows, None, first)
    hours = F.when(F.col("key") % 4 == 0, 1).when(F.col("key") % 4 == 1, -1).otherwise(0)
    newer = rows.withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(hours=hours)).withColumn(
        "title", F.when(F.col("key") % 4 < 2, F.lit("changed")).otherwise(F.col("title"))
    )
    stored = files.store_postings(spark, newer, first, second)
    return stored.select(
        "id", "title", "source", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.md5("description").alias("description_md5"),
    )


@query(
    "boards_dim",
    """SELECT s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'api' ELSE 'scraping' END AS method,
         'https://' || s_suppkey || '.example' AS base_url, CAST(CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey
           WHEN s_suppkey % 4 >= 2 THEN 75 ELSE 0 END AS BIGINT) AS max_results,
         'v' || s_suppkey AS q, '.title' AS title_rule FROM supplier WHERE s_suppkey % 3 > 0""",
)
def boards(spark, sf):
    """A configuration per supplier, written and read as JSON."""
    n = F.col("s_suppkey")
    board = _object(
        name=F.col("s_name"), enabled=F.when(n % 6 != 0, n % 3 > 0),
        baseUrl=F.concat(F.lit("https://"), n.cast("string"), F.lit(".example")), searchPath=F.lit("/jobs"),
        searchParams=F.create_map(F.lit("q"), F.concat(F.lit("v"), n.cast("string"))),
        selectors=_object(jobContainer=F.lit(".job"), title=F.lit(".title")),
        maxResults=F.when(n % 5 > 0, n),
        scrapingMethod=F.when(n % 4 == 0, "rss").when(n % 4 == 1, "api").when(n % 4 == 2, ""),
    )
    config = _object(jobBoards=F.array(board), globalSettings=_object(maxResultsPerBoard=F.lit(75)))
    path = new_path(spark, "boards")
    table(spark, sf, "supplier").select(config.alias("c")).select("c.*").write.json(path)
    return boards_dim(spark.read.schema(CONFIG).json(path)).select(
        "name", "method", "base_url", "max_results", F.col("search_params")["q"].alias("q"),
        F.col("selectors.title").alias("title_rule"),
    )


@query(
    "write_result_json",
    on_postings(
        """SELECT 'row' AS part, id AS key, title AS value FROM postings
           UNION ALL SELECT 'insight', source, CAST(count(*) AS VARCHAR) FROM postings GROUP BY source"""
    ),
)
def result_json(spark, sf):
    rows = postings(spark, sf)
    path = new_path(spark, "result")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    files.write_result_json(rows.select("id", "title"), counts, path)
    back = spark.read.schema("id string, title string").json(f"{path}/rows")
    insights = spark.read.schema("source string, n bigint").json(f"{path}/insights")
    return back.select(F.lit("row").alias("part"), F.col("id").alias("key"), F.col("title").alias("value")).unionByName(
        insights.select(F.lit("insight").alias("part"), F.col("source").alias("key"), F.col("n").cast("string").alias("value"))
    )


INGEST_TERMS = ["django", "fastapi", "flask", "python", "python developer", "remote", "distributed",
                "telecommute", "wfh", "work from home"]


def _payloads(rows):
    reed = _object(results=F.array(_object(
        jobId=F.col("key"), jobTitle=F.col("title"), employerName=F.col("company"),
        jobDescription=F.col("description"), jobUrl=F.col("link"), date=F.lit(""),
    )))
    return {"reed": _raw(rows, reed), "github-jobs-api": _raw(rows, F.array(_usual()))}


@query(
    "ingest_run",
    on_postings(
        f"""SELECT 'reed_' || key AS id, 'Reed' AS source, {sql_ratio('title', 'description', INGEST_TERMS)}
             AS relevance FROM postings
           UNION ALL SELECT md5(lower(trim(title, {WS})) || '|' || lower(company) || '|' || link), 'github-jobs-api',
             {sql_ratio('title', 'description', INGEST_TERMS)} FROM postings"""
    ),
)
def ingest(spark, sf):
    """The whole table as two providers, in two overlapping runs into one store."""
    path, rows = new_path(spark, "store"), postings(spark, sf)
    query_row = table(spark, sf, "region").where(F.col("r_regionkey") == 0).select(
        F.lit("Python, REMOTE; c#").alias("text")
    )
    for run in (rows.where(F.col("key") % 3 < 2), rows.where(F.col("key") % 3 > 0)):
        ingest_run(spark, query_row, _payloads(run), path, buckets=16)
    return store.read_version(spark, path).select("id", "source", "relevance")


@query(
    "export_run",
    on_postings(
        """SELECT 'csv' AS format, id, title FROM postings UNION ALL SELECT 'json', id, title FROM postings"""
    ),
)
def export(spark, sf):
    path, out = new_path(spark, "store"), new_path(spark, "export")
    store.upsert(spark, path, full_postings(spark, sf), buckets=16)
    now = F.lit(AS_OF).cast("timestamp")
    csv_path, _, json_path = export_run(spark, path, out, ["CSV", "json"], now)
    schema = ", ".join(f"`{name}` string" for name in V.CSV_HEADER)
    read = spark.read.schema(schema).options(**files.CSV_FORM).csv(csv_path)
    lines = spark.read.schema("id string, title string").json(json_path)
    return read.select(F.lit("csv").alias("format"), F.col("ID").alias("id"), F.col("Title").alias("title")).unionByName(
        lines.select(F.lit("json").alias("format"), "id", "title")
    )

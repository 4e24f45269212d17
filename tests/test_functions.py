"""Hand-computed cases of the column functions."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.functions import facets as C
from jobloom.functions import relevance as R
from jobloom.functions import text as X
from jobloom.functions.sqlfuncs import register_sql_functions
from jobloom.operators import querytext as K
from jobloom.operators.filters import like_pattern


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def lit(text):
    return F.lit(text).cast("string")


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: X.trim_space(lit("  \t a b\n ")), "a b"),
        (lambda: X.posting_id(lit("A"), lit("B"), lit("L")), hashlib.md5(b"a|b|L").hexdigest()),
        (lambda: X.posting_id(lit(None), lit("B"), lit(None)), hashlib.md5(b"|b|").hexdigest()),
        (lambda: X.clean_description(lit(" a\r\n\t b   c ")), "a b c"),
        (lambda: X.clean_description(lit("é" * 501)), "é" * 500 + "..."),
        (lambda: X.clean_description(lit("x" * 500)), "x" * 500),
        (lambda: X.preview(lit("y" * 101)), "y" * 100 + "..."),
        (lambda: X.extract_keywords(lit("JavaScript"), lit("maintain MongoDB")),
         ["javascript", "java", "go", "mongodb", "ai"]),
        (lambda: X.extract_keywords(lit("x"), lit(None)), []),
        (lambda: X.extract_keywords_provider(lit("NoSQL Engineer"), lit("")), ["engineer", "sql", "nosql"]),
        (lambda: X.extract_company(lit("Dev at  Big\tData Corp Ltd"), lit("")), "big data corp"),
        (lambda: X.extract_company(lit("Dev"), lit("that one")), "one"),
        (lambda: X.extract_company(lit("Dev company: X"), lit("y at ")), "x y at"),
        (lambda: X.extract_company(lit("Dev"), lit("none here")), "Unknown Company"),
        (lambda: X.extract_location(lit("London or Remote"), lit("")), "Remote"),
        (lambda: X.extract_location(lit("in SAN FRANCISCO"), lit("")), "San Francisco"),
        (lambda: X.extract_location(lit("x"), lit(None)), "Not Specified"),
        (lambda: X.split_keywords(lit(" a ; b;")), ["a", "b", ""]),
        (lambda: X.join_locations(F.array().cast("array<string>")), "Not specified"),
        (lambda: X.join_locations(F.lit(None).cast("array<string>")), "Not specified"),
        (lambda: X.city_state_country(lit(""), lit("S"), lit("C")), "S, C"),
        (lambda: X.city_state_country(lit(None), lit(""), lit(None)), "Not specified"),
        (lambda: X.tag_employment_type(lit(""), lit("d")), "d"),
        (lambda: X.tag_employment_type(lit("PART"), lit("d")), "[PART] d"),
        (lambda: C.experience_level(lit("Entry"), lit("you will lead")), "senior"),
        (lambda: C.experience_level(lit("Jr. dev"), lit(None)), "junior"),
        (lambda: C.experience_level(lit(None), lit(None)), "mid"),
        (lambda: C.is_remote(lit("Work From HOME")), True),
        (lambda: C.is_remote(lit(None)), False),
        (lambda: C.salary_min(lit("60k to 100K")), 100000),
        (lambda: C.salary_max(lit("")), 0),
        (lambda: C.format_salary_gbp(F.lit(0.5), F.lit(2.5)), "£0 - £2 per year"),
        (lambda: C.format_salary_gbp(F.lit(30000.0), F.lit(0.0)), "£30000+ per year"),
        (lambda: C.format_salary_gbp(F.lit(0.0), F.lit(9.0)), ""),
        (lambda: C.format_salary_gbp(F.lit(None).cast("double"), F.lit(9.0)), ""),
        (lambda: C.format_salary_usd(lit("1"), lit("")), "$1+ per year"),
        (lambda: C.format_salary_usd(lit(""), lit("2")), ""),
        (lambda: C.format_salary_ccy(F.lit(1e7), F.lit(2e7), lit("INR"), lit("MONTH")),
         "INR 10000000 - INR 20000000 per MONTH"),
        (lambda: C.format_salary_ccy(F.lit(0.0), F.lit(None).cast("double"), lit(None), lit("")), "$0+ per year"),
        (lambda: C.date_posted_days(lit("MONTH")), 30),
        (lambda: C.date_posted_days(lit(None)), 0),
        (lambda: C.requires_js(lit("My-LinkedIn"), lit("")), True),
        (lambda: C.requires_js(lit("x"), lit("https://jobs.x.com")), True),
        (lambda: C.requires_js(lit("x"), lit(None)), False),
        (lambda: C.region_of(lit("Remote, India")), "Remote/Global"),
        (lambda: K.tokenize_query(lit("C# dev; C++,node.js | a é")), ["dev", "c++", "node.js"]),
        (lambda: K.expand_synonyms(F.array(F.lit("rust"), F.lit("rust"))),
         ["rust", "rust developer", "systems programming"]),
        (lambda: K.drop_exclusions(F.array(F.lit("MLM-like"), F.lit("ok"))), ["ok"]),
        (lambda: K.job_patterns(F.lit("senior full stack frontend engineer lead")),
         ["senior", "lead", "engineer", "full stack", "frontend"]),
    ],
)
def test_value(spark, column, expected):
    assert value(spark, column()) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("31/01/2024", datetime(2024, 1, 31)),
        ("2024-01-31T10:00:00Z", datetime(2024, 1, 31, 10)),
        ("2024-01-31T10:00:00.250+01:00", datetime(2024, 1, 31, 9, 0, 0, 250000)),
        ("31/13/2024", datetime(2020, 1, 1)),
        ("2024-01-31", datetime(2020, 1, 1)),
        ("", datetime(2020, 1, 1)),
        (None, datetime(2020, 1, 1)),
    ],
)
def test_parse_posted_date(spark, text, expected):
    fetched = F.lit("2020-01-01 00:00:00").cast("timestamp")
    assert value(spark, C.parse_posted_date(lit(text), fetched).cast("timestamp_ntz")) == expected


@pytest.mark.parametrize(
    "link, expected",
    [
        ("/a b/c", "https://x.org/a%20b/c"),
        ("c?q=1", "https://x.org/p/c?q=1"),
        ("../d/./e", "https://x.org/d/e"),
        ("../../../f", "https://x.org/f"),
        ("//y.org/z", "https://y.org/z"),
        ("?page=2", "https://x.org/p/q?page=2"),
        ("#top", ""),
        ("https://z.org", "https://z.org"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("/für", "https://x.org/f%C3%BCr"),
        ("", ""),
    ],
)
def test_resolve_link(spark, link, expected):
    assert value(spark, X.resolve_link(lit(link), F.lit("https://x.org/p/q?r=1#s"))) == expected


def test_scores(spark):
    title, description, company = lit("Python Developer"), lit("Python and Django development"), lit("TechCorp")
    words = ["python", "django"]
    listed = F.array(*[F.lit(w) for w in words])
    for keywords in (words, listed):
        assert value(spark, R.relevance_weighted(title, description, company, keywords)) == 2.5
        assert value(spark, R.relevance_ratio(title, description, keywords)) == 1.5
    assert value(spark, R.relevance_ratio(title, description, [])) == 0.0
    assert value(spark, R.relevance_ratio(title, description, F.array().cast("array<string>"))) == 0.0
    assert value(spark, R.relevance_ratio(title, description, [""])) == 2.0
    assert value(spark, R.relevance_feed(title, description, ["python"], ["python", "java"])) == 4 / 3


@pytest.mark.parametrize(
    "created, bonus",
    [
        ("2024-01-23 00:00:00.5", 1.0),
        ("2024-01-22 23:59:59.5", 1.0),
        ("2024-01-22 23:59:59", 1.0),
        ("2024-01-23 00:00:00", 1.0),
        ("2024-01-22 00:00:00", 0.5),
        ("2023-12-31 00:00:00", 0.5),
        ("2023-12-30 00:00:00", 0.0),
        (None, 0.0),
    ],
)
def test_recency(spark, created, bonus):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    if created == "2024-01-22 00:00:00":
        now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    if created in ("2023-12-31 00:00:00", "2023-12-30 00:00:00"):
        now = F.lit("2024-01-30 23:59:59").cast("timestamp")
    assert value(spark, R.recency_bonus(lit(created).cast("timestamp"), now)) == bonus


def test_like_pattern():
    assert like_pattern("a%b_c") == "%a%b_c%"
    assert like_pattern("a\\b\\%") == "%ab\\%%"


def test_sql_functions_do_as_the_columns(spark):
    register_sql_functions(spark)
    row = spark.sql(
        """SELECT is_remote('ANYWHERE') AS remote, salary_max('80K') AS high,
             extract_keywords('Go', NULL) AS words, relevance_ratio('a', 'b', array()) AS none,
             date_posted_days('Week') AS days, experience_level(NULL, 'Graduate') AS level"""
    ).head()
    assert tuple(row) == (True, 100000, ["go"], 0.0, 7, "junior")

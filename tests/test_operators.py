"""Operators against brute force on small or skewed tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobloom.operators import calls as C
from jobloom.operators import merge as M
from jobloom.operators import ranking as K
from jobloom.operators import stats as A
from jobloom.operators.advice import recommend_keywords, result_advice, strategy_advice
from jobloom.operators.filters import SearchSpec, filter_spec, match_criteria, quality_gate
from jobloom.operators.frontier import crawl_frontier
from jobloom.operators.matching import match_queries, score_many, term_hits
from jobloom.operators.querytext import query_variations
from jobloom.plans import registry
from jobloom.plans.search import search_agent, search_hybrid

NOW = datetime(2024, 1, 31)
# The two full postings of the test strategy.
FULL = [
    ("1", "Python Developer", "TechCorp", "Bangalore", "₹8-12 LPA", "Python and Django development",
     "python;django;api"),
    ("2", "Senior Java Developer", "Enterprise Inc", "Mumbai", "₹15-20 LPA",
     "Java microservices development", "java;spring;microservices"),
]


def as_of():
    return F.lit(NOW)


@pytest.fixture(scope="module")
def full(spark):
    rows = [(*r[:6], r[6].split(";"), "test", NOW, 1.0) for r in FULL]
    return spark.createDataFrame(
        rows,
        "id string, title string, company string, location string, salary string, description string,"
        "keywords array<string>, source string, scraped_at timestamp, relevance double",
    )


def test_criteria(full):
    assert [r.id for r in match_criteria(full, "senior").collect()] == ["1", "2"]
    assert [r.id for r in match_criteria(full, "junior").collect()] == ["1"]
    assert match_criteria(full, None, True).count() == 0


def test_search_agent(full):
    found = search_agent(full, "python, django")
    rows = found.rows.orderBy("search_rank").collect()
    assert [(r.id, r.relevance, r.search_rank) for r in rows] == [("1", 2.5, 1), ("2", 0.0, 2)]
    skills = {r.key: r.n for r in found.insights.where("metric = 'popular_skills'").collect()}
    assert skills == {"python": 1, "java": 1, "microservices": 1}
    assert [r.advice[:14] for r in found.advice.collect()] == ["Consider broad", "'java' appears"]


def test_empty_keywords_are_an_error(full):
    with pytest.raises(ValueError):
        search_agent(full, " , ")


def test_advice_of_nothing_is_nothing(full):
    assert result_advice(full.where("id = 'none'"), [F.asc("id")]).count() == 0


def test_spec_defaults_keep_everything(full):
    assert filter_spec(full, SearchSpec()).count() == 2
    assert filter_spec(full, SearchSpec(keywords=[""])).count() == 2
    assert filter_spec(full, SearchSpec(keywords=["spring"])).count() == 1
    assert filter_spec(full, SearchSpec(min_salary=1)).count() == 0


def test_hybrid_falls_back(spark, full):
    stored = full.where("id = '1'")
    found = search_hybrid(stored, full, SearchSpec(keywords=["developer"], limit=10), as_of())
    rows = {r.id: (r.source_type, r.relevance) for r in found.rows.collect()}
    assert rows == {"1": ("database", 1.0), "2": ("live_scraping", 4.0)}
    assert found.counts.head().asDict() == {
        "total_found": 2, "database_count": 1, "scraping_count": 2, "scraping_triggered": True,
    }
    assert found.advice.head().advice.startswith("Live scraping")
    alone = search_hybrid(stored, full, SearchSpec(keywords=["developer"]), as_of(), include_live=False)
    assert [r.id for r in alone.rows.collect()] == ["1"]
    assert alone.advice.head().advice.startswith("Limited")


def test_quality_gate(spark):
    rows = spark.createDataFrame(
        [("Title", "c", "d"), ("", "c", "d"), ("Titles", None, "x" * 5001)],
        "title string, company string, description string",
    )
    good, bad = quality_gate(rows)
    assert good.count() == 1
    assert sorted(sorted(r.failed_rules) for r in bad.collect()) == [
        ["description_max_length", "required_company"], ["required_title", "title_min_length"],
    ]


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_global_rank(spark, hot):
    random.seed(int(hot * 10))
    rows = [(i, 1.5 if random.random() < hot else random.random()) for i in range(3000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "key bigint, score double")
    expected = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    ranked = K.global_rank(df, "score", "key")
    assert {r.key: r.search_rank for r in ranked.collect()} == expected


def test_global_rank_of_text_keys(spark):
    rows = [(f"k{n % 97:03d}-{n}", float(n % 3)) for n in range(500)]
    df = spark.createDataFrame(rows, "id string, score double")
    expected = [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    ranked = K.global_rank(df, "score", "id").orderBy("search_rank").collect()
    assert [r.id for r in ranked] == expected
    assert [r.search_rank for r in ranked] == list(range(1, 501))


def test_large_groups_are_cut_in_parts(spark):
    df = spark.range(6000).withColumn("g", F.lit("one"))
    kept = K.top_per_group(df, ["g"], [F.desc("id")], 1500, salt_on="id")
    assert kept.count() == 1500
    assert kept.agg(F.min("id")).head()[0] == 4500


def test_caps(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("source"))
    assert K.cap_per_source(df, [F.asc("id")], 0).count() == 10
    assert sorted(r.id for r in K.cap_per_source(df, [F.asc("id")], 2).collect()) == [0, 1, 2, 3]


def test_groups_are_cut_before_the_shuffle(spark):
    """A hot source sends its first rows of each partition only."""
    df = spark.range(100).select("id", (F.col("id") % 1).alias("source"))
    plan = K.cap_per_source(df, [F.asc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = M.first_per_key(df, [F.col("source")], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_page_info(spark):
    def info(n, limit, offset, known):
        return K.page_info_of(spark.range(n), limit, offset, known).head().asDict()

    assert info(100, 10, 20, True) == {"total": 100, "page": 3, "per_page": 10, "total_pages": 10, "has_more": True}
    assert info(30, 10, 20, True)["has_more"] is False
    assert info(30, 10, 20, False)["has_more"] is True
    assert info(25, 10, 20, True)["has_more"] is False


POSTINGS = [
    (1, "Senior Go developer", "We use React  Native and mongodb", "Acme", ["go"]),
    (2, "javascript", "react\nnative apps; xreact nativex", "Java Co", ["javascript", "java"]),
    (3, "", "ends with react", "native", []),
    (4, "verylongword" * 6, "x", "y", []),
    (5, None, None, None, None),
    (6, "react", "native", "z", []),
]
TERMS = ["go", "java", "react native", "ative", "o", "word" + "verylongword" * 3, "zzz", "react  native", ""]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        POSTINGS, "key bigint, title string, description string, company string, keywords array<string>"
    )


def _fields(row):
    _, title, description, company, keywords = row
    title, description, company = ((x or "").lower() for x in (title, description, company))
    return {
        "in_text": f"{title} {description}", "in_title": title, "in_description": description,
        "in_company": company, "in_keywords": " ; ".join(keywords or []),
    }


def test_term_hits(spark, texts):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = {
        (r.key, r.term): {n: r[n] for n in _fields(POSTINGS[0])}
        for r in term_hits(texts, terms).collect()
    }
    expected = {}
    for row in POSTINGS:
        for term in TERMS:
            found = {name: term in text for name, text in _fields(row).items()}
            if any(found.values()):
                expected[(row[0], term)] = found
    assert {k: v for k, v in got.items() if any(v.values())} == expected


def test_terms_in_very_long_words(spark):
    """A word without blanks is searched in windows; a digest does not stand for its text."""
    draw = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300_000)) + "\u2028é🙂"
    rows = [(1, draw, "", "", []), (2, "", draw[::-1] + "needle" + draw, "", []), (3, "x" * 33, "x" * 32, "", [])]
    postings = spark.createDataFrame(rows, "key int, title string, description string, company string, keywords array<string>")
    terms = ["needle", draw[70_001:70_033], draw[5:40], draw[100:400], "\u2028é", "é🙂", "x" * 32, "x" * 33, "x" * 34]
    found = term_hits(postings, spark.createDataFrame([(t,) for t in terms], "term string"))
    got = {(r.key, r.term): (r.in_title, r.in_description) for r in found.collect()}
    expected = {
        (key, t): (t in title, t in text) for key, title, text, *_ in rows for t in terms if t in title or t in text
    }
    assert got == expected


def test_many_queries(spark, texts):
    queries = spark.createDataFrame(
        [(1, ["Java", "java"]), (2, ["react native", "zzz"]), (3, [])], "query_id bigint, keywords array<string>"
    )
    pairs = {(r.query_id, r.key) for r in match_queries(queries, texts).collect()}
    assert pairs == {(1, 2), (2, 2)}
    ratio = {(r.query_id, r.key): r.relevance for r in score_many(queries, texts).collect()}
    assert ratio == {(1, 2): 2.0, (2, 2): 0.5, (2, 6): 0.5}
    weighted = {(r.query_id, r.key): r.relevance for r in score_many(queries, texts, "weighted").collect()}
    assert weighted == {(1, 2): 3.5, (2, 2): 0.5}


def test_variations(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "query_id int, keywords array<string>")
    found = sorted((r.query_id, r.variation, tuple(r.keywords)) for r in query_variations(df).collect())
    assert found == [
        (1, "query", ("a", "b", "c")), (1, "single", ("a",)), (1, "single", ("b",)), (1, "single", ("c",)),
        (2, "query", ("a",)),
    ]


def test_duplicates(spark):
    rows = [(1, "i1", "A", "X"), (2, "i1", "B", "X"), (3, "i3", "a", "x"), (4, "i4", "C", "Y")]
    df = spark.createDataFrame(rows, "key int, id string, title string, company string")
    links = {(r.key, r.first_key, r.reason) for r in M.duplicate_links(df).collect()}
    assert links == {(2, 1, "id"), (3, 1, "title_company")}
    left, right = df.alias("a"), df.alias("b")
    test = left.join(right, F.col("a.key") == F.col("b.key") - 1).select("a.key", M.is_duplicate("a", "b").alias("d"))
    assert {r.key: r.d for r in test.collect()} == {1: True, 2: False, 3: False}
    assert {r.key for r in M.dedup_postings(df, ["key"]).collect()} == {1, 4}


def test_stats_of_text_keywords(spark):
    df = spark.createDataFrame([("c", None, "s", "a; b")], "company string, location string, source string, keywords string")
    found = {(r.metric, r.key): r.n for r in A.analyze_postings(df).collect()}
    assert found == {
        ("total_jobs", ""): 1, ("sources", "s"): 1, ("top_companies", "c"): 1, ("top_keywords", "a"): 1,
        ("top_keywords", "b"): 1, ("unique_companies", ""): 1,
    }


def test_success_rate_without_calls(spark):
    calls = spark.createDataFrame([("a", True), ("a", False)], "provider string, ok boolean")
    listed = spark.createDataFrame([("a",), ("b",)], "provider string")
    rates = {r.provider: r.success_rate for r in C.source_success_rate(calls, listed).collect()}
    assert rates == {"a": 50.0, "b": None}


def test_verdict(spark):
    outcomes = spark.createDataFrame([("a", 0, 2, 0)], "source string, succeeded bigint, failed bigint, jobs bigint")
    assert C.collection_verdict(outcomes).head().all_failed is True


def test_recommendations(spark):
    df = spark.createDataFrame([("JavaScript and data", "senior"), (None, None)], "p string, l string")
    words = [r[0] for r in df.select(recommend_keywords(F.col("p"), F.col("l"))).collect()]
    assert words[0] == ["senior", "lead", "architect", "principal", "javascript", "react", "node", "vue", "java", "spring"]
    assert words[1] == ["developer", "engineer", "specialist"]
    advice = [r[0] for r in spark.range(1).select(strategy_advice(F.lit(20), F.lit(1), F.lit(True))).collect()]
    assert advice[0].startswith("Good database")


def test_frontier(spark):
    requests = spark.createDataFrame(
        [(1, "n", ["a", "b"], None), (2, "none", ["a"], "x")],
        "query_id int, board string, keywords array<string>, location string",
    )
    boards = spark.createDataFrame(
        [Row(name="n", method="scraping", base_url="http://x", search_path="/s",
             search_params={"l": "{location}", "k": "{keywords}!"}, max_results=5)]
    )
    known, unknown = sorted(crawl_frontier(requests, boards).collect())
    assert (known.url, known.cap, known.requires_js) == ("http://x/s?k=a b!&l=", 5, False)
    assert (unknown.board, unknown.url, unknown.cap) == ("none", None, None)


def test_rank_of_one_prefix_and_score(spark):
    """Ids that begin alike and share a score are still cut into parts, by the whole key."""
    df = spark.range(10_000).selectExpr("format_string('usajobs_%020d', id) AS id", "1.0D AS score")
    ranked = K.global_rank(df, "score", "id")
    assert [r.search_rank for r in ranked.orderBy("id").collect()] == list(range(1, 10_001))
    parts = df.repartitionByRange(4, F.desc_nulls_last("score"), F.asc("id"))
    assert parts.groupBy(F.spark_partition_id()).count().count() == 4


def test_blank_terms(spark):
    rows = [(1, "A b", "x", "c", []), (2, "cd", "y", "e", [])]
    postings = spark.createDataFrame(rows, "key int, title string, description string, company string, keywords array<string>")
    found = term_hits(postings, spark.createDataFrame([(" ",), ("",), ("  ",)], "term string"))
    assert {(r.key, r.term, r.in_title) for r in found.collect()} == {(1, " ", True), (2, " ", False), (1, "", True), (2, "", True)}


def test_ingest_takes_one_query(spark):
    from jobloom.plans.runs import score_with_query

    df = spark.createDataFrame([("python jobs",), ("java jobs",)], "text string")
    with pytest.raises(ValueError):
        score_with_query(df, df)


def test_registry(full):
    assert registry.available() == ["search_stored", "search_hybrid", "recommend"]
    assert [d["name"] for d in registry.definitions()] == registry.available()
    assert registry.run("search_stored", postings=full, keywords="java, x", max_results=1).rows.count() == 1
    with pytest.raises(KeyError):
        registry.run("unknown")
    with pytest.raises(ValueError):
        registry.run("search_stored", postings=full)

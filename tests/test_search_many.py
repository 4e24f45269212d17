"""Many queries by one pass and by the substring index, the SQL table functions, and payloads by paths."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.operators import scanning
from jobloom.operators.filters import SearchSpec
from jobloom.operators.substrings import build_index, count_indexed, find_words, search_indexed
from jobloom.plans.search import search_stored
from jobloom.plans.tables import register_search_functions
from jobloom.schema import POSTING
from jobloom.session import new_path
from jobloom.sources.providers import map_by_paths

POSTINGS = "key bigint, title string, description string, company string, keywords array<string>"
LONG = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(3_000))


def made_postings():
    draw = random.Random(5)
    words = ["java", "javascript", "ja", "va", "react", "native", "c++", "a.b", "é🙂é", "x", LONG]
    rows = []
    for key in range(60):
        title, text = (" ".join(draw.choice(words) for _ in range(n)) for n in (2, draw.randint(0, 12)))
        rows.append((key, title.upper() if key % 5 == 0 else title, text, draw.choice(words), draw.sample(words[:6], 2)))
    rows += [(100, None, None, None, None), (101, "", "", "", []), (102, "re", "act native", "", []), (103, " \t", "react\tnative", "x y", [])]
    return rows


QUERIES = [
    (1, ["Java", "java"]), (2, ["react native", "zzz"]), (3, []), (4, ["a", "v", "aj", "ava"]), (5, [""]),
    (6, [LONG[100:400], LONG[5:40], LONG[7:39]]), (7, ["+", ".", "é🙂"]), (8, [" "]), (9, ["nothing of it"]), (10, ["re act"]),
    (11, ["javascriptjava"]), (12, [" ; "]),
]


@pytest.fixture(scope="module")
def postings(spark):
    return spark.createDataFrame(made_postings(), POSTINGS)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, keywords array<string>")


@pytest.fixture(scope="module")
def index(spark, postings):
    path = new_path(spark, "index")
    build_index(postings, path, buckets=5)
    return path


def texts(row):
    key, title, text, company, words = row
    title, text, company = ((t or "").lower() for t in (title, text, company))
    return {"title": title, "description": text, "company": company, "keywords": " ; ".join(words or []).lower(), "text": f"{title} {text}"}


def plain_counts():
    found = {}
    for number, terms in QUERIES:
        held = [any(t.lower() in texts(r)[f] for t in terms for f in ("title", "description", "keywords")) for r in made_postings()]
        found[number] = sum(held)
    return found


def plain_search(k, formula):
    out = []
    for number, terms in QUERIES:
        scored = []
        for row in made_postings():
            at = texts(row)
            if formula == "ratio":
                points = sum((t.lower() in at["text"]) * (1 + (t.lower() in at["title"])) for t in terms)
            else:
                weights = {"title": 3, "description": 1, "company": 0.5}
                points = sum(w * (t.lower() in at[f]) for t in terms for f, w in weights.items())
            if points:
                scored.append((-points / len(terms), row[0]))
        out += [(number, rank + 1, key, -score) for rank, (score, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found_rows(df):
    return sorted((r["query_id"], r["search_rank"], r["key"], r["relevance"]) for r in df.collect())


@pytest.mark.parametrize("sent", [1 << 20, 10])
def test_counts_by_one_pass(postings, queries, monkeypatch, sent):
    monkeypatch.setattr(scanning, "SENT_CHARS", sent)
    assert {r["query_id"]: r["n"] for r in scanning.count_many(queries, postings).collect()} == plain_counts()


@pytest.mark.parametrize("formula", ["weighted", "ratio"])
def test_search_by_one_pass(postings, queries, monkeypatch, formula):
    monkeypatch.setattr(scanning, "QUERIES", 3)
    assert found_rows(scanning.search_many(queries, postings, 4, formula)) == plain_search(4, formula)


def test_one_pass_shuffles_no_text(postings, queries):
    plan = scanning.search_many(queries, postings, 4)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInPandas") :]
    assert "Exchange hashpartitioning" not in below and "Join" not in plan


def test_counts_by_index(postings, queries, index):
    assert {r["query_id"]: r["n"] for r in count_indexed(index, queries, postings).collect()} == plain_counts()


@pytest.mark.parametrize("formula", ["weighted", "ratio"])
def test_search_by_index(postings, queries, index, formula):
    assert found_rows(search_indexed(index, queries, postings, 4, formula)) == plain_search(4, formula)


def test_words_of_a_term(spark, index):
    probes = ["ava", "scr", "a", "c+", "é🙂", "javax", LONG[50:80]]
    terms = spark.createDataFrame(list(enumerate(probes)), "term_id bigint, probe string")
    found = {(r["term_id"], r["name"][:10]) for r in find_words(spark, index, terms).collect()}
    words = {w for r in made_postings() for t in texts(r).values() for w in t.split()}
    expected = {(i, w[:10]) for i, p in enumerate(probes) for w in words if p in w and len(w) <= 32}
    assert {f for f in found if not f[1].startswith(" ")} == expected
    assert {f[0] for f in found if f[1].startswith(" ")} == {i for i, p in enumerate(probes) if p in LONG}


def test_few_terms_open_few_buckets(spark, postings, index):
    one = spark.createDataFrame([(0, "script")], "term_id bigint, probe string")
    plan = find_words(spark, index, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters") :].split("\n")[0]


def test_nothing_to_search(spark, postings, queries):
    none = postings.where("key < 0")
    path = new_path(spark, "index")
    build_index(none, path)
    for found in (scanning.count_many(queries, none), count_indexed(path, queries, none)):
        assert {r["n"] for r in found.collect()} == {0}
    assert search_indexed(path, queries, none, 3).collect() == scanning.search_many(queries, none, 3).collect() == []
    assert scanning.search_many(queries.where("query_id < 0"), postings, 3).collect() == []
    with pytest.raises(ValueError, match="unknown formula"):
        scanning.search_many(queries, postings, 3, "other")


@pytest.fixture(scope="module")
def stored(spark):
    rows = [
        (f"i{k}", f"Title {k % 7}", f"Company {k % 6}", ["Oslo", "Remote", "", None][k % 4], None, "python 100% sure" if k % 3 else "C", f"l{k}",
         ["s", None][k % 2], ["go"], datetime(2024, 1, 1 + k % 9) if k % 10 else None, None, True, k / 7)
        for k in range(60)
    ]
    return spark.createDataFrame(rows, POSTING)


@pytest.mark.parametrize(("words", "place", "limit"), [(["python"], None, 10), (["title 3", "go"], "o", 7), ([], None, 100), (["100%"], "remote", 50), (["nope"], None, 5)])
def test_searches_in_sql(spark, stored, words, place, limit):
    register_search_functions(spark, stored)
    spec = SearchSpec(keywords=words, location=place, limit=limit)
    plain = search_stored(stored, spec)
    array = "array(" + ", ".join(f"'{w}'" for w in words) + ")" if words else "CAST(array() AS ARRAY<STRING>)"
    arguments = f"{array}, {'NULL' if place is None else repr(place)}, {limit}"
    rows = spark.sql(f"SELECT * FROM search_stored({arguments})")
    assert rows.columns == POSTING.fieldNames()
    assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in plain.rows.collect())
    told = spark.sql(f"SELECT * FROM search_insights({arguments})")

    def some(df):
        return sorted((r["metric"], r["key"], r["n"]) for r in df.collect() if r["n"])

    assert some(told) == some(plain.insights)


def test_payload_paths(spark):
    payloads = [
        '{"a": {"t": "Title"}, "c": ["X", "Y"], "n": 3, "l": null}', '{"a": {"t": ""}, "c": ["X"]}', "no json", None,
        '{"a": {"t": "Other"}, "c": ["Z"], "n": {"k": 1}, "l": "u"}',
    ]
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "key int, payload string").withColumn(
        "fetched_at", F.lit(datetime(2024, 1, 1)).cast("timestamp")
    )
    paths = {"title": "$.a.t", "company": "$.c[0]", "salary": "$.n", "link": "$.l"}
    found = map_by_paths(raw, paths, "b", keep=["key"])
    rows = {r["key"]: (r["title"], r["company"], r["salary"], r["link"]) for r in found.collect()}
    assert rows == {0: ("Title", "X", "3", ""), 4: ("Other", "Z", '{"k":1}', "u")}
    # The paths read the result of one parse.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1

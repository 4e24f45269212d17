"""What grows with the tables: hits of queries, rows of a batch of pages, rows of a task of a merge."""

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.operators import holding, substrings
from jobloom.operators.matching import match_queries, score_many
from jobloom.session import new_path
from jobloom.sources import pages, store

TEXTS = "key bigint, title string, description string, company string, keywords array<string>"


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, ["Java", "java", "zzz"]), (2, ["work from home"]), (3, [""]), (4, None), (None, ["scala"])]
    return spark.createDataFrame(rows, "query_id bigint, keywords array<string>")


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [
        (7, "Java", "work from home", "c", ["go"]), (7, "none", "JavaScript, work from home", "c", None),
        (8, None, "scala java", None, None), (9, "Work", "from home", "", []),
        (None, "Scala", "work from home", "", []), (None, "scala", "x", "", []),
    ]
    return spark.createDataFrame(rows * 3, TEXTS)


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_rows_of_one_key_are_one_posting(asked, repeated, monkeypatch, cells):
    """Words count once a posting, terms that are checked on the texts in each row, and in none without a key."""
    monkeypatch.setattr(holding, "CELLS", cells)
    found = {(r.query_id, r.key): r.relevance for r in score_many(asked, repeated).collect()}
    assert found == {
        (1, 7): pytest.approx(4 / 3), (1, 8): pytest.approx(2 / 3), (2, 7): 6.0, (2, 9): 3.0,
        (3, 7): 12.0, (3, 8): 6.0, (3, 9): 6.0, (None, 8): 1.0, (None, None): 2.0,
    }
    pairs = sorted(map(tuple, match_queries(asked, repeated).collect()), key=str)
    assert pairs == sorted([k for k in found if k != (2, 9)], key=str)


def test_pairs_are_made_where_the_text_is(asked, repeated):
    for made in (match_queries(asked, repeated), score_many(asked, repeated, "weighted")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == 1


def test_passes_of_queries(asked, repeated, monkeypatch):
    whole = sorted(map(tuple, score_many(asked, repeated).collect()), key=str)
    monkeypatch.setattr(holding, "SENT_CHARS", 20)
    assert sorted(map(tuple, score_many(asked, repeated).collect()), key=str) == whole


def test_pages_of_a_batch_are_read_in_slices(spark, monkeypatch):
    sizes = [3, 0, 5, 20, 1, 1]
    batch = pa.RecordBatch.from_pydict({"html": ["x" * n or None for n in sizes]})
    monkeypatch.setattr(pages, "SLICE_BYTES", 8)
    assert [p.num_rows for p in pages._slices(batch)] == [3, 1, 2]
    html = "<div class=j><b>T</b><i>C</i></div>"
    rows = [(k if k % 3 else None, f"p{k}", "https://e.org/", html * (k % 4) or None) for k in range(40)]
    raw = spark.createDataFrame(rows, "n bigint, page string, url string, html string").coalesce(1)
    rules = {"jobContainer": ".j", "title": "b", "company": "i"}
    found = pages.extract_postings_html(raw, rules, F.lit("s"), F.lit("2024-01-01").cast("timestamp"), keep=["n", "page"])
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r.page, r.n, r.title, r.company) for r in found.collect()), key=str)
    assert got == sorted(((page, n, "T", "C") for n, page, _, h in rows for _ in range((h or "").count("<div"))), key=str)


def test_an_index_shuffles_lists_and_no_row_per_word(spark, monkeypatch):
    """A word is one row a segment, however many postings hold it; a search meets segments of bounded text."""
    monkeypatch.setattr(substrings, "SEGMENT_BYTES", 100)
    rows = [(k if k else None, "java dev", "work from home javac" if k % 2 else "x" * 40, None, ["go"]) for k in range(40)]
    postings = spark.createDataFrame(rows + rows[:5], TEXTS)
    path = new_path(spark, "index")
    substrings.build_index(postings, path)
    segments = spark.read.parquet(f"{path}/about").head()["segments"]
    words = spark.read.parquet(f"{path}/words")
    assert segments > 5 and words.where("name = 'java'").count() <= segments < 40
    assert words.where("name = 'java'").selectExpr("sum(size(keys))").head()[0] == 40
    asked = [(1, ["jav"]), (2, ["from home"]), (3, ["x" * 33]), (4, ["zz"]), (5, [""])]
    queries = spark.createDataFrame(asked, "query_id bigint, keywords array<string>")
    counts = {r.query_id: r.n for r in substrings.count_indexed(path, queries, postings).collect()}
    assert counts == {1: 40, 2: 20, 3: 19, 4: 0, 5: 39}


def test_grams_stay_where_they_are(spark):
    path = new_path(spark, "index")
    row = [(1, "java dev", "scala", None, None)]
    substrings.build_index(spark.createDataFrame(row, TEXTS), path)
    terms = spark.createDataFrame([(0, "jav"), (1, "a")], "term_id bigint, probe string")
    found = substrings._words_of(spark, path, terms)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    assert {tuple(r) for r in found.collect()} == {(0, "java"), (1, "java"), (1, "scala")}


def test_a_large_bucket_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(store, "ROWS_PER_TASK", 5)
    made = [(f"id{k}", datetime(2024, 1, 1 + k % 20)) for k in range(40)]
    path = new_path(spark, "store")
    store.upsert(spark, path, spark.createDataFrame(made, "id string, scraped_at timestamp"), buckets=1)
    files = store.manifest(spark, path).collect()
    assert len(files) > 3 and sum(f["n"] for f in files) == 40
    spans = sorted((f["first_at"], f["last_at"]) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))

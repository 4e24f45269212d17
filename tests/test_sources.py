"""Sources and sinks on small files and payloads."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from jobloom.plans.runs import export_run
from jobloom.schema import POSTING
from jobloom.sources import files, providers
from jobloom.sources.boards import read_boards
from jobloom.sources.feeds import read_feed_files, read_feed_rss
from jobloom.sources.pages import extract_postings_html, parse_selector
from jobloom.session import shared_folder

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


JOB = {"id": "1", "title": "Python Developer", "company": "TechCorp", "keywords": "python;django"}


@pytest.mark.parametrize(
    "content, titles",
    [
        (json.dumps([JOB, {**JOB, "id": "2", "keywords": ["a", "b"]}], indent=2), 2),
        (json.dumps({"jobs": [JOB]}), 1),
        (json.dumps({"jobs": []}), 0),
        (json.dumps({"other": 1}), 0),
        ("[]", 0),
        ("not json", 0),
    ],
)
def test_json_shapes(spark, tmp_path, content, titles):
    _write(tmp_path / "jobs.json", content)
    rows = files.read_postings_json(spark, str(tmp_path / "jobs.json")).orderBy("id").collect()
    assert len(rows) == titles
    if titles:
        assert rows[0].keywords == ["python", "django"]
    if titles == 2:
        assert rows[1].keywords == ["a", "b"]


def test_latest_snapshot(spark, tmp_path):
    def latest():
        return [r.title for r in files.latest_snapshot(spark, str(tmp_path)).collect()]

    tmp_path.joinpath("exports").mkdir()
    _write(tmp_path / "exports/readme.json", json.dumps([{"title": "other"}]))
    assert latest() == []
    _write(tmp_path / "exports/jobs_export_b.json", json.dumps([{"title": "old"}]))
    os.utime(tmp_path / "exports/jobs_export_b.json", (time.time() - 100,) * 2)
    _write(tmp_path / "exports/jobs_export_a.json", json.dumps([{"title": "new"}]))
    assert latest() == ["new"]
    _write(tmp_path / "exports/latest_jobs.json", json.dumps({"jobs": [{"title": "latest"}]}))
    assert latest() == ["latest"]
    _write(tmp_path / "data/jobs.json", "broken")
    assert latest() == ["latest"]
    _write(tmp_path / "data/jobs.json", json.dumps([{"title": "first"}]))
    assert latest() == ["first"]


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 'a "b", c', "  x ", None, "", "l\nine", "u", "s", ["k", "l"], None, None, None, 0.125)], POSTING
    )
    files.write_postings_csv(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    header, line = part.strip("\n").split("\n")
    assert header.startswith("ID,Title,Company") and header.count(",") == 14
    assert line == '1,"a ""b"", c",  x ,,,l ine,u,s,k; l,mid,false,0.12,,,false'


FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>
<item><title>Dev at Acme</title><description>in <![CDATA[<b>London</b>]]> &amp; more</description>
<link>http://x/1</link></item><item><title></title><description>none</description></item>
<item><description>no title</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>Go dev hiring: Zed Inc</title>
<summary>anywhere</summary><link href="http://y/2"/></entry></feed>"""


def test_feed_files(spark, tmp_path):
    _write(tmp_path / "a.rss", FEED)
    _write(tmp_path / "b.atom", ATOM)
    rss = read_feed_files(spark, str(tmp_path / "a.rss"), "board", now()).collect()
    assert [(r.title, r.company, r.location, r.link, r.salary) for r in rss] == [
        ("Dev at Acme", "acme in <b>london</b>", "London", "http://x/1", "")
    ]
    assert rss[0].is_active and rss[0].source == "board"
    atom = read_feed_files(spark, str(tmp_path / "b.atom"), "board", now(), "atom").collect()
    assert [(r.company, r.location, r.link) for r in atom] == [("zed inc anywhere", "Anywhere", "http://y/2")]


def test_broken_feed_gives_nothing(spark):
    feeds = spark.createDataFrame([("s", FEED), ("s", "<rss><channel><item>")], "source string, body string")
    assert read_feed_rss(feeds, now()).count() == 1


PAGE = """<html><body><ul class="jobs big"><li class="job new" data-id='7'><h2><a href="/j/1?x=1">Title &amp; One</a></h2>
<span class=company> Acme <b>Inc</b></span><p>first<p>second</li><li class=job><h2>No company</h2></li>
<li class="job"><h2>Two</h2><div class="company">B</div><img src=x><a href=rel>l</a></ul>
<div class="job"><h2>Out</h2><i class="company">C</i></div></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([("https://x.org/a/b", PAGE), ("https://y.org", ""), ("u", None)], "url string, html string")
    selectors = {
        "jobContainer": "ul.jobs li.job, [data-none]", "title": "h2 a, h2", "company": ".company",
        "description": "p", "link": "a",
    }
    rows = extract_postings_html(pages, selectors, F.lit("board"), now()).orderBy("title").collect()
    assert [(r.title, r.company, r.description, r.link) for r in rows] == [
        ("Title & One", "Acme Inc", "first", "https://x.org/j/1?x=1"),
        ("Two", "B", "", "https://x.org/a/rel"),
    ]
    assert extract_postings_html(pages, {**selectors, "jobContainer": "li[data-id='7']"}, F.lit("b"), now()).count() == 1


def test_selectors():
    (first, second), = [parse_selector("td.company h2, #top")]
    assert [s["tag"] for s in first] == ["td", "h2"] and second[0]["attrs"] == [("id", "top")]
    with pytest.raises(ValueError):
        parse_selector("a > b")


def _map(spark, name, payload):
    raw = spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload),)], "payload string")
    return providers.provider(name)(raw.withColumn("fetched_at", now())).collect()


def test_provider_records(spark):
    row, = _map(spark, "reed", {"results": [{"jobId": 5, "jobTitle": " T ", "minimumSalary": 10.0}], "totalResults": 9})
    assert (row.id, row.title, row.salary, row.company, row.is_active, row.updated_at) == (
        "reed_5", " T ", "£10+ per year", "", False, None,
    )
    assert _map(spark, "reed", "broken") == []
    assert _map(spark, "jsearch", {"status": "ERROR", "data": [{"job_id": "1"}]}) == []
    row, = _map(spark, "jsearch", {"status": "OK", "data": [{"job_id": "1", "job_employment_type": "PART", "job_title": "x",
                "job_posted_at_datetime_utc": "2024-01-05T06:00:00.000Z"}]})
    assert (row.id, row.location, row.description, str(row.scraped_at)) == (
        "jsearch_1", "Not specified", "[PART] ", "2024-01-05 06:00:00",
    )
    row, = _map(spark, "remoteok-api", [{"slug": "s", "position": " P ", "company": "c", "tags": ["a"]}])
    assert (row.title, row.link, row.keywords, row.is_active) == ("P", "https://remoteok.io/remote-jobs/s", ["a"], True)
    item = {"PositionTitle": "t", "OrganizationName": "o", "PositionRemuneration": [{"MinimumRange": "1", "MaximumRange": "2"}],
            "ApplyURI": [], "PositionURI": "p"}
    row, = _map(spark, "usajobs-api", {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": item}]}})
    assert (row.salary, row.link, row.location) == ("$1 - $2", "p", "")
    assert len(_map(spark, "generic", {"jobs": [{"title": "t", "company": "c"}, {"title": "t"}]})) == 1
    assert len(_map(spark, "hn-jobs-api", [{"title": "t", "text": ""}, {"title": "t", "text": "x"}])) == 1


def test_provider_registry():
    assert "reed" in providers.providers()
    with pytest.raises(ValueError):
        providers.register_provider("reed", providers.map_reed)
    with pytest.raises(KeyError):
        providers.provider("none")


def test_boards(spark, tmp_path):
    config = {
        "jobBoards": [
            {"name": "a", "enabled": True, "baseUrl": "http://a", "searchParams": {"q": "{keywords}"}},
            {"name": "b", "enabled": False}, {"name": "c"},
            {"name": "d", "enabled": True, "scrapingMethod": "rss", "maxResults": 3, "rssConfig": {"feedUrl": "u", "keywords": ["x"]}},
        ],
        "globalSettings": {"maxResultsPerBoard": 75},
    }
    _write(tmp_path / "boards.json", json.dumps(config, indent=1))
    rows = {r.name: r for r in read_boards(spark, str(tmp_path / "boards.json")).collect()}
    assert {n: (r.method, r.max_results) for n, r in rows.items()} == {"a": ("scraping", 75), "d": ("rss", 3)}
    assert rows["a"].search_params == {"q": "{keywords}"} and rows["d"].feed.keywords == ["x"]


def test_export_errors(spark, tmp_path):
    files.write_store(spark.createDataFrame([], POSTING), str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no jobs"):
        export_run(spark, str(tmp_path / "empty"), str(tmp_path / "o"), ["csv"], now())
    with pytest.raises(ValueError, match="unsupported"):
        export_run(spark, str(tmp_path / "empty"), str(tmp_path / "o"), ["xml"], now())


def test_upsert(spark):
    def rows(*items):
        return spark.createDataFrame(
            [(i, t, u) for i, t, u in items], "id string, title string, updated string"
        ).select("id", "title", F.col("updated").cast("timestamp").alias("updated_at"),
                 F.lit(None).cast("timestamp").alias("scraped_at"))

    old = rows(("1", "old", "2024-01-01"), ("2", "old", "2024-01-03"), ("3", "old", "2024-01-01"))
    new = rows(("1", "new", "2024-01-02"), ("2", "new", "2024-01-02"), ("3", "new", "2024-01-01"), ("4", "new", None))
    from jobloom.operators.merge import upsert_postings

    found = {r.id: r.title for r in upsert_postings(new, old).collect()}
    assert found == {"1": "new", "2": "old", "3": "new", "4": "new"}


def test_jdbc_options():
    assert files.jdbc_options("jdbc:x", "jobs")["dbtable"] == "jobs"
    split = files.jdbc_options("jdbc:x", "jobs", "created_at", "2024-01-01", "2024-02-01", 8)
    assert split["numPartitions"] == "8" and split["partitionColumn"] == "created_at"
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x", "jobs", "created_at")


def test_shared_folder_is_the_one_named(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

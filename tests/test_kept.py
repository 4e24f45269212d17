"""What is kept for later: ordered tables, sketches, hourly panes, and the two-key stream."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.operators import sketches as S
from jobloom.operators.calls import source_alerts
from jobloom.operators.merge import dedup_postings
from jobloom.session import new_path
from jobloom.sources.ordered import ordered_page_info, ordered_parts, read_page, write_ordered
from jobloom.streaming import streams as X

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ordered(spark):
    """100,000 rows of ten scores, ties broken by the key."""
    path = new_path(spark, "ordered")
    rows = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(10)).alias("score"), "id")
    write_ordered(rows, [F.desc("score"), F.asc("id")], path, parts=16)
    expected = sorted(map(tuple, rows.collect()), key=lambda r: (-r[0], r[1]))
    return path, expected


@pytest.mark.parametrize(("limit", "offset"), [(25, 0), (25, 24_975), (7, 99_990), (1, 99_999), (3, 100_000), (0, 5), (40_000, 30_000)])
def test_pages(spark, ordered, limit, offset):
    path, expected = ordered
    found = sorted((r["rank"], r["score"], r["id"]) for r in read_page(spark, path, limit, offset).collect())
    page = expected[offset : offset + limit]
    assert found == [(offset + i + 1, *row) for i, row in enumerate(page)]


def test_a_far_page_opens_two_parts_at_most(spark, ordered):
    path, _ = ordered
    assert ordered_parts(spark, path).count() == 16
    for number in range(0, 4000, 97):
        found = read_page(spark, path, 25, 25 * number)
        assert len({f.split("_part=")[1].split("/")[0] for f in found.inputFiles()}) <= 2
    plan = read_page(spark, path, 25, 25_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "_place" in plan[plan.index("PushedFilters") :]


def test_ordered_ties_nulls_and_nothing(spark):
    path = new_path(spark, "ordered")
    rows = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (2, None)], "n int, _t string")
    write_ordered(rows, [F.desc_nulls_first("n"), F.asc("_t")], path)
    found = sorted(read_page(spark, path, 10).collect(), key=lambda r: r["rank"])
    assert [(r["n"], r["_t"], r["rank"]) for r in found] == [(None, "b", 1), (2, None, 2), (1, "a", 3), (1, "a", 4)]
    empty = new_path(spark, "ordered")
    write_ordered(rows.where("n > 5"), [F.asc("n")], empty)
    assert read_page(spark, empty, 10).collect() == []
    assert ordered_page_info(spark, empty, 10).head()["total"] == 0


def offers(spark, n, start=0):
    rows = spark.range(start, start + n)
    return rows.select(
        F.lit(START).cast("timestamp").alias("scraped_at") + F.make_dt_interval(days=(F.col("id") % 10).cast("int")),
        F.lit("s").alias("source"), F.col("id").cast("string").alias("company"),
        F.when(F.col("id") % 2 == 0, (F.col("id") % 7).cast("string")).alias("location"),
    ).toDF("scraped_at", "source", "company", "location")


def test_merged_sketches_equal_one(spark):
    whole = S.distinct_sketches(offers(spark, 20_000))
    parts = [S.distinct_sketches(offers(spark, 12_000)), S.distinct_sketches(offers(spark, 12_000, 8_000))]
    merged = S.merge_distinct(*parts)
    one, two = (S.distinct_over(t).head() for t in (whole, merged))
    # Rows in both parts count twice, values once.
    assert (one["n"], two["n"]) == (20_000, 24_000)
    assert (one["company"], one["location"]) == (two["company"], two["location"])
    assert one["location"] == 7 and abs(one["company"] - 20_000) <= 20_000 * 4 * 1.04 / 2 ** (S.LG / 2)


def test_sketches_of_a_range_of_days_and_of_nothing(spark):
    told = S.distinct_sketches(offers(spark, 1_000))
    some = S.distinct_over(told, ["source"], F.lit(date(2024, 1, 2)), F.lit(date(2024, 1, 3))).head()
    assert (some["n"], some["company"], some["location"]) == (200, 200, 7)
    none = S.distinct_over(told.where("n < 0")).head()
    assert (none["n"], none["company"]) == (0, 0)
    blank = offers(spark, 10).withColumn("company", F.lit(None).cast("string"))
    assert S.distinct_over(S.distinct_sketches(blank)).head()["company"] == 0


def call_rows(spark, n):
    return spark.range(n).select(
        F.lit("p").alias("provider"), (F.lit(START).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 600).cast("int"))).alias("called_at"),
        (F.col("id") % 10 > 0).alias("ok"), F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("latency_ms"),
    )


def test_quantiles_of_a_hot_provider(spark):
    calls = call_rows(spark, 200_000)
    told = S.latency_sketches(calls)
    assert told.agg(F.max(F.length("latency"))).head()[0] < 20_000
    row = S.latency_over(told, ["provider"], (0.1, 0.5, 0.95)).head()
    values = sorted(r[0] for r in calls.select("latency_ms").collect())
    assert (row["n"], row["failed"]) == (200_000, 20_000)
    for share, value in zip((0.1, 0.5, 0.95), row["quantiles"], strict=True):
        rank = sum(v <= value for v in values) / len(values)
        assert abs(rank - share) <= S.RANK_ERROR


def test_alerts_from_the_sketches_of_two_runs(spark):
    calls = call_rows(spark, 50_000)
    runs = [S.latency_sketches(calls.where(c)) for c in ("latency_ms < 40000", "latency_ms >= 40000")]
    limits = {"max_failure_rate": 0.05, "max_latency_ms": 90_000.0}
    found = {r["window_start"]: r for r in S.alerts_from_sketches(runs[0].unionByName(runs[1]), **limits).collect()}
    exact = {r["window_start"]: r for r in source_alerts(calls, **limits).collect()}
    assert found.keys() == exact.keys() and len(found) == 10
    for at, row in found.items():
        assert (row["n"], row["failure_rate"], row["failing"]) == (exact[at]["n"], exact[at]["failure_rate"], exact[at]["failing"])
        # Latencies are spread evenly, so an error of the rank is one of the value.
        assert abs(row["p95_latency_ms"] - exact[at]["p95_latency_ms"]) <= 100_000 * (S.RANK_ERROR + 0.01)
        assert row["slow"] == exact[at]["slow"]


def test_panes_add_up(spark):
    seen = [START + timedelta(hours=h, minutes=m) for h, m in [(0, 0), (0, 59), (5, 1), (23, 0), (30, 30)]]
    rows = spark.createDataFrame([(t,) for t in seen], "scraped_at timestamp")
    hour = F.window("scraped_at", "1 hour")
    panes = rows.groupBy(hour).agg(F.count("*").alias("n")).select(F.col("window.end").alias("hour_end"), "n")
    found = {r["as_of"]: r["n"] for r in X.recent_from_hours(panes).collect()}
    for hours in range(1, 60):
        at = START + timedelta(hours=hours)
        expected = sum(at - timedelta(hours=24) <= t < at for t in seen)
        assert found.get(at, 0) == expected


@pytest.mark.parametrize("files_at_once", [1, 3])
def test_two_key_stream_equals_the_batch(spark, tmp_path, files_at_once):
    rows = [(f"id{i % 7}" if i < 14 else f"id{i}", f"Title {i % 5}" if i % 2 else f"TITLE {i % 5}", "c", START + timedelta(hours=i)) for i in range(30)]
    schema = "id string, title string, company string, scraped_at timestamp"
    for number in range(6):
        part = spark.createDataFrame(rows[number * 5 : number * 5 + 5], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.createDataFrame([], schema)
    arriving = X.read_stream(spark, str(tmp_path / "in"), like, max_files=files_at_once)
    found = X.run_available(X.stream_dedup_both(arriving), "both")
    batch = dedup_postings(spark.createDataFrame(rows, schema), [F.asc("scraped_at")])

    def names(df):
        return sorted((r[0].lower(), r[1]) for r in df.select("title", "company").collect())

    assert names(found) == names(batch)

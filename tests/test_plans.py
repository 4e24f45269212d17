"""The plans that matter at scale: pruning, push-down, one scan per report."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.catalog.base import full_postings, offers
from jobloom.operators import stats as A
from jobloom.operators.filters import SearchSpec, filter_spec
from jobloom.operators.matching import score_many, term_hits
from jobloom.operators.ranking import global_rank
from jobloom.session import new_path, spread
from jobloom.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    path = new_path(spark, "store")
    rows = full_postings(spark, SF)
    stamps = {c: F.col(c).cast("timestamp") for c in ("scraped_at", "updated_at")}
    files.write_store(rows.withColumns(stamps), path)
    return files.read_store(spark, path)


def plan_of(df, run=False):
    if run:
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_filters_reach_the_scan(store):
    spec = SearchSpec(
        keywords=["python"], sources=["src1", "src2"], date_from=datetime(2024, 1, 2), is_active=True
    )
    plan = plan_of(filter_spec(store, spec).select("id"))
    assert "PartitionFilters: [source" in plan
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "EqualTo(is_active,true)" in pushed and "GreaterThanOrEqual(scraped" in pushed


def test_unused_columns_are_not_read(store):
    plan = plan_of(A.stats_top_locations(store))
    assert "ReadSchema: struct<location:string>" in plan
    assert "TakeOrderedAndProject" in plan
    assert "description" not in plan_of(A.insights_search(store))


@pytest.mark.parametrize("report", [A.analyze_postings, A.insights_search, A.insights_agent])
def test_reports_read_their_input_once(store, report):
    plan = plan_of(report(store), run=True)
    assert plan.count("FileScan parquet") == 1


def test_stats_and_hybrid_read_once(store):
    as_of = F.lit(datetime(2024, 1, 31))
    assert plan_of(A.posting_stats(store, as_of), run=True).count("FileScan parquet") == 1
    marked = store.withColumn("source_type", F.lit("database"))
    assert plan_of(A.insights_hybrid(marked), run=True).count("FileScan parquet") == 1


def test_rank_needs_no_single_task_sort(store):
    plan = plan_of(global_rank(store.select("id", "relevance"), "relevance", "id"))
    window = plan[: plan.index("BroadcastHashJoin") if "BroadcastHashJoin" in plan else None]
    assert "Exchange hashpartitioning(_part" in plan and "Sort [id" not in window


def test_term_search_never_pairs_all(spark, store):
    terms = spark.createDataFrame([("python",), ("react native",)], "term string")
    plan = plan_of(term_hits(store, terms, "id"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_stay_with_their_posting(spark, store):
    """After the hits are partitioned by posting, scoring them has no exchange of its own."""
    queries = spark.createDataFrame([(1, ["python", "go"]), (2, ["java"])], "query_id int, keywords array<string>")
    plan = plan_of(score_many(queries, store, key="id"))
    top = plan[: plan.index("REPARTITION_BY_COL")]
    assert top.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" not in top


def test_offers_join_without_hints(spark):
    plan = offers(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan


def test_spread_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores

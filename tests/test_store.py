"""The versioned store: what a merge rewrites, what a reader opens, and what a broken run leaves."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.operators.filters import SearchSpec
from jobloom.schema import POSTING
from jobloom.session import new_path
from jobloom.sources import store

START = datetime(2024, 1, 1)


def rows_of(spark, ids, salary="1", day=None, updated=0, location=None):
    """One posting per id; id n is seen on day n unless a day is given."""
    made = [
        (
            f"id{i}", f"t{i}", "c", location or f"Town {i % 3}", salary, None, f"l{i}", "s", ["a"],
            START + timedelta(days=i if day is None else day, hours=3), START + timedelta(days=updated), True, 0.0,
        )
        for i in ids
    ]
    return spark.createDataFrame(made, POSTING)


def salaries(df):
    return {r["id"]: r["salary"] for r in df.select("id", "salary").collect()}


def files(spark, path, version=None):
    return {r["path"]: r["bucket"] for r in store.manifest(spark, path, version).collect() if r["path"]}


@pytest.fixture
def path(spark):
    return new_path(spark, "store")


def test_a_merge_leaves_the_files_of_other_buckets(spark, path):
    store.upsert(spark, path, rows_of(spark, range(40)), buckets=8)
    before = files(spark, path)
    assert set(before.values()) == set(range(8))
    store.upsert(spark, path, rows_of(spark, [3], "2", updated=1))
    after = files(spark, path)
    changed = {before[p] for p in before.keys() - after.keys()}
    assert len(changed) == 1 and {after[p] for p in after.keys() - before.keys()} == changed
    assert len(before.keys() & after.keys()) == 7
    found = salaries(store.read_version(spark, path))
    assert len(found) == 40 and found["id3"] == "2" and found["id4"] == "1"


def test_the_later_row_wins_and_the_batch_on_a_tie(spark, path):
    store.upsert(spark, path, rows_of(spark, range(3), "old", updated=5), buckets=2)
    store.upsert(spark, path, rows_of(spark, [0], "early", updated=4))
    store.upsert(spark, path, rows_of(spark, [1], "tie", updated=5))
    store.upsert(spark, path, rows_of(spark, [2], "late", updated=6).unionByName(rows_of(spark, [2], "mid", updated=5)))
    assert salaries(store.read_version(spark, path)) == {"id0": "old", "id1": "tie", "id2": "late"}


def test_old_versions_stay(spark, path):
    store.upsert(spark, path, rows_of(spark, range(4), "1"), buckets=2)
    store.upsert(spark, path, rows_of(spark, range(2, 6), "2", updated=1))
    assert salaries(store.read_version(spark, path, version=1)) == {f"id{i}": "1" for i in range(4)}
    assert {(r["version"], r["n"]) for r in store.history(spark, path).collect()} == {(1, 4), (2, 6)}
    with pytest.raises(ValueError, match="no version 3"):
        store.read_version(spark, path, version=3)


def test_a_run_that_ends_before_its_manifest_changes_nothing(spark, path, monkeypatch):
    store.upsert(spark, path, rows_of(spark, range(10)), buckets=4)
    before = files(spark, path)

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(spark, path, rows_of(spark, range(20), "2", updated=1))
    assert files(spark, path) == before
    assert salaries(store.read_version(spark, path)) == {f"id{i}": "1" for i in range(10)}
    store.upsert(spark, path, rows_of(spark, range(5), "3", updated=1))
    assert salaries(store.read_version(spark, path)) == {f"id{i}": "3" if i < 5 else "1" for i in range(10)}


def test_the_second_writer_of_a_version_is_told(spark, path):
    store.upsert(spark, path, rows_of(spark, range(4)), buckets=2)
    listed = store.manifest(spark, path)
    store.upsert(spark, path, rows_of(spark, [7]))
    with pytest.raises(store.StoreConflict):
        store.commit(spark, path, 2, listed)
    assert len(salaries(store.read_version(spark, path))) == 5


def test_a_day_opens_the_files_of_its_stretch_of_time(spark, path):
    store.upsert(spark, path, rows_of(spark, range(60)), buckets=2, rows_per_file=5)
    everything = files(spark, path)
    assert len(everything) >= 12
    spec = store.day_spec(date(2024, 1, 11))
    opened = [r["path"] for r in store.files_for(spark, path, spec).collect()]
    assert 1 <= len(opened) <= 2
    found = store.read_version(spark, path, spec)
    assert salaries(found) == {"id10": "1"}
    assert {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {p.rsplit("/", 1)[1] for p in opened}


def test_a_location_opens_the_files_that_list_it(spark, path):
    for town, ids in (("Oslo", range(10)), ("Bergen", range(10, 12))):
        store.upsert(spark, path, rows_of(spark, ids, location=town), buckets=8)
    opened = store.files_for(spark, path, SearchSpec(location="berg")).count()
    assert opened <= 2 < len(files(spark, path))
    assert set(salaries(store.read_version(spark, path, SearchSpec(location="berg")))) == {"id10", "id11"}


def test_files_with_many_locations_are_opened(spark, path, monkeypatch):
    monkeypatch.setattr(store, "LISTED_LOCATIONS", 1)
    store.upsert(spark, path, rows_of(spark, range(9)), buckets=1)
    assert store.manifest(spark, path).head()["locations"] is None
    assert set(salaries(store.read_version(spark, path, SearchSpec(location="town 1")))) == {"id1", "id4", "id7"}


def test_absent_times_and_locations(spark, path):
    blank = rows_of(spark, range(2)).withColumns(
        {"scraped_at": F.lit(None).cast("timestamp"), "location": F.lit(None).cast("string")}
    )
    store.upsert(spark, path, blank, buckets=2)
    assert store.read_version(spark, path).count() == 2
    assert store.read_version(spark, path, store.day_spec(date(2024, 1, 1))).count() == 0
    assert store.read_version(spark, path, SearchSpec(location="x")).count() == 0


def test_ids_open_their_buckets(spark, path):
    store.upsert(spark, path, rows_of(spark, range(40)), buckets=8)
    found = store.read_ids(spark, path, ["id5", "none"])
    assert set(salaries(found)) == {"id5"}
    assert len(found.inputFiles()) <= 2
    assert store.read_ids(spark, path, []).count() == 0


def test_empty_batches_and_stores(spark, path):
    empty = spark.createDataFrame([], POSTING)
    assert store.read_version(spark, path).count() == 0
    assert store.upsert(spark, path, empty, buckets=4) == 1
    assert store.upsert(spark, path, rows_of(spark, range(3)), buckets=99) == 2
    assert store.manifest(spark, path).head()["buckets"] == 4
    before = files(spark, path)
    assert store.upsert(spark, path, empty) == 3
    assert files(spark, path) == before


def test_rows_without_id_and_more_columns(spark, path):
    rows = rows_of(spark, range(2)).withColumn("bucket", F.lit("own")).withColumn("path", F.lit("own"))
    store.upsert(spark, path, rows.unionByName(rows.withColumn("id", F.lit(None).cast("string"))), buckets=4)
    found = store.read_version(spark, path)
    assert found.columns == POSTING.fieldNames()
    assert sorted(str(r["id"]) for r in found.collect()) == ["None", "id0", "id1"]


def test_a_repeated_merge_gives_the_same_rows(spark, path):
    batch = rows_of(spark, range(12))
    store.upsert(spark, path, batch, buckets=4)
    store.upsert(spark, path, batch)
    assert salaries(store.read_version(spark, path)) == {f"id{i}": "1" for i in range(12)}

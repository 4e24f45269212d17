"""What a merge leaves on disk beside the store's own files, and that its passes give the same rows."""

from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jobloom.operators.merge import upsert_postings
from jobloom.schema import POSTING
from jobloom.session import new_path
from jobloom.sources import store

START = datetime(2024, 1, 1)


def rows_of(spark, ids, salary, updated):
    """Rows that come twice, times that tie, rows without id and without times."""
    made = [
        (None if i % 9 == 0 else f"id{i}", f"t{i}", "c", None, salary, None, f"l{i}", "s", None if i % 4 else ["a", None],
         START + timedelta(days=i % 5), None if i % 7 == 0 else START + timedelta(days=(updated + i) % 3), True, 0.5)
        for i in [*ids, *list(ids)[::3]]
    ]
    return spark.createDataFrame(made, POSTING)


def shown(df):
    return sorted(map(str, df.collect()))


def test_passes_are_whole_slots(monkeypatch):
    monkeypatch.setattr(store, "SLOTS", 4)
    monkeypatch.setattr(store, "ROWS_PER_PASS", 10)
    assert store._passes({0: 3, 4: 3, 1: 4, 2: 25, 6: 1, 7: 1}) == [[0, 4, 1], [2, 6], [7]]
    assert store._passes({}) == []


def test_a_merge_in_passes(spark, monkeypatch):
    first, second = rows_of(spark, range(60), "1", 0), rows_of(spark, range(30, 90), "2", 1)
    expected = upsert_postings(second, upsert_postings(first, spark.createDataFrame([], POSTING)))
    shared, path = Path(spark.conf.get("spark.checkpoint.dir")), new_path(spark, "store")
    left = {p for p in shared.rglob("*") if p.is_file()}
    sizes, write = [], store._write_files

    def noted(rows, folder, buckets, rows_per_file, n):
        sizes.append(n)
        write(rows, folder, buckets, rows_per_file, n)

    monkeypatch.setattr(store, "_write_files", noted)
    monkeypatch.setattr(store, "ROWS_PER_PASS", 20)
    store.upsert(spark, path, first, buckets=16)
    assert len(sizes) >= 4 and sum(sizes) == 80
    sizes.clear()
    store.upsert(spark, path, second)
    assert len(sizes) >= 4
    assert shown(store.read_version(spark, path)) == shown(expected.select(POSTING.fieldNames()))
    # The batch set aside is gone, and there is no copy of it among the checkpoints.
    new = {p for p in shared.rglob("*") if p.is_file()} - left
    assert new and all(p.is_relative_to(path.removeprefix("file:")) for p in new)
    codecs = {pq.ParquetFile(p).metadata.row_group(0).column(0).compression for p in new if p.name.endswith(".parquet")}
    assert codecs == {"ZSTD"}


def test_a_failed_merge_leaves_nothing_aside(spark, monkeypatch):
    path, shared = new_path(spark, "store"), Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("batch-*"))

    def failing(*args):
        raise OSError("no disk")

    monkeypatch.setattr(store, "_merge", failing)
    with pytest.raises(OSError, match="no disk"):
        store.upsert(spark, path, rows_of(spark, range(5), "1", 0).withColumn("more", F.lit(1)), buckets=4)
    assert set(shared.glob("batch-*")) == before and store.manifest(spark, path).count() == 0

"""A versioned store of postings: files by hash bucket of the id, named by one manifest a version.

A version is a manifest, a file with a row per data file: its bucket, path, rows, range of times
and, if they are few, its locations. An upsert reads and rewrites only the buckets that its batch
falls into, as new files, and becomes the next version when the manifest file appears; files of
other buckets are named again as they are. A run that ends before that leaves the version before
it, and files that no manifest names. Old versions stay readable.

Rows of a bucket are sorted by time and cut into files of ``rows_per_file`` rows, so a file covers
a stretch of time. A reader with a time range or a location passes over the files that the
manifest rules out; what it opens has Parquet statistics, and a Bloom filter on the id.

A batch is read once and set aside, compressed, by groups of buckets (slots). The slots are merged
one after the other, and what a slot left on disk is freed before the next, so a merge needs the
store's own files, the batch and the exchanges of one slot. A task of it writes a stretch of buckets
and times of at most about ``ROWS_PER_TASK`` rows, so a large bucket is several tasks. The number of buckets is fixed by the first version. Manifests are as long as there are files and are read by the driver,
as Spark itself lists the files of a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.filters import SearchSpec, filter_spec, like_pattern
from jobloom.operators.merge import upsert_postings
from jobloom.schema import POSTING, POSTING_COLUMNS, as_posting
from jobloom.session import free_exchanges, new_path, remove_folder

BUCKETS = 64
ROWS_PER_FILE = 200_000
ROWS_PER_TASK = 20_000
# A merge is done in passes of whole slots: about so many rows each, a slot at least.
SLOTS = 16
ROWS_PER_PASS = 40_000
# A file with more locations than this cannot be passed over by location.
LISTED_LOCATIONS = 50

MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("buckets", T.LongType()),
        T.StructField("bucket", T.LongType()),
        # below the folder of the store, so that it can be moved
        T.StructField("path", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_at", T.TimestampType()),
        T.StructField("last_at", T.TimestampType()),
        T.StructField("locations", T.ArrayType(T.StringType())),
    ]
)
_FILE = MANIFEST.fieldNames()[1:]


class StoreConflict(RuntimeError):
    """Another writer has made the version this one was about to make."""


def _manifest_files(spark: SparkSession, path: str) -> dict[int, str]:
    """The manifest file of each version, by a listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.json")
    try:
        # What a writer has not finished lies in a folder that Spark does not list.
        listed = found.load(f"{path}/manifests").select("path").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = []
    return {int(r["path"].rsplit("/", 2)[1]): r["path"] for r in listed}


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a version, the last one if none is named; no rows where there is no store yet."""
    files = _manifest_files(spark, path)
    if version is None and not files:
        return spark.createDataFrame([], MANIFEST)
    if version is not None and version not in files:
        raise ValueError(f"no version {version} in {path}")
    return spark.read.schema(MANIFEST).json(files[max(files) if version is None else version])


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, files, n): the versions of a store, their files and rows."""
    files = list(_manifest_files(spark, path).values())
    listed = spark.read.schema(MANIFEST).json(files) if files else spark.createDataFrame([], MANIFEST)
    return listed.groupBy("version").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )


def _may_hold(spec: SearchSpec) -> Column:
    """Whether a file can hold a row that the search keeps, by its times and locations."""
    tests = F.lit(True)
    if spec.date_from is not None:
        tests = tests & (F.col("last_at") >= F.lit(spec.date_from))
    if spec.date_to is not None:
        tests = tests & (F.col("first_at") <= F.lit(spec.date_to))
    if spec.location:
        pattern = like_pattern(spec.location)
        fits = F.exists("locations", lambda at: at.ilike(pattern))
        tests = tests & (F.col("locations").isNull() | fits)
    return tests


def _read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    names = sorted(f"{path}/{r['path']}" for r in files.where(F.col("path").isNotNull()).select("path").collect())
    return spark.read.schema(POSTING).parquet(*names) if names else spark.createDataFrame([], POSTING)


def files_for(spark: SparkSession, path: str, spec: SearchSpec, version: int | None = None) -> DataFrame:
    """The manifest rows of the files that a search has to open."""
    return manifest(spark, path, version).where(F.col("path").isNotNull() & _may_hold(spec))


def read_version(
    spark: SparkSession, path: str, spec: SearchSpec | None = None, version: int | None = None
) -> DataFrame:
    """The postings of a version; with a search, those it keeps, from the files that can hold them."""
    if spec is None:
        return _read_files(spark, path, manifest(spark, path, version))
    return filter_spec(_read_files(spark, path, files_for(spark, path, spec, version)), spec)


def read_ids(spark: SparkSession, path: str, ids: Sequence[str], version: int | None = None) -> DataFrame:
    """The postings with the given ids, from their buckets; Bloom filters pass over row groups."""
    files = manifest(spark, path, version)
    head = files.select("buckets").head()
    if head is None or not ids:
        return spark.createDataFrame([], POSTING)
    asked = spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(head["buckets"]).alias("bucket"))
    return _read_files(spark, path, files.join(asked, "bucket", "left_semi")).where(F.col("id").isin(list(ids)))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _write_files(rows: DataFrame, folder: str, buckets: int, rows_per_file: int, n: int) -> None:
    """``n``: the rows at most, which says how many tasks there are; each has a stretch of the order."""
    order = ["bucket", "scraped_at", "id"]
    (
        rows.select(*POSTING_COLUMNS, _bucket(buckets).alias("bucket"))
        .repartitionByRange(max(1, -(-n // min(rows_per_file, ROWS_PER_TASK))), *order)
        .sortWithinPartitions(*order)
        .write.mode("append").partitionBy("bucket")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#id", "true")
        # Else each file has a filter of 1 MB.
        .option("parquet.bloom.filter.expected.ndv#id", 2 * min(rows_per_file, ROWS_PER_TASK))
        .parquet(folder)
    )


def _set_aside(batch: DataFrame, buckets: int, folder: str) -> dict[int, int]:
    """Write a batch by slot, without an exchange; the rows of each bucket."""
    bucket = _bucket(buckets)
    parts = batch.withColumns({"bucket": bucket, "slot": bucket % SLOTS}).write.partitionBy("slot")
    parts.option("compression", "zstd").parquet(folder)
    rows = batch.sparkSession.read.schema("bucket int").parquet(folder)
    return {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most a row per bucket


def _passes(rows: Mapping[int, int]) -> list[list[int]]:
    """The buckets, of so many rows each, in passes of whole slots."""
    passes, size = [], ROWS_PER_PASS
    for slot in sorted({bucket % SLOTS for bucket in rows}):
        some = sorted(bucket for bucket in rows if bucket % SLOTS == slot)
        more = sum(rows[bucket] for bucket in some)
        if size + more > ROWS_PER_PASS:
            passes.append([])
            size = 0
        passes[-1] += some
        size += more
    return passes


def _merge(
    spark: SparkSession, path: str, folder: str, aside: str, old: DataFrame, rows: Mapping[int, int], buckets: int,
    rows_per_file: int,
) -> None:
    """One pass: the buckets of ``rows``, from the batch set aside and the old files."""
    slots = [f"{aside}/slot={slot}" for slot in sorted({bucket % SLOTS for bucket in rows})]
    batch = spark.read.schema(POSTING).parquet(*slots)
    merged = upsert_postings(batch, _read_files(spark, path, old.where(F.col("bucket").isin(list(rows)))))
    _write_files(merged, f"{path}/{folder}", buckets, rows_per_file, sum(rows.values()))
    for slot in slots:
        remove_folder(spark, slot)


def _described(spark: SparkSession, path: str, folder: str, buckets: int) -> DataFrame:
    """A manifest row per file of a folder, from its times and locations alone."""
    at = F.col("_metadata.file_path")
    # An absent location matches no search, so it need not be listed.
    locations = F.collect_set("location")
    described = (
        spark.read.schema(POSTING)
        .option("recursiveFileLookup", True)
        .parquet(f"{path}/{folder}")
        .groupBy(F.regexp_extract(at, f"{folder}/bucket=[0-9]+/[^/]+$", 0).alias("path"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("scraped_at").alias("first_at"),
            F.max("scraped_at").alias("last_at"),
            F.when(F.size(locations) <= LISTED_LOCATIONS, F.array_sort(locations)).alias("locations"),
        )
    )
    return described.withColumns(
        {
            "buckets": F.lit(buckets).cast("bigint"),
            "bucket": F.regexp_extract("path", "/bucket=([0-9]+)/", 1).cast("bigint"),
        }
    ).select(_FILE)


def commit(spark: SparkSession, path: str, version: int, files: DataFrame) -> None:
    """Make a version visible: its manifest appears as one file, by one rename."""
    named = files.select(F.lit(version).cast("bigint").alias("version"), *_FILE)
    try:
        named.coalesce(1).write.json(f"{path}/manifests/{version:012d}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise StoreConflict(f"version {version} of {path} is there already") from error


def upsert(
    spark: SparkSession, path: str, batch: DataFrame, buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE
) -> int:
    """Merge a batch into the store and return the version this made.

    One row per id stays: the one updated last, the batch's on a tie; rows without id are one id.
    ``buckets`` counts for the first version only. An empty batch makes a version of the same
    files. Of two writers of a version the second gets ``StoreConflict`` and may run again; it
    is the folder of the manifest that tells them apart, so writers that end in the same instant
    need a lock of their own.
    """
    files = manifest(spark, path)
    head = files.select("version", "buckets").head()
    version, buckets = (head["version"] + 1, head["buckets"]) if head else (1, buckets)
    batch = as_posting(batch, **{c: F.col(c) for c in POSTING_COLUMNS if c in batch.columns})
    aside = new_path(spark, "batch")
    try:
        # What the batch is made from is read once.
        rows = _set_aside(batch, buckets, aside)
        hit = F.coalesce(F.col("bucket").isin(list(rows)), F.lit(False))
        named = files.where(~hit & F.col("path").isNotNull()).select(_FILE)
        folder, old = f"data/{version:012d}-{uuid.uuid4().hex}", files.where(hit)
        for r in old.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            rows[r["bucket"]] += r["n"]
        for some in _passes(rows):
            _merge(spark, path, folder, aside, old, {b: rows[b] for b in some}, buckets, rows_per_file)
            free_exchanges(spark)
    finally:
        remove_folder(spark, aside)
    if rows:
        named = named.unionByName(_described(spark, path, folder, buckets))
    elif named.isEmpty():
        # A version without files still tells the number of buckets.
        none = [F.lit(None).cast(MANIFEST[c].dataType).alias(c) for c in _FILE[1:]]
        named = spark.range(1).select(F.lit(buckets).cast("bigint").alias("buckets"), *none)
    commit(spark, path, version, named)
    return version


def day_spec(day: date, **more) -> SearchSpec:
    """A search for the postings of one day."""
    start = datetime(day.year, day.month, day.day)
    return SearchSpec(date_from=start, date_to=start + timedelta(days=1, microseconds=-1), **more)

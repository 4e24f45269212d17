"""Posting files, exports and the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions import values as V
from jobloom.functions.facets import experience_level, is_remote
from jobloom.functions.text import clean_description, join_keywords, split_keywords, text_of
from jobloom.operators.merge import upsert_postings
from jobloom.operators.ranking import top_per_group
from jobloom.operators.stats import posting_stats
from jobloom.schema import POSTING, POSTING_COLUMNS

# Posting files write keywords as a list or as a ``;`` text, so they are read as text.
FILE_POSTING = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "keywords" else f.dataType) for f in POSTING]
)
CORRUPT = "_corrupt_record"
# Plain CSV: blanks at the ends stay, quotes are doubled, an empty text is an empty cell.
CSV_FORM = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
STAMP = "yyyy-MM-dd HH:mm:ss"


def keywords_from_text(text: Column) -> Column:
    """A JSON list, or a ``;`` text, as an array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.isNotNull(), split_keywords(text)
    )


def _json_rows(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    schema = T.StructType(
        [
            *FILE_POSTING.fields,
            T.StructField("jobs", T.ArrayType(FILE_POSTING)),
            T.StructField(CORRUPT, T.StringType()),
        ]
    )
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def _unwrapped(rows: DataFrame) -> DataFrame:
    one = F.array(F.struct(*POSTING_COLUMNS))
    each = rows.where(F.col(CORRUPT).isNull()).select(
        F.inline(F.when(F.col("jobs").isNotNull(), F.col("jobs")).otherwise(one))
    )
    known = F.coalesce(*[F.col(c).cast("string") for c in POSTING_COLUMNS]).isNotNull()
    return each.where(known).withColumn("keywords", keywords_from_text(F.col("keywords")))


def read_postings_json(
    spark: SparkSession, path: str | list[str], multi_line: bool = True
) -> DataFrame:
    """Postings of JSON files: an array, or ``{"jobs": [...]}``; other shapes give no row.

    One such file is read by one task. Files with an object per line, as
    ``write_postings_json`` makes them, are split: pass ``multi_line=False``.
    """
    return _unwrapped(_json_rows(spark, path, multi_line))


def snapshots(spark: SparkSession, base: str) -> DataFrame:
    """(path, modified, place, parts): the snapshots below a folder, the preferred one first.

    A snapshot is a file, or a folder of part files as Spark writes it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .load(base)
    )
    snapshot = F.regexp_replace("path", r"/part-[^/]*$", "")
    place = (
        F.when(F.col("snapshot").endswith("/data/jobs.json"), 1)
        .when(F.col("snapshot").endswith("/exports/latest_jobs.json"), 2)
        .when(F.col("snapshot").rlike(r"/exports/jobs_export_[^/]*\.json$"), 3)
    )
    return (
        files.select("path", "modificationTime", snapshot.alias("snapshot"))
        .withColumn("place", place)
        .where(F.col("place").isNotNull())
        .groupBy(F.col("snapshot").alias("path"), "place")
        .agg(
            F.max("modificationTime").alias("modified"),
            F.max(F.col("path") != F.col("snapshot")).alias("parts"),
        )
        .orderBy("place", F.desc("modified"), "path")
    )


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The first readable of the two fixed files, else the newest export.

    A file that does not parse is passed over; of the exports only the newest is tried.
    """
    listed = snapshots(spark, base)
    fixed = listed.where(F.col("place") < 3).limit(2)
    newest = listed.where(F.col("place") == 3).limit(1)
    for row in [*fixed.collect(), *newest.collect()]:
        rows = _json_rows(spark, row.path, multi_line=not row.parts)
        if not rows.select(CORRUPT, "id").where(F.col(CORRUPT).isNotNull()).head(1):
            return _unwrapped(rows)
    return spark.createDataFrame([], POSTING)


def write_postings_json(df: DataFrame, path: str) -> None:
    """All postings, an object per line; every task writes its own file."""
    df.select(*[c for c in POSTING_COLUMNS if c in df.columns]).write.json(path)


def csv_view(df: DataFrame) -> DataFrame:
    """The fifteen text columns of the postings CSV."""
    columns = [
        F.col("id"),
        F.col("title"),
        F.col("company"),
        F.col("location"),
        F.col("salary"),
        clean_description(F.col("description")),
        F.col("link"),
        F.col("source"),
        join_keywords(F.col("keywords")),
        experience_level(F.col("title"), F.col("description")),
        is_remote(F.col("location")).cast("string"),
        F.format_string("%.2f", F.bround(F.coalesce("relevance", F.lit(0.0)), 2)),
        F.date_format("scraped_at", STAMP),
        F.date_format("updated_at", STAMP),
        F.coalesce("is_active", F.lit(False)).cast("string"),
    ]
    return df.select(
        *[text_of(c).alias(name) for c, name in zip(columns, V.CSV_HEADER, strict=True)]
    )


def write_postings_csv(df: DataFrame, path: str) -> None:
    csv_view(df).write.options(**CSV_FORM).csv(path)


def stats_csv_view(stats: DataFrame, locations: int = 10, keywords: int = 20) -> DataFrame:
    """(section, name, value): the summary block, all sources, the top locations and keywords."""
    labels = {
        "total_jobs": ("1 Metric", "Total Jobs"),
        "recent_jobs": ("1 Metric", "Recent Jobs (24h)"),
        "last_scraped": ("1 Metric", "Last Scraped"),
    }
    summary = stats.where(F.col("metric").isin(list(labels)))
    label = F.create_map(*[part for k, v in labels.items() for part in (F.lit(k), F.lit(v[1]))])
    parts = [
        summary.select(F.lit("1 Metric").alias("section"), label[F.col("metric")].alias("name"), "value"),
        stats.where(F.col("metric") == "jobs_by_source").select(
            F.lit("2 Source").alias("section"), F.col("key").alias("name"), "value"
        ),
    ]
    for metric, section, k in [
        ("jobs_by_location", "3 Location", locations),
        ("keywords", "4 Keyword", keywords),
    ]:
        counts = stats.where(F.col("metric") == metric)
        order = [F.desc(F.col("value").cast("bigint")), F.asc("key")]
        best = top_per_group(counts, ["metric"], order, k)
        parts.append(best.select(F.lit(section).alias("section"), F.col("key").alias("name"), "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def write_stats_csv(df: DataFrame, as_of: Column, path: str) -> None:
    view = stats_csv_view(posting_stats(df, as_of)).orderBy("section", "name")
    view.write.options(**CSV_FORM).csv(path)


def write_result_json(rows: DataFrame, insights: DataFrame, path: str) -> None:
    """A search result: its rows and its insights, side by side below ``path``."""
    rows.write.json(f"{path}/rows")
    insights.write.json(f"{path}/insights")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING).parquet(path)


def write_store(df: DataFrame, path: str) -> None:
    """Parquet by source; the rebalance splits a large source over several files."""
    kept = df.select(*POSTING_COLUMNS).hint("rebalance", F.col("source"))
    kept.write.partitionBy("source").parquet(path)


def store_postings(spark: SparkSession, new: DataFrame, old_path: str | None, new_path: str) -> DataFrame:
    """Merge new postings with a stored version into a new version; the old one stays as it is."""
    old = read_store(spark, old_path) if old_path else spark.createDataFrame([], POSTING)
    write_store(upsert_postings(new, old), new_path)
    return read_store(spark, new_path)


def read_postings_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "jobs",
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Stored postings of a relational database.

    Name a partition column with its bounds to read with several tasks; filters and
    column choice go to the database.
    """
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, partition_column, lower, upper, partitions), **options
    ).load()


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    chosen = {"url": url, "dbtable": table, "fetchsize": "10000", "pushDownLimit": "true"}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs a lower and an upper bound")
        chosen |= {
            "partitionColumn": partition_column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": str(partitions),
        }
    return chosen

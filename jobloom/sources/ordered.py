"""Tables kept in an order, so that a page at any depth reads the parts it lies in.

The rows are cut by range over the whole order, key included, and sorted in each part; a part is a
folder, a row has its place in the part, and a small table says where each part starts. A page is
found by arithmetic: it opens the one or two parts it touches (a page longer than a part, more),
and in them the row groups that hold its places. The total is known without a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.operators.ranking import page_info

PART, PLACE = "_part", "_place"
# The lower bits of the number that Spark gives to the rows of a partition count from 0.
_IN_PARTITION = (1 << 33) - 1


def write_ordered(df: DataFrame, order: Sequence[Column], path: str, parts: int | None = None) -> None:
    """Write the rows in an order that should be total: rows that tie in all of it have any place among them."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
        .withColumn(PART, F.spark_partition_id())
        .write.partitionBy(PART)
        .parquet(f"{path}/rows")
    )
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/like")
    sizes = _rows(spark, path).groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    # A row per part.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(PART).alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
    starts.coalesce(1).write.parquet(f"{path}/parts")


def _rows(spark: SparkSession, path: str, parts: Sequence[int] | None = None) -> DataFrame:
    """The rows of some parts or of all; the folders of others are not even listed."""
    like = spark.read.parquet(f"{path}/like")
    schema = like.withColumns({PLACE: F.lit(0).cast("bigint"), PART: F.lit(0)}).schema
    if parts is not None and not parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/rows"] if parts is None else [f"{path}/rows/{PART}={p}" for p in parts]
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*folders)


def ordered_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, start, n): where each part starts, counted from 0, and its rows."""
    return spark.read.parquet(f"{path}/parts")


def read_page(spark: SparkSession, path: str, limit: int, offset: int = 0, rank: str = "rank") -> DataFrame:
    """The rows of a page, with their place in the whole order from 1."""
    touched = ordered_parts(spark, path).where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
    starts = {r["part"]: r["start"] for r in touched.collect()}  # as many as the page is parts long
    rows = _rows(spark, path, sorted(starts))
    number = F.lit(None).cast("bigint")
    wanted = F.lit(False)
    for part, start in starts.items():
        here = F.col(PART) == part
        # Bounds on the place alone, so that they reach the scan.
        wanted = wanted | (here & F.col(PLACE).between(max(0, offset - start), offset + limit - start - 1))
        number = F.when(here, F.col(PLACE) + start + 1).otherwise(number)
    return rows.where(wanted).withColumn(rank, number).drop(PART, PLACE)


def ordered_page_info(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """One row about a page, from the sizes of the parts alone."""
    counted = ordered_parts(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rows = F.greatest(F.least(F.col("n") - offset, F.lit(limit)), F.lit(0))
    return counted.select(*page_info(rows, F.col("n"), limit, offset, total_known=True))

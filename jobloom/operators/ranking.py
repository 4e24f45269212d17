"""Order, rank, top-k and paging without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.relevance import relevance_weighted
from jobloom.session import shared_folder

# Above this many rows per group Spark no longer cuts a group before the shuffle.
PRUNED_BY_SPARK = 1000
SALTS = 64


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    salt_on: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group, with their 1-based rank.

    Up to a thousand rows Spark keeps ``n`` rows of a group per input partition
    before the shuffle, so a hot group stays small. For larger ``n`` name a column
    in ``salt_on``: groups are then cut in salted parts first.
    """
    if n >= PRUNED_BY_SPARK and salt_on is not None:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
            .withColumn("_place", F.row_number().over(part))
            .where(F.col("_place") <= n)
            .drop("_salt", "_place")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
    return numbered.withColumn(rank, F.col(rank).cast("bigint"))


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order; each input partition sends one row per key at most."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") == 1).drop("_place")
    )


def cap_per_source(
    df: DataFrame,
    order: Sequence[Column],
    cap: int,
    source: str = "source",
    salt_on: str | None = None,
    caps: DataFrame | None = None,
) -> DataFrame:
    """The first ``cap`` rows of each source; 0 or less leaves them all.

    ``caps`` (name, max_results) gives the caps of some sources; the others have ``cap``.
    """
    if caps is None:
        if cap <= 0:
            return df
        return top_per_group(df, [source], order, cap, rank="_rank", salt_on=salt_on).drop("_rank")
    own = caps.select(F.col("name").alias("_name"), F.col("max_results").alias("_cap"))
    rows = df.join(own, F.col(source) == F.col("_name"), "left").withColumn(
        "_cap", F.coalesce("_cap", F.lit(cap))
    )
    keep = (F.col("_cap") <= 0) | (F.col("_rank") <= F.col("_cap"))
    groups = [[source, "_salt"], [source]] if salt_on is not None else [[source]]
    if salt_on is not None:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
    for keys in groups:
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(keep)
    return rows.select(df.columns)


def top_k(counts: DataFrame, k: int, n: str = "n", key: str = "key") -> DataFrame:
    """The ``k`` largest counts; ties by key."""
    return counts.orderBy(F.desc(n), F.asc(key)).limit(k)


def rank_all(df: DataFrame, order: Sequence[Column], rank: str = "search_rank") -> DataFrame:
    """1-based place of every row in an order; nothing but one row per part runs in one task.

    Spark's range partitioning cuts the rows by the whole order, so rows that tie on a score are
    cut by key. The parts are written once, by a reliable checkpoint, since their sizes and their
    rows must come from the same cut; what the order is derived from is computed once as well.
    """
    spark = df.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_place", F.row_number().over(within))
        # a row per part
        .join(F.broadcast(starts), "_part")
        .withColumn(rank, (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_part", "_place", "_start")
    )


def global_rank(df: DataFrame, score: str, key: str, rank: str = "search_rank") -> DataFrame:
    """1-based rank over all rows by score descending, then key; an absent score comes last."""
    return rank_all(df, [F.desc_nulls_last(score), F.asc(key)], rank)


def score_weighted(df: DataFrame, keywords: str | Sequence[str]) -> DataFrame:
    """Add the weighted relevance. A text of keywords is cut at commas."""
    if isinstance(keywords, str):
        keywords = [k.strip() for k in keywords.lower().split(",")]
    score = relevance_weighted(F.col("title"), F.col("description"), F.col("company"), keywords)
    return df.withColumn("relevance", score)


def relevance_order(key: str = "id") -> list[Column]:
    return [F.desc("relevance"), F.asc(key)]


def search_rank(df: DataFrame, keywords: str | Sequence[str], key: str = "id") -> DataFrame:
    """Score with the weighted formula and rank all rows."""
    return global_rank(score_weighted(df, keywords), "relevance", key)


def search_order(key: str = "id") -> list[Column]:
    """Newest first, then relevance; absent values first, ties by key."""
    return [F.desc_nulls_first("scraped_at"), F.desc_nulls_first("relevance"), F.asc(key)]


def order_search(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(*search_order(key))


def place_search(df: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """The place of every row in the order of a search."""
    return rank_all(df, search_order(key), place)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """LIMIT / OFFSET after a sort, as a top-k. For a page far down use ``page_by_rank``."""
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset > 0 else ordered.limit(limit)


def page_by_rank(df: DataFrame, score: str, key: str, limit: int, offset: int) -> DataFrame:
    """A page at any depth, cut by global rank instead of a sorted prefix."""
    ranked = global_rank(df, score, key, rank="rank")
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def page_info(
    rows: Column, total: Column, limit: int, offset: int, total_known: bool = False
) -> list[Column]:
    """Columns about a page: number, size, pages in all, and whether more follow.

    A provider that tells the total has more only if the total goes further.
    """
    per_page = F.lit(limit)
    more = rows == per_page
    if total_known:
        more = more & (total > offset + limit)
    return [
        total.cast("bigint").alias("total"),
        F.lit(offset // limit + 1).cast("bigint").alias("page"),
        per_page.cast("bigint").alias("per_page"),
        F.ceil(total / per_page).cast("bigint").alias("total_pages"),
        more.alias("has_more"),
    ]


def page_info_of(
    df: DataFrame, limit: int, offset: int = 0, total_known: bool = True
) -> DataFrame:
    """One row about the page that ``limit`` and ``offset`` cut from ``df``."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    rows = F.greatest(F.least(F.col("n") - offset, F.lit(limit)), F.lit(0))
    return counted.select(*page_info(rows, F.col("n"), limit, offset, total_known))


def rank_combined(df: DataFrame, max_results: int, key: str = "id") -> DataFrame:
    """The best rows of a merged set; a missing score counts as 0."""
    score = F.coalesce(F.col("relevance"), F.lit(0.0))
    return df.orderBy(score.desc(), F.asc(key)).limit(max_results)

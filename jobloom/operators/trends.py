"""Technology trend and regional share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.facets import region_of
from jobloom.functions.text import contains_any, labels_where, title_and_description


def keyword_trend(
    df: DataFrame, terms: Mapping[str, Sequence[str]] = V.TREND_TERMS, days: int = 30
) -> DataFrame:
    """Postings per keyword and day, moving average, and growth over the days before.

    The scan ends in counts per keyword and day; only those go through the window.
    The average divides by the full number of days; growth is NULL without postings
    in the days before.
    """
    text = title_and_description(F.col("title"), F.col("description"))
    labels = labels_where((contains_any(text, words), name) for name, words in terms.items())
    daily = (
        df.select(F.to_date("scraped_at").alias("day"), F.explode(labels).alias("keyword"))
        .groupBy("keyword", "day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    over = Window.partitionBy("keyword").orderBy("day_no")
    current = F.sum("n").over(over.rangeBetween(-(days - 1), 0))
    before = F.sum("n").over(over.rangeBetween(-(2 * days - 1), -days))
    return (
        daily.withColumn("day_no", number)
        .withColumn("in_window", current)
        .withColumn("before", before)
        .select(
            "keyword",
            "day",
            "n",
            (F.col("in_window") / days).alias("moving_average"),
            F.try_divide((F.col("in_window") - F.col("before")) * 100.0, F.col("before")).alias(
                "growth_percent"
            ),
        )
    )


def region_share(df: DataFrame, region: Column | None = None) -> DataFrame:
    """Postings per region and their share of all in percent."""
    region = region_of(F.col("location")) if region is None else region
    counts = df.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("region", "n", (F.col("n") * 100.0 / total).alias("percent"))

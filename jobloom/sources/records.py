"""The posting record: made from scraped texts, or taken from a provider."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import posting_id, text_of, trim_space
from jobloom.schema import POSTING, TEXT_COLUMNS


def normalize_posting(df: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Trim the text fields, compute the id, and stamp a new, active posting.

    Text columns that are missing become empty; ``keywords`` stays if it is there.
    """
    texts = {
        name: trim_space(text_of(F.col(name))) if name in df.columns else F.lit("")
        for name in TEXT_COLUMNS
    }
    keywords = F.col("keywords") if "keywords" in df.columns else F.lit(None)
    trimmed = df.select(
        *keep,
        *[c.alias(name) for name, c in texts.items()],
        keywords.cast("array<string>").alias("keywords"),
        now.cast("timestamp").alias("_now"),
    )
    return trimmed.select(
        *keep,
        posting_id(F.col("title"), F.col("company"), F.col("link")).alias("id"),
        *TEXT_COLUMNS,
        "keywords",
        F.col("_now").alias("scraped_at"),
        F.col("_now").alias("updated_at"),
        F.lit(True).alias("is_active"),
        F.lit(0.0).cast("double").alias("relevance"),
    )


def provider_posting(df: DataFrame, keep: Sequence[str] = (), **columns: Column) -> DataFrame:
    """A record as a provider gives it: not trimmed, not yet active, never updated."""
    given = {
        name: text_of(c) if name in TEXT_COLUMNS else c for name, c in columns.items()
    }
    given["is_active"] = F.lit(False)
    given["relevance"] = F.lit(0.0)
    return df.select(
        *keep,
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POSTING.fields],
    )


def posting_json(df: DataFrame) -> Column:
    """The record as JSON text."""
    return F.to_json(F.struct(*[F.col(f.name) for f in POSTING.fields if f.name in df.columns]))


def posting_from_json(text: Column) -> Column:
    """The record a JSON text holds, as a struct."""
    return F.from_json(text, POSTING)

"""RSS and Atom feeds to postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import extract_company, extract_location, filled, text_of
from jobloom.sources.records import normalize_posting

ITEM = "title string, description string, link string, pubDate string, guid string, category string"
ENTRY = "title string, summary string, link struct<_href:string>, published string, id string"
RSS = (
    "channel struct<item:array<struct<title:string,description:string,link:string,pubDate:string,"
    "guid:string,category:string>>>"
)
ATOM = (
    "entry array<struct<title:string,summary:string,link:struct<_href:string>,published:string,"
    "id:string>>"
)


def _posting(
    items: DataFrame, description: Column, link: Column, now: Column, keep: Sequence[str]
) -> DataFrame:
    texts = items.where(filled(F.col("title"))).select(
        *keep,
        "source",
        "title",
        text_of(description).alias("description"),
        link.alias("link"),
        extract_company(F.col("title"), description).alias("company"),
        extract_location(F.col("title"), description).alias("location"),
    )
    return normalize_posting(texts, now, keep)


def rss_items(items: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Items (title, description, link, source) to postings; one without title is dropped."""
    return _posting(items, F.col("description"), F.col("link"), now, keep)


def atom_entries(entries: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    return _posting(entries, F.col("summary"), F.col("link._href"), now, keep)


def read_feed_rss(feeds: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Postings of a table of feed documents (source, body); a broken document gives none."""
    parsed = feeds.select(*keep, "source", F.from_xml("body", RSS).alias("_f"))
    return rss_items(parsed.select(*keep, "source", F.inline("_f.channel.item")), now, keep)


def read_feed_atom(feeds: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    parsed = feeds.select(*keep, "source", F.from_xml("body", ATOM).alias("_f"))
    return atom_entries(parsed.select(*keep, "source", F.inline("_f.entry")), now, keep)


def read_feed_files(
    spark: SparkSession, path: str, source: str, now: Column, feed_type: str = "rss"
) -> DataFrame:
    """Postings of feed files; a large file is split at its items."""
    atom = feed_type == "atom"
    items = (
        spark.read.format("xml")
        .option("rowTag", "entry" if atom else "item")
        .schema(ENTRY if atom else ITEM)
        .load(path)
        .withColumn("source", F.lit(source))
    )
    return atom_entries(items, now) if atom else rss_items(items, now)

"""Row filters over postings: predicates as columns, and the frames built on them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.facets import experience_level, is_remote, salary_max, salary_min
from jobloom.functions.relevance import relevance_feed, relevance_ratio
from jobloom.functions.text import (
    all_of,
    any_of,
    contains_any,
    filled,
    join_keywords,
    labels_where,
    text_of,
    title_and_description,
)
from jobloom.operators.ranking import cap_per_source


@dataclass
class SearchSpec:
    """What one search asks for. Fields left at their default do not filter."""

    keywords: Sequence[str] = field(default_factory=list)
    location: str | None = None
    sources: Sequence[str] = field(default_factory=list)
    min_salary: int = 0
    max_salary: int = 0
    date_from: datetime | None = None
    date_to: datetime | None = None
    is_active: bool | None = None
    experience_level: str | None = None
    is_remote: bool | None = None
    limit: int = 50
    offset: int = 0


def like_pattern(word: str) -> str:
    """The ILIKE pattern for "contains"; ``%`` and ``_`` in the word stay wildcards."""
    return re.sub(r"\\([^%_\\])", r"\1", f"%{word}%")


def keyword_any(
    keywords: Sequence[str], title: Column, description: Column, keywords_text: Column
) -> Column:
    """One keyword or more in title, description or keywords.

    The three texts are bound once, so that keywords that are still to be derived are
    derived once and not once per searched word.
    """
    patterns = [like_pattern(word) for word in keywords]
    return F.exists(
        F.array(title, description, keywords_text),
        lambda text: any_of(text.ilike(pattern) for pattern in patterns),
    )


def location_like(location: Column, wanted: str) -> Column:
    return location.ilike(like_pattern(wanted))


def created_between(
    created_at: Column, date_from: datetime | None, date_to: datetime | None
) -> Column:
    """Both bounds belong to the range; a bound left out is open."""
    bounds = []
    if date_from is not None:
        bounds.append(created_at >= F.lit(date_from))
    if date_to is not None:
        bounds.append(created_at <= F.lit(date_to))
    return all_of(bounds) if bounds else F.lit(True)


def level_equals(level: Column, wanted: str | None) -> Column:
    return level == wanted if wanted else F.lit(True)


def remote_equals(remote: Column, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else remote == F.lit(wanted)


def valid_postings(df: DataFrame) -> DataFrame:
    return df.where(filled(F.col("title")) & filled(F.col("company")) & filled(F.col("link")))


def valid_scraped(df: DataFrame) -> DataFrame:
    return df.where(filled(F.col("title")) & filled(F.col("company")))


def spec_predicate(spec: SearchSpec) -> Column:
    """Every field that is set, as one condition; cheap equalities come first.

    A salary bound compares with the range the salary text stands for, so a
    posting without a known salary fails any bound.
    """
    title, description = F.col("title"), F.col("description")
    conditions = []
    if spec.sources:
        conditions.append(F.col("source").isin(list(spec.sources)))
    if spec.is_active is not None:
        conditions.append(F.col("is_active") == F.lit(spec.is_active))
    if spec.date_from is not None or spec.date_to is not None:
        conditions.append(created_between(F.col("scraped_at"), spec.date_from, spec.date_to))
    if spec.location:
        conditions.append(location_like(F.col("location"), spec.location))
    if spec.is_remote is not None:
        conditions.append(remote_equals(is_remote(F.col("location")), spec.is_remote))
    if spec.min_salary > 0:
        conditions.append(salary_min(F.col("salary")) >= spec.min_salary)
    if spec.max_salary > 0:
        highest = salary_max(F.col("salary"))
        conditions.append((highest > 0) & (highest <= spec.max_salary))
    if spec.experience_level:
        conditions.append(level_equals(experience_level(title, description), spec.experience_level))
    if spec.keywords:
        conditions.append(
            keyword_any(spec.keywords, title, description, join_keywords(F.col("keywords")))
        )
    return all_of(conditions) if conditions else F.lit(True)


def filter_spec(df: DataFrame, spec: SearchSpec) -> DataFrame:
    return df.where(spec_predicate(spec))


def match_criteria(
    df: DataFrame, experience_level: str | None = None, remote_preference: bool = False
) -> DataFrame:
    """Drop titles of the opposite level; keep remote locations where preferred."""
    title = F.lower(text_of(F.col("title")))
    forbidden = V.CRITERIA_FORBIDDEN.get((experience_level or "").lower(), [])
    if forbidden:
        df = df.where(~contains_any(title, forbidden))
    if remote_preference:
        df = df.where(contains_any(F.lower(text_of(F.col("location"))), V.CRITERIA_REMOTE_WORDS))
    return df


def feed_match(
    title: Column, description: Column, board_keywords: Sequence[str], search_keywords: Sequence[str]
) -> Column:
    words = [w.lower() for w in (*board_keywords, *search_keywords)]
    if not words:
        return F.lit(True)
    return contains_any(title_and_description(title, description), words)


def feed_exclude(title: Column, description: Column, exclude_words: Sequence[str]) -> Column:
    """True for a row that holds none of the excluded words."""
    return ~contains_any(
        title_and_description(title, description), [w.lower() for w in exclude_words]
    )


def feed_filter(
    df: DataFrame,
    board_keywords: Sequence[str] = (),
    search_keywords: Sequence[str] = (),
    exclude_words: Sequence[str] = (),
    max_results: int = 0,
    order: Sequence[str] = ("id",),
) -> DataFrame:
    """Keep what matches, drop what is excluded, score, then cut where a maximum is set."""
    title, description = F.col("title"), F.col("description")
    kept = df.where(
        feed_match(title, description, board_keywords, search_keywords)
        & feed_exclude(title, description, exclude_words)
    ).withColumn("relevance", relevance_feed(title, description, board_keywords, search_keywords))
    return kept.orderBy(*order).limit(max_results) if max_results > 0 else kept


def feed_filter_boards(
    df: DataFrame,
    boards: DataFrame,
    search_keywords: Sequence[str] = (),
    order: Sequence[Column] = (),
    source: str = "source",
    salt_on: str = "id",
) -> DataFrame:
    """``feed_filter`` with the words and the maximum of each row's own board.

    ``boards`` has a row per ``name`` with its ``feed`` (as ``boards_dim`` gives it). A source that is
    no board there has the search's words only and no maximum.
    """

    def words(name: str) -> Column:
        listed = F.coalesce(f"b.feed.{name}", F.array().cast("array<string>"))
        return F.transform(F.filter(listed, lambda w: w.isNotNull()), F.lower)

    searched = F.array(*[F.lit(w.lower()) for w in search_keywords]).cast("array<string>")
    rows = df.alias("d").join(boards.alias("b"), F.col(f"d.{source}") == F.col("b.name"), "left").select(
        "d.*", F.concat(words("keywords"), searched).alias("_wanted"), words("excludeWords").alias("_excluded")
    )
    title, description = F.col("title"), F.col("description")

    def holds(listed: str) -> Column:
        # The text is put together once per row.
        text = F.array(title_and_description(title, description))
        return F.element_at(F.transform(text, lambda t: F.exists(listed, lambda w: t.contains(w))), 1)

    kept = (
        rows.where(((F.size("_wanted") == 0) | holds("_wanted")) & ~holds("_excluded"))
        .withColumn("relevance", relevance_ratio(title, description, F.col("_wanted")))
        .drop("_wanted", "_excluded")
    )
    caps = boards.select("name", F.coalesce("feed.maxResults", F.lit(0)).alias("max_results"))
    return cap_per_source(kept, list(order) or [F.col("id")], 0, source, salt_on, caps)


def recent_condition(scraped_at: Column, as_of: Column, hours: int = 24) -> Column:
    return scraped_at >= as_of - F.make_dt_interval(hours=F.lit(hours))


def recent(
    df: DataFrame, as_of: Column, hours: int = 24, limit: int = 20, order: Sequence[str] = ("id",)
) -> DataFrame:
    """The postings of the last hours, newest first, up to the limit."""
    fresh = df.where(recent_condition(F.col("scraped_at"), as_of, hours))
    return fresh.orderBy(F.desc("scraped_at"), *order).limit(limit)


def quality_rules(
    required: Sequence[str] = ("title", "company"), title_min: int = 5, description_max: int = 5000
) -> dict[str, Column]:
    """Name of the rule -> condition a good row meets."""
    rules = {f"required_{name}": filled(F.col(name)) for name in required}
    rules["title_min_length"] = F.length(text_of(F.col("title"))) >= title_min
    rules["description_max_length"] = (
        F.length(text_of(F.col("description"))) <= description_max
    )
    return rules


def mark_quality(df: DataFrame, **limits) -> DataFrame:
    """Add ``failed_rules``, the names of the rules a row breaks."""
    rules = quality_rules(**limits)
    failed = labels_where((~good, name) for name, good in rules.items())
    return df.withColumn("failed_rules", failed)


def quality_gate(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejected rows with the rules they break."""
    marked = mark_quality(df, **limits)
    good = marked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return good, marked.where(F.size("failed_rules") > 0)

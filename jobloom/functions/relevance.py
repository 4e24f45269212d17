"""Relevance formulas. Keywords are a Python list, or an array column for queries in a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import text_of, title_and_description

Keywords = Sequence[str] | Column


Points = Callable[..., Column]


def _sum_over(keywords: Keywords, texts: Sequence[Column], points: Points) -> Column:
    """Add up ``points(keyword, *texts)``.

    A fixed list unrolls, so that it stays in generated code. For an array column the
    texts are bound once per row and not put together again for each keyword.
    """
    if not isinstance(keywords, Column):
        return reduce(add, [points(F.lit(k.lower()), *texts) for k in keywords], F.lit(0)).cast("double")
    bound = F.struct(*[text.alias(f"t{i}") for i, text in enumerate(texts)])

    def total(row: Column) -> Column:
        fields = [row[f"t{i}"] for i in range(len(texts))]
        return F.aggregate(
            keywords, F.lit(0.0), lambda acc, k: acc + points(F.lower(k), *fields).cast("double")
        )

    return F.element_at(F.transform(F.array(bound), total), 1)


def _mean_over(keywords: Keywords, texts: Sequence[Column], points: Points) -> Column:
    if isinstance(keywords, Column):
        total = _sum_over(keywords, texts, points)
        return F.coalesce(F.try_divide(total, F.size(keywords)), F.lit(0.0))
    if not keywords:
        return F.lit(0.0)
    return _sum_over(keywords, texts, points) / F.lit(float(len(keywords)))


def _points(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight).cast("double")).otherwise(F.lit(0.0).cast("double"))


def relevance_ratio(title: Column, description: Column, keywords: Keywords) -> Column:
    """One point per keyword in title or description, one more if in the title; mean."""
    texts = [title_and_description(title, description), F.lower(text_of(title))]

    def points(keyword: Column, text: Column, head: Column) -> Column:
        in_text = text.contains(keyword)
        return _points(in_text, 1.0) + _points(in_text & head.contains(keyword), 1.0)

    return _mean_over(keywords, texts, points)


def _lower(*fields: Column) -> list[Column]:
    return [F.lower(text_of(c)) for c in fields]


def _field_points(*weights: float) -> Points:
    def points(keyword: Column, *texts: Column) -> Column:
        return reduce(
            add, [_points(t.contains(keyword), w) for t, w in zip(texts, weights, strict=True)]
        )

    return points


def relevance_weighted(
    title: Column, description: Column, company: Column, keywords: Keywords
) -> Column:
    """3 for the title, 1 for the description, 0.5 for the company; mean over keywords."""
    return _mean_over(keywords, _lower(title, description, company), _field_points(3.0, 1.0, 0.5))


def recency_bonus(created_at: Column, as_of: Column) -> Column:
    """1 up to 7 whole days of age, 0.5 up to 30, nothing beyond or without a time."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))
    days = F.floor(age / F.lit(86_400_000_000))
    return F.when(days <= 7, F.lit(1.0)).when(days <= 30, F.lit(0.5)).otherwise(F.lit(0.0)).cast("double")


def relevance_recency(
    title: Column,
    description: Column,
    company: Column,
    created_at: Column,
    as_of: Column,
    keywords: Keywords,
) -> Column:
    """3 for the title, 1.5 for the description, 1 for the company, summed; plus recency."""
    hits = _sum_over(keywords, _lower(title, description, company), _field_points(3.0, 1.5, 1.0))
    return hits + recency_bonus(created_at, as_of)


def relevance_feed(
    title: Column, description: Column, board_keywords: Sequence[str], search_keywords: Sequence[str]
) -> Column:
    """The ratio over board and search keywords; a word in both counts twice."""
    return relevance_ratio(title, description, [*board_keywords, *search_keywords])

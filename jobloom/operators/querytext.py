"""Keyword queries: from a text to terms, synonyms, patterns and variations.

All of it is array work inside the row of a ``queries`` table: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.text import contains_any


def tokenize_query(text: Column) -> Column:
    """Lower-case terms of two characters or more."""
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\t\n\f\r \-+.]", " ")
    return F.filter(F.split(plain, r"[\t\n\f\r ,;|]+"), lambda term: F.length(term) >= 2)


def with_synonyms(
    custom: Mapping[str, Sequence[str]], base: Mapping[str, Sequence[str]] = V.SYNONYMS
) -> dict[str, list[str]]:
    """The synonym table with the entries of some keys replaced."""
    return {k: list(v) for k, v in {**base, **custom}.items()}


def with_exclusions(more: Sequence[str], base: Sequence[str] = V.EXCLUSIONS) -> list[str]:
    return [*base, *more]


def expand_synonyms(
    terms: Column, synonyms: Mapping[str, Sequence[str]] = V.SYNONYMS
) -> Column:
    """The terms and the synonyms of terms, each once, sorted."""
    table = F.create_map(
        *[
            part
            for key, words in synonyms.items()
            for part in (F.lit(key), F.array(*[F.lit(w) for w in words]))
        ]
    )
    none = F.array().cast("array<string>")
    added = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), none)))
    return F.array_sort(F.array_distinct(F.concat(terms, added)))


def drop_exclusions(terms: Column, exclusions: Sequence[str] = V.EXCLUSIONS) -> Column:
    words = [w.lower() for w in exclusions]
    return F.filter(terms, lambda term: ~contains_any(F.lower(term), words))


def job_patterns(text: Column, patterns: Sequence[str] = V.QUERY_PATTERNS) -> Column:
    """Every hit of the patterns, pattern by pattern, repeats kept."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def process_query(
    queries: DataFrame,
    text: str = "text",
    synonyms: Mapping[str, Sequence[str]] = V.SYNONYMS,
    exclusions: Sequence[str] = V.EXCLUSIONS,
) -> DataFrame:
    """Add ``tokens``, ``keywords`` (expanded, filtered), ``patterns`` and ``exclusions``."""
    return (
        queries.withColumn("tokens", tokenize_query(F.col(text)))
        .withColumn("keywords", drop_exclusions(expand_synonyms(F.col("tokens"), synonyms), exclusions))
        .withColumn("patterns", job_patterns(F.array_join("tokens", " ")))
        .withColumn("exclusions", F.array(*[F.lit(e) for e in exclusions]))
    )


def query_variations(queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, variation, keywords): the query and each single term of it.

    Pairs of terms are left out: they grow with the square of a query's terms, and any pair can
    be asked as a query of its own.
    """
    terms = F.col("keywords")
    whole = queries.select(query_id, F.lit("query").alias("variation"), terms.alias("keywords"))
    several = queries.where(F.size("keywords") > 1)
    singles = several.select(query_id, F.explode("keywords").alias("_term")).select(
        query_id, F.lit("single").alias("variation"), F.array("_term").alias("keywords")
    )
    return whole.unionByName(singles)

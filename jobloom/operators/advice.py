"""Recommendations: rule tables over profiles and over search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.facets import first_match
from jobloom.functions.text import contains_any, text_of
from jobloom.operators.ranking import top_k
from jobloom.operators.stats import facet_counts, skills_in


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _by_level(level: Column, table: dict[str, list[str]], other: list[str]) -> Column:
    return first_match([(level == name, _words(w)) for name, w in table.items()], _words(other))


def recommend_keywords(profile: Column, level: Column, most: int = V.MAX_RECOMMENDED) -> Column:
    """Keywords for a level and a profile text, in rule order, without repeats."""
    text = F.lower(text_of(profile))
    none = F.array().cast("array<string>")
    by_profile = [
        F.when(contains_any(text, words), _words(added)).otherwise(none)
        for words, added in V.PROFILE_KEYWORDS
    ]
    base = _by_level(level, V.LEVEL_KEYWORDS, V.OTHER_LEVEL_KEYWORDS)
    return F.slice(F.array_distinct(F.concat(base, *by_profile)), 1, most)


def recommend_tips(level: Column) -> Column:
    return _by_level(level, V.LEVEL_TIPS, V.OTHER_LEVEL_TIPS)


def result_advice(
    df: DataFrame, order: Sequence[Column], level: str | None = None, few: int = 10, top: int = 5
) -> DataFrame:
    """(position, advice) for a result in its order, in rule order; nothing for an empty one."""
    title = F.lower(text_of(F.col("title")))
    first = df.orderBy(*order).limit(top)
    seniors = first.agg(F.count_if(title.contains("senior"))).scalar()
    figures = df.agg(F.count(F.lit(1)).alias("n")).select("n", seniors.alias("seniors"))
    skills = facet_counts(df, lists={"skill": skills_in()})
    skill = top_k(skills, 1).agg(F.max("key")).scalar()
    before, after = V.ADVICE_SKILL
    advice = F.array(
        F.when(F.col("n") < few, F.lit(V.ADVICE_BROADEN)),
        F.when(F.lit(level == "junior") & (F.col("seniors") > 0), F.lit(V.ADVICE_SENIOR)),
        F.when(skill.isNotNull(), F.concat(F.lit(before), skill, F.lit(after))),
    )
    return (
        figures.where(F.col("n") > 0)
        .select(F.posexplode(F.array_compact(advice)).alias("position", "advice"))
        .select((F.col("position") + 1).cast("bigint").alias("position"), "advice")
    )


def strategy_advice(stored: Column, live: Column, triggered: Column) -> Column:
    return (
        F.when(stored >= 20, V.STRATEGY_STORED)
        .when(triggered & (live > 0), V.STRATEGY_LIVE)
        .otherwise(V.STRATEGY_LIMITED)
    )

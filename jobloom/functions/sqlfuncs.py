"""The scalar operators as temporary functions of Spark SQL.

They are SQL functions, so calls are inlined into the plan and optimized with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from jobloom.functions import values as V


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(w)})" for w in words) + ")"


def _list(text: str, words: Sequence[str]) -> str:
    listed = ", ".join(_quoted(w) for w in words)
    return f"transform(array({text}), whole -> filter(array({listed}), word -> contains(whole, word)))[0]"


def _both(title: str = "title", description: str = "description") -> str:
    return f"lower(concat(coalesce({title}, ''), ' ', coalesce({description}, '')))"


def _band(end: int) -> str:
    cases = " ".join(
        f"WHEN {_any('lower(coalesce(salary, ' + chr(39) * 2 + '))', words)} THEN {band[end]}"
        for words, band in V.SALARY_BANDS
    )
    return f"CAST(CASE {cases} ELSE 0 END AS BIGINT)"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, return type, body)."""
    location = "lower(coalesce(location, ''))"
    hits = (
        "aggregate(keywords, 0.0D, (acc, k) -> acc + "
        f"CASE WHEN contains({_both()}, lower(k)) THEN 1.0D + "
        "CASE WHEN contains(lower(coalesce(title, '')), lower(k)) THEN 1.0D ELSE 0.0D END "
        "ELSE 0.0D END)"
    )
    weighted = (
        "aggregate(keywords, 0.0D, (acc, k) -> acc"
        " + CASE WHEN contains(lower(coalesce(title, '')), lower(k)) THEN 3.0D ELSE 0.0D END"
        " + CASE WHEN contains(lower(coalesce(description, '')), lower(k)) THEN 1.0D ELSE 0.0D END"
        " + CASE WHEN contains(lower(coalesce(company, '')), lower(k)) THEN 0.5D ELSE 0.0D END)"
    )
    return {
        "posting_id": (
            "title STRING, company STRING, link STRING",
            "STRING",
            "md5(concat_ws('|', lower(coalesce(title, '')), lower(coalesce(company, '')),"
            " coalesce(link, '')))",
        ),
        "is_remote": ("location STRING", "BOOLEAN", _any(location, V.REMOTE_WORDS)),
        "experience_level": (
            "title STRING, description STRING",
            "STRING",
            f"CASE WHEN {_any(_both(), V.SENIOR_WORDS)} THEN 'senior'"
            f" WHEN {_any(_both(), V.JUNIOR_WORDS)} THEN 'junior' ELSE 'mid' END",
        ),
        "salary_min": ("salary STRING", "BIGINT", _band(0)),
        "salary_max": ("salary STRING", "BIGINT", _band(1)),
        "extract_keywords": (
            "title STRING, description STRING", "ARRAY<STRING>", _list(_both(), V.TECH_TERMS)
        ),
        "extract_keywords_provider": (
            "title STRING, description STRING", "ARRAY<STRING>", _list(_both(), V.PROVIDER_TERMS)
        ),
        "relevance_ratio": (
            "title STRING, description STRING, keywords ARRAY<STRING>",
            "DOUBLE",
            f"CASE WHEN size(keywords) > 0 THEN {hits} / size(keywords) ELSE 0.0D END",
        ),
        "relevance_weighted": (
            "title STRING, description STRING, company STRING, keywords ARRAY<STRING>",
            "DOUBLE",
            f"CASE WHEN size(keywords) > 0 THEN {weighted} / size(keywords) ELSE 0.0D END",
        ),
        "date_posted_days": (
            "token STRING",
            "BIGINT",
            "CAST(CASE "
            + " ".join(f"WHEN lower(token) = {_quoted(t)} THEN {d}" for t, d in V.DATE_POSTED_DAYS.items())
            + " ELSE 0 END AS BIGINT)",
        ),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create or replace the temporary functions; returns their names."""
    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(definitions())

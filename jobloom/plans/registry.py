"""Searches by name, with the schema of their parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.advice import recommend_keywords, recommend_tips
from jobloom.operators.filters import SearchSpec
from jobloom.plans.search import SearchResult, comma_keywords, search_hybrid, search_stored


@dataclass
class NamedFunction:
    run: Callable[..., Any]
    description: str
    parameters: dict[str, dict[str, str]] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


_FUNCTIONS: dict[str, NamedFunction] = {}


def register(
    name: str, run: Callable[..., Any], description: str, parameters: dict[str, dict[str, str]],
    required: list[str],
) -> None:
    if name in _FUNCTIONS:
        raise ValueError(f"function {name} already registered")
    _FUNCTIONS[name] = NamedFunction(run, description, parameters, required)


def available() -> list[str]:
    return list(_FUNCTIONS)


def definitions() -> list[dict[str, Any]]:
    """Name, description and JSON schema of every function."""
    return [
        {
            "name": name,
            "description": f.description,
            "parameters": {"type": "object", "properties": f.parameters, "required": f.required},
        }
        for name, f in _FUNCTIONS.items()
    ]


def run(name: str, **arguments: Any) -> Any:
    """Run a function by name; the tables it reads are keyword arguments as well."""
    if name not in _FUNCTIONS:
        raise KeyError(f"function {name} not found; available: {', '.join(available())}")
    missing = [p for p in _FUNCTIONS[name].required if p not in arguments]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return _FUNCTIONS[name].run(**arguments)


def _stored(
    postings: DataFrame, keywords: str, location: str | None = None, max_results: int = 25
) -> SearchResult:
    spec = SearchSpec(keywords=comma_keywords(keywords), location=location, limit=max_results)
    return search_stored(postings, spec)


def _hybrid(
    postings: DataFrame,
    live: DataFrame,
    as_of: Column,
    keywords: str,
    location: str | None = None,
    max_results: int = 50,
    include_scraping: bool = True,
) -> SearchResult:
    spec = SearchSpec(keywords=comma_keywords(keywords), location=location, limit=max_results)
    return search_hybrid(postings, live, spec, as_of, include_live=include_scraping)


def _recommend(
    profiles: DataFrame, user_profile: str = "text", experience_level: str | None = None
) -> DataFrame:
    """``user_profile`` and ``experience_level`` name columns of ``profiles``."""
    level = F.col(experience_level) if experience_level else F.lit(None).cast("string")
    return profiles.withColumn(
        "recommended_keywords", recommend_keywords(F.col(user_profile), level)
    ).withColumn("tips", recommend_tips(level))


_TEXT, _COUNT, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
register(
    "search_stored", _stored, "Search the stored postings.",
    {"keywords": _TEXT, "location": _TEXT, "max_results": _COUNT}, ["keywords"],
)
register(
    "search_hybrid", _hybrid, "Search the stored postings and, if they are few, the live ones.",
    {"keywords": _TEXT, "location": _TEXT, "max_results": _COUNT, "include_scraping": _FLAG},
    ["keywords"],
)
register(
    "recommend", _recommend, "Keywords and tips for profiles.",
    {"user_profile": _TEXT, "experience_level": _TEXT}, [],
)

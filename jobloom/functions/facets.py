"""Facets of one posting: level, remote flag, salary, dates, region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.text import (
    contains_any,
    filled,
    null_if_empty,
    text_of,
    title_and_description,
)


def first_match(cases: list[tuple[Column, Column]], default: Column | None) -> Column:
    """CASE over (condition, value) in order."""
    first, *others = cases
    case = reduce(lambda acc, c: acc.when(c[0], c[1]), others, F.when(*first))
    return case if default is None else case.otherwise(default)


def is_remote(location: Column) -> Column:
    return contains_any(F.lower(text_of(location)), V.REMOTE_WORDS)


def experience_level(title: Column, description: Column) -> Column:
    text = title_and_description(title, description)
    return (
        F.when(contains_any(text, V.SENIOR_WORDS), "senior")
        .when(contains_any(text, V.JUNIOR_WORDS), "junior")
        .otherwise("mid")
    )


def _salary_bound(salary: Column, end: int) -> Column:
    text = F.lower(text_of(salary))
    return first_match(
        [(contains_any(text, words), F.lit(band[end])) for words, band in V.SALARY_BANDS],
        F.lit(0),
    ).cast("bigint")


def salary_min(salary: Column) -> Column:
    return _salary_bound(salary, 0)


def salary_max(salary: Column) -> Column:
    return _salary_bound(salary, 1)


def salary_range(salary: Column) -> Column:
    return F.struct(salary_min(salary).alias("min"), salary_max(salary).alias("max"))


def whole_number(amount: Column) -> Column:
    """The amount without decimals, halves to the even neighbour."""
    return F.bround(amount.cast("double"), 0).cast("decimal(38,0)").cast("string")


def format_salary_gbp(low: Column, high: Column) -> Column:
    low_text = F.concat(F.lit("£"), whole_number(low))
    return (
        F.when(
            (low > 0) & (high > 0),
            F.concat(low_text, F.lit(" - £"), whole_number(high), F.lit(" per year")),
        )
        .when(low > 0, F.concat(low_text, F.lit("+ per year")))
        .otherwise("")
    )


def format_salary_usd(low: Column, high: Column) -> Column:
    """Pay bounds given as texts."""
    return (
        F.when(
            filled(low) & filled(high),
            F.concat(F.lit("$"), low, F.lit(" - $"), high, F.lit(" per year")),
        )
        .when(filled(low), F.concat(F.lit("$"), low, F.lit("+ per year")))
        .otherwise("")
    )


def format_salary_ccy(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Nullable pay bounds with a currency and a period."""
    unit = F.coalesce(F.concat(null_if_empty(currency), F.lit(" ")), F.lit("$"))
    per = F.concat(F.lit("per "), F.coalesce(null_if_empty(period), F.lit("year")))
    low_text = F.concat(unit, whole_number(low))
    return (
        F.when(
            low.isNotNull() & high.isNotNull(),
            F.concat(low_text, F.lit(" - "), unit, whole_number(high), F.lit(" "), per),
        )
        .when(low.isNotNull(), F.concat(low_text, F.lit("+ "), per))
        .otherwise("")
    )


RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+\-]\d{2}:\d{2})$"


def parse_posted_date(text: Column, fetched_at: Column) -> Column:
    """A ``dd/MM/yyyy`` or RFC 3339 date, the fetch time where it is neither."""
    day = F.when(
        text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))
    )
    instant = F.when(text.rlike(RFC3339), F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("."))))
    return F.coalesce(day, instant, fetched_at.cast("timestamp"))


def date_posted_days(token: Column) -> Column:
    """The number of days an age token means, 0 where unknown."""
    cases = [(F.lower(token) == name, F.lit(days)) for name, days in V.DATE_POSTED_DAYS.items()]
    return first_match(cases, F.lit(0)).cast("bigint")


def region_of(location: Column, regions: dict[str, list[str]] | None = None) -> Column:
    text = F.lower(text_of(location))
    regions = V.REGIONS if regions is None else regions
    cases = [(contains_any(text, words), F.lit(name)) for name, words in regions.items()]
    return first_match(cases, F.lit(V.OTHER_REGION))


def requires_js(name: Column, base_url: Column) -> Column:
    return contains_any(F.lower(text_of(name)), V.JS_SOURCE_NAMES) | contains_any(
        F.lower(text_of(base_url)), V.JS_URL_PARTS
    )


def search_url(
    base_url: Column, path: Column, params: Column, keywords: Column, location: Column
) -> Column:
    """The address of a board search; parameters in key order, nothing escaped."""

    def pair(entry: Column) -> Column:
        value = entry["value"]
        filled_in = (
            F.when(
                value.contains("{keywords}"), F.replace(value, F.lit("{keywords}"), text_of(keywords))
            )
            .when(
                value.contains("{location}"), F.replace(value, F.lit("{location}"), text_of(location))
            )
            .otherwise(value)
        )
        return F.concat(entry["key"], F.lit("="), filled_in)

    base = F.concat(text_of(base_url), text_of(path))
    pairs = F.transform(F.array_sort(F.map_entries(params)), pair)
    return F.when(
        F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))
    ).otherwise(base)

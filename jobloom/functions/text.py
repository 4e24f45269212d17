"""Text expressions: trimming, identity keys, descriptions, links and term hits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import values as V


def text_of(column: Column) -> Column:
    """The text, empty where absent."""
    return F.coalesce(column, F.lit(""))


def trim_space(column: Column) -> Column:
    """Cut white space of any kind off both ends (``trim`` alone cuts blanks only)."""
    return F.btrim(column, F.lit(V.WHITE_SPACE))


def filled(column: Column) -> Column:
    """True where the text is there and not empty."""
    return F.coalesce(column != "", F.lit(False))


def null_if_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where the text contains one of the words; substrings count."""
    return any_of(text.contains(F.lit(word)) for word in words)


def title_and_description(title: Column, description: Column) -> Column:
    """The lower-case text that most facets are looked for in."""
    return F.lower(F.concat(text_of(title), F.lit(" "), text_of(description)))


SEPARATOR = "\x1f"


def _joined_where(cases: Iterable[tuple[Column, str]]) -> Column:
    return F.concat_ws(SEPARATOR, *[F.when(condition, F.lit(label)) for condition, label in cases])


def labels_where(cases: Iterable[tuple[Column, str]]) -> Column:
    """The labels whose condition holds, in order.

    Joined and split again rather than filtered: that stays in generated code, where a
    text that all conditions look at is put together once.
    """
    return F.array_remove(F.split(_joined_where(cases), SEPARATOR), "")


def first_label(cases: Iterable[tuple[Column, str]], default: str) -> Column:
    """The first label whose condition holds. All conditions are evaluated, as above."""
    first = F.substring_index(_joined_where(cases), SEPARATOR, 1)
    return F.coalesce(null_if_empty(first), F.lit(default))


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """The dictionary terms contained in the text, in dictionary order.

    The text is bound once per row, and the plan holds one test, not one per term.
    """
    words = F.array(*[F.lit(term) for term in terms])
    found = F.transform(
        F.array(text), lambda whole: F.filter(words, lambda word: F.contains(whole, word))
    )
    return F.element_at(found, 1)


def extract_keywords(
    title: Column, description: Column, terms: Sequence[str] = V.TECH_TERMS
) -> Column:
    return terms_in(title_and_description(title, description), terms)


def extract_keywords_provider(title: Column, description: Column) -> Column:
    return extract_keywords(title, description, V.PROVIDER_TERMS)


def posting_id(title: Column, company: Column, link: Column) -> Column:
    """The identity of a posting: MD5 of lower title, lower company and link."""
    return F.md5(
        F.concat_ws("|", F.lower(text_of(title)), F.lower(text_of(company)), text_of(link))
    )


def provider_id(provider: str, native_id: Column) -> Column:
    return F.concat(F.lit(f"{provider}_"), text_of(native_id.cast("string")))


def combined_key(title: Column, company: Column, location: Column) -> Column:
    """The key by which stored and live postings are the same."""
    return F.concat_ws(
        "|", *[trim_space(F.lower(text_of(c))) for c in (title, company, location)]
    )


def _cut(text: Column, size: int) -> Column:
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def clean_description(description: Column, size: int = 500) -> Column:
    """One line of text for a CSV cell, cut to a number of characters."""
    one_line = F.regexp_replace(text_of(description), r"[\n\r\t ]+", " ")
    return _cut(trim_space(one_line), size)


def preview(description: Column, size: int = 100) -> Column:
    return _cut(text_of(description), size)


def tag_employment_type(employment_type: Column, description: Column) -> Column:
    """Put the employment type before the description where there is one."""
    return F.when(
        filled(employment_type),
        F.concat(F.lit("["), employment_type, F.lit("] "), text_of(description)),
    ).otherwise(text_of(description))


def extract_company(title: Column, description: Column) -> Column:
    """Up to three words after the first company cue that has words after it."""
    text = title_and_description(title, description)

    def words_after(cue: str) -> Column:
        found = F.regexp_extract(text, rf"(?U){cue}\s*(\S+(?:\s+\S+){{0,2}})", 1)
        return null_if_empty(F.regexp_replace(found, r"(?U)\s+", " "))

    return F.coalesce(*[words_after(cue) for cue in V.COMPANY_CUES], F.lit(V.UNKNOWN_COMPANY))


def extract_location(title: Column, description: Column) -> Column:
    """The first place of the list that the text contains."""
    text = title_and_description(title, description)
    return first_label(
        ((text.contains(F.lit(place)), place.title()) for place in V.PLACES), V.UNKNOWN_PLACE
    )


def split_keywords(column: Column, separator: str = ";") -> Column:
    """A separated text as an array of trimmed words."""
    return F.transform(F.split(column, separator), trim_space)


def join_keywords(column: Column, separator: str = "; ") -> Column:
    return text_of(F.array_join(column, separator))


def join_locations(column: Column) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(
        F.lit(V.UNLISTED_LOCATION)
    )


def city_state_country(city: Column, state: Column, country: Column) -> Column:
    joined = F.concat_ws(", ", *[null_if_empty(c) for c in (city, state, country)])
    return F.coalesce(null_if_empty(joined), F.lit(V.UNLISTED_LOCATION))


def _without_dots(path: Column) -> Column:
    """The path after walking its ``.`` and ``..`` steps."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    ends_open = F.element_at(parts, -1).isin(".", "..")
    return F.concat(
        F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), "/").otherwise("")
    )


def escape_path(path: Column) -> Column:
    """Percent-encode the characters a URL path may not hold."""
    escaped = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda c: F.when(c.rlike(r"[^A-Za-z0-9\-_.~$&+,/:;=@%?#]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
        ),
        "",
    )
    return F.when(path.rlike(r"[^A-Za-z0-9\-_.~$&+,/:;=@%?#!'()*\[\]]"), escaped).otherwise(path)


def resolve_link(link: Column, page_url: Column) -> Column:
    """The absolute form of a link found on a page."""
    scheme = F.try_parse_url(page_url, F.lit("PROTOCOL"))
    origin = F.concat(scheme, F.lit("://"), F.try_parse_url(page_url, F.lit("AUTHORITY")))
    page_path = F.coalesce(null_if_empty(F.try_parse_url(page_url, F.lit("PATH"))), F.lit("/"))
    folder = F.regexp_extract(page_path, r"^(.*/)[^/]*$", 1)
    path = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    absolute = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    # only a path that holds a dot step needs the walk
    walked = F.when(absolute.rlike(r"/\.{1,2}(/|$)"), _without_dots(absolute)).otherwise(absolute)
    return (
        F.when(~filled(link) | link.startswith("http"), link)
        .when(link.startswith("#"), F.lit(""))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(link.startswith("?"), F.concat(origin, page_path, link))
        .otherwise(F.concat(origin, escape_path(walked), rest))
    )

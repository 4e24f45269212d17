"""Provider payloads to postings.

Each mapper takes a table of raw payloads (one JSON text per answer, in ``payload``)
and gives one row per posting. A payload that does not parse gives none.
``fetched_at`` is the time of the fetch; ``keep`` names columns carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import values as V
from jobloom.functions.facets import (
    format_salary_ccy,
    format_salary_gbp,
    format_salary_usd,
    parse_posted_date,
)
from jobloom.functions.text import (
    city_state_country,
    extract_keywords_provider,
    filled,
    join_locations,
    provider_id,
    tag_employment_type,
    text_of,
)
from jobloom.operators.ranking import page_info
from jobloom.sources.records import normalize_posting, provider_posting

REED = (
    "results array<struct<jobId:bigint,employerName:string,jobTitle:string,locationName:string,"
    "minimumSalary:double,maximumSalary:double,date:string,jobDescription:string,jobUrl:string>>,"
    "totalResults bigint"
)
_PAY = "array<struct<MinimumRange:string,MaximumRange:string>>"
USAJOBS = (
    "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<"
    "PositionID:string,PositionTitle:string,PositionURI:string,PositionLocationDisplay:array<string>,"
    f"OrganizationName:string,PositionRemuneration:{_PAY},"
    "UserArea:struct<Details:struct<JobSummary:string>>>>>>"
)
JSEARCH = (
    "status string, data array<struct<job_id:string,employer_name:string,job_employment_type:string,"
    "job_title:string,job_apply_link:string,job_description:string,job_posted_at_datetime_utc:string,"
    "job_city:string,job_state:string,job_country:string,job_min_salary:double,job_max_salary:double,"
    "job_salary_currency:string,job_salary_period:string>>"
)
GITHUB = "array<struct<title:string,company:string,location:string,description:string,url:string>>"
REMOTEOK = (
    "array<struct<slug:string,company:string,position:string,description:string,location:string,"
    "tags:array<string>>>"
)
USAJOBS_LEGACY = (
    "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<"
    "PositionTitle:string,OrganizationName:string,PositionLocation:array<struct<LocationName:string>>,"
    f"PositionRemuneration:{_PAY},QualificationSummary:string,PositionURI:string,"
    "ApplyURI:array<struct<ApplyOnlineURL:string>>>>>>"
)
HACKER_NEWS = "array<struct<title:string,text:string,url:string>>"
GENERIC = f"jobs {GITHUB}"


def _items(
    raw: DataFrame, schema: str, path: str | None, keep: Sequence[str], where: Column | None = None
) -> DataFrame:
    """One row per item of the parsed payload, the item's fields as columns."""
    parsed = raw.select(*keep, "fetched_at", F.from_json("payload", schema).alias("_p"))
    if where is not None:
        parsed = parsed.where(where)
    items = F.col("_p") if path is None else F.col(f"_p.{path}")
    return parsed.select(*keep, "fetched_at", F.inline(items))


def payload_page_info(
    raw: DataFrame,
    schema: str,
    items: str,
    limit: int,
    offset: int = 0,
    total: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per answer: total, page, per_page, total_pages and has_more.

    ``total`` is the path of the provider's own total, 0 where the answer has none. Without such a
    path the total is the number of items, and a full page is taken to have more.
    """
    parsed = raw.select(*keep, F.from_json("payload", schema).alias("_p"))
    found = F.coalesce(F.array_size(f"_p.{items}"), F.lit(0))
    told = found if total is None else F.coalesce(f"_p.{total}", F.lit(0))
    return parsed.select(*keep, *page_info(found, told, limit, offset, total_known=total is not None))


def _first(column: str, field: str) -> Column:
    return F.try_element_at(F.col(column), F.lit(1))[field]


def map_reed(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    jobs = _items(raw, REED, "results", keep)
    title, description = F.col("jobTitle"), F.col("jobDescription")
    return provider_posting(
        jobs,
        keep,
        id=provider_id("reed", F.coalesce("jobId", F.lit(0))),
        title=title,
        company=F.col("employerName"),
        location=F.col("locationName"),
        salary=format_salary_gbp(F.col("minimumSalary"), F.col("maximumSalary")),
        description=description,
        link=F.col("jobUrl"),
        source=F.lit(V.REED_SOURCE),
        keywords=extract_keywords_provider(title, description),
        scraped_at=parse_posted_date(F.when(~F.col("date").contains("T"), F.col("date")), F.col("fetched_at")),
    )


def map_usajobs(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    jobs = _items(raw, USAJOBS, "SearchResult.SearchResultItems", keep).select(
        *keep, "fetched_at", "MatchedObjectDescriptor.*"
    )
    title, description = F.col("PositionTitle"), F.col("UserArea.Details.JobSummary")
    return provider_posting(
        jobs,
        keep,
        id=provider_id("usajobs", F.col("PositionID")),
        title=title,
        company=F.col("OrganizationName"),
        location=join_locations(F.col("PositionLocationDisplay")),
        salary=format_salary_usd(
            _first("PositionRemuneration", "MinimumRange"), _first("PositionRemuneration", "MaximumRange")
        ),
        description=description,
        link=F.col("PositionURI"),
        source=F.lit(V.USAJOBS_SOURCE),
        keywords=extract_keywords_provider(title, description),
        scraped_at=F.col("fetched_at"),
    )


def map_jsearch(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Only answers whose status is OK count."""
    jobs = _items(raw, JSEARCH, "data", keep, where=F.col("_p.status") == "OK").withColumn(
        "job_description",
        tag_employment_type(F.col("job_employment_type"), F.col("job_description")),
    )
    title, description = F.col("job_title"), F.col("job_description")
    posted = F.col("job_posted_at_datetime_utc")
    return provider_posting(
        jobs,
        keep,
        id=provider_id("jsearch", F.col("job_id")),
        title=title,
        company=F.col("employer_name"),
        location=city_state_country(F.col("job_city"), F.col("job_state"), F.col("job_country")),
        salary=format_salary_ccy(
            F.col("job_min_salary"),
            F.col("job_max_salary"),
            F.col("job_salary_currency"),
            F.col("job_salary_period"),
        ),
        description=description,
        link=F.col("job_apply_link"),
        source=F.lit(V.JSEARCH_SOURCE),
        keywords=extract_keywords_provider(title, description),
        scraped_at=parse_posted_date(F.when(posted.contains("T"), posted), F.col("fetched_at")),
    )


def _new(jobs: DataFrame, keep: Sequence[str], board: str, **columns: Column) -> DataFrame:
    texts = jobs.select(
        *keep, "fetched_at", F.lit(board).alias("source"), *[c.alias(n) for n, c in columns.items()]
    )
    return normalize_posting(texts, F.col("fetched_at"), keep)


def map_github(raw: DataFrame, board: str = "github-jobs-api", keep: Sequence[str] = ()) -> DataFrame:
    jobs = _items(raw, GITHUB, None, keep)
    return _new(
        jobs, keep, board,
        title=F.col("title"), company=F.col("company"), location=F.col("location"),
        description=F.col("description"), link=F.col("url"),
    )


def map_remoteok(raw: DataFrame, board: str = "remoteok-api", keep: Sequence[str] = ()) -> DataFrame:
    jobs = _items(raw, REMOTEOK, None, keep)
    return _new(
        jobs, keep, board,
        title=F.col("position"), company=F.col("company"), location=F.col("location"),
        description=F.col("description"), keywords=F.col("tags"),
        link=F.concat(F.lit(V.REMOTEOK_LINK), text_of(F.col("slug"))),
    )


def map_usajobs_legacy(raw: DataFrame, board: str = "usajobs-api", keep: Sequence[str] = ()) -> DataFrame:
    jobs = _items(raw, USAJOBS_LEGACY, "SearchResult.SearchResultItems", keep).select(
        *keep, "fetched_at", "MatchedObjectDescriptor.*"
    )
    low = text_of(_first("PositionRemuneration", "MinimumRange"))
    high = text_of(_first("PositionRemuneration", "MaximumRange"))
    paid = F.size("PositionRemuneration") > 0
    applies = F.size("ApplyURI") > 0
    return _new(
        jobs, keep, board,
        title=F.col("PositionTitle"), company=F.col("OrganizationName"),
        location=_first("PositionLocation", "LocationName"),
        salary=F.when(paid, F.concat(F.lit("$"), low, F.lit(" - $"), high)),
        description=F.col("QualificationSummary"),
        link=F.when(applies, _first("ApplyURI", "ApplyOnlineURL")).otherwise(F.col("PositionURI")),
    )


def map_hn(raw: DataFrame, board: str = "hn-jobs-api", keep: Sequence[str] = ()) -> DataFrame:
    """Items with a title and a text."""
    jobs = _items(raw, HACKER_NEWS, None, keep).where(filled(F.col("title")) & filled(F.col("text")))
    return _new(
        jobs, keep, board,
        title=F.col("title"), company=F.lit(V.HN_COMPANY), location=F.lit(V.HN_LOCATION),
        description=F.col("text"), link=F.col("url"),
    )


def map_generic(raw: DataFrame, board: str = "generic", keep: Sequence[str] = ()) -> DataFrame:
    """A ``jobs`` list with the usual field names; title and company are required."""
    jobs = _items(raw, GENERIC, "jobs", keep).where(filled(F.col("title")) & filled(F.col("company")))
    return _new(
        jobs, keep, board,
        title=F.col("title"), company=F.col("company"), location=F.col("location"),
        description=F.col("description"), link=F.col("url"),
    )


def map_by_paths(
    raw: DataFrame, paths: Mapping[str, str], board: str = "generic", keep: Sequence[str] = ()
) -> DataFrame:
    """One posting per payload, each field at a JSON path such as ``$.company.name``.

    A payload is parsed once, into a variant, whatever the number of paths; one that is no JSON gives
    no posting. A path to an object or a list gives its JSON text, a number its plain form (50000 for 50000.0).
    """
    # The generator keeps the optimizer from repeating the parse for each path.
    parsed = raw.withColumn("_variant", F.explode(F.array(F.try_parse_json("payload"))))
    columns = {name: F.try_variant_get("_variant", path, "string") for name, path in paths.items()}
    found = parsed.select(*raw.columns, F.struct(*[c.alias(name) for name, c in columns.items()]).alias("_found"))
    values = {name: F.col(f"_found.{name}") for name in paths}
    posted = values.pop("posted_date", F.lit(None).cast("string"))
    fields = found.withColumn("fetched_at", parse_posted_date(posted, F.col("fetched_at")))
    mapped = _new(fields, keep, board, **values)
    return mapped.where(filled(F.col("title")) & filled(F.col("company")))


Mapper = Callable[..., DataFrame]
_MAPPERS: dict[str, Mapper] = {}


def register_provider(name: str, mapper: Mapper) -> None:
    """Add a mapper from raw payloads to postings; a name is taken once."""
    if name in _MAPPERS:
        raise ValueError(f"provider {name} already registered")
    _MAPPERS[name] = mapper


def provider(name: str) -> Mapper:
    if name not in _MAPPERS:
        raise KeyError(f"provider {name} not found")
    return _MAPPERS[name]


def providers() -> list[str]:
    return sorted(_MAPPERS)


for _name, _mapper in {
    "reed": map_reed,
    "usajobs": map_usajobs,
    "jsearch": map_jsearch,
    "github-jobs-api": map_github,
    "remoteok-api": map_remoteok,
    "usajobs-api": map_usajobs_legacy,
    "hn-jobs-api": map_hn,
    "generic": map_generic,
}.items():
    register_provider(_name, _mapper)

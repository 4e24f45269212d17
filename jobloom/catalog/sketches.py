"""Sketches: distinct counts and quantiles that can be merged, against exact figures.

SQL gives the exact figures, so a query says of each estimate whether it lies within the stated error.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from jobloom.catalog.base import calls, calls_from, offers, on_calls, on_offers, query, table
from jobloom.operators import sketches as S
from jobloom.session import new_path
from jobloom.streaming import streams as X

# Four standard errors.
WITHIN = 4 * 1.04 / 2 ** (S.LG / 2)


def _halves(spark, sf):
    """Two stores of the offers' sketches, written and read again."""
    rows = offers(spark, sf)
    paths = []
    for half in (F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 2 == 1):
        paths.append(new_path(spark, "sketches"))
        S.distinct_sketches(rows.where(half), ("company", "location", "title")).write.parquet(paths[-1])
    return [spark.read.parquet(p) for p in paths]


FIRST, LAST = date(1994, 1, 1), date(1996, 6, 30)


@query(
    "distinct_sketches",
    on_offers(
        """SELECT source, count(*) AS n, count(DISTINCT company) AS companies, true AS companies_near,
             count(DISTINCT location) AS locations, true AS locations_near, count(DISTINCT title) AS titles,
             true AS titles_near
           FROM offers WHERE scraped_at BETWEEN DATE '1994-01-01' AND DATE '1996-06-30' GROUP BY source"""
    ),
)
def distinct(spark, sf):
    """Distinct values over a range of days, from the merged sketches of two stores."""
    facets = ("company", "location", "title")
    merged = S.merge_distinct(*_halves(spark, sf), facets=facets)
    told = S.distinct_over(merged, ["source"], F.lit(FIRST), F.lit(LAST), facets)
    rows = offers(spark, sf).where(F.to_date("scraped_at").between(FIRST, LAST))
    plural = {"company": "companies", "location": "locations", "title": "titles"}
    exact = rows.groupBy("source").agg(*[F.countDistinct(f).alias(plural[f]) for f in facets])
    near = [
        (F.abs(F.col(f) - F.col(plural[f])) <= WITHIN * F.col(plural[f])).alias(f"{plural[f]}_near") for f in facets
    ]
    return told.join(exact, "source").select("source", "n", *plural.values(), *near)


SHARES = (0.5, 0.95, 0.99)


def _ranked(calls, told):
    """Per key of the told quantiles the share of calls at or below each, and whether it is near what was asked."""
    keys = [c for c in told.columns if c in ("provider", "window_start")]
    rows = calls.select("provider", F.date_trunc("hour", "called_at").alias("window_start"), F.col("latency_ms").alias("at"))
    q = [F.col("quantiles")[i] for i in range(len(SHARES))]
    counts = [F.count_if(F.col("at") < v).alias(f"_l{i}") for i, v in enumerate(q)]
    counts += [F.count_if(F.col("at") <= v).alias(f"_u{i}") for i, v in enumerate(q)]
    # The rank of the answer, its ties included, reaches the share but for the error and one row.
    slack = F.col("n") * S.RANK_ERROR + 1
    near = F.lit(True)
    for i, share in enumerate(SHARES):
        near = near & (F.col(f"_l{i}") <= F.col("n") * share + slack) & (F.col(f"_u{i}") >= F.col("n") * share - slack)
    return (
        rows.join(told, keys).groupBy(*keys, "n", "failed").agg(*counts).select(*keys, "n", "failed", near.alias("near"))
    )


@query(
    "latency_sketches",
    on_calls("SELECT provider, count(*) AS n, count_if(NOT ok)::BIGINT AS failed, true AS near FROM calls GROUP BY provider"),
)
def latency(spark, sf):
    """Quantiles of each provider over all time, from hourly sketches."""
    rows = calls(spark, sf)
    path = new_path(spark, "latency")
    S.latency_sketches(rows).write.parquet(path)
    return _ranked(rows, S.latency_over(spark.read.parquet(path), ["provider"], SHARES))


@query(
    "stream_latency",
    on_calls(
        """SELECT provider, date_trunc('hour', called_at) AS window_start, count(*) AS n,
             count_if(NOT ok)::BIGINT AS failed, true AS near FROM calls GROUP BY ALL"""
    ),
)
def latency_stream(spark, sf):
    """The same state, kept by a stream."""
    like = table(spark, sf, "events")
    arriving = calls_from(X.read_stream(spark, f"{sf}/events*.parquet", like))
    arriving = arriving.withColumn("called_at", F.col("called_at").cast("timestamp"))
    found = X.run_updates(X.stream_latency(arriving), "latency", ["provider", "window_start"])
    told = S.latency_over(found, ["provider", "window_start"], SHARES)
    told = told.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return _ranked(calls(spark, sf), told)

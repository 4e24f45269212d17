"""The versioned store: merges, one day of it, and some ids."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from jobloom.catalog.base import full_postings, on_postings, query
from jobloom.session import new_path
from jobloom.sources import store

COLUMNS = ["id", "title", "salary", "location", "source", "scraped_at", "updated_at"]


def _batches(spark, sf):
    """All postings, then later and earlier forms of some of them, and a few new ones."""
    rows = full_postings(spark, sf).drop("key")
    number = F.regexp_extract("link", "[0-9]+$", 0).cast("bigint")
    later = rows.where(number % 9 == 0).withColumns(
        {"salary": F.lit("60k"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 DAY")}
    )
    earlier = rows.where(number % 13 == 0).withColumns(
        {"salary": F.lit("0"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 DAY")}
    )
    added = rows.where(number % 17 == 0).withColumn("id", F.concat(F.col("id"), F.lit("-b")))
    return rows, later.unionByName(earlier.where(number % 9 != 0)).unionByName(added)


MERGED = f"""merged AS (
    SELECT {', '.join(COLUMNS)} FROM postings WHERE key % 9 <> 0
    UNION ALL SELECT id, title, '60k', location, source, scraped_at, updated_at + INTERVAL 1 DAY FROM postings WHERE key % 9 = 0
    UNION ALL SELECT id || '-b', title, salary, location, source, scraped_at, updated_at FROM postings WHERE key % 17 = 0)"""


def _stored(spark, sf, buckets=16):
    path = new_path(spark, "store")
    for batch in _batches(spark, sf):
        store.upsert(spark, path, batch, buckets=buckets)
    return path


def _shown(rows):
    return rows.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(c) for c in COLUMNS]
    )


@query("store_upsert", on_postings(f"SELECT {', '.join(COLUMNS)} FROM merged", MERGED))
def upserted(spark, sf):
    return _shown(store.read_version(spark, _stored(spark, sf)))


@query("store_history", on_postings(
    """SELECT CAST(1 AS BIGINT) AS version, count(*) AS n FROM postings
       UNION ALL SELECT 2, count(*) FROM merged""", MERGED,
))
def versions(spark, sf):
    return store.history(spark, _stored(spark, sf)).select("version", "n")


@query("store_first_version", on_postings(f"SELECT {', '.join(COLUMNS)} FROM postings"))
def first_version(spark, sf):
    """An old version stays as it was."""
    return _shown(store.read_version(spark, _stored(spark, sf), version=1))


@query("store_day", on_postings(
    f"""SELECT {', '.join(COLUMNS)} FROM merged
        WHERE CAST(scraped_at AS DATE) = DATE '2024-01-15' AND location ILIKE '%york%'""", MERGED,
))
def one_day(spark, sf):
    """From the files whose times and locations can hold such a row."""
    spec = store.day_spec(date(2024, 1, 15), location="york")
    return _shown(store.read_version(spark, _stored(spark, sf), spec))


@query("store_ids", on_postings(
    f"""SELECT {', '.join(COLUMNS)} FROM merged
        WHERE id IN (SELECT id FROM postings WHERE key < 5 UNION ALL SELECT 'none')""", MERGED,
))
def some_ids(spark, sf):
    wanted = full_postings(spark, sf).where("key < 5").select("id").collect()
    return _shown(store.read_ids(spark, _stored(spark, sf), [r["id"] for r in wanted] + ["none"]))

"""Column types of the posting table and its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ["title", "company", "location", "salary", "description", "link", "source"]

POSTING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in TEXT_COLUMNS],
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("relevance", T.DoubleType()),
    ]
)
POSTING_COLUMNS = POSTING.fieldNames()


def as_posting(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the posting columns, taking the given ones and NULL for those left out."""
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in POSTING.fields
        ]
    )

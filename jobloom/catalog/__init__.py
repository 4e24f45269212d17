"""The checked queries: one per operator, over the whole given tables."""

from jobloom.catalog import (
    columns, filters, merging, ranking, reports, searches, sketches, sources, stores, streams, terms,
)
from jobloom.catalog.base import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "columns", "filters", "merging", "ranking", "reports", "searches", "sketches", "sources",
    "stores", "streams", "terms",
]

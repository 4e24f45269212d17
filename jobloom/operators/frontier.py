"""The crawl frontier: where a query is sent on the board it names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.facets import requires_js, search_url


def crawl_frontier(
    requests: DataFrame,
    boards: DataFrame,
    board: str = "board",
    keywords: str = "keywords",
    location: str = "location",
    keep: Sequence[str] = ("query_id",),
) -> DataFrame:
    """For each (query, board) row its address, method, cap, and whether a browser is needed.

    An equi-join on the board's name; a request for an unknown board has no address.
    """
    named = boards.select(
        F.col("name").alias("_name"), "method", "base_url", "search_path", "search_params", "max_results"
    )
    joined = requests.join(named, F.col(board) == F.col("_name"), "left")
    params = F.coalesce("search_params", F.create_map().cast("map<string,string>"))
    address = search_url(
        F.col("base_url"), F.col("search_path"), params, F.array_join(keywords, " "), F.col(location)
    )
    return joined.select(
        *keep,
        F.col(board).alias("board"),
        "method",
        F.when(F.col("method") == "scraping", address).alias("url"),
        F.col("max_results").cast("bigint").alias("cap"),
        requires_js(F.col(board), F.col("base_url")).alias("requires_js"),
    )

"""The board configuration as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SELECTORS = (
    "struct<jobContainer:string,title:string,company:string,location:string,salary:string,"
    "description:string,link:string>"
)
FEED = (
    "struct<name:string,feedUrl:string,feedType:string,maxResults:bigint,keywords:array<string>,"
    "excludeWords:array<string>>"
)
CONFIG = (
    "jobBoards array<struct<name:string,enabled:boolean,baseUrl:string,searchPath:string,"
    f"searchParams:map<string,string>,selectors:{SELECTORS},rateLimit:bigint,maxResults:bigint,"
    f"scrapingMethod:string,rssConfig:{FEED}>>, "
    "globalSettings struct<maxResultsPerBoard:bigint>"
)


def boards_dim(config: DataFrame) -> DataFrame:
    """The enabled boards; method and cap fall back to their defaults."""
    boards = config.select(
        F.col("globalSettings.maxResultsPerBoard").alias("_cap"), F.explode("jobBoards").alias("b")
    ).where(F.coalesce("b.enabled", F.lit(False)))
    method = F.coalesce(F.nullif("b.scrapingMethod", F.lit("")), F.lit("scraping"))
    own_cap = F.nullif(F.coalesce("b.maxResults", F.lit(0)), F.lit(0))
    return boards.select(
        F.col("b.name").alias("name"),
        method.alias("method"),
        F.col("b.baseUrl").alias("base_url"),
        F.col("b.searchPath").alias("search_path"),
        F.col("b.searchParams").alias("search_params"),
        F.col("b.selectors").alias("selectors"),
        F.coalesce("b.rateLimit", F.lit(0)).alias("rate_limit"),
        F.coalesce(own_cap, F.when(method == "scraping", F.col("_cap")), F.lit(0)).alias("max_results"),
        F.col("b.rssConfig").alias("feed"),
    )


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    return boards_dim(spark.read.schema(CONFIG).option("multiLine", True).json(path))

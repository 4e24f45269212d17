"""Five stages from raw documents to tokens; each reads what the one before wrote.

Every stage decides per row. Rows are told apart by id and text, a null id being an id like
others; rows that share both fare alike, but that near_copies leaves one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jobloom.llm import byte_bpe, decontamination, jaccard_forest, quality_rules, suffix_dedup
from jobloom.session import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules).where("kept").select(docs.columns)


def _same(id: str, digest: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(id)) & (jaccard_forest.text_digest() == F.col(digest))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the first by id, those without an id last, then by a digest of the text.

    Of rows that share id and text the first by the other columns stays. Rows without words are in no class.
    """
    found = jaccard_forest.classed_rows(docs).where("n_shingles > 0")
    later = ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")))
    marks = (
        found.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
        .agg(F.max(later).alias("__later"), F.count("*").alias("__rows"))
        .where("__later OR __rows > 1")
        .select("__id", "__digest", "__later")
        .checkpoint()
    )
    marked = docs.join(marks, _same("__id", "__digest"), "left")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__id", "__digest").orderBy(*(others or [F.col("text")]))
    once = marked.where("NOT __later").withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return marked.where("__later IS NULL").select(docs.columns).union(once.select(docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; those of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs)
    # A cut can part a character; its bytes then read as U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    rows = cut.where("octet_length(kept) > 0 OR n_bytes = 0").withColumn("text", text)
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contained_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(held, _same("__id", "__digest"), "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of their bytes."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_forest", near_copies),
    ("suffix_dedup", passages),
    ("decontamination", decontaminate),
    ("byte_bpe", tokens),
]

#: SQL has no word for the learned rules and the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Benchmark items that stand inside documents: MinHash containment search, then an exact test.

An item is contained if at least ``THRESHOLD`` of its distinct five-word shingles stand in the
document, however long that is. Items are divided by size: the sketch of an item is its
shingles of smallest hash, all of them for a short item, and a size class sets how many hits of
the sketch make a candidate. Documents have size classes too, and a document too small for an
item is not compared with it. Candidates are verified on all shingles of the item.

Only built-in functions run. The items are a query set: their sketches are sent to all tasks in
blocks of about ``BLOCK`` shingles, so no shuffle of all shingles of the corpus is needed. Blocks
are measured first; should one hold far more, by a huge item, its whole items are joined by a shuffle.

Words are runs of letters and digits, lower-cased. Defined cases: null texts have no words; an
item of fewer than five words has no shingle and is found nowhere; repeated items are each found;
repeated documents give one row per id, text and item. Results hold ids and counts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 5
THRESHOLD = 0.8
#: Shingles in the sketch of an item.
SKETCH = 48
#: A candidate has this share of the sketch, 20 of 48; a true match of a long item at the threshold
#: falls short of it about once in 10**9 (binomial: 1.1e-9). Short items are sketched whole, so the threshold itself applies.
CANDIDATE = 0.4
#: Shingles of items that are sent to all tasks at once (about 16 bytes each).
BLOCK = 500_000


def text_digest(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingles(text: str | Column) -> Column:
    """The distinct hashed shingles of a text; an empty array if it has fewer than five words."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.when(
                F.size(w) >= WORDS,
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(0), F.size(w) - WORDS),
                        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]),
                    )
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        ),
        1,
    )


def size_class(n: Column) -> Column:
    """Powers of two: class c holds sizes from 2**c up to below 2**(c+1)."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    rows = items.select(F.col(item_id).alias("item_id"), F.sort_array(shingles(text)).alias("all"))
    rows = rows.where(F.size("all") > 0).select("*", F.size("all").alias("n_item")).distinct()
    return rows.select(
        "*", size_class(F.col("n_item")).alias("item_class"), F.slice("all", 1, SKETCH).alias("sketch")
    )


def contained(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every document that holds an item."""
    return contained_rows(docs, items, doc_id, text, item_id, item_text, threshold).drop("digest")


def contained_rows(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """Like ``contained``, with ``digest``, which tells the texts of one id apart."""
    queries = _items(items, item_id, item_text)
    total = queries.agg(F.sum("n_item")).head()[0] or 0
    blocks = int(total) // BLOCK + 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    # As many rows as blocks.
    sizes = dict(queries.groupBy(block).agg(F.sum("n_item")).collect()) if blocks > 1 else {0: total}
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    found = [
        _block(rows, queries.where(block == k) if blocks > 1 else queries, threshold, sizes.get(k, 0) <= 2 * BLOCK)
        for k in range(blocks)
    ]
    return reduce(DataFrame.union, found)


def _block(rows: DataFrame, queries: DataFrame, threshold: float, small: bool) -> DataFrame:
    def sent(items: DataFrame) -> DataFrame:
        return F.broadcast(items) if small else items

    sketches = queries.select(
        "item_id", "n_item", "item_class", F.size("sketch").alias("n_sketch"), F.explode("sketch").alias("shingle")
    )
    # Repeated rows are counted apart and then taken once.
    hashes = rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("row"), shingles("text").alias("own"))
    exploded = hashes.select(
        "doc_id", "digest", "row", size_class(F.size("own")).alias("doc_class"), F.explode("own").alias("shingle")
    )
    # A document with fewer shingles than the threshold asks of the item is at least a class below it.
    hits = (
        exploded.join(sent(sketches), "shingle")
        .where("doc_class >= item_class - 1")
        .groupBy("doc_id", "digest", "row", "item_id", "n_item", "n_sketch")
        .agg(F.count("*").alias("hits"))
    )
    share = F.when(F.col("n_sketch") == F.col("n_item"), F.lit(threshold)).otherwise(F.lit(CANDIDATE))
    candidates = hits.where(F.col("hits") >= share * F.col("n_sketch") - 1e-9).drop("row").distinct()
    settled = F.col("n_sketch") == F.col("n_item")
    exact = candidates.where(settled).select("doc_id", "digest", "item_id", F.col("hits").alias("n_shared"), "n_item")
    # Long items: all their shingles against those of the candidates' documents.
    longer = candidates.where(~settled).select("doc_id", "digest", "item_id", "n_item")
    some = longer.select(F.col("doc_id").alias("c_id"), F.col("digest").alias("c_digest")).distinct()
    whole = queries.where(F.size("sketch") < F.col("n_item")).select("item_id", F.explode("all").alias("shingle"))
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))
    again = rows.join(some, same, "left_semi").select("doc_id", "digest", F.explode(shingles("text")).alias("shingle"))
    counted = (
        again.distinct()
        .join(sent(whole), "shingle")
        .groupBy("doc_id", "digest", "item_id")
        .agg(F.count("*").alias("n_shared"))
    )
    checked = (
        longer.alias("l")
        .join(
            counted.alias("c"),
            F.col("l.doc_id").eqNullSafe(F.col("c.doc_id"))
            & (F.col("l.digest") == F.col("c.digest"))
            & (F.col("l.item_id").eqNullSafe(F.col("c.item_id"))),
        )
        .select("l.doc_id", "l.digest", "l.item_id", "c.n_shared", "l.n_item")
    )
    return (
        exact.union(checked)
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
        .select("doc_id", "digest", "item_id", F.col("n_shared").cast("bigint").alias("n_shared"), F.col("n_item").cast("bigint").alias("n_item"))
    )

"""A persisted index for substring search: positional grams of the vocabulary, and where its words stand.

A text holds a term without white space exactly if one of its words does. So the index has two
tables, each cut into hash buckets: ``grams`` (gram, place, window, name) has a row for every
place of every distinct word: three characters from there, fewer at the end; ``words`` (segment, name, keys,
fields) lists the postings of a segment that hold a word, with the fields as bits. A segment is a set of postings
of bounded text, by a hash of the key, inverted in one task: what is shuffled is the text, once, and no row per
word of a posting. ``counts`` has the number of places of each gram.

A term is looked up by the rarest of its grams: each place of that gram says where the term must
begin in the word, and the term is compared there. Terms of one or two characters are looked up by
the grams that begin with them. Only the buckets that a search asks for are read. Long words are
held in windows of bounded size, by a digest; terms of several words, or longer than a window can
answer for, are found by one automaton in a pass over the texts.

A key names a posting: rows that share one are one posting here. Searches give counts and the
best postings of each query. The lists of the words found meet the queries segment by segment, against a
matrix of the weights of a block of queries; no (query, posting) row leaves a task but the best ``k``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.text import text_of, title_and_description
from jobloom.operators.holding import BITS, Scorer, automaton, codes_of, passes, points_of, ranges, read_fields, run_passes
from jobloom.operators.matching import FIELDS, LONGEST_PROBE, SPACE, _field_texts, _windows, query_terms
from jobloom.operators.scanning import best_of_all, counts_of_all
from jobloom.session import shared_folder

GRAM = 3
BUCKETS = 16
# Bytes of title and description in a segment, about.
SEGMENT_BYTES = 8 << 20
# Terms of up to this many bytes in all are sent to every task.
SENT_BYTES = 8 << 20


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, name: str, by: str, buckets: int) -> None:
    parts = min(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("bucket", _bucket(by, buckets))
    placed.repartition(parts, "bucket").sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(f"{path}/{name}")
    rows.sparkSession.createDataFrame([], placed.schema).write.parquet(f"{path}/like_{name}")


def _grams(window: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(window))
    return F.transform(
        at, lambda i: F.struct(F.substring(window, i, GRAM).alias("gram"), i.alias("place"))
    )


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def _inverted(rows: pa.Table) -> pa.Table:
    """The words of one segment, each with its postings and the bits of their fields."""
    key, keys = codes_of(rows["key"])
    found, at, bits = [], [], []
    for name in FIELDS:
        lists = pc.split_pattern_regex(pa.concat_arrays(rows[name].chunks), SPACE)
        words, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        found.append(words)
        at.append(key[parents])
        bits.append(np.full(len(words), BITS[name], dtype=np.int8))
    word, words = codes_of(pa.concat_arrays(found))
    pair, bits = word * len(keys) + np.concatenate(at), np.concatenate(bits)
    by = np.argsort(pair, kind="stable")
    pair, bits = pair[by], bits[by]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    pair, bits = pair[first], np.bitwise_or.reduceat(bits, first)
    ends = pa.array(np.append(0, np.cumsum(np.bincount(pair // len(keys), minlength=len(words)))), pa.int32())
    long = pc.greater(pc.utf8_length(words), LONGEST_PROBE)
    names = [
        " " + hashlib.md5(w.encode()).hexdigest() if is_long else w
        for w, is_long in zip(words.to_pylist(), long.to_pylist(), strict=True)
    ]
    out = pa.table({
        "segment": pa.array(np.full(len(words), rows["segment"][0].as_py()), pa.int32()),
        "name": pa.array(names, pa.string()),
        "long": pc.if_else(long, words, pa.scalar(None, pa.string())),
        "keys": pa.ListArray.from_arrays(ends, keys.take(pa.array(pair % len(keys)))),
        "fields": pa.ListArray.from_arrays(ends, pa.array(bits, pa.int8())),
    })
    return out.filter(pc.not_equal(words, ""))


def build_index(postings: DataFrame, path: str, key: str = "key", buckets: int = BUCKETS) -> None:
    """Write the index of title, description, company and keywords of the postings."""
    spark = postings.sparkSession
    size = sum(F.octet_length(text_of(F.col(name))) for name in ("title", "description"))
    segments = (postings.agg(F.sum(size)).head()[0] or 0) // SEGMENT_BYTES + 1
    texts = [text.alias(name) for name, text in _field_texts(postings).items()]
    rows = postings.select(_segment(F.col(key), segments).alias("segment"), F.col(key).alias("key"), *texts)
    of = postings.schema[key].dataType.simpleString()
    schema = f"segment int, name string, long string, keys array<{of}>, fields array<tinyint>"
    words = rows.groupBy("segment").applyInArrow(_inverted, schema).withColumn("bucket", _bucket("name", buckets))
    words.sortWithinPartitions("bucket", "name").write.partitionBy("bucket").parquet(f"{path}/words")
    spark.createDataFrame([], words.schema).write.parquet(f"{path}/like_words")
    vocabulary = _table(spark, path, "words").select("name", "long").distinct()
    grams = (
        vocabulary.select("name", F.explode(_windows(F.coalesce("long", "name"))).alias("window"))
        # A short word is its own window.
        .select(F.nullif("name", F.col("window")).alias("name"), "window", F.inline(_grams(F.col("window"))))
    )
    _write(grams, path, "grams", "gram", buckets)
    about = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(segments).cast("int").alias("segments"))
    about.write.parquet(f"{path}/about")
    _table(spark, path, "grams").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    # The columns are told by a file without rows, so that an empty index can be read.
    like = spark.read.parquet(f"{path}/like_{name}").schema
    return spark.read.schema(like).parquet(f"{path}/{name}")


def _asked(rows: DataFrame, by: str, path: str, name: str) -> DataFrame:
    """The rows of an index table in the buckets that the asked values fall into."""
    spark = rows.sparkSession
    buckets = spark.read.parquet(f"{path}/about").head()["buckets"]
    wanted = [r[0] for r in rows.select(_bucket(by, buckets)).distinct().collect()]  # at most one per bucket
    table = _table(spark, path, name)
    return table.where(F.col("bucket").isin(wanted)) if len(wanted) < buckets else table


def find_words(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """(term_id, name): the words that contain the ``probe`` of a term."""
    return _words_of(spark, path, terms).distinct()


def _sent(rows: DataFrame, size: int) -> DataFrame:
    """A row a term at most: sent to every task if the terms are small, so that the grams stay where they are."""
    return F.broadcast(rows) if size <= SENT_BYTES else rows


def _words_of(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The rows of ``find_words``, also repeated ones."""
    n = F.length("probe")
    size = terms.agg(F.sum(F.octet_length("probe") + 48)).head()[0] or 0
    long = terms.where(n >= GRAM)
    pieces = long.select("term_id", "probe", F.explode(F.sequence(F.lit(1), n - GRAM + 1)).alias("offset")).withColumn(
        "gram", F.substr("probe", F.col("offset"), F.lit(GRAM))
    )
    counts = spark.read.parquet(f"{path}/counts")
    rarest = (
        pieces.join(counts, "gram", "left")
        .groupBy("term_id", "probe")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("best"))
        .where("best.n > 0")
        .select("term_id", "probe", "best.gram", "best.offset")
    )
    start = F.col("place") - F.col("offset") + 1
    by_gram = (
        _asked(rarest, "gram", path, "grams")
        .join(_sent(rarest, size), "gram")
        .where((start > 0) & (F.substr("window", start, F.length("probe")) == F.col("probe")))
        .select("term_id", F.coalesce("name", "window").alias("name"))
    )
    short = terms.where(n < GRAM)
    if short.isEmpty():
        return by_gram
    grams = _table(spark, path, "grams")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("gram"), F.lit(GRAM - 1))), lambda k: F.substr("gram", F.lit(1), k))
    by_head = grams.select(F.coalesce("name", "window").alias("name"), F.explode(heads).alias("probe")).join(_sent(short, size), "probe")
    return by_gram.union(by_head.select("term_id", "name"))


def _numbered(terms: DataFrame) -> DataFrame:
    """(term_id, term, probe, whole): the distinct terms; ``whole`` ones are compared with the texts."""
    pieces = F.filter(F.split("term", SPACE), lambda p: p != "")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))
    whole = F.col("term").rlike(SPACE) | (F.length("term") > LONGEST_PROBE) | (F.col("term") == "")
    return (
        terms.select("term").distinct()
        .select(
            F.monotonically_increasing_id().alias("term_id"), "term",
            F.substring(F.coalesce(longest["piece"], F.lit("")), 1, LONGEST_PROBE).alias("probe"),
            whole.alias("whole"),
        )
        .checkpoint()
    )


def _word_lists(path: str, spark: SparkSession, terms: DataFrame) -> DataFrame:
    """(segment, keys, fields, terms): the postings of each word that holds terms, with their numbers."""
    words = _words_of(spark, path, terms.where(~F.col("whole")))
    # Read twice: for the buckets, and for their rows.
    named = words.groupBy("name").agg(F.collect_set("term_id").alias("terms")).checkpoint()
    return _asked(named, "name", path, "words").join(named, "name").select("segment", "keys", "fields", "terms")


def _text_lists(path: str, postings: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(segment, key, terms, fields): the terms that words cannot answer for, by a pass over the texts.

    No such term is in a posting without a key.
    """
    spark = postings.sparkSession
    segments = spark.read.parquet(f"{path}/about").head()["segments"]
    of = postings.schema[key].dataType.simpleString()
    schema = f"segment int, key {of}, terms array<bigint>, fields array<tinyint>"
    texts = {**_field_texts(postings), "text": title_and_description(F.col("title"), F.col("description"))}
    rows = postings.where(F.col(key).isNotNull()).select(
        _segment(F.col(key), segments).alias("segment"), F.col(key).alias("key"), *[t.alias(n) for n, t in texts.items()]
    )
    found = spark.createDataFrame([], schema)
    weights = terms.where("whole").select(F.col("term_id").alias("query_id"), "term")
    for sent in passes(weights):
        found = found.union(rows.mapInArrow(_pass_of_texts(sent), schema))
    return found


def _pass_of_texts(sent: pa.Table):
    numbers, terms = sent["query_id"].to_numpy(), sent["term"].to_pylist()
    everywhere = [n for n, term in enumerate(terms) if not term]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        for batch in batches:
            at, held, bits = [], [], []
            texts = zip(*[batch[name].to_pylist() for name in BITS], strict=True)
            for row, some in enumerate(texts):
                mine = dict.fromkeys(everywhere, sum(BITS.values()))
                for bit, text in zip(BITS.values(), some, strict=True):
                    for number in {n for _, n in machine.iter(text)} if len(machine) else ():
                        mine[number] = mine.get(number, 0) | bit
                if mine:
                    at.append(row)
                    held.append(numbers[list(mine)])
                    bits.append(list(mine.values()))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["segment"].take(at), batch["key"].take(at),
                 pa.array(held, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int8()))],
                ["segment", "key", "terms", "fields"],
            )

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The values of all lists, and the size of each list."""
    return pc.list_flatten(lists), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _segment_scores(words: pa.Table, texts: pa.Table, scorer: Scorer, formula: str):
    """Gives (keys, query ids, postings x queries scores) of one segment; the keys rise."""
    known = scorer.terms.to_numpy()
    listed, n_keys = _flat(words["keys"])
    key, keys = codes_of(pa.chunked_array([*listed.chunks, *texts["key"].chunks], listed.type))
    fields, _ = _flat(words["fields"])
    terms, n_terms = _flat(words["terms"])
    begins = np.cumsum(n_terms) - n_terms
    bits = fields.to_numpy().astype(np.uint8)
    bits = bits | np.where(bits & (BITS["title"] | BITS["description"]), BITS["text"], 0).astype(np.uint8)
    own, n_own = _flat(texts["terms"])
    own_bits = _flat(texts["fields"])[0].to_numpy().astype(np.uint8)

    def columns(numbers: pa.ChunkedArray) -> np.ndarray:
        """The place of each term among those of this pass, or -1."""
        asked = numbers.to_numpy()
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, at, -1)

    term, own = columns(terms), columns(own)
    # Entries: a posting of a word, and then a posting of the texts; each has a stretch of terms.
    row = np.repeat(np.arange(words.num_rows), n_keys)
    start = np.concatenate([begins[row], len(term) + np.cumsum(n_own) - n_own])
    count = np.concatenate([n_terms[row], n_own])
    term = np.concatenate([term, own])
    by = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[by], np.arange(0, len(keys) + scorer.step, scorer.step))
    for begin, (a, b) in zip(range(0, len(keys), scorer.step), zip(cuts, cuts[1:], strict=False), strict=False):
        some = by[a:b]
        place = ranges(start[some], count[some])
        column, at = term[place], np.repeat(key[some] - begin, count[some])
        entry = np.repeat(some, count[some])
        of_word = entry < len(bits)
        bit = np.where(of_word, bits[np.where(of_word, entry, 0)] if len(bits) else 0, 0).astype(np.uint8)
        bit[~of_word] = own_bits[place[~of_word] - (len(term) - len(own))]
        mine = column >= 0
        column, at, bit = column[mine], at[mine], bit[mine]
        held = np.zeros((min(scorer.step, len(keys) - begin), len(known)), dtype=np.uint8)
        for one in BITS.values():
            has = (bit & one) != 0
            held[at[has], column[has]] |= one
        for ids, found in scorer.scores(points_of(held, formula)):
            yield keys[begin : begin + len(held)], ids, found


def _by_segment(
    path: str, queries: DataFrame, postings: DataFrame, formula: str, query_id: str, key: str, schema: str,
    summed: Callable,
) -> DataFrame:
    """What ``summed`` makes of the scores of each segment, pass by pass."""
    spark = postings.sparkSession
    shared_folder(spark)
    asked = query_terms(queries, query_id).withColumnRenamed(query_id, "query_id").where("term IS NOT NULL")
    terms = _numbered(asked)
    weights = asked.join(terms.select("term", "term_id"), "term").select(
        "query_id", F.col("term_id").alias("term"), "times", "n_terms"
    )
    words, texts = _word_lists(path, spark, terms), _text_lists(path, postings, terms, key)

    def one(sent: pa.Table) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return summed(_segment_scores(left, right, Scorer(sent), formula))

        return words.groupBy("segment").cogroup(texts.groupBy("segment")).applyInArrow(run, schema)

    return run_passes(weights, one, schema)


def count_indexed(
    path: str, queries: DataFrame, postings: DataFrame, query_id: str = "query_id", key: str = "key"
) -> DataFrame:
    """(query_id, n): how many postings hold a term of each query in title, description or keywords."""
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, n bigint"

    def summed(scores) -> pa.Table:
        parts = [
            pa.table({"query_id": ids, "n": pa.array((found > 0).sum(axis=0), pa.int64())}) for _, ids, found in scores
        ]
        return pa.concat_tables(parts)

    return counts_of_all(queries, _by_segment(path, queries, postings, "match", query_id, key, schema, summed), query_id)


def search_indexed(
    path: str, queries: DataFrame, postings: DataFrame, k: int, formula: str = "weighted",
    query_id: str = "query_id", key: str = "key",
) -> DataFrame:
    """(query_id, search_rank, key, relevance): the best ``k`` postings of each query, as ``search_many`` scores them."""
    read_fields(formula)
    kind, of = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (postings, key)))

    def summed(scores) -> pa.Table:
        """The best of each stretch of postings; what is left of a segment is ranked with the others."""
        parts = []
        for keys, ids, found in scores:
            # The keys rise, so a stable order by score breaks ties by key.
            order = np.argsort(-found, axis=0, kind="stable")[:k]
            value = np.take_along_axis(found, order, axis=0)
            row, query = np.nonzero(value > 0)
            best = [ids.take(pa.array(query)), keys.take(pa.array(order[row, query])), pa.array(value[row, query])]
            parts.append(pa.Table.from_arrays(best, ["query_id", "key", "relevance"]))
        return pa.concat_tables(parts)

    schema = f"query_id {kind}, key {of}, relevance double"
    return best_of_all(_by_segment(path, queries, postings, formula, query_id, key, schema, summed), k, query_id, key)

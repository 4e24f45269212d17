"""Many queries against all postings: which postings contain which terms.

A term counts wherever it is a substring, so words cannot simply be joined. A term
without white space lies in a text exactly if it lies in one of its words, so terms
are looked for in the *vocabulary* (each distinct word once): the parts of a word that
are as long as some term are joined with the terms, and the hits go back to postings by
word. Every step is an equi-join or an aggregate; no posting meets every term.

A long word is cut into overlapping windows, so its parts stay in proportion to it. Hits
are partitioned by posting once; what follows per posting needs no other exchange.

The (query, posting) rows of ``match_queries`` and ``score_many`` need no hits as rows: texts are
partitioned by posting once, and a task finds the terms of each with one automaton and scores
them against a matrix of (term, query) counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import text_of, title_and_description
from jobloom.operators.holding import BITS, Scorer, automaton, codes_of, points_of, read_fields, run_passes

SPACE = r"[ \t\n\r]+"
# Terms up to this length are looked for by word; longer ones are checked on the texts.
LONGEST_PROBE = 32
FIELDS = ["title", "description", "company", "keywords"]


def query_terms(queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, term, times, n_terms): the terms of each query, lower case."""
    return (
        queries.select(query_id, F.size("keywords").alias("n_terms"), F.explode("keywords").alias("term"))
        .groupBy(query_id, F.lower("term").alias("term"), "n_terms")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _field_texts(postings: DataFrame) -> dict[str, Column]:
    texts = {}
    for name in FIELDS:
        column = F.col(name)
        if postings.schema[name].dataType.typeName() == "array":
            column = F.array_join(column, " ; ")
        texts[name] = F.lower(text_of(column))
    return texts


def _field_words(name: str, text: Column) -> Column:
    words = F.array_distinct(F.split(text, SPACE))
    return F.transform(words, lambda w: F.struct(F.lit(name).alias("field"), w.alias("word")))


def _word_name(word: Column) -> Column:
    """What a word is joined by: itself, or a digest behind a blank, which no word contains."""
    return F.when(F.length(word) <= LONGEST_PROBE, word).otherwise(F.concat(F.lit(" "), F.md5(word)))


def _windows(word: Column) -> Column:
    """The word, or stretches of it such that each part up to ``LONGEST_PROBE`` lies in one."""
    cut = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{LONGEST_PROBE}}}"), F.lit(0))
    # Bound in a lambda, so that a word is cut once and not for each of its windows.
    joined = F.transform(
        F.array(cut),
        lambda c: F.transform(c, lambda piece, i: F.concat(piece, F.coalesce(F.get(c, i + 1), F.lit("")))),
    )
    return F.when(F.length(word) <= LONGEST_PROBE, F.array(word)).otherwise(
        F.array_distinct(F.element_at(joined, 1))
    )


def _parts(window: Column, lengths: Column) -> Column:
    """Every part of the window that has one of the lengths, each once."""

    def of_length(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(window) - n + 1), lambda i: F.substring(window, i, n))

    fitting = F.filter(lengths, lambda n: n <= F.length(window))
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


def _word_hits(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, term): the words that contain the ``probe`` of a term."""
    lengths = terms.agg(F.collect_set(F.length("probe"))).scalar()
    parts = (
        words.select("word").distinct()
        .select(_word_name(F.col("word")).alias("name"), F.explode(_windows(F.col("word"))).alias("window"))
        .withColumn("_lengths", lengths)
        .select("name", F.explode(_parts(F.col("window"), F.col("_lengths"))).alias("probe"))
    )
    return parts.join(terms, "probe").select("name", "term")


def term_hits(postings: DataFrame, terms: DataFrame, key: str = "key") -> DataFrame:
    """(key, term, in_text, in_title, in_description, in_company, in_keywords), partitioned by key.

    ``terms`` has one column, ``term``, in lower case. The empty term is in every text.
    """
    texts = _field_texts(postings)
    words = postings.select(
        key, F.explode(F.concat(*[_field_words(name, text) for name, text in texts.items()])).alias("_at")
    ).select(key, "_at.field", "_at.word")

    pieces = F.filter(F.split("term", SPACE), lambda p: p != "")
    longest = F.element_at(
        F.array_sort(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))), -1
    )
    listed = terms.select("term").distinct()
    split = listed.where(F.col("term").rlike(r"[^ \t\n\r]")).withColumn(
        "probe", F.substring(longest["piece"], 1, LONGEST_PROBE)
    )
    named = words.select(key, "field", _word_name(F.col("word")).alias("name"))
    found = named.join(_word_hits(words, split), "name").select(key, "field", "term")
    # Terms of white space alone have no word to look up; every posting is asked for the few there are.
    blanks = listed.where(~F.col("term").rlike(r"[^ \t\n\r]")).agg(F.collect_set("term")).scalar()
    asked = postings.select(key, F.lit("").alias("field"), F.explode(blanks).alias("term"))
    flags = [F.max(F.col("field") == name).alias(f"in_{name}") for name in FIELDS]
    by_word = found.unionByName(asked).repartition(key).groupBy(key, "term").agg(*flags)

    # Terms that are no short word are checked on the texts of their postings; the other rows of
    # the outer join meet no text. Without such terms no text is read.
    on_text = F.col("term").rlike(SPACE) | (F.col("term") == "") | (F.length("term") > LONGEST_PROBE)
    any_on_text = listed.where(on_text).limit(1).agg(F.count(F.lit(1))).scalar()
    both = title_and_description(F.col("title"), F.col("description"))
    whole = postings.where(any_on_text > 0).select(
        F.col(key).alias("_key"), both.alias("_text"), *[t.alias(f"_{name}") for name, t in texts.items()]
    )
    checked = by_word.join(whole, (F.col(key) == F.col("_key")) & on_text, "left")

    def flag(text: str, by_words: Column) -> Column:
        return F.when(on_text, F.col(text).contains(F.col("term"))).otherwise(by_words)

    hits = checked.select(
        key,
        "term",
        flag("_text", F.col("in_title") | F.col("in_description")).alias("in_text"),
        *[flag(f"_{name}", F.col(f"in_{name}")).alias(f"in_{name}") for name in FIELDS],
    )
    anywhere = F.col("in_text") | F.col("in_title") | F.col("in_description") | F.col("in_company") | F.col("in_keywords")
    return hits.where(anywhere)


def _held(texts: list[list[str]], names: list[str], terms: list[str], machine) -> np.ndarray:
    """(rows x terms) bits of the fields that hold each term."""
    out = np.zeros((len(texts[0]), len(terms)), dtype=np.uint8)
    for name, column in zip(names, texts, strict=True):
        if len(machine):
            for row, text in enumerate(column):
                out[row, list({number for _, number in machine.iter(text)})] |= BITS[name]
        out[:, [n for n, term in enumerate(terms) if not term]] |= BITS[name]
    return out


def _each_posting(batches: Iterator[pa.RecordBatch], scorer: Scorer, formula: str):
    """Gives (keys, points) of postings that come sorted by key.

    The rows of one key are one posting: a term holds that one of them holds, but terms that are checked on
    the texts count in each row, and in none without a key.
    """
    names, terms = read_fields(formula), scorer.terms.to_pylist()
    machine = automaton(terms)
    on_text = np.array([bool(re.search(SPACE, t)) or not t or len(t) > LONGEST_PROBE for t in terms], dtype=bool)
    # What is known of the last key, since its rows may go on.
    keys, bits, sums = None, np.zeros((0, len(terms)), np.uint8), np.zeros((0, int(on_text.sum())))

    def value(bits: np.ndarray, sums: np.ndarray) -> np.ndarray:
        found = points_of(bits, formula)
        found[:, on_text] = sums
        return found

    for batch in batches:
        for begin in range(0, batch.num_rows, scorer.step):
            part = batch.slice(begin, scorer.step)
            held = _held([part[n].to_pylist() for n in names], names, terms, machine)
            own = points_of(held[:, on_text], formula)
            own[part["key"].is_null().to_numpy(zero_copy_only=False)] = 0
            keys = part["key"] if keys is None else pa.concat_arrays([keys, part["key"]])
            bits, sums = np.vstack([bits, held]), np.vstack([sums, own])
            code, _ = codes_of(keys)
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            if len(first) < len(code):
                bits, sums = np.bitwise_or.reduceat(bits, first), np.add.reduceat(sums, first)
            keys = keys.take(pa.array(first))
            if len(first) > 1:
                yield keys[:-1], value(bits[:-1], sums[:-1])
            keys, bits, sums = keys[-1:], bits[-1:], sums[-1:]
    if keys is not None:
        yield keys, value(bits, sums)


def _scored(queries: DataFrame, postings: DataFrame, formula: str, query_id: str, key: str) -> DataFrame:
    """(query_id, key, relevance) for the postings with a score above 0. Reads the terms when it is called."""
    fields = read_fields(formula)
    weights = query_terms(queries, query_id).withColumnRenamed(query_id, "query_id")
    kind, of = weights.schema["query_id"].dataType.simpleString(), postings.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, key {of}, relevance double"
    texts = {**_field_texts(postings), "text": title_and_description(F.col("title"), F.col("description"))}
    rows = postings.select(F.col(key).alias("key"), *[texts[n].alias(n) for n in fields]).repartition("key")
    rows = rows.sortWithinPartitions("key")

    def one(sent: pa.Table) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(sent)
            for keys, value in _each_posting(batches, scorer, formula):
                for ids, found in scorer.scores(value):
                    row, query = np.nonzero(found > 0)
                    columns = [ids.take(pa.array(query)), keys.take(pa.array(row)), pa.array(found[row, query])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "key", "relevance"])

        return rows.mapInArrow(run, schema)

    return run_passes(weights, one, schema).select(
        F.col("query_id").alias(query_id), F.col("key").alias(key), "relevance"
    )


def match_queries(
    queries: DataFrame, postings: DataFrame, query_id: str = "query_id", key: str = "key"
) -> DataFrame:
    """(query_id, key): the postings with one term or more in title, description or keywords."""
    return _scored(queries, postings, "match", query_id, key).select(query_id, key)


def score_many(
    queries: DataFrame,
    postings: DataFrame,
    formula: str = "ratio",
    query_id: str = "query_id",
    key: str = "key",
) -> DataFrame:
    """(query_id, key, relevance) for the postings with a score above 0.

    ``ratio``: one point per term in the text, one more in the title. ``weighted``:
    3 for the title, 1 for the description, 0.5 for the company. Both are means.
    """
    if formula not in ("ratio", "weighted"):
        raise ValueError(f"unknown formula: {formula}")
    return _scored(queries, postings, formula, query_id, key)

"""Many queries against all postings in one pass over the texts.

The distinct terms of all queries become one automaton that a task runs over each text once,
whatever the number of terms; it finds every term, overlapping ones too, wherever it stands. The
terms a posting holds meet the queries inside its task, against a matrix of (term, query) counts, so no
text is shuffled and nothing leaves a task but counts, or the best ``k`` of each query. Each row is a
posting, also where rows share a key.

The terms are sent to the tasks in parts of bounded size (``SENT_CHARS``), a pass each. For a few terms
against a store that is searched often, ``substrings`` keeps an index in place of the pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import title_and_description
from jobloom.operators.holding import automaton, points, read_fields
from jobloom.operators.matching import _field_texts, query_terms
from jobloom.operators.ranking import top_per_group
from jobloom.session import spread

# Characters of terms in a pass.
SENT_CHARS = 1 << 20
# Queries that are scored at once, and cells (postings x terms) held for that.
QUERIES = 256
CELLS = 1 << 22


class Scorer:
    """The queries of a pass: their terms, and in blocks the number of times each query has each term."""

    def __init__(self, weights: pd.DataFrame):
        """``weights``: (query_id, term, times, n_terms)."""
        self.terms = np.sort(weights["term"].unique())
        self.blocks = []
        ids = np.sort(weights["query_id"].unique())
        at = np.searchsorted(self.terms, weights["term"])
        for begin in range(0, len(ids), QUERIES):
            some = ids[begin : begin + QUERIES]
            mine = weights["query_id"].isin(some).to_numpy()
            columns, place = np.unique(at[mine], return_inverse=True)
            part = weights[mine]
            matrix = np.zeros((len(columns), len(some)))
            matrix[place, np.searchsorted(some, part["query_id"])] = part["times"]
            size = part.groupby("query_id")["n_terms"].first().to_numpy()
            self.blocks.append((some, columns, matrix, size))
        self.step = max(1, CELLS // max(1, len(self.terms)))

    def scores(self, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query ids, rows x queries scores) of the points of some postings."""
        for some, columns, matrix, size in self.blocks:
            # Points are whole halves, so the sums are exact in any order.
            yield some, value[:, columns] @ matrix / size


def _frame_scores(scorer: Scorer, formula: str):
    """Gives (keys, query ids, rows x queries scores) of frames of texts."""
    machine = automaton(scorer.terms)
    everywhere = np.flatnonzero(scorer.terms == "")

    def held_in(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), len(scorer.terms)))
        out[:, everywhere] = 1
        if len(machine):
            for row, text in enumerate(texts):
                out[row, list({number for _, number in machine.iter(text)})] = 1
        return out

    def run(frame: pd.DataFrame):
        for begin in range(0, len(frame), scorer.step):
            part = frame[begin : begin + scorer.step]
            value = points(lambda name, part=part: held_in(part[name]), formula)
            for some, found in scorer.scores(value):
                yield part["key"].to_numpy(), some, found

    return run


def texts_of(postings: DataFrame, formula: str, key: str = "key") -> DataFrame:
    """(key, <field>...): the texts that a formula looks at, in lower case."""
    texts = _field_texts(postings) | {"text": F.lower(title_and_description(F.col("title"), F.col("description")))}
    return postings.select(F.col(key).alias("key"), *[texts[name].alias(name) for name in read_fields(formula)])


def passes(weights: DataFrame) -> Iterator[pd.DataFrame]:
    """The (query_id, term, times, n_terms) rows in parts of bounded size, whole queries each."""
    size = weights.agg(F.sum(F.char_length("term") + 16)).head()[0] or 0
    parts = size // SENT_CHARS + 1
    for number in range(parts):
        sent = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == number).toPandas()
        if not sent.empty:
            yield sent


def run_passes(rows: DataFrame, weights: DataFrame, task, schema: str) -> DataFrame:
    """What ``task`` makes of the rows in each pass."""
    found = None
    for sent in passes(weights):
        some = rows.mapInPandas(task(sent), schema)
        found = some if found is None else found.union(some)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def counting(frame_scores):
    """Rows (query_id, n) of a task: its postings with a score above 0."""

    def run(frames):
        total: dict = {}
        for frame in frames:
            for _, some, found in frame_scores(frame):
                for query, n in zip(some.tolist(), (found > 0).sum(axis=0).tolist(), strict=True):
                    total[query] = total.get(query, 0) + n
        yield pd.DataFrame(total.items(), columns=["query_id", "n"])

    return run


def keeping_best(frame_scores, k: int, queries: int):
    """Rows (query_id, key, relevance) of a task: its best ``k`` postings of each query, ties by key."""

    def best(rows: list[pd.DataFrame]) -> pd.DataFrame:
        ordered = pd.concat(rows).sort_values(["query_id", "relevance", "key"], ascending=[True, False, True])
        return ordered[ordered.groupby("query_id").cumcount() < k]

    def run(frames):
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            # The keys rise, so a stable order by score breaks ties by key.
            for keys, some, found in frame_scores(frame.sort_values("key")):
                order = np.argsort(-found, axis=0, kind="stable")[:k]
                value = np.take_along_axis(found, order, axis=0)
                row, query = np.nonzero(value > 0)
                rows = {"query_id": some[query], "key": keys[order[row, query]], "relevance": value[row, query]}
                held.append(pd.DataFrame(rows))
                size += len(row)
                if size > 4 * k * queries:
                    held = [best(held)]
                    size = len(held[0])
        if held:
            yield best(held)

    return run


def numbered_queries(queries: DataFrame, query_id: str) -> DataFrame:
    return query_terms(queries, query_id).withColumnRenamed(query_id, "query_id")


def counts_of_all(queries: DataFrame, counted: DataFrame, query_id: str) -> DataFrame:
    """(query_id, n) with the queries that nothing matches."""
    added = counted.groupBy("query_id").agg(F.sum("n").alias("n"))
    asked = queries.select(F.col(query_id).alias("query_id")).distinct()
    return asked.join(added, "query_id", "left").select(
        F.col("query_id").alias(query_id), F.coalesce("n", F.lit(0)).alias("n")
    )


def best_of_all(scored: DataFrame, k: int, query_id: str, key: str) -> DataFrame:
    order = [F.desc("relevance"), F.asc("key")]
    ranked = top_per_group(scored, ["query_id"], order, k, rank="search_rank", salt_on="key")
    return ranked.select(F.col("query_id").alias(query_id), "search_rank", F.col("key").alias(key), "relevance")


def count_many(
    queries: DataFrame, postings: DataFrame, query_id: str = "query_id", key: str = "key"
) -> DataFrame:
    """(query_id, n): the postings with a term of each query in title, description or keywords.

    A query without terms matches none. Runs one small job for the terms when it is called.
    """
    weights = numbered_queries(queries, query_id)
    kind = weights.schema["query_id"].dataType.simpleString()

    def task(sent: pd.DataFrame):
        return counting(_frame_scores(Scorer(sent), "match"))

    rows = spread(texts_of(postings, "match", key))
    return counts_of_all(queries, run_passes(rows, weights, task, f"query_id {kind}, n bigint"), query_id)


def search_many(
    queries: DataFrame, postings: DataFrame, k: int, formula: str = "weighted",
    query_id: str = "query_id", key: str = "key",
) -> DataFrame:
    """(query_id, search_rank, key, relevance): the best ``k`` postings of each query, ties by key.

    ``weighted``: 3 for a term in the title, 1 in the description, 0.5 in the company. ``ratio``:
    one point in the text, one more if also in the title. Both are means over the terms.
    """
    weights = numbered_queries(queries, query_id)
    kind, of = weights.schema["query_id"].dataType.simpleString(), postings.schema[key].dataType.simpleString()

    def task(sent: pd.DataFrame):
        return keeping_best(_frame_scores(Scorer(sent), formula), k, sent["query_id"].nunique())

    rows = spread(texts_of(postings, formula, key))
    scored = run_passes(rows, weights, task, f"query_id {kind}, key {of}, relevance double")
    return best_of_all(scored, k, query_id, key)

"""Groups of spelling variants: words one edit apart, found by an index of variable-length grams.

A word with marks at both ends has a gram at each of its places: the shortest one of two symbols
or more that is not frequent among the words, at most ``LONGEST`` symbols long. A dictionary of
the frequent grams decides how far each is read; a gram is frequent above a share of all places
that keeps the dictionary below ``DICTIONARY`` entries of each length, so it fits every task.

An edit changes only the grams that were read across its place. The largest number of grams of a
word that are read across one place is its affected-gram bound; all others are found in every word
one edit away. So a word shares at least grams - bound with a near word, and of any bound + 1 of its
grams, taken in an order common to all words, one is shared. As no gram reads more than five symbols
and a word has at least six grams, there always is one. Words are listed below their bound + 1
rarest grams; a gram that an edit leaves alone keeps its place from the start or moves by the one
symbol that the longer word has more, so a list is kept by gram, place and length. Lists longer
than ``LIST`` are cut into blocks that are compared two by two. The members of a list are
compared exactly, in chunks of bounded size; only words that are near leave a task.

A word's form is its near word of largest count, if that is twice its own or more; following
forms ends at the root, since the counts rise. Pointers are doubled until none moves.

Defined cases: a null text has no words. A null id counts as the empty text in the draw of the
deleted code point. Repeated rows count again. Words of any length are compared whole. Tables
without words give no rows. Columns of the input other than id and text are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobloom.session import new_path, shared_folder

RUN = re.compile("[a-zÀ-ÿ]+")
#: One word in so many loses a code point.
DRAWN = 97
SHORTEST = 5
LEAST = 3
LONGEST = 5
DICTIONARY = 50_000
LIST = 20_000
#: Distinct words that a task counts before it sends them on, and pairs compared at once.
HELD = 200_000
PAIRS = 1_000_000
#: Words of more code points are compared one by one.
WIDE = 60


def read_words(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text, with their counts, after the draw."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for word, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
        h = zlib.crc32(word.encode(), start)
        if h % DRAWN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= SHORTEST:
            found[word] += n
    return found


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts that occur ``least`` times or more."""

    def run(frames):
        found: Counter = Counter()
        for frame in frames:
            for key, value in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                found.update(read_words(None if key is pd.NA else key, value))
                if len(found) > HELD:
                    yield pd.DataFrame(found.items(), columns=["word", "n"])
                    found.clear()
        yield pd.DataFrame(found.items(), columns=["word", "n"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def frequent_grams(words: DataFrame, dictionary: int = DICTIONARY) -> dict[str, int]:
    """The grams above a share of all places, with their counts; at most ``dictionary`` of each length."""

    def run(frames):
        found: Counter = Counter()
        for frame in frames:
            for word in frame["word"]:
                marked = f"^{word}$"
                for size in range(2, LONGEST + 1):
                    found.update(marked[i : i + size] for i in range(len(marked) - size + 1))
                if len(found) > HELD:
                    yield pd.DataFrame(found.items(), columns=["gram", "n"])
                    found.clear()
        yield pd.DataFrame(found.items(), columns=["gram", "n"])

    places = words.agg(F.sum(F.char_length("word") + 1)).head()[0] or 0
    counted = words.mapInPandas(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") > max(1, places // dictionary)).collect()}


def grams(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram at each place, and the affected-gram bound."""
    marked = f"^{word}$"
    found = []
    across = [0] * (len(marked) + 1)
    for i in range(len(marked) - 1):
        end = i + 2
        while end - i < LONGEST and end < len(marked) and marked[i:end] in frequent:
            end += 1
        found.append(marked[i:end])
        across[i] += 1
        across[end] -= 1
    most = now = 0
    for step in across:
        now += step
        most = max(most, now)
    return found, most


def rarest(found: list[str], bound: int, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram) of the ``bound + 1`` rarest grams, in an order common to all words."""
    order = sorted(range(len(found)), key=lambda i: (frequent.get(found[i], 0), found[i], i))
    return [(i, found[i]) for i in order[: bound + 1]]


def _index(frequent: dict[str, int]):
    """The lists each word is in: those of its own length, and those of one symbol less."""

    def key(gram: str, place: int, length: int) -> int:
        return xxhash.xxh3_64_intdigest(f"{gram}/{place}/{length}".encode()) - (1 << 63)

    def run(frames):
        for frame in frames:
            out = []
            for word, n in zip(frame["word"], frame["n"], strict=True):
                found, bound = grams(word, frequent)
                size = len(word)
                for place, gram in rarest(found, bound, frequent):
                    out.append((key(gram, place, size), size, word, n))
                    if size > SHORTEST:
                        out += [(key(gram, p, size - 1), size - 1, word, n) for p in (place, place - 1) if p >= 0]
            yield pd.DataFrame(out, columns=["key", "length", "word", "n"])

    return run


def near_one_edit(a: str, b: str) -> bool:
    """Whether two different words are one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _near(left: np.ndarray, right: np.ndarray, size: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of rows of code points are near; each row has ``length`` or one more."""
    near = np.zeros(len(left), dtype=bool)
    same = np.flatnonzero((size == length) & (other == length))
    near[same] = (left[same, :length] != right[same, :length]).sum(axis=1) == 1
    for one, two, at in ((left, right, (size == length) & (other > length)), (right, left, (size > length) & (other == length))):
        at = np.flatnonzero(at)
        short, long = one[at, :length], two[at, : length + 1]
        before, after = short == long[:, :length], short == long[:, 1:]
        maybe = np.flatnonzero((before | after).all(axis=1))
        lead = np.logical_and.accumulate(before[maybe], axis=1).sum(axis=1)
        tail = np.logical_and.accumulate(after[maybe][:, ::-1], axis=1).sum(axis=1)
        near[at[maybe[lead + tail >= length]]] = True
    return near


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """The near words of every list of a task, each pair once."""
    frame = frame.drop_duplicates(["length", "key", "low", "high", "word"])
    frame = frame.sort_values(["length", "key", "low", "high"], ignore_index=True)
    pairs = []
    for length, some in frame.groupby("length", sort=False):
        words = some["word"].to_numpy()
        size = some["word"].str.len().to_numpy()
        block, two = some["block"].to_numpy(), (some["low"] != some["high"]).to_numpy()
        parts = some[["key", "low", "high"]].to_numpy()
        first = np.concatenate([[True], (parts[1:] != parts[:-1]).any(axis=1)])
        ends = np.append(np.flatnonzero(first)[1:], len(some))[np.cumsum(first) - 1]
        follow = ends - np.arange(len(some)) - 1
        wide = length > WIDE
        if not wide:
            width = int(length) + 1
            codes = np.frombuffer(
                b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), dtype=np.uint8
            ).reshape(len(words), width)
        done = np.cumsum(follow)
        begin = 0
        while begin < len(some):
            limit = (done[begin - 1] if begin else 0) + PAIRS
            stop = max(begin + 1, int(np.searchsorted(done, limit, side="right")))
            count = follow[begin:stop]
            i = np.repeat(np.arange(begin, stop), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            begin = stop
            keep = ((size[i] == length) | (size[j] == length)) & ~(two[i] & (block[i] == block[j]))
            i, j = i[keep], j[keep]
            if wide:
                near = np.array([near_one_edit(words[a], words[b]) for a, b in zip(i, j, strict=True)], dtype=bool)
            else:
                near = _near(codes[i], codes[j], size[i], size[j], int(length))
            if near.any():
                pairs.append(pd.DataFrame({"a": some.index[i[near]], "b": some.index[j[near]]}))
    if not pairs:
        return pd.DataFrame(columns=["word", "near", "near_n"], dtype=object)
    both = pd.concat(pairs)
    a, b = (np.concatenate([both[x], both[y]]) for x, y in (("a", "b"), ("b", "a")))
    words, counts = frame["word"].to_numpy(dtype=object), frame["n"].to_numpy()
    return pd.DataFrame({"word": words[a], "near": words[b], "near_n": counts[b]}).drop_duplicates(["word", "near"])


def near_words(words: DataFrame, dictionary: int = DICTIONARY, longest_list: int = LIST) -> DataFrame:
    """(word, near): an array of (n, word) of the words one edit away, for words that have any."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "gram_lists")
    found = words.mapInPandas(_index(frequent_grams(words, dictionary)), "key bigint, length bigint, word string, n bigint")
    found.write.parquet(path)
    lists = spark.read.parquet(path)
    long = (
        lists.groupBy("key")
        .agg(F.ceil(F.count("*") / longest_list).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = F.when(F.col("blocks") == 1, F.pmod("key", F.lit(8 * parts))).otherwise(F.xxhash64("key", "low", "high"))
    return (
        lists.join(long, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        .select("*", other.alias("other"))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select(task.alias("task"), "key", "length", "word", "n", "block", "low", "high")
        .groupBy("task")
        .applyInPandas(_merge, "word string, near string, near_n bigint")
        .groupBy("word")
        # A word has a bounded number of neighbours: its places times the code points that can stand there.
        .agg(F.collect_set(F.struct(F.col("near_n").alias("n"), F.col("near").alias("word"))).alias("near"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; pointers are doubled until none moves."""
    state = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("__ahead"))
        state = (
            state.join(ahead, "root", "left")
            .select("word", F.coalesce("__ahead", "root").alias("root"), F.col("__ahead").isNotNull().alias("moved"))
            .checkpoint()
        )
        if not state.where("moved").head(1):
            return state.select("word", "root")
        state = state.drop("moved")


def variant_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
    dictionary: int = DICTIONARY, longest_list: int = LIST,
) -> DataFrame:
    """Per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root``."""
    shared_folder(docs.sparkSession)
    words = vocabulary(docs, doc_id, text, least).checkpoint()
    near = near_words(words, dictionary, longest_list)
    most = F.array_max(F.transform("near", lambda x: x["n"]))
    formed = (
        words.join(near, "word", "left")
        .withColumn("form_n", most)
        .withColumn("form_n", F.when(F.col("form_n") >= 2 * F.col("n"), F.col("form_n")))
        .select(
            "word", "n", F.coalesce(F.size("near"), F.lit(0)).cast("bigint").alias("n_near"), "form_n",
            F.array_min(
                F.transform(F.filter("near", lambda x: x["n"] == F.col("form_n")), lambda x: x["word"])
            ).alias("form"),
        )
        .checkpoint()
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )

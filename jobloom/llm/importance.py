"""Importance resampling towards a target: array-scored weights, ranked by a distributed radix sort.

Every feature of a text (a run of 1 to ``words`` words) falls into one of ``buckets`` hashed
buckets. The log ratio of a bucket's share in the target and in the documents, rounded down to
thousandths, is its gain; the gains are one array of that many numbers, so a task scores a text
by looking its features up. A document's score is the sum of its gains plus noise drawn from its
id (the Gumbel trick: the highest scores are a sample without replacement by those weights).

The ranks come from a least-significant-digit radix sort over (score descending, id, number of
features); id and score tell the weight. The digits of this key are read off from below. In each pass the rows of a
block are put in the order of the digit, stably; the counts of a digit in every block, summed up
over the digits first and the blocks second, are the global offset of each run; a row's place is
its run's offset plus its place there, and the place names the row's next block. Blocks hold the
same number of rows however many rows tie, so no task gets more than one block at a time. Rows
travel once a pass. A pass is written to the shared folder, so a lost executor costs one pass.

Defined cases: a null text has no features and weight 0. A null id draws its noise from the
empty id and ranks behind equal scores with an id. Rows that share id, text and so the score
take consecutive ranks. No target, or no documents: gains of add-one smoothing, no rows. Columns
of the input other than id and text are not carried.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from jobloom.session import shared_folder

BUCKETS = 10_000
WORDS = 1
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bits of a digit, and rows of a block.
DIGIT = 12
BLOCK = 1 << 16
#: Distinct words a task keeps before it adds them up, or forgets their buckets.
HELD = 200_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ROW = np.dtype([("null", "?"), ("doc_id", "<i8"), ("n_features", "<i8"), ("weight", "<i8"), ("score", "<i8")])


def features(text: str | None, words: int = WORDS) -> list[str]:
    """The runs of 1 to ``words`` words; only A-Z are lower-cased."""
    found = WORD.findall((text or "").translate(UPPER))
    return found + [
        " ".join(found[i : i + n]) for n in range(2, words + 1) for i in range(len(found) - n + 1)
    ]


def bucket_counts(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; a task adds up its own features first."""

    def added(found: Counter) -> pd.DataFrame:
        total = np.zeros(buckets, dtype=np.int64)
        at = np.fromiter((zlib.crc32(w.encode()) % buckets for w in found), dtype=np.int64, count=len(found))
        np.add.at(total, at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        at = np.flatnonzero(total)
        return pd.DataFrame({"bucket": at, "n": total[at]})

    def run(frames):
        found: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                found.update(features(text, words))
                if len(found) > HELD:
                    yield added(found)
                    found.clear()
        yield added(found)

    counted = texts.mapInPandas(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, a number each, from the counts of all documents and the whole target."""
    sides = []
    for texts in (docs, target):
        total = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(texts, words, buckets).collect():  # at most one row a bucket
            total[row["bucket"]] = row["n"]
        sides.append([int(n) for n in total])
    many, few = (sum(side) for side in sides)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (many + buckets) / ((s + 1) * (few + buckets))))
            for s, t in zip(*sides, strict=True)
        ],
        dtype=np.int64,
    )


def score(docs: DataFrame, gain: np.ndarray, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of (doc_id, text)."""
    buckets = len(gain)

    def run(frames):
        value: dict[str, int] = {}
        for frame in frames:
            counts, weights, plain = [], [], []
            for text in frame["text"]:
                found = features(text, 1) if words == 1 else features(text, words)
                each = Counter(found)
                total = 0
                for word, n in each.items():
                    one = value.get(word)
                    if one is None:
                        one = value[word] = int(gain[zlib.crc32(word.encode()) % buckets])
                    total += n * one
                counts.append(len(found))
                weights.append(total)
                plain.append(len(found) if words == 1 else len(WORD.findall(text or "")))
                if len(value) > HELD:
                    value.clear()
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"].astype("Int64"), "n_words": plain, "n_features": counts, "weight": weights}
            )

    scored = docs.mapInPandas(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return scored.withColumn("score", (F.col("weight") + noise).cast("bigint"))


def _key(rows: np.ndarray, low: dict[str, int], width: dict[str, int], bits: int, at: int) -> np.ndarray:
    """Digit ``at`` of the composite key, counted from below; a field starts at a digit of its own."""
    for name in ("n_features", "doc_id", "null", "score"):
        digits = -(-width[name] // bits)
        if at < digits:
            value = rows[name].astype(np.int64)
            value = low["top"] - value if name == "score" else value - low[name]
            return (value >> (bits * at)) & ((1 << bits) - 1)
        at -= digits
    raise IndexError(at)


def _blocks(size: int):
    """Packs rows into blocks; a block's number comes later."""

    def run(frames):
        for frame in frames:
            rows = np.zeros(len(frame), dtype=ROW)
            rows["null"] = frame["doc_id"].isna()
            rows["doc_id"] = frame["doc_id"].fillna(0)
            for name in ("n_features", "weight", "score"):
                rows[name] = frame[name]
            for begin in range(0, len(rows), size):
                some = rows[begin : begin + size]
                yield pd.DataFrame({"rows": [some.tobytes()], "n": [len(some)]})

    return run


def _count_digit(low: dict[str, int], width: dict[str, int], bits: int, at: int):
    """Per block: its rows in the order of the digit, stably, and the runs of equal digits."""

    def run(frames):
        for frame in frames:
            out = []
            for block, packed in zip(frame["block"], frame["rows"], strict=True):
                rows = np.frombuffer(packed, dtype=ROW)
                digit = _key(rows, low, width, bits, at)
                order = np.argsort(digit, kind="stable")
                found, size = np.unique(digit, return_counts=True)
                runs = [(int(d), int(n)) for d, n in zip(found, size, strict=True)]
                out.append((block, rows[order].tobytes(), runs))
            yield pd.DataFrame(out, columns=["block", "rows", "runs"])

    return run


def _deal(size: int):
    """Rows to their places: a piece for each next block that a run of equal digits reaches into."""

    def run(frames):
        for frame in frames:
            out = []
            for packed, offsets in zip(frame["rows"], frame["offsets"], strict=True):
                rows = np.frombuffer(packed, dtype=ROW)
                begin = 0
                place = np.empty(len(rows), dtype=np.int64)
                for _, n, offset in sorted((o["digit"], o["n"], o["offset"]) for o in offsets):
                    place[begin : begin + n] = offset + np.arange(n)
                    begin += n
                to = place // size
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(rows)]])
                # Places rise inside a block, and so do the blocks they are dealt to.
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((int(to[a]), place[a:b].tobytes(), rows[a:b].tobytes()))
            yield pd.DataFrame(out, columns=["block", "places", "rows"])

    return run


def _place(frame: pd.DataFrame) -> pd.DataFrame:
    """Puts the pieces of one block at their places."""
    places = np.concatenate([np.frombuffer(p, dtype=np.int64) for p in frame["places"]])
    rows = np.concatenate([np.frombuffer(r, dtype=ROW) for r in frame["rows"]])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "rows": [rows[np.argsort(places)].tobytes()]})


def radix_ranks(scored: DataFrame, bits: int = DIGIT, size: int = BLOCK) -> DataFrame:
    """The rows with their ``rank`` from 1, by score descending, id (null last) and features.

    ``bits`` of a digit are counted at a time; a block holds ``size`` rows.
    """
    fields = ("n_features", "score", "doc_id")
    bounds = scored.agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in fields for f in (F.min, F.max)], F.max(F.col("doc_id").isNull()).alias("nulls")
    ).head()
    low = {c: bounds[f"min_{c}"] or 0 for c in fields} | {"null": 0, "top": bounds["max_score"] or 0}
    width = {c: ((bounds[f"max_{c}"] or 0) - low[c]).bit_length() for c in fields} | {"null": int(bool(bounds["nulls"]))}
    # A null id is stored as 0, which may lie below the others; its own digit outranks it.
    if bounds["nulls"]:
        low["doc_id"] = min(low["doc_id"], 0)
        width["doc_id"] = max((bounds["max_doc_id"] or 0) - low["doc_id"], -low["doc_id"]).bit_length()
    passes = sum(-(-w // bits) for w in width.values())
    blocks = (
        scored.mapInPandas(_blocks(size), "rows binary, n bigint")
        .where("n > 0")
        .select(F.monotonically_increasing_id().alias("block"), "rows")
        .checkpoint()
    )
    for at in range(passes):
        counted = blocks.mapInPandas(
            _count_digit(low, width, bits, at), "block bigint, rows binary, runs array<struct<digit:bigint,n:bigint>>"
        ).checkpoint()
        runs = counted.select("block", F.inline("runs"))
        digits = runs.groupBy("digit").agg(F.sum("n").alias("n"))
        before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        # At most 2**bits rows.
        starts = digits.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .join(starts, "digit")
            .groupBy("block")
            .agg(F.collect_list(F.struct("digit", "n", (F.col("start") + F.col("before")).alias("offset"))).alias("offsets"))
        )
        blocks = (
            counted.select("block", "rows")
            .join(offsets, "block")
            .mapInPandas(_deal(size), "block bigint, places binary, rows binary")
            .groupBy("block")
            .applyInPandas(_place, "block bigint, rows binary")
        )

    def unpacked(frames):
        for frame in frames:
            for block, packed in zip(frame["block"], frame["rows"], strict=True):
                rows = np.frombuffer(packed, dtype=ROW)
                out = pd.DataFrame({name: rows[name] for name in ("n_features", "weight", "score")})
                out.insert(0, "doc_id", pd.array(rows["doc_id"], dtype="Int64"))
                out.loc[rows["null"], "doc_id"] = pd.NA
                out["rank"] = int(block) * size + 1 + np.arange(len(rows))
                yield out

    return blocks.mapInPandas(unpacked, "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    words: int = WORDS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_features``, ``weight``, ``score`` and the ``rank`` of the rows that are drawn.

    ``percent`` of the documents with at least ``least`` words are drawn, the highest scores first.
    """
    shared_folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(rows.select("text"), target.select(F.col(target_text).alias("text")), words, buckets)
    scored = score(rows, gain, words, seed).checkpoint()
    enough = F.col("n_words") >= least
    drawn = scored.where(enough).count() * percent // 100
    ranked = radix_ranks(scored.where(enough).drop("n_words"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.union(rest)

"""Near-duplicate join on word shingles by MinHash bands, with exact verification.

A text is the set of its five-word shingles. Fixed bands replace an LSH forest: no tree of sorted
paths is kept. Of a tree of at most ``depth`` MinHash values only a prefix is signed, hashed to one
key, and two sets meet if some key is equal. One length serves all trees: the longest at which the
chance that a pair at the threshold meets in some tree reaches the target recall. A forest that
shortens its prefixes to that target ends at the same length, and longer prefixes meet no further
pairs. What meets is verified exactly on the sets.

Nothing emits pairs. Equal sets are one class from the start. Sets that meet are joined to
candidate groups by components over (set, smallest set of the prefix) edges; each group's sets
then travel once. A group too large for a task is cut into blocks by a hash, and each task
compares two blocks. A task returns, per set, how many rows it is linked to there, and one edge
of a spanning forest; components over those edges are the classes.

Defined cases: a text of one to four words has one shingle, all its words; a text without words
(null too) is linked to nothing. Repeated rows count as links of each other. ``class_id`` is the
smallest id of the class, null if none of it has an id. Texts of any length are hashed whole.
Rows are told apart by id and a digest of the text.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobloom.llm.components import components
from jobloom.session import shared_folder

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
TREES = 20
DEPTH = 8
#: A task compares at most two blocks of about so many sets and shingles.
BLOCK_SETS = 2_000
BLOCK_SHINGLES = 1_000_000
#: Parts in which the sets of a group are told its number of blocks.
SALTS = 64
#: Shingles that more sets of a task have go into a matrix, others are paired directly.
COMMON = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from ``depth`` down, at which the forest reaches the recall."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    value = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        value = value * _STEP + hashed[k : len(words) - size + 1 + k]
    value ^= value >> np.uint64(31)
    value *= _MIX
    value ^= value >> np.uint64(29)
    return np.unique(value)


def _name(found: np.ndarray) -> str:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def _sign(trees: int, length: int):
    """Per row: the name of its set, the set's size, and the tree prefixes."""
    draw = np.random.default_rng(5)
    times = draw.integers(0, 1 << 63, trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, trees * length, dtype=np.uint64)
    number = np.arange(trees, dtype=np.uint64)

    def prefixes(found: np.ndarray) -> list[int]:
        least = np.full(trees * length, np.uint64((1 << 64) - 1))
        for begin in range(0, len(found), 4096):
            some = found[begin : begin + 4096, None] * times
            some += plus
            np.minimum(least, some.min(axis=0), out=least)
        path = number.copy()
        for values in least.reshape(trees, length).T:
            path = (path ^ values) * _STEP
            path ^= path >> np.uint64(32)
        return path.view(np.int64).tolist()

    def run(frames):
        for frame in frames:
            rows = []
            for key, digest, text in zip(frame["doc_id"], frame["digest"], frame["text"], strict=True):
                found = shingles(text)
                rows.append((key, digest, _name(found), len(found), prefixes(found) if len(found) else []))
            out = pd.DataFrame(rows, columns=["doc_id", "digest", "name", "n", "paths"])
            yield out.astype({"doc_id": "Int64"})

    return run


def _sets(frames):
    """The wanted sets, as bytes, each once a task however often its row is repeated."""
    sent: set[str] = set()
    for frame in frames:
        frame = frame[~frame["name"].isin(sent)].drop_duplicates(["name", "text"])
        found = [shingles(t) for t in frame["text"]]
        mine = [_name(f) == name for f, name in zip(found, frame["name"], strict=True)]
        out = frame.drop(columns=["text"])
        out["hashes"] = [f.tobytes() for f in found]
        out = out[mine]
        sent.update(out["name"])
        yield out


def _links(sets: list[np.ndarray], side: np.ndarray | None, ratio: Fraction) -> np.ndarray:
    """Which sets reach the ratio; only between the two sides if the task has sides, empty or not."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        shared = np.array([[0, np.intersect1d(*sets, assume_unique=True).size]] * 2)
        shared[1] = shared[1, ::-1]
    else:
        owner = np.repeat(np.arange(n), sizes)
        values = np.concatenate(sets)
        by = np.argsort(values, kind="stable")
        owner, values = owner[by], values[by]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        times = np.diff(np.append(first, len(values)))
        shared = np.zeros((n, n), dtype=np.int64)
        for count in range(2, min(COMMON, n) + 1):
            at = first[times == count]
            if not len(at):
                continue
            members = owner[at[:, None] + np.arange(count)]
            for i in range(count):
                for j in range(i + 1, count):
                    np.add.at(shared, (members[:, i], members[:, j]), 1)
        shared += shared.T
        common = np.flatnonzero(times > COMMON)
        for begin in range(0, len(common), 4096):
            some = common[begin : begin + 4096]
            matrix = np.zeros((n, len(some)), dtype=np.float32)
            place = np.repeat(np.arange(len(some)), times[some])
            at = np.concatenate([np.arange(f, f + t) for f, t in zip(first[some], times[some], strict=True)])
            matrix[owner[at], place] = 1
            shared += np.rint(matrix @ matrix.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = ratio.denominator * shared >= ratio.numerator * union
    if side is not None:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _verify(ratio: Fraction):
    """Of one task: for each set the rows it is linked to there, and a set of its class."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("name").sort_values(["grp", "name"])
        rows = []
        for _, some in frame.groupby("grp", sort=False):
            names, copies = some["name"].tolist(), some["copies"].to_numpy()
            # Links inside a block are those of the task (block, block), also where the other block is empty.
            two = some["low"].iloc[0] != some["high"].iloc[0]
            side = (some["block"] == some["high"]).to_numpy() if two else None
            sets = [np.frombuffer(h, dtype=np.uint64) for h in some["hashes"]]
            linked = _links(sets, side, ratio)
            count = linked @ copies
            root = np.arange(len(names))
            while True:
                least = np.minimum(root, np.where(linked, root[None, :], len(names)).min(axis=1))
                if (least == root).all():
                    break
                root = least
            rows += [(a, int(c), names[r]) for a, c, r in zip(names, count, root, strict=True)]
        return pd.DataFrame(rows, columns=["name", "links", "peer"])

    return run


def text_digest(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
) -> DataFrame:
    """Per row: ``doc_id``, ``class_id``, ``n_links`` (rows within the threshold), ``n_shingles``."""
    found = classed_rows(docs, doc_id, text, threshold, trees, depth, recall)
    return found.select("doc_id", "class_id", "n_links", "n_shingles")


def classed_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
) -> DataFrame:
    """Like ``near_duplicates``, with ``digest`` of the row's text and ``class_digest``.

    ``class_id`` and ``class_digest`` name the first row of the class: by id, those without one
    last, then by digest.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ratio = Fraction(threshold).limit_denominator(1000)
    length = prefix_length(threshold, trees, depth, recall)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    signed = rows.mapInPandas(
        _sign(trees, length), "doc_id bigint, digest bigint, name string, n bigint, paths array<bigint>"
    ).checkpoint()
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = signed.where("n > 0").groupBy("name").agg(
        F.min(row).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("paths").alias("paths"),
    )
    paths = classes.select("name", F.explode("paths").alias("path"))
    least = paths.groupBy("path").agg(F.min("name").alias("peer"), F.count("*").alias("k")).where("k > 1")
    edges = paths.join(least.select("path", "peer"), "path").where("name <> peer").select("name", "peer").distinct()
    groups = components(edges, "name", "peer").select(F.col("node").alias("name"), F.col("root").alias("grp"))
    classes = classes.drop("paths")
    members = groups.join(classes, "name")
    sizes = members.groupBy("grp").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    # Few groups have several blocks; only these are looked up, in parts, so that a hot one is no one task.
    several = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = (
        members.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
        .join(several, ["grp", "salt"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        .drop("salt")
        .checkpoint()
    )
    total = members.agg(F.sum("n")).head()[0] or 0
    tasks = max(parts, total // (4 * BLOCK_SHINGLES) + 1)
    wanted = members.select(F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"), "name", "grp", "copies", "blocks", "block")
    sets = (
        rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
        .select("text", "name", "grp", "copies", "blocks", "block")
        .mapInPandas(_sets, "name string, grp string, copies bigint, blocks int, block int, hashes binary")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("string")).otherwise(
        F.concat_ws("/", "grp", "low", "high")
    )
    compared = (
        sets.select("*", other.alias("other"))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .withColumn("task", task)
        .select("task", "name", "grp", "copies", "block", "low", "high", "hashes")
        .groupBy("task")
        .applyInPandas(_verify(ratio), "name string, links bigint, peer string")
        .checkpoint()
    )
    roots = components(compared.select("name", "peer"), "name", "peer")
    links = compared.groupBy("name").agg(F.sum("links").alias("links"))
    named = (
        classes.join(roots.withColumnRenamed("node", "name"), "name", "left")
        .join(links, "name", "left")
        .withColumn("root", F.coalesce("root", "name"))
    )
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    named = named.join(heads, "root").select(
        "name", F.col("head.doc_id").alias("class_id"), F.col("head.digest").alias("class_digest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    found = signed.select("doc_id", "digest", "name", F.col("n").alias("n_shingles")).join(named, "name", "left")
    return found.select(
        "doc_id",
        "digest",
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n_shingles") > 0, F.col("class_digest")).otherwise(F.col("digest")).alias("class_digest"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "n_shingles",
    )

"""Stupid-backoff scores of documents under the n-gram counts of all the others.

Documents are spread over blocks by a hash, the words of many in one compressed row, n-grams over
buckets by ranges of their hash. An n-gram
found in one block only is counted there; most are, so blocks first learn which ones they share.
A block sends the first ``PREFIX`` bits of each of its distinct n-grams once to the bucket, sorted,
as differences; the bucket answers a bit for each: another one begins with the same bits. For these
the block sends the other bits of the hash and its count. Buckets put the parts together and add up
the counts: the count table, partitioned by hash, of whole hashes, so a prefix in common costs bytes
and never a count. They answer each block, in the order in which it asked, how often other blocks
have the n-gram. So a frequent n-gram costs a bucket one entry per block, however many documents
hold it. The block adds its own counts and sums the scores of each document. What a block asks is a
function of its set of documents, so a lost and repeated task asks the same.

The score of a word is its count after its context divided by the context's count, without the
document's own counts; a context not seen elsewhere backs off to the next shorter one at
``ALPHA``, in the end to the word's share of all words; a word found nowhere else counts as half
a word. ``score`` is the mean natural logarithm over the words, null for a text without words.
Words are lower-cased and end at white space. Null texts have no words; rows are scored apart,
repeated ones with each other in the counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

ORDER = 3
ALPHA = 0.4
#: Of the 64 bits of a hash: enough to tell 2**36 n-grams apart but for one in 16.
PREFIX = 40
#: Bytes of words that a task gathers before it sends them to the blocks.
GATHERED = 1 << 26

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_REST = np.uint64(64 - PREFIX)


def _zipped(data: bytes, level: int = 1) -> bytes:
    """Smaller than what the shuffle's own compression makes of it."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def _unzipped(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, compressed: small ones have planes of zeros."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + _zipped(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzipped(blob[1:]), dtype=np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel()


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids and words, of many documents of a block each: a line of words for a document."""
    held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

    def flush() -> pa.RecordBatch:
        rows = []
        for block, (ids, lines) in held.items():
            keys = np.array([k or 0 for k in ids], dtype="<i8").view("<u8")
            absent = np.array([k is None for k in ids], dtype=np.uint8)
            rows.append((block, _packed(keys), _packed(absent), _zipped(b"\n".join(lines), 3)))
        held.clear()
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "absent", "lines"])

    size = 0
    for batch in batches:
        for block, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            line = b" ".join((text or "").lower().encode().split())
            held[block][0].append(key)
            held[block][1].append(line)
            size += len(line)
            if size > GATHERED:
                yield flush()
                size = 0
    if held:
        yield flush()


def _words(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a block, one text after the other; the number of words of each text."""
    held = []
    for line in (line for blob in frame["lines"] for line in _unzipped(blob).split(b"\n")):
        words = line.split()
        held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    sizes = np.array([len(h) for h in held], dtype=np.int64)
    return np.concatenate([np.empty(0, dtype=np.uint64), *held]), sizes


def _grams(word: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length n, the hashes of all runs of n words of a text, and the places of their last words."""
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    run = word
    for n in range(order):
        if n:
            run = np.concatenate([run[:1], (run[:-1] * _STEP) ^ word[1:]])
            run = (run ^ (run >> np.uint64(29))) * _MIX
            run = run ^ (run >> np.uint64(32))
        at = np.flatnonzero(place >= n)
        yield run[at], at


def _firsts(*runs: np.ndarray) -> np.ndarray:
    """Where one of the arrays differs from the entry before."""
    new = np.ones(len(runs[0]), dtype=bool)
    new[1:] = False
    for values in runs:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.append(first, size))


def _counted(frame: pd.DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the distinct n-grams of a block, sorted, with their counts."""
    found = []
    for keys, _ in _grams(*_words(frame), order):
        keys = np.sort(keys)
        first = _firsts(keys)
        found.append((keys[first], _lengths(first, len(keys))))
    return found


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[slice]:
    """Buckets are ranges of the hash, so sorted keys are sorted by bucket."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield slice(a, b)


def _ask(order: int, buckets: int):
    """The prefixes of a block's n-grams, and its number of words, for each bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        sent: list[list[bytes]] = [[] for _ in range(buckets)]
        found = _counted(frame, order)
        for keys, _ in found:
            for mine, part in zip(sent, _by_bucket(keys, buckets), strict=True):
                mine.append(_packed(np.diff(keys[part] >> _REST, prepend=np.uint64(0))))
        words = int(found[0][1].sum())
        rows = [(bucket, block, prefixes, words) for bucket, prefixes in enumerate(sent)]
        return pd.DataFrame(rows, columns=["bucket", "block", "prefixes", "words"])

    return run


def _read(asked: pd.DataFrame, n: int) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """The prefixes that a bucket got, the slice of each row, and which of them are there twice."""
    each = [np.cumsum(_unpacked(p[n])) for p in asked["prefixes"]]
    ends = np.cumsum([len(p) for p in each]).tolist()
    prefixes = np.concatenate(each)
    by = np.argsort(prefixes)
    first = _firsts(prefixes[by])
    size = _lengths(first, len(prefixes))
    shared = np.empty(len(prefixes), dtype=bool)
    shared[by] = np.repeat(size > 1, size)
    return prefixes, [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)], shared


def _share(asked: pd.DataFrame) -> pd.DataFrame:
    """A bit for each prefix of each block: there is another n-gram or block with it."""
    bits: list[list[bytes]] = [[] for _ in range(len(asked))]
    for n in range(len(asked["prefixes"].iloc[0])):
        _, rows, shared = _read(asked, n)
        for mine, row in zip(bits, rows, strict=True):
            mine.append(_packed(np.packbits(shared[row])))
    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "shared": bits})


def _tell(order: int, buckets: int):
    """The other bits and the counts of a block's n-grams that may be in another block."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "rests", "counts"]
        if not len(docs):
            return pd.DataFrame({c: [] for c in columns})
        block = int(docs["block"].iloc[0])
        bits = answers.sort_values("bucket")["shared"].tolist()
        sent: list[tuple[list, list]] = [([], []) for _ in range(buckets)]
        for n, (keys, counts) in enumerate(_counted(docs, order)):
            for bucket, part in enumerate(_by_bucket(keys, buckets)):
                shared = np.unpackbits(_unpacked(bits[bucket][n]).astype(np.uint8), count=part.stop - part.start).view(bool)
                sent[bucket][0].append(_packed(keys[part][shared] & ((np.uint64(1) << _REST) - np.uint64(1))))
                sent[bucket][1].append(_packed(counts[part][shared]))
        return pd.DataFrame([(bucket, block, *both) for bucket, both in enumerate(sent)], columns=columns)

    return run


def _answer(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """For each block, in the order of its keys, their counts in other blocks; with the number of all words."""
    told = told.set_index("block").loc[asked["block"]]
    others: list[list[bytes]] = [[] for _ in range(len(asked))]
    for n in range(len(asked["prefixes"].iloc[0])):
        prefixes, rows, shared = _read(asked, n)
        keys = (prefixes[shared] << _REST) | np.concatenate([_unpacked(r[n]) for r in told["rests"]])
        counts = np.concatenate([_unpacked(c[n]) for c in told["counts"]])
        by = np.argsort(keys)
        first = _firsts(keys[by])
        total = np.empty_like(counts)
        if len(keys):
            total[by] = np.repeat(np.add.reduceat(counts[by], first), _lengths(first, len(keys)))
        found = np.zeros(len(prefixes), dtype=np.uint64)
        found[shared] = total - counts
        for mine, row in zip(others, rows, strict=True):
            mine.append(_packed(found[row]))
    return pd.DataFrame({"block": asked["block"], "bucket": asked["bucket"], "others": others, "words": asked["words"].sum()})


def _score(order: int, alpha: float):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "n_words": [], "score": []})
        answers = answers.sort_values("bucket")
        word, sizes = _words(docs)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        best = shorter = np.empty(0)
        for n, (keys, at) in enumerate(_grams(word, sizes, order)):
            # Equal n-grams stand together, in them those of one document.
            by = np.argsort(keys, kind="stable")
            keys, at = keys[by], at[by]
            first, own = _firsts(keys), _firsts(keys, doc[at])
            count, mine = _lengths(first, len(keys)), _lengths(own, len(keys))
            elsewhere = np.concatenate([_unpacked(o[n]) for o in answers["others"]]).astype(np.int64)
            seen = np.zeros(len(word), dtype=np.int64)
            seen[at] = np.repeat(elsewhere + count, count) - np.repeat(mine, mine)
            # From the word alone up: the longest context with a count decides.
            if n == 0:
                words = np.maximum(int(answers["words"].iloc[0]) - sizes, 1)
                best = np.log(np.where(seen > 0, seen, 0.5) / np.repeat(words, sizes)) + (order - 1) * np.log(alpha)
            else:
                tail = np.flatnonzero(seen > 0)
                best[tail] = np.log(seen[tail] / shorter[tail - 1]) + (order - 1 - n) * np.log(alpha)
            shorter = seen
        ends = np.cumsum(sizes)
        # Words near the start have no longer context to back off from.
        for k in range(order - 1):
            best[(ends - sizes + k)[sizes > k]] -= (order - 1 - k) * np.log(alpha)
        scores = [float(best[b - s : b].mean()) if s else None for s, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        keys, absent = (np.concatenate([_unpacked(blob) for blob in docs[c]]) for c in ("ids", "absent"))
        ids = pd.arrays.IntegerArray(keys.view("<i8"), absent.astype(bool))
        return pd.DataFrame({"doc_id": ids, "n_words": sizes, "score": scores}).astype({"score": "float64"})

    return run


def backoff_scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``score``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = parts * 2
    spread = F.pmod(F.xxhash64(F.col(doc_id), F.substring(F.col(text), 1, 200)), F.lit(blocks)).cast("int")
    rows = docs.select(spread.alias("block"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_gather, "block int, ids binary, absent binary, lines binary").repartition(parts, "block")
    asked = rows.groupBy("block").applyInPandas(
        _ask(order, parts), "bucket int, block int, prefixes array<binary>, words bigint"
    )
    shared = asked.groupBy("bucket").applyInPandas(_share, "block int, bucket int, shared array<binary>")
    told = (
        rows.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInPandas(_tell(order, parts), "bucket int, block int, rests array<binary>, counts array<binary>")
    )
    answers = (
        asked.groupBy("bucket")
        .cogroup(told.groupBy("bucket"))
        .applyInPandas(_answer, "block int, bucket int, others array<binary>, words bigint")
    )
    return (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_score(order, alpha), "doc_id bigint, n_words bigint, score double")
    )

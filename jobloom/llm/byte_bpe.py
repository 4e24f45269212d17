"""Byte-level BPE: encoding of whole texts by a table of ranks, and decoding.

The pre-token pattern is not run as a regular expression. Each code point has a class; each
class is a function on the nine states of a small automaton, and functions compose
associatively, so the state before every code point comes from a prefix scan in a few array
steps. State, class and next class say where a token begins. The slices go through pair merging,
lowest rank first and leftmost on ties, behind a cache of bounded size. A token's bytes follow
from its id, so running lengths of the ids are the offsets that decoding copies to.

A null or empty text has no ids. Special tokens are not recognised. Texts of any length take
memory in proportion to themselves. Input columns pass through, but for those named like a result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Merged pre-tokens that a worker keeps.
CACHE = 300_000
#: Characters whose pre-tokens are found at once.
SCAN = 1 << 20
#: Bytes of a pre-token up to which it is merged beside others.
SIDE_BY_SIDE = 32
NEVER = 1 << 30

# Classes of code points; the last five are letters or signs that can end or start a contraction.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, ENDS, RV, EL, EE = range(10)
# States: what the code point before was.
FRESH, AFTER_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHER, QUOTED, QUOTED_RV, QUOTED_L, CONTRACTED = range(9)
# White space by Unicode, other than the space itself.
WHITE = (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _classes() -> np.ndarray:
    letters = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((letters.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8)
    table[list(WHITE)] = BLANK
    for signs, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", ENDS), ("rv", RV), ("l", EL), ("e", EE)):
        table[[ord(c) for c in signs]] = kind
    return table


def _next_state(state: int, kind: int) -> int:
    if kind == BLANK:
        return FRESH
    if kind == SPACE:
        return AFTER_SPACE
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == OTHER:
        return IN_OTHER
    if kind == QUOTE:
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, QUOTED) else QUOTED
    if state == QUOTED:
        return {ENDS: CONTRACTED, RV: QUOTED_RV, EL: QUOTED_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((QUOTED_RV, EE), (QUOTED_L, EL)):
        return CONTRACTED
    return IN_LETTERS


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions that classes compose to: number of each class's, table of products, images of states."""
    generators = [tuple(_next_state(s, k) for s in range(9)) for k in range(10)]
    known = {tuple(range(9)): 0}
    functions = [tuple(range(9))]
    for f in functions:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
    of_class = np.array([known[g] for g in generators], dtype=np.uint8 if len(functions) < 256 else np.uint16)
    product = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], dtype=of_class.dtype)
    return of_class, product, np.array(functions, dtype=np.uint8)


def _scan(items: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Prefix products: by columns inside rows of 64, then over the totals of the rows."""
    n = len(items)
    if n <= 1:
        return items
    width = min(64, n)
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=items.dtype)
    padded[:n] = items
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    for k in range(1, width):
        columns[k] = product[columns[k - 1], columns[k]]
    if rows > 1:
        before = np.concatenate([np.zeros(1, dtype=items.dtype), _scan(columns[-1], product)[:-1]])
        columns = product[before[None, :], columns]
    return columns.T.reshape(-1)[:n]


def token_starts(texts: Sequence[str]) -> list[np.ndarray]:
    """Where the pre-tokens of each text begin, in code points."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    if not len(points):
        return [np.empty(0, dtype=np.int64) for _ in texts]
    of_class, product, images = _monoid()
    kind = _classes()[points]
    state = np.empty(len(kind), dtype=np.uint8)
    state[0] = FRESH
    state[1:] = images[_scan(of_class[kind[:-1]], product), FRESH]
    after = np.append(kind[1:], np.uint8(BLANK))
    # A line feed between two texts ends a token as the end of a text does, and leaves a fresh state.
    starts = _starts_table()[state, kind, after]
    starts[(begins + sizes)[:-1]] = False
    starts[begins[sizes > 0]] = True
    starts = np.flatnonzero(starts)
    cuts = np.searchsorted(starts, begins)
    return [s - b for s, b in zip(np.split(starts, cuts[1:]), begins, strict=True)]


@functools.cache
def _starts_table() -> np.ndarray:
    """Whether a token begins at a code point: by the state before, its class and the next class."""
    table = np.zeros((9, 10, 10), dtype=bool)
    for s, k, a in np.ndindex(9, 10, 10):
        if k in (BLANK, SPACE):
            # Inside a run of white space, only the last one before other text begins a token.
            begins = s not in (FRESH, AFTER_SPACE) or a not in (BLANK, SPACE)
        elif s in (FRESH, AFTER_SPACE):
            begins = s == FRESH
        elif k == NUMBER:
            begins = s != IN_NUMBERS
        elif k in (OTHER, QUOTE):
            begins = s not in (IN_OTHER, QUOTED)
        elif s == QUOTED:
            begins = not (k == ENDS or (k == RV and a == EE) or (k == EL and a == EL))
        else:
            begins = s not in (IN_LETTERS, QUOTED_RV, QUOTED_L)
        table[s, k, a] = begins
    return table


class ByteBpe(dict):
    """Cache of pre-tokens: their ids and the decimals of these. It starts over when full."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.token = tokens
        # Every way in which two tokens join to a third, sorted by the pair of their ids.
        joins = [
            ((self.ranks[t[:k]] << 32) | self.ranks[t[k:]], rank)
            for t, rank in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        joins.sort()
        self.pairs = np.array([pair for pair, _ in joins] + [1 << 62], dtype=np.int64)
        self.joined = np.array([rank for _, rank in joins] + [NEVER], dtype=np.int32)

    def _learn(self, tokens: set[str]) -> None:
        """Put pre-tokens into the cache; short ones are merged side by side, a pair of each a step."""
        pieces = [t.encode() for t in tokens]
        short, long = [], []
        for token, piece in zip(tokens, pieces, strict=True):
            whole = self.ranks.get(piece)
            if whole is not None:
                self[token] = ((whole,), str(whole))
            elif len(piece) <= SIDE_BY_SIDE and len(pieces) > 64:
                short.append((token, piece))
            else:
                long.append((token, piece))
        for token, piece in long:
            ids = tuple(self._merge_long([self.bytes[b] for b in piece]))
            self[token] = (ids, ",".join(map(str, ids)))
        short.sort(key=lambda x: len(x[1]))
        for begin in range(0, len(short), 20_000):
            some = short[begin : begin + 20_000]
            for (token, _), ids in zip(some, self._merge([p for _, p in some]), strict=True):
                self[token] = (ids, ",".join(map(str, ids)))

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left.astype(np.int64) << 32) | right
        place = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[place] == pair, self.joined[place], np.int32(NEVER))

    def _merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece: a row per piece, merged at its lowest rank, leftmost first."""
        width = max(map(len, pieces))
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], np.array(self.bytes, dtype=np.int32)[data], np.int32(-1))
        ranks = np.full((len(pieces), width), NEVER, dtype=np.int32)
        row, at = np.nonzero(column[1:] < sizes[:, None])
        ranks[row, at] = self._ranks_of(ids[row, at], ids[row, at + 1])
        done_ids, done_rows = [], []
        rows = np.arange(len(pieces))
        while True:
            at = ranks.argmin(axis=1)
            here = np.arange(len(ids))
            least = ranks[here, at]
            if (over := least == NEVER).any():
                done_ids.append(ids[over])
                done_rows.append(rows[over])
                go = ~over
                ids, ranks, rows, at, least = ids[go], ranks[go], rows[go], at[go], least[go]
                here = np.arange(len(ids))
            if not len(ids):
                break
            # Drop the column after the pair; the pair's own becomes the join.
            source = column + (column > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            ids[here, at] = least
            source = column + (column >= at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[:, -1] = NEVER
            ranks[here, at] = NEVER
            some = np.flatnonzero(ids[here, np.minimum(at + 1, width - 1)] >= 0)
            some = some[at[some] + 1 < width]
            ranks[some, at[some]] = self._ranks_of(least[some], ids[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self._ranks_of(ids[some, at[some] - 1], least[some])
        out: list[tuple[int, ...]] = [()] * len(pieces)
        for block, at in zip(done_ids, done_rows, strict=True):
            counts = (block >= 0).sum(axis=1).tolist()
            for r, values, count in zip(at.tolist(), block.tolist(), counts, strict=True):
                out[r] = tuple(values[:count])
        return out

    def _join(self, left: int, right: int) -> int:
        """The rank of two ids' join; very large if they don't join."""
        return self.ranks.get(self.token[left] + self.token[right], NEVER)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for pre-tokens of any length."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(pairwise(ids)) if (r := self._join(a, b)) < NEVER]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            r = right[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = rank, -1
            right[k] = after = right[r]
            if after < n:
                left[after] = k
                if (new := self._join(rank, ids[after])) < NEVER:
                    heapq.heappush(heap, (new, k, rank, ids[after]))
            if (before := left[k]) >= 0 and (new := self._join(ids[before], rank)) < NEVER:
                heapq.heappush(heap, (new, before, ids[before], rank))
        return [x for x in ids if x >= 0]

    def tokens(self, texts: Sequence[str]) -> Iterator[list[tuple[tuple[int, ...], str]]]:
        """For each text, its pre-tokens in order: their ids and the decimals of these."""
        begin, size = 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size < SCAN and end < len(texts):
                continue
            some, found = texts[begin:end], []
            for text, starts in zip(some, token_starts(some), strict=True):
                cuts = starts.tolist()
                cuts.append(len(text))
                found.append([text[a:b] for a, b in pairwise(cuts)])
            self.ready(chain.from_iterable(found))
            for tokens in found:
                yield [self[t] for t in tokens]
            begin, size = end, 0

    def ready(self, tokens: Iterable[str]) -> None:
        """Have pre-tokens in the cache."""
        tokens = set(tokens)
        new = {t for t in tokens if t not in self}
        if len(self) + len(new) > CACHE:
            self.clear()
            new = tokens
        self._learn(new)

    def sizes_of(self, tokens: Sequence[str]) -> list[int]:
        """The number of ids of each pre-token."""
        self.ready(tokens)
        return [len(self[t][0]) for t in tokens]

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.fromiter(chain.from_iterable([t[0] for t in found]), dtype=np.int32) for found in self.tokens(texts)]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the decoded bytes."""
        return np.cumsum(self.sizes[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        source = np.repeat(self.begins[ids] - ends + sizes, sizes)
        source += np.arange(len(source))
        return self.flat[source].tobytes()


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The encoder of a rank file, once per worker; the path must be readable on every executor."""
    return ByteBpe(path)


def _others(df: DataFrame, *results: str) -> list[str]:
    return [c for c in df.columns if c not in results]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``ends``, the offsets at which each token ends in the bytes of the text."""

    def run(frames):
        bpe = byte_bpe(path)
        for frame in frames:
            ids = bpe.ids([t or "" for t in frame.pop("__text")])
            frame["ids"] = ids
            frame["ends"] = [bpe.ends(i) for i in ids]
            yield frame

    others = _others(docs, "ids", "ends")
    rows = docs.select(*others, F.col(text).alias("__text"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInPandas(run, f"{fields}, ids array<int>, ends array<bigint>")


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the ids; null ids have none."""

    def run(frames):
        bpe = byte_bpe(path)
        for frame in frames:
            frame["decoded"] = [
                bpe.decode(np.asarray(i if i is not None else (), dtype=np.int64)) for i in frame[ids]
            ]
            yield frame

    others = _others(tokens, "decoded")
    fields = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in others)
    return tokens.select(*others).mapInPandas(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the number of ids, and digests of the ids and of what they decode to.

    One pass without the ids leaving the task: ``encode`` and ``decode`` for a corpus to check.
    """

    def run(frames):
        bpe = byte_bpe(path)
        for frame in frames:
            rows = []
            texts = [t or "" for t in frame["text"]]
            for key, found in zip(frame["doc_id"], bpe.tokens(texts), strict=True):
                ids = np.fromiter(chain.from_iterable([t[0] for t in found]), dtype=np.int64)
                decimals = ",".join([t[1] for t in found]).encode()
                rows.append((key, len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

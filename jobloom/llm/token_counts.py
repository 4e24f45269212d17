"""Token counts that follow edits.

Each document keeps a segment tree. A leaf is a run of pre-tokens; a node has the code points and
tokens below it. An edit finds its leaves by their sums, and only they are encoded again, with a
leaf before and as many after as it takes until an old leaf begins at a new pre-token: from
there on nothing changes, since the pattern reads forward only. Then the sums above are renewed.

Edits apply in order; places refer to the text as the edits before left it, and are clipped to
it. A null text is empty, null edits are none, a null replacement is empty. Counting uses the
encoder of ``byte_bpe``. Columns of the input pass through, but for those named like a result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.byte_bpe import ByteBpe, byte_bpe, token_starts

#: Pre-tokens in a leaf.
LEAF = 48
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"
RESULTS = ("n_tokens", "n_tokens_after", "n_edits", "n_encoded_again", "n_chars_after")


class CountTree:
    """The token count of a text under edits."""

    def __init__(self, bpe: ByteBpe, text: str, starts: np.ndarray | None = None) -> None:
        self.bpe = bpe
        self.again = 0
        self._build(self._leaves(text, token_starts([text])[0] if starts is None else starts))

    def _leaves(self, text: str, starts: np.ndarray, count: int | None = None) -> list[tuple[str, int]]:
        """A text as leaves: of ``LEAF`` pre-tokens, or ``count`` leaves of equal numbers."""
        cuts = starts.tolist()
        cuts.append(len(text))
        sizes = self.bpe.sizes_of([text[a:b] for a, b in pairwise(cuts)])
        total = len(cuts) - 1
        step = LEAF if count is None else max(1, -(-total // count))
        leaves = []
        for k in range(0, total, step):
            end = min(k + step, total)
            leaves.append((text[cuts[k] : cuts[end]], sum(sizes[k:end])))
        return leaves + [("", 0)] * ((count or 1) - len(leaves))

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = [text for text, _ in leaves]
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for k, (text, tokens) in enumerate(leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = len(text), tokens
        for k in range(self.width - 1, 0, -1):
            self._add_up(k)

    def _add_up(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf with a place, and the place where the leaf starts; the last leaf for the end."""
        if place >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - len(self.leaves[last])
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace [start, stop) by a text."""
        region = self.region(start, stop, text)
        while region is not None:
            region = self.settle(*region, token_starts([region[2] + region[3]])[0])

    def region(self, start: int, stop: int, text: str) -> tuple[int, int, str, str]:
        """The leaves an edit touches, their new text, and what is read after it."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        low, begin = self._find(start)
        high, _ = self._find(stop)
        # At least two unchanged code points stand before the edit, or it is the start.
        while low and start - begin < 2:
            low -= 1
            begin -= len(self.leaves[low])
        region = "".join(self.leaves[low : high + 1])
        region = region[: start - begin] + text + region[stop - begin :]
        return low, high, region, self._after(high)

    def _after(self, high: int) -> str:
        after, k = "", high + 1
        while k < len(self.leaves) and len(after) < 2:
            after += self.leaves[k]
            k += 1
        return after

    def settle(self, low: int, high: int, region: str, after: str, starts: np.ndarray):
        """Take the new leaves over; or the next larger region, if no old leaf begins at a new token."""
        place = int(np.searchsorted(starts, len(region)))
        if after and (place == len(starts) or starts[place] != len(region)):
            high += 1
            return low, high, region + self.leaves[high], self._after(high)
        self.again += len(region)
        starts = starts[:place]
        if place > 8 * LEAF * (high - low + 1):
            old = [(t, self.tokens[self.width + k]) for k, t in enumerate(self.leaves)]
            self._build(old[:low] + self._leaves(region, starts) + old[high + 1 :])
            return None
        changed = set()
        for k, (piece, tokens) in enumerate(self._leaves(region, starts, high - low + 1), low):
            self.leaves[k] = piece
            self.chars[self.width + k], self.tokens[self.width + k] = len(piece), tokens
            changed.add((self.width + k) // 2)
        while changed and 0 not in changed:
            for k in changed:
                self._add_up(k)
            changed = {k // 2 for k in changed}
        return None


def _edit_all(trees: list[CountTree], changes: list[list]) -> None:
    """The edits of many documents: the first of each, then the second; a scan reads all regions of a round."""
    for turn in range(max(map(len, changes), default=0)):
        live = [
            (tree, tree.region(c[turn]["start"] or 0, c[turn]["stop"] or 0, c[turn]["text"] or ""))
            for tree, c in zip(trees, changes, strict=True)
            if turn < len(c)
        ]
        while live:
            found = token_starts([r[2] + r[3] for _, r in live])
            live = [
                (tree, more)
                for (tree, region), starts in zip(live, found, strict=True)
                if (more := tree.settle(*region, starts)) is not None
            ]


def recount(docs: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Adds the tokens before and after the edits of each row, and the code points encoded again."""

    def run(frames):
        bpe = byte_bpe(path)
        for frame in frames:
            texts = [t or "" for t in frame.pop("__text")]
            out = []
            for begin in range(0, len(texts), 256):
                some = texts[begin : begin + 256]
                found = token_starts(some)
                bpe.ready(t[a:b] for t, s in zip(some, found, strict=True) for a, b in pairwise([*s.tolist(), len(t)]))
                changes = [
                    [] if c is None else [x for x in c if x is not None]
                    for c in frame["__edits"].iloc[begin : begin + 256]
                ]
                trees = [CountTree(bpe, t, s) for t, s in zip(some, found, strict=True)]
                before = [tree.n_tokens for tree in trees]
                _edit_all(trees, changes)
                out += [
                    (b, tree.n_tokens, len(c), tree.again, tree.n_chars)
                    for b, tree, c in zip(before, trees, changes, strict=True)
                ]
            frame = frame.drop(columns=["__edits"])
            for name, values in zip(RESULTS, zip(*out, strict=True) if out else [[]] * len(RESULTS), strict=True):
                frame[name] = np.array(values, dtype=np.int64)
            yield frame

    others = [c for c in docs.columns if c not in (*RESULTS, text, edits)]
    rows = docs.select(*others, F.col(text).alias("__text"), F.col(edits).cast(EDITS).alias("__edits"))
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInPandas(run, fields + ", ".join(f"{name} bigint" for name in RESULTS))

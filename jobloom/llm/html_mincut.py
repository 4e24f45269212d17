"""Main text of web pages by a minimum cut.

A page is read as blocks: the text between block-level tags, with the containers around it. A
logistic score of each block's containers, names, links and length gives two costs, for calling
it content and for calling it boilerplate; they are the capacities to the two terminals. Blocks
that follow each other, and blocks with the same container, are tied by smoothness edges. A
maximum flow separates the two sides, and the blocks on the content side make up the text.

The weights below are set by hand: no table labels the blocks of pages. Scripts, styles, heads
and hidden elements have no text. A null or empty page has an empty text; markup that does not
close is read as far as it goes; pages of any length take time in proportion to their blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Tags by kind.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head title script style noscript template svg math iframe object textarea select option".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "button": 5.0, "header": 3.0, "address": 1.0}
GOOD_TAGS = {"article": 5.0, "main": 4.0}
# Parts of class names that speak against content, and for it.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert popup modal overlay sidebar side widget related recommend recommended recommendations menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus share sharing social "
    "newsletter subscribe signup login search form pagination pager toolbar disclaimer legal copyright tag tags skip".split()
)
GOOD_NAMES = frozenset("article content post entry story body main text".split())
# What such a part comes after in names that only tell how a page is laid out or filed.
QUALIFIERS = frozenset("no not has have with without is in category cat tag type format status page layout".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Any white space, no-break spaces too, becomes one space.
_WHITE = re.compile(r"\s+")

#: Smoothness: between blocks in sequence, and between those of one container.
ADJACENT, SIBLING = 20, 40
SCALE = 100


#: A container that holds so much of a page's text is not judged by its class.
WHOLE = 0.8


class Block:
    __slots__ = ("text", "linked", "score", "parent")

    def __init__(self, text: str, linked: int, score: float, parent: int) -> None:
        self.text, self.linked, self.score, self.parent = text, linked, score, parent


class Container:
    """An open element: what its tag and its names say against content, and the text below it."""

    __slots__ = ("parent", "tag", "firm", "named", "mass")

    def __init__(self, parent: int, tag: str, firm: float, named: float) -> None:
        self.parent, self.tag, self.firm, self.named, self.mass = parent, tag, firm, named, 0


def _name_score(value: str) -> float:
    """What a class or id says: a whole name most, a part of one less, a part that only files the page nothing."""
    bad = good = 0.0
    for name in value.lower().split():
        parts = re.split("[_-]+", name)
        praised = any(p in GOOD_NAMES for p in parts)
        at = next((i for i, p in enumerate(parts) if p in BAD_NAMES and not (p == "tag" and i + 1 < len(parts))), None)
        if at is None or any(p in QUALIFIERS for p in parts[:at]):
            good = max(good, 2.0 * praised)
        elif len(parts) == 1:
            bad = max(bad, 6.0)
        elif not praised:
            bad = max(bad, 5.0)
        elif parts[at] != "header":
            bad = max(bad, 3.0)
    return bad or -good


def _weigh(tag: str, attrs: str) -> tuple[float, float, bool]:
    """How much a container's tag and role, and its names, speak against content, and whether it is hidden."""
    firm = BAD_TAGS.get(tag, 0.0) - GOOD_TAGS.get(tag, 0.0)
    named = 0.0
    hidden = False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in ("html", "body"):
                named += _name_score(value)
            elif name == "role":
                firm += 6.0 if value.lower() in BAD_ROLES else -4.0 if value.lower() in ("main", "article") else 0.0
            elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (name == "aria-hidden" and value.lower() == "true"):
                hidden = True
    return firm, named, hidden


def _scores(containers: list[Container]) -> list[float]:
    """Per container what speaks against the text directly inside, its ancestors included."""
    for c in reversed(containers[1:]):
        containers[c.parent].mass += c.mass
    total = containers[0].mass
    scores, firms = [0.0], [0.0]
    for c in containers[1:]:
        named = c.named if c.mass < WHOLE * total else min(c.named, 0.0)
        above, firm_above = scores[c.parent], firms[c.parent]
        own = c.firm + named if named < 6 else max(c.firm, 0.0) + named
        if c.tag == "header" and above < 0:
            # The head of an article holds its title.
            own -= BAD_TAGS["header"]
        if own < 0 < above:
            # An article inside an aside is not the article; one below a class name is.
            inner = own if c.firm < 0 and firm_above <= 0 else above
        elif own > 0 > above:
            # A menu inside an article is a menu.
            inner = own - 1.0
        else:
            inner = above + own
        scores.append(max(-8.0, min(inner, 12.0)))
        firms.append(max(firm_above, 0.0) + c.firm if c.firm > 0 else firm_above)
    return scores


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    found: list[Block] = []
    containers = [Container(0, "", 0.0, 0.0)]
    # Per open container: tag, its number, hidden or skipped.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened = {"": 1}
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _WHITE.sub(" ", "".join(parts)).strip()
            if text and not stack[-1][2]:
                number = stack[-1][1]
                containers[number].mass += len(text)
                # The number of the container, until it is known what speaks against it.
                found.append(Block(text, linked, number, _parent()))
        parts, linked = [], 0

    def _parent() -> int:
        return stack[-2][1] if len(stack) > 1 and stack[-1][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else stack[-1][1]

    def close(tag: str) -> None:
        while True:
            top = stack.pop()
            opened[top[0]] -= 1
            if top[0] == tag:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][2]:
            text = entities.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at, length = 0, len(page)
    while at < length:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"].lower() if m["tag"] else None
        if tag is None:
            continue
        if m["end"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            flush()
            if opened.get(tag):
                close(tag)
            in_link = 0 if tag not in INLINE else in_link
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s>/])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else length
            if tag in ("script", "style"):
                continue
            flush()
            continue
        if tag in INLINE:
            if tag == "a" and not m["attrs"].rstrip().endswith("/"):
                in_link = 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        for other in _CLOSES.get(tag, ()):
            if stack[-1][0] == other:
                close(other)
        if tag in _BREAKS_P and stack[-1][0] == "p":
            close("p")
        if m["attrs"].endswith("/"):
            continue
        firm, named, hidden = _weigh(tag, m["attrs"])
        _, above, dead = stack[-1]
        if tag == "body" and stack[-1][0] == "head":
            dead = False
        stack.append((tag, len(containers), dead or hidden or tag in SKIPPED))
        containers.append(Container(above, tag, firm, named))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    scores = _scores(containers)
    for block in found:
        block.score = scores[int(block.score)]
    return found


def priors(found: list[Block]) -> list[float]:
    """Log odds of each block that it is boilerplate.

    Blocks below a container that speaks for content or against it follow that. Others are judged by their
    length where some container speaks for content, else by the plain text of their container, as a share of
    the container of the page that has most: a page without such marks has its text where most of it stands.
    """
    mass: dict[int, int] = {}
    for block in found:
        if block.score < 1:
            mass[block.parent] = mass.get(block.parent, 0) + max(0, len(block.text) - block.linked)
    most = max(mass.values(), default=0)
    marked = any(block.score < -2.5 and len(block.text) > block.linked for block in found)
    out = []
    for block in found:
        length = len(block.text)
        odds = block.score + 3.0 * min(1.0, block.linked / max(1, length))
        if block.score >= 0 or not marked:
            if marked or not most or block.score >= 1:
                odds += 1.5 - 0.6 * math.log1p(length / 20)
            else:
                odds += 1.5 - 3.0 * mass[block.parent] / most
        out.append(odds)
    return out


def content(found: list[Block]) -> list[bool]:
    """Which blocks a minimum cut leaves on the content side."""
    n = len(found)
    if not n:
        return []
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def tie(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    last: dict[int, int] = {}
    for k, (block, odds) in enumerate(zip(found, priors(found), strict=True)):
        tie(source, k, int(SCALE * math.log1p(math.exp(-odds))), 0)
        tie(k, sink, int(SCALE * math.log1p(math.exp(odds))), 0)
        if k:
            tie(k - 1, k, ADJACENT, ADJACENT)
        before = last.get(block.parent)
        if before is not None:
            tie(before, k, SIBLING, SIBLING)
        last[block.parent] = k
    while True:
        level = _levels(head, to, room, source)
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        _augment(head, to, room, level, source, sink)


def _levels(head, to, room, source) -> list[int]:
    level = [-1] * len(head)
    level[source] = 0
    queue = deque([source])
    while queue:
        a = queue.popleft()
        for e in head[a]:
            if room[e] and level[to[e]] < 0:
                level[to[e]] = level[a] + 1
                queue.append(to[e])
    return level


def _augment(head, to, room, level, source, sink) -> None:
    """A blocking flow; the path is a stack, so long pages do not recurse."""
    turn = [0] * len(head)
    path: list[int] = []
    a = source
    while True:
        if a == sink:
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least
            cut = next(k for k, e in enumerate(path) if not room[e])
            a = to[path[cut] ^ 1]
            del path[cut:]
            continue
        while turn[a] < len(head[a]):
            e = head[a][turn[a]]
            if room[e] and level[to[e]] == level[a] + 1:
                path.append(e)
                a = to[e]
                break
            turn[a] += 1
        else:
            if a == source:
                return
            level[a] = -1
            a = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, content(found), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text``, the main text, and ``n_chars``, its code points, in place of the page."""

    def run(frames):
        for frame in frames:
            texts = [main_text(p) for p in frame.pop("__html")]
            frame["text"] = texts
            frame["n_chars"] = pd.Series([len(t) for t in texts], index=frame.index, dtype="int64")
            yield frame

    others = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in others)
    return pages.select(*others, F.col(html).alias("__html")).mapInPandas(run, fields + "text string, n_chars bigint")

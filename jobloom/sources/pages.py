"""Postings out of raw web pages by selectors.

Only the reading of one page is Python: a small tree over ``html.parser``. Pages
come in Arrow batches, are spread by Spark, and everything after the field texts is
built-in expressions. A batch is read in slices of bounded size, so what a worker holds beside
the batch does not follow the number of its rows.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.text import filled, resolve_link
from jobloom.sources.records import normalize_posting

FIELDS = ["title", "company", "location", "salary", "description", "link"]
# Bytes of pages that are read before their postings leave the task.
SLICE_BYTES = 1 << 20

# Elements without an end tag, and elements that end an open <p>.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section",
    "table", "ul",
}


class _Page(HTMLParser):
    """Elements in document order: (tag, attributes, parent, first/last text, last element)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._close_down_to(0)

    def _close_down_to(self, depth: int) -> None:
        while len(self.open) > depth:
            element = self.elements[self.open.pop()]
            element["to"], element["last"] = len(self.texts), len(self.elements)

    def handle_starttag(self, tag, attrs):
        tags = [self.elements[i]["tag"] for i in self.open]
        if tag in ENDS_PARAGRAPH and "p" in tags:
            self._close_down_to(len(tags) - 1 - tags[::-1].index("p"))
        elif tag in ("li", "tr", "td", "th", "option", "dt", "dd") and tags and tags[-1] == tag:
            self._close_down_to(len(tags) - 1)
        parent = self.open[-1] if self.open else -1
        here = len(self.texts)
        self.elements.append(
            {"tag": tag, "attrs": dict(attrs), "up": parent, "from": here, "to": here,
             "index": len(self.elements), "last": len(self.elements) + 1}
        )
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]]["tag"] == tag:
                self._close_down_to(depth)
                return

    def handle_data(self, data):
        self.texts.append(data)

    def text(self, element: dict) -> str:
        return "".join(self.texts[element["from"] : element["to"]])

    def _fits(self, element: dict, step: dict) -> bool:
        attrs = element["attrs"]
        return (
            step["tag"] in ("", "*", element["tag"])
            and set(step["classes"]) <= set((attrs.get("class") or "").split())
            and all(k in attrs and (v is None or attrs[k] == v) for k, v in step["attrs"])
        )

    def select(self, selector: list[list[dict]], first: int = 0, last: int | None = None):
        """Elements that fit one of the alternatives, in document order."""
        for index in range(first, len(self.elements) if last is None else last):
            if any(self._fits_path(index, path) for path in selector):
                yield self.elements[index]

    def _fits_path(self, index: int, path: list[dict]) -> bool:
        if not self._fits(self.elements[index], path[-1]):
            return False
        up, wanted = self.elements[index]["up"], len(path) - 2
        while up >= 0 and wanted >= 0:
            if self._fits(self.elements[up], path[wanted]):
                wanted -= 1
            up = self.elements[up]["up"]
        return wanted < 0


_STEP = re.compile(r"^([\w*-]*)((?:[.#][\w-]+|\[[\w-]+(?:=(?:'[^']*'|\"[^\"]*\"|[\w-]+))?\])*)$")


def parse_selector(text: str) -> list[list[dict]]:
    """Alternatives of descendant steps: tag, ``.class``, ``#id``, ``[attr]``, ``[attr='v']``."""
    alternatives = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        steps = []
        for word in part.split():
            match = _STEP.match(word)
            if match is None:
                raise ValueError(f"selector not supported: {word}")
            rest = match.group(2)
            attrs = [
                (m[0], m[1].strip("'\"") if m[1] else None)
                for m in re.findall(r"\[([\w-]+)(?:=('[^']*'|\"[^\"]*\"|[\w-]+))?\]", rest)
            ]
            attrs += [("id", name) for name in re.findall(r"#([\w-]+)", rest)]
            classes = re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", rest))
            steps.append({"tag": match.group(1).lower(), "classes": classes, "attrs": attrs})
        alternatives.append(steps)
    return alternatives


@functools.lru_cache(maxsize=1024)
def _rules(selectors: str) -> tuple[list, dict[str, list]]:
    """The container and the fields of selectors given as a JSON object, parsed once per worker."""
    named = json.loads(selectors)
    return (
        parse_selector(named.get("jobContainer") or ""),
        {name: parse_selector(named.get(name) or "") for name in FIELDS},
    )


def _postings_of(html: str, selectors: str) -> Iterator[dict[str, str]]:
    container, rules = _rules(selectors)
    page = _Page(html or "")
    for box in page.select(container):
        found = {}
        for name, rule in rules.items():
            element = next(page.select(rule, box["index"] + 1, box["last"]), None)
            if element is None:
                found[name] = ""
            elif name == "link":
                found[name] = element["attrs"].get("href") or ""
            else:
                found[name] = page.text(element)
        yield found


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``SLICE_BYTES`` of html, a page at least."""
    sizes = pc.fill_null(pc.binary_length(batch["html"]), 0).to_pylist()
    begin = size = 0
    for row, more in enumerate(sizes):
        if size and size + more > SLICE_BYTES:
            yield batch.slice(begin, row - begin)
            begin, size = row, 0
        size += more
    if begin < len(sizes):
        yield batch.slice(begin)


def extract_postings_html(
    pages: DataFrame,
    selectors: Mapping[str, str] | Column,
    source: Column,
    now: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One posting per container that has a title and a company.

    ``pages`` has ``url`` and ``html``; ``selectors`` names ``jobContainer`` and the
    fields, for all pages or, as a struct or map column, for each page: those of its
    board. A page without selectors gives no row. The first match of a selector counts, and the id is computed before the
    link is made absolute. A page without containers gives no row.
    """
    if isinstance(selectors, Column):
        rules = F.to_json(selectors)
    else:
        named = json.dumps(dict(selectors))
        _rules(named)
        rules = F.lit(named)
    raw = pages.select(*keep, source.alias("source"), "url", "html", rules.alias("_rules"))
    carried = [f for f in raw.schema.fields if f.name not in ("html", "_rules")]
    schema = T.StructType([*carried, *[T.StructField(name, T.StringType()) for name in FIELDS]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                at, postings = [], []
                for row, (html, named) in enumerate(zip(part["html"].to_pylist(), part["_rules"].to_pylist(), strict=True)):
                    if named is not None:
                        postings += _postings_of(html, named)
                        at += [row] * (len(postings) - len(at))
                columns = [part[f.name].take(pa.array(at, pa.int64())) for f in carried]
                columns += [pa.array([p[name] for p in postings], pa.string()) for name in FIELDS]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    found = raw.mapInArrow(read, schema)
    posting = normalize_posting(found, now, keep=list(dict.fromkeys([*keep, "url"])))
    return (
        posting.where(filled(F.col("title")) & filled(F.col("company")))
        .withColumn("link", resolve_link(F.col("link"), F.col("url")))
        .drop(*[] if "url" in keep else ["url"])
    )

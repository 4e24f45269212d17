"""License scan: ordered signature rules over word sequences, gated by keywords.

A signature is a regular expression over the text's words, joined by single spaces. The rules
are every wording of ``FORMS`` for every name of ``NAMES``; each has a keyword, and is tried only
on texts that hold it. Before that, two cheap expressions pass over texts that hold no keyword, or
none of the words of which every wording needs one; both look at words as the rules do, whatever
stands between them. Of the detections of a text, one that lies inside another of the same or a
higher priority is suppressed; the labels are those of the rest.

Base phrases are found apart and always count. Defined cases: a null text has no words; rows of
one id and text share their detections; no detection gives empty labels, null places and score 0.
Only built-in functions run; detections travel as numbers, texts do not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Phrases and labels of the contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# (label, keyword, name over words). Versions are words as well: "2.0" reads "2 0".
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license| licence)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license| licence)?(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-3.0", "general", "(?:gnu )?general public(?: license| licence)?(?: version)?(?: v)? 3(?: 0)?"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version| v)? 3(?: 0)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public(?: license| licence)?(?: version)? 2(?: 0)?"),
    ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version| v)? 2(?: 0)?"),
    ("gpl", "general", "(?:gnu )?general public"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public(?: license| licence)?(?: version)? 3(?: 0)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public(?: license| licence)?(?: version)? 2 1"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public(?: license| licence)?(?: version)? 3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("mpl-2.0", "mozilla", "mozilla public(?: license| licence)?(?: version)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl-2.0", "mpl", "mpl(?: version)? 2(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public(?: license| licence)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("eupl", "eupl", "eupl"),
    ("cddl", "cddl", "cddl"),
    ("artistic-2.0", "artistic", "artistic(?: license| licence)? 2(?: 0)?"),
    ("artistic", "artistic", "artistic"),
    ("bsl-1.0", "boost", "boost software"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by", "commons", "creative commons attribution(?: [1-4] 0)?"),
    ("odbl", "database", "open database"),
    ("ofl-1.1", "font", "(?:sil )?open font(?: license| licence)?(?: version)?(?: 1 1)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("psf-2.0", "python", "python software foundation"),
)

_TAIL = "(?: licen[sc]e)?(?: version(?: [0-9]+)+)?"
# (priority, strength, wording around the name).
FORMS = (
    (5, 1.0, "spdx license identifier {name}(?: only| or later)?"),
    (4, 0.95, "(?:licen[sc]ed|released|distributed|published|available|provided|covered|governed)"
     " (?:under|by)(?: the)?(?: terms of)?(?: the)? {name}" + _TAIL),
    (3, 0.9, "(?:under|by)(?: the)? terms of(?: the)? {name}" + _TAIL),
    (3, 0.85, "licen[sc]e {name}" + _TAIL),
    (2, 0.8, "{name} licen[sc]e(?: version(?: [0-9]+)+)?"),
    (2, 0.8, "{name}(?: licen[sc]e)? or(?: any)? later"),
    (1, 0.5, "subject to(?: the)? {name}" + _TAIL),
)
PRIORITIES = sorted({priority for priority, _, _ in FORMS})
KEYWORDS = sorted({keyword for _, keyword, _ in NAMES})
#: Every wording of FORMS holds one of these words.
NEEDED = ("license", "licence", "under", "by", "later", "subject")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = rf"[^{_BETWEEN}]+"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(number, label, keyword, priority, strength, expression), in order."""
    made = []
    for priority, strength, wording in FORMS:
        for label, keyword, name in NAMES:
            made.append((len(made), label, keyword, priority, strength, " " + wording.format(name=f"(?:{name})") + "(?= )"))
    return made


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _holds(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the words stands in the text as a word."""
    return text.rlike(rf"(?i)(?:^|[{_BETWEEN}])(?:{'|'.join(words)})(?:\z|[{_BETWEEN}])")


def _hinted(rows: DataFrame) -> DataFrame:
    """Texts on which some rule may hold, as words."""
    lowered = F.translate(F.col("text"), _UPPER, _LOWER)
    words = F.filter(F.split(lowered, _NO_WORD), lambda w: w != "")
    # Never null, but it keeps filters on what is derived from the words above this projection;
    # pushed below it, they would split the text again for every word.
    once = F.when(F.monotonically_increasing_id() >= 0, words)
    may = _holds(F.col("text"), NEEDED) & _holds(F.col("text"), KEYWORDS)
    return rows.where(may).select("id", "digest", once.alias("words"))


def _base(hinted: DataFrame) -> DataFrame:
    """Places of the base phrases, by id and text."""

    def here(phrase: str, i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase.split()):
            found = found & F.coalesce(F.get("words", i + k) == word, F.lit(False))
        return found

    def places(phrase: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: here(phrase, i))

    rows = hinted.where(F.array_contains("words", "license")).select(
        "id", "digest", *[places(phrase).alias(label) for phrase, label in BASE]
    )
    every = F.concat(*[F.col(label) for _, label in BASE])
    held = F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    return rows.select(
        "id", "digest", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"), held.alias("base"),
    ).where("n_base > 0").distinct()


def detections(hinted: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, digest, label, priority, strength, start, end) in words, after suppression."""
    table = spark.createDataFrame(
        rules(), "rule int, label string, keyword string, priority int, strength double, expression string"
    )
    held = F.array_intersect("words", F.array(*[F.lit(k) for k in KEYWORDS]))
    tried = (
        hinted.select("id", "digest", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"), F.explode(held).alias("keyword"))
        # A few hundred fixed rules.
        .join(F.broadcast(table), "keyword")
        .where(F.expr("line rlike expression"))
    )
    parts = F.expr("split(line, expression, -1)")
    matches = F.expr("regexp_extract_all(line, expression, 0)")
    counted = F.arrays_zip(
        F.transform(parts, _spaces).alias("gap"), F.transform(matches, _spaces).alias("size")
    )
    rows = tried.select("id", "digest", "rule", "label", "priority", "strength", F.posexplode(counted).alias("k", "m"))
    by_rule = Window.partitionBy("id", "digest", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Repeated rows send the same parts again.
    rows = rows.select("*", F.col("m.gap").alias("gap"), F.coalesce("m.size", F.lit(0)).alias("size")).drop("m").distinct()
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by_rule)).where("size > 0")
    rows = rows.withColumn("start", F.col("end") - F.col("size"))
    before = (
        Window.partitionBy("id", "digest").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.select("*", *[F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before).alias(f"reach{p}") for p in PRIORITIES])
    inside = F.lit(False)
    for p in PRIORITIES:
        inside = inside | ((F.col("priority") == p) & (F.col("end") <= F.coalesce(F.col(f"reach{p}"), F.lit(-1))))
    return rows.where(~inside).select("id", "digest", "label", "priority", "strength", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and the columns of ``RESULTS``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole).alias("digest"), whole.alias("text"))
    hinted = _hinted(rows)
    found = detections(hinted, docs.sparkSession).groupBy("id", "digest").agg(
        F.collect_set("label").alias("more"), F.max("strength").alias("strength")
    )

    base = _base(hinted).withColumnsRenamed({"id": "base_id", "digest": "base_digest"})
    found = found.withColumnsRenamed({"id": "more_id", "digest": "more_digest"})
    rows = rows.select("id", "digest", F.regexp_count("text", F.lit(_WORD)).cast("bigint").alias("n_words"))
    joined = rows.join(
        base, F.col("id").eqNullSafe(F.col("base_id")) & (F.col("digest") == F.col("base_digest")), "left"
    ).join(found, F.col("id").eqNullSafe(F.col("more_id")) & (F.col("digest") == F.col("more_digest")), "left")
    empty = F.array().cast("array<string>")
    every = F.array_sort(F.array_union(F.coalesce("base", empty), F.coalesce("more", empty)))
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", empty)), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("strength", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )

"""Quality rules: a decision list of threshold conjunctions, learned and applied in Spark.

``text_stats`` derives the statistics of every whole text with built-in functions, row by row and
without a shuffle. ``learn`` takes the statistics of a bounded sample of labelled rows and grows
rules by sequential covering: a rule adds the threshold with the best gain on two thirds of the
sample, loses its last conditions as long as that helps on the other third, and is listed if it
is precise there; then the rows it covers are set aside. ``verdict`` turns the list into one
ordered conditional expression. Words that mark toxic rows are learned from the same sample.

Defined cases: a null text has no words and fails the base rule; labels of one id count as bad if
any of them is; without usable labels the list is empty and the base rule alone decides. Columns
of the input pass through, except for those named like a result, which the result replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows that a list is learned from, at most; they are drawn by a hash of the id.
SAMPLE = 10_000
#: Marked words, at most.
LEXICON = 1_000
#: Toxic rows that hold a marked word, at least. Fixed: a share of all toxic rows would pass over
#: the words of languages with few rows.
SUPPORT = 5
#: Share of the rows holding a marked word that must be toxic.
MARKED = 0.95
#: Share of the rows a rule covers that must be bad, on the part it did not grow on.
PRECISION = 0.97
RULES = 24
CONDITIONS = 4

BLANKS = " \t\n\x0b\f\r"
EDGES = ".,;:!?\"'()[]"
FEATURES = (
    "n_words", "repeat_share", "dup_lines", "dup_line_share", "symbol_share", "word_length",
    "upper_share", "digit_share", "bang_share", "distinct_share", "n_marked", "marked_share",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.at_least else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(f"__{self.feature}")
        return value >= self.threshold if self.at_least else value <= self.threshold


@dataclass
class DecisionList:
    """Rules in order; a row is bad by the first rule that holds. ``words`` are the marked words."""

    rules: list[list[Condition]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)


def _bare(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(EDGES)))


def text_stats(docs: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """Adds the counts of ``COUNTS`` and, with a leading ``__``, the features of the rules."""
    whole = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(whole, F.lit(BLANKS))
    # Java's \s is the six ASCII blanks.
    split = F.when(inner != "", F.split(inner, "\\s+")).otherwise(F.array().cast("array<string>"))
    others = [c for c in docs.columns if c not in COUNTS and not c.startswith("__")]
    rows = docs.select(*others, whole.alias("__text")).withColumn("__w", split)
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike("\\S"))
    triples = F.when(
        F.size("__w") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__w") - 3),
            lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__lines", lines).withColumn("__h", triples)
    # Positions matter only where some triple repeats, which few texts have.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("__s", F.when(repeats, pairs))
    twice = F.filter(
        "__s",
        lambda s, i: F.coalesce(s["h"] == F.get("__s", i - 1)["h"], F.lit(False))
        | F.coalesce(s["h"] == F.get("__s", i + 1)["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda s: s["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end")
        ),
        lambda acc: acc["n"],
    )
    marked = F.lit(0)
    if words:
        marked = F.size(F.filter("__w", lambda w: _bare(w).isin(words)))
    rows = rows.select(
        *others,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        # Never false, but it keeps filters on the results above this projection: pushed below
        # it, they would repeat the derivation inside its own lambdas.
        F.coalesce(F.when(F.monotonically_increasing_id() >= 0, covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        F.regexp_count("__text", F.lit("\\p{Lu}")).alias("__upper"),
        F.regexp_count("__text", F.lit("[0-9]")).alias("__digits"),
        F.regexp_count("__text", F.lit("[!?]")).alias("__bangs"),
        F.size(F.array_distinct("__w")).alias("__n_distinct"),
        marked.alias("__n_marked"),
    )

    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0)

    return rows.select(
        *others,
        *COUNTS,
        F.col("n_words").cast("double").alias("__n_words"),
        share("n_repeat_words", "n_words").alias("__repeat_share"),
        F.col("n_dup_lines").cast("double").alias("__dup_lines"),
        share("n_dup_lines", "__n_lines").alias("__dup_line_share"),
        share("n_symbols", "n_words").alias("__symbol_share"),
        share("word_chars", "n_words").alias("__word_length"),
        share("__upper", "word_chars").alias("__upper_share"),
        share("__digits", "word_chars").alias("__digit_share"),
        share("__bangs", "n_words").alias("__bang_share"),
        share("__n_distinct", "n_words").alias("__distinct_share"),
        F.col("__n_marked").cast("double").alias("__n_marked"),
        share("__n_marked", "n_words").alias("__marked_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: DecisionList) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for number, rule in enumerate(rules.rules, 1):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed``, the number of the ``rule`` and ``kept``."""
    others = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "rule", "kept")]
    rows = text_stats(docs.select(*others), text, rules.words)
    return rows.select(
        *[c for c in others if not c.startswith("__")],
        *COUNTS,
        base_failed().alias("base_failed"),
        verdict(rules).alias("rule"),
        (~base_failed() & (verdict(rules) == 0)).alias("kept"),
    )


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DecisionList:
    """A decision list for rows labelled ``quality`` 0 or ``toxic`` 1."""
    spark = docs.sparkSession
    marks = (
        labels.select(
            F.col("doc_id").alias("__id"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
            F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"),
        )
        .where("__id IS NOT NULL")
        .groupBy("__id")
        .agg(F.max("toxic").alias("toxic"), F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(SAMPLE)
    )
    sample = marks.collect()
    if not sample:
        return DecisionList()
    # At most SAMPLE ids: safe to send to every task.
    marks = F.broadcast(spark.createDataFrame(sample, marks.schema))
    rows = docs.join(marks, F.col(doc_id) == F.col("__id")).select(
        F.col("__id").alias("id"), F.col(text).alias("text"), "toxic", "bad"
    )
    words = _marked_words(rows)
    stats = text_stats(rows, "text", words).where(~base_failed())
    names = [f"__{f}" for f in FEATURES]
    # A row per label as well, should an id stand in several rows.
    found = stats.groupBy("id").agg(F.max("bad").alias("bad"), *[F.max(n).alias(n) for n in names]).collect()
    table = [({f: float(r[f"__{f}"]) for f in FEATURES}, r["bad"]) for r in sorted(found, key=lambda r: r["id"])]
    grow = [t for k, t in enumerate(table) if k % 3]
    prune = [t for k, t in enumerate(table) if k % 3 == 0]
    return DecisionList(_cover(grow, prune), words)


def _marked_words(rows: DataFrame) -> list[str]:
    """Words that many toxic rows of the sample hold and hardly any others."""
    totals = rows.agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.sum((~F.col("toxic")).cast("int")).alias("c")).head()
    toxic, clean = totals["t"] or 0, totals["c"] or 0
    if toxic < 5 or clean < 5:
        return []
    bare = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\\s+"), _bare))
    counts = (
        rows.select("toxic", F.explode(bare).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    )
    lift = (F.col("t") / toxic) / ((F.col("c") + 1) / clean)
    marks = (F.col("t") >= SUPPORT) & (lift >= 10) & (F.col("t") >= MARKED * (F.col("t") + F.col("c")))
    best = counts.where(marks).orderBy(F.desc("t"), "word").limit(LEXICON)
    return [r["word"] for r in best.collect()]


def _counts(rule: list[Condition], rows: list) -> tuple[int, int]:
    hit = [bad for values, bad in rows if all(c.holds(values) for c in rule)]
    return sum(hit), len(hit)


def _cover(grow: list, prune: list) -> list[list[Condition]]:
    rules: list[list[Condition]] = []
    while len(rules) < RULES and any(bad for _, bad in grow):
        rule = _grow(grow)
        if not rule:
            break
        best, score = rule, -1.0
        for size in range(len(rule), 0, -1):
            bad, all_ = _counts(rule[:size], prune)
            if all_ and (2 * bad - all_) / all_ >= score:
                best, score = rule[:size], (2 * bad - all_) / all_
        bad, all_ = _counts(best, prune)
        got, of = _counts(best, grow)
        if (got + bad) < 3 or (got + bad) / (of + all_) < PRECISION or (all_ and bad / all_ < PRECISION - 0.05):
            break
        rules.append(best)
        grow = [r for r in grow if not all(c.holds(r[0]) for c in best)]
        prune = [r for r in prune if not all(c.holds(r[0]) for c in best)]
    return rules


def _grow(rows: list) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        bad = sum(b for _, b in rows)
        if not bad or bad == len(rows):
            break
        before, best, gain = math.log2(bad / len(rows)), None, 1e-9
        for name in FEATURES:
            ordered = sorted((values[name], b) for values, b in rows)
            seen = seen_bad = 0
            for k, (value, b) in enumerate(ordered):
                seen, seen_bad = seen + 1, seen_bad + b
                if k + 1 == len(ordered) or ordered[k + 1][0] == value:
                    continue
                middle = (value + ordered[k + 1][0]) / 2
                for at_least, p, n in ((False, seen_bad, seen), (True, bad - seen_bad, len(ordered) - seen)):
                    if p >= 2 and (g := p * (math.log2(p / n) - before)) > gain:
                        best, gain = Condition(name, at_least, middle), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r[0])]
    return rule

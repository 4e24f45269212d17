"""Spelling variants, NN-descent and importance resampling against plain versions."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from jobloom.llm import html_mincut, importance, nn_descent, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n string, word string, rank string, weight string"


def table(name: str, columns: str) -> list[tuple]:
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def documents(spark, rows):
    """The rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)


def made_texts() -> list[tuple]:
    draw = random.Random(11)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    words += [w + "tion" for w in words[:20]] + ["Ünité", "ünité", "UNITÉ", "a×b÷c", "x" * 70, "x" * 71, "y" * 5 + "x" * 66]
    rows = [(k, " ".join(draw.choice(words) for _ in range(80))) for k in range(40)]
    rows += [(k, "-".join(draw.choice(words).upper() for _ in range(30)) + "1 2") for k in range(40, 60)]
    rows += [(5, None), (6, ""), (None, " ".join(words)), (None, " ".join(words)), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(99, "long" * 20_000), (100, "long" * 20_000), (101, "long" * 20_000 + " word " * 5_000)]
    return rows


# Spelling variants


def plain_words(rows):
    found = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def plain_groups(words):
    """By comparing every word with its deletions, replacements and insertions."""
    gone = collections.defaultdict(set)
    near = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)) if len(w) < 100 else ():
            gone[w[:i] + w[i + 1 :], i].add(w)
    for (rest, _), some in gone.items():
        for w in some:
            near[w] |= some - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, some in near.items():
        if some:
            best = min(some, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {
        (w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()
    }


def groups_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize(("dictionary", "longest_list"), [(50_000, 20_000), (3, 7), (40, 1)])
def test_spelling(spark, dictionary, longest_list):
    rows = made_texts()
    found = spelling.variant_groups(documents(spark, rows), dictionary=dictionary, longest_list=longest_list)
    expected = plain_groups(plain_words(rows))
    assert groups_of(found) == expected
    assert any(r[5] != r[0] for r in expected) and any(len(r[0]) > spelling.WIDE for r in expected)


def test_spelling_small_chunks(spark, monkeypatch):
    rows = made_texts()[:30]
    monkeypatch.setattr(spelling, "PAIRS", 3)
    frame = documents(spark, rows)
    words = spelling.vocabulary(frame).toPandas()
    lists = list(spelling._index(spelling.frequent_grams(spelling.vocabulary(frame)))([words]))[0]
    lists[["block", "low", "high"]] = 0
    pairs = spelling._merge(lists)
    known = set(words["word"])
    expected = {(a, b) for a, b in itertools.permutations(known, 2) if spelling.near_one_edit(a, b)}
    assert set(zip(pairs["word"], pairs["near"], strict=True)) == expected


def test_spelling_of_nothing(spark):
    assert spelling.variant_groups(documents(spark, [])).collect() == []
    assert spelling.variant_groups(documents(spark, [(1, None), (2, "12 ab")])).collect() == []


def test_spelling_query(spark):
    found = groups_of(queries.op11_spelling_variants(spark, SF))
    assert found == plain_groups(plain_words(table("documents", "doc_id, text")))


@settings(max_examples=300, deadline=None)
@given(
    st.text("abc", min_size=5, max_size=14), st.integers(0, 20), st.sampled_from("abcz"), st.sampled_from("idr"),
    st.sets(st.text("abc^$", min_size=2, max_size=4), max_size=60),
)
def test_near_words_share_a_list(word, at, letter, kind, frequent):
    """Whatever the dictionary, one edit leaves a rare gram in common, at the place a list is kept for."""
    at %= len(word)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[kind]
    if other == word or len(other) < 5:
        return
    counts = {g: len(g) for g in frequent if all(g[:k] in frequent for k in range(2, len(g)))}

    def keys(w, length):
        shift = len(w) - length
        return {
            (g, p - d) for p, g in spelling.rarest(*spelling.grams(w, counts), counts) for d in range(shift + 1)
        }

    short = min(len(word), len(other))
    assert spelling.near_one_edit(word, other)
    assert keys(word, short) & keys(other, short)


# Near vectors


def plain_links(rows, threshold=0.95):
    """(id, links, smallest id) per row, by all pairs."""
    usable = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, dtype=float) if good else None
        usable.append(None if a is None else a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()))
    near = [set() for _ in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = usable[i], usable[j]
        if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        head = min(ids) if ids else None
        out.append((key, len(near[i]), head, key == head))
    return sorted(out, key=str)


def made_vectors(dim=12):
    draw = np.random.default_rng(4)
    rows = []
    key = itertools.count(100)
    for size in (1, 1, 2, 2, 3, 40):
        centre = draw.normal(size=dim)
        rows += [(next(key), (centre + draw.normal(size=dim) * 0.06).tolist()) for _ in range(size)]
    # A chain whose ends are far apart.
    a, b = np.eye(dim)[0], np.eye(dim)[1]
    rows += [(next(key), (math.cos(t) * a + math.sin(t) * b).tolist()) for t in np.arange(0, 1.5, 0.2)]
    rows += [(next(key), draw.normal(size=dim).tolist()) for _ in range(30)]
    same = rows[0][1]
    rows += [(1, same), (1, same), (None, same), (2, [x * 1e200 for x in same]), (3, [x * 1e-200 for x in same])]
    rows += [(None, rows[9][1]), (None, [7.0] + [0.0] * (dim - 1)), (None, [-1.0] * dim)]
    rows += [(4, None), (5, []), (6, [0.0] * dim), (7, [None] + [1.0] * (dim - 1)), (8, [float("nan")] * dim)]
    rows += [(9, [float("inf")] + [1.0] * (dim - 1)), (10, same[:5]), (11, same[:5]), (12, same + [0.0])]
    return rows


VECTORS = "vec_id bigint, embedding array<double>, vec string, node string, n_links string"


def links_of(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"room": 2, "trees": 1, "leaf": 8, "probes": 500}])
def test_near_vectors(spark, monkeypatch, options):
    if options:
        monkeypatch.setattr(nn_descent, "BLOCK", 7)
    rows = made_vectors()
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS)
    found = links_of(nn_descent.near_vectors(frame, **options))
    assert found == plain_links(rows)
    assert max(r[1] for r in found) >= 30


def test_near_vectors_of_nothing(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert nn_descent.near_vectors(frame).collect() == []
    one = spark.createDataFrame([(3, [1.0, 2.0], "x", "x", "x"), (4, None, "x", "x", "x")], VECTORS)
    assert links_of(nn_descent.near_vectors(one)) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_the_audit_finds_missing_links(spark):
    """Vectors in pairs, none of them joined: a share of 0; all joined: 1."""
    draw = np.random.default_rng(1)
    base = draw.normal(size=(20, 8))
    rows = [(i, (base[i // 2] * (1 + i)).tolist()) for i in range(40)]
    points = spark.createDataFrame(rows, "node bigint, vec array<double>")
    alone = spark.createDataFrame([], "node bigint, root bigint")
    joined = points.select("node", (F.col("node") - F.col("node") % 2).alias("root"))
    assert nn_descent._audit(points, alone, 0.95, 100) == 0.0
    assert nn_descent._audit(points, joined, 0.95, 100) == 1.0


def test_another_pass_after_a_poor_audit(spark):
    """Leaves of two vectors miss most links; passes with larger leaves find them."""
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + draw.normal(size=16) * 0.02).tolist()) for i in range(180)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = links_of(nn_descent.near_vectors(frame, trees=1, leaf=2, room=2, recall=1.0, probes=1_000))
    assert found == plain_links(rows)


def test_near_vectors_query(spark):
    rows = table("embeddings", "vec_id, embedding")
    assert links_of(queries.op12_nn_descent(spark, SF)) == plain_links(rows)


# Importance resampling


def plain_resample(rows, target, words=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(found), [" ".join(found[i : i + n]) for n in range(1, words + 1) for i in range(len(found) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    many, few = sum(s.values()), sum(t.values())
    out = []
    for key, text in rows:
        n, found = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (few + buckets))))
            for b in map(bucket, found)
        )
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([n, key, len(found), weight, weight + noise, None])
    enough = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for rank, row in enumerate(enough[: len(enough) * percent // 100]):
        row[5] = rank + 1
    return sorted((tuple(r[1:]) for r in out), key=str)


def ranks_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"words": 3, "buckets": 64, "percent": 100, "least": 1, "seed": 7}])
def test_resample(spark, options):
    rows = made_texts() + [(-5, "the quick brown fox " * 10), (2**40, "the quick brown fox " * 10)]
    target = ["The Quick", None, "", "brown fox abé " * 40]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, n string")
    found = importance.resample(documents(spark, rows), aim, **options)
    assert ranks_of(found) == plain_resample(rows, target, **options)


def test_ranks_cross_blocks(spark):
    """Blocks of five rows and digits of three bits; ties, repeated rows and ids on both sides of 0."""
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(-9, 9)]), draw.randint(1, 40), 0, draw.randint(-30, 30)) for _ in range(203)]
    frame = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint")
    found = sorted((r["rank"], r["doc_id"], r["n_features"], r["score"]) for r in importance.radix_ranks(frame, bits=3, size=5).collect())
    ordered = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    assert found == [(i + 1, r[0], r[1], r[3]) for i, r in enumerate(ordered)]


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(documents(spark, []), none).collect() == []
    rows = [(1, None), (2, "a b")]
    assert ranks_of(importance.resample(documents(spark, rows), none)) == plain_resample(rows, [])


def test_resample_query(spark):
    found = ranks_of(queries.op13_importance_resampling(spark, SF))
    expected = plain_resample(table("documents", "doc_id, text"), [r[0] for r in table("benchmark", "text")])
    assert found == expected and any(r[4] for r in found)


# Main text of ordinary pages

STORY = " ".join(f"This is sentence number {k} of the article." for k in range(20))
SHORT = [f"Paragraph {k} with some words, which is short for a block of an article that has many of them." for k in range(50)]


def page_of(inner, body="<body>"):
    return (
        f"<html><head><title>t</title></head>{body}<nav><a href=/>Home</a><a href=/x>More</a></nav>{inner}"
        "<footer>(c) 2024 Someone</footer></body></html>"
    )


@pytest.mark.parametrize(
    ("inner", "body", "expected"),
    [
        (f"<article><p>{STORY}</p></article>", '<body class="home no-sidebar">', STORY),
        (f"<main><article><p>{STORY}</p></article></main>", '<body class="has-sidebar">', STORY),
        (f'<div class="content-with-sidebar"><article><p>{STORY}</p></article></div>', "<body>", STORY),
        (f'<div class="site side"><article><p>{STORY}</p></article></div>', "<body>", STORY),
        (f'<article class="post category-legal"><p>{STORY}</p></article>', "<body>", STORY),
        (f'<article class="post tag-search"><p>{STORY}</p></article>', "<body>", STORY),
        (f'<div class="sidebar"><p>{STORY}</p></div>', "<body>", STORY),
        ("<div><h1>Notice of the day</h1><p>Shops stay open.</p></div>", "<body>", "Notice of the day Shops stay open."),
        ("<div>" + "".join(f"<p>{p}</p>" for p in SHORT) + "</div>", "<body>", " ".join(SHORT)),
        ("".join(f"<div>{p}</div>" for p in SHORT), "<body>", " ".join(SHORT)),
        (f'<article><header class="post-header"><h1>A title</h1></header><p>{STORY}</p></article>', "<body>", f"A title {STORY}"),
        (f'<article><p>{STORY}</p><div class="share-buttons">Share this</div><div class="related-posts"><p>{STORY}</p></div></article>', "<body>", STORY),
        (f'<main><p>{STORY}</p><article class="comment"><p>{STORY} I say.</p></article></main>', "<body>", STORY),
        (f"<article><p>{STORY}</p></article><aside><article><p>{STORY} teaser</p></article></aside>", "<body>", STORY),
    ],
)
def test_ordinary_pages(inner, body, expected):
    assert html_mincut.main_text(page_of(inner, body)) == expected


def cut_cost(found, odds, keep):
    """What a labelling costs: capacities of blocks on the wrong side, and ties that are cut."""
    cost, last = 0, {}
    for k, block in enumerate(found):
        sides = (math.exp(odds[k]), math.exp(-odds[k]))
        cost += int(html_mincut.SCALE * math.log1p(sides[0] if keep[k] else sides[1]))
        if k:
            cost += html_mincut.ADJACENT * (keep[k] != keep[k - 1])
        if block.parent in last:
            cost += html_mincut.SIBLING * (keep[k] != keep[last[block.parent]])
        last[block.parent] = k
    return cost


def test_the_cut_is_least_among_all_labellings():
    draw = random.Random(8)
    for _ in range(60):
        found = [
            html_mincut.Block("x" * draw.randint(1, 400), 0, draw.choice([-6.0, -3.0, 0.0, 0.5, 2.0, 6.0]), draw.randint(0, 3))
            for _ in range(draw.randint(1, 9))
        ]
        for block in found:
            block.linked = draw.choice([0, 0, len(block.text)])
        odds = html_mincut.priors(found)
        least = min(cut_cost(found, odds, keep) for keep in itertools.product([False, True], repeat=len(found)))
        assert cut_cost(found, odds, html_mincut.content(found)) == least


def test_pages_again_long_and_with_clashing_columns(spark):
    long = page_of("<article>" + "".join(f"<p>{p}</p>" for p in SHORT * 100) + "</article>")
    rows = [(1, "u", long, "x", 7), (1, "u", long, "y", 8), (2, None, "", "z", 9)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars bigint")
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_mincut.extract(frame).select("page_id", "text", "n_chars").collect())
    whole = " ".join(SHORT * 100)
    assert found == [(1, whole, len(whole)), (1, whole, len(whole)), (2, "", 0)]

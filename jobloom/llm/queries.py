"""The checked queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobloom.llm import (
    byte_bpe, decontamination, html_mincut, importance, jaccard_forest, license_scan, lm_backoff, nn_descent,
    quality_rules, sharding, spelling, suffix_dedup, token_counts,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.octet_length("kept")
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - kept).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"))


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def edits_of(docs: DataFrame) -> DataFrame:
    """An edit log: per document an insertion, a deletion and a replacement, placed by a hash of the id."""
    size = F.char_length(F.coalesce("text", F.lit("")))

    def drawn(salt: str, below) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(F.lit(1), below)).cast("bigint")

    def edit(salt: str, width: int, words: int):
        start = drawn(salt, size + 1)
        new = F.substr("text", (drawn(salt + "f", size) + 1).cast("int"), drawn(salt + "n", F.lit(words)).cast("int"))
        return F.struct(start.alias("start"), (start + drawn(salt + "w", F.lit(width))).alias("stop"), new.alias("text"))

    return docs.select("doc_id", "text", F.array(edit("insert", 1, 60), edit("delete", 200, 1), edit("replace", 30, 30)).alias("edits"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_counts.recount(edits_of(_table(spark, sf_dir, "documents")), path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.backoff_scores(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_rules, op3_license_scan, op4_sharding, op5_jaccard_forest, op6_html_mincut,
        op7_token_counts, op8_decontamination, op9_lm_backoff, op10_byte_bpe, op11_spelling_variants,
        op12_nn_descent, op13_importance_resampling,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The unsigned crc32 of a text: of each byte value eight shifts, then a byte of the text at a time.
_CRC_TABLE = """crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))"""


def _crc(text: str) -> str:
    data = f"hex(encode({text}))"
    octets = f"list_transform(range(CAST(length({data}) // 2 AS BIGINT)), lambda i: CAST('0x' || substr({data}, 2 * i + 1, 2) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


_RUNS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')"
_FEATURES = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

SQL = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest({_RUNS}) AS w FROM documents) GROUP BY ALL),
        drawn AS (SELECT w, k, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, crc),
        read AS (SELECT k, CASE WHEN h % 97 = 0
            THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM drawn),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM read WHERE length(word) >= 5
            GROUP BY word HAVING sum(k) >= 3),
        places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
        gone AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
        near AS (
            SELECT a.word, b.word AS other FROM gone AS a JOIN gone AS b USING (rest, i) WHERE a.word <> b.word
            UNION SELECT gone.word, words.word FROM gone JOIN words ON rest = words.word
            UNION SELECT words.word, gone.word FROM gone JOIN words ON rest = words.word),
        ranked AS (SELECT near.word, other, o.n AS other_n,
            row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(other)) AS place,
            count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words AS o ON other = o.word),
        formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
            CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM words LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (word)),
        followed AS (
            SELECT word, word AS here, form AS next FROM formed
            UNION ALL SELECT f.word, f.next, g.form FROM followed AS f JOIN formed AS g ON f.next = g.word)
        SELECT formed.word, n, n_near, form, form_n, here AS root
        FROM formed JOIN (SELECT word, here FROM followed WHERE next IS NULL) AS ends USING (word)
    """,
    "op12_nn_descent": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (SELECT row, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.row AS a, b.row AS b FROM usable AS a JOIN usable AS b
            ON a.row <> b.row AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reached AS (SELECT row, row AS other FROM v
            UNION SELECT reached.row, b FROM reached JOIN links ON other = a),
        heads AS (SELECT reached.row, min(v.vec_id) AS component_id FROM reached JOIN v ON other = v.row GROUP BY reached.row),
        counted AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN heads USING (row) LEFT JOIN counted USING (row)
    """,
    "op13_importance_resampling": f"""
        WITH {_CRC_TABLE},
        docs AS (SELECT row_number() OVER () AS row, doc_id, {_FEATURES} AS found FROM documents),
        asked AS (SELECT {_FEATURES} AS found FROM benchmark),
        words AS (SELECT row, w, count(*) AS k FROM (SELECT row, unnest(found) AS w FROM docs) GROUP BY ALL),
        aims AS (SELECT w, count(*) AS k FROM (SELECT unnest(found) AS w FROM asked) GROUP BY ALL),
        hashed AS (SELECT w, {_crc("w")} % 10000 AS bucket
            FROM (SELECT w FROM words UNION SELECT w FROM aims), crc),
        s AS (SELECT bucket, sum(k) AS s FROM words JOIN hashed USING (w) GROUP BY bucket),
        t AS (SELECT bucket, sum(k) AS t FROM aims JOIN hashed USING (w) GROUP BY bucket),
        total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS many, coalesce((SELECT sum(t) FROM t), 0) AS few),
        gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (many + 10000) AS DOUBLE)
            / CAST((coalesce(s, 0) + 1) * (few + 10000) AS DOUBLE))) AS BIGINT) AS gain
            FROM s FULL JOIN t USING (bucket), total),
        weighed AS (SELECT row, CAST(sum(k * gain) AS BIGINT) AS weight
            FROM words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY row),
        scored AS (SELECT doc_id, CAST(len(found) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:'
              || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM docs LEFT JOIN weighed USING (row)),
        ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20
            ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored
            WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
    """,
    "op8_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        ds AS (
            SELECT DISTINCT doc_id, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
        ),
        bs AS (
            SELECT DISTINCT item_id, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
        ),
        n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
        FROM ds JOIN bs USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
    """,
}

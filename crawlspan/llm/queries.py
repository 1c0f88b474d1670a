"""The corpus queries: each applies its operator to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.llm import bpe, exact_dedup, html_text, media, mixing, near_dedup, negatives, quality, resample, suffix_dedup, token_store, topk, toxicity
from crawlspan.llm.common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = docs.withColumn("found", toxicity.verdict(spark, model, F.col("text")))
    worst = F.expr("substring(text, found.worst_start + 1, found.worst_end - found.worst_start)")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.offending", "found.worst_start", "found.worst_end", worst.alias("worst_sentence"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.NearDedup(width=3, percent=85).groups(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_digests(spark, store)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, *html_text.fit(pages))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights, F.col("source"), F.col("lang"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.col("kept").cast("int").alias("predicted"), "kept", "host_rate", "path_rate")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_bpe, op3_near_dedup, op4_media, op5_token_store, op6_html_text, op7_repeated_passages, op8_mixing, op9_exact_dedup, op10_quality,
        op11_hard_negatives, op12_importance_resampling, op13_exact_top_k, pipeline,
    )
}

#: Vectors that take part, with their components as integers, in DuckDB's SQL.
_VECTORS = """
    v AS (
        SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS c
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
"""

ORACLES: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY h) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
                   row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS place FROM t
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM g
    """,
    "op11_hard_negatives": f"""
        WITH {_VECTORS.format(scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")},
        s AS (
            SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, CAST(list_inner_product(a.c, x.c) AS BIGINT) AS score
            FROM v AS a JOIN v AS x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id
            WHERE a.label IS NOT NULL AND x.label IS NOT NULL
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), n AS (
            SELECT p.*, s.id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op12_importance_resampling": r"""
        WITH steps AS (  -- the table of CRC-32
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), dw AS (SELECT doc_id, unnest(words) AS word FROM d),
        bw AS (SELECT unnest(words) AS word FROM b),
        hashed AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
        ), bucket AS (
            SELECT word, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER) + 1, 2) AS BIGINT)),
                                         lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
            FROM hashed, steps
        ), s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY bucket),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000)
                   / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket)
        ), w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        g AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                   (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM d LEFT JOIN w USING (doc_id)
        ), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM g WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM g LEFT JOIN r USING (doc_id)
    """,
    "op13_exact_top_k": f"""
        WITH {_VECTORS.format(scale=64, label="label")},
        s AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.c, x.c) AS BIGINT) AS score
            FROM v AS q JOIN v AS x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20
    """,
}

"""The registered queries of this subpackage, each one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectext.llm import (
    divergence, exact_dedup, html_text, language, mixing, packing, quality, sharding, simhash, spelling, token_files,
    topk, warc,
)
from vectext.llm.streams import held_out
from vectext.session import new_shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 16
MAX_PASSES = 2.0
ACCEPT = 0.7


def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


@register
def op2_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, folder, "documents"), shards=SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def quality_votes(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Votes:
    """The classifier learned from the labels that are not held out."""
    return quality.learn(docs, table(spark, folder, "labels").where(~held_out("doc_id")))


@register
def op3_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.with_quality(docs.select("doc_id", "text"), quality_votes(spark, docs, folder))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


@register
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"), keep="largest")


ORACLES["op4_exact_dedup"] = """
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    rows AS (
        SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER (PARTITION BY doc_id, body) AS copy
        FROM docs
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept,
           sha256(body) AS text_sha256
    FROM rows
"""


@register
def op5_norm_bucket_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


ORACLES["op5_norm_bucket_top_k"] = """
    WITH parts AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, p.vec_id,
               CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(p.v AS DOUBLE[])) AS BIGINT) AS score
        FROM parts q JOIN parts p ON q.vec_id <> p.vec_id
        WHERE q.vec_id % 20 = 0
    ),
    placed AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""


@register
def op6_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    counts = language.learn(docs.where(~held_out("doc_id")))
    guessed = language.predict_language(docs.select("doc_id", "text"), counts)
    return guessed.select("doc_id", held_out("doc_id").alias("held_out"), "predicted.lang_pred", "predicted.score")


@register
def op10_temperature_mix(spark: SparkSession, folder: str) -> DataFrame:
    places, _ = mixing.mix_sources(table(spark, folder, "documents"), max_passes=MAX_PASSES)
    return places.drop("text_hash")


@register
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=2, capacity=1024)


@register
def op8_plane_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = new_shared_path(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(table(spark, folder, "documents"), out, vocabulary, "words", end_id=1)
    return token_files.read_documents(spark, out).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@register
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@register
def op11_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    out = new_shared_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), out)
    return warc.read_archives(spark, out)


ORACLES["op11_warc_segments"] = """
    WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
    placed AS (
        SELECT page_id, url, body, sha1(body) AS sha,
               max(page_id) OVER (PARTITION BY body) AS keep_id,
               row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place
        FROM payloads
    )
    SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda k: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(sha, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS INTEGER)
                         >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
           CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN place > 1 THEN keep_id END AS refers_to
    FROM placed
"""


@register
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ),
    words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs),
    kept AS (
        SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
    ),
    langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
    shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
               1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
               1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
        FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
    ),
    found AS (
        SELECT lang, a.source, a.term, b.source AS item, ((a.p - b.p) * (a.p - b.p)) // b.p AS f
        FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source
    ),
    pairs AS (
        SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(sum(f), 0) AS BIGINT) AS value
        FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
        LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.item = o.source
        GROUP BY ALL
    ),
    terms AS (
        SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
        FROM shares WHERE c > 0 AND p > q
    ),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    )
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@register
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))

"""Queries over explanations and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, tokens as tk
from vectext.functions.keys import keyed_hash
from vectext.operators import build as bd, explain as ex, report as rp, scoring as sc
from vectext.operators.explain import EXPLANATION, TEXT
from vectext.plans import inputs as ins
from vectext.plans.registry import query
from vectext.session import cut_lineage

CLEANED = f"WITH {ins.cleaned_sql()}"


def cleaned(spark, folder):
    return ex.clean_responses(ins.responses(spark, folder))


@query(
    "explain_clean",
    f"{CLEANED} SELECT doc_id, feature_count, md5(cleaned) AS explanation_md5 FROM reasoned WHERE reason IS NULL".replace(
        "SELECT doc_id, feature_count", "SELECT doc_id, CAST(feature_count AS BIGINT) AS feature_count"
    ),
)
def explain_clean(spark, folder):
    kept = cleaned(spark, folder).where("reason is null")
    return kept.select("doc_id", F.col("feature_count").cast("bigint").alias("feature_count"), F.md5("cleaned").alias("explanation_md5"))


@query(
    "explain_rejects",
    f"""{CLEANED} SELECT doc_id // 512 * 512 AS chunk_start, doc_id % 512 AS row_in_chunk, doc_id AS global_row, CAST(doc_id AS VARCHAR) AS doc_id,
      sha256(detokenized_text_truncated) AS text_sha256, reason, md5(raw_response) AS raw_md5, cleaned, CAST(feature_count AS INTEGER) AS feature_count
    FROM reasoned WHERE reason IS NOT NULL""",
)
def explain_rejects(spark, folder):
    responses = cleaned(spark, folder).withColumn("global_row", F.col("doc_id"))
    rejected = ex.rejects(responses, "global_row")
    return rejected.withColumn("raw_md5", F.md5("raw_response")).drop("raw_response")


@query("explain_reject_counts", f"{CLEANED} SELECT reason, count(*) AS rows FROM reasoned WHERE reason IS NOT NULL GROUP BY reason")
def explain_reject_counts(spark, folder):
    return rp.reject_counts(cleaned(spark, folder))


@query(
    "completion_quality",
    f"""{CLEANED}, q AS (SELECT source, count(*) AS rows, count(*) FILTER (feature_count >= 2) AS ok, count(*) FILTER (raw_response IS NULL) AS none,
      max(length(source) * 2.0::DOUBLE) AS seconds FROM reasoned GROUP BY source)
    SELECT *, ok = rows AS all_ok, round(rows / seconds, 6) AS calls_per_s FROM q""",
)
def completion_quality(spark, folder):
    quality = rp.completion_quality(cleaned(spark, folder), "source", F.length("source") * F.lit(2.0))
    return quality.withColumn("calls_per_s", F.round("calls_per_s", 6))


# ------------------------------------------------------------------------ cache


CACHE = f"""WITH {ins.explained_sql()},
first_source AS (SELECT sha256(detokenized_text_truncated) AS text_key, 'old ' || n_raw_tokens AS cached FROM explained WHERE substr(sha256('old|' || doc_id || '|' || n_raw_tokens), 1, 1) < '8'),
second_source AS (SELECT sha256(detokenized_text_truncated) AS text_key, api_explanation AS cached FROM explained WHERE substr(sha256('new|' || doc_id || '|' || n_raw_tokens), 1, 1) < '5'),
cache AS (SELECT text_key, arg_max(cached, s) AS cached FROM
  (SELECT text_key, max(cached) AS cached, 0 AS s FROM first_source GROUP BY 1 UNION ALL SELECT text_key, max(cached), 1 FROM second_source GROUP BY 1) GROUP BY 1),
looked AS (SELECT b.doc_id, b.n_raw_tokens, sha256(b.detokenized_text_truncated) AS text_key, c.cached
  FROM explained b LEFT JOIN cache c ON sha256(b.detokenized_text_truncated) = c.text_key)"""


def in_share(name, sixteenths):
    """Whether a row is in a share of all rows, chosen by a hash of its key."""
    return F.substring(keyed_hash(name, "doc_id", "n_raw_tokens"), 1, 1) < F.lit(f"{sixteenths:x}")


def looked_up(spark, folder):
    """Base rows against two older runs, each of a share of the rows by hash.

    The second run wins where both know a text.
    """
    rows = cut_lineage(ins.explained(spark, folder))
    old = rows.where(in_share("old", 8)).withColumn(EXPLANATION, F.concat(F.lit("old "), F.col("n_raw_tokens").cast("string")))
    new = rows.where(in_share("new", 5))
    cache = ex.explanation_cache(old, new, order=EXPLANATION)
    return ex.with_cached(rows.drop(EXPLANATION), cache, ["doc_id", "n_raw_tokens"]), cache


@query("cache_hits", f"{CACHE} SELECT doc_id, n_raw_tokens, md5(cached) AS cached_md5 FROM looked WHERE cached IS NOT NULL")
def cache_hits(spark, folder):
    found, _ = looked_up(spark, folder)
    return found.where("cached is not null").select("doc_id", "n_raw_tokens", F.md5("cached").alias("cached_md5"))


@query("cache_misses", f"{CACHE} SELECT doc_id, n_raw_tokens, text_key FROM looked WHERE cached IS NULL")
def cache_misses(spark, folder):
    found, _ = looked_up(spark, folder)
    return found.where("cached is null").select("doc_id", "n_raw_tokens", "text_key")


@query(
    "cache_hit_rate",
    f"""{CACHE} SELECT count(*) AS rows, count(cached) AS hits, round(count(cached) / count(*), 6) AS share,
    (SELECT count(*) FROM cache) AS cached_texts FROM looked""",
)
def cache_hit_rate(spark, folder):
    return ex.cache_hit_rate(*looked_up(spark, folder)).withColumn("share", F.round("share", 6))


@query(
    "reuse_exact_join",
    f"""WITH {ins.explained_sql()}
    SELECT doc_id, n_raw_tokens, api_explanation FROM explained WHERE substr(sha256('prior|' || doc_id || '|' || n_raw_tokens), 1, 2) < 'f8'""",
)
def reuse_exact_join(spark, folder):
    rows = cut_lineage(ins.explained(spark, folder))
    # The earlier run lacks a thirty-second of the rows and holds a stale copy of each of the others.
    known = F.substring(keyed_hash("prior", "doc_id", "n_raw_tokens"), 1, 2) < F.lit("f8")
    prior = bd.build_av(rows.where(known)).withColumn("version", F.lit(2))
    stale = prior.withColumn("version", F.lit(1)).withColumn("response", F.lit(f"{fx.EXPLANATION_OPEN}stale{fx.EXPLANATION_CLOSE}"))
    known = ex.prior_explanations(prior.unionByName(stale))
    joined = ex.reuse_exact(rows.drop(EXPLANATION), known, ["version"])
    return joined.select("doc_id", "n_raw_tokens", EXPLANATION)


@query(
    "run_overlap",
    """WITH l AS (SELECT doc_id AS id, sha256(text) AS a FROM documents WHERE substr(sha256('left|' || doc_id), 1, 1) < 'c'),
    r AS (SELECT item_id AS id, sha256(text) AS b FROM benchmark UNION ALL SELECT doc_id, sha256(text) FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)),
    j AS (SELECT l.id AS lid, r.id AS rid, a, b FROM l FULL JOIN r USING (id))
    SELECT count(*) FILTER (lid IS NOT NULL AND rid IS NOT NULL) AS shared, count(*) FILTER (lid IS NOT NULL AND rid IS NOT NULL AND a <> b) AS text_differs,
      count(*) FILTER (rid IS NULL) AS only_left, count(*) FILTER (lid IS NULL) AS only_right,
      round(count(*) FILTER (lid IS NOT NULL AND rid IS NOT NULL) / count(lid), 6) AS overlap_share FROM j""",
)
def run_overlap(spark, folder):
    docs = ins.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    older = ins.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    right = older.unionByName(docs.join(older, "id", "left_anti"))
    audit = ex.run_overlap(docs.where(F.substring(keyed_hash("left", "id"), 1, 1) < F.lit("c")), right, ["id"], "text")
    return audit.withColumn("overlap_share", F.round("overlap_share", 6))


@query(
    "resume_pending",
    """WITH done AS (SELECT doc_id // 32 AS chunk FROM labels GROUP BY 1 HAVING count(*) >= 13)
    SELECT doc_id, doc_id // 32 AS chunk FROM documents WHERE doc_id // 32 NOT IN (SELECT chunk FROM done)""",
)
def resume_pending(spark, folder):
    labels = ins.table(spark, folder, "labels")
    done = labels.groupBy(F.floor(F.col("doc_id") / 32).cast("bigint").alias("chunk")).agg(F.count("*").alias("n")).where("n >= 13")
    docs = ins.table(spark, folder, "documents").select("doc_id")
    return ex.pending_chunks(docs, done, "doc_id", 32).select("doc_id", "chunk")


# -------------------------------------------------------------- training tables

ACTOR = fx.ACTOR_TEMPLATE.replace("{injection_char}", "<INJECT>").replace("'", "''")


@query(
    "build_av",
    f"""WITH {ins.explained_sql()} SELECT doc_id, n_raw_tokens, activation_layer, md5(detokenized_text_truncated) AS text_md5, 'user' AS role,
    md5('{ACTOR}') AS prompt_md5, {ins.WRAPPED} AS response FROM explained""",
)
def build_av(spark, folder):
    built = bd.build_av(ins.explained(spark, folder))
    first = F.get("prompt", F.lit(0))
    return built.select(
        "doc_id", "n_raw_tokens", "activation_layer", F.md5(TEXT).alias("text_md5"),
        first["role"].alias("role"), F.md5(first["content"]).alias("prompt_md5"), "response",
    )


@query(
    "build_rl",
    f"""WITH {ins.base_sql()} SELECT doc_id, n_raw_tokens, activation_layer, 'user' AS role, md5('{ACTOR}') AS prompt_md5 FROM base""",
)
def build_rl(spark, folder):
    built = bd.build_rl(ins.base(spark, folder), keep_text=False)
    first = F.get("prompt", F.lit(0))
    return built.select(
        "doc_id", "n_raw_tokens", "activation_layer", first["role"].alias("role"), F.md5(first["content"]).alias("prompt_md5")
    )


@query(
    "build_ar",
    f"""WITH {ins.explained_sql()} SELECT doc_id, n_raw_tokens, activation_layer,
    {ins.critic_sql("api_explanation")} AS prompt FROM explained""",
)
def build_ar(spark, folder):
    return bd.build_ar(ins.explained(spark, folder), keep_text=False).select(
        "doc_id", "n_raw_tokens", "activation_layer", "prompt"
    )


@query(
    "recover_roundtrip",
    f"""WITH {ins.explained_sql()}, both_tables AS (SELECT md5(detokenized_text_truncated) AS text_md5, api_explanation FROM explained)
    SELECT *, 'av' AS origin FROM both_tables UNION ALL SELECT *, 'ar' AS origin FROM both_tables""",
)
def recover_roundtrip(spark, folder):
    rows = ins.explained(spark, folder)
    av = bd.recover(bd.build_av(rows)).withColumn("origin", F.lit("av"))
    ar = bd.recover(bd.build_ar(rows)).withColumn("origin", F.lit("ar"))
    return av.unionByName(ar).select(F.md5(TEXT).alias("text_md5"), EXPLANATION, "origin")


@query(
    "suffix_check",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(CASE WHEN doc_id % 4 = 0 THEN '{ins.CRITIC_HEAD}' || text || '</text>'
      ELSE {ins.critic_sql("text")} END, '\S+') AS t FROM documents)
    SELECT doc_id, len(t) AS n_tokens, t[-1] = '<summary>' AS ends_well FROM p""",
)
def suffix_check(spark, folder):
    head, tail = tx.split_template(fx.CRITIC_TEMPLATE, "{explanation}")
    end = F.when(F.pmod("doc_id", F.lit(4)) == 0, "</text>").otherwise(tail)
    toks = tk.tokens(F.concat(F.lit(head), F.col("text"), end))
    prompts = ins.table(spark, folder, "documents").select("doc_id", toks.alias("t"))
    return prompts.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        tk.ends_with(F.col("t"), tk.stable_suffix(fx.CRITIC_TEMPLATE)).alias("ends_well"),
    )


@query(
    "prompt_guard",
    """SELECT conv_id, turn, role = 'user' AS has_placeholder FROM conversations""",
)
def prompt_guard(spark, folder):
    content = F.when(F.col("role") == "user", F.concat(F.col("text"), F.lit(" <INJECT>"))).otherwise(F.col("text"))
    prompt = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct("role", content.alias("content")))
    turns = ins.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", bd.has_placeholder(prompt).alias("has_placeholder"))


@query(
    "inject_placeholder",
    f"""WITH {ins.explained_sql()} SELECT doc_id, n_raw_tokens, md5(replace('{ACTOR}', '<INJECT>', '㈀')) AS prompt_md5,
    {ins.WRAPPED} AS response FROM explained""",
)
def inject_placeholder(spark, folder):
    view = bd.loader_view(bd.build_av(ins.explained(spark, folder)), "㈀")
    return view.select(
        F.col("metadata.doc_id").alias("doc_id"), F.col("metadata.n_raw_tokens").alias("n_raw_tokens"),
        F.md5(F.get("prompt", F.lit(0))["content"]).alias("prompt_md5"), F.col("metadata.response").alias("response"),
    )


@query(
    "supervised_rows",
    rf"""WITH {ins.explained_sql()} SELECT doc_id, n_raw_tokens,
      len(regexp_extract_all('{ACTOR}', '\S+')) + len(regexp_extract_all(r, '\S+')) AS n_tokens, len(regexp_extract_all(r, '\S+')) AS response_length
    FROM (SELECT *, {ins.WRAPPED} AS r FROM explained)""",
)
def supervised_rows(spark, folder):
    rows = bd.supervised_rows(bd.build_av(ins.explained(spark, folder)))
    return rows.select(
        "doc_id", "n_raw_tokens", F.size("loss_mask").cast("bigint").alias("n_tokens"),
        F.col("response_length").cast("bigint").alias("response_length"),
    )


# -------------------------------------------------------------------- responses


@query(
    "extract_tag",
    f"WITH {ins.GENERATIONS} SELECT index, md5(explanation) AS explanation_md5 FROM parsed",
)
def extract_tag(spark, folder):
    rows = ins.generations(spark, folder)
    return rows.select("index", F.md5(tx.extract_explanation(F.col("response"))).alias("explanation_md5"))


@query(
    "extract_or_all",
    rf"WITH {ins.GENERATIONS} SELECT index, md5(coalesce(explanation, regexp_replace(response, '^\s+|\s+$', '', 'g'))) AS body_md5 FROM parsed",
)
def extract_or_all(spark, folder):
    rows = ins.generations(spark, folder)
    return rows.select("index", F.md5(tx.extract_or_all(F.col("response"))).alias("body_md5"))


@query(
    "generation_status",
    f"WITH {ins.GENERATIONS} SELECT index, status, final_status, n_logprobs > 4000 AS length_anomaly FROM judged",
)
def generation_status(spark, folder):
    judged = sc.generation_status(ins.generations(spark, folder), max_new=4000)
    return judged.select("index", "status", "final_status", "length_anomaly")


@query(
    "critic_rows",
    f"WITH {ins.GENERATIONS} SELECT index, len(ctoks) AS total_length, md5(array_to_string(ctoks, ' ')) AS tokens_md5 FROM judged WHERE final_status = 'completed'",
)
def critic_rows(spark, folder):
    rows = bd.critic_rows(sc.generation_status(ins.generations(spark, folder)))
    return rows.select("index", "total_length", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))

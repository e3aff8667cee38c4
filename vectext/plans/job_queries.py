"""Queries over sinks, plug-ins and whole jobs, run on tables derived from the given ones."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import keys as ky
from vectext.operators import corpus as cp, explain as ex, lookups as lk, sampling as sp, splits as sl
from vectext.plans import inputs as ins, jobs
from vectext.plans.registry import query
from vectext.plans.table_queries import SPLIT
from vectext.session import new_shared_path
from vectext.sources import manifest as ms, tables as tb

# ------------------------------------------------------------- sources and sinks


@query(
    "ingest_split",
    """WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents WHERE doc_id % 3 > 0)
    SELECT row_index, md5(text) AS text_md5 FROM r WHERE row_index >= 20 AND row_index < 100""",
)
def ingest_split(spark, folder):
    # Files that mix two splits; rows are numbered within one.
    docs = ins.table(spark, folder, "documents").select(
        "doc_id", "text", F.when(F.pmod("doc_id", F.lit(3)) > 0, "train").otherwise("test").alias("split")
    )
    path = new_shared_path(spark, "mixed")
    docs.repartitionByRange(ins.range_count(spark, folder, "documents"), "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.parquet(path)
    return tb.ingest_slice(spark, path, "train", 20, 80).select("row_index", F.md5("text").alias("text_md5"))


@query("bounded_files", "SELECT doc_id, true AS bounded FROM documents")
def bounded_files(spark, folder):
    path = new_shared_path(spark, "bounded")
    tb.write_table(ins.table(spark, folder, "documents").select("doc_id"), path, rows_per_file=64)
    back = spark.read.parquet(path).select("doc_id", *tb.lineage())
    return back.select("doc_id", (F.col("source_row") < 64).alias("bounded"))


@query(
    "split_folders",
    SPLIT.replace("docs AS", "WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents), docs AS") + " SELECT doc_id, split FROM assigned",
)
def split_folders(spark, folder):
    docs = ins.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    path = new_shared_path(spark, "splits")
    tb.write_splits(sl.split_documents(docs), path, rows_per_file=100)
    return spark.read.parquet(path).select("doc_id", F.col("split").cast("string").alias("split"))


@query(
    "rows_guard",
    """SELECT l AS lang, (SELECT count(*) FROM documents WHERE lang = l) AS rows,
      (SELECT count(*) FROM documents WHERE lang = l) > 0 AS passed FROM (VALUES ('de'), ('en'), ('none')) t(l)""",
)
def rows_guard(spark, folder):
    docs = ins.table(spark, folder, "documents").select("lang")
    found = []
    for lang in ("de", "en", "none"):
        part = docs.where(F.col("lang") == lang)
        try:
            tb.require_rows(part, f"no rows in {lang}")
            passed = True
        except ValueError:
            passed = False
        found.append(part.agg(F.count("*").alias("rows")).select(F.lit(lang).alias("lang"), "rows", F.lit(passed).alias("passed")))
    return tb.union_shards(*found)


@query(
    "manifest_stamp",
    "SELECT source AS dataset_id, count(*) AS row_count, true AS stamped FROM documents GROUP BY source",
)
def manifest_stamp(spark, folder):
    rows = ins.table(spark, folder, "documents").groupBy(F.col("source").alias("dataset_id")).agg(F.count("*").alias("row_count"))
    none = F.lit(None).cast(ms.EXTRACTION)
    made = ms.to_json(rows.select("*", F.lit("base").alias("stage"), none.alias("extraction")))
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|[+-]\d\d:\d\d)$"
    return ms.from_json(made).select("dataset_id", "row_count", F.col("created_at").rlike(stamp).alias("stamped"))


@query(
    "manifest_release",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'av' ELSE 'ar' END AS role, 'org/open' AS base, 'org/open' AS parents, 'corpus' AS trained_on,
      CASE WHEN user_id % 2 = 0 THEN event_type END AS av_prompt FROM events""",
)
def manifest_release(spark, folder):
    role = F.when(F.pmod("user_id", F.lit(2)) == 0, "actor").otherwise("critic")
    private = {"role": role, "base_checkpoint": F.lit("/mnt/private"), "trained_on": F.lit("gs://private"), "rollout_id": F.lit("7")}
    entries = F.create_map(*[x for k, v in private.items() for x in (F.lit(k), v)], role, F.col("event_type"))
    out = ky.released(entries, "org/open", "corpus")
    get = lambda k: F.try_element_at(F.col("m"), F.lit(k))
    return ins.table(spark, folder, "events").select("event_id", out.alias("m")).select(
        "event_id", get("role").alias("role"), get("base_checkpoint").alias("base"), get("parent_checkpoints").alias("parents"),
        get("trained_on").alias("trained_on"), get("av").alias("av_prompt"),
    )


# ---------------------------------------------------------------------- lookups


HOT = "SELECT e.event_id, e.k, v.label FROM (SELECT event_id, {key} AS k FROM events) e LEFT JOIN embeddings v ON v.vec_id = e.k"


def looked_up(spark, folder, key):
    events = ins.table(spark, folder, "events").select("event_id", key.alias("k"))
    table = ins.table(spark, folder, "embeddings").select(F.col("vec_id").alias("k"), "label")
    return lk.lookup_join(events, table, "k", ["event_id"]).select("event_id", "k", "label")


@query("lookup_hot_key", HOT.format(key="CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id % 900 END"))
def lookup_hot_key(spark, folder):
    return looked_up(spark, folder, F.when(F.pmod("event_id", F.lit(3)) == 0, 7).otherwise(F.pmod("event_id", F.lit(900))).cast("bigint"))


@query("lookup_null_keys", HOT.format(key="CASE WHEN event_id % 3 > 0 THEN event_id % 900 END"))
def lookup_null_keys(spark, folder):
    return looked_up(spark, folder, F.when(F.pmod("event_id", F.lit(3)) > 0, F.pmod("event_id", F.lit(900))))


@query(
    "text_dedup",
    r"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
      PARTITION BY lower(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def text_dedup(spark, folder):
    """As ``prefix_dedup``, over whole texts."""
    docs = ins.table(spark, folder, "documents").select("doc_id", "text")
    return cp.dedup_prefix(docs, ["doc_id"], chars=None).select("doc_id")


# --------------------------------------------------------------------- plug-ins


@query(
    "tokenizer_plugin",
    "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)",
)
def tokenizer_plugin(spark, folder):
    letters = sp.python_tokenizer(lambda text: re.findall("[a-z]+", text.lower()))
    docs = ins.table(spark, folder, "documents").select("doc_id", "text")
    tokens = sp.with_tokens(docs, tokenizer=letters("text"))
    return tokens.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


RESPONSE = """CASE WHEN {n} % 7 = 0 THEN NULL WHEN {n} % 7 = 1 THEN '<analysis>' || {n} || ' signs</analysis>'
  ELSE '<analysis>' || chr(10) || {n} || ' signs' || chr(10) || chr(10) || 'ends' || chr(10) || '</analysis>' END"""


@query("provider_completion", f"SELECT doc_id, {RESPONSE.format(n='length(text)')} AS raw_response FROM documents")
def provider_completion(spark, folder):
    provider = jobs.load_callable("vectext.plans.sample_plugins.LengthProvider")()
    # Without blank lines inside, so that the prompt's last paragraph is the text.
    text = F.regexp_replace("text", "\n", " ")
    docs = ins.table(spark, folder, "documents").select("doc_id", text.alias(ex.TEXT))
    return ex.complete(docs, provider, "Describe.\n\n{text}", chunk_rows=50).select("doc_id", "raw_response")


# ------------------------------------------------------------------ whole jobs

CRITIC = "Sum up: {explanation} <summary> now"


def run_job(spark, folder, steps):
    """A job over all documents into a new folder."""
    docs = ins.table(spark, folder, "documents").select("doc_id", "text")
    corpus = new_shared_path(spark, "corpus")
    docs.repartitionByRange(ins.range_count(spark, folder, "documents"), "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.parquet(corpus)
    config = {
        "output": new_shared_path(spark, "job"), "base_model": "org/m", "layer_index": 2, "width": 3,
        "corpus": {"path": corpus, "name": "documents", "start": 0, "length": docs.count()},
        "base": {"positions_per_doc": fx.POSITIONS_PER_DOC, "extractor": "vectext.plans.sample_plugins.ShapeExtractor"},
        "explain": {
            "provider": "vectext.plans.sample_plugins.LengthProvider", "chunk_size": 50, "rows_per_file": 150, "files_per_batch": 2,
        },
        "build": {"tokenizer": "vectext.plans.sample_plugins.piece_ids", "critic_template": CRITIC},
    }
    return jobs.run_job(spark, config, steps)


JOB = f"""{ins.positions_sql(fx.POSITIONS_PER_DOC, [])},
base AS (SELECT 'documents:train:' || doc_id AS doc_id, length(array_to_string(t[1:position + 1], ' ')) AS n FROM sampled),
{SPLIT},
judged AS (SELECT split, CASE WHEN n % 7 = 0 THEN 'provider_returned_none' WHEN n % 7 = 1 THEN 'too_few_features' END AS reason
  FROM base JOIN assigned USING (doc_id))"""


@query(
    "explain_job_rejects",
    f"""WITH {JOB} SELECT split, reason, count(*) AS rows, count(*) AS numbers, true AS in_range, true AS in_chunk
    FROM judged WHERE split <> 'rl' AND reason IS NOT NULL GROUP BY split, reason""",
)
def explain_job_rejects(spark, folder):
    # Row numbers are those of the split: no two alike over all batches, none beyond its rows.
    paths = run_job(spark, folder, ["base", "split", "explain"])
    found = []
    for stage in ("av_sft", "ar_sft"):
        total = jobs.read_split(spark, paths, stage).agg(F.count("*")).scalar()
        log = spark.read.json(paths[f"{stage}_rejects"])
        found.append(log.groupBy("reason").agg(
            F.count("*").alias("rows"), F.count_distinct("global_row").alias("numbers"),
            (F.max("global_row") < F.max(total)).alias("in_range"),
            F.bool_and((F.col("chunk_start") + F.col("row_in_chunk") == F.col("global_row")) & (F.col("row_in_chunk") < 50)).alias("in_chunk"),
        ).withColumn("split", F.lit(stage)))
    return tb.union_shards(*found)


@query(
    "config_job",
    f"""WITH {JOB} SELECT split AS stage, count(*) AS rows, count(*) AS row_count, '{CRITIC}' AS critic, true AS suffix_known
    FROM judged WHERE split = 'rl' OR reason IS NULL GROUP BY split""",
)
def config_job(spark, folder):
    paths = run_job(spark, folder, None)
    built = []
    for stage in fx.TRAINING_STAGES:
        rows = spark.read.parquet(paths[stage]).agg(F.count("*").alias("rows"))
        note = ms.read_manifest(spark, paths[stage])
        suffix = F.size("tokens.critic_suffix_ids") == 2  # "<summary>" and "now"
        known = suffix if stage == "ar_sft" else F.col("tokens.critic_suffix_ids").isNull()
        built.append(note.select(
            "stage", "row_count", F.col("prompt_templates")["critic"].alias("critic"), known.alias("suffix_known")
        ).withColumn("rows", rows.scalar()))
    return tb.union_shards(*built)

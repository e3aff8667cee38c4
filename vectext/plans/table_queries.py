"""Queries over splits, row order, batches, groups, shards and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import keys as ky
from vectext.operators import index as ix, layout as ly, manifests as mf, splits as sl
from vectext.plans import inputs as ins
from vectext.plans.registry import query
from vectext.session import cut_lineage
from vectext.sources import manifest as ms, tables as tb

# ----------------------------------------------------------------------- splits

SPLIT = """docs AS (SELECT DISTINCT doc_id FROM base),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS r, count(*) OVER () AS n FROM docs),
assigned AS (SELECT doc_id, CASE
    WHEN r < floor(n * 0.3::DOUBLE) THEN 'av_sft'
    WHEN r < floor(n * 0.3::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 'ar_sft' ELSE 'rl' END AS split FROM ranked)"""


def split_base(spark, folder):
    base = ins.base(spark, folder).select("doc_id", "n_raw_tokens")
    return sl.split_documents(base)


@query("split_docs", f"WITH {ins.base_sql()}, {SPLIT} SELECT doc_id, split FROM assigned")
def split_docs(spark, folder):
    return split_base(spark, folder).select("doc_id", "split").distinct().orderBy("doc_id")


@query("split_rows", f"WITH {ins.base_sql()}, {SPLIT} SELECT doc_id, n_raw_tokens, split FROM base JOIN assigned USING (doc_id)")
def split_rows(spark, folder):
    return split_base(spark, folder)


@query(
    "split_counts",
    f"""WITH {ins.base_sql()}, {SPLIT} SELECT split, count(DISTINCT doc_id) AS documents, count(*) AS rows
    FROM base JOIN assigned USING (doc_id) GROUP BY split""",
)
def split_counts(spark, folder):
    return sl.split_counts(split_base(spark, folder))


@query(
    "split_leak",
    # By document nothing leaks; by row, documents do whose rows fall on both sides of a line.
    f"""WITH {ins.base_sql()}, {SPLIT}, ruled AS (
      SELECT 'document' AS rule, doc_id, split FROM base JOIN assigned USING (doc_id)
      UNION ALL SELECT 'row', doc_id, CASE WHEN n_raw_tokens < 300 THEN 'a' ELSE 'b' END FROM base)
    SELECT doc_id, count(DISTINCT split) AS splits, rule FROM ruled GROUP BY rule, doc_id HAVING count(DISTINCT split) > 1""",
)
def split_leak(spark, folder):
    base = cut_lineage(ins.base(spark, folder).select("doc_id", "n_raw_tokens"))
    by_row = base.withColumn("split", F.when(F.col("n_raw_tokens") < 300, "a").otherwise("b"))
    leaks = sl.split_leak(sl.split_documents(base)).withColumn("rule", F.lit("document"))
    return leaks.unionByName(sl.split_leak(by_row).withColumn("rule", F.lit("row")))


@query(
    "permute_repeated_keys",
    """WITH a AS (SELECT count(*) AS rows, count(DISTINCT embedding[1]) AS cells, sum(label) AS labels FROM embeddings)
    SELECT rows, CAST(cells AS BIGINT) AS cells, CAST(labels AS BIGINT) AS labels, true AS moved FROM a""",
)
def permute_repeated_keys(spark, folder):
    # All rows of a label share one key: every row stays, every vector is used once.
    rows = ins.table(spark, folder, "embeddings")
    before = rows.select("vec_id", F.get("embedding", F.lit(0)).alias("old"))
    moved = ly.permute_column(rows, "label", "embedding", 42, "base").join(before, "vec_id")
    cell = F.get("embedding", F.lit(0))
    return moved.agg(
        F.count("*").alias("rows"), F.count_distinct(cell).alias("cells"), F.sum("label").alias("labels"),
        (F.count_if(cell != F.col("old")) > F.count("*") / 2).alias("moved"),
    )


# -------------------------------------------------------------- index and order


@query(
    "global_index",
    "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS row_index FROM events",
)
def global_index(spark, folder):
    events = ins.table(spark, folder, "events").select("event_id", "value")
    return ix.global_index(events, F.col("value").desc(), F.col("event_id")).select("event_id", "row_index")


@query(
    "scan_index",
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, event_id FROM events",
)
def scan_index(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", *tb.lineage())
    return ix.scan_index(events).select("row_index", "event_id")


@query(
    "chunk_ids",
    """SELECT user_id, event_id, r // 64 AS chunk, r % 64 AS row_in_chunk FROM
    (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events)""",
)
def chunk_ids(spark, folder):
    events = ins.table(spark, folder, "events").select("user_id", "event_id")
    ranked = ix.group_rank(events, "event_id", ["user_id"], "r")
    chunk = ix.chunk_id("r", 64)
    return ranked.select("user_id", "event_id", chunk.alias("chunk"), (F.col("r") - chunk * 64).alias("row_in_chunk"))


@query(
    "shuffle_rows",
    "SELECT vec_id, label, row_number() OVER (ORDER BY sha256('42|' || vec_id)) - 1 AS place FROM embeddings",
)
def shuffle_rows(spark, folder):
    rows = ins.table(spark, folder, "embeddings").select("vec_id", "label")
    return ix.hash_rank(rows, 42, "vec_id", "place")


@query(
    "shuffle_table",
    "SELECT doc_id, length(text) AS n_chars, row_number() OVER (ORDER BY sha256('42|documents|' || doc_id)) - 1 AS place FROM documents",
)
def shuffle_table(spark, folder):
    docs = ins.table(spark, folder, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    # The place is where the row lies in the shuffled table.
    return ix.numbered(ix.written_in_place(ly.shuffle_rows(docs, "doc_id", 42, "documents")), "place")


@query(
    "permute_vectors",
    """WITH a AS (SELECT vec_id, label, row_number() OVER (ORDER BY sha256('42|base|row|' || vec_id)) AS r FROM embeddings),
    b AS (SELECT embedding, row_number() OVER (ORDER BY sha256('42|base|activ|' || vec_id)) AS r FROM embeddings)
    SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first_cell, round(embedding[64]::DOUBLE, 6) AS last_cell
    FROM a JOIN b USING (r)""",
)
def permute_vectors(spark, folder):
    rows = ins.table(spark, folder, "embeddings")
    moved = ly.permute_column(rows, "vec_id", "embedding", 42, "base")
    cell = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 6)
    return moved.select("vec_id", "label", cell(0).alias("first_cell"), cell(63).alias("last_cell"))


@query(
    "epoch_batches",
    """WITH n AS (SELECT count(*) AS n FROM embeddings),
    e AS (SELECT vec_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256((42 + epoch) || '|' || vec_id)) - 1 + epoch * (SELECT n FROM n) AS draw
      FROM embeddings, range(3) t(epoch))
    SELECT vec_id, epoch, draw, draw // 48 AS batch FROM e""",
)
def epoch_batches(spark, folder):
    rows = ins.table(spark, folder, "embeddings").select("vec_id")
    return ly.epoch_batches(rows, "vec_id", rows.count(), 48, range(3))


@query(
    "fanout_samples",
    "SELECT doc_id, doc_id AS group_index, doc_id * 8 + c AS index FROM documents, range(8) t(c)",
)
def fanout_samples(spark, folder):
    return ly.fan_out(ins.table(spark, folder, "documents").select("doc_id"), 8, "doc_id")


@query(
    "equalize_groups",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    m AS (SELECT min(n) // 4 * 4 AS keep FROM (SELECT count(*) AS n FROM events GROUP BY user_id))
    SELECT user_id, event_id FROM r, m WHERE rn <= keep""",
)
def equalize_groups(spark, folder):
    events = ins.table(spark, folder, "events").select("user_id", "event_id")
    return ly.equalize_groups(events, "user_id", "event_id", 4)


@query("round_robin_parts", "SELECT event_id, user_id, user_id % 6 AS target FROM events")
def round_robin_parts(spark, folder):
    events = ins.table(spark, folder, "events").select("event_id", "user_id")
    return ly.round_robin(events, "user_id", 6)


@query(
    "shard_plan",
    """WITH n AS (SELECT count(*) AS n FROM documents),
    plan AS (SELECT s AS shard, s * (n // 7) AS start, CASE WHEN s = 6 THEN n - 6 * (n // 7) ELSE n // 7 END AS length FROM range(7) t(s), n)
    SELECT shard, start, length, CAST(count(doc_id) AS BIGINT) AS documents FROM plan LEFT JOIN documents ON doc_id >= start AND doc_id < start + length GROUP BY ALL""",
)
def shard_plan(spark, folder):
    docs = ins.table(spark, folder, "documents")
    n = docs.count()
    counted = docs.groupBy(ly.shard_of(F.col("doc_id"), 0, n, 7).alias("shard")).agg(F.count("*").alias("documents"))
    return ly.shard_plan(spark, 0, n, 7).join(counted, "shard", "left").fillna(0, ["documents"])


@query("head_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def head_rows(spark, folder):
    events = ins.table(spark, folder, "events").select("event_id", "value")
    return ly.head_rows(events, 25, F.col("value").desc(), F.col("event_id"))


# -------------------------------------------------------------------- manifests


@query(
    "shard_contiguity",
    """WITH s AS (SELECT source AS dataset_id, min(doc_id) AS start, count(*) AS length FROM documents GROUP BY source),
    g AS (SELECT *, lead(start) OVER (ORDER BY start) - (start + length) AS gap FROM s)
    SELECT dataset_id, start, length, gap, CASE WHEN gap > 0 THEN 'gap' WHEN gap < 0 THEN 'overlap' ELSE 'ok' END AS verdict FROM g""",
)
def shard_contiguity(spark, folder):
    docs = ins.table(spark, folder, "documents")
    shards = docs.groupBy(F.col("source").alias("dataset_id")).agg(
        F.min("doc_id").alias("start"), F.count("*").alias("length")
    )
    return mf.shard_contiguity(shards)


@query(
    "manifest_merge",
    f"""WITH {ins.SHARDS},
    m AS (SELECT count(*) AS shards, min(start) AS start, CAST(sum(length) AS BIGINT) AS length, CAST(sum(row_count) AS BIGINT) AS row_count,
      string_agg(dataset_id, ',' ORDER BY start) AS parents, max(start + length) AS stop FROM shards)
    SELECT shards, start, length, row_count, parents, '' AS differing_fields, stop - start = length AS contiguous,
      'base_model-a_L20_' || substr(sha256('org/model-a|20|documents|{{''start'': ' || start || ', ''length'': ' || length || '}}'), 1, 8) AS dataset_id FROM m""",
)
def manifest_merge(spark, folder):
    return mf.merge_manifests(ins.shards(spark, folder))


@query("merge_shards", "SELECT doc_id, n_chars FROM documents")
def merge_shards(spark, folder):
    docs = ins.table(spark, folder, "documents").select("doc_id", "n_chars")
    n = docs.count()
    shard = ly.shard_of(F.col("doc_id"), 0, n, 4)
    parts = [docs.where(shard == i) for i in range(4)]
    manifests = docs.groupBy(shard.cast("string").alias("dataset_id")).agg(
        F.min("doc_id").alias("start"), F.count("*").alias("length"), F.count("*").alias("row_count")
    )
    same = {"base_model": "org/model-a", "norm": "none", "corpus": "documents"}
    for field in mf.AGREEING:
        manifests = manifests.withColumn(field, F.lit(same.get(field, 5)))
    return mf.merge_shards(parts, manifests)


def manifests(spark, folder):
    """A manifest per source and language; some break their stage's contract."""
    lang, rows = F.col("lang"), F.col("rows")
    grouped = ins.table(spark, folder, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("start")
    )
    odd = F.pmod(rows, F.lit(2)) == 1
    stage = F.when(lang == "en", "base").when(lang == "fr", "av_sft").when(lang == "de", "ar_sft").otherwise("rl")
    tokens = F.when(odd | (lang == "de"), F.struct(
        F.lit("㈀").alias("injection_char"), rows.alias("injection_token_id"),
        F.lit(1).cast("bigint").alias("injection_left_neighbor_id"), F.lit(2).cast("bigint").alias("injection_right_neighbor_id"),
        F.when(odd, F.array(F.lit(7).cast("bigint"))).alias("critic_suffix_ids"),
    ))
    templates = F.when(
        F.pmod(rows, F.lit(3)) == 0, F.create_map(F.lit("critic"), F.lit("c"))
    ).otherwise(F.create_map(F.lit("actor"), F.lit("a"), F.lit("critic"), F.lit("c")))
    return grouped.select(
        F.concat_ws("_", "source", "lang").alias("dataset_id"),
        stage.alias("stage"),
        rows.alias("row_count"),
        F.struct(
            F.lit("org/model-a").alias("base_model"), F.lit(64).cast("bigint").alias("d_model"),
            F.lit(20).cast("bigint").alias("layer_index"), F.lit("none").alias("norm"), F.lit("documents").alias("corpus"),
            F.create_map(F.lit("start"), F.col("start"), F.lit("length"), rows).alias("corpus_slice"),
            F.lit(5).cast("bigint").alias("positions_per_doc"),
        ).alias("extraction"),
        tokens.alias("tokens"),
        templates.alias("prompt_templates"),
    )


PROBLEMS = """g AS (SELECT source || '_' || lang AS dataset_id, lang, count(*) AS rows, min(doc_id) AS start FROM documents GROUP BY source, lang),
s AS (SELECT *, CASE lang WHEN 'en' THEN 'base' WHEN 'fr' THEN 'av_sft' WHEN 'de' THEN 'ar_sft' ELSE 'rl' END AS stage FROM g),
p AS (SELECT *, CASE WHEN stage = 'base' THEN NULL
  WHEN rows % 2 = 0 AND lang <> 'de' THEN 'no_tokens'
  WHEN rows % 3 = 0 THEN 'no_actor_template'
  WHEN stage = 'ar_sft' AND rows % 2 = 0 THEN 'no_critic_suffix' END AS problem FROM s)"""


@query("manifest_validate", f"WITH {PROBLEMS} SELECT dataset_id, stage, problem FROM p")
def manifest_validate(spark, folder):
    return manifests(spark, folder).select("dataset_id", "stage", ms.problem().alias("problem"))


@query(
    "manifest_read",
    f"""WITH {PROBLEMS} SELECT dataset_id, stage, rows AS row_count, 'vector_text_dataset' AS kind, CAST(1 AS BIGINT) AS schema_version,
    CAST(64 AS BIGINT) AS d_model, start, '' AS parents FROM p WHERE problem IS NULL""",
)
def manifest_read(spark, folder):
    sound = manifests(spark, folder).where(ms.problem().isNull())
    text = ms.to_json(sound).select(F.regexp_replace("manifest", r"^\{", '{"unknown":{"a":1},').alias("manifest"))
    return ms.from_json(text).select(
        "dataset_id", "stage", "row_count", "kind", "schema_version",
        F.col("extraction.d_model").alias("d_model"),
        F.col("extraction.corpus_slice")["start"].alias("start"),
        F.array_join("parent_datasets", ",").alias("parents"),
    )


@query(
    "path_slice_parse",
    r"""WITH p AS (SELECT page_id, 'data/' || page_id || '.parquet' || CASE page_id % 3
        WHEN 0 THEN '@[' || page_id || ':' || length(html) || ']' WHEN 1 THEN '@[:' || page_id || ']' ELSE '' END AS path FROM pages)
    SELECT page_id, split_part(path, '@[', 1) AS base, split_part(path, '@[', 1) || '.manifest.json' AS manifest,
      try_cast(regexp_extract(path, '@\[(\d*):(\d*)\]$', 1) AS BIGINT) AS first_row,
      try_cast(regexp_extract(path, '@\[(\d*):(\d*)\]$', 2) AS BIGINT) AS last_row FROM p""",
)
def path_slice_parse(spark, folder):
    page = F.col("page_id").cast("string")
    third = F.pmod("page_id", F.lit(3))
    cut = (
        F.when(third == 0, F.concat(F.lit("@["), page, F.lit(":"), F.length("html").cast("string"), F.lit("]")))
        .when(third == 1, F.concat(F.lit("@[:"), page, F.lit("]")))
        .otherwise("")
    )
    path = F.concat(F.lit("data/"), page, F.lit(".parquet"), cut)
    pages = ins.table(spark, folder, "pages").select("page_id", path.alias("path"))
    first, last = ky.path_slice(F.col("path"))
    return pages.select(
        "page_id", ky.path_base(F.col("path")).alias("base"), ky.manifest_path(F.col("path")).alias("manifest"),
        first.alias("first_row"), last.alias("last_row"),
    )


@query(
    "manifest_precedence",
    """SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN 'explicit/' || page_id END,
      CASE WHEN length(html) % 2 = 0 THEN 'model/' || page_id END, url) AS source FROM pages""",
)
def manifest_precedence(spark, folder):
    page = F.col("page_id").cast("string")
    explicit = F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.lit("explicit/"), page))
    model = F.when(F.pmod(F.length("html"), F.lit(2)) == 0, F.concat(F.lit("model/"), page))
    pages = ins.table(spark, folder, "pages")
    return pages.select("page_id", ky.manifest_source(explicit, model, F.col("url")).alias("source"))


@query(
    "dataset_id",
    """SELECT source, count(*) AS documents, 'base_' || source || '_L20_' || substr(sha256('org/' || source || '|20|documents|{''start'': ' || min(doc_id)
      || ', ''length'': ' || count(*) || '}'), 1, 8) AS dataset_id FROM documents GROUP BY source""",
)
def dataset_id(spark, folder):
    grouped = ins.table(spark, folder, "documents").groupBy("source").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("start")
    )
    made = ky.dataset_id(
        F.concat(F.lit("org/"), F.col("source")), F.lit(20), F.lit("documents"), F.col("start"), F.col("documents")
    )
    return grouped.select("source", "documents", made.alias("dataset_id"))


@query(
    "lineage_ids",
    """SELECT DISTINCT 'base_' || source || '_' || lang AS id, 'base_' || source || '_' || lang || '__' || lang || '_raw' AS split_id,
    'base_' || source || '_' || lang || '__explained' AS explained_id, 'av_sft_' || source || '_' || lang AS training_id,
    'av_sft_' || source || '_' || lang || '__shuf42' AS shuffled_id, 'av_sft_' || source || '_' || lang || '__shuf_activations42' AS permuted_id FROM documents""",
)
def lineage_ids(spark, folder):
    ids = ins.table(spark, folder, "documents").select(
        F.concat_ws("_", F.lit("base"), "source", "lang").alias("id"), "lang"
    ).distinct()
    training = ky.training_id(F.lit("av_sft"), F.col("id"))
    return ids.select(
        "id", ky.split_id(F.col("id"), F.col("lang")).alias("split_id"), ky.explained_id(F.col("id")).alias("explained_id"),
        training.alias("training_id"), ky.shuffled_id(training, 42).alias("shuffled_id"),
        ky.permuted_id(training, 42).alias("permuted_id"),
    )


@query(
    "preset_resolve",
    "WITH presets AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{m}', {l}, {b})" for n, m, l, _, b, _, _ in fx.MODEL_PRESETS)
    + """) v(name, hf_name, layers, batch_size)),
    cfg AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'qwen7b' WHEN 'click' THEN 'gemma12b' WHEN 'error' THEN 'gemma27b'
        WHEN 'signup' THEN 'llama70b' END AS model, CASE WHEN user_id % 5 = 0 THEN user_id END AS layer_index,
        CASE WHEN event_type = 'purchase' THEN 'local/model' END AS base_model FROM events)
    SELECT event_id, coalesce(c.base_model, p.hf_name) AS base_model, CAST(coalesce(c.layer_index, 2 * p.layers // 3) AS BIGINT) AS layer_index,
      CAST(p.batch_size AS BIGINT) AS batch_size FROM cfg c LEFT JOIN presets p ON c.model = p.name""",
)
def preset_resolve(spark, folder):
    from vectext.plans.jobs import resolve_presets

    kind = F.col("event_type")
    model = F.when(kind == "view", "qwen7b").when(kind == "click", "gemma12b").when(kind == "error", "gemma27b").when(kind == "signup", "llama70b")
    configs = ins.table(spark, folder, "events").select(
        "event_id",
        model.alias("model"),
        F.when(F.pmod("user_id", F.lit(5)) == 0, F.col("user_id")).alias("layer_index"),
        F.when(kind == "purchase", "local/model").alias("base_model"),
    )
    return resolve_presets(configs).select("event_id", "base_model", "layer_index", "batch_size")


OPTIONS = """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'actor' ELSE 'critic' END AS role, props FROM events"""


@query(
    "manifest_scrub",
    f"""SELECT event_id, CASE WHEN role = 'actor' THEN 'av' ELSE 'ar' END || '=1;props=' || props AS released FROM ({OPTIONS})""",
)
def manifest_scrub(spark, folder):
    events = ins.table(spark, folder, "events")
    role = F.when(F.pmod("user_id", F.lit(2)) == 0, "actor").otherwise("critic")
    entries = F.create_map(role, F.lit("1"), F.lit("rollout_id"), F.col("event_id").cast("string"), F.lit("props"), F.col("props"))
    released = ky.drop_keys(ky.rename_keys(entries, fx.RELEASED_ROLES), fx.RELEASED_DROPS)
    pairs = F.sort_array(F.transform(F.map_entries(released), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return events.select("event_id", F.array_join(pairs, ";").alias("released"))


@query(
    "redact_options",
    """SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ';model=' || event_type AS options FROM events""",
)
def redact_options(spark, folder):
    events = ins.table(spark, folder, "events")
    named = F.create_map(F.lit("api_KEY"), F.lit("s"), F.lit("model"), F.col("event_type"), F.lit("keyfile"), F.lit("f"))
    options = F.map_concat(named, ky.parse_options(F.col("props")))
    pairs = F.sort_array(F.transform(F.map_entries(ky.redact(options)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return events.select("event_id", F.array_join(pairs, ";").alias("options"))


@query(
    "forbidden_pattern_scan",
    """SELECT page_id, contains(lower(url), 'm.') OR contains(lower(html), 'track(') OR contains(lower(html), '/tmp/') OR contains(lower(html), 'gs://')
      OR contains(lower(html), 's3://') OR contains(lower(html), '/mnt/') OR contains(lower(html), 'iter_') OR contains(lower(html), 'rollout_id') AS hit,
      contains(lower(html), 'lang="fr"') AS hit_extra FROM pages""",
)
def forbidden_pattern_scan(spark, folder):
    html = F.col("html")
    hit = ky.has_forbidden(html, [*fx.PRIVATE_PATTERNS, "TRACK("]) | ky.has_forbidden(F.col("url"), ["m."])
    return ins.table(spark, folder, "pages").select(
        "page_id", hit.alias("hit"), ky.has_forbidden(html, ['lang="FR"']).alias("hit_extra")
    )

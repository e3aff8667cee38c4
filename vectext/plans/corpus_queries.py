"""Queries over the corpus: quality, dedup, tokens, positions, marker."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, tokens as tk
from vectext.operators import corpus as cp, sampling as sp
from vectext.operators.index import group_running_sum, scan_slice
from vectext.plans import inputs as ins
from vectext.plans.registry import query
from vectext.session import new_shared_path
from vectext.sources import row_groups as rg, tables as tb

BAD = "(?i)" + "|".join(fx.BAD_PATTERNS)
NO_SCORE = tx.QualityRules(score_min=None)

REASONS = f"""{ins.CORPUS},
measured AS (
  SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls
  FROM corpus),
judged AS (
  SELECT *, CASE
    WHEN text IS NULL THEN 'not_text'
    WHEN NOT coalesce(try_cast(score AS DOUBLE) >= FLOOR, FLOOR IS NULL) THEN 'low_score'
    WHEN length(text) < 1200 OR length(text) > 20000 THEN 'length'
    WHEN regexp_matches(text, '{BAD}') THEN 'bad_pattern'
    WHEN len(regexp_extract_all(text, '[A-Za-z]+')) < 220 THEN 'few_words'
    WHEN len(ls) >= 20 AND len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[-*•]|\\d+[.)]\\s)'))) / len(ls) > 0.45 THEN 'bullets'
    END AS reject_reason FROM measured)"""
ANY_SCORE = REASONS.replace("NOT coalesce(try_cast(score AS DOUBLE) >= FLOOR, FLOOR IS NULL)", "false")
SCORED = REASONS.replace("FLOOR IS NULL", "false").replace("FLOOR", "0.95")
KEY = "lower(regexp_replace(substr(text, 1, 500), '\\s+', ' ', 'g'))"


@query(
    "corpus_clean",
    f"""WITH {ANY_SCORE},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS rn FROM judged WHERE reject_reason IS NULL)
    SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5, printf('%.4f', try_cast(score AS DOUBLE)) AS score
    FROM ranked WHERE rn = 1""",
)
def corpus_clean(spark, folder):
    kept = cp.clean_corpus(ins.corpus(spark, folder), ["doc_id"], NO_SCORE)
    return kept.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"), "score"
    )


@query(
    "corpus_lineage",
    f"""WITH {ANY_SCORE.replace("LEFT JOIN labels l USING (doc_id)", "LEFT JOIN labels l USING (doc_id)")}
    SELECT 'documents.parquet' AS file_name, doc_id AS source_row, md5(text) AS text_md5
    FROM judged WHERE reject_reason IS NULL""",
)
def corpus_lineage(spark, folder):
    corpus = tb.read_corpus(spark, f"{folder}/documents.parquet", score="score")
    return cp.passing(corpus, NO_SCORE).select(
        F.substring_index("source_file", "/", -1).alias("file_name"), "source_row", F.md5("text").alias("text_md5")
    )


@query("corpus_slice", "SELECT doc_id AS row_index, md5(text) AS text_md5 FROM documents WHERE doc_id >= 50 AND doc_id < 150")
def corpus_slice(spark, folder):
    return scan_slice(tb.read_corpus(spark, f"{folder}/documents.parquet"), 50, 100).select("row_index", F.md5("text").alias("text_md5"))


@query(
    "indexed_slice",
    "SELECT doc_id, doc_id AS row_index, md5(text) AS text_md5 FROM documents WHERE doc_id >= 40 AND doc_id < 160",
)
def indexed_slice(spark, folder):
    path = f"{folder}/documents.parquet"
    index = rg.build_index(spark, path, new_shared_path(spark, "groups"))
    rows = rg.read_path(spark, f"{path}@[40:160]", index, ["doc_id", "text"])
    return rows.select("doc_id", "row_index", F.md5("text").alias("text_md5"))


@query(
    "indexed_first_clean",
    f"""WITH {ANY_SCORE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS rn FROM judged WHERE reject_reason IS NULL)
    SELECT doc_id, md5(text) AS text_md5 FROM ranked WHERE rn = 1 ORDER BY doc_id LIMIT 60""",
)
def indexed_first_clean(spark, folder):
    path = f"{folder}/documents.parquet"
    index = rg.build_index(spark, path, new_shared_path(spark, "groups"))
    schema = spark.read.parquet(path).select("doc_id", "text").schema

    def clean(part):
        return cp.dedup_prefix(cp.passing(part, NO_SCORE).drop("score"), ["source_file", "source_row"])

    kept = cp.first_of(lambda rows: rg.read_rows(index, schema, 0, rows), rg.total_rows(index), 60, clean)
    return kept.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "filter_score",
    f"""WITH {ins.CORPUS} SELECT doc_id, printf('%.4f', try_cast(score AS DOUBLE)) AS score_text
    FROM corpus WHERE try_cast(score AS DOUBLE) >= 0.95""",
)
def filter_score(spark, folder):
    corpus = ins.corpus(spark, folder)
    kept = corpus.where(tx.score_ok(F.col("score"), fx.SCORE_MIN))
    return kept.select("doc_id", tx.score_text(F.col("score")).alias("score_text"))


@query("filter_bad_pattern", f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE regexp_matches(text, '{BAD}')")
def filter_bad_pattern(spark, folder):
    docs = ins.table(spark, folder, "documents")
    return docs.where(tx.has_bad_pattern(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "bullet_fraction",
    r"""WITH marked AS (SELECT doc_id, regexp_replace(text, '\n([A-M])', chr(10) || '- \1', 'g') AS text FROM documents),
    lined AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM marked),
    counted AS (SELECT doc_id, len(ls) AS lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[-*•]|\d+[.)]\s)'))) AS bullets FROM lined)
    SELECT doc_id, lines, bullets, CASE WHEN lines >= 20 THEN round(bullets / lines, 6) END AS share FROM counted""",
)
def bullet_fraction(spark, folder):
    docs = ins.table(spark, folder, "documents")
    text = F.regexp_replace("text", r"\n([A-M])", "\n- $1")
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        tx.line_count(F.col("text")).cast("bigint").alias("lines"),
        tx.bullet_count(F.col("text")).cast("bigint").alias("bullets"),
        F.round(tx.bullet_share(F.col("text")), 6).alias("share"),
    )


@query(
    "reject_reasons",
    f"WITH {SCORED} SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS rows FROM judged GROUP BY 1",
)
def reject_reasons(spark, folder):
    judged = cp.with_reject_reason(ins.corpus(spark, folder))
    return judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query(
    "prefix_dedup",
    f"SELECT doc_id, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def prefix_dedup(spark, folder):
    docs = ins.table(spark, folder, "documents").select("doc_id", "text")
    return cp.dedup_prefix(docs, ["doc_id"]).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "first_n_clean",
    f"""WITH {ANY_SCORE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS rn FROM judged WHERE reject_reason IS NULL)
    SELECT doc_id AS source_row, md5(text) AS text_md5 FROM ranked WHERE rn = 1 ORDER BY doc_id LIMIT 40""",
)
def first_n_clean(spark, folder):
    def clean(part):
        return cp.dedup_prefix(cp.passing(part, NO_SCORE).drop("score"), ["source_file", "source_row"])

    kept = cp.first_clean(tb.read_corpus(spark, f"{folder}/documents.parquet"), 40, clean)
    return kept.select("source_row", F.md5("text").alias("text_md5"))


@query(
    "tokenize_stats",
    r"""WITH tok AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS t FROM documents)
    SELECT doc_id, len(t) AS n_tokens, len(t[1:512]) AS n_kept, md5(array_to_string(t[1:512], ' ')) AS kept_md5 FROM tok""",
)
def tokenize_stats(spark, folder):
    docs = ins.table(spark, folder, "documents")
    kept = tk.tokens(F.col("text"), 512)
    return docs.select(
        "doc_id",
        tk.token_count(F.col("text")).cast("bigint").alias("n_tokens"),
        F.size(kept).cast("bigint").alias("n_kept"),
        F.md5(F.array_join(kept, " ")).alias("kept_md5"),
    )


@query("sample_positions", f"WITH {ins.positions_sql(5)} SELECT doc_id, position FROM sampled")
def sample_positions(spark, folder):
    return ins.positions(spark, folder, 5).select("doc_id", "position")


@query("sample_positions_plain", f"WITH {ins.positions_sql(10, [])} SELECT doc_id, position FROM sampled")
def sample_positions_plain(spark, folder):
    return ins.positions(spark, folder, 10, []).select("doc_id", "position")


@query(
    "sampling_audit",
    f"""WITH {ins.positions_sql(5)}
    SELECT count(*) AS documents, count(*) FILTER (s = 0) AS skipped,
           count(*) FILTER (s > 0 AND s < 5) AS short_sampled, CAST(sum(s) AS BIGINT) AS rows FROM d1""",
)
def sampling_audit(spark, folder):
    docs = sp.with_tokens(ins.table(spark, folder, "documents").select("doc_id", "text"))
    return sp.sampling_audit(docs, "doc_id", 5, 42, ins.SPECIALS)


@query(
    "base_rows",
    f"""WITH {ins.base_sql()}
    SELECT doc_id, n_raw_tokens, activation_layer, md5(detokenized_text_truncated) AS text_md5 FROM base""",
)
def base_rows(spark, folder):
    return ins.base(spark, folder).select(
        "doc_id", "n_raw_tokens", "activation_layer", F.md5("detokenized_text_truncated").alias("text_md5")
    )


@query(
    "base_vectors",
    f"""WITH {ins.positions_sql(2)},
    nv AS (SELECT count(*) AS n FROM embeddings),
    slots AS (SELECT doc_id, position, unnest(t[greatest(position - 3, 0) + 1:position + 1]) AS token FROM sampled),
    ids AS (SELECT doc_id, position, ('0x' || substr(sha256(token), 1, 8))::BIGINT % (SELECT n FROM nv) AS vec_id FROM slots),
    cells AS (SELECT doc_id, position, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM ids JOIN embeddings USING (vec_id)),
    pooled AS (SELECT doc_id, position, i, avg(x) AS x FROM cells GROUP BY ALL)
    SELECT doc_id, position, round(sum(x * i), 5) AS weighted, round(sqrt(sum(x * x)), 5) AS norm FROM pooled GROUP BY ALL""",
)
def base_vectors(spark, folder):
    table = ins.table(spark, folder, "embeddings").select("vec_id", "embedding")
    pooled = sp.pooled_vectors(ins.tokenised(spark, folder), table, table.count(), k=2, specials=ins.SPECIALS)
    v = F.col("activation_vector")
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return pooled.select("doc_id", "position", F.round(weighted, 5).alias("weighted"), F.round(norm, 5).alias("norm"))


@query(
    "token_guard",
    r"""SELECT lang, count(*) AS documents, count(*) FILTER (list_contains(regexp_extract_all(text, '\S+'), 'la')) AS with_token,
    count(*) FILTER (list_contains(regexp_extract_all(text, '\S+'), '<pad>')) AS with_pad FROM documents GROUP BY lang""",
)
def token_guard(spark, folder):
    docs = sp.require_no_pad(sp.with_tokens(ins.table(spark, folder, "documents").select("lang", "text")), "<pad>")
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count_if(F.array_contains("tokens", "la")).alias("with_token"),
        F.count_if(F.array_contains("tokens", "<pad>")).alias("with_pad"),
    )


MARKED = """marked AS (
  SELECT doc_id, regexp_extract_all(CASE lang
    WHEN 'en' THEN '<concept> ㈀ </concept> ' || text || ' <concept> ㈀ </concept>'
    WHEN 'fr' THEN '<concept> ㈀ other ' || text
    WHEN 'de' THEN '㈀ </concept> ' || text || ' <concept> ㈀'
    ELSE text END, '\\S+') AS t FROM documents)"""


def marked_tokens(spark, folder):
    text, lang = F.col("text"), F.col("lang")
    site = "<concept> ㈀ </concept>"
    marked = (
        F.when(lang == "en", F.concat(F.lit(site + " "), text, F.lit(" " + site)))
        .when(lang == "fr", F.concat(F.lit("<concept> ㈀ other "), text))
        .when(lang == "de", F.concat(F.lit("㈀ </concept> "), text, F.lit(" <concept> ㈀")))
        .otherwise(text)
    )
    return ins.table(spark, folder, "documents").select("doc_id", tk.tokens(marked).alias("tokens"))


@query(
    "marker_sites",
    f"""WITH {MARKED}
    SELECT doc_id, len(s) AS sites, s[1] AS first_site, s[-1] AS last_site FROM (
      SELECT doc_id, list_filter(range(1, len(t) - 1), lambda i: t[i + 1] = '㈀' AND t[i] = '<concept>' AND t[i + 2] = '</concept>') AS s FROM marked)""",
)
def marker_sites(spark, folder):
    sites = tk.marker_sites(F.col("tokens"), "㈀", "<concept>", "</concept>")
    found = marked_tokens(spark, folder).select("doc_id", sites.alias("s"))
    return found.select(
        "doc_id",
        F.size("s").cast("bigint").alias("sites"),
        F.try_element_at("s", F.lit(1)).cast("bigint").alias("first_site"),
        F.try_element_at("s", F.lit(-1)).cast("bigint").alias("last_site"),
    )


@query(
    "marker_neighbors",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all('first ' || text || ' last', '\S+') AS t FROM documents),
    p AS (SELECT *, CAST(1 + doc_id % (len(t) - 1) AS BIGINT) AS pos FROM t)
    SELECT doc_id, t[pos] AS left_token, t[pos + 1] AS right_token FROM p""",
)
def marker_neighbors(spark, folder):
    # The marker stands somewhere inside the document's own text, by its number.
    tokens = tk.tokens(F.concat(F.lit("first "), F.col("text"), F.lit(" last")))
    docs = ins.table(spark, folder, "documents").select("doc_id", tokens.alias("t"))
    at = (1 + F.pmod("doc_id", F.size("t") - 1)).cast("int")
    put = F.concat(F.slice("t", F.lit(1), at), F.array(F.lit("㈀")), F.slice("t", at + 1, F.size("t")))
    found = docs.select("doc_id", tk.marker_neighbors(put, "㈀").alias("m"))
    return found.select("doc_id", F.col("m.left").alias("left_token"), F.col("m.right").alias("right_token"))


@query(
    "pick_marker",
    """WITH used AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\x{3200}-\\x{33FF}]')) AS marker FROM documents
      UNION SELECT chr(CAST(12800 + doc_id AS INTEGER)) FROM documents WHERE n_chars < 400 AND doc_id < 512),
    usable AS (SELECT r AS code_point, chr(CAST(r AS INTEGER)) AS marker FROM range(12800, 13312) t(r))
    SELECT min(code_point) AS code_point, arg_min(marker, code_point) AS marker FROM usable WHERE marker NOT IN (SELECT marker FROM used)""",
)
def pick_marker(spark, folder):
    # Short documents carry a character of the range, named by their number.
    code = F.lpad(F.hex(F.col("doc_id") + 0x3200), 4, "0")
    own = F.when((F.col("n_chars") < 400) & (F.col("doc_id") < 512), F.decode(F.unhex(code), "UTF-16BE")).otherwise("")
    docs = ins.table(spark, folder, "documents").select(F.concat(F.col("text"), own).alias("text"))
    return sp.pick_marker(docs)


@query(
    "loss_mask",
    r"""WITH turns AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM conversations)
    SELECT conv_id, turn, n_tokens, CASE WHEN role = 'assistant' THEN n_tokens ELSE 0 END AS loss_tokens,
      CAST(sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - n_tokens AS BIGINT) AS first_token FROM turns""",
)
def loss_mask(spark, folder):
    message = F.array(F.struct("role", F.col("text").alias("content")))
    turns = ins.table(spark, folder, "conversations").select("conv_id", "turn", tk.loss_mask(message).alias("mask"))
    sized = turns.select(
        "conv_id",
        "turn",
        F.size("mask").cast("bigint").alias("n_tokens"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("loss_tokens"),
    )
    placed = group_running_sum(sized, "n_tokens", "turn", ["conv_id"], "upto")
    return placed.withColumn("first_token", F.col("upto") - F.col("n_tokens")).drop("upto")


@query(
    "packed_last_index",
    r"""WITH lens AS (SELECT doc_id, doc_id // 64 AS pack, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
    SELECT doc_id, pack, CAST(sum(n) OVER (PARTITION BY pack ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS last_index FROM lens""",
)
def packed_last_index(spark, folder):
    lens = ins.table(spark, folder, "documents").select(
        "doc_id",
        F.floor(F.col("doc_id") / 64).cast("bigint").alias("pack"),
        tk.token_count(F.col("text")).cast("bigint").alias("n"),
    )
    placed = group_running_sum(lens, "n", "doc_id", ["pack"], "upto")
    return placed.select("doc_id", "pack", (F.col("upto") - 1).alias("last_index"))


@query(
    "padded_last_index",
    r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations)
    SELECT conv_id, turn, CASE WHEN n > 0 THEN 3 + n - 1 END AS last_index FROM t""",
)
def padded_last_index(spark, folder):
    # Three pads on the left, two on the right, ones in between.
    n = tk.token_count(F.col("text"))
    mask = F.concat(F.array_repeat(F.lit(0), 3), F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), 2))
    turns = ins.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", tk.last_real_index(mask).cast("bigint").alias("last_index"))


TOKEN_VECTORS = r"""nv AS (SELECT count(*) AS n FROM embeddings),
slots AS (SELECT conv_id, turn, unnest(t) AS token, unnest(range(len(t))) AS position FROM
  (SELECT conv_id, turn, regexp_extract_all('<concept> ㈀ </concept> ' || text, '\S+') AS t FROM conversations)),
ids AS (SELECT *, ('0x' || substr(sha256(token), 1, 8))::BIGINT % (SELECT n FROM nv) AS vec_id FROM slots),
weights AS (SELECT vec_id, sum(x * i) AS w FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)"""


def token_vectors(spark, folder):
    turns = ins.table(spark, folder, "conversations")
    text = F.concat(F.lit("<concept> ㈀ </concept> "), F.col("text"))
    toks = turns.select("conv_id", "turn", tk.tokens(text).alias("tokens"))
    table = ins.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return toks, table, table.count()


def weighted_sum(vector):
    cells = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)


@query(
    "embedding_lookup",
    f"""WITH {TOKEN_VECTORS}
    SELECT conv_id, turn, count(*) AS n_tokens, round(sum(8 * w), 4) AS weighted FROM ids JOIN weights USING (vec_id) GROUP BY ALL""",
)
def embedding_lookup(spark, folder):
    toks, table, n = token_vectors(spark, folder)
    embedded = sp.embed_tokens(toks, table, n, ["conv_id", "turn"], scale=8.0)
    return embedded.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_tokens"), F.round(F.sum(weighted_sum(F.col("embedding"))), 4).alias("weighted")
    )


@query(
    "embedding_splice",
    f"""WITH {TOKEN_VECTORS},
    own AS (SELECT conv_id, turn, 1 AS position, w AS own FROM conversations JOIN weights ON vec_id = (conv_id * 31 + turn) % (SELECT n FROM nv))
    SELECT conv_id, turn, count(own) AS spliced, round(sum(coalesce(own, w)), 4) AS weighted
    FROM ids JOIN weights USING (vec_id) LEFT JOIN own USING (conv_id, turn, position) GROUP BY ALL""",
)
def embedding_splice(spark, folder):
    toks, table, n = token_vectors(spark, folder)
    key = ["conv_id", "turn"]
    embedded = sp.embed_tokens(toks, table, n, key)
    found = tk.marker_sites(F.col("tokens"), "㈀", "<concept>", "</concept>")
    own = F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(n)).alias("vec_id")
    sites = toks.select(*key, F.explode(found).alias("position"), own).join(table, "vec_id")
    sites = sites.select(*key, "position", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    spliced = sp.splice_vectors(embedded, sites, key)
    is_site = (F.col("position") == 1).cast("bigint")
    return spliced.groupBy(*key).agg(
        F.sum(is_site).alias("spliced"), F.round(F.sum(weighted_sum(F.col("embedding"))), 4).alias("weighted")
    )


@query(
    "site_vectors",
    r"""WITH sites AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS nth FROM conversations),
    given AS (SELECT len(regexp_extract_all(text, '\S+')) AS n, row_number() OVER (ORDER BY turn, conv_id) AS nth FROM conversations)
    SELECT conv_id, turn, CAST(1 AS INTEGER) AS position, CAST(n AS DOUBLE) AS cell FROM sites JOIN given USING (nth)""",
)
def site_vectors(spark, folder):
    toks, _, _ = token_vectors(spark, folder)
    found = tk.marker_sites(F.col("tokens"), "㈀", "<concept>", "</concept>")
    sites = toks.select("conv_id", "turn", F.explode(found).alias("position"))
    turns = ins.table(spark, folder, "conversations")
    given = turns.select("turn", "conv_id", F.array(tk.token_count(F.col("text")).cast("double")).alias("vector"))
    paired = sp.vectors_in_order(sites, given, ["conv_id", "turn", "position"], ["turn", "conv_id"])
    return paired.select("conv_id", "turn", "position", F.get("vector", F.lit(0)).alias("cell"))


@query(
    "cjk_share",
    """SELECT lang, count(*) AS rows, round(avg(CASE WHEN regexp_matches(t, '[\\x{3200}-\\x{9fff}]') THEN 1.0 ELSE 0.0 END), 6) AS cjk_share
    FROM (SELECT lang, CASE WHEN n_chars % 3 = 0 THEN text || '中' ELSE text END AS t FROM documents) GROUP BY lang""",
)
def cjk_share(spark, folder):
    from vectext.operators.report import cjk_share as share

    docs = ins.table(spark, folder, "documents")
    text = F.when(F.pmod("n_chars", F.lit(3)) == 0, F.concat(F.col("text"), F.lit("中"))).otherwise(F.col("text"))
    found = share(docs.select("lang", text.alias("text")), "text", ["lang"])
    return found.withColumn("cjk_share", F.round("cjk_share", 6))

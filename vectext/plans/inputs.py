"""Inputs the registered queries share, as Spark plans and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext import fixed_values as fx
from vectext.operators import sampling as sp
from vectext.operators.explain import EXPLANATION, TEXT
from vectext.operators.lookups import lookup_join

SPECIALS = ["the", "and"]
WIDTH = 64
WIDE_TABLES = ("documents", "conversations", "pages", "embeddings")
LAYER = 20
#: Bytes of a table's files that go into one range where it is written in another order.
RANGE_BYTES = 16 << 20
CRITIC_HEAD, CRITIC_TAIL = fx.CRITIC_TEMPLATE.split("{explanation}")
#: The explanation of a row between its tags, in SQL.
WRAPPED = f"'{fx.EXPLANATION_OPEN}' || chr(10) || api_explanation || chr(10) || '{fx.EXPLANATION_CLOSE}'"


def critic_sql(column: str) -> str:
    """The critic's prompt for a column, in SQL."""
    return f"'{CRITIC_HEAD}' || {column} || '{CRITIC_TAIL}'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, dealt out to ``spark.vectext.inputPartitions`` tasks if that is set.

    Set it where a table is a file of one row group, which one task would read
    for all; tables of many row groups need no such shuffle.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get("spark.vectext.inputPartitions", None)
    return df if parts is None or name not in WIDE_TABLES else df.repartition(int(parts))


def range_count(spark: SparkSession, folder: str, name: str) -> int:
    """Ranges to write a table anew in: four, or as many more as keep each near ``RANGE_BYTES`` of it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(4, math.ceil(held / RANGE_BYTES))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality label as a score held as text."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("score"))
    return table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id", "left")


CORPUS = """corpus AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def tokenised(spark: SparkSession, folder: str) -> DataFrame:
    return sp.with_tokens(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def positions(spark: SparkSession, folder: str, k: int, specials: list[str] = SPECIALS) -> DataFrame:
    return sp.sample_positions(tokenised(spark, folder), "doc_id", k, 42, specials)


def positions_sql(k: int, specials: list[str] = SPECIALS, name: str = "sampled") -> str:
    """CTEs ``tok`` and ``name`` (doc_id, t, position): k keyed draws without replacement."""
    listed = ", ".join(f"'{s}'" for s in specials)
    parts = [
        "tok AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS t FROM documents)",
        f"d0 AS (SELECT doc_id, t, list_filter(range(50, len(t)), lambda i: NOT list_contains([{listed}]::VARCHAR[], t[i + 1])) AS c FROM tok)",
        f"d1 AS (SELECT *, len(c) AS n, least({k}, len(c)) AS s, []::BIGINT[] AS picked FROM d0)",
    ]
    for i in range(k):
        draw = f"(('0x' || substr(sha256('42|' || doc_id || '|{i}'), 1, 15))::BIGINT % (n - s + {i} + 1))"
        parts.append(
            f"d{i + 2} AS (SELECT doc_id, t, c, n, s, CASE WHEN {i} >= s THEN picked "
            f"WHEN list_contains(picked, {draw}) THEN list_append(picked, n - s + {i}) "
            f"ELSE list_append(picked, {draw}) END AS picked FROM d{i + 1})"
        )
    parts.append(
        f"{name} AS (SELECT doc_id, t, c[pick + 1] AS position FROM "
        f"(SELECT doc_id, t, c, unnest(picked) AS pick FROM d{k + 1}))"
    )
    return ",\n".join(parts)


def base(spark: SparkSession, folder: str, k: int = fx.POSITIONS_PER_DOC) -> DataFrame:
    return sp.base_rows(tokenised(spark, folder), LAYER, "doc_id", "documents:train:", k, 42, SPECIALS)


def base_sql(k: int = fx.POSITIONS_PER_DOC) -> str:
    return positions_sql(k) + f""",
base AS (
  SELECT CAST(position + 1 AS BIGINT) AS n_raw_tokens,
         array_to_string(list_filter(t[1:position + 1], lambda x: NOT list_contains({SPECIALS}, x)), ' ') AS detokenized_text_truncated,
         CAST({LAYER} AS BIGINT) AS activation_layer,
         'documents:train:' || doc_id AS doc_id
  FROM sampled)"""


def explanation(text: Column, n: Column) -> Column:
    """A two-feature explanation written from the row itself."""
    return F.concat(
        F.lit("Prefix of "), n.cast("string"), F.lit(" tokens.\n\nEnds with "), F.substring_index(text, " ", -1)
    )


def explained(spark: SparkSession, folder: str, k: int = fx.POSITIONS_PER_DOC) -> DataFrame:
    return base(spark, folder, k).withColumn(EXPLANATION, explanation(F.col(TEXT), F.col("n_raw_tokens")))


def explained_sql(k: int = fx.POSITIONS_PER_DOC) -> str:
    return base_sql(k) + """,
explained AS (
  SELECT *, 'Prefix of ' || n_raw_tokens || ' tokens.' || chr(10) || chr(10) || 'Ends with '
         || string_split(detokenized_text_truncated, ' ')[-1] AS api_explanation
  FROM base)"""


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Provider responses made from whole texts: some missing, some never closed."""
    doc = F.col("doc_id")
    closed = F.concat(F.lit("<analysis>\n"), F.col("text"), F.lit("\n</analysis>"))
    raw = (
        F.when(F.pmod(doc, F.lit(11)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(doc, F.lit(7)) == 0, F.concat(F.lit("<analysis>\n"), F.col("text")))
        .otherwise(closed)
    )
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", F.col("text").alias(TEXT), raw.alias("raw_response"))


RESPONSES = """responses AS (
  SELECT doc_id, source, text AS detokenized_text_truncated,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              WHEN doc_id % 7 = 0 THEN '<analysis>' || chr(10) || text
              ELSE '<analysis>' || chr(10) || text || chr(10) || '</analysis>' END AS raw_response
  FROM documents)"""


def cleaned_sql() -> str:
    headers = "|".join(fx.HEADER_PHRASES)
    line = (
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, "
        f"'{fx.LIST_PREFIX}', ''), '{fx.BOLD_WRAP}', '\\1 '), '^\\s+|\\s+$', '', 'g'), '^[*_]+|[*_]+$', '', 'g')"
    )
    return RESPONSES + f""",
body AS (
  SELECT *, CASE WHEN regexp_matches(raw_response, '(?s){fx.RESPONSE_PATTERN}')
                 THEN regexp_extract(raw_response, '(?s){fx.RESPONSE_PATTERN}', 1) END AS b0 FROM responses),
cut AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(b0,
      '(?i)\\s+((?:{headers})\\s*:)', chr(10) || '\\1', 'g'),
      '(?i)\\s+((?:{fx.ORDINAL_WORDS}),)', chr(10) || '\\1', 'g'),
      '(?i)\\s+((?:{fx.FINAL_PHRASES})\\b)', chr(10) || '\\1', 'g') AS b1 FROM body),
lined AS (
  SELECT *, list_filter(list_transform(string_split(b1, chr(10)), lambda x: {line}), lambda x: x <> '') AS ls FROM cut),
sentenced AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(ls[1],
      '({fx.SENTENCE_END})\\s+({fx.SENTENCE_START})', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM lined),
cleaned AS (
  SELECT doc_id, source, detokenized_text_truncated, raw_response,
         array_to_string(CASE WHEN len(ls) = 1 AND len(ss) >= 2 THEN ss ELSE ls END, chr(10) || chr(10)) AS cleaned
  FROM sentenced),
judged AS (
  SELECT *, CASE WHEN cleaned IS NULL THEN 0 ELSE len(string_split(cleaned, chr(10) || chr(10))) END AS feature_count
  FROM cleaned),
reasoned AS (
  SELECT *, CASE WHEN raw_response IS NULL THEN 'provider_returned_none'
                 WHEN cleaned IS NULL THEN 'extract_failed'
                 WHEN feature_count < 2 THEN 'too_few_features' END AS reason FROM judged)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").withColumnRenamed("embedding", "activation_vector")


def with_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the mean vector of their label as the prediction."""
    rows = vectors(spark, folder)
    cells = rows.select("label", F.posexplode("activation_vector").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    # One row per label, each vector meets one of them.
    return lookup_join(rows, means.groupBy("label").agg(listed.alias("predicted")), "label", ["vec_id"], "inner")


CENTROID = """cells AS (
  SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM cells GROUP BY ALL),
sums AS (
  SELECT c.vec_id, c.label, sum(c.x * c.x) AS gg, sum(m.m * m.m) AS pp, sum(c.x * m.m) AS pg
  FROM cells c JOIN means m USING (label, i) GROUP BY ALL),
scored AS (SELECT *, 2 - 2 * pg / sqrt(gg * pp) AS mse FROM sums)"""


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """Scored samples from events: reward, group, document id by source."""
    kind = F.col("event_type")
    source = F.when(kind == "view", "WildChat").when(kind == "click", "Ultra-FineWeb").otherwise(kind)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("index"),
        F.col("user_id").alias("group_index"),
        F.concat_ws(":", source, F.col("event_id").cast("string")).alias("doc_id"),
        F.col("value").alias("reward"),
        "props",
        "event_type",
    )


ROLLOUTS = """rollouts AS (
  SELECT event_id AS index, user_id AS group_index, value AS reward, props, event_type,
         CASE event_type WHEN 'view' THEN 'WildChat' WHEN 'click' THEN 'Ultra-FineWeb' ELSE event_type END
         || ':' || event_id AS doc_id
  FROM events)"""


def as_generations(documents: DataFrame) -> DataFrame:
    """Generations made from whole texts: some untagged, some cut off."""
    open_, close = fx.EXPLANATION_OPEN, fx.EXPLANATION_CLOSE
    text = F.col("text")
    tagged = F.concat(F.lit(open_ + "\n"), text, F.lit("\n" + close))
    return documents.select(
        F.col("doc_id").alias("index"),
        "source",
        F.when(F.pmod("doc_id", F.lit(5)) == 0, text).otherwise(tagged).alias("response"),
        F.when(F.pmod("doc_id", F.lit(9)) == 0, "truncated").otherwise("completed").alias("status"),
        (F.col("n_chars") + 1).alias("n_logprobs"),
    )


def generations(spark: SparkSession, folder: str) -> DataFrame:
    return as_generations(table(spark, folder, "documents"))


GENERATIONS = f"""generations AS (
  SELECT doc_id AS index, source, n_chars + 1 AS n_logprobs,
         CASE WHEN doc_id % 5 = 0 THEN text
              ELSE '{fx.EXPLANATION_OPEN}' || chr(10) || text || chr(10) || '{fx.EXPLANATION_CLOSE}' END AS response,
         CASE WHEN doc_id % 9 = 0 THEN 'truncated' ELSE 'completed' END AS status
  FROM documents),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(response, '(?s){fx.EXPLANATION_OPEN}.*?{fx.EXPLANATION_CLOSE}') THEN
      regexp_replace(regexp_extract(response, '(?s){fx.EXPLANATION_OPEN}(.*?){fx.EXPLANATION_CLOSE}', 1), '^\\s+|\\s+$', '', 'g') END AS explanation
  FROM generations),
filled AS (
  SELECT *, regexp_extract_all({critic_sql("explanation")}, '\\S+') AS ctoks
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN explanation IS NULL OR status = 'truncated' OR len(ctoks) > 512 THEN 'failed' ELSE status END AS final_status
  FROM filled)"""


def shards(spark: SparkSession, folder: str, count: int = 16) -> DataFrame:
    """One manifest for each of ``count`` runs of documents, whatever the size of the table."""
    docs = table(spark, folder, "documents").select("doc_id")
    shard = F.floor(F.col("doc_id") / F.ceil(docs.agg(F.count("*")).scalar() / F.lit(count))).cast("bigint")
    return (
        docs
        .groupBy(shard.alias("shard"))
        .agg(F.min("doc_id").alias("start"), F.count("*").alias("length"), F.count("*").alias("row_count"))
        .select(
            F.concat(F.lit("shard_"), F.col("shard").cast("string")).alias("dataset_id"),
            "start", "length", "row_count",
            F.lit("org/model-a").alias("base_model"),
            F.lit(LAYER).cast("bigint").alias("layer_index"),
            F.lit(WIDTH).cast("bigint").alias("d_model"),
            F.lit("none").alias("norm"),
            F.lit("documents").alias("corpus"),
            F.lit(5).cast("bigint").alias("positions_per_doc"),
        )
    )


SHARDS = """shards AS (
  SELECT 'shard_' || (doc_id // per) AS dataset_id, min(doc_id) AS start, count(*) AS length, count(*) AS row_count
  FROM documents, (SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS per FROM documents) GROUP BY doc_id // per)"""

"""Jobs from stored tables to stored tables, each with its manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext import fixed_values as fx
from vectext.functions import keys as ky
from vectext.functions.text import QualityRules
from vectext.operators import build as bd, corpus as cp, explain as ex, layout as ly, manifests as mf, scoring as sc
from vectext.sources import manifest as ms, tables as tb


def derive_manifest(
    spark: SparkSession, source: str, target: str, dataset: Callable[[Column], Column], **fields: Column
) -> None:
    """The target's manifest: the source's with a new id, its rows counted, its parent named."""
    old = ms.read_manifest(spark, source)
    rows = spark.read.parquet(target).agg(F.count("*")).scalar()
    new = {
        "parent_datasets": F.array("dataset_id"),
        "row_count": rows,
        "created_by": F.lit("vectext"),
        **fields,
    }
    made = old.drop("created_at").withColumns(new).withColumn("dataset_id", dataset(F.col("dataset_id")))
    ms.write_manifest(made, target)


def filter_corpus(
    spark: SparkSession,
    inputs: Sequence[str],
    output: str,
    length: int | None = None,
    text: str = "content",
    score: str = "score",
    rules: QualityRules = QualityRules(),
    chars: int | None = fx.PREFIX_CHARS,
) -> None:
    """Clean rows of the inputs, one per opening text, the first ``length`` in scan order."""
    order = ["source_file", "source_row"]
    rows = tb.read_corpus(spark, inputs, text, score)

    def clean(part: DataFrame) -> DataFrame:
        return cp.clean_corpus(part, order, rules, text, score, chars)

    kept = clean(rows) if length is None else cp.first_clean(rows, length, clean)
    if score not in kept.columns:
        kept = kept.withColumn(score, F.lit(None).cast("string"))
    tb.write_table(kept.select(text, score, *order), output)


def merge_tables(spark: SparkSession, inputs: Sequence[str], output: str) -> None:
    """One base table from contiguous shards, with the manifest a single run would have."""
    notes = tb.union_shards(*[ms.read_manifest(spark, p).withColumn("path", F.lit(p)) for p in inputs])
    slices = F.col("extraction.corpus_slice")
    parts = notes.select(
        "path", "dataset_id", "stage", "row_count", slices["start"].alias("start"), slices["length"].alias("length"),
        *[F.col(f"extraction.{f}").alias(f) for f in mf.AGREEING],
    )
    rows = parts.orderBy("start").select("path", "stage").collect()  # one row per input
    if any(r["stage"] != "base" for r in rows):
        raise ValueError("only base tables can be merged")
    paths = [r["path"] for r in rows]
    tb.write_table(mf.merge_shards([spark.read.parquet(p) for p in paths], parts), output)
    merged = mf.merge_manifests(parts)
    whole = F.create_map(F.lit("start"), F.col("_start"), F.lit("length"), F.col("_length"))
    first = ms.read_manifest(spark, paths[0]).drop("dataset_id", "row_count", "parent_datasets", "created_at")
    made = first.withColumns({
        "dataset_id": merged.select("dataset_id").scalar(),
        "row_count": merged.select("row_count").scalar(),
        "parent_datasets": F.split(merged.select("parents").scalar(), ","),
        "_start": merged.select("start").scalar(),
        "_length": merged.select("length").scalar(),
        "created_by": F.lit("vectext"),
    })
    made = made.withColumn("extraction", F.col("extraction").withField("corpus_slice", whole))
    ms.write_manifest(made, output)


def reuse_table(
    spark: SparkSession, raw: str, prior: str, output: str, min_share: float = fx.MIN_MATCH_SHARE, template: str = fx.CRITIC_TEMPLATE
) -> None:
    """Explain a raw split from an earlier run's built table, by document and position."""
    rows = spark.read.parquet(raw)
    built = spark.read.parquet(prior)
    wrapped = "response" if "response" in built.columns else "prompt"
    built = built.select("doc_id", "n_raw_tokens", wrapped, *tb.lineage())
    known = ex.prior_explanations(built, template)
    joined = ex.reuse_exact(rows, known, ["source_file", "source_row"], min_share)
    tb.write_table(joined, output)
    summary = F.struct(
        F.lit(f"joined-from:{prior}").alias("model"), F.lit(-1).cast("bigint").alias("max_tokens"),
        F.lit(-1.0).alias("temperature"), F.lit("(reused by document and position)").alias("instruction_prompt"),
    )
    derive_manifest(spark, raw, output, ky.explained_id, api_summaries=summary)


def recover_tables(spark: SparkSession, built: Sequence[str], output: str, template: str = fx.CRITIC_TEMPLATE) -> list[str]:
    """Cache tables (text, explanation) from built tables that kept their texts."""
    made = []
    for path in built:
        target = f"{output.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}_explained"
        tb.write_table(bd.recover(spark.read.parquet(path), template), target)
        made.append(target)
    return made


def row_key() -> Column:
    return F.concat_ws("|", "doc_id", F.col("n_raw_tokens").cast("string"))


def shuffle_table(
    spark: SparkSession, source: str, output: str, seed: int = 42, mode: str = "errorifexists"
) -> None:
    """All rows of a table in keyed random order."""
    dataset = ms.read_manifest(spark, source).first()["dataset_id"]
    tb.write_table(ly.shuffle_rows(spark.read.parquet(source), row_key(), seed, dataset), output, mode=mode)
    derive_manifest(spark, source, output, lambda i: ky.shuffled_id(i, seed))


def permute_table(spark: SparkSession, source: str, output: str, seed: int = 42, vector: str = "activation_vector") -> None:
    """The random-vector baseline: vectors permuted across rows, all else in place."""
    rows = tb.require_columns(spark.read.parquet(source), [vector])
    dataset = ms.read_manifest(spark, source).first()["dataset_id"]
    keyed = rows.withColumn("_key", row_key())
    tb.write_table(ly.permute_column(keyed, "_key", vector, seed, dataset).drop("_key"), output)
    derive_manifest(spark, source, output, lambda i: ky.permuted_id(i, seed))


def check_vectors(spark: SparkSession, source: str, output: str, vector: str = "activation_vector") -> DataFrame:
    """Copy a table whose vectors all have the width its manifest states."""
    width = ms.read_manifest(spark, source).first()["extraction"]["d_model"]
    tb.write_table(sc.require_vectors(spark.read.parquet(source), width, vector), output)
    derive_manifest(spark, source, output, lambda i: i)
    return spark.read.parquet(output)

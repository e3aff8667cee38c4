"""Dataset manifests: one JSON record beside each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext import fixed_values as fx

KIND = "vector_text_dataset"

EXTRACTION = (
    "struct<base_model:string,d_model:bigint,layer_index:bigint,norm:string,corpus:string,"
    "corpus_slice:map<string,bigint>,positions_per_doc:bigint>"
)
TOKENS = (
    "struct<injection_char:string,injection_token_id:bigint,injection_left_neighbor_id:bigint,"
    "injection_right_neighbor_id:bigint,critic_suffix_ids:array<bigint>>"
)
SUMMARIES = "struct<model:string,max_tokens:bigint,temperature:double,instruction_prompt:string>"

SCHEMA = (
    f"dataset_id string, stage string, row_count bigint, extraction {EXTRACTION}, kind string,"
    f"schema_version bigint, keep_debug_metadata boolean, tokens {TOKENS},"
    f"prompt_templates map<string,string>, api_summaries {SUMMARIES},"
    "parent_datasets array<string>, created_at string, created_by string, git_commit string"
)


def utc_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def complete(manifests: DataFrame) -> DataFrame:
    """Manifests with every field; fields not given get their defaults."""
    defaults = {
        "kind": F.lit(KIND),
        "schema_version": F.lit(fx.MANIFEST_VERSION).cast("bigint"),
        "keep_debug_metadata": F.lit(True),
        "tokens": F.lit(None).cast(TOKENS),
        "prompt_templates": F.create_map().cast("map<string,string>"),
        "api_summaries": F.lit(None).cast(SUMMARIES),
        "parent_datasets": F.array().cast("array<string>"),
        "created_at": utc_stamp(),
        "created_by": F.lit(""),
        "git_commit": F.lit(""),
    }
    fields = ["dataset_id", "stage", "row_count", "extraction", *defaults]
    given = set(manifests.columns)
    return manifests.select(*[F.col(f) if f in given else defaults[f].alias(f) for f in fields])


def problem() -> Column:
    """First contract a manifest breaks; null where it is sound.

    Training stages need their tokens and the actor template; the critic stage
    also needs its suffix and its own template.
    """
    training = F.col("stage").isin(fx.TRAINING_STAGES)
    critic = F.col("stage") == "ar_sft"

    def template(name: str) -> Column:
        return F.coalesce(F.try_element_at("prompt_templates", F.lit(name)), F.lit("")) != ""

    return (
        F.when(~F.col("stage").isin(["base", *fx.TRAINING_STAGES]), "unknown_stage")
        .when(training & F.col("tokens").isNull(), "no_tokens")
        .when(training & F.col("tokens.injection_token_id").isNull(), "no_marker_id")
        .when(training & ~template("actor"), "no_actor_template")
        .when(critic & F.col("tokens.critic_suffix_ids").isNull(), "no_critic_suffix")
        .when(critic & ~template("critic"), "no_critic_template")
    )


def checked(manifests: DataFrame) -> DataFrame:
    """The manifests, or an error naming the first broken contract."""
    fault = problem()
    note = F.concat(F.lit("manifest "), F.col("dataset_id"), F.lit(": "), fault)
    return manifests.withColumn(
        "dataset_id", F.when(fault.isNull(), F.col("dataset_id")).otherwise(F.raise_error(note).cast("string"))
    )


def require_raw_base(manifest: DataFrame) -> None:
    """Training tables are built from base rows with raw vectors only."""
    row = manifest.select("dataset_id", "stage", "extraction.norm").first()
    if row["stage"] != "base" or row["norm"] != "none":
        raise ValueError(f"{row['dataset_id']}: stage {row['stage']}, norm {row['norm']}; base rows with raw vectors needed")


def to_json(manifests: DataFrame) -> DataFrame:
    return checked(complete(manifests)).select(F.to_json(F.struct("*")).alias("manifest"))


def from_json(records: DataFrame, column: str = "manifest", kind: str = KIND) -> DataFrame:
    """Manifests from JSON text; unknown fields are ignored, other kinds are an error."""
    parsed = records.select(F.from_json(column, SCHEMA).alias("m")).select("m.*")
    known = (F.col("kind") == kind) & (F.col("schema_version") == fx.MANIFEST_VERSION)
    fault = F.raise_error(F.concat_ws(" ", F.lit("not a manifest of this kind and version:"), "kind", "schema_version"))
    return parsed.withColumn(
        "kind", F.when(F.coalesce(known, F.lit(False)), F.col("kind")).otherwise(fault.cast("string"))
    )


def manifest_folder(table_path: str) -> str:
    return table_path.split("@[")[0].rstrip("/") + ".manifest"


def write_manifest(manifest: DataFrame, table_path: str) -> None:
    """One JSON line in a folder beside the table."""
    to_json(manifest).coalesce(1).write.mode("overwrite").text(manifest_folder(table_path))


def read_manifest(spark: SparkSession, table_path: str, kind: str = KIND) -> DataFrame:
    return from_json(spark.read.text(manifest_folder(table_path)), "value", kind)

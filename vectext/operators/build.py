"""Training tables: actor, critic and reinforcement rows, and their inverses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx, tokens as tk
from vectext.operators.explain import EXPLANATION, TEXT, prior_explanations
from vectext.sources.tables import require_columns

PROVENANCE = ["n_raw_tokens", "activation_layer", "doc_id"]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def actor_prompt(template: str = fx.ACTOR_TEMPLATE) -> Column:
    """The same one-message prompt on every row, with the placeholder in its slot."""
    head, tail = tx.split_template(template, "{injection_char}")
    return F.array(message("user", F.lit(head + fx.INJECT_PLACEHOLDER + tail)))


def carried(df: DataFrame, keep_text: bool) -> list[str]:
    extra = [TEXT] if keep_text and TEXT in df.columns else []
    vector = ["activation_vector"] if "activation_vector" in df.columns else []
    return [*vector, *PROVENANCE, *extra]


def build_av(explained: DataFrame, template: str = fx.ACTOR_TEMPLATE, keep_text: bool = True) -> DataFrame:
    """Actor rows: constant prompt, wrapped explanation, raw vector, provenance."""
    require_columns(explained, [EXPLANATION, *PROVENANCE])
    return explained.select(
        actor_prompt(template).alias("prompt"),
        tx.wrap_explanation(F.col(EXPLANATION)).alias("response"),
        *carried(explained, keep_text),
    )


def build_rl(base: DataFrame, template: str = fx.ACTOR_TEMPLATE, keep_text: bool = True) -> DataFrame:
    require_columns(base, PROVENANCE)
    return base.select(actor_prompt(template).alias("prompt"), *carried(base, keep_text))


def build_ar(explained: DataFrame, template: str = fx.CRITIC_TEMPLATE, keep_text: bool = True) -> DataFrame:
    """Critic rows: the filled template, which has to end with its stable suffix."""
    require_columns(explained, [EXPLANATION, *PROVENANCE])
    suffix = tk.stable_suffix(template)
    prompt = tx.fill_template(template, F.col(EXPLANATION))
    fault = F.raise_error(F.lit("a critic prompt does not end with the template's suffix")).cast("string")
    checked = F.when(tk.ends_with(tk.tokens(prompt), suffix), prompt).otherwise(fault)
    return explained.select(checked.alias("prompt"), *carried(explained, keep_text))


def build(
    stage: str, df: DataFrame, keep_text: bool = True, actor: str = fx.ACTOR_TEMPLATE, critic: str = fx.CRITIC_TEMPLATE
) -> DataFrame:
    """The training table of a stage, from the actor's or the critic's template."""
    if stage not in fx.TRAINING_STAGES:
        raise ValueError(f"unknown stage {stage!r}, known: {fx.TRAINING_STAGES}")
    make = {"av_sft": build_av, "ar_sft": build_ar, "rl": build_rl}[stage]
    return make(df, critic if stage == "ar_sft" else actor, keep_text)


def recover(built: DataFrame, template: str = fx.CRITIC_TEMPLATE) -> DataFrame:
    """Cache rows (text, explanation) from a built table that kept its texts."""
    require_columns(built, [TEXT])
    return prior_explanations(built, template, allow_empty=False).select(TEXT, EXPLANATION)


# ------------------------------------------------------------- loading prompts


def has_placeholder(prompt: Column) -> Column:
    return F.exists(prompt, lambda m: F.contains(m["content"], F.lit(fx.INJECT_PLACEHOLDER)))


def with_marker(prompt: Column, marker: str) -> Column:
    """Prompt messages with the marker in place of the placeholder."""
    put = F.transform(
        prompt,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.replace(m["content"], F.lit(fx.INJECT_PLACEHOLDER), F.lit(marker)).alias("content"),
        ),
    )
    fault = F.raise_error(F.lit(f"no message contains {fx.INJECT_PLACEHOLDER}"))
    return F.when(has_placeholder(prompt), put).otherwise(fault.cast("array<struct<role:string,content:string>>"))


def loader_view(built: DataFrame, marker: str) -> DataFrame:
    """Rows as a trainer loads them: marked prompt and a metadata struct.

    Complete text prompts pass as they are.
    """
    listed = built.schema["prompt"].dataType.typeName() == "array"
    prompt = with_marker(F.col("prompt"), marker) if listed else F.col("prompt")
    metadata = F.struct(*[c for c in built.columns if c != "prompt"])
    return built.select(prompt.alias("prompt"), metadata.alias("metadata"))


def with_response_turn(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, F.array(message("assistant", response)))


def supervised_rows(df: DataFrame) -> DataFrame:
    """Full message list, its loss mask and the response length."""
    return (
        df.withColumn("messages", with_response_turn(F.col("prompt"), F.col("response")))
        .withColumn("loss_mask", tk.loss_mask(F.col("messages")))
        .withColumn("response_length", tk.response_length(F.col("loss_mask")))
    )


def critic_rows(rollouts: DataFrame, template: str = fx.CRITIC_TEMPLATE) -> DataFrame:
    """Completed rollouts (see ``generation_status``) as critic input: prompt
    tokens, their number, raw vector."""
    prompt = tx.fill_template(template, F.col("explanation"))
    vector = ["activation_vector"] if "activation_vector" in rollouts.columns else []
    return (
        rollouts.where("final_status = 'completed'")
        .withColumn("tokens", tk.tokens(prompt))
        .select("index", "tokens", F.size("tokens").cast("bigint").alias("total_length"), *vector)
    )


def prompts_end_with(df: DataFrame, suffix: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """Rows whose prompt does not end with the suffix; empty when all do."""
    return df.where(~tk.ends_with(tk.tokens(F.col(prompt)), suffix))

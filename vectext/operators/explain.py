"""Explanations: cache lookup, provider calls, cleaning, rejects, exact reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx
from vectext.functions import text as tx
from vectext.functions.keys import text_key
from vectext.operators.index import chunk_id
from vectext.operators.lookups import last_per_key, lookup_join
from vectext.session import cut_lineage

TEXT = "detokenized_text_truncated"
EXPLANATION = "api_explanation"
INSTRUCTION = (
    "Name the two or three features of the text below that matter most for predicting how it "
    "goes on, one short paragraph each, blank lines between, inside <analysis> tags.\n\n{text}"
)


def explanation_cache(*sources: DataFrame, order: str | None = None) -> DataFrame:
    """One explanation per text hash; later sources win, then the greater ``order``."""
    parts = []
    for number, source in enumerate(sources):
        rank = F.col(order) if order else F.lit(0)
        parts.append(
            source.select(
                text_key(F.col(TEXT)).alias("text_key"),
                F.col(EXPLANATION).alias("cached"),
                F.lit(number).alias("_source"),
                rank.alias("_order"),
            )
        )
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return last_per_key(merged, ["text_key"], ["_source", "_order"]).select("text_key", "cached")


def with_cached(df: DataFrame, cache: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows with the cached explanation of their text, null on a miss."""
    keyed = df.withColumn("text_key", text_key(F.col(TEXT)))
    return lookup_join(keyed, cache, "text_key", spread, "left")


def cached_is_sound() -> Column:
    """Whether a cached explanation is there and has enough features."""
    return F.col("cached").isNotNull() & (tx.feature_count(F.col("cached")) >= fx.MIN_FEATURES)


def cache_hit_rate(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    hit = F.col("cached").isNotNull()
    rate = looked_up.agg(
        F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("share")
    )
    return rate.withColumn("cached_texts", cache.agg(F.count("*")).scalar())


def complete(
    df: DataFrame,
    provider: Callable[[list[str]], list[str | None]],
    template: str = INSTRUCTION,
    chunk_rows: int = fx.EXPLAIN_CHUNK,
) -> DataFrame:
    """Responses of a text provider, at most ``chunk_rows`` prompts per call.

    The provider returns one text or None (gave up) per prompt; anything else
    is an error. Pass cache misses only, and keep the result before using it
    twice: a lazy result would call the provider again.
    """
    head, tail = tx.split_template(template, "{text}")
    names = df.columns
    out = df.withColumn("raw_response", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = [head + text + tail for text in batch[TEXT]]
            replies = []
            for start in range(0, len(prompts), chunk_rows):
                chunk = prompts[start : start + chunk_rows]
                answers = list(provider(chunk))
                if len(answers) != len(chunk):
                    raise ValueError(f"{len(answers)} responses for {len(chunk)} prompts")
                if any(a is not None and (not isinstance(a, str) or not a) for a in answers):
                    raise ValueError("a response must be non-empty text or None")
                replies.extend(answers)
            yield batch[names].assign(raw_response=pd.Series(replies, index=batch.index, dtype=object))

    return df.mapInPandas(run, out)


def clean_responses(df: DataFrame, pattern: str = fx.RESPONSE_PATTERN) -> DataFrame:
    """Cleaned text, feature count and the reason a response is dropped, if any.

    The three come out of one generator, one row per row: a filter on the
    reason is then not pushed below, where it would clean every text again.
    """

    def judged(cleaned: Column) -> Column:
        count = tx.feature_count(cleaned).cast("int")
        reason = (
            F.when(F.col("raw_response").isNull(), "provider_returned_none")
            .when(cleaned.isNull(), "extract_failed")
            .when(count < fx.MIN_FEATURES, "too_few_features")
        )
        return F.struct(cleaned.alias("cleaned"), count.alias("feature_count"), reason.alias("reason"))

    cleaned = F.array(tx.clean_explanation(F.col("raw_response"), pattern))
    return df.select("*", F.inline(F.transform(cleaned, judged)))


def kept_responses(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("reason is null").withColumnRenamed("cleaned", EXPLANATION).drop(
        "raw_response", "feature_count", "reason"
    )


def rejects(cleaned: DataFrame, index: str, chunk_rows: int = fx.EXPLAIN_CHUNK) -> DataFrame:
    """Reject log: where the row sat, what came back and why it was dropped."""
    chunk = chunk_id(index, chunk_rows) * chunk_rows
    return cleaned.where("reason is not null").select(
        chunk.alias("chunk_start"),
        (F.col(index) - chunk).cast("bigint").alias("row_in_chunk"),
        F.col(index).alias("global_row"),
        F.col("doc_id").cast("string").alias("doc_id"),
        text_key(F.col(TEXT)).alias("text_sha256"),
        "reason",
        "raw_response",
        "cleaned",
        "feature_count",
    )


def explain(
    df: DataFrame,
    provider: Callable[[list[str]], list[str | None]],
    index: str,
    cache: DataFrame | None = None,
    template: str = INSTRUCTION,
    pattern: str = fx.RESPONSE_PATTERN,
    chunk_rows: int = fx.EXPLAIN_CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Explained rows and the reject log.

    Cached rows skip the provider. Provider responses are written to the shared
    folder once, cleaned and judged, since both results read them.
    """
    columns = df.columns
    if cache is None:
        hits, misses = None, df
    else:
        looked_up = with_cached(df, cache, [index])
        hits = looked_up.where(cached_is_sound()).withColumnRenamed("cached", EXPLANATION)
        misses = looked_up.where("cached is null")
    responses = cut_lineage(clean_responses(complete(misses.select(*columns), provider, template, chunk_rows), pattern))
    explained = kept_responses(responses).select(*columns, EXPLANATION)
    if hits is not None:
        explained = hits.select(*columns, EXPLANATION).unionByName(explained)
    return explained, rejects(responses, index, chunk_rows)


def prior_explanations(
    built: DataFrame, critic_template: str = fx.CRITIC_TEMPLATE, allow_empty: bool = True
) -> DataFrame:
    """Explanations unwrapped from a built table: its response, or its prompt.

    A row without one is an error, and so is an empty one unless allowed.
    """
    if "response" in built.columns:
        text = tx.extract_explanation(F.col("response"))
    else:
        text = tx.unwrap_template(F.col("prompt"), critic_template)
    fault = F.raise_error(F.lit("a built row holds no explanation")).cast("string")
    sound = text.isNotNull() if allow_empty else F.coalesce(text, F.lit("")) != ""
    return built.withColumn(EXPLANATION, F.when(sound, text).otherwise(fault))


def reuse_exact(
    raw: DataFrame, prior: DataFrame, order: Sequence[str], min_share: float | None = fx.MIN_MATCH_SHARE
) -> DataFrame:
    """Explanations of an earlier run by (document, position); other rows drop.

    ``prior`` may repeat a key, the greatest ``order`` wins. A matched share
    below ``min_share`` is an error: the runs do not belong together. The share
    is counted from keys alone, so ``raw`` is read twice, and of its other
    columns only those move that the caller goes on with.
    """
    key = ["doc_id", "n_raw_tokens"]
    lut = last_per_key(prior.select(*key, EXPLANATION, *[c for c in order if c not in key]), key, order)
    lut = lut.select(*key, EXPLANATION)
    if min_share is not None:
        # One explanation per key, written once: the share and the rows come from the same table.
        lut = cut_lineage(lut)
        keys = raw.select(*key).join(lut.select(*key, F.lit(True).alias("_matched")), key, "left")
        total, matched = keys.agg(F.count("*"), F.count("_matched")).first()
        if total == 0 or matched / total < min_share:
            raise ValueError(f"{matched} of {total} rows matched, below {min_share}")
    return raw.join(lut, key).select(*raw.columns, EXPLANATION)


def pending_chunks(df: DataFrame, done: DataFrame, index: str, chunk_rows: int = fx.EXPLAIN_CHUNK) -> DataFrame:
    """Rows of chunks that are not done yet. ``done`` has one ``chunk`` per row."""
    return df.withColumn("chunk", chunk_id(index, chunk_rows)).join(done.select("chunk"), "chunk", "left_anti")


def run_overlap(left: DataFrame, right: DataFrame, key: Sequence[str], text: str = TEXT) -> DataFrame:
    """How far two runs agree: shared keys, differing texts, keys of one side."""
    a = left.select(*key, F.sha2(text, 256).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*key, F.sha2(text, 256).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return (
        a.join(b, list(key), "full_outer")
        .agg(
            F.count_if(both).alias("shared"),
            F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("text_differs"),
            F.count_if(F.col("_in_b").isNull()).alias("only_left"),
            F.count_if(F.col("_in_a").isNull()).alias("only_right"),
        )
        .withColumn("overlap_share", F.col("shared") / (F.col("shared") + F.col("only_left")))
    )

"""Position sampling, base tables and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx
from vectext.functions import tokens as tk
from vectext.functions.keys import hash_number
from vectext.operators.index import global_index
from vectext.operators.lookups import lookup_join

#: UTF-8 bytes of text, give or take a text, whose tokens are Python strings at once.
SLICE_BYTES = 1 << 20


def with_tokens(df: DataFrame, text: str = "text", max_length: int | None = None, tokenizer: Column | None = None) -> DataFrame:
    """Adds ``tokens``; ``tokenizer`` may be any array<string> column, such as an Arrow UDF call."""
    return df.withColumn("tokens", tk.tokens(F.col(text), max_length) if tokenizer is None else tokenizer)


def python_tokenizer(tokenize: Callable[[str], Sequence[str]]) -> Callable[[Column | str], Column]:
    """A Python function of one text as a ``tokenizer`` of whole columns; null texts stay null.

    A text becomes many Python strings, so a batch is tokenised and passed on in
    slices of ``SLICE_BYTES`` of text: a worker never holds the tokens of more.
    """

    @F.arrow_udf("array<string>")
    def tokenized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            # A text that takes the sum over another multiple begins a slice.
            filled = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
            ends = [*(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)]
            for start, end in zip([0, *ends], ends):
                found = [None if t is None else list(tokenize(t)) for t in texts.slice(start, end - start).to_pylist()]
                yield pa.array(found, pa.list_(pa.string()))

    return tokenized


def sample_positions(
    df: DataFrame,
    key: str,
    k: int = fx.POSITIONS_PER_DOC,
    seed: int = 42,
    specials: Sequence[str] = (),
    min_position: int = fx.MIN_POSITION,
    **fields: Callable[[Column, Column], Column],
) -> DataFrame:
    """Key and position of every sampled position of a tokenised document.

    The draw happens inside the document's own row, so nothing is shuffled and
    only the chosen positions become rows. ``fields`` adds columns made from
    (tokens, position); they too are made inside the row, so that the token
    list is not copied to every position.
    """
    picked = tk.sampled_positions(F.col("tokens"), F.col(key), k, seed, specials, min_position)

    def row(position: Column) -> Column:
        made = [make(F.col("tokens"), position).alias(name) for name, make in fields.items()]
        return F.struct(position.alias("position"), *made)

    return df.select(key, F.inline(F.transform(picked, row)))


def sampling_audit(
    df: DataFrame,
    key: str,
    k: int = fx.POSITIONS_PER_DOC,
    seed: int = 42,
    specials: Sequence[str] = (),
    min_position: int = fx.MIN_POSITION,
) -> DataFrame:
    """Documents without a candidate, documents with fewer than ``k`` and rows."""
    picked = F.size(tk.sampled_positions(F.col("tokens"), F.col(key), k, seed, specials, min_position))
    return df.select(picked.alias("n")).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("n") == 0).alias("skipped"),
        F.count_if((F.col("n") > 0) & (F.col("n") < k)).alias("short_sampled"),
        F.sum("n").cast("bigint").alias("rows"),
    )


def require_no_pad(df: DataFrame, pad: str) -> DataFrame:
    """Tokens, or an error where the pad token got into a document."""
    clean = ~F.array_contains("tokens", pad)
    fault = F.raise_error(F.lit(f"pad token {pad!r} among document tokens")).cast("array<string>")
    return df.withColumn("tokens", F.when(clean, F.col("tokens")).otherwise(fault))


def base_rows(
    df: DataFrame,
    layer: int,
    key: str,
    corpus: str = "",
    k: int = fx.POSITIONS_PER_DOC,
    seed: int = 42,
    specials: Sequence[str] = (),
    min_position: int = fx.MIN_POSITION,
) -> DataFrame:
    """Prefix text and provenance of the sampled positions of tokenised documents.

    ``corpus`` goes before the key to make the document id.
    """
    rows = sample_positions(
        df, key, k, seed, specials, min_position, text=lambda toks, at: tk.prefix_text(toks, at + 1, specials)
    )
    return rows.select(
        (F.col("position") + 1).alias("n_raw_tokens"),
        F.col("text").alias("detokenized_text_truncated"),
        F.lit(layer).cast("bigint").alias("activation_layer"),
        F.concat(F.lit(corpus), F.col(key).cast("string")).alias("doc_id"),
    )


def vector_slots(toks: Column, n_vectors: int) -> Column:
    """Table row of each token, by hash."""
    return F.transform(toks, lambda t: F.pmod(hash_number(F.sha2(t, 256), 8), F.lit(n_vectors)))


def pooled_vectors(
    df: DataFrame,
    table: DataFrame,
    n_vectors: int,
    window: int = 4,
    key: str = "doc_id",
    k: int = fx.POSITIONS_PER_DOC,
    seed: int = 42,
    specials: Sequence[str] = (),
) -> DataFrame:
    """Default vectors: mean table row of the last ``window`` tokens up to a position.

    Frequent tokens make large partitions, which adaptive execution splits; at most ``window``
    vectors meet in one group.
    """

    def recent(toks: Column, at: Column) -> Column:
        first = F.greatest(at - (window - 1), F.lit(0))
        return vector_slots(F.slice(toks, (first + 1).cast("int"), (at - first + 1).cast("int")), n_vectors)

    rows = sample_positions(df, key, k, seed, specials, slots=recent)
    slots = rows.select(key, "position", F.posexplode("slots").alias("slot", "vec_id"))
    found = lookup_join(slots, table, "vec_id", [key, "position", "slot"], "inner")

    def mean(vectors: Column) -> Column:
        total = F.aggregate(
            F.slice(vectors, 2, window),
            F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")),
            lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")),
        )
        return F.transform(total, lambda x: x / F.size(vectors))

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("slot", "embedding"))), lambda s: s["embedding"])
    return (
        found.groupBy(key, "position")
        .agg(ordered.alias("vectors"))
        .select(key, "position", mean(F.col("vectors")).alias("activation_vector"))
    )


def extract_vectors(
    df: DataFrame,
    extract: Callable[[Sequence[str], int], Sequence[Sequence[float]]],
    layer: int,
    width: int,
    text: str = "detokenized_text_truncated",
) -> DataFrame:
    """Vectors from a model: ``extract(texts, layer)`` runs on Arrow batches.

    ``extract`` may be an object that loads its model on first use, once per
    worker. Its result must hold one vector of ``width`` per text.
    """
    names = df.columns
    out = df.withColumn("activation_vector", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = list(extract(batch[text].tolist(), layer))
            if len(vectors) != len(batch) or any(len(v) != width for v in vectors):
                raise ValueError("the extractor must return one vector of the stated width per text")
            yield batch[names].assign(activation_vector=[np.asarray(v, dtype=np.float32) for v in vectors])

    return df.mapInPandas(run, out)


def pick_marker(df: DataFrame, text: str = "text", first: int = fx.MARKER_FIRST, last: int = fx.MARKER_LAST) -> DataFrame:
    """First code point of a range that no text of the corpus uses.

    Only characters of the range leave the scan, so at most ``last - first + 1``
    distinct values are compared.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"[\\x{{{first:X}}}-\\x{{{last:X}}}]"), F.lit(0))
    used = df.select(F.explode(found).alias("marker")).distinct()
    code = F.lpad(F.hex("id"), 4, "0")
    usable = df.sparkSession.range(first, last + 1).select(
        F.col("id").alias("code_point"), F.decode(F.unhex(code), "UTF-16BE").alias("marker")
    )
    none_left = F.raise_error(F.lit("every character of the range is in the corpus"))
    return (
        usable.join(used, "marker", "left_anti")
        .agg(F.min(F.struct("code_point", "marker")).alias("m"))
        .select(F.coalesce("m.code_point", none_left.cast("bigint")).alias("code_point"), "m.marker")
    )


def embed_tokens(df: DataFrame, table: DataFrame, n_vectors: int, key: Sequence[str], scale: float = 1.0) -> DataFrame:
    """One row per token with its scaled table vector."""
    slots = df.select(*key, F.posexplode(vector_slots(F.col("tokens"), n_vectors)).alias("position", "vec_id"))
    if scale != 1.0:
        scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
        table = table.withColumn("embedding", scaled)
    return lookup_join(slots, table, "vec_id", [*key, "position"], "inner")


def vectors_in_order(
    sites: DataFrame, vectors: DataFrame, site_order: Sequence[str], vector_order: Sequence[str], vector: str = "vector"
) -> DataFrame:
    """Sites and vectors paired by order, the first site with the first vector.

    As many vectors as sites are needed; any other number means that templates
    or tokens have drifted apart.
    """
    numbered = global_index(sites, *site_order, out="_nth")
    # Only the order columns are sorted and written; the vectors join by them.
    given = global_index(vectors.select(*vector_order), *vector_order, out="_nth")
    n_sites, n_vectors = numbered.count(), given.count()
    if n_sites != n_vectors:
        raise ValueError(f"{n_sites} marker sites for {n_vectors} vectors")
    places = given.select("_nth", *[F.col(c).alias(f"_v_{c}") for c in vector_order])
    wide = vectors.select(*[F.col(c).alias(f"_v_{c}") for c in vector_order], vector)
    keys = [f"_v_{c}" for c in vector_order]
    return numbered.join(places, "_nth").join(wide, keys).drop("_nth", *keys)


def splice_vectors(embedded: DataFrame, sites: DataFrame, key: Sequence[str]) -> DataFrame:
    """Embedded tokens with the row's own vector at its marker sites.

    ``sites`` holds key, position and vector.
    """
    at = [*key, "position"]
    joined = embedded.join(sites.withColumnRenamed("vector", "_vector"), at, "left")
    own = F.col("_vector").cast(embedded.schema["embedding"].dataType)
    return joined.withColumn("embedding", F.coalesce(own, "embedding")).drop("_vector")

"""Keys, ids, paths and option maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vectext import fixed_values as fx


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def keyed_hash(seed: int | str, *parts: Column | str) -> Column:
    """SHA-256 hex of ``seed|part|part``: the same value in any layout or run."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *texts), 256)


def hash_number(digest: Column, digits: int = 15) -> Column:
    """Leading hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def slice_text(start: Column, length: Column) -> Column:
    return F.concat(
        F.lit("{'start': "), start.cast("string"), F.lit(", 'length': "), length.cast("string"), F.lit("}")
    )


def dataset_id(model: Column, layer: Column, corpus: Column, start: Column, length: Column) -> Column:
    """Id of a base table: model tag, layer and a short hash of its extraction."""
    digest = F.sha2(
        F.concat_ws("|", model, layer.cast("string"), corpus, slice_text(start, length)), 256
    )
    tag = F.substring_index(model, "/", -1)
    return F.concat(
        F.lit("base_"), tag, F.lit("_L"), layer.cast("string"), F.lit("_"), F.substring(digest, 1, 8)
    )


def explained_id(base_id: Column) -> Column:
    return F.concat(base_id, F.lit("__explained"))


def split_id(base_id: Column, split: Column) -> Column:
    return F.concat(base_id, F.lit("__"), split, F.lit("_raw"))


def training_id(stage: Column, base_id: Column) -> Column:
    return F.concat(stage, F.lit("_"), F.regexp_replace(base_id, "^base_", ""))


def shuffled_id(any_id: Column, seed: int) -> Column:
    return F.concat(any_id, F.lit(f"__shuf{seed}"))


def permuted_id(any_id: Column, seed: int) -> Column:
    return F.concat(any_id, F.lit(f"__shuf_activations{seed}"))


def corpus_doc_id(corpus: Column, split: Column, position: Column) -> Column:
    return F.concat_ws(":", corpus, split, position.cast("string"))


def path_base(path: Column) -> Column:
    """Path without a trailing ``@[start:end]`` slice."""
    return F.substring_index(path, "@[", 1)


def path_slice(path: Column) -> tuple[Column, Column]:
    """Start and end of the slice; null where absent or left open."""
    pattern = r"@\[(\d*):(\d*)\]$"
    return tuple(F.regexp_extract(path, pattern, i).try_cast("bigint") for i in (1, 2))


def manifest_path(path: Column, suffix: str = ".manifest.json") -> Column:
    return F.concat(path_base(path), F.lit(suffix))


def manifest_source(explicit: Column, model: Column, dataset: Column) -> Column:
    """Where settings come from: explicit, then the model, then the dataset."""
    return F.coalesce(explicit, model, dataset, F.raise_error(F.lit("no manifest source")).cast("string"))


def source_label(
    doc_id: Column,
    labels: Sequence[tuple[str, str]] = tuple(fx.SOURCE_LABELS),
    other: str = fx.SOURCE_OTHER,
) -> Column:
    label = F.lit(other)
    for part, name in reversed(labels):
        label = F.when(doc_id.contains(part), name).otherwise(label)
    return label


def parse_options(text: Column) -> Column:
    """JSON options as a map of texts; no options where the text is null or empty."""
    none = F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(F.from_json(text, "map<string,string>"))


def redact(options: Column) -> Column:
    """Options whose name does not look like a secret."""
    return F.map_filter(options, lambda k, v: ~F.lower(k).contains("key"))


def rename_keys(values: Column, names: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(values, lambda k, v: F.coalesce(F.try_element_at(table, k), k))


def drop_keys(values: Column, names: Sequence[str]) -> Column:
    return F.map_filter(values, lambda k, v: ~k.isin(list(names)))


def released(values: Column, base: str, corpus: str) -> Column:
    """Entries of a manifest as they are published.

    The role's value and the names of entries take their public form, base and
    parents name the public model, training data the public corpus, and entries
    of the run itself are dropped.
    """
    roles = F.create_map(*[F.lit(x) for pair in fx.RELEASED_ROLES.items() for x in pair])
    role = F.try_element_at(values, F.lit("role"))
    public = F.create_map(
        F.lit("role"), F.coalesce(F.try_element_at(roles, role), role), F.lit("base_checkpoint"), F.lit(base),
        F.lit("parent_checkpoints"), F.lit(base), F.lit("trained_on"), F.lit(corpus),
    )
    rest = drop_keys(values, [*fx.RELEASED_DROPS, "role", "base_checkpoint", "parent_checkpoints", "trained_on"])
    return F.map_concat(rename_keys(rest, fx.RELEASED_ROLES), F.map_filter(public, lambda k, v: v.isNotNull()))


def has_forbidden(text: Column, patterns: Sequence[str]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | low.contains(pattern.lower())
    return hit

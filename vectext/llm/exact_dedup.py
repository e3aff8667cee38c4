"""Exact duplicates: groups by a 128-bit content hash, with bytes compared.

Built from DataFrame functions only. Rows are grouped by the MD5 of their text
*and* the text itself, so equal hashes of different texts stay apart: the bytes
decide. Copies are combined on the map side, hence a text that fills a third of
the table reaches the shuffle once per input split. What is joined back to the
rows is the hash alone; only if some hash has more than one text, a collision,
are the texts of such hashes read again and joined by their bytes.

Nulls and empties: a null text counts as empty; a null id takes part, and loses
to any id. Rows repeated in id and text give as many rows, of which one at most
is kept. Other columns of the input are never touched, whatever their names. Texts of any
length are hashed and compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from vectext.llm.streams import free_name, text_of
from vectext.session import cut_lineage


COLUMNS = ["id", "keep_id", "group_size", "text_sha256", "copies"]


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_classes(rows: DataFrame, largest: bool) -> DataFrame:
    """One row per distinct text of (hash, text, id): its keeper and its size."""
    best = F.max("id") if largest else F.min("id")
    return rows.groupBy("hash", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))


def duplicate_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", hash_of=content_hash
) -> DataFrame:
    """Every row's keeper: ``id, keep_id, group_size, kept, text_sha256``, dropped rows included.

    ``keep`` names the id that stays of equal texts, ``smallest`` or ``largest``.
    """
    largest = check_keep(keep)
    whole = df.select(F.col(id).alias("id"), text_of(text).alias("text")).withColumn("hash", hash_of(F.col("text")))
    classes = text_classes(whole, largest)
    # Written once: the texts are shuffled for this table and for nothing else.
    per_hash = cut_lineage(classes.groupBy("hash").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    ))
    # Repeated rows (same id, same text) travel as one row with a count.
    narrow = (
        whole.select("id", "hash", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("id", "hash", "text_sha256").agg(F.count("*").alias("copies"))
    )
    rows = narrow.join(per_hash.where("texts = 1"), "hash").select(*COLUMNS)
    clashing = per_hash.where("texts > 1").select("hash")
    if not clashing.isEmpty():
        collided = (
            whole.join(clashing, "hash", "left_semi")
            .groupBy("id", "hash", "text").agg(F.count("*").alias("copies"))
            .join(classes, ["hash", "text"])
            .withColumn("text_sha256", F.sha2("text", 256))
        )
        rows = rows.unionByName(collided.select(*COLUMNS))
    return rows.select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    ).select(
        F.col("id").alias(id), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", hash_of=content_hash
) -> DataFrame:
    """The kept rows, with all their columns.

    Whole rows are compared by (id, other columns in their order), so rows that
    repeat an id have a defined winner as well; a column that has no order, such as
    a map, is compared by its JSON text. One shuffle of each distinct
    text per input split; nothing is joined back.
    """
    largest = check_keep(keep)
    hash_name, key, row = (free_name(df, s) for s in ("_hash", "_key", "_row"))
    rest = [c for c in df.columns if c not in (id, text)]
    # A null id loses: it is the largest of "smallest" and the smallest of "largest".
    known = F.col(id).isNotNull() if largest else F.col(id).isNull()
    unordered = {f.name for f in df.schema.fields if f.name in rest and not has_order(f.dataType)}

    def whole_row(value: Callable[[str], Column]) -> Column:
        return F.struct(known.alias("known"), F.col(id), *[value(c).alias(c) for c in rest], F.col(text).isNull().alias("null"))

    order, best = whole_row(F.col), F.max if largest else F.min
    if unordered:
        by = whole_row(lambda c: F.to_json(F.struct(F.col(c))) if c in unordered else F.col(c))
        best = (lambda row: F.max_by(row, by)) if largest else (lambda row: F.min_by(row, by))
    picked = df.withColumn(key, text_of(text)).withColumn(hash_name, hash_of(F.col(key)))
    picked = picked.groupBy(hash_name, key).agg(best(order).alias(row))
    original = F.when(~F.col(row)["null"], F.col(key))
    return picked.select(*[
        (original if c == text else F.col(row)[c]).alias(c) for c in df.columns
    ])


def has_order(kind: DataType) -> bool:
    """Whether values of a type can be compared: not if a map or a variant is in it."""
    if isinstance(kind, StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return has_order(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def check_keep(keep: str) -> bool:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    return keep == "largest"

"""Exact duplicates against a plain grouping by text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vectext.llm import exact_dedup

ROWS = [
    (1, "a", "x"), (2, "a", "y"), (3, "", "x"), (4, None, None), (5, "b", "x"), (None, "b", "x"), (None, None, "z"),
    (6, "c" * 300_000, "x"), (7, "c" * 300_000, "x"), (5, "b", "x"), (8, " a", "x"), (9, "A", "x"), (None, "alone", "x"),
]
SCHEMA = "doc_id bigint, text string, hash string"


def expected(rows, keep):
    """Sorted (id, keeper, size, kept, sha) by a dictionary of texts."""
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keeper = (max if keep == "largest" else min)(known) if known else None
        seen = set()
        for i in ids:
            out.append((i, keeper, len(ids), i == keeper and i not in seen, hashlib.sha256(text.encode()).hexdigest()))
            seen.add(i)
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("clash", [False, True])
def test_groups(spark, keep, clash):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    # With one hash for all texts only their bytes tell them apart.
    hash_of = (lambda text: F.lit(b"same")) if clash else exact_dedup.content_hash
    got = exact_dedup.duplicate_groups(df, keep=keep, hash_of=hash_of).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS, keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("clash", [False, True])
def test_kept_rows(spark, keep, clash):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("_row", F.lit(1)).withColumn("_hash", F.lit("h"))
    hash_of = (lambda text: F.lit(b"same")) if clash else exact_dedup.content_hash
    got = exact_dedup.drop_duplicates(df, keep=keep, hash_of=hash_of)
    assert got.columns == df.columns
    rows = got.collect()
    assert len({r["text"] or "" for r in rows}) == len(rows) == len({t or "" for _, t, _ in ROWS})
    keepers = {t or "": k for (_, t, _), k in zip(ROWS, [None] * len(ROWS))}
    for doc_id, keeper, _, _, sha in expected(ROWS, keep):
        keepers[sha] = keeper
    assert all(r["doc_id"] == keepers[hashlib.sha256((r["text"] or "").encode()).hexdigest()] for r in rows)
    assert all(tuple(r)[:3] in ROWS for r in rows)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_columns_without_an_order(spark, keep):
    marks = F.create_map(F.lit("k"), F.col("n"))
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (2, "a", 6), (3, "b", 1), (None, "b", 2)], "doc_id bigint, text string, n int")
    df = df.withColumn("marks", marks).withColumn("nested", F.array(F.struct(marks.alias("m")))).drop("n")
    rows = exact_dedup.drop_duplicates(df, keep=keep).collect()
    got = sorted((r["text"], r["doc_id"], r["marks"]["k"], r["nested"][0]["m"]["k"]) for r in rows)
    assert got == ([("a", 1, 5, 5), ("b", 3, 1, 1)] if keep == "smallest" else [("a", 2, 6, 6), ("b", 3, 1, 1)])


def test_hot_text_and_empty_table(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.duplicate_groups(df, keep="largest").where("group_size > 1")
    assert got.agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first() == (1000, 2997, 2997, 1)
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.duplicate_groups(none, keep="any")


def test_native(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for made in (exact_dedup.duplicate_groups(df), exact_dedup.drop_duplicates(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan

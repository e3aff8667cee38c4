"""Jobs from stored tables to stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from vectext.__main__ import main, parse, read_config
from vectext.functions.text import QualityRules
from vectext.operators import build as bd
from vectext.plans import jobs, table_jobs as tj
from vectext.sources import manifest as ms, tables as tb

CONFIG = {
    "base_model": "org/m", "layer_index": 2, "width": 2, "base": {"positions_per_doc": 3},
    "corpus": {"name": "c", "start": 0, "length": 10},
}


def config(start, length):
    return {**CONFIG, "corpus": {"name": "c", "start": start, "length": length}}


def write_base(spark, path, start, length, made=None):
    rows = spark.range(start, start + length).select(
        (F.col("id") + 51).alias("n_raw_tokens"), F.concat(F.lit("text "), "id").alias("detokenized_text_truncated"),
        F.lit(2).cast("bigint").alias("activation_layer"), F.concat(F.lit("c:train:"), "id").alias("doc_id"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("activation_vector"),
    )
    made = made or config(start, length)
    jobs.publish(rows, path, made, jobs.base_id(made), "base", F.array().cast("array<string>"))


def note(spark, path):
    return ms.read_manifest(spark, path).first()


def test_merge_tables(spark, tmp_path):
    paths = [f"{tmp_path}/b", f"{tmp_path}/a"]
    write_base(spark, paths[0], 6, 4)
    write_base(spark, paths[1], 0, 6)
    tj.merge_tables(spark, paths, f"{tmp_path}/all")
    write_base(spark, f"{tmp_path}/serial", 0, 10)
    merged, serial = note(spark, f"{tmp_path}/all"), note(spark, f"{tmp_path}/serial")
    assert merged["dataset_id"] == serial["dataset_id"] and merged["extraction"] == serial["extraction"]
    assert merged["row_count"] == 10 and spark.read.parquet(f"{tmp_path}/all").count() == 10
    assert merged["parent_datasets"] == [note(spark, paths[1])["dataset_id"], note(spark, paths[0])["dataset_id"]]
    write_base(spark, f"{tmp_path}/far", 11, 2)
    with pytest.raises(ValueError, match="not contiguous"):
        tj.merge_tables(spark, [*paths, f"{tmp_path}/far"], f"{tmp_path}/none")
    write_base(spark, f"{tmp_path}/odd", 10, 2, {**config(10, 2), "layer_index": 3})
    with pytest.raises(ValueError, match="differ in layer_index"):
        tj.merge_tables(spark, [*paths, f"{tmp_path}/odd"], f"{tmp_path}/none")


def test_reuse_recover_shuffle_permute(spark, tmp_path):
    raw, prior = f"{tmp_path}/raw", f"{tmp_path}/prior"
    write_base(spark, raw, 0, 40)
    explained = spark.read.parquet(raw).withColumn("api_explanation", F.concat(F.lit("one\n\n"), "doc_id"))
    tb.write_table(bd.build_av(explained), prior)
    tb.write_table(bd.build_ar(explained), f"{tmp_path}/prior_ar")
    want = sorted((r["doc_id"], r["api_explanation"]) for r in explained.collect())
    for source in (prior, f"{tmp_path}/prior_ar"):
        out = f"{source}_reused"
        tj.reuse_table(spark, raw, source, out)
        assert sorted((r["doc_id"], r["api_explanation"]) for r in spark.read.parquet(out).collect()) == want
        made = note(spark, out)
        assert made["dataset_id"] == note(spark, raw)["dataset_id"] + "__explained" and made["row_count"] == 40
        assert made["api_summaries"]["model"] == f"joined-from:{source}"
    for path in tj.recover_tables(spark, [prior, f"{tmp_path}/prior_ar"], f"{tmp_path}/cache"):
        assert spark.read.parquet(path).columns == ["detokenized_text_truncated", "api_explanation"]
        assert spark.read.parquet(path).count() == 40

    tj.shuffle_table(spark, raw, f"{tmp_path}/shuf", 7)
    assert note(spark, f"{tmp_path}/shuf")["dataset_id"].endswith("__shuf7")
    before, after = spark.read.parquet(raw), spark.read.parquet(f"{tmp_path}/shuf")
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in before.collect())

    tj.permute_table(spark, raw, f"{tmp_path}/perm", 7)
    assert note(spark, f"{tmp_path}/perm")["dataset_id"].endswith("__shuf_activations7")
    moved = {r["doc_id"]: r["activation_vector"][0] for r in spark.read.parquet(f"{tmp_path}/perm").collect()}
    kept = {r["doc_id"]: r["activation_vector"][0] for r in before.collect()}
    assert sorted(moved.values()) == sorted(kept.values()) and moved != kept

    assert tj.check_vectors(spark, raw, f"{tmp_path}/checked").count() == 40
    narrow = before.withColumn("activation_vector", F.slice("activation_vector", 1, 1))
    jobs.publish(narrow, f"{tmp_path}/narrow", CONFIG, F.lit("base_x"), "base", F.array().cast("array<string>"))
    with pytest.raises(Exception, match="not 2 finite values"):
        tj.check_vectors(spark, f"{tmp_path}/narrow", f"{tmp_path}/none")


def test_filter_corpus(spark, tmp_path):
    texts = [f"{'a b c ' * 3}{i // 2}" for i in range(10)]
    rows = [(t, str(1.0 if i != 4 else 0.1)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "content string, score string").coalesce(1).write.parquet(f"{tmp_path}/in")
    rules = QualityRules(min_chars=5, min_words=3)
    tj.filter_corpus(spark, [f"{tmp_path}/in"], f"{tmp_path}/out", 3, rules=rules)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("source_row").collect()
    assert [(r["source_row"], r["score"]) for r in got] == [(0, "1.0000"), (2, "1.0000"), (5, "1.0000")]
    with pytest.raises(ValueError, match="only 5 of 9"):
        tj.filter_corpus(spark, [f"{tmp_path}/in"], f"{tmp_path}/none", 9, rules=rules)


def test_read_config(spark, tmp_path):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"a": {"b": 1}}, indent=1))
    assert read_config(spark, str(path)) == {"a": {"b": 1}}


def test_command_line(spark, tmp_path, capsys):
    raw = f"{tmp_path}/raw"
    write_base(spark, raw, 0, 30)
    main(["shuffle", "--input", raw, "--output", f"{tmp_path}/shuf", "--seed", "3"])
    assert note(spark, f"{tmp_path}/shuf")["dataset_id"].endswith("__shuf3")
    main(["permute", "--input", raw, "--output", f"{tmp_path}/perm"])
    main(["check", "--input", raw, "--output", f"{tmp_path}/checked"])
    explained = spark.read.parquet(raw).withColumn("api_explanation", F.lit("one\n\ntwo"))
    tb.write_table(bd.build_av(explained), f"{tmp_path}/prior")
    main(["reuse", "--input", raw, "--prior", f"{tmp_path}/prior", "--output", f"{tmp_path}/reused", "--min-share", "1"])
    main(["recover", "--inputs", f"{tmp_path}/prior", "--output", f"{tmp_path}/cache"])
    write_base(spark, f"{tmp_path}/more", 30, 5)
    main(["merge", "--inputs", raw, f"{tmp_path}/more", "--output", f"{tmp_path}/all"])
    assert [spark.read.parquet(f"{tmp_path}/{p}").count() for p in ("perm", "checked", "reused", "cache/prior_explained", "all")] == [30, 30, 30, 30, 35]
    assert f"{tmp_path}/all" in capsys.readouterr().out
    spark.createDataFrame([("word " * 400, "1.0")], "content string, score string").write.parquet(f"{tmp_path}/corpus")
    main(["filter", "--inputs", f"{tmp_path}/corpus", "--output", f"{tmp_path}/clean", "--chars", "0"])
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 1
    assert parse(["--config", "a.json"]).config == "a.json" and parse(["job", "--config", "b"]).config == "b"

"""Scans, sinks, guards, manifests and keys."""

import glob
import hashlib
import json
import os
import threading

import pyarrow.parquet as pq
import pytest
from conftest import fails
from pyspark.sql import functions as F

from vectext import fixed_values as fx
from vectext.functions import keys as ky
from vectext.operators import manifests as mf
from plugins import piece_ids
from vectext.plans import inputs as ins, job_queries as jq, jobs
from vectext.sources import manifest as ms, tables as tb

X = F.col("x")


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


# -------------------------------------------------------------------- scans, sinks


def write_files(spark, folder, sizes):
    for number, size in enumerate(sizes):
        rows = [(f"f{number} r{i}", None if i % 2 else str(i / 10)) for i in range(size)]
        spark.createDataFrame(rows, "content string, score string").coalesce(1).write.parquet(f"{folder}/part{number}")


def test_read_corpus(spark, tmp_path):
    write_files(spark, tmp_path, [3, 2])
    df = tb.read_corpus(spark, f"{tmp_path}/part*", "content", "score")
    assert df.columns == ["content", "score", "source_file", "source_row"]
    rows = {r["content"]: r for r in df.collect()}
    assert len(rows) == 5
    for text, row in rows.items():
        number, at = text.split()
        assert f"part{number[1:]}/" in row["source_file"] and row["source_row"] == int(at[1:])
    assert tb.read_corpus(spark, f"{tmp_path}/part0", "content", "missing").columns[:2] == ["content", "source_file"]
    spark.createDataFrame([("bare",)], "content string").write.parquet(f"{tmp_path}/part9")
    mixed = tb.read_corpus(spark, [f"{tmp_path}/part0", f"{tmp_path}/part9"], "content", "score", merge_schema=True)
    assert {r["content"]: r["score"] for r in mixed.collect()} == {"f0 r0": "0.0", "f0 r1": None, "f0 r2": "0.2", "bare": None}
    with pytest.raises(ValueError, match="available: content, score"):
        tb.read_corpus(spark, f"{tmp_path}/part0", "text")


def test_corpus_reads_only_its_columns(spark, tmp_path):
    write_files(spark, tmp_path, [3])
    plan = tb.read_corpus(spark, f"{tmp_path}/part0", "content")._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "content:string" in read and "score" not in read


def test_slice(spark):
    df = spark.range(10).withColumnRenamed("id", "row_index")
    assert sorted(r[0] for r in tb.read_slice(df, 3, 4).collect()) == [3, 4, 5, 6]
    with pytest.raises(ValueError, match="requested, 2 found"):
        tb.read_slice(df, 8, 4)


def test_ingest(spark, tmp_path):
    path = f"{tmp_path}/d"
    df = spark.range(60).select(F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"))
    df.repartition(3).write.partitionBy("split").parquet(path)
    whole = tb.ingest_slice(spark, path, "train", 0, 40)
    part = tb.ingest_slice(spark, path, "train", 10, 5)
    want = {r["row_index"]: r["text"] for r in whole.collect()}
    assert sorted(want) == list(range(40)) and len(set(want.values())) == 40
    assert {r["row_index"]: r["text"] for r in part.collect()} == {i: want[i] for i in range(10, 15)}
    with pytest.raises(ValueError, match="test, train"):
        tb.ingest_slice(spark, path, "dev", 0, 1)
    with pytest.raises(ValueError, match="missing columns"):
        tb.ingest_slice(spark, path, "train", 0, 1, text="content")
    with pytest.raises(ValueError, match="found"):
        tb.ingest_slice(spark, path, "test", 0, 21)


def test_bounded_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.write_table(spark.range(250).coalesce(1), path, rows_per_file=100)
    sizes = sorted(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path}/*.parquet"))
    assert sizes == [50, 100, 100]
    assert os.path.exists(f"{path}/_SUCCESS")
    with pytest.raises(Exception, match="already exists"):
        tb.write_table(spark.range(1), path)


def test_failed_write_publishes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("boom")).cast("bigint")).alias("v"))
    with pytest.raises(Exception, match="boom"):
        tb.write_table(bad, path)
    assert not glob.glob(f"{path}/*.parquet") and not os.path.exists(f"{path}/_SUCCESS")


def test_splits_in_one_pass(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.range(30).withColumn("split", F.when(F.col("id") < 10, "av_sft").otherwise("rl"))
    tb.write_splits(df, path)
    assert sorted(os.path.basename(p) for p in glob.glob(f"{path}/split=*")) == ["split=av_sft", "split=rl"]
    back = spark.read.parquet(path)
    assert back.where("split = 'av_sft'").count() == 10 and back.count() == 30


def test_rejects_as_json_lines(spark, tmp_path):
    path = f"{tmp_path}/r"
    tb.write_rejects(spark.createDataFrame([(1, None, "ü")], "a int, b string, c string"), path)
    lines = [json.loads(line) for f in glob.glob(f"{path}/*.json") for line in open(f, encoding="utf8")]
    assert lines == [{"a": 1, "b": None, "c": "ü"}]


def test_guards(spark):
    with pytest.raises(ValueError, match="nothing left"):
        tb.require_rows(spark.range(0), "nothing left")
    assert tb.require_rows(spark.range(1), "x").count() == 1
    assert tb.union_shards(spark.range(2), spark.range(3)).count() == 5


def test_ingest_of_files_that_mix_splits(spark, tmp_path):
    rows = [(f"t{i}", "train" if i % 2 else "test") for i in range(40)]
    for part in range(2):
        spark.createDataFrame(rows[20 * part:20 * part + 20], "text string, split string").coalesce(1).write.parquet(f"{tmp_path}/in/f={part}")
    got = tb.ingest_slice(spark, f"{tmp_path}/in", "train", 0, 20).orderBy("row_index").collect()
    assert [(r["row_index"], r["text"]) for r in got] == [(k, f"t{2 * k + 1}") for k in range(20)]
    part = tb.ingest_slice(spark, f"{tmp_path}/in", "train", 5, 10).orderBy("row_index").collect()
    assert [(r["row_index"], r["text"]) for r in part] == [(k, f"t{2 * k + 1}") for k in range(5, 15)]
    with pytest.raises(ValueError, match="requested"):
        tb.ingest_slice(spark, f"{tmp_path}/in", "train", 15, 10)
    with pytest.raises(ValueError, match="test, train"):
        tb.ingest_slice(spark, f"{tmp_path}/in", "none", 0, 1)


# ---------------------------------------------------------------------------- keys


def test_ids(spark):
    row = spark.range(1).select(
        ky.dataset_id(F.lit("org/model-a"), F.lit(20), F.lit("corpus"), F.lit(0), F.lit(10)).alias("base")
    ).first()
    digest = hashlib.sha256(b"org/model-a|20|corpus|" + str({"start": 0, "length": 10}).encode()).hexdigest()[:8]
    assert row["base"] == f"base_model-a_L20_{digest}"
    made = values(spark, ["base_m_L2_x"], ky.shuffled_id(ky.training_id(F.lit("rl"), ky.explained_id(X)), 7))
    assert made == ["rl_m_L2_x__explained__shuf7"]
    assert values(spark, ["a"], ky.permuted_id(ky.split_id(X, F.lit("rl")), 1)) == ["a__rl_raw__shuf_activations1"]
    assert values(spark, ["c"], ky.corpus_doc_id(X, F.lit("train"), F.lit(3))) == ["c:train:3"]


def test_paths(spark):
    paths = ["a.parquet", "a.parquet@[0:10]", "a.parquet@[:5]", "a@[3:]"]
    assert values(spark, paths, ky.path_base(X)) == ["a.parquet", "a.parquet", "a.parquet", "a"]
    first, last = ky.path_slice(X)
    assert values(spark, paths, first) == [None, 0, None, 3] and values(spark, paths, last) == [None, 10, 5, None]
    assert values(spark, paths, ky.manifest_path(X, ".m"))[1] == "a.parquet.m"


def test_manifest_source(spark):
    null = F.lit(None).cast("string")
    assert values(spark, ["d"], ky.manifest_source(null, null, X)) == ["d"]
    assert values(spark, ["d"], ky.manifest_source(null, F.lit("m"), X)) == ["m"]
    assert values(spark, ["d"], ky.manifest_source(F.lit("e"), F.lit("m"), X)) == ["e"]
    fails(spark.range(1).select(ky.manifest_source(null, null, null)), "no manifest source")


def test_parse_options(spark):
    got = values(spark, ['{"a": 1, "b": "x"}', "", None], ky.parse_options(X))
    assert got == [{"a": "1", "b": "x"}, {}, {}]


def test_option_maps(spark):
    items = [{"actor": "a", "rollout_id": "1", "api_Key": "s"}]
    kind = "map<string,string>"
    assert values(spark, items, ky.redact(X), kind) == [{"actor": "a", "rollout_id": "1"}]
    assert values(spark, items, ky.rename_keys(X, fx.RELEASED_ROLES), kind) == [{"av": "a", "rollout_id": "1", "api_Key": "s"}]
    assert values(spark, items, ky.drop_keys(X, ["rollout_id"]), kind) == [{"actor": "a", "api_Key": "s"}]


def test_labels_and_scan(spark):
    from vectext.operators.report import require_none_forbidden

    texts = spark.createDataFrame([("fine",), ("see GS://x",)], "t string")
    fails(require_none_forbidden(texts, "t"), "forbidden pattern")
    assert require_none_forbidden(texts.limit(1), "t").count() == 1
    assert values(spark, ["a WildChat Ultra-FineWeb", "Ultra-FineWeb", "z"], ky.source_label(X)) == ["WildChat", "UFW", "other"]
    assert values(spark, ["see S3://x", "fine"], ky.has_forbidden(X, fx.PRIVATE_PATTERNS)) == [True, False]


# ----------------------------------------------------------------------- manifests


def manifest(spark, stage="base", **extra):
    df = spark.range(1).select(
        F.lit("base_x").alias("dataset_id"), F.lit(stage).alias("stage"), F.lit(5).cast("bigint").alias("row_count"),
        F.struct(
            F.lit("org/m").alias("base_model"), F.lit(8).cast("bigint").alias("d_model"), F.lit(2).cast("bigint").alias("layer_index"),
            F.lit("none").alias("norm"), F.lit("c").alias("corpus"),
            F.create_map(F.lit("start"), F.lit(0).cast("bigint"), F.lit("length"), F.lit(9).cast("bigint")).alias("corpus_slice"),
            F.lit(5).cast("bigint").alias("positions_per_doc"),
        ).alias("extraction"),
    )
    return df.withColumns(extra) if extra else df


def tokens(suffix=True):
    ids = F.array(F.lit(4).cast("bigint")) if suffix else F.lit(None).cast("array<bigint>")
    one = F.lit(1).cast("bigint")
    return F.struct(
        F.lit("㈀").alias("injection_char"), one.alias("injection_token_id"), one.alias("injection_left_neighbor_id"),
        one.alias("injection_right_neighbor_id"), ids.alias("critic_suffix_ids"),
    )


def templates(*names):
    return F.create_map(*[F.lit(x) for n in names for x in (n, "t")]) if names else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize("stage, tok, tem, want", [
    ("base", None, (), None), ("odd", None, (), "unknown_stage"), ("rl", None, ("actor",), "no_tokens"),
    ("av_sft", True, (), "no_actor_template"), ("av_sft", True, ("actor",), None),
    ("ar_sft", False, ("actor", "critic"), "no_critic_suffix"), ("ar_sft", True, ("actor",), "no_critic_template"),
    ("ar_sft", True, ("actor", "critic"), None),
])
def test_stage_contracts(spark, stage, tok, tem, want):
    field = F.lit(None).cast(ms.TOKENS) if tok is None else tokens(tok)
    full = ms.complete(manifest(spark, stage, tokens=field, prompt_templates=templates(*tem)))
    assert full.select(ms.problem()).first()[0] == want
    if want is not None:
        fails(ms.to_json(full), want)


def test_manifest_round_trip(spark, tmp_path):
    path = f"{tmp_path}/table"
    ms.write_manifest(manifest(spark, "ar_sft", tokens=tokens(), prompt_templates=templates("actor", "critic")), path)
    row = ms.read_manifest(spark, path + "@[0:3]").first()
    assert row["dataset_id"] == "base_x" and row["kind"] == ms.KIND and row["schema_version"] == 1
    assert row["tokens"]["critic_suffix_ids"] == [4] and row["extraction"]["corpus_slice"] == {"start": 0, "length": 9}
    assert row["created_at"].endswith("Z") or row["created_at"].endswith("+00:00")


@pytest.mark.parametrize("text", ['{"kind":"other","schema_version":1}', '{"kind":"vector_text_dataset","schema_version":9}', "{}"])
def test_foreign_manifests(spark, text):
    fails(ms.from_json(spark.createDataFrame([(text,)], "manifest string")), "not a manifest")


def test_only_raw_base_rows_are_built(spark):
    ms.require_raw_base(manifest(spark))
    scaled = manifest(spark).withColumn("extraction", F.col("extraction").withField("norm", F.lit("l2")))
    for bad in (manifest(spark, "rl"), scaled):
        with pytest.raises(ValueError, match="base rows with raw vectors"):
            ms.require_raw_base(bad)


def test_unknown_fields_are_ignored(spark):
    text = '{"kind":"vector_text_dataset","schema_version":1,"dataset_id":"a","new":{"b":1}}'
    assert ms.from_json(spark.createDataFrame([(text,)], "manifest string")).first()["dataset_id"] == "a"


def shards(spark, ranges, **fields):
    df = spark.createDataFrame([(f"s{i}", a, n, n) for i, (a, n) in enumerate(ranges)], "dataset_id string, start bigint, length bigint, row_count bigint")
    for f in mf.AGREEING:
        df = df.withColumn(f, fields.get(f, F.lit("v")))
    return df


@pytest.mark.parametrize("ranges, verdicts", [
    ([(0, 5), (5, 5)], ["ok", "ok"]), ([(5, 5), (0, 5)], ["ok", "ok"]),
    ([(0, 5), (6, 5)], ["gap", "ok"]), ([(0, 6), (5, 5)], ["overlap", "ok"]),
])
def test_contiguity(spark, ranges, verdicts):
    got = mf.shard_contiguity(shards(spark, ranges)).orderBy("start").collect()
    assert [r["verdict"] for r in got] == verdicts


def test_merge(spark):
    row = mf.merge_manifests(shards(spark, [(5, 5), (0, 5)])).first()
    assert (row["start"], row["length"], row["row_count"], row["parents"], row["contiguous"]) == (0, 10, 10, "s1,s0", True)
    odd = shards(spark, [(0, 5), (5, 5)], norm=F.col("dataset_id"))
    assert mf.merge_manifests(odd).first()["differing_fields"] == "norm"
    tables = [spark.range(5), spark.range(5)]
    assert mf.merge_shards(tables, shards(spark, [(0, 5), (5, 5)])).count() == 10
    for bad, words in ((odd, "differ in norm"), (shards(spark, [(0, 5), (6, 5)]), "not contiguous"), (shards(spark, [(0, 5), (5, 6)]), "in their manifests")):
        with pytest.raises(ValueError, match=words):
            mf.merge_shards(tables, bad)


# ---------------------------------------------------------------------------- jobs


def test_presets():
    got = jobs.preset_config({"model": "gemma27b", "base": {"positions_per_doc": 3}})
    assert got["layer_index"] == 41 and got["base_model"] == "google/gemma-3-27b-it"
    assert got["base"] == {"positions_per_doc": 3, "extractor_options": {"batch_size": 4, "max_length": 4096, "device_map": "cuda:0"}}
    assert jobs.preset_config({"model": "qwen7b", "layer_index": 20})["layer_index"] == 20
    assert jobs.preset_config({"a": 1}) == {"a": 1}
    with pytest.raises(ValueError):
        jobs.preset_config({"model": "other"})


def test_overrides():
    got = jobs.override({"a": {"b": 1}}, ["a.b=2", "a.c.d=x", "e=[1, 2]", "f=true"])
    assert got == {"a": {"b": 2, "c": {"d": "x"}}, "e": [1, 2], "f": True}


def test_load_callable():
    assert jobs.load_callable("json.loads")("1") == 1
    with pytest.raises(AttributeError):
        jobs.load_callable("json.nothing")


def test_whole_job(spark, tmp_path):
    corpus = f"{tmp_path}/corpus"
    texts = [(" ".join(f"w{i}x{j}" for j in range(45 + i)),) for i in range(40)]
    spark.createDataFrame(texts, "text string").coalesce(1).write.parquet(corpus)
    config = {
        "output": f"{tmp_path}/out", "base_model": "org/m", "layer_index": 2, "width": 3,
        "corpus": {"path": corpus, "name": "c", "start": 0, "length": 40},
        "base": {"positions_per_doc": 3, "extractor": "plugins.LengthExtractor"},
        "explain": {"provider": "plugins.EchoProvider", "rows_per_file": 7, "files_per_batch": 2, "chunk_size": 4},
        "build": {"tokenizer": "plugins.piece_ids", "critic_template": "Sum up: {explanation} <summary> now"},
        "shuffle": {"enabled": True, "seed": 7},
    }
    paths = jobs.run_job(spark, config, settings=["base.seed=5"])
    read = lambda name: spark.read.parquet(paths[name])
    base = read("base")
    assert base.columns == ["n_raw_tokens", "detokenized_text_truncated", "activation_layer", "doc_id", "activation_vector"]
    assert base.where("size(activation_vector) <> 3").count() == 0
    splits = spark.read.parquet(paths["splits"])
    assert splits.count() == base.count()
    assert splits.groupBy("doc_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    for stage in fx.TRAINING_STAGES:
        built, shuffled = read(stage), read(f"{stage}_shuffled")
        assert built.count() == shuffled.count() > 0
        note = ms.read_manifest(spark, paths[stage]).first()
        assert note["stage"] == stage and note["row_count"] == built.count()
        note = ms.read_manifest(spark, paths[f"{stage}_shuffled"]).first()
        assert note["dataset_id"].endswith("__shuf7") and len(note["parent_datasets"]) == 1
        assert note["stage"] == stage and (note["tokens"]["critic_suffix_ids"] is not None) == (stage == "ar_sft")
        assert note["tokens"]["injection_token_id"] == piece_ids(note["tokens"]["injection_char"])[0]
        assert note["tokens"]["injection_left_neighbor_id"] == piece_ids("<concept>")[0]
        assert note["prompt_templates"]["critic"].startswith("Sum up")
    assert ms.read_manifest(spark, paths["ar_sft"]).first()["tokens"]["critic_suffix_ids"] == piece_ids("<summary> now")
    assert read("ar_sft").where("prompt like 'Sum up: % <summary> now'").count() == read("ar_sft").count()
    explained, split = read("av_sft_explained"), splits.where("split = 'av_sft'")
    rejected = spark.read.json(paths["av_sft_rejects"])
    assert explained.count() + rejected.count() == split.count()
    # Rows keep their number in the split, whatever batch they came with.
    numbers = rejected.select("global_row", "chunk_start", "row_in_chunk").collect()
    assert len({r["global_row"] for r in numbers}) == len(numbers) > 0 and max(r["global_row"] for r in numbers) < split.count()
    assert all(r["chunk_start"] + r["row_in_chunk"] == r["global_row"] and r["row_in_chunk"] < 4 for r in numbers)
    assert rejected.select("batch").distinct().count() > 1
    # Done batches stay done when the step runs again.
    before = sorted(glob.glob(f"{paths['av_sft_explained']}/batch=*/*.parquet"))
    jobs.run_job(spark, config, ["explain"])
    assert before and sorted(glob.glob(f"{paths['av_sft_explained']}/batch=*/*.parquet")) == before
    # Another run of the same corpus takes every explanation from the first.
    silent = {"provider": "plugins.SilentProvider", "cache_from": [paths["av_sft_explained"], paths["ar_sft_explained"]]}
    other = {**config, "output": f"{tmp_path}/out2", "explain": silent}
    second = jobs.run_job(spark, other, ["base", "split", "explain"], ["base.seed=5"])
    reused = spark.read.parquet(second["av_sft_explained"])
    assert reused.count() == explained.count()
    with pytest.raises(ValueError, match="unknown steps"):
        jobs.run_job(spark, config, ["odd"])
    # Without a tokenizer or given ids no id is made up, and the manifest is refused.
    with pytest.raises(Exception, match="no_marker_id"):
        jobs.run_job(spark, {**config, "build": {}}, ["build"])


def test_batches_of_small_files_stay_few(spark, tmp_path, monkeypatch):
    """The number of batches does not grow with the table while batches are small."""
    monkeypatch.setattr(jobs, "BATCHES", 2)
    corpus = f"{tmp_path}/corpus"
    texts = [(" ".join(f"w{i}x{j}" for j in range(55 + i)),) for i in range(30)]
    spark.createDataFrame(texts, "text string").coalesce(1).write.parquet(corpus)
    config = {
        "output": f"{tmp_path}/out", "base_model": "org/m", "layer_index": 2, "width": 3,
        "corpus": {"path": corpus, "name": "c", "start": 0, "length": 30},
        "base": {"positions_per_doc": 2, "extractor": "plugins.LengthExtractor"},
        "explain": {"provider": "plugins.EchoProvider", "rows_per_file": 2, "files_per_batch": 1, "chunk_size": 2},
    }
    paths = jobs.run_job(spark, config, ["base", "split", "explain"])
    for stage in ("av_sft", "ar_sft"):
        explained, rejected = spark.read.parquet(paths[f"{stage}_explained"]), glob.glob(f"{paths[f'{stage}_rejects']}/batch=*/*.json")
        lost = spark.read.json(paths[f"{stage}_rejects"]).count() if any(os.path.getsize(f) for f in rejected) else 0
        assert explained.count() + lost == jobs.read_split(spark, paths, stage).count() > 4
        assert len(glob.glob(f"{paths[f'{stage}_explained']}/batch=*")) <= 2


def test_ranges_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A table that is written anew goes to as many tasks as its bytes ask for, with the same rows."""
    texts = [(i, f"text {i} " + hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(200)]
    spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert ins.range_count(spark, str(tmp_path), "documents") == 4
    kept = [t for i, t in texts if i % 3][20:100]
    held = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/documents.parquet/*.parquet"))
    for size, files in ((ins.RANGE_BYTES, 4), (held // 8, 8)):
        monkeypatch.setattr(ins, "RANGE_BYTES", size)
        paths = []
        monkeypatch.setattr(jq, "new_shared_path", lambda spark, name: paths.append(f"{tmp_path}/{name}{files}") or paths[-1])
        got = jq.ingest_split(spark, str(tmp_path)).orderBy("row_index").collect()
        assert [tuple(r) for r in got] == [(i, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(kept, 20)]
        assert files <= len(glob.glob(f"{paths[0]}/*.parquet")) <= files + 1


def test_splits_are_explained_side_by_side(spark, tmp_path, monkeypatch):
    """No split waits for the other one; a split that fails leaves the other finished."""
    corpus = f"{tmp_path}/corpus"
    texts = [(" ".join(f"w{i}x{j}" for j in range(55 + i)),) for i in range(20)]
    spark.createDataFrame(texts, "text string").coalesce(1).write.parquet(corpus)
    config = {
        "output": f"{tmp_path}/out", "base_model": "org/m", "layer_index": 2, "width": 3,
        "corpus": {"path": corpus, "name": "c", "start": 0, "length": 20},
        "base": {"positions_per_doc": 2, "extractor": "plugins.LengthExtractor"}, "explain": {"provider": "plugins.EchoProvider"},
    }
    both, start = threading.Barrier(2, timeout=60), jobs.st.explain_batches

    def met(*args):
        both.wait()
        if "ar_sft" in args[2]:
            raise RuntimeError("no connection")
        return start(*args)

    monkeypatch.setattr(jobs.st, "explain_batches", met)
    with pytest.raises(RuntimeError, match="no connection"):
        jobs.run_job(spark, config, ["base", "split", "explain"])
    paths = jobs.table_paths(config["output"])
    assert ms.read_manifest(spark, paths["av_sft_explained"]).first()["row_count"] > 0
    assert not os.path.exists(paths["ar_sft_explained"])
    monkeypatch.undo()
    jobs.run_job(spark, config, ["explain"])
    assert ms.read_manifest(spark, paths["ar_sft_explained"]).first()["row_count"] > 0


def test_batch_files():
    assert jobs.batch_files(10, 2, 150) == 2  # as set
    assert jobs.batch_files(1000, 2, 150) == 63  # a sixteenth
    assert jobs.batch_files(10**7, 2, 150) == 64 * fx.ROWS_PER_FILE // 150  # no more rows than a batch of the defaults
    assert jobs.batch_files(10**7, 64, fx.ROWS_PER_FILE) == 64  # the defaults stay
    assert jobs.batch_files(0, 2, 150) == 2


def test_token_ids_from_a_tokenizer():
    build = {"tokenizer": "plugins.piece_ids", "tokens": {"injection_left_neighbor_id": 5}}
    ids = jobs.token_ids(build, "#", "say <c> # </c> now", "text: {explanation} end of it")
    assert ids["injection_left_neighbor_id"] == 5 and ids["injection_right_neighbor_id"] == piece_ids("</c>")[0]
    assert ids["critic_suffix_ids"] == piece_ids("end of it")
    with pytest.raises(ValueError, match="one token"):
        jobs.token_ids(build, "#", "# comes first", "{explanation}")
    assert jobs.token_ids({}, "#", "a # b", "c") == {}

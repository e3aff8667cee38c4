"""Streams against their batch results."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from vectext.plans import inputs as ins, stream_queries as sq
from vectext.session import CUTS, cut_lineage, drop_cuts, new_shared_path, shared_folder
from vectext.streaming import streams as st
from vectext.streaming.state import first_rows, score_collected


def add_file(spark, folder, number, rows):
    spark.createDataFrame(rows, "text string, n int").coalesce(1).write.parquet(f"{folder}/in{number}")


SCHEMA = "text string, n int"


def test_resume_never_redoes_a_file(spark, tmp_path):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA, files_per_batch=1)
        st.resume_into(arriving.withColumn("done", F.current_timestamp()), out, state).awaitTermination()
        return {r["n"]: r["done"] for r in spark.read.parquet(out).collect()}

    add_file(spark, tmp_path, 1, [("a", 1)])
    add_file(spark, tmp_path, 2, [("b", 2)])
    first = run()
    assert set(first) == {1, 2}
    add_file(spark, tmp_path, 3, [("c", 3)])
    second = run()
    assert set(second) == {1, 2, 3} and all(second[n] == first[n] for n in first)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_score_reads_a_file_or_a_folder(spark, tmp_path, files):
    """The table may be one file or a folder of files of any names."""
    table = f"{tmp_path}/documents.parquet"
    texts = [(i, f"Text {i}", "en", "web", 6) for i in range(20)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if files == 1:
        rows.toPandas().to_parquet(table)
    else:
        rows.repartition(files).write.parquet(table)
    got = {r["final_status"]: r["rows"] for r in sq.stream_score(spark, str(tmp_path)).collect()}
    # Every fifth text has no tags, every ninth is cut off.
    failed = sum(i % 5 == 0 or i % 9 == 0 for i in range(20))
    assert got == {"failed": failed, "completed": 20 - failed}


def test_stream_dedup_equals_batch(spark, tmp_path):
    for i in range(3):
        add_file(spark, tmp_path, i, [(f"Text  {j % 4}", i * 10 + j) for j in range(8)])
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA, files_per_batch=1)
        st.dedup_batches(arriving, out, state, ["n"]).awaitTermination()
        return sorted((r["n"], r["text"]) for r in st.deduped(spark, out, ["n"]).collect())

    assert run() == [(j, f"Text  {j}") for j in range(4)]
    # A row that comes late but before the one kept takes its place; no other row moves.
    add_file(spark, tmp_path, 9, [("TEXT 2", -1), ("text 3", 99), ("new", 7)])
    assert run() == [(-1, "TEXT 2"), (0, "Text  0"), (1, "Text  1"), (3, "Text  3"), (7, "new")]


def test_stream_dedup_of_many_files(spark, tmp_path, monkeypatch):
    """A larger table arrives in more files, in no more batches and with the same result."""
    texts = [(i, f"Text {i % 30}", "en", "web", 7) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    paths = {}
    monkeypatch.setattr(sq, "new_shared_path", lambda spark, name: paths.setdefault(name, f"{tmp_path}/{name}"))
    monkeypatch.setattr(ins, "range_count", lambda *a: 10)
    got = sq.stream_dedup(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(30))
    assert len(glob.glob(f"{paths['arriving']}/*.parquet")) > 4
    assert 1 < len([f for f in os.listdir(f"{paths['dedup-state']}/commits") if f.isdigit()]) <= 4


def test_bounded_dedup(spark, tmp_path):
    out = f"{tmp_path}/out"
    for number, rows in enumerate(([("a", 1), ("a", 2), ("b", 3)], [("a", 50)], [("a", 5000)])):
        add_file(spark, tmp_path, number, rows)
        arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA).withColumn("at", F.timestamp_seconds(F.col("n")))
        st.dedup_batches(arriving, out, f"{tmp_path}/state", ["n"], time="at", delay_seconds=100).awaitTermination()
    # The repeat within the delay is dropped, the one long after is kept beside it.
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 3, 5000]


def test_late_rows_and_restart(spark, tmp_path):
    """Winners whatever the arrival; a row later than the delay is dropped; a new query goes on from the state."""
    out = f"{tmp_path}/out"

    def run(number, rows):
        add_file(spark, tmp_path, number, rows)
        arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA).withColumn("at", F.timestamp_seconds(F.col("n")))
        st.dedup_batches(arriving, out, f"{tmp_path}/state", ["n"], time="at", delay_seconds=100).awaitTermination()
        return sorted((r["text"], r["n"]) for r in spark.read.parquet(out).collect())

    assert run(0, [("a", 500), ("a", 480), ("b", 500), ("b", 300)]) == [("a", 480), ("b", 300), ("b", 500)]
    # The watermark is 400: earlier rows are late, a row before the kept one replaces it.
    assert run(1, [("a", 420), ("c", 10), ("a", 520)]) == [("a", 420), ("a", 480), ("b", 300), ("b", 500)]


def test_dedup_reads_nothing_back(spark, tmp_path):
    """What earlier batches have written may be gone: the state alone decides."""
    out = f"{tmp_path}/out"
    for number, rows in enumerate(([("a", 5), ("b", 6)], [("a", 7), ("b", 1), ("c", 2)])):
        add_file(spark, tmp_path, number, rows)
        arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA)
        first = first_rows(arriving, F.col("text"), ["n"])
        st.score_batches(first, lambda rows: rows, f"{out}{number}", f"{tmp_path}/state").awaitTermination()
    assert sorted((r["text"], r["n"]) for r in spark.read.parquet(f"{out}1").collect()) == [("b", 1), ("c", 2)]


def scored(frame):
    if (frame["n"] == 13).any():
        raise RuntimeError("scorer down")
    return frame.assign(score=frame["n"] * 2.0, size=len(frame))


OUT = "text string, n int, score double, size int"


def collected(spark, tmp_path, rows, wait_seconds):
    """Runs the collecting query until it has written so many rows and seen all files, then stops it."""
    arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA, files_per_batch=1)
    stream, out = score_collected(arriving, scored, OUT, size=4, wait_seconds=wait_seconds), f"{tmp_path}/out"
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # a store a partition
    query, got, since = writer.trigger(processingTime="500 milliseconds").start(), [], time.monotonic()
    try:
        while time.monotonic() - since < 60 and query.exception() is None:
            time.sleep(0.5)
            read = sum(p.numInputRows for p in query.recentProgress)
            got = spark.read.schema(WHOLE).parquet(out).collect() if query.recentProgress else []
            if len(got) >= rows and read:
                break
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert query.exception() is None
    return got


WHOLE = f"{OUT}, lane int, batch bigint, error string"


def test_batches_close_by_size(spark, tmp_path):
    add_file(spark, tmp_path, 0, [("x", k) for k in range(3)])
    # Three wait in the state; a restarted query fills their batch up, and the rest waits again.
    assert collected(spark, tmp_path, 0, 3600) == []
    add_file(spark, tmp_path, 1, [("x", k) for k in range(3, 10)])
    got = collected(spark, tmp_path, 8, 3600)
    assert sorted(r["n"] for r in got) == list(range(8))
    assert {(r["batch"], r["size"]) for r in got} == {(0, 4), (1, 4)} and all(r["score"] == 2 * r["n"] for r in got)
    # A failing scorer marks all rows of its batch, and no other.
    add_file(spark, tmp_path, 2, [(None, 13), ("x", 14)] + [("x", k) for k in range(20, 24)])
    got = collected(spark, tmp_path, 16, 3600)
    by_batch = {b: [r for r in got if r["batch"] == b] for b in (2, 3)}
    assert all(r["error"] == "RuntimeError: scorer down" and r["score"] is None for r in by_batch[2]) and len(by_batch[2]) == 4
    assert {r["n"] for r in by_batch[2]} == {8, 9, 13, 14} and all(r["error"] is None for r in by_batch[3])


def test_batches_close_by_time(spark, tmp_path):
    add_file(spark, tmp_path, 0, [("x", k) for k in range(6)])
    rows = collected(spark, tmp_path, 6, 1)
    assert sorted((r["batch"], r["size"]) for r in rows) == [(0, 4)] * 4 + [(1, 2)] * 2


def test_scored_batches(spark, tmp_path):
    for i in range(3):
        add_file(spark, tmp_path, i, [("x" * i, i)])
    arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA, files_per_batch=2)
    out = f"{tmp_path}/out"
    st.score_batches(arriving, lambda b: b.withColumn("score", F.length("text")), out, f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r["n"], r["score"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]
    assert got.select("batch").distinct().count() == 2


def test_a_failing_batch_fails_the_query(spark, tmp_path):
    add_file(spark, tmp_path, 1, [("a", 1)])
    arriving = st.read_files(spark, f"{tmp_path}/in*", SCHEMA)

    def broken(batch):
        return batch.withColumn("score", F.raise_error(F.lit("scorer down")))

    with pytest.raises(Exception, match="scorer down"):
        st.score_batches(arriving, broken, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert new_shared_path(spark, "a") != new_shared_path(spark, "a")


def test_cut_runs_the_plan_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    cut = cut_lineage(spark.range(50).withColumn("r", F.rand()).mapInPandas(count, "id bigint, r double"))
    assert sorted(cut.collect()) == sorted(cut.collect()) and runs.value == 50


def test_cuts_can_be_dropped(spark):
    kept, before = cut_lineage(spark.range(5)), len(CUTS)
    cut_lineage(spark.range(5))
    gone = CUTS[-1]
    drop_cuts(spark, before)
    assert len(CUTS) == before and kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)

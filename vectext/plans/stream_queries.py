"""Queries that run as streams over the table's files and read the result back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vectext.operators import scoring as sc
from vectext.plans import inputs as ins
from vectext.plans.registry import query
from vectext.session import new_shared_path
from vectext.streaming import streams as st


@query(
    "stream_dedup",
    r"""SELECT doc_id, sha256(text) AS text_sha256 FROM (SELECT *, row_number() OVER (
      PARTITION BY lower(regexp_replace(substr(text, 1, 500), '\s+', ' ', 'g')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def stream_dedup(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # Several files, written in reverse, so that winners arrive late and in other batches.
    files = new_shared_path(spark, "arriving")
    docs.repartitionByRange(ins.range_count(spark, folder, "documents"), F.col("doc_id").desc()).write.parquet(files)
    # Four batches, of one file each while there are no more files.
    count = len(spark.read.schema(docs.schema).parquet(files).inputFiles())
    arriving = st.read_files(spark, files, docs.schema, files_per_batch=max(1, math.ceil(count / 4)))
    path, checkpoint = new_shared_path(spark, "dedup"), new_shared_path(spark, "dedup-state")
    st.dedup_batches(arriving, path, checkpoint, ["doc_id"]).awaitTermination()
    return st.deduped(spark, path, ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    "stream_score",
    f"WITH {ins.GENERATIONS} SELECT final_status, count(*) AS rows FROM judged GROUP BY final_status",
)
def stream_score(spark, folder):
    def score(batch):
        judged = sc.generation_status(ins.as_generations(batch))
        return judged.select("index", "final_status")

    schema = ins.table(spark, folder, "documents").schema
    # The table itself, be it a file or a folder of files of any names.
    arriving = st.read_files(spark, f"{folder}/documents.parquet", schema)
    path, checkpoint = new_shared_path(spark, "scores"), new_shared_path(spark, "scores-state")
    st.score_batches(arriving, score, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).groupBy("final_status").agg(F.count("*").alias("rows"))

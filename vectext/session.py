"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this driver's ``cut_lineage`` has written and not dropped.
CUTS: list[str] = []


def get_session(master: str = "local[*]", app: str = "vectext", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``; unset is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def use_own_folder(spark: SparkSession) -> None:
    """Give a one-machine session without ``spark.checkpoint.dir`` a folder: for tests, benchmarks and the driver.

    On a cluster nothing is set, since a machine-local folder is lost with its
    machine.
    """
    context = spark.sparkContext
    unset = context.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None
    if unset and re.match(r"local(\[|$)", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vectext-"))


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    The plan behind it runs exactly once, later readers see the same rows, and
    a lost executor costs a re-read instead of a re-run.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, "cut")
    CUTS.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``cut_lineage`` has written, from the given one on.

    Call it once the results that read them are written themselves.
    """
    for path in CUTS[since:]:
        table = spark._jvm.org.apache.hadoop.fs.Path(path)
        table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)
    del CUTS[since:]

"""Every registered query against its SQL, run by DuckDB on the same files."""

import os
import re

import pytest

import __spark_entry__ as entry
import compare

FOLDER = os.environ.get("VECTEXT_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window in one task may only run over block, file or shard summaries.
    lone = re.findall(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", plan)
    assert all("sum(_rows" in w or name == "shard_contiguity" for w in lone)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        compare.check(df, con, sql)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["split"] for r in rows] == ["ar_sft", "av_sft", "rl"]
    assert all(r["documents"] > 0 and r["rows"] >= r["documents"] for r in rows)

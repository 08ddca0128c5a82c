"""The driver contract, and plans of the registered queries."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
REST = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


def test_the_rest_does_not_need_the_corpus_operators():
    for p in Path(entry.__file__).parent.glob("cadenza/**/*.py"):
        if "llm" not in p.parts:
            assert "cadenza.llm" not in p.read_text()


def unpartitioned_windows(plan):
    """Windows of a plan that have no partition key, so that one task would read all rows."""
    return re.findall(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan)


def test_unpartitioned_windows_are_seen(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    df = spark.range(9).withColumn("k", F.col("id") % 3)
    show = lambda w: df.withColumn("n", F.row_number().over(w))._jdf.queryExecution().executedPlan().toString()
    assert unpartitioned_windows(show(W.orderBy("id"))) and not unpartitioned_windows(show(W.partitionBy("k").orderBy("id")))


@pytest.mark.parametrize("name", REST)
def test_against_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = entry.queries()[name](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and not unpartitioned_windows(plan)
    rows = got.collect()
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    key = lambda r: tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)
    want = sorted(key(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in res.fetchall())
    assert sorted(key(tuple(r[c] for c in order)) for r in rows) == want

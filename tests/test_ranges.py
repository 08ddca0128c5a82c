"""Files and logs in many ranges give the rows of the whole reader."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import text as X
from cadenza.operators.along import along
from cadenza.sources.ranges import range_lines
from cadenza.sources.settings_files import file_lines


def messy(r, n):
    out = []
    for _ in range(n):
        out.append(r.choice(["TABLE one", "TABLE two", "a\tb\tc", "1\t2\t3", 'x\ty\t"open', 'close"', "mid line", "# note", "", "  ", "-- c", "key = 1 \\", "  more", "1\t2", "é " * r.randrange(9), 'q\t"shut"\tz']))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    top = tmp_path_factory.mktemp("texts")
    (top / "sub dir").mkdir()
    for name, end in (("a.txt", "\n"), ("sub dir/b+c.txt", "\r\n"), ("d.txt", "\n")):
        (top / name).write_bytes((end.join(messy(r, 400)) + (end if name != "d.txt" else "")).encode())
    (top / "empty.txt").write_text("")
    (top / "blank.txt").write_text("\n\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield str(top)
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(str, df.collect()))


def test_lines(spark, folder):
    got = range_lines(spark, folder)
    assert got.select("file", "part").distinct().count() > 30
    assert rows(got.select("file", F.col("linenum").cast("int"), "line")) == rows(file_lines(spark, folder).select("file", "linenum", "line"))
    assert "Exchange hashpartitioning" not in got.select("line")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_text_operators(spark, folder):
    cut, whole = range_lines(spark, folder), file_lines(spark, folder).withColumn("linenum", F.col("linenum").cast("long"))
    for op in (lambda d, p: X.logical_lines(d, r"^\w+ =", file="file", part=p), lambda d, p: X.section_fill(d, "^TABLE", "file", p).drop("part"), lambda d, p: X.multi_tables(d, file="file", part=p)):
        want = rows(op(whole, None))
        assert rows(op(cut, "part")) == want and len(want) > 20


def test_running_values(spark):
    """Every kind, over ranges of one row and many, with nulls and several keys."""
    r = random.Random(4)
    data = [(r.choice(["k", "l", None]), r.randrange(12), i, r.choice([None, -2, 3, 5])) for i in range(300)]
    data = [(k, i // 37 if k == "k" else i // 5, i, v) for k, _, i, v in data]
    df = spark.createDataFrame(data, "k string, part int, n int, v int")
    kinds = ["last", "last_before", "sum", "sum_before", "min", "min_before", "max", "max_before", "lag", "lead"]
    run = {f"o_{x}": (x, "v") for x in kinds}
    assert rows(along(df, ["k"], "part", "n", **run)) == rows(along(df, ["k"], None, "n", **run))

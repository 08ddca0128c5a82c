import re
from collections import Counter

from pyspark.sql import functions as F

from cadenza.llm.mixing import _hypergeometric, _lfact, mix, plan, split_tree, targets


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def docs(spark):
    rows = [(i, "w " * (i % 9) + "é x", "s%d" % (i % 7 % 4 if i % 3 else 0)) for i in range(900)]
    rows += [(2000, None, "s1"), (2001, "", "empty"), (2002, "a b c", None), (2003, "a " * 3000, "s2"), (2004, "x", "z"), (5, rows[5][1], rows[5][2]), (None, "p q", "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as no", "3 as block", "4 as _id", "5 as mix_shard"), rows


def test_plan(spark):
    df, rows = docs(spark)
    got = plan(df, shards=5).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").replace(" ", "_").split())
    aim = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - aim[r.source]) < 1e-6 and 0 <= r.copies <= 3 and len(r.draws) == r.copies
        assert [d.epoch for d in r.draws] == list(range(r.copies)) and all(0 <= d.shard < 5 for d in r.draws)
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= 3000 if s == "s2" else abs(taken[s] - aim[s]) <= 12
    again = {(r.doc_id, r.size): r for r in plan(df, shards=5).collect()}
    assert all(again[r.doc_id, r.size] == r for r in got)
    assert plan(df.limit(0)).count() == 0
    mixed = mix(df.filter("doc_id != 5"))
    assert mixed.columns == [*df.columns[:-1], "mix_shard", "mix_epoch", "mix_position"]


def test_draws_are_the_leaf_quotas(spark, monkeypatch):
    import cadenza.llm.mixing as mixing

    seen, real = [], mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda q, n, s: seen.append(real(q, n, s)) or seen[-1])
    df, _ = docs(spark)
    df = df.filter("size > 0")
    # blocks of a source by shard and epoch: the leaf's quota is the number of blocks that the shard draws
    got = plan(df, shards=6, seed="t").select("doc_id", "source", "size", F.explode("draws").alias("d")).filter("size > 0").collect()
    quota = {(r.no, r.shard): r.quota for r in seen[0].collect()}
    names = sorted({r.source for r in df.collect()}, key=lambda s: (s is None, s))
    blocks = {s: int(-(-(df.filter(F.col("source").eqNullSafe(s)).count() ** 0.5) // 1)) for s in names}
    import hashlib

    drawn = {(names.index(r.source), int(hashlib.md5(f"t|block|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) % blocks[r.source], r.d.epoch, r.d.shard) for r in got}
    count = Counter((no, shard) for no, _, _, shard in drawn)
    for at, n in quota.items():
        assert n - 1 <= count[at] <= n, at  # the block at the edge may take no document
    # disjoint: a block of an epoch is in one shard
    assert len({x[:3] for x in drawn}) == len(drawn) and len({x[3] for x in drawn}) == 6
    # what the tree does not give is not taken
    monkeypatch.setattr(mixing, "split_tree", lambda q, n, s: real(q, n, s).withColumn("quota", F.lit(0).cast("long")))
    assert plan(df).filter("copies > 0").count() == 0


def test_too_many_sources(spark):
    import pytest

    from cadenza.llm.mixing import MAX_SOURCES

    with pytest.raises(ValueError, match="sources"):
        plan(spark.range(MAX_SOURCES + 5).selectExpr("id as doc_id", "'x' as text", "string(id) as source"))


def test_shuffled_shards(spark):
    from cadenza.llm.mixing import shuffled

    df, rows = docs(spark)
    got = shuffled(df)
    planned, rows_ = plan(df).collect(), got.withColumn("p", F.spark_partition_id()).collect()
    assert got.columns == df.columns and len(rows_) == sum(r.copies for r in planned)
    place = {}
    for r in planned:
        for d in r.draws:
            place.setdefault((r.doc_id, r.size), []).append((d.shard, d.position))
    # rows of a partition lie by shard, and within a shard by position
    for _, part in __import__("itertools").groupby(rows_, key=lambda r: r.p):
        keys = [place[r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))] for r in part]
        low = (-1, -1)
        for own in keys:  # a row is one of its document's draws
            assert (low := min((d for d in own if d >= low), default=None)) is not None


def test_hypergeometric_law(spark):
    from math import comb, lgamma

    got = spark.range(200).select(_lfact(F.col("id").cast("double")).alias("f"), "id").collect()
    assert all(abs(r.f - lgamma(r.id + 1)) < 1e-9 for r in got)
    n = 4000
    one = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(_hypergeometric(one(7), one(20), one(9), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    for r in got:
        assert abs(r["count"] / n - comb(7, r.x) * comb(13, 9 - r.x) / comb(20, 9)) < 2 / n


def test_tree_keeps_quotas(spark):
    quotas = {0: 31, 1: 0, 2: 500, 3: 2}
    for shards in (1, 2, 7):
        leaves = split_tree(spark.createDataFrame(list(quotas.items()), "no long, quota long"), shards, "s").collect()
        assert {r.shard for r in leaves} == set(range(shards))
        total = Counter()
        width = Counter()
        for r in leaves:
            assert r.quota >= 0
            total[r.no] += r.quota
            width[r.shard] += r.quota
        assert dict(total) == quotas and max(width.values()) - min(width.values()) <= 3


def test_native(spark):
    df, _ = docs(spark)
    plan_ = plan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan_ and "Cartesian" not in plan_ and "NestedLoop" not in plan_


def test_mix_of_null_and_repeated_ids(spark):
    _, rows = docs(spark)
    rows = rows + [(None, "n " * k, "s%d" % (k % 3)) for k in range(1, 40)] + [(7, "r " * 5, "s1")] * 30 + [(None, "t t", "s2")] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in plan(df, shards=5).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    for r in mix(df, shards=5).collect():
        got[r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))] += 1
    assert got == +want and got[7, "s1", 5] <= 90
    assert mix(df.limit(0)).count() == 0

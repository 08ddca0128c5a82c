import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm.manifest import COLUMNS, leaf_digest, manifest, tampered

H = lambda *s: hashlib.sha256("".join(s).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """(root, siblings of every leaf as (before, after) by level)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            ways[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes, at = [H(*r) for r in runs], [i // fanout for i in at]
    return nodes[0], ways


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]], fanout)
    root, above = climb([trees[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for r, way in zip(groups[s], trees[s][1], strict=True):
            way = way + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r)
            for before, after in way:
                h = H(before, h, after)
            out.append((r[0], leaf(r), trees[s][0], root, H(*(b + a for b, a in way)), h, h == root))
    return sorted(out, key=str)


def shown(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout", [3, 16])
def test_against_brute_force(spark, fanout):
    r = random.Random(fanout)
    rows = [(i, r.choice(["s1", "s1", "s1", "S2", "é", "\U0001f600", "￮", "", None]), r.choice(["en", None]), r.choice([3, None]), r.choice(["Text " * r.randrange(9), "small", None, "", "-"])) for i in range(400)]
    rows += [(None, "s1", None, None, None), (None, None, "x", 1, "Y"), (999, "alone", "en", 2, "Lone"), (-5, "s1", "en", 2, "ÄB"), (7, "s1", "en", 1, "L" * 60000)]
    rows += rows[:30] + [rows[3]] * 40
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "at", "total", "_leaf2", "digest", "path", "_group2")}).repartition(5)
    got = manifest(df, claimed=tampered(df), fanout=fanout)
    assert shown(got) == brute(rows, fanout)
    assert not all(x.verified for x in got.select("verified").collect())
    assert manifest(df, fanout=fanout).filter("not verified").count() == 0


def test_small_tables(spark):
    df = spark.createDataFrame([(4, None, None, None, None)], SCHEMA)
    one = manifest(df).first()
    assert one.leaf == one.subroot == one.root == leaf((4, None, None, None, None)) and one.proof_sha256 == H("") and one.verified and one.path == []
    assert manifest(df.limit(0)).count() == 0
    many = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    assert shown(manifest(many, claimed=tampered(many))) == brute([tuple(x) for x in many.collect()], 16)


def test_one_group_of_many_ranges(spark):
    """A group that holds all rows, with one id for all: dealt over ranges, the same tree."""
    rows = [(1, "hot", "en", i % 3, "same") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = manifest(df, claimed=tampered(df))
    assert shown(got) == brute(rows, 16)
    path = got.agg(F.max(F.size("path"))).first()[0]
    assert path == 3


def test_another_change_is_found(spark):
    """Any changed column of any row fails to verify, and that row alone."""
    rows = [(i, "ab"[i % 2], "en", i, f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    for column in COLUMNS[2:]:
        values = [F.lit(None).cast("string") if c == column else df[c] for c in COLUMNS]
        got = manifest(df, claimed=F.when(df["doc_id"] == 41, leaf_digest(values)).otherwise(F.col("_leaf")))
        assert [x.doc_id for x in got.filter("not verified").collect()] == [41]

import hashlib
import random

from pyspark.sql import functions as F

from cadenza.llm.fixity import audit, depth, manifest, parse, query, read_volumes, records, stored, tree, write_volumes


def rows(n=90):
    r = random.Random(1)
    out = [(i * 7, f"http://h/{i}", "<p>" + "é" * r.randint(0, 50) + "\r\n\r\nx</p>") for i in range(n)]
    return out + [(3, None, None), (None, "u", "x"), (None, "u", "x"), (14, "dup", "x"), (14, "dup", "x")]


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as volume", "2 as record", "3 as name", "4 as node")


def test_trees_and_volumes(spark, tmp_path):
    df = frame(spark, rows())
    recs = records(df, volume_ids=200).cache()
    leaves = manifest(recs).cache()
    assert leaves.count() == len(rows()) and depth(leaves) == 2
    # the tree by hand: relative ranges and hashes of the children
    own = sorted((r.ordinal, r.offset, r.length, r.digest) for r in leaves.filter("volume = 1").collect())
    level = [(o, n, d) for _, o, n, d in own]
    while len(level) > 1:
        level = [(c[0][0], sum(x[1] for x in c), hashlib.sha256(",".join(f"{o - c[0][0]}:{n}:{d}" for o, n, d in c).encode()).hexdigest()) for c in (level[i : i + 4] for i in range(0, len(level), 4))]
    small = leaves.filter("volume = 1")
    assert [(r.offset, r.length, r["hash"]) for r in tree(small, depth(small, 4), 4)[-1].collect()] == level
    path = str(tmp_path / "warc")
    write_volumes(recs, path)
    back = read_volumes(spark, path).cache()
    assert {(r.volume, r.offset, r.length, r.digest) for r in back.collect()} == {(r.volume, r.offset, r.length, r.digest) for r in leaves.collect()}
    assert back.filter("not good or uri is null or name is null").count() == 0
    assert sorted(r.payload.decode() for r in back.collect()) == sorted(h or "" for _, _, h in rows())
    # an undamaged replica, with null and repeated ids
    assert audit(leaves, stored(back)).count() == 0
    empty = manifest(records(df.limit(0)))
    assert audit(empty, empty).count() == 0 and {r.status for r in audit(leaves, empty).collect()} == {"missing"} and audit(leaves, empty).count() == len(rows())


def test_broken_files():
    one = lambda name, body, size=None: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:{name}>\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n{body}\r\n\r\n".encode()
    for bad in (one("b", "xyz", 9), one("b", "xyz", 1), one("b", "xyz")[:60] + b"\r\n\r\n", b"WARC/1.1\r\nno head\r\n\r\n", one("b", "x" * 50)[:-20] + b"\r\n\r\n"):
        data = one("a", "1\r\n\r\n2") + bad + one("c", "")
        got = parse(data)
        assert [r[0] for r in got] == [0, len(one("a", "1\r\n\r\n2")), len(data) - len(one("c", ""))] and [r[5] for r in got] == [True, False, True] and sum(r[1] for r in got) == len(data)
    assert parse(b"") == [] and [r[5] for r in parse(b"junk")] == [False]


def test_audit_finds_all_and_only_damage(spark, tmp_path):
    """Random damage with records moved by it, against a comparison of the record lists."""
    r = random.Random(5)
    leaves = manifest(records(frame(spark, rows()), volume_ids=200)).cache()
    other, want = [], []
    for volume in sorted({x.volume for x in leaves.collect()}):
        at = 0
        ordinal = 0
        for x in sorted(leaves.filter(F.col("volume") == volume).collect(), key=lambda x: x.ordinal):
            fate = r.choice(["ok"] * 9 + ["change", "longer", "gone", "twice", "renamed"]) if volume >= 0 and x.page_id != 14 else "ok"
            length, digest, name = x.length, x.digest, x.name
            if fate == "gone":
                want.append((volume, "left", x.ordinal, "missing"))
                continue
            if fate in ("change", "longer", "renamed"):
                digest, length = hashlib.sha256(f"{volume}{x.ordinal}".encode()).hexdigest(), length + (fate == "longer")
                name = "new" if fate == "renamed" else name
                want.append((volume, "left", x.ordinal, "missing" if fate == "renamed" else "corrupt"))
            for copy in range(2 if fate == "twice" else 1):
                if copy or fate == "renamed":
                    want.append((volume, "right", ordinal, "surplus"))
                other.append((volume, name, ordinal, at, length, digest))
                ordinal, at = ordinal + 1, at + length
    held = spark.createDataFrame(other, "volume long, name string, ordinal long, offset long, length long, digest string")
    for fanout in (2, 4, 16):
        assert sorted(map(tuple, audit(leaves, held, fanout).collect())) == sorted(want)
    plan = audit(leaves, held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30


def test_query_on_null_and_repeated_ids(spark, tmp_path):
    fate = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:6], 16) % 64
    by = {f: next(i for i in range(1000, 9000) if fate(i) == f) for f in (5, 6, 7, 8)}
    safe = [i for i in range(3, 60) if fate(i) not in by][:3]
    data = [(i, "u", "safe") for i in safe] + [(safe[0], "u", "safe"), (safe[1], "v", "other"), (None, "u", "y"), (None, "u", "y"), (None, None, None)]
    data += [(i, "u", f"a{i} é" * 40) for i in by.values()] + [(by[7], "u", "again"), (by[5], None, None)]
    frame(spark, data).write.parquet(str(tmp_path / "pages.parquet"))
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(data) + 1
    status = lambda i: sorted(r.status for r in got if r.page_id == i)
    assert status(by[5]) == ["corrupt", "intact"] and status(by[6]) == ["corrupt"] and status(by[7]) == ["missing", "missing"] and status(by[8]) == ["intact"]
    assert all(status(i) == ["intact"] * len(status(i)) for i in safe) and status(None) == ["intact"] * 3 + ["surplus"]

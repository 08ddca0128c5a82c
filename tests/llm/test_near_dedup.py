import random
import re

from cadenza.llm.components import components
from cadenza.llm.near_dedup import bands_for, drop_near, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = "z%d" % r.randrange(10**6)
    return " ".join(w)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A  B"), (1005, "b a"), (1006, "a b c d e"), (1007, "A b c d\x0be")]
    for g in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(6, 400))]
        rows += [(r.randrange(900), edited(r, base, r.choice([0, 0, 1, 2, 3, 6]))) for _ in range(r.randint(1, 5))]
    hot = [r.choice(vocab) for _ in range(150)]  # a group in which most pairs are too far apart
    rows += [(2000 + i, edited(r, hot, r.randint(0, 7))) for i in range(120)]
    rows += [(3000, "x" * 30000), (3001, "long " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as key", "2 as bands")
    got = near_duplicates(df, percent=85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 85)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_recall_on_the_given_documents(spark):
    """All links of the given table are found: the components are those of brute force, at both thresholds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for percent in (80, 85):
        want = brute(rows, percent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, percent=percent).collect()) == want
        assert sum(d != c for d, _, c in want) > 5


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    import cadenza.llm.near_dedup as nd

    monkeypatch.setattr(nd, "PART", 4)
    r = random.Random(8)
    hot = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(120)]
    rows = [(i, edited(r, hot, r.randint(2, 9))) for i in range(90)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows, 85)


def test_small(spark):
    assert (bands_for(85), bands_for(80), bands_for(100)) == (32, 50, 1)
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string").withColumn("_keep", __import__("pyspark").sql.functions.lit(1))
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert drop_near(df).columns == ["doc_id", "text", "_keep"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}

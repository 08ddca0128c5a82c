import random
import re

import numpy as np
from xxhash import xxh64_intdigest

import cadenza.llm.simhash as sh
from cadenza.llm.simhash import allocate, fingerprint, links, near_groups, partition_bits, unit_costs


def plain(text):
    """The fingerprint by its definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def shown(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_fingerprint_by_definition():
    r = random.Random(1)
    texts = [None, "", " \t\n", "One", "A  b", "a b c", "Ä \x1c ö\x85ü ß", "x\x0by\x0cz W"]
    texts += [r.choice(" \n\t").join(r.choice(["ab", "Cd", "é", "q" * r.randrange(9)]) for _ in range(r.randrange(90))) for _ in range(60)]
    for t in texts:
        assert fingerprint(t) == plain(t) == fingerprint(t, piece=7)


def test_fingerprint_is_what_spark_hashes(spark):
    """A text of one shingle has the hash of Spark's own XXH64 with seed 42."""
    df = spark.createDataFrame([(1, "some three words"), (2, "Zwei Wörter")], "doc_id long, text string")
    want = {r.i: r.h & (2**64 - 1) for r in df.selectExpr("doc_id as i", "xxhash64(lower(text)) as h").collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in near_groups(df).collect()} == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert shown(near_groups(docs)) == want and sum(d != c for d, _, c in want) > 5


def test_edges(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(50)]
    rows = [(5, None), (3, ""), (9, " \n"), (4, "a b"), (2, "A  B"), (1, "b a"), (7, "long " * 30000), (8, "x" * 40000)]
    for g in range(10):
        base = [r.choice(words) for _ in range(r.randint(3, 300))]
        for _ in range(5):
            w = list(base)
            w[r.randrange(len(w))] = "new"
            rows.append((r.randrange(10, 900), " ".join(w)))
    rows += rows[8:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 as fp", "'x' as component", "1 as rows")
    got = near_groups(df)
    assert shown(got) == brute(rows) and all(x.kept == (x.doc_id == x.component_id) for x in got.collect())
    assert near_groups(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "p q r"), (6, "p q r"), (None, "alone here now")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in near_groups(nulls).collect()) == [(0, 0), (0, 6), (6, 6)]


def classes_near(r, centres, n, flips):
    out = set()
    for _ in range(n):
        x = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def spanned(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), []).append(x)
    return sorted(sorted(g) for g in groups.values())


def test_links_span_what_brute_force_links(spark):
    """Crowded values, uneven bits and several partition counts: the same components, and true links alone."""
    r = random.Random(5)
    fps = classes_near(r, [r.getrandbits(64) for _ in range(4)], 500, 4) + [r.getrandbits(64) & 0xFFFF for _ in range(200)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pair = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    want = spanned(pair, signed)
    for crowd in (256, 20, 1):
        got = [tuple(x) for x in links(df, crowd=crowd).collect()]
        assert spanned(got, signed) == want
        assert {frozenset(p) for p in got} <= {frozenset(p) for p in pair}


def test_other_partitions_and_distances(spark, monkeypatch):
    r = random.Random(6)
    signed = np.array(classes_near(r, [r.getrandbits(64) for _ in range(3)], 150, 5), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for k in (2, 4):
        want = spanned([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= k], signed)
        for m in (2, 4, 6):
            monkeypatch.setattr(sh, "PARTITIONS", (m,))
            assert spanned([tuple(x) for x in links(df, k, crowd=10**6).collect()], signed) == want
    assert spanned([tuple(x) for x in links(df, 4, crowd=30).collect()], signed) == want


def test_crowds_cost_a_bounded_number_of_rows(spark):
    """Many classes that share most bits: no pairs of a crowded value are made."""
    r = random.Random(7)
    fps = sorted({r.getrandbits(64) & ~((1 << 48) - 1) ^ (1 << 60) for _ in range(900)})  # 48 bits are the same in all
    df = spark.createDataFrame([(x,) for x in np.array(fps, np.uint64).view(np.int64).tolist()], "fp long")
    out = sh._midpoints(df, 2)
    assert out.count() <= 65 * len(fps)


def test_units_are_the_cheapest_that_suffice():
    r = np.random.default_rng(2)
    costs = r.random((200, 3, 4)) * 10
    costs[:, :, 0] = 0
    got = allocate(costs)
    assert (got.sum(axis=1) == 3).all()
    for row, u in zip(costs, got, strict=True):
        every = [(row[0, a] + row[1, b] + row[2, 3 - a - b]) for a in range(4) for b in range(4 - a)]
        assert np.isclose(sum(row[i, u[i]] for i in range(3)), min(every))


def test_counts_of_candidates_are_exact_within_the_fold():
    counts = np.zeros(16)
    counts[[0, 1, 3, 15]] = [5, 2, 1, 7]
    c = unit_costs(counts, 4, 2)
    probes = [0, 1, 5, 11]
    assert np.allclose(c[0], [p + sh.COMPARE * n for p, n in zip(probes, [0, 5, 7, 8], strict=True)])


def test_bits_that_go_together_share_a_partition():
    together = np.zeros((64, 64))
    for i in range(0, 64, 4):
        for j in range(i, i + 4):
            for k in range(i, i + 4):
                together[j, k] = float(j != k)
    for parts in (2, 4):
        got = partition_bits(together, parts)
        assert sorted(b for p in got for b in p) == list(range(64))
        assert all(len({b // 4 for b in p}) == len(p) // 4 for p in got)

import hashlib
import re

from cadenza.llm.exact_dedup import drop_exact, exact_dedup

ROWS = [
    (1, "a b", "x"), (2, "ab", "x"), (3, "a\t\n b ", None), (4, None, "x"), (5, "", "x"), (6, " \x0b", "x"), (7, "A b", "x"),
    (8, "é" * 9000, "x"), (9, "é" * 8999 + "e", "x"), (10, "é" * 9000 + " ", "x"), (11, "a b", "x"), (12, "ab", "x"), (12, "ab", "x"), (None, "ab", "x"),
]


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {n: (min(g, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items()}


def test_both_join_paths(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, _len string").selectExpr("*", "1 as _keep", "2 as _sha")
    want = brute(ROWS)
    for limit in (0, 1000):
        got = exact_dedup(df, digest_all=True, broadcast_limit=limit, prefix_chars=3).collect()
        assert len(got) == len(ROWS)
        by = {sha: (k, n) for k, n, sha in want.values()}
        assert all(by[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
        assert {r.doc_id for r in got if r.kept} == {3, 6, 7, 8 + 2, 9, 11}
    lazy = {r.doc_id: r.text_sha256 for r in exact_dedup(df).collect()}
    assert lazy[7] is None and lazy[1] is not None
    assert drop_exact(df).columns == df.columns and drop_exact(df).count() == 6
    assert exact_dedup(df.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    from cadenza.llm.near_dedup import drop_near

    words = [f"word{k}" for k in range(60)]
    long = " ".join(words)
    rows = [(None, long), (None, long), (None, "lone text of a null id"), (5, "twice"), (5, "twice"), (5, "other"), (6, "o ther"), (6, "ot her"), (6, "oth er")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_exact(df).collect()
    assert sorted((r.text.replace(" ", ""), str(r.doc_id)) for r in got) == sorted([(long.replace(" ", ""), "None"), ("lonetextofanullid", "None"), ("twice", "5"), ("other", "6")])
    rows = [(None, long), (None, long + " more"), (None, "lone text of a null id"), (5, " ".join(words[::-1])), (5, " ".join(words[::-1]) + " end"), (5, "other")]
    got = drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.text[:5] for r in got} == {"word0", "lone ", "word5", "other"}

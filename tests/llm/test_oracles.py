"""The SQL of the corpus operators against their queries, on a table with nulls, repeated rows and extra columns besides the given one."""

import pytest

from cadenza.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    res = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = sorted(tuple(show(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in res.fetchall())
    assert sorted(tuple(show(r[c]) for c in sorted(names)) for r in got.collect()) == want and want

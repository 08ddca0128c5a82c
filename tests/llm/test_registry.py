import re

from cadenza.llm import registry


def test_names_and_oracles():
    q, o = registry.queries(), registry.oracle_sql()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q) == list(range(1, 14))
    assert set(o) <= set(q) and all(isinstance(s, str) for s in o.values())

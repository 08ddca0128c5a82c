import hashlib
import random

import pytest

pytest.importorskip("sentencepiece")
from cadenza.llm.piece_codec import PieceModel, default_model, encode

ODD = ["", " ", "  a  b ", "a" * 5000, "▁x▁ y", "日本語 テスト 😀", "\x00\x01tab\tnew\nline\r\n", "é é ﬀ", "   ", "x" + " " * 40 + "y", "<s> </s> <unk> <0x41>", "🏳️‍🌈" * 30]


def texts():
    r = random.Random(5)
    more = ["".join(r.choice("abcde  \n\té▁<0x>日") for _ in range(r.randint(0, 60))) for _ in range(400)]
    return ODD + more


def test_agenda_equals_the_library():
    m = PieceModel(default_model())
    for t in texts():
        ids = m.library.encode(t)
        assert m.encode(t) == ids, t
        assert m.decode(ids) == m.library.decode(ids), t


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(9999, None, None), (0, ODD[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in encode(df, default_model()).collect()}
    lib = PieceModel(default_model()).library
    for i, t, _ in rows:
        ids = lib.encode(t or "")
        r = got[i]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert encode(df.limit(0), default_model()).count() == 0

import zlib

import numpy as np
import pytest

from cadenza.llm import bigru
from cadenza.llm.bigru import CONTEXT, WINDOW, BiGru, windows
from cadenza.llm.language_id import fit, identify, predict, training_windows


def plain(m, text):
    """Label probabilities of every position of a text, window by window and byte by byte."""
    sig = lambda a: 1 / (1 + np.exp(-a))
    h, out = m.hidden, []
    for at in range(0, len(text), WINDOW):
        first = max(0, at - CONTEXT)
        read = text[first : at + WINDOW + CONTEXT]
        states = []
        for d, seq in (("f", read), ("b", read[::-1])):
            s, every = np.zeros(h), []
            for byte in seq:
                g, u = m.p[d + "E"][byte].astype(float), s @ m.p[d + "U"].astype(float)
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                s = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                every.append(s)
            states.append(every)
        logits = np.concatenate([np.array(states[0]), np.array(states[1][::-1])], axis=1) @ m.p["V"] + m.p["c"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        out.extend(p[at - first : at - first + WINDOW][: len(text) - at])
    return np.array(out)


def test_gradient_by_differences():
    m = BiGru(["a", "b", "c"], hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    words, y = [b"abc", b"z", b"hello"], np.array([0, 2, 1])
    _, g = m.step(words, y)
    for k, at in (("fE", (97, 2)), ("fU", (1, 5)), ("bE", (104, 9)), ("bE", (108, 1)), ("bU", (2, 11)), ("V", (3, 1)), ("c", (2,)), ("fU", (0, 9)), ("bE", (122, 0))):
        old = m.p[k][at]
        diff = []
        for e in (1e-2, -1e-2):
            m.p[k][at] = old + e
            diff.append(m.step(words, y)[0])
        m.p[k][at] = old
        assert abs((diff[0] - diff[1]) / 2e-2 - g[k][at]) < 1e-3, k


def test_batched_pass_equals_the_plain_one(monkeypatch):
    r = np.random.default_rng(5)
    m = BiGru(["a", "b", "c"], hidden=6)
    texts = [bytes(r.integers(32, 250, n, dtype=np.uint8)) for n in (1, 2, 31, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + CONTEXT, 3 * WINDOW + 7, 5)] + [b""]
    want = np.array([plain(m, t).sum(axis=0) if t else np.zeros(3) for t in texts])
    for lanes in (1, 3, 512):
        monkeypatch.setattr(bigru, "LANES", lanes)
        assert np.abs(m.sums(texts) - want).max() < 1e-2
    # every position is labelled once
    for t in texts:
        assert sum(n for _, n, _ in windows(t)) == len(t) and b"".join(x[s : s + n] for s, n, x in windows(t)) == t
    # training reads the same function
    x, length = bigru.pad([t for t in texts if 0 < len(t) < WINDOW])
    p = m._probabilities(x, length)[0]
    for i, t in enumerate(t for t in texts if 0 < len(t) < WINDOW):
        assert np.abs(p[i, : len(t)] - plain(m, t)).max() < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in out) / len(out) >= 0.95


def test_odd_rows(spark):
    rows = [(1, "the house", "en"), (3, "das Haus ist gut", "de"), (4, None, "en"), (5, "", None), (6, "123 !!", "de"), (7, "x" * 5000 + " " + "é" * 100, None), (None, "the the", None), (1, "the house", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out", "2 as score", "3 as h", "4 as windows")
    model = fit(df, steps=5)
    got = predict(df, model).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6}
    assert {r.lang_pred for r in predict(df, None).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0


def test_learns_only_from_training_rows(spark):
    rows = [(i, f"wort{i % 5} das", "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert any(r[2] == "zz" for r in rows) and fit(df, steps=2).labels == ["de"]
    got = training_windows(df, "doc_id", "text", "lang", 7, 3)
    assert len(got) == 21 and {lang for lang, _ in got} == {"de"} and got == training_windows(df.repartition(3), "doc_id", "text", "lang", 7, 3)
    # the end of a long text is drawn from as well
    long = spark.createDataFrame([(1, "a " * 4000 + "b " * 4000, "de")] * 3, "doc_id long, text string, lang string")
    assert {w.strip()[0] for _, w in training_windows(long, "doc_id", "text", "lang", 5, 30)} == {"a", "b"}
    with pytest.raises(ValueError, match="languages"):
        training_windows(spark.range(900).selectExpr("id as doc_id", "'x' as text", "string(id) as lang"), "doc_id", "text", "lang")

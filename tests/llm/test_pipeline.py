import hashlib
import re
from collections import Counter

import corpus_pipeline
from cadenza.llm.language_id import fit, predict
from cadenza.llm.piece_codec import PieceModel, default_model
from test_mixing import brute_targets
from test_near_dedup import brute


def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "123 456", None, None, 7), (9003, "the of and in", None, None, 13)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 30"))  # rows that are there twice
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    lang = {r.doc_id: r for r in predict(docs, fit(docs)).collect()}
    kept = {i for i, r in lang.items() if r.lang_pred != "und" and r.score >= 0.3}
    assert {9001, 9002} & kept == set() and len(kept) == len(rows) - 2
    best = {}
    for i in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", rows[i].text)
        best[key] = min(best.get(key, (1, 0)), (-len(rows[i].text), i))
    kept = {i for _, i in best.values()}
    kept = {d for d, _, c in brute([(i, rows[i].text) for i in sorted(kept)], 80) if d == c}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in kept}
    sources = Counter()
    for i in kept:
        sources[rows[i].source] += size[i]
    aim = brute_targets(sources)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= kept and max(Counter(r.doc_id for r in got).values()) <= 3
    taken, most = Counter(), Counter()
    for r in got:
        taken[rows[r.doc_id].source] += size[r.doc_id]
    for i in kept:
        most[rows[i].source] = max(most[rows[i].source], size[i])
    assert all(abs(taken[s] - aim[s]) <= most[s] for s in sources)
    lib = PieceModel(default_model()).library
    for r in got:
        ids = lib.encode(rows[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "source mix", "sentencepiece"]

import hashlib
import zlib

from cadenza.llm.media import blocks, described, store

ROWS = [(1, ""), (2, None), (3, "a" * 576), (4, "é" * 400), (5, "x" * 577), (6, "Lorem ipsum " * 9000), (3, "a" * 576), (None, "z")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "1 as flac", "2 as feature")
    got = {r.doc_id: r for r in described(df).collect()}
    assert described(df).count() == len(ROWS)
    for i, t in ROWS:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576) if raw else b"\xff" * 576
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[1][3:] == got[2][3:]
    for i, t in ROWS:
        x = [b - 128 for b in (lambda raw: raw + b"\xff" * (-len(raw) % 576) if raw else b"\xff" * 576)((t or "").encode())]
        sums = f"n={len(x)};sum={sum(x)};power={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};low={min(x)};high={max(x)}"
        assert got[i].feature == sums
        raw = bytes(v + 128 for v in x)
        assert got[i].pcm_blocks == ",".join(f"{at}:{zlib.crc32(raw[at:at + 9216])}" for at in range(0, len(raw), 9216))
    media = store(df.filter("doc_id in (5, 6)"))
    assert {hashlib.sha256(r.flac).hexdigest() for r in media.collect()} == {got[5].media_sha256, got[6].media_sha256}
    pcm = sorted(blocks(media, 5000).filter("doc_id = 6").collect(), key=lambda r: r.first_sample)
    assert b"".join(bytes(r.pcm) for r in pcm)[: 12 * 9000] == ("Lorem ipsum " * 9000).encode()
    assert [r.first_sample for r in pcm] == list(range(0, got[6].payload_bytes, 5000))
    assert described(df.limit(0)).count() == 0

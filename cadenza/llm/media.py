"""Texts as FLAC media columns: stored losslessly, read back, checked and described.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, are
the samples of an 8-bit mono FLAC stream (``flac.py``). ``store`` gives the
streams, ``blocks`` decodes them into PCM blocks with seekable sample offsets,
and ``described`` stores, reads back, cuts into the same blocks and digests in one pass, so that no stream
leaves its task. Rows are independent: there is no shuffle, a lost executor
only repeats its own rows, and the memory of a task is a batch slice of about
2 MB of text (or one longer text).

Defined results: null counts as empty, and an empty text is one frame of bytes
255; equal texts give equal streams and values; repeated rows give equal rows;
other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import flac
from .common import sliced

SLICE = 2 << 20
#: Samples of a PCM block.
PCM = 16 * flac.BLOCK


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * ((-len(raw)) % flac.BLOCK or (0 if raw else flac.BLOCK)), len(raw)


def feature(samples: bytes) -> str:
    """Count, mean, power and sign changes of decoded samples, as exact fractions of sums."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};power={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};low={x.min()};high={x.max()}"


def _rows(docs, id_col, text_col):
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, flac): the stream of every text."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                own = [payload(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in own], pa.int64()), pa.array(flac.encode([p for p, _ in own]), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("flac", T.BinaryType())])
    return _rows(docs, id_col, text_col).mapInArrow(run, out)


def cut_blocks(samples: bytes, size: int = PCM) -> list[tuple[int, bytes]]:
    """(first sample, samples) of the blocks of a decoded stream."""
    return [(at, samples[at : at + size]) for at in range(0, len(samples), size)]


def blocks(media: DataFrame, samples_per_block: int = PCM) -> DataFrame:
    """(doc_id, first_sample, pcm) blocks of the streams in ``media`` (doc_id, flac)."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in sliced(whole, "flac", SLICE):
                rows = []
                for i, raw in zip(batch.column("doc_id").to_pylist(), flac.decode(batch.column("flac").to_pylist()), strict=True):
                    rows += [(i, *b) for b in cut_blocks(raw, samples_per_block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (batch.column("doc_id").type, pa.int64(), pa.binary()), strict=True)], names=["doc_id", "first_sample", "pcm"])

    out = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType), T.StructField("first_sample", T.LongType()), T.StructField("pcm", T.BinaryType())])
    return media.select("doc_id", "flac").mapInArrow(run, out)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back and digest both; ``pcm_blocks`` has first sample and CRC-32 of every PCM block."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                own = [payload(t) for t in batch.column("text").to_pylist()]
                streams = flac.encode([p for p, _ in own])
                rows = [
                    (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature(back), ",".join(f"{at}:{zlib.crc32(b)}" for at, b in cut_blocks(back)))
                    for (_, n), s, back in zip(own, streams, flac.decode(streams), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in (
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pcm_blocks", T.StringType()))])
    return _rows(docs, id_col, text_col).mapInArrow(run, out)


def query(spark, sf_dir):
    from .common import table

    return described(table(spark, sf_dir, "documents"))

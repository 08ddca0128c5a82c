"""PCM WAV files as chunk rows: whole files as values, and by ranges through the data source ``wav``."""

from __future__ import annotations

import struct

from pyarrow.fs import LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import relative, store_of

SCHEMA = "song string, voice string, chunk bigint, frame0 bigint, n_channels int, rate int, samples array<smallint>"


def read_wav(spark: SparkSession, path: str, frames_per_chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of the files ``<song>-<voice>.wav`` below a folder; a song's name includes the folders below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return decode_wav(files.select(relative(F.col("path"), path).alias("file"), "content"), frames_per_chunk)


def read_head(f, total: int) -> tuple[int, int, int, int, int]:
    """(channels, rate, bits, first byte of the samples, bytes of whole frames) of an open file of ``total`` bytes; raises ValueError if it is broken."""
    f.seek(0)
    top = f.read(12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise ValueError("no WAVE header")
    form, at = None, 12
    while at + 8 <= total:
        f.seek(at)
        tag, size = struct.unpack("<4sI", f.read(8))
        if tag == b"fmt ":
            if size < 16 or at + 24 > total:
                raise ValueError("broken format chunk")
            form = struct.unpack("<HHIIHH", f.read(16))
        elif tag == b"data":
            if at + 8 + size > total:
                raise ValueError("truncated samples")
            break
        at += 8 + size + size % 2
    else:
        raise ValueError("no format or no samples")
    if form is None:
        raise ValueError("no format or no samples")
    n, rate, bits = form[1], form[2], form[5]
    if form[0] not in (1, 0xFFFE) or not n:
        raise ValueError("no PCM")
    if bits not in (8, 16, 24, 32):
        raise ValueError(f"{bits} bits a sample")
    frame = bits // 8 * n
    return n, rate, bits, at + 8, size // frame * frame


def to_16_bits(body: bytes, bits: int):
    """Samples of whole frames as 16 bits."""
    import numpy as np

    if bits == 8:  # unsigned
        return (np.frombuffer(body, np.uint8).astype(np.int16) - 128) << 8
    if bits == 16:
        return np.frombuffer(body, "<i2")
    width = bits // 8  # the upper two bytes
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(-1, width)[:, width - 2 :]).view("<i2").ravel()


def _parsed(data: bytes):
    """(channels, rate, samples as 16 bits) of a file; raises ValueError if it is broken."""
    import io

    n, rate, bits, first, size = read_head(io.BytesIO(data), len(data))
    return n, rate, to_16_bits(data[first : first + size], bits)


def decode_wav(files: DataFrame, frames_per_chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of files (file, content): samples of 8, 16, 24 or 32 bits, as 16 bits; a broken file is a row (file, reason)."""

    def run(batches):
        import os

        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.string(), pa.string())
        names = ["song", "voice", "chunk", "frame0", "n_channels", "rate", "samples", "file", "reason"]
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                song, _, voice = os.path.splitext(name)[0].rpartition("-")
                try:
                    n, rate, x = _parsed(data)
                    step = frames_per_chunk * n
                    rows = [(song, voice, i // step, i // n, n, rate, x[i : i + step], name, None) for i in range(0, len(x), step)]
                except (ValueError, struct.error) as e:
                    rows = [(None, None, None, None, None, None, None, name, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = files.select("file", "content").mapInArrow(run, SCHEMA + ", file string, reason string")
    return rows.filter("reason is null").drop("file", "reason"), rows.filter("reason is not null").select("file", "reason")


def wav_files(pcm: DataFrame, rate: int = 44100) -> DataFrame:
    """(file, content): the 16-bit file of every (song, voice), which is one value by nature."""

    def run(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("frame0")
        n, parts, size = int(frame["n_channels"].iloc[0]), [], 0
        for at, samples in zip(frame["frame0"], frame["samples"], strict=True):
            parts.append(b"\0" * (int(at) * n * 2 - size))  # silence before the chunk
            parts.append(np.clip(np.asarray(samples, np.int64), -32767, 32767).astype("<i2").tobytes())
            size += len(parts[-2]) + len(parts[-1])
        return pd.DataFrame([(f"{key[0]}-{key[1]}.wav", head(n, rate, size) + b"".join(parts))], columns=["file", "content"])

    rows = pcm.select(F.col("song").cast("string").alias("song"), "voice", "frame0", "n_channels", "samples")
    return rows.groupBy("song", "voice").applyInPandas(run, "file string, content binary")


def head(n: int, rate: int, size: int) -> bytes:
    return b"RIFF" + (36 + size).to_bytes(4, "little") + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * n * 2, n * 2, 16) + b"data" + size.to_bytes(4, "little")


def write_wav(pcm: DataFrame, path: str, rate: int = 44100, mode: str = "append") -> None:
    """One file per (song, voice), samples clamped, by the data source of this package: many tasks write a file on a local (shared) folder.

    On another store the chunks of a file are brought into one task, in order; its memory is a batch of chunks.
    """
    from .data_sources import register

    register(pcm.sparkSession)
    whole = pcm.groupBy("song", "voice").agg(F.max(F.col("frame0") * F.col("n_channels") + F.size("samples")).alias("total"), F.min("frame0").alias("_from"))
    rows = pcm.join(whole, ["song", "voice"]).withColumn("first", F.col("frame0") == F.col("_from"))
    if not isinstance(store_of(path)[0], LocalFileSystem):
        rows = rows.repartition("song", "voice").sortWithinPartitions("song", "voice", "frame0")
    rows.select(F.col("song").cast("string").alias("song"), "voice", "frame0", "n_channels", "samples", "total", "first").write.format("wav").option("rate", rate).mode(mode).save(path)

"""The data sources of MIDI and WAV files: ranges, columns, commits."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import midi
from cadenza.sources.data_sources import register
from cadenza.sources.wav import head, read_wav, write_wav

PCM = "song string, voice string, chunk bigint, frame0 bigint, n_channels int, rate int, samples array<smallint>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register(spark)


def files(top):
    return sorted(str(p.relative_to(top)) for p in Path(top).rglob("*") if p.is_file())


def samples(song, n=25000):
    return ((np.arange(n, dtype=np.int64) * 7919 + len(song)) % 60000 - 30000).astype(np.int16)


def pcm(spark, songs, step=1000):
    rows = [(s, "v", i // step, i // 2, 2, 8000, samples(s)[i : i + step].tolist()) for s in songs for i in range(0, 25000, step)]
    return spark.createDataFrame(rows, PCM).repartition(7)


def test_a_long_file_in_many_ranges(spark, tmp_path):
    """Chunks are the same whatever the ranges, and as the whole reader gives them."""
    write_wav(pcm(spark, ["a", "sub/b"]), str(tmp_path), 8000)
    assert files(tmp_path) == ["a-v.wav", "sub/b-v.wav"]
    assert (tmp_path / "a-v.wav").read_bytes() == head(2, 8000, 50000) + samples("a").tobytes()
    whole = sorted(map(tuple, read_wav(spark, str(tmp_path), 300)[0].collect()))
    for size in (6500, 999, 10**9):
        got = spark.read.format("wav").option("frames", 300).option("taskBytes", size).load(str(tmp_path))
        assert sorted(map(tuple, got.drop("reason").collect())) == whole
        if size == 6500:
            assert got.filter("song = 'a'").rdd.getNumPartitions() == 8  # of one file
    names = spark.read.format("wav").schema("song string, frame0 bigint").load(str(tmp_path))
    assert names.distinct().count() == 2 * 4 and names.columns == ["song", "frame0"]


def test_chunks_in_any_order_with_gaps_and_broken_files(spark, tmp_path):
    rows = [("s", "x", 3, 700, 1, 8000, [5, 6]), ("s", "x", 0, 2, 1, 8000, [32767, -32768, 1]), ("../t", "x", 0, 0, 1, 8000, [9])]
    write_wav(spark.createDataFrame(rows, PCM).repartition(3), str(tmp_path), 8000)
    assert files(tmp_path) == ["s-x.wav", "t-x.wav"]
    body = np.frombuffer((tmp_path / "s-x.wav").read_bytes()[44:], "<i2")
    assert len(body) == 702 and body[:6].tolist() == [0, 0, 32767, -32767, 1, 0] and body[-2:].tolist() == [5, 6]
    (tmp_path / "bad-x.wav").write_bytes(b"RIFFxxxx" * 900)
    (tmp_path / "cut-x.wav").write_bytes(head(1, 8000, 400) + b"\0" * 390)
    got = spark.read.format("wav").option("taskBytes", 1000).load(str(tmp_path))
    assert sorted(tuple(r) for r in got.filter("reason is not null").select("song", "reason").collect()) == [("bad", "no WAVE header"), ("cut", "truncated samples")]
    with pytest.raises(Exception, match="no WAVE header"):
        spark.read.format("wav").option("mode", "failfast").load(str(tmp_path)).collect()


def events(spark, songs):
    one = []
    for s in songs:
        one += [(s, 0, None, 0, 0, "Meta", "TrkName", None, None, None, "t", None, 96), (s, 0, None, 1, 5, "On", None, 1, 60, 90, None, None, 96), (s, 0, None, 2, 9, "Meta", "TrkEnd", None, None, None, None, None, 96)]
    return spark.createDataFrame(one, midi.EVENTS)


def test_midi_columns_filters_and_rejects(spark, tmp_path):
    midi.write_midi(events(spark, [f"d{i % 3}/s{i}" for i in range(20)]), str(tmp_path))
    assert files(tmp_path) == sorted(f"d{i % 3}/s{i}.mid" for i in range(20))
    (tmp_path / "broken.mid").write_bytes(b"MThd?")
    got = spark.read.format("midi").option("taskBytes", 100).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 5 and got.filter("reason is null").count() == 60
    assert [tuple(r) for r in got.filter("reason is not null").select("song", "reason").collect()] == [("broken.mid", "no MIDI header")]
    few = spark.read.format("midi").schema("song string, kind string").load(str(tmp_path))
    assert few.filter("kind = 'On'").count() == 20 and few.columns == ["song", "kind"]
    (tmp_path / "d0/s0.mid").write_bytes(b"no longer a file")
    own = spark.read.format("midi").option("mode", "failfast").load(str(tmp_path)).filter("song in ('d1/s1.mid', 'd2/s2.mid')")
    assert own.count() == 6  # files of other songs are not read


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """A task that dies takes the job with it: what the others wrote is removed, what was there stays."""
    midi.write_midi(events(spark, ["old"]), str(tmp_path))
    before = (tmp_path / "old.mid").read_bytes()
    bad = events(spark, ["new1", "new2", "new3", "old"]).withColumn("p1", F.when((F.col("song") == "new2") & (F.col("kind") == "On"), F.raise_error(F.lit("killed"))).otherwise(F.col("p1")))
    with pytest.raises(Exception, match="killed"):
        midi.write_midi(bad, str(tmp_path))
    assert files(tmp_path) == ["old.mid"] and (tmp_path / "old.mid").read_bytes() == before
    broken = pcm(spark, ["a", "b"]).withColumn("voice", F.when((F.col("song") == "b") & (F.col("frame0") > 9000), F.raise_error(F.lit("killed"))).otherwise(F.col("voice")))
    with pytest.raises(Exception, match="killed"):
        write_wav(broken, str(tmp_path))
    assert files(tmp_path) == ["old.mid"]


def test_overwrite_and_scattered_rows(spark, tmp_path):
    midi.write_midi(events(spark, ["a", "b"]), str(tmp_path))
    midi.write_midi(events(spark, ["c"]), str(tmp_path), "overwrite")
    assert files(tmp_path) == ["c.mid"]
    rows = events(spark, ["x"]).repartition(3)
    with pytest.raises(Exception, match="several tasks|MIDI|song"):
        rows.write.format("midi").mode("append").save(str(tmp_path))
    assert files(tmp_path) == ["c.mid"]

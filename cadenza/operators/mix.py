"""Sampled signals in chunks: gain, sum, peak, scaling, padding; groups of voices.

A signal is a table (song, voice, chunk, frame0, n_channels, samples): arrays of
interleaved 16-bit samples. No sample becomes a row. Mixes are made in Arrow batches: a task applies
gains and pans and adds what it has of a chunk before anything is shuffled, the shuffled parts of a chunk
are added as a sorted stream, and the sums are evaluated once and kept: the peak is a partial
aggregate over a number that was stored with them, and the scaled output is made from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import scalars as L
from cadenza.sources.shared import cut, give_back

CHUNK = 4096
TOP = 32767


def to_chunks(frames: DataFrame, n_channels: int = 1, size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """Chunks of rows (song, voice, frame, channel, sample); places without a row are 0.

    One shuffle by chunk brings the rows together; the gaps between them are filled within the array.
    ``tasks``: how many tasks share the chunks, where the number of a shuffle's partitions does not follow the input.
    """
    at = (F.col("frame") % size * n_channels + F.col("channel")).cast("int")
    own = frames.select("song", "voice", F.floor(F.col("frame") / size).alias("chunk"), at.alias("k"), F.col("sample").cast("long").alias("s"))
    own = own.repartition(*([tasks] if tasks else []), "song", "voice", "chunk")
    summed = own.groupBy("song", "voice", "chunk", "k").agg(F.sum("s").alias("s"))
    got = summed.groupBy("song", "voice", "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("a"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    filled = F.flatten(F.transform("a", lambda x, i: F.concat(zeros(x.k - F.coalesce(F.get("a", i - 1).k, F.lit(-1)) - 1), F.array(x.s))))
    tail = zeros(F.pmod(-F.size("filled"), F.lit(n_channels)))
    got = got.withColumn("filled", filled).withColumn("samples", F.concat("filled", tail))
    return got.select("song", "voice", "chunk", (F.col("chunk") * size).alias("frame0"), F.lit(n_channels).alias("n_channels"), "samples")


def peak(pcm: DataFrame) -> DataFrame:
    """(song, peak): the greatest absolute sample."""
    return pcm.groupBy("song").agg(F.max(F.array_max(F.transform("samples", lambda s: F.abs(s)))).alias("peak"))


def length(pcm: DataFrame) -> DataFrame:
    """(song, frames, voices): frames of the longest voice."""
    end = F.col("frame0") + F.size("samples") / F.col("n_channels")
    return pcm.groupBy("song").agg(F.max(end).cast("long").alias("frames"), F.count_distinct("voice").alias("voices"))


#: Bytes of sums that a task holds before it passes them on, and bytes of samples that it takes from an Arrow batch at a time.
HELD = 16 << 20
PIECE = 4 << 20
#: Rows of settings up to which they are broadcast: a row a voice of a song.
BROADCAST_VOICES = 200_000
_SUMS = "track string, chunk bigint, frame0 bigint, n_channels int, samples array<bigint>, top bigint"


def _few(df: DataFrame) -> DataFrame:
    """A broadcast of a table that is small by count."""
    return F.broadcast(df) if df.limit(BROADCAST_VOICES + 1).count() <= BROADCAST_VOICES else df


def _lists(column):
    """Arrays of a list column of samples, without copies."""
    import numpy as np

    ends = np.asarray(column.offsets)
    values, ends = np.asarray(column.values.slice(ends[0], ends[-1] - ends[0]).cast("int64")), ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _pieces(batches):
    """Slices of Arrow batches, of about ``PIECE`` bytes of samples each; a batch is let go before the next one is read."""
    import numpy as np

    for batch in batches:
        ends = np.asarray(batch.column("samples").offsets).astype(np.int64) * 8
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECE, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch, ends
        give_back()


def _add(total, x):
    """The sum of two signals, the shorter one as if zeros followed; ``total`` may be changed."""
    if len(total) < len(x):
        total, x = x.copy(), total
    total[: len(x)] += x
    return total


def _sums(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Sums by (song, track, chunk), with their greatest absolute sample ``top``, of rows (chunk, frame0, n_channels, samples, takes).

    ``takes`` says where a chunk goes: (song, track, left, right, gain), factors over 1024; without ``left`` it keeps its channels, else it becomes stereo.
    """
    song = rows.schema["takes"].dataType.elementType["song"].dataType
    schema = T.StructType([T.StructField("song", song), *T.StructType.fromDDL(_SUMS).fields])
    limit = HELD

    def batch_of(sums):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        keys = list(zip(*sums, strict=True))
        ends = np.cumsum([0, *map(len, sums.values())])
        top = [int(np.abs(x).max()) if len(x) else None for x in sums.values()]
        flat = np.concatenate(list(sums.values()))
        kinds = to_arrow_schema(schema)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(kinds.field("samples").type)
        return pa.RecordBatch.from_arrays([*(pa.array(k, kinds.types[i]) for i, k in enumerate(keys)), lists, pa.array(top, pa.int64())], schema=kinds)

    def parts(batches):
        import numpy as np

        sums, held = {}, 0
        for batch in _pieces(batches):
            cols = [batch.column(c).to_pylist() for c in ("chunk", "frame0", "n_channels", "takes")]
            for x, chunk, frame0, n, takes in zip(_lists(batch.column("samples")), *cols, strict=True):
                for t in takes:
                    y = x
                    if t["left"] is not None:
                        y = np.repeat(x, 2) if n == 1 else x.copy()
                        y[0::2] = (y[0::2] * t["left"]) >> 10
                        y[1::2] = (y[1::2] * t["right"]) >> 10
                    y = (y * t["gain"]) >> 10
                    key = (t["song"], t["track"], chunk, frame0, n if t["left"] is None else 2)
                    if key in sums:
                        sums[key] = _add(sums[key], y)
                    else:
                        sums[key] = y
                        held += y.nbytes
                if held > limit:
                    out, sums, held = batch_of(sums), {}, 0
                    yield out
                    del out
            del batch, x
        if sums:
            yield batch_of(sums)

    def streams(batches):
        """Rows that come sorted by chunk: of one chunk at a time."""
        now, held, done = None, 0, {}
        for batch in _pieces(batches):
            cols = [batch.column(c).to_pylist() for c in ("song", "track", "chunk", "frame0", "n_channels")]
            for x, *key in zip(_lists(batch.column("samples")), *cols, strict=True):
                key = tuple(key)
                if key != now:
                    if held > limit // 4:
                        out, done, held = batch_of(done), {}, 0
                        yield out
                        del out
                    now, done[key] = key, x.copy()
                    held += x.nbytes
                else:
                    done[key] = _add(done[key], x)
            del batch, x
        if done:
            yield batch_of(done)

    keys = ["song", "track", "chunk", "frame0", "n_channels"]
    part = rows.select("chunk", "frame0", "n_channels", "samples", "takes").mapInArrow(parts, schema)
    return part.repartition(*([tasks] if tasks else []), *keys[:3]).sortWithinPartitions(*keys).mapInArrow(streams, schema)


def _finished(sums: DataFrame, levels: DataFrame | None, amplification: float, low_peak: int) -> DataFrame:
    """Sums (song, chunk, frame0, n_channels, samples, top) scaled and clipped; they are evaluated once."""
    kept = cut(sums)
    tops = kept.groupBy("song").agg(F.max("top").alias("peak"))
    tops = tops if levels is None else tops.join(levels, "song", "left")
    level = F.lit(float(amplification)) if levels is None else F.coalesce("amplification", F.lit(float(amplification)))
    factor = F.when(F.col("peak") >= low_peak, F.lit(float(TOP)) * F.pow(F.lit(2.0), level / 6.0206) / F.col("peak")).otherwise(1.0)
    tops = _few(cut(tops.select(F.col("song").alias("_of"), factor.alias("_factor"))))
    rows = kept.join(tops, F.col("song").eqNullSafe(F.col("_of"))).drop("top", "_of")
    out = rows.drop("_factor").schema

    def scale(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _pieces(batches):
            lists = _lists(batch.column("samples"))
            flat = np.concatenate([*lists, np.zeros(0, np.int64)])
            factors = np.repeat(np.asarray(batch.column("_factor")), [len(x) for x in lists])
            flat = np.clip(np.rint(flat * factors), -TOP, TOP).astype(np.int64)  # halves to even
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            own = pa.ListArray.from_arrays(ends, pa.array(flat)).cast(batch.schema.field("samples").type)
            del lists, factors, flat
            yield pa.RecordBatch.from_arrays([own if n == "samples" else batch.column(n) for n in out.names], names=out.names)

    return rows.mapInArrow(scale, out)


def mix(pcm: DataFrame, settings: DataFrame, amplification: float = 0.0, low_peak: int = 3276, levels: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(song, chunk, frame0, n_channels, samples): voices with their gain (song, voice, volume in dB), summed, scaled and clipped.

    Gains are fixed point over 1024. A sum that reaches ``low_peak`` is scaled so that its
    peak becomes full scale times the amplification; a lower one is left alone.
    ``levels`` (song, amplification) has amplifications of single songs; ``tasks``: how many tasks share the sums.
    """
    gain = L.fixed_point(L.db_to_gain(F.coalesce("volume", F.lit(0.0)))).cast("long")
    own = _few(settings.select("song", "voice", gain.alias("_gain")))
    none = F.lit(None)
    take = F.struct(F.col("song"), none.cast("string").alias("track"), none.cast("long").alias("left"), none.cast("long").alias("right"), F.coalesce("_gain", F.lit(1024).cast("long")).alias("gain"))
    rows = pcm.join(own, ["song", "voice"], "left").withColumn("takes", F.array(take))
    return _finished(_sums(rows, tasks).drop("track"), levels, amplification, low_peak)


def pan_stereo(pcm: DataFrame, pans: DataFrame) -> DataFrame:
    """Stereo chunks with the left and right factors of (song, voice, pan); mono is doubled."""
    b = L.balance(F.coalesce("pan", F.lit(0.0)))
    own = pans.select("song", "voice", L.fixed_point(b.ll).cast("long").alias("_l"), L.fixed_point(b.rr).cast("long").alias("_r"))
    got = pcm.join(own, ["song", "voice"], "left")
    ll, rr = (F.coalesce(c, F.lit(1024).cast("long")) for c in ("_l", "_r"))
    side = lambda s, g: F.shiftright(s.cast("long") * g, 10)
    mono = F.flatten(F.transform("samples", lambda s: F.array(side(s, ll), side(s, rr))))
    stereo = F.transform("samples", lambda s, i: F.when(i % 2 == 0, side(s, ll)).otherwise(side(s, rr)))
    return got.withColumn("samples", F.when(F.col("n_channels") == 1, mono).otherwise(stereo)).withColumn("n_channels", F.lit(2)).drop("_l", "_r", "pan")


def mix_variants(groups: DataFrame) -> DataFrame:
    """(key, variant, members): every subset of an array ``groups``, in the order of its bits."""
    n = F.size("groups")
    bit = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1))
    got = groups.withColumn("variant", bit)
    return got.withColumn("members", F.filter("groups", lambda x, i: F.getbit("variant", i) == 1)).drop("groups")


#: Groups of a song beyond which their variants are refused: there are 2^n of them.
MAX_GROUPS = 20


def variant_peaks(pcm: DataFrame, members: DataFrame, tasks: int | None = None) -> DataFrame:
    """(song, variant, peak) of the mixes of all subsets of a song's groups; bit i of the variant is the i-th group in order.

    ``members``: (group, voice); a voice may be in several groups, a group that no voice of a song is in is none of its. Voices are summed by group once. Within a chunk
    the variants follow each other in Gray code, so that each is its neighbour with one group added or taken
    away; a chunk gives out a number a variant, and the peak is their greatest.
    """
    found = pcm.select("song", "voice").distinct().join(_few(members.select("group", "voice").distinct()), "voice")
    found = cut(found)
    order = found.groupBy("song").agg(F.array_sort(F.collect_set("group")).alias("groups"))
    order = cut(order)
    if not order.filter(F.size("groups") > MAX_GROUPS).isEmpty():
        raise ValueError(f"more than {MAX_GROUPS} groups in a song")
    none = F.lit(None).cast("long")
    take = F.struct(F.col("song"), F.col("group").alias("track"), none.alias("left"), none.alias("right"), F.lit(1024).cast("long").alias("gain"))
    takes = found.groupBy("song", "voice").agg(F.collect_list(take).alias("takes"))
    sums = _sums(pcm.join(_few(takes), ["song", "voice"]), tasks)
    rows = sums.groupBy("song", "chunk").agg(F.collect_list(F.struct("track", "samples")).alias("own")).join(_few(order), "song")  # at most MAX_GROUPS arrays
    schema = T.StructType([rows.schema["song"], T.StructField("variant", T.LongType()), T.StructField("top", T.LongType())])

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                song, own, names = (batch.column(c)[i].as_py() for c in ("song", "own", "groups"))
                length = max(len(x["samples"]) for x in own)
                group = np.zeros((len(names), length), np.int64)
                for x in own:
                    group[names.index(x["track"]), : len(x["samples"])] = x["samples"]
                now, code = np.zeros(length, np.int64), 0
                top = np.zeros(1 << len(names), np.int64)
                for step in range(1, 1 << len(names)):
                    bit = (step & -step).bit_length() - 1  # the bit in which a Gray code differs from the one before
                    code ^= 1 << bit
                    now = now + group[bit] if code >> bit & 1 else now - group[bit]
                    top[code] = np.abs(now).max()
                yield pa.RecordBatch.from_arrays([pa.array([song] * len(top), batch.schema.field("song").type), pa.array(np.arange(len(top))), pa.array(top)], names=["song", "variant", "top"])

    return rows.mapInArrow(walk, schema).groupBy("song", "variant").agg(F.max("top").alias("peak"))


def shift_padding(pcm: DataFrame, seconds: float, rate: int) -> DataFrame:
    """Prefix silence by moving the frame offsets; no sample moves."""
    n = round(rate * seconds)
    return pcm.withColumn("frame0", F.col("frame0") + n)


def shift_cues(cues: DataFrame, seconds: float) -> DataFrame:
    ms = round(seconds * 1000)
    return cues.withColumns({"start_ms": F.col("start_ms") + ms, "end_ms": F.col("end_ms") + ms})


def rechunk(pcm: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks on the grid of ``size`` frames again, after frame offsets have moved: slices of the old chunks, joined in order, with zeros where no chunk is."""
    end = F.col("frame0") + F.floor(F.size("samples") / F.col("n_channels")) - 1
    part = pcm.filter(F.size("samples") > 0).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("frame0") / size), F.floor(end / size))))
    first = F.greatest(F.col("frame0"), F.col("chunk") * size)
    start, stop = (first - F.col("frame0")) * F.col("n_channels"), ((F.col("chunk") + 1) * size - F.col("frame0")) * F.col("n_channels")
    cut = F.slice("samples", (start + 1).cast("int"), (F.least(stop, F.size("samples")) - start).cast("int"))
    part = part.select("song", "voice", "n_channels", "chunk", F.struct(first.alias("frame"), cut.alias("samples")).alias("x"))
    got = part.groupBy("song", "voice", "n_channels", "chunk").agg(F.array_sort(F.collect_list("x")).alias("a"))
    got = got.withColumn("frame0", F.get("a", F.lit(0)).frame)
    # a chunk may end before the next one begins: zeros lie between
    zeros = lambda have, x: F.array_repeat(F.lit(0).cast("long"), ((x.frame - F.col("frame0")) * F.col("n_channels") - F.size(have)).cast("int"))
    joined = F.aggregate("a", F.array().cast("array<bigint>"), lambda have, x: F.concat(have, zeros(have, x), x.samples.cast("array<bigint>")))
    return got.select("song", "voice", "n_channels", "chunk", "frame0", joined.alias("samples"))


def intersect_voices(a: DataFrame, b: DataFrame, keys: tuple = ("song", "voice")) -> DataFrame:
    """The voices, once each, that both have."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")


def subtract_voices(a: DataFrame, b: DataFrame, keys: tuple = ("song", "voice")) -> DataFrame:
    """The voices, once each, of the first that the second lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def expand_groups(audio_tracks: DataFrame, groups: DataFrame, voices: DataFrame) -> DataFrame:
    """(song, track, voice): an audio track's groups to their voices, once each, of those that a song (song, voice) has; unknown groups vanish."""
    got = audio_tracks.select("track", F.explode("groups").alias("group")).join(groups.select("group", "voice").distinct(), "group").select("track", "voice").distinct()
    return voices.select("song", "voice").distinct().join(got, "voice").select("song", "track", "voice")


def fill_template(template: Column, value: Column) -> Column:
    """``$`` in a file template becomes the value."""
    return F.replace(template, F.lit("$"), value)


def fill_pan(mix: DataFrame, voices: DataFrame) -> DataFrame:
    """A missing pan comes from the voice, else it is 0."""
    return mix.join(voices.select("voice", F.col("pan").alias("_pan")), "voice", "left").withColumn("pan", F.coalesce("pan", "_pan", F.lit(0.0))).drop("_pan")


def add_parallel_track(mix: DataFrame, extra: DataFrame) -> DataFrame:
    """One more source with its own volume, in the centre."""
    return mix.unionByName(extra.withColumn("pan", F.lit(0.0)))


def mixdown(pcm: DataFrame, audio_tracks: DataFrame, groups: DataFrame, voices: DataFrame, settings: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Mixes of all audio tracks: groups expanded, settings and pans filled and applied, voices summed.

    Audio tracks: (track, groups[, amplification]); voices: (song, voice, pan); ``settings``: (track, voice, volume,
    pan), where a missing row is 0 dB and a missing pan is the voice's. The result has a song per (song, track).
    A chunk is read once for all tracks that it goes to. ``tasks``: how many tasks share the sums.
    """
    pairs = audio_tracks.select("track", F.explode("groups").alias("group")).join(groups.select("group", "voice").distinct(), "group").select("track", "voice").distinct()
    if settings is None:
        pairs = pairs.withColumns({"volume": F.lit(0.0), "pan": F.lit(None).cast("double")})
    else:
        pairs = pairs.join(settings.select("track", "voice", "volume", "pan"), ["track", "voice"], "left")
    pairs = _few(cut(pairs.withColumnRenamed("pan", "_pan")))
    chosen = voices.select("song", "voice", "pan").join(pairs, "voice")
    b = L.balance(F.coalesce("_pan", "pan", F.lit(0.0)))
    factor = lambda c: L.fixed_point(c).cast("long")
    name = F.concat_ws("/", F.col("song").cast("string"), "track")
    take = F.struct(name.alias("song"), F.col("track"), factor(b.ll).alias("left"), factor(b.rr).alias("right"), factor(L.db_to_gain(F.coalesce("volume", F.lit(0.0)))).alias("gain"))
    takes = _few(cut(chosen.groupBy("song", "voice").agg(F.collect_list(take).alias("takes"))))
    sums = _sums(pcm.join(takes, ["song", "voice"]), tasks)
    levels = None
    if "amplification" in audio_tracks.columns:
        songs = takes.select(F.explode("takes").alias("t")).select("t.song", "t.track").distinct()
        levels = songs.join(_few(audio_tracks.select("track", "amplification")), "track").select("song", "amplification")
    return _finished(sums.drop("track"), levels, 0.0, 3276)

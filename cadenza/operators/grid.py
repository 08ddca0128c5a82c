"""Measure grids, as-of fills, music time, durations and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as L


def fill_forward(points: DataFrame, changes: DataFrame, keys: Sequence[str], at: str, since: str, value: str, default=None, out: str | None = None, tasks: int | None = None) -> DataFrame:
    """Give every point the value of the last change at or before it (``default`` before the first).

    Both sides are sorted once by (keys, time), changes first, and the last
    value is carried on; there is no theta join, and the exchange is the one that
    later windows over the same keys use. ``tasks``: how many tasks share the keys,
    where the number of a shuffle's partitions does not follow the input.
    """
    out = out or value
    left = points.withColumn("_point", F.lit(1))
    right = changes.select(*keys, F.col(since).cast(points.schema[at].dataType).alias(at), F.struct(F.col(value).alias("v")).alias("_change"), F.lit(0).alias("_point"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.repartition(tasks, *keys) if tasks else both
    order = W.partitionBy(*keys).orderBy(at, "_point").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = F.last("_change", ignorenulls=True).over(order)
    filled = both.withColumn("_got", got).filter("_point = 1")
    return filled.withColumn(out, F.when(F.col("_got").isNull(), F.lit(default)).otherwise(F.col("_got.v"))).drop("_got", "_point", "_change")


def measure_grid(signatures: DataFrame, lasts: DataFrame, tpq: int = 96, count_in: int = 0) -> DataFrame:
    """(song, measure, t_start, t_end) from signatures (song, time, num, den) and (song, last_time).

    A signature counts only at a measure start and up to the last event; of
    equal times the last counts. The few signatures of a song are folded as an
    array, the measures are generated per segment.
    """
    ticks = lambda x: F.bround(F.bround(x.num * 4.0 / x.den, 3) * tpq).cast("long")
    sigs = signatures.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("time", "num", "den"))).alias("sigs"))
    base = lasts.select("song", F.col("last_time").cast("long").alias("last_time")).join(sigs, "song", "left")
    first = F.struct(F.lit(0).cast("long").alias("t0"), F.lit(1 - count_in).cast("long").alias("m0"), F.lit(4 * tpq).cast("long").alias("ticks"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        past = x.time.cast("long") - last.t0
        ok = (x.time <= F.col("last_time")) & (past >= 0) & (past % last.ticks == 0)
        new = F.struct(x.time.cast("long").alias("t0"), (last.m0 + F.floor(past / last.ticks)).cast("long").alias("m0"), ticks(x).alias("ticks"))
        kept = F.when(past == 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(ok, F.concat(kept, F.array(new))).otherwise(acc)

    folded = base.withColumn("segs", F.aggregate(F.coalesce("sigs", F.array().cast("array<struct<time:bigint,num:bigint,den:bigint>>")), F.array(first), step))
    seg = folded.select("song", "last_time", "segs", F.posexplode("segs").alias("i", "s"))
    until = F.get("segs", F.col("i") + 1).t0
    n = F.coalesce(F.floor((until - F.col("s.t0")) / F.col("s.ticks")), F.floor((F.col("last_time") - F.col("s.t0")) / F.col("s.ticks")) + 2).cast("long")
    row = seg.select("song", "s", until.isNull().alias("tail"), n.alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    start = F.col("s.t0") + F.col("k") * F.col("s.ticks")
    return row.select("song", (F.col("s.m0") + F.col("k")).alias("measure"), start.alias("t_start"), F.when(~(F.col("tail") & (F.col("k") == F.col("n") - 1)), start + F.col("s.ticks")).alias("t_end"))


def locate_measure(events: DataFrame, grid: DataFrame, at: str = "midi_time", tasks: int | None = None) -> DataFrame:
    """Add measure and t_start of the grid's measure with t_start <= time < t_end."""
    starts = grid.withColumn("_m", F.struct("measure", "t_start", "t_end"))
    out = fill_forward(events, starts, ["song"], at, "t_start", "_m", None, "_m", tasks)
    return out.withColumns({"measure": F.col("_m.measure"), "t_start": F.col("_m.t_start"), "t_end": F.col("_m.t_end")}).drop("_m")


def music_time(time: Column, measure: Column, t_start: Column, tpq: int) -> Column:
    """Struct (measure, quarter, sixteenth, remainder) of a time, all counted from 1."""
    off = time - t_start
    return F.struct(
        measure.cast("int").alias("measure"), (F.floor(off / tpq) + 1).cast("int").alias("quarter"),
        (F.floor(off % tpq / (tpq // 4)) + 1).cast("int").alias("sixteenth"), (off % (tpq // 4) + 1).cast("int").alias("remainder"),
    )


def duration_time(ticks: Column, measure_ticks: int, tpq: int) -> Column:
    """Struct of a duration, counted from 0; negative durations divide toward zero."""
    part = lambda unit, size: (F.signum(ticks) * F.floor(F.abs(ticks) % size / unit)).cast("int")
    return F.struct(
        (F.signum(ticks) * F.floor(F.abs(ticks) / measure_ticks)).cast("int").alias("measure"), part(tpq, measure_ticks).alias("quarter"),
        (F.signum(ticks) * F.floor(F.abs(ticks) % measure_ticks % tpq / (tpq // 4))).cast("int").alias("sixteenth"),
        (F.signum(ticks) * (F.abs(ticks) % measure_ticks % tpq % (tpq // 4))).cast("int").alias("remainder"),
    )


def to_ticks(time: Column, t_start: Column, tpq: int) -> Column:
    """Ticks of a music time whose measure starts at ``t_start``."""
    return t_start + (time.quarter - 1) * tpq + (time.sixteenth - 1) * (tpq // 4) + (time.remainder - 1)


def match_position(offset: Column, measure_ticks: Column, style: dict, tpq: int) -> Column:
    """Index of the first style position within half a raster of the offset, with wrap at the measure's end; null is OTHER."""
    half = F.bround(F.lit(4.0 * tpq * style["raster"] / 2)).cast("long")
    places = F.array(*(F.bround(F.lit(4.0 * tpq * p["position"])).cast("long") for p in style["positions"]))
    near = lambda d: F.abs(d) <= half
    hits = F.filter(F.transform(places, lambda p, i: F.when(near(offset - p) | near(offset - measure_ticks - p), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def page_durations(pages: DataFrame, measures: DataFrame) -> DataFrame:
    """(song, page, seconds): sum of measure durations from a page's first measure to the next page's.

    The first page starts at the song's first measure; the last, artificial, page gives no row.
    """
    w = W.partitionBy("song").orderBy("page")
    first = pages.withColumn("first_measure", F.when(F.row_number().over(w) == 1, F.lit(-(2**31))).otherwise(F.col("first_measure")))
    first = first.withColumn("_last", F.lead("page").over(w).isNull()).withColumn("_p", F.struct("page", "_last"))
    on = fill_forward(measures, first, ["song"], "measure", "first_measure", "_p", None, "_p")
    return on.filter(~F.col("_p._last")).groupBy("song", F.col("_p.page").alias("page")).agg(F.sum("seconds").alias("seconds"))


def cumulative_timeline(durations: DataFrame, gap: float = 0.95) -> DataFrame:
    """(song, measure, start, end) of measures from 1 on: start is the sum of earlier durations."""
    w = W.partitionBy("song").orderBy("measure").rowsBetween(W.unboundedPreceding, -1)
    out = durations.filter("measure >= 1").withColumn("start", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)))
    return out.withColumn("end", F.col("start") + gap * F.col("seconds"))


def quantize(durations: DataFrame, fps: float, order: str = "page") -> DataFrame:
    """Add ``frames``: whole frames of each duration, the remainder carried on."""
    w = W.partitionBy("song").orderBy(order)
    total = F.floor(F.round(F.sum("seconds").over(w.rowsBetween(W.unboundedPreceding, 0)) * fps, 6))
    return durations.withColumn("_t", total).withColumn("frames", (F.col("_t") - F.coalesce(F.lag("_t").over(w), F.lit(0))).cast("long")).drop("_t")


def absolute_time(deltas: DataFrame) -> DataFrame:
    w = W.partitionBy("song", "track").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumn("midi_time", F.sum("delta").over(w))


def delta_time(events: DataFrame) -> DataFrame:
    """Add ``delta`` to the event before in the track, and ``bad`` where time decreases."""
    w = W.partitionBy("song", "track").orderBy("seq")
    out = events.withColumn("delta", F.col("midi_time") - F.coalesce(F.lag("midi_time").over(w), F.lit(0)))
    return out.withColumn("bad", F.col("delta") < 0)


def style_in_force(points: DataFrame, changes: DataFrame, default: str = "default", tasks: int | None = None) -> DataFrame:
    """Add ``style`` to (song, measure) from (song, from_measure, style).

    Entries from measure 1 on are carried to later measures; measures up to 1 have a style only by an
    entry of their own.
    """
    own = changes.filter("from_measure <= 1").select("song", F.col("from_measure").cast(points.schema["measure"].dataType).alias("measure"), F.col("style").alias("_own"))
    got = fill_forward(points.join(own, ["song", "measure"], "left"), changes.filter("from_measure >= 1"), ["song"], "measure", "from_measure", "style", default, tasks=tasks)
    return got.withColumn("style", F.when(F.col("measure") <= 1, F.coalesce("_own", F.lit(default))).otherwise(F.col("style"))).drop("_own")


def measure_durations(measures: DataFrame, tempos: DataFrame, count_in: int = 0, quarters: float = 4.0) -> DataFrame:
    """Add ``seconds`` to (song, measure) from the tempo in force; measure 1 also lasts for the count-in.

    Tempo entries at a fraction of a measure never match.
    """
    tempos = tempos.filter(F.col("from_measure") == F.floor("from_measure"))
    on = fill_forward(measures, tempos, ["song"], "measure", "from_measure", "tempo", 120.0)
    sec = L.measure_seconds(F.col("tempo"), F.lit(quarters))
    return on.withColumn("seconds", F.when(F.col("measure") == 1, sec * (1 + count_in)).otherwise(sec))


def in_order(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Rows in ascending order of keys and order, for output: sampled ranges of both become partitions, each sorted within, so a hot key is many of them."""
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def write_in_order(df: DataFrame, path: str, keys: list, order: list) -> None:
    """Parquet files whose rows ascend within a file and from file to file."""
    in_order(df, keys, order).write.parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of written files with ``place``, from 1, in the order in which they were written: by number of the file and place within it."""
    nth = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select("*", nth.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    sizes = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes, "_file").withColumn("place", F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before", "_n")

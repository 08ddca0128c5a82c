"""Cue timelines from tempo maps and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid as G


def cues(durations: DataFrame) -> DataFrame:
    """(song, n, start_ms, end_ms, text): a cue per measure, in whole milliseconds."""
    line = G.cumulative_timeline(durations)
    ms = lambda c: F.floor(F.round(F.col(c) * 1000, 6)).cast("long")
    return line.select("song", F.col("measure").cast("int").alias("n"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.col("measure").cast("string").alias("text"))


def timeline(measures: DataFrame, tempos: DataFrame, pages: DataFrame, count_in: int = 0, fps: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """(cues, page frames) of songs."""
    d = G.measure_durations(measures, tempos, count_in)
    return cues(d), G.quantize(G.page_durations(pages, d), fps)

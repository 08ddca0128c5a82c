"""Trace logs: spans, nesting and elapsed time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .along import along


def span_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse ``>>f (HHMMSS.mmm) [thread] text`` lines: add mark, func, ms, thread, depth_delta; other lines go."""
    pat = r"^(>>|<<|--)\s*([\w.]+)\s*\((\d{2})(\d{2})(\d{2})\.(\d{1,3})\)\s*(?:\[([^\]]*)\])?\s*(.*)$"
    g = lambda i: F.regexp_extract(line, pat, i)
    got = lines.filter(F.col(line).rlike(pat))
    ms = ((g(3).cast("long") * 60 + g(4).cast("long")) * 60 + g(5).cast("long")) * 1000 + F.rpad(g(6), 3, "0").cast("long")
    return got.withColumns({"mark": g(1), "func": g(2), "ms": ms, "thread": g(7), "text": g(8), "depth_delta": F.when(g(1) == ">>", 1).when(g(1) == "<<", -1).otherwise(0)})


def pair_spans(log: DataFrame, part: str | None = None) -> DataFrame:
    """(thread, seq, end_seq, depth, elapsed, has_children) of rows (thread, seq, ts, begin).

    Begins and ends nest; an end without an open begin is dropped; a begin without an end closes at the end of
    the thread's log. ``part`` names consecutive ranges of a thread's log: depths and partners are then found within ranges from what the
    ranges before are worth (their balance, their lowest point, their first event at a depth), so that
    the log of one thread is many tasks.
    """
    run = along(log.withColumn("_step", F.when(F.col("begin"), 1).otherwise(-1)), ["thread"], part, "seq", _s=("sum", "_step"))
    run = along(run, ["thread"], part, "seq", _min=("min", "_s"), _min_before=("min_before", "_s"))
    # the deepest fall below zero so far counts the ends without a begin
    low, low_before = F.least("_min", F.lit(0)), F.least(F.coalesce("_min_before", F.lit(0)), F.lit(0))
    run = run.withColumn("_low", low).filter(F.col("begin") | (low >= low_before))
    run = run.withColumn("depth", F.col("_s") - F.col("_low") + F.when(F.col("begin"), 0).otherwise(1))
    run = along(run, ["thread", "depth"], part, "seq", _partner=("lead", F.struct("seq", "ts")))
    run = along(run, ["thread"], part, "seq", _next=("lead", "begin"))
    last = run.groupBy("thread").agg(F.max("ts").alias("_last"))
    run = run.filter("begin").join(last, "thread")
    end = F.coalesce("_partner.ts", "_last") - F.col("ts")
    return run.select("thread", "seq", F.col("_partner.seq").alias("end_seq"), F.col("depth").cast("int").alias("depth"), end.alias("elapsed"), F.coalesce("_next", F.lit(False)).alias("has_children"))

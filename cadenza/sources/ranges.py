"""Text files read by byte ranges, so that a file may be larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import relative

#: Ranges up to which their line counts are broadcast.
BROADCAST_RANGES = 200_000


def range_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, linenum, line) of the text files below a folder; ``part`` is the first byte of the range that a line is read with.

    Spark's own text reader cuts a file into ranges of ``spark.sql.files.maxPartitionBytes`` and reads each
    from its first whole line. A first pass counts the lines of every range; a line's number
    is the count of the ranges before its own and its place within it. No line is shuffled. Both passes plan the same ranges.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows = text.select(
        relative(F.col("_metadata.file_path"), path).alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("_nth"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    counts = rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("file", "part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    counts = F.broadcast(counts) if counts.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else counts
    met = rows.join(counts, ["file", "part"])
    return met.select("file", "part", (F.col("_before") + F.col("_nth") - F.col("_first") + 1).cast("long").alias("linenum"), "line")

"""Readers and writers of multi-table text, relaxed JSON and subtitle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as L
from cadenza.operators.text import multi_tables

from .settings_files import file_lines, whole_files


def read_multi_table_tsv(spark: SparkSession, path: str, marker: str = r"^TABLE (\w+)", comment: str = r"^\s*#", sep: str = "\t") -> DataFrame:
    """(file, table, linenum, fields, bad) of the files below a folder."""
    return multi_tables(file_lines(spark, path), marker, comment, sep, "file")


def read_relaxed_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, bad) of the files below a folder."""
    return relaxed_json(whole_files(spark, path))


def relaxed_json(files: DataFrame) -> DataFrame:
    """(file, value, bad) of files (file, value): JSON with unquoted keys, ``--`` comments, ``#define NAME value`` lines and optional outer braces.

    The value is a VARIANT; a broken file is an empty object and ``bad``. A defined name is replaced where it stands as a value.
    """
    word = r"[A-Za-z_]\w*"
    quiet = F.regexp_replace("value", r'(?m)("(?:[^"\\]|\\.)*+")|--.*$', "$1")
    define = rf"(?m)^[ \t]*#define[ \t]+({word})[ \t]+(.*?)[ \t]*$"
    defined = F.map_from_arrays(F.array_distinct(F.regexp_extract_all(quiet, F.lit(define), F.lit(1))), F.transform(F.array_distinct(F.regexp_extract_all(quiet, F.lit(define), F.lit(1))), lambda n: F.element_at(F.regexp_extract_all(quiet, F.concat(F.lit(r"(?m)^[ \t]*#define[ \t]+"), n, F.lit(r"[ \t]+(.*?)[ \t]*$")), F.lit(1)), -1)))
    plain = F.regexp_replace(quiet, r"(?m)^[ \t]*#define\b.*$", "")
    token = F.regexp_extract_all(plain, F.lit(rf'"(?:[^"\\]|\\.)*+"|{word}|[^"A-Za-z_]+|"'), F.lit(0))
    parts = files.select("file", defined.alias("d"), token.alias("t"))
    key = lambda i: F.coalesce(F.get("t", i + 1).rlike(r"^\s*:"), F.lit(False))
    shown = F.transform("t", lambda x, i: F.when(~x.rlike("^[A-Za-z_]"), x).when(key(i), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.coalesce(F.try_element_at("d", x), x)))
    body = F.regexp_replace(F.array_join(shown, ""), r"^\s+|\s+$", "")
    braced = F.when(body.startswith("{") | body.startswith("["), body).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    got = F.try_parse_json(braced)
    return parts.select("file", F.coalesce(got, F.parse_json(F.lit("{}"))).alias("value"), got.isNull().alias("bad"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(song, n, start_ms, end_ms, text) of the cue files below a folder; the song is the file's path without its suffix."""
    return srt_cues(file_lines(spark, path))


def srt_cues(lines: DataFrame) -> DataFrame:
    """(song, n, start_ms, end_ms, text) of the cue blocks in lines (file, linenum, line)."""
    lines = lines.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))
    w = W.partitionBy("file").orderBy("linenum")
    starts = F.coalesce(F.lead("line").over(w).contains("-->"), F.lit(False)) & F.col("line").rlike(r"^\d+\s*$")
    got = lines.withColumn("_s", starts).withColumn("_c", F.sum(F.col("_s").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_c > 0 and trim(line) != ''")
    cue = got.groupBy("file", "_c").agg(F.array_sort(F.collect_list(F.struct("linenum", "line"))).alias("a"))
    part = lambda i: F.get("a", F.lit(i)).line
    time = lambda i: L.srt_parse(F.trim(F.get(F.split(part(1), "-->"), F.lit(i))))
    text = F.array_join(F.transform(F.slice("a", F.lit(3), F.greatest(F.size("a") - 2, F.lit(0))), lambda x: x.line), "\n")
    return cue.select(F.regexp_replace("file", r"\.srt$", "").alias("song"), F.trim(part(0)).cast("int").alias("n"), time(0).alias("start_ms"), time(1).alias("end_ms"), text.alias("text"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One file per song, cues in order, by Spark's text sink partitioned by song."""
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(L.srt_format(F.col("start_ms")), F.lit(" --> "), L.srt_format(F.col("end_ms"))), "text", F.lit(""))
    (cues.select("song", "n", block.alias("value")).repartition("song").sortWithinPartitions("song", "n").select("song", "value")
     .write.partitionBy("song").text(path))

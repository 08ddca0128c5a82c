"""Text tables: logical lines, sections, marker scans, several tables in one file.

A file whose lines do not fit a task comes in ranges of lines (column ``part``), as ``cadenza.sources.ranges``
reads it; what is open at the end of a range is carried into the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .along import along


def logical_lines(lines: DataFrame, start: str, comment: str = r"^\s*--", file: str = "doc_id", part: str | None = None) -> DataFrame:
    """(file, linenum, text): a line that matches ``start`` opens a logical line, a blank one ends it.

    Comments go, a trailing backslash is removed, the parts are joined by one space; text
    before the first start is dropped.
    """
    keep = lines.filter(~F.col("line").rlike(comment)).withColumn("_blank", F.trim("line") == "").withColumn("_start", F.col("line").rlike(start))
    keep = along(keep, [file], part, "linenum", _island=("sum", F.when(F.col("_start") | F.col("_blank"), 1).otherwise(0))).filter("not _blank")
    part = F.trim(F.regexp_replace("line", r"\\\s*$", ""))
    got = keep.groupBy(file, "_island").agg(F.min("linenum").alias("linenum"), F.max("_start").alias("_start"), F.array_sort(F.collect_list(F.struct("linenum", part.alias("p")))).alias("a"))
    return got.filter("_start").select(file, "linenum", F.array_join(F.transform("a", lambda x: x.p), " ").alias("text"))


def section_fill(lines: DataFrame, marker: str, file: str = "doc_id", part: str | None = None) -> DataFrame:
    """Add ``section``, the last line that matched the marker, and ``is_heading`` for the line right after one."""
    mark = F.when(F.col("line").rlike(marker), F.col("line"))
    got = along(lines.withColumn("_m", mark), [file], part, "linenum", section=("last", "_m"), is_heading=("lag", "_m"))
    return got.withColumn("is_heading", F.col("is_heading").isNotNull()).drop("_m")


def multi_tables(lines: DataFrame, marker: str = r"^TABLE (\w+)", comment: str = r"^\s*#", sep: str = "\t", file: str = "doc_id", part: str | None = None) -> DataFrame:
    """(file, table, linenum, fields, bad): rows of the tables in a text file.

    A marker line names a table, the next line is its heading. A line that ends in an
    open quoted field is joined with those up to the line that closes it; comment and blank lines
    are skipped; a row of another width than the heading keeps the common prefix and is flagged.
    """
    keep = lines.filter(~F.col("line").rlike(comment) & (F.trim("line") != ""))
    opens, neutral = F.col("line").rlike("\t\" *[^\t \"][^\t\"]*$"), ~F.col("line").rlike("[\t\"]")
    keep = keep.withColumn("_s", F.when(opens, True).when(~neutral, False))
    keep = along(keep, [file], part, "linenum", _inside=("last_before", "_s"))
    keep = along(keep, [file], part, "linenum", _g=("sum", F.when(F.coalesce("_inside", F.lit(False)), 0).otherwise(1)))
    first = [F.min(part).alias(part)] if part else []  # a joined line belongs to the range of its first
    whole = keep.groupBy(file, "_g").agg(F.min("linenum").alias("linenum"), *first, F.array_sort(F.collect_list(F.struct("linenum", "line"))).alias("a"))
    whole = whole.select(file, *([part] if part else []), "linenum", F.array_join(F.transform("a", lambda x: x.line), "\n").alias("line"))
    hit = F.regexp_extract("line", marker, 1)
    whole = whole.withColumn("_n", F.when(hit != "", hit))
    named = along(whole, [file], part, "linenum", table=("last", "_n"), _above=("lag", "_n"))
    named = named.withColumn("_head", F.when(F.col("_above").isNotNull() & F.col("_n").isNull(), F.split("line", sep)))
    named = along(named, [file], part, "linenum", _names=("last", "_head"))
    rows = named.filter(F.col("_n").isNull() & F.col("_head").isNull() & F.col("table").isNotNull()).withColumn("_v", F.transform(F.split("line", sep), lambda v: F.regexp_replace(v, r'(?s)^ *"(.*)" *$', "$1")))
    n = F.least(F.size("_names"), F.size("_v"))
    return rows.select(file, "table", "linenum", F.map_from_arrays(F.slice("_names", F.lit(1), n), F.slice("_v", F.lit(1), n)).alias("fields"), (F.size("_names") != F.size("_v")).alias("bad"))


def scan_sections(lines: DataFrame, page_re: str, color_re: str, font_re: str, digit_re: str, glyph_re: str, tail: int = 8, file: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """(file, page, first_measure) by a marker scan.

    Inside a page a colour line, then a font line, open a number whose digits follow one
    per line, least significant first; the line after the digits must match ``glyph_re``. A
    number counts only if it exceeds every earlier accepted one. A page's value is its
    least number, the first page's is 1, and an extra last page has the greatest plus ``tail``.
    ``tasks``: how many tasks share the files, where the number of a shuffle's partitions does not follow the input.
    """
    w = W.partitionBy(file).orderBy("linenum")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    # what a line is goes to the file's task, not the line; one order serves all windows
    digit = F.regexp_extract("line", digit_re, 1)
    at = F.regexp_extract("line", page_re, 1)
    own = lines.select(
        file, "linenum", F.when(at != "", at.try_cast("int")).alias("_at"), F.col("line").rlike(color_re).alias("_color"), F.col("line").rlike(font_re).alias("_font"),
        F.when(digit != "", digit.try_cast("long")).alias("_d"), F.col("line").rlike(glyph_re).alias("_glyph"),
    )
    own = own.repartition(tasks, file) if tasks else own
    got = own.select(file, "linenum", F.last("_at", ignorenulls=True).over(upto).alias("page"), "_color", "_font", "_d", "_glyph").filter("page is not null")
    got = got.withColumns({"_font": F.col("_font") & F.coalesce(F.lag("_color").over(w), F.lit(False)), "_n": F.row_number().over(w)})
    got = got.withColumn("_d", F.when(~F.col("_font"), F.col("_d"))).withColumn("_opened", F.col("_d").isNotNull() & F.coalesce(F.lag("_font").over(w), F.lit(False)))
    # a run is digits and the line behind them; its number is the place of the last other line before
    got = got.withColumn("_run", F.coalesce(F.last(F.when(F.col("_d").isNull(), F.col("_n")), ignorenulls=True).over(before), F.lit(0))).withColumn("_k", F.col("_n") - F.col("_run"))
    got = got.filter("_d is not null or _k > 1")
    runs = got.groupBy(file, "_run").agg(
        F.sum(F.when(F.col("_d").isNotNull(), F.col("_d") * F.pow(F.lit(10.0), F.col("_k") - 1).cast("long"))).alias("number"), F.max("_opened").alias("_opened"),
        F.max(F.col("_d").isNull() & F.col("_glyph")).alias("_closed"), F.min("linenum").alias("linenum"), F.min("page").alias("page"),
    ).filter("_opened and _closed and number is not null")
    w2 = W.partitionBy(file).orderBy("linenum")
    # a number that does not exceed an earlier one cannot raise the running maximum, so the maximum over all earlier numbers is that over the accepted ones
    good = runs.withColumn("_top", F.max("number").over(w2.rowsBetween(W.unboundedPreceding, -1))).filter("_top is null or number > _top")
    value = good.groupBy(file, "page").agg(F.min("number").alias("first_measure"), F.max("number").alias("_max"))
    per = value.select(file, "page", F.when(F.col("page") == 1, F.lit(1).cast("long")).otherwise(F.col("first_measure")).alias("first_measure"))
    last = per.groupBy(file).agg((F.max("page") + 1).alias("page"), (F.max("first_measure") + tail).alias("first_measure"))
    return per.unionByName(last)


def defined_names(lines: DataFrame, pattern: str = r"^ *([A-Za-z]+) *=", file: str = "doc_id") -> DataFrame:
    """Distinct (file, name) that lines define."""
    return lines.select(file, F.regexp_extract("line", pattern, 1).alias("name")).filter("name != ''").distinct()

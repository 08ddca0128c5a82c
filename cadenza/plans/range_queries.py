"""Queries over files, logs and songs that are cut into ranges of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import spans as P
from cadenza.operators import text as X
from cadenza.sources.ranges import range_lines
from cadenza.sources.shared import cut, new_folder, remove

from . import text_queries
from .bindings import bound, duck
from .registry import oracle_sql, query

#: Lines of a range in the bound tables.
LINES = 20
_SQL = oracle_sql()


def _ranged(spark, sf):
    return bound(spark, sf, "lines").withColumn("part", F.expr(f"(linenum - 1) div {LINES}"))


@query("logical_lines_by_range", _SQL["logical_lines"])
def _logical(spark, sf):
    return X.logical_lines(_ranged(spark, sf), ",", part="part")


@query("section_fill_by_range", _SQL["section_fill"])
def _section(spark, sf):
    return X.section_fill(_ranged(spark, sf), r"(?s)^.{0,39}$", part="part").select("doc_id", "linenum", "section", "is_heading")


@query("multi_tables_by_range", _SQL["multi_tables"])
def _tables(spark, sf):
    t = _ranged(spark, sf).select("doc_id", "linenum", "part", F.expr(text_queries._TSV_SPARK).alias("line"))
    return X.multi_tables(t, part="part").select("doc_id", "table", "linenum", *(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")).alias(k) for k in "abc"), "bad")


@query("pair_spans_by_range", _SQL["pair_spans"])
def _spans(spark, sf):
    """Turns of a conversation begin and end spans; four turns are a range."""
    log = text_queries.turn_log(spark, sf).withColumn("part", F.expr("seq div 4"))
    return P.pair_spans(log, "part").withColumn("end_seq", F.coalesce("end_seq", F.lit(-1)))


@query("range_lines", duck("lines") + """, n as (select doc_id // 100 as g, line, row_number() over (partition by doc_id // 100 order by doc_id, linenum) as n from lines)
select g, count(*) as lines, sum(length(line))::bigint as chars, sum(n * length(line))::bigint as weight from n group by g""")
def _files(spark, sf):
    """The texts of every hundred documents written as a text file, read back by ranges of bytes."""
    folder = new_folder(spark, "texts")
    d = bound(spark, sf, "documents").select(F.expr("doc_id div 100").alias("g"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("g").sortWithinPartitions("g", "doc_id").select("g", "value").write.partitionBy("g").text(folder)
    size = F.char_length("line")
    got = range_lines(spark, folder).groupBy(F.regexp_extract("file", r"g=(\d+)/", 1).cast("long").alias("g")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(size).cast("long").alias("chars"), F.sum(F.col("linenum") * size).alias("weight")
    )
    out = cut(got)
    remove(spark, folder)
    return out

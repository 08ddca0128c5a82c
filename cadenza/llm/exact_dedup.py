"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted; null counts as empty. The first scan counts the
normalised lengths. The second takes the prefix hash of the rows whose length occurs more
than once, and only the (length, prefix) pairs that occur more than once survive. The third takes the full
SHA-256 of the rows of surviving pairs alone; all others are known to be
unique without it. Groups are only ever counted and minimised, with map-side
partial aggregation, and the rows of the largest ones meet their group by a
broadcast of bounded size, so a group that holds a third of all rows is no hot task.

Defined results: null and empty texts are equal to each other; of equal texts
the row with the most code points in the original text, then the smallest id (a
null id before all), stays; rows that repeat the id and size of the row that
stays cannot be told from it and are marked as kept with it (``drop_exact`` keeps one of them); other columns are
ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, join_groups, keep_rows, row_digest

#: Surviving (length, prefix) pairs up to which they are broadcast: 16 bytes each.
BROADCAST_PREFIXES = 500_000


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
    digest_all: bool = False, broadcast_limit: int = BROADCAST_PREFIXES, row_digests: bool = False,
) -> DataFrame:
    """Return a row per document: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for rows that needed no full hash, unless
    ``digest_all`` asks for it; ``row_digests`` adds a column row_digest. The surviving lengths and prefixes are broadcast when there
    are at most ``broadcast_limit`` of them (their count is taken first), else
    joined by a shuffle that adaptive execution splits where it is skewed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, SPACE + "+", "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), F.char_length(text).alias("_n"), norm.alias("_norm"),
        *([row_digest(F.col(text_col)).alias("row_digest")] if row_digests else []),
    )
    more = ["row_digest"] if row_digests else []
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_limit else df
    measured = rows.withColumn("_len", F.char_length("_norm"))
    lengths = small(cut(measured.groupBy("_len").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_len")))
    keyed = measured.withColumn("_pre", F.xxhash64(F.substring("_norm", 1, prefix_chars)))
    prefixes = keyed.join(lengths, "_len", "left_semi").groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    again = small(cut(prefixes.select("_len", "_pre", F.lit(True).alias("_many"))))
    sha = F.sha2(F.col("_norm").cast("binary"), 256)
    hashed = keyed.join(again, ["_len", "_pre"], "left").select(
        "doc_id", "_n", "_len", "_pre", F.coalesce("_many", F.lit(False)).alias("_many"),
        (sha if digest_all else F.when(F.col("_many"), sha)).alias("_sha"), *more,
    )
    hashed = cut(hashed)
    single = hashed.filter(~F.col("_many")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"), *more
    )
    many = hashed.filter("_many")
    groups = many.groupBy("_sha").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").alias("id"))).alias("_best")
    )
    groups = cut(groups)
    shared = join_groups(many.select("doc_id", "_n", "_sha", *more), groups, "_sha", "group_size", hashed.count()).select(
        "doc_id", F.col("_best.id").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("_best.id")) & (-F.col("_n") == F.col("_best.n"))).alias("kept"), F.col("_sha").alias("text_sha256"), *more,
    )
    return single.unionByName(shared)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the columns of ``docs`` and one row of each text, also where rows repeat the id and size of the one that stays."""
    kept = exact_dedup(docs, id_col, text_col, row_digests=True).filter("kept")
    alone = kept.filter("group_size = 1").select("doc_id", "row_digest", F.lit(False).alias("single"))
    tied = kept.filter("group_size > 1").groupBy("text_sha256", "doc_id", "row_digest").agg(F.count(F.lit(1)).alias("c"))
    tied = tied.groupBy("text_sha256").agg(F.min(F.struct("row_digest", "doc_id", "c")).alias("b"))
    return keep_rows(docs, alone.unionByName(tied.select("b.doc_id", "b.row_digest", (F.col("b.c") > 1).alias("single"))), id_col, text_col)


def query(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


ORACLE = r"""
with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), h as (select doc_id, length(t) as n, sha256(norm) as text_sha256 from n)
select doc_id,
  first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as kept,
  text_sha256
from h
"""

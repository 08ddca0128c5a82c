"""What the corpus operators share: tables, checkpoints, white space, row identity."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only a
    session in one process without that setting (a test) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def words(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


_CLAIM: dict = {"name": None, "forget": None}


def claim_worker(name: str, forget=None) -> None:
    """Let one operator at a time remember things in a Python worker: who comes next makes the last one forget."""
    if _CLAIM["name"] != name:
        if _CLAIM["forget"]:
            _CLAIM["forget"]()
        _CLAIM.update(name=name, forget=forget)
        give_back()


def give_back() -> None:
    """Return the freed memory of a Python worker, which Spark keeps for later stages, to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def sliced(batch, column: str, budget: int = 8 << 20):
    """Cut an Arrow record batch into row slices whose ``column`` holds about ``budget`` bytes.

    A single longer value still forms a slice of its own, so the memory of the
    caller is bounded by the budget plus one document.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    if n == 0:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(np.asarray(length.cast(pa.int64())))
    start = 0
    while start < n:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + budget, side="right")))
        yield batch.slice(start, end - start)
        start = end


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with their group (one row per ``on``), safe for groups of any size.

    Groups of more than ``max(100, total / 10000)`` rows are at most 10,000 by
    counting, whatever the data, so they are broadcast and their rows are not
    shuffled; the others are small and joined by a shuffle.
    """
    hot = F.col(size) > max(100, total // 10_000)
    large = groups.filter(hot).withColumnRenamed(on, "_hot")
    met = rows.join(F.broadcast(large), F.col(on) == F.col("_hot"), "left")
    added = [c for c in groups.columns if c != on]
    return met.filter(F.col("_hot").isNotNull()).drop("_hot").unionByName(met.filter(F.col("_hot").isNull()).drop("_hot", *added).join(groups.filter(~hot), on))


def row_digest(text: Column) -> Column:
    """What tells rows of one id apart: the digest of the text, "" for null."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def keep_rows(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (doc_id, row_digest, single) names; of rows equal in both, one if ``single``."""
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("row_digest").alias("_digest"), "single")
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), docs[id_col].alias("_own"), row_digest(docs[text_col]).alias("_text"))
    met = lambda m: rows.join(m, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest")), "left_semi")
    marks = cut(marks)
    out = met(marks.filter("not single")).select("_row.*")
    if marks.filter("single").limit(1).count():
        one = met(marks.filter("single")).groupBy("_own", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        out = out.unionByName(one.select("_row.*"))
    return out

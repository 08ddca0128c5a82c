"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Signatures. A document's shingles are mapped to positions of a universe of
2^20 by a first permutation; the second permutation, circularly shifted by
k = 0, 1, ..., gives coordinate k as the least value at those positions. All
coordinates of a shingle are therefore one contiguous run of a table.

Classes. Documents with equal shingle sets form a class before any comparison,
so exact copies never meet each other. Classes share a bucket if a band of
their signatures agrees; there are as many bands of 6 rows as it takes for a
pair at the threshold to be missed with probability below 3e-7 (32 bands at
0.85, 50 at 0.8).

Links. In every bucket each class is first compared with one hub, the class with
the most bucket neighbours; that is linear in the bucket. Buckets that are then
one component are done. In the others, classes that cannot reach the threshold
are taken out by an exact bound (shingles that no other open class has cannot be
shared), and the remaining pairs between different components that satisfy the
bound and the length condition are compared inside the join, which gives out
links alone. A large bucket is dealt over several tasks. There is no cap on buckets and no candidate is dropped without
proof; pairs inside a component are not needed for the result and never looked at.

Defined results: null, empty and blank texts have no shingles and are their own
component; a text with fewer words than the width has one shingle; the component
of a class is the smallest id in any of its documents; repeated rows and ids
each get a row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, cut, give_back, keep_rows, remove, row_digest, shared_folder, sliced
from .components import components
from .shingles import mix, shingle_sets, text_bytes

WIDTH, PERCENT = 5, 80
ROWS, MISS = 6, 3e-7
UNIVERSE = 1 << 20
#: Bytes of text that a task works on at a time; it takes some 40 times that in memory.
SLICE = 1 << 20
#: Classes of one bucket that a task compares with the whole bucket.
PART = 256
#: Ids of candidate classes up to which they are broadcast to the text scan.
BROADCAST_IDS = 500_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold is missed with probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.uint32)
    wrapped = np.concatenate([second, second[: length - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(wrapped, length)


def _digest(s: np.ndarray) -> bytes:
    """128-bit digest of a shingle set."""
    m = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(s)))
    return m.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(m)).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, row_digests: bool = False) -> DataFrame:
    """(doc_id, n, key, bands[, row_digest]): set size, class key (null if empty) and one 64-bit key per band."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    if row_digests:
        out = out.add("row_digest", T.StringType())

    def run(batches):
        import pyarrow as pa

        claim_worker("minhash")
        first, windows = _tables(bands * rows)
        factor = np.random.default_rng(31).integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        band_no = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                sets = shingle_sets(*text_bytes(batch.column("text")), width)
                sig = np.zeros((len(sets), bands * rows), np.uint32)
                for i, s in enumerate(sets):
                    if len(s):
                        at = first[(s >> np.uint64(44)).astype(np.int64)]
                        sig[i] = windows[at[:2048]].min(axis=0)
                        for k in range(2048, len(at), 2048):
                            np.minimum(sig[i], windows[at[k : k + 2048]].min(axis=0), out=sig[i])
                banded = mix((sig.reshape(len(sets), bands, rows).astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64) + band_no)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, banded.size + 1, bands), pa.int32()), pa.array(banded.view(np.int64).ravel())),
                        *([batch.column("row_digest")] if row_digests else []),
                    ],
                    names=["doc_id", "n", "key", "bands", "row_digest"][: 5 if row_digests else 4],
                )
        first = windows = whole = batch = sets = sig = banded = at = None
        give_back()

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *([row_digest(docs[text_col]).alias("row_digest")] if row_digests else [])).mapInArrow(run, out)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of texts."""

    def run(batches):
        import pyarrow as pa

        claim_worker("minhash")
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                sets = shingle_sets(*text_bytes(batch.column("text")), width)
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["key", "shingles"])
        whole = batch = sets = flat = ends = None
        give_back()

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose full sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return joined.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u")).filter(f"100 * i >= {percent} * u").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int | None = None, rows: int = ROWS, row_digests: bool = False) -> DataFrame:
    """Return a row per document: doc_id, n_shingles, component_id, kept; ``row_digests`` adds row_digest and the component's class key."""
    bands = bands or bands_for(percent, rows)
    signed = cut(signatures(docs, id_col, text_col, width, bands, rows, row_digests))
    classes = cut(signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    member = classes.select("key", "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # a row for every band of every class is the largest table here; as Parquet it is far smaller than as a checkpoint, and it goes when the links stand
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    member.join(shared, "bucket").write.parquet(folder)
    links = _links(docs, id_col, text_col, classes, spark.read.parquet(folder), width, percent)
    remove(spark, folder)
    comp = components(links)
    named = classes.select("key", "rep").join(comp, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    least = named.join(comp.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("least"))
    final = named.join(least, "component", "left").select("key", "component", F.coalesce("least", "rep").alias("component_id"))
    out = signed.join(final, "key", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), *(["row_digest", "component"] if row_digests else []))


def _links(docs, id_col, text_col, classes, live, width, percent) -> DataFrame:
    """Verified links (a, b) that span every component."""
    weight = cut(live.groupBy("key").agg(F.sum("c").alias("w")))
    ids = classes.join(weight, "key", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    ids = F.broadcast(ids) if weight.count() <= BROADCAST_IDS else ids
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("text")).join(ids, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = _sets(texts, width).join(weight.select("key"), "key", "left_semi")
    sets = cut(sets.dropDuplicates(["key"]))

    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    heavy = live.join(weight, "key")
    hubs = heavy.groupBy("bucket").agg(F.max(F.struct("w", "key", "n")).alias("hub"))
    star = heavy.join(hubs, "bucket").filter((F.col("key") != F.col("hub.key")) & near(F.col("n"), F.col("hub.n")))
    star = cut(star.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct())
    links = cut(_verified(star, sets, percent))

    comp = components(links)
    placed = live.filter("c > 2").join(comp, F.col("key") == F.col("node"), "left").select("key", "n", "bucket", F.coalesce("component", "key").alias("comp"))
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
    placed = cut(placed.join(open_, "bucket", "left_semi"))
    nodes = placed.select("key", "n").distinct()
    own = (
        sets.join(nodes, "key", "left_semi").select("key", F.explode("shingles").alias("s"))
        .groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.first("key").alias("key")).filter("c = 1").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    )
    # of a class with n shingles, v shared with any other: similarity to one with m is at most v / (n + m - v)
    reach = nodes.join(own, "key", "left").withColumn("v", F.col("n") - F.coalesce("own", F.lit(0))).withColumn("most", F.expr(f"((100 + {percent}) * v - {percent} * n) div {percent}"))
    reach = cut(reach.filter(F.col("most") * 100 >= F.col("n") * percent).select("key", "most"))
    met = placed.groupBy("key").agg(F.collect_list("bucket").alias("met"))  # at most one bucket a band
    # a bucket of m classes is dealt over m / PART tasks: each has a part of one side and all of the other
    held = placed.join(reach, "key")
    parts = held.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    # sets travel as 32-bit hashes; what hashing merges is added to the intersection, so no link is lost, and what passes is compared in full
    small = sets.select("key", F.array_distinct(F.transform("shingles", lambda s: F.hash(s))).alias("hashes"))
    side = cut(held.join(parts, "bucket")).join(met, "key").join(small, "key")
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left, right = (side.select(F.col("bucket"), p.alias("part"), *(F.col(c).alias(c + x) for c in ("key", "n", "comp", "most", "met", "hashes"))) for x, p in (("a", own), ("b", every)))
    both = F.size(F.array_intersect("hashesa", "hashesb")).cast("long") + F.col("na") - F.size("hashesa")
    rest = left.join(right, ["bucket", "part"]).filter(
        (F.col("keya") < F.col("keyb")) & (F.col("compa") != F.col("compb")) & near(F.col("na"), F.col("nb")) & (F.col("nb") <= F.col("mosta")) & (F.col("na") <= F.col("mostb"))
        & (F.array_min(F.array_intersect("meta", "metb")) == F.col("bucket"))  # a pair is looked at in the first bucket that it shares
        & (100 * both >= percent * (F.col("na") + F.col("nb") - both))  # only links, and what hashing cannot tell from them, leave the join
    )
    rest = _verified(cut(rest.select(F.col("keya").alias("a"), F.col("keyb").alias("b"))), sets, percent)
    return cut(links.unionByName(rest))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Keep one document of each group, with all columns, also where ids are null or repeated."""
    kept = near_duplicates(docs, id_col, text_col, percent=percent, row_digests=True).filter("kept")
    blank = kept.filter("n_shingles = 0").select("doc_id", "row_digest").distinct().withColumn("single", F.lit(False))
    best = kept.filter("n_shingles > 0").groupBy("component", "doc_id", "row_digest").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("component").agg(F.min(F.struct("row_digest", "doc_id", "c")).alias("b"))
    return keep_rows(docs, blank.unionByName(best.select("b.doc_id", "b.row_digest", (F.col("b.c") > 1).alias("single"))), id_col, text_col)


def query(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)

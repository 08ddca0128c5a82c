"""Centroid clustering with heap-ordered bounds.

The gap of a vector is the distance to its second nearest centroid less that to its own. While
centroids move, a gap shrinks by no more than its cluster's drift: the way of its own
centroid plus the longest way of another. Each cluster keeps a heap of its
vectors' gaps, to which the drift accumulated so far is added when a vector is put in, so
that nothing in the heap changes as the drift grows: the vectors whose gap may have
expired are those at the top, up to the cluster's drift. They alone are popped, compared exactly with
every centroid and put in again; all others keep their centroid by the triangle inequality.

The heap is external: every round puts its vectors in as one sorted run, Parquet files in the
shared folder sorted by (cluster, key), and pops by a range of keys that the reader uses to pass over row groups and
pages. An entry leaves its run in the one round in which the drift passes its key, so runs are never
rewritten. Sums of centroids change by the vectors that moved. What reaches the driver is a row a
cluster and component; no vector is shuffled.

Components are whole numbers, floor(scale * x); distances and sums are exact, bounds are
rounded to the safe side. Ties go to the smaller number, and a tied vector has no gap, so it is compared in the next round.

Defined results: vectors of another length and those with a null or non-finite
component are left out; an id that is null comes last when starts are drawn; equal ids are told apart by their
vectors; repeated rows each get a row; with fewer vectors than centroids every vector is a start; an
empty table gives an empty table; other columns are ignored; a component so large that a
distance might not fit 64 bits (at 64 components, 2^27 after scaling) is an error; an inertia that does not is null.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, cut, remove, shared_folder

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors compared with the centroids at a time.
BLOCK = 4096
#: What a float computation of a bound can be off by, relatively, and a whole number that is surely more.
SAFE = 1e-12
NEVER = 1e300


@dataclass
class Clustering:
    """``rows``: id, cluster, distance, cluster_inertia, inertia, centroid_sha256; the final centroids; how many vectors each assignment compared."""

    rows: DataFrame
    centroids: list[list[int]]
    compared: list[int] = field(default_factory=list)


@dataclass
class _Run:
    path: str
    popped: list[float] | None = None  # by cluster, the drift up to which keys have left


def usable(vector: Column, dims: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return (F.size(vector) == dims) & ~odd


def whole(x: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as integers, checked against overflow of distances."""
    y = np.floor(x.astype(np.float64) * scale)
    limit = 2.0 ** ((62 - int(np.ceil(np.log2(max(dims, 1))))) // 2 - 1)
    if y.size and np.abs(y).max() > limit:
        raise ValueError(f"a component is beyond {limit:.0f} after scaling; scale the vectors down")
    return y.astype(np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def keys_of(d: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, heap key) of vectors with distances ``d``: the gap, rounded down, plus the cluster's drift so far."""
    own = d.argmin(axis=1)
    if d.shape[1] == 1:
        return own, np.full(len(d), NEVER)
    near = np.sqrt(d[np.arange(len(d)), own].astype(np.float64))
    rest = d.copy()
    rest[np.arange(len(d)), own] = np.iinfo(np.int64).max
    far = np.sqrt(rest.min(axis=1).astype(np.float64))
    at = drift[own]
    return own, far - near + at - (far + near + at) * SAFE - SAFE


def drifts(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How much the gaps of each cluster may shrink, rounded up; 0 for all if no centroid moved."""
    way = np.array([np.sqrt(float(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)))) for p, q in zip(before, now, strict=True)])
    if not way.any():
        return way
    top = np.sort(way)[::-1]
    others = np.where((way == top[0]) & (np.arange(len(way)) == way.argmax()), top[1] if len(way) > 1 else 0.0, top[0])
    return (way + others) * (1 + SAFE) + SAFE


def _binary(rows: np.ndarray):
    import pyarrow as pa

    rows = np.ascontiguousarray(rows.astype(np.int32))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _vectors(column, dims: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.int32, len(column) * dims, int(ends[0])).reshape(-1, dims).astype(np.int64)


def _put(rows: DataFrame, id_type, centroids: np.ndarray, drift: np.ndarray, dims: int, scale: int) -> DataFrame:
    """Compare rows (id, vec[, cluster]) with all centroids: (id, vec, old, cluster, key)."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("vec", T.BinaryType()), T.StructField("old", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("key", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        claim_worker("centroids")
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(start, BLOCK)
                raw = batch.column("vec")
                if "cluster" in batch.schema.names:
                    v, old = _vectors(raw, dims), batch.column("cluster")
                else:
                    v = whole(np.asarray(raw.flatten()).reshape(-1, dims), dims, scale)
                    old = pa.array(np.full(len(v), -1, np.int32))
                own, key = keys_of(distances(v, centroids), drift)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(v), old, pa.array(own.astype(np.int32)), pa.array(key)], names=["id", "vec", "old", "cluster", "key"])

    return rows.mapInArrow(run, schema)


def _changes(run: DataFrame, clusters: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums, counts, rows): what the vectors of a run add to each cluster, exactly, less what they take from their old one."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros((clusters + 1, dims + 1), np.int64)
        for batch in batches:
            v = _vectors(batch.column("vec"), dims)
            old, new = (np.asarray(batch.column(c)) for c in ("old", "cluster"))
            total[clusters, dims] += len(v)
            for j in range(clusters):
                to, away = (new == j) & (old != j), (old == j) & (new != j)
                total[j, :dims] += v[to].sum(axis=0) - v[away].sum(axis=0)
                total[j, dims] += to.sum() - away.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    out = np.zeros((clusters + 1) * (dims + 1), object)
    for r in run.select("vec", "old", "cluster").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():
        out[r.at] = int(r.n)
    out = out.reshape(clusters + 1, dims + 1)
    return out[:clusters, :dims], out[:clusters, dims], int(out[clusters, dims])


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> Clustering:
    """Cluster the usable vectors; starts are those with the smallest hash of seed and id."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vectors[vector_col], dims)).select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vec"))
    id_type = rows.schema["id"].dataType
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "vec").limit(clusters).collect()
    now = whole(np.array([r.vec for r in first], float).reshape(-1, dims), dims, scale)
    clusters = len(first)
    if not clusters:
        none = T.StructType([T.StructField(id_col, id_type), *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
        return Clustering(spark.createDataFrame([], none), [])
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    drift = np.zeros(clusters)
    runs: list[_Run] = []
    compared: list[int] = []
    sums, counts = np.zeros((clusters, dims), object), np.zeros(clusters, object)
    schema = None

    def put(popped: DataFrame) -> None:
        nonlocal sums, counts, schema
        entries = _put(popped, id_type, now, drift, dims, scale)
        path = f"{folder}/{len(runs)}"
        entries.sortWithinPartitions("cluster", "key").write.parquet(path)
        schema = entries.schema
        runs.append(_Run(path))
        s, c, n = _changes(read(runs[-1]), clusters, dims)
        sums, counts = sums + s, counts + c
        compared.append(n)

    def read(run: _Run) -> DataFrame:
        return spark.read.schema(schema).parquet(run.path)

    def between(run: _Run, upto: np.ndarray | None) -> Column | None:
        """Entries of a run that are still in the heap, and below the drift if given."""
        out = None
        for j in range(clusters):
            low = run.popped[j] if run.popped else None
            if upto is not None and low is not None and low >= upto[j]:
                continue
            c = F.col("cluster") == j
            c = c & (F.col("key") > float(low)) if low is not None else c
            c = c & (F.col("key") <= float(upto[j])) if upto is not None else c
            out = c if out is None else out | c
        return out

    put(rows)
    for _ in range(rounds):
        before = now
        now = np.array([[int(x) // int(n) for x in s] if n else c for s, n, c in zip(sums, counts, before.tolist(), strict=True)], np.int64)
        step = drifts(before, now)
        if not step.any():
            break  # nothing will move any more
        drift = drift + step
        popped = None
        for run in runs:
            due = between(run, drift)
            if due is not None:
                top = read(run).filter(due).select("id", "vec", "cluster")
                popped = top if popped is None else popped.unionByName(top)
            run.popped = drift.tolist()
        put(popped)

    live = None
    for run in runs:
        left = read(run) if run.popped is None else read(run).filter(between(run, None))
        live = left if live is None else live.unionByName(left)
    final = now

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            own = np.asarray(batch.column("cluster"))
            d = _vectors(batch.column("vec"), dims) - final[own]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], names=["id", "cluster", "distance"])

    out = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    done = cut(live.select("id", "vec", "cluster").mapInArrow(measure, out))
    remove(spark, folder)
    per = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 2**63 else None
    facts = [(j, fits(per.get(j, 0)), fits(sum(per.values())), hashlib.sha256(",".join(map(str, now[j].tolist())).encode()).hexdigest()) for j in range(clusters)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster
    return Clustering(done.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), now.tolist(), compared)


def query(spark, sf_dir):
    from .common import table

    return cluster(table(spark, sf_dir, "embeddings")).rows


def _oracle() -> str:
    """DuckDB SQL of the query: every round compares all vectors with all centroids."""
    out = [
        f"kept as materialized (select row_number() over () as r, vec_id, embedding from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS} and len(embedding) = {DIMS})",
        f"v as materialized (select r, unnest(range({DIMS})) as d, unnest(list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint))) as x from kept)",
        f"starts as (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, embedding) - 1 as c, r from kept qualify c < {CLUSTERS})",
        "c0 as materialized (select c, d, x from starts join v using (r))",
    ]
    for i in range(ROUNDS + 1):
        out.append(f"a{i} as materialized (select v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) as dist from v join c{i} c using (d) group by 1, 2 qualify row_number() over (partition by v.r order by dist, c.c) = 1)")
        if i < ROUNDS:
            out.append(f"n{i} as (select c, d, sum(x) as s, count(*) as n from a{i} join v using (r) group by 1, 2)")
            out.append(f"c{i + 1} as materialized (select c, d, coalesce(cast((s - ((s % n) + n) % n) // n as bigint), o.x) as x from c{i} o left join n{i} using (c, d))")
    out.append(f"h as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c{ROUNDS} group by 1)")
    return "with " + ",\n".join(out) + f"\nselect vec_id, cast(c as int) as cluster, cast(dist as bigint) as distance, cast(sum(dist) over (partition by c) as bigint) as cluster_inertia, cast(sum(dist) over () as bigint) as inertia, centroid_sha256 from a{ROUNDS} join kept using (r) join h using (c)"


ORACLE = _oracle()

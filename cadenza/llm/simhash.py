"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints. Every 3-word shingle of a text, repeats included, is hashed by XXH64
(seed 42); a bit of the 64-bit fingerprint is set if it is set in over half of the
hashes. Documents with equal fingerprints form a class and never meet each other.

Partitions. Bits that go together over all classes (64 x 64 correlations) are
put in the same partition, so that the partitions tell classes apart as well as they can. Two
fingerprints within distance k, and units u_i with sum k + 1 over the partitions: in
one of them the two differ in at most u_i - 1 bits, and partitions of 0 units need
no look. Every class gets its own units from a dynamic program over the partitions, on the
number of candidates estimated from histograms of a fixed size; the number of partitions is the one
with the least estimated cost over all classes.

Probe and verify. A class probes the values within its threshold in each partition, meets
the classes above it there, and pairs within distance k are links. A value that many
classes share is not probed: its classes, and those that would probe it, are resolved at midpoints
instead. Two fingerprints are within an even distance k if and only if
some value is within k / 2 of both, so each class writes the ball of radius k / 2 around it and
all classes that wrote the same value are linked; for k = 2 that is 65 rows a class
and at most 65 classes a value, whatever the data.

Defined results: null, empty and blank texts have fingerprint zero, which is linked
like any other; with fewer words than the width the whole sequence is the one
shingle; the component of a document is the smallest id that it reaches (null ids
are passed over unless there are no others); repeated rows and ids each get a row; other columns
are ignored; an empty table gives an empty table. A long text is read in pieces that overlap by two words.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, cut, join_groups, sliced
from .components import components

WIDTH, DISTANCE, SEED = 3, 2, 42
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (2, 3, 4)
#: Bits of a partition that its histogram of candidate counts goes by.
FOLD = 14
#: Classes of one probed value above which they are resolved at midpoints.
CROWD = 256
#: Cost of comparing a candidate, in rows written by a probe.
COMPARE = 0.25
#: Hot values up to which they are broadcast.
BROADCAST_VALUES = 200_000
#: Bytes of text worked on at a time.
PIECE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _pieces(data: bytes, size: int):
    """Cut lower-cased text at white space into pieces of about ``size`` bytes."""
    start = 0
    while len(data) - start > size:
        end = start + size
        ends = [i for s in b" \t\n\r\x0b\x0c" if (i := data.find(s, end)) >= 0]
        if not ends:
            break
        yield data[start : min(ends)]
        start = min(ends)
    yield data[start:] if start else data


def fingerprint(text: str | None, width: int = WIDTH, piece: int = PIECE) -> int:
    """SimHash of one text, unsigned."""
    from xxhash import xxh64_intdigest

    ones, total, carry = np.zeros(64, np.int64), 0, []
    for part in _pieces((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), piece):
        words = carry + part.split()
        carry = words[max(0, len(words) - width + 1) :]
        n = len(words) - width + 1
        if n > 0:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
            spans = zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
            for i in range(0, n, 1 << 15):
                ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
    if not total:
        return xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a signed long."""

    def run(batches):
        import pyarrow as pa

        claim_worker("simhash")
        for whole in batches:
            for batch in sliced(whole, "text", PIECE):
                fp = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, out)


def correlations(classes: DataFrame) -> tuple[int, np.ndarray]:
    """(number of classes, 64 x 64 absolute correlations of their bits); tasks add up, and 65 rows of 64 numbers are gathered."""

    def run(batches):
        import pyarrow as pa

        both = np.zeros((65, 64), np.int64)
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64)
            for i in range(0, len(fp), 1 << 14):
                bits = np.unpackbits(fp[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[:64] += (bits.T @ bits).astype(np.int64)  # whole numbers below 2^24 are exact
                both[64, 0] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size), pa.int64()), pa.array(both.ravel())], names=["at", "n"])

    sums = classes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(65 * 64)
    for r in sums:
        both[r.at] = r.n
    both = both.reshape(65, 64)
    n = both[64, 0]
    if not n:
        return 0, np.zeros((64, 64))
    p = np.diag(both[:64]) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    together = np.abs(both[:64] / n - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(together, 0)
    return int(n), together


def partition_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to ``parts`` partitions; each grows by the bit that goes best with those it has."""
    left, out = set(range(64)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        at = sorted(left)
        own = [max(at, key=lambda b: (together[b, at].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: (together[b, own].sum(), -b)))
            left.discard(own[-1])
        out.append(own)
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a partition, packed: bit j of the value is bit bits[j] of the fingerprint."""
    fp = fp.view(np.uint64)
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out.view(np.int64)


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64).view(np.int64)


def unit_costs(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """Cost of 0, 1, ... distance + 1 units in a partition, by folded value: rows of probes and estimated candidates.

    ``counts`` says how many classes have each folded value; the bits beyond the fold count as evenly spread.
    """
    fold = int(np.log2(len(counts)))
    rest = width - fold
    choose = lambda n, k: 1.0 if k == 0 else choose(n, k - 1) * (n - k + 1) / k if n >= k else 0.0
    at = np.arange(len(counts))
    near = []  # classes at exactly r folded bits from each value
    for r in range(distance + 1):
        near.append(sum(counts[at ^ m] for m in (sum(1 << b for b in c) for c in combinations(range(fold), r))))
    out = np.zeros((len(counts), distance + 2))
    for u in range(1, distance + 2):
        found = sum(near[r] * sum(choose(rest, k) for k in range(u - r)) for r in range(u)) / 2.0**rest
        out[:, u] = sum(choose(width, k) for k in range(u)) + COMPARE * found
    return out


def allocate(costs: np.ndarray) -> np.ndarray:
    """Units of every row and partition with the least total cost; costs is rows x partitions x units, whose last is the sum to reach."""
    rows, parts, units = costs.shape
    best = np.full((rows, units), np.inf)
    best[:, 0] = 0
    took = np.zeros((rows, parts, units), np.int8)
    for i in range(parts):
        now = np.full((rows, units), np.inf)
        for s in range(units):
            for u in range(s + 1):
                c = best[:, s - u] + costs[:, i, u]
                better = c < now[:, s]
                now[better, s] = c[better]
                took[better, i, s] = u
        best = now
    out, s = np.zeros((rows, parts), np.int8), np.full(rows, units - 1)
    for i in reversed(range(parts)):
        out[:, i] = took[np.arange(rows), i, s]
        s = s - out[:, i]
    return out


def plan(classes: DataFrame, distance: int = DISTANCE, fold: int = FOLD) -> tuple[list[list[int]], list[np.ndarray]]:
    """(bits, unit costs by folded value) of the partitions with the least estimated cost over all classes."""
    n, together = correlations(classes)
    choices = [partition_bits(together, m) for m in PARTITIONS]
    flat = [(i, j, bits) for i, parts in enumerate(choices) for j, bits in enumerate(parts)]
    mask = np.int64((1 << fold) - 1)

    def run(batches):
        import pyarrow as pa

        own = np.zeros((len(flat), 1 << fold), np.int64)
        for batch in batches:
            fp = np.asarray(batch.column("fp")).astype(np.int64)
            for k, (_, _, bits) in enumerate(flat):
                own[k] += np.bincount(values(fp, bits) & mask, minlength=1 << fold)
        at = np.flatnonzero(own.ravel())
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(own.ravel()[at[i : i + (1 << 16)]])], names=["at", "n"])

    counts = np.zeros(len(flat) << fold)
    got = classes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most a row a folded value
    counts[np.asarray(got.column("at"))] = np.asarray(got.column("n"))
    counts = counts.reshape(len(flat), -1)
    best = None
    for i, parts in enumerate(choices):
        own = [k for k, f in enumerate(flat) if f[0] == i]
        costs = [unit_costs(counts[k], len(flat[k][2]), distance) for k in own]
        mean = np.array([[(counts[k] @ c) / max(n, 1) for k, c in zip(own, costs, strict=True)]])
        units = allocate(mean)[0]
        total = sum(mean[0, j, u] for j, u in enumerate(units))
        if best is None or total < best[0]:
            best = (total, parts, [c.astype(np.float32) for c in costs])
    return best[1], best[2]


def _probes(classes: DataFrame, parts: list[list[int]], costs: list[np.ndarray], distance: int) -> DataFrame:
    """(part, value, fp, own): every class under its own value of each partition, and under the values that it probes."""
    masks = [[ball(len(bits), u - 1) if u else None for u in range(distance + 2)] for bits in parts]
    fold = int(np.log2(len(costs[0])))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 12):
                fp = np.asarray(batch.column("fp").slice(start, 1 << 12)).astype(np.int64)
                value = [values(fp, bits) for bits in parts]
                units = allocate(np.stack([c[v & ((1 << fold) - 1)] for c, v in zip(costs, value, strict=True)], axis=1))
                for i, v in enumerate(value):
                    for u in range(distance + 2):
                        rows = np.flatnonzero(units[:, i] == u)
                        if u == 0:  # indexed, not probing
                            at, who, own, asks = v[rows], fp[rows], np.ones(len(rows), bool), np.zeros(len(rows), bool)
                        else:
                            at = (v[rows, None] ^ masks[i][u][None, :]).ravel()
                            who = np.repeat(fp[rows], len(masks[i][u]))
                            own = np.tile(np.arange(len(masks[i][u])) == 0, len(rows))
                            asks = np.ones(len(at), bool)
                        for k in range(0, len(at), 1 << 16):
                            s = slice(k, k + (1 << 16))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at[s]), i, np.int32)), pa.array(at[s]), pa.array(who[s]), pa.array(own[s]), pa.array(asks[s])], names=["part", "value", "fp", "own", "asks"]
                            )

    return classes.select("fp").mapInArrow(run, "part int, value long, fp long, own boolean, asks boolean")


def _midpoints(crowd: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of classes: all that have a value within half the distance in common, as stars around the least."""
    masks = ball(64, distance // 2)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 9):
                fp = np.asarray(batch.column("fp").slice(start, 1 << 9)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks[None, :]).ravel()), pa.array(np.repeat(fp, len(masks)))], names=["mid", "fp"])

    met = crowd.mapInArrow(run, "mid long, fp long").groupBy("mid").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")  # no more than a ball has
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b").distinct()


def links(classes: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between classes that span all components of distance ``distance`` or less."""
    if distance % 2 or distance < 0:
        raise ValueError("the distance must be even: crowded values are resolved at midpoints")
    if not distance:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts, costs = plan(classes, distance)
    probes = cut(_probes(classes, parts, costs, distance))
    hot = cut(probes.filter("own").groupBy("part", "value").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowd).select("part", "value"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_VALUES else hot
    calm = probes.join(hot, ["part", "value"], "left_anti")
    a, b = (calm.filter(f).select("part", "value", F.col("fp").alias(n)) for f, n in (("asks", "a"), ("own", "b")))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    found = a.join(b, (a["part"] == b["part"]) & (a["value"] == b["value"]) & near).select("a", "b")
    crowded = probes.join(hot, ["part", "value"], "left_semi").select("fp").distinct()
    return found.unionByName(_midpoints(crowded, distance)).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Return a row per document: doc_id, fingerprint (hexadecimal), component_id, kept."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    comp = components(links(classes, distance, crowd))
    named = cut(classes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = cut(named.join(least, "component").select("fp", "rows", "component_id"))
    total = classes.agg(F.sum("rows")).first()[0] or 0
    out = join_groups(marked, final, "fp", "rows", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir):
    from .common import table

    return near_groups(table(spark, sf_dir, "documents"))

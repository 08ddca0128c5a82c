"""A Merkle manifest of a dataset, built and proved by slot pivots.

Every row is a leaf. Within a group the leaves ascend by their order column, and while
several nodes remain every ``fanout`` consecutive ones become their digest. A level is
one aggregate: conditional aggregates spread the children of a parent into one column a
slot; the columns concatenated give the parent's digest, and the columns without a child's own
slot are its siblings. The roots of the groups, in the order of the groups, are the leaves of one more tree.

Proofs come from the top down: a node's path is its siblings followed by its parent's
path, so each level is one join of pivots (a fanout-th of the level's nodes) with the paths above.
Folding a digest through its path gives the root again if and only if the row is as it was.

Places come without a window over a group: rows are dealt by ranges of (group, order),
counted by range and group, and a row's place is the count of its group before
its range plus its place within it. A group with a third of all rows is many ranges.

Defined results: a null value has its own mark, so null, empty and "-" differ; a null
group is a group of its own, before the others; a null order column comes first; ties are broken by the leaf, and
repeated rows are leaves each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Counts of (range, group) up to which they are broadcast.
BROADCAST_COUNTS = 200_000

_GROUP = ["_named", "_group"]  # whether the group has a name; the name, "" without


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat_ws("", *texts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of values, each written as its byte count and itself, or as a mark if null."""

    def written(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(written, values)), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with the group's columns) with ``at`` (place within the group, from 0) and ``total`` (rows of the group)."""
    keys = [*_GROUP, *order, "_tie"]  # the tie splits any run of equal rows
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.drop("_tie").withColumn("_nth", F.monotonically_increasing_id()))
    ranged = dealt.withColumn("_range", F.shiftrightunsigned("_nth", 33))
    counts = ranged.groupBy(*_GROUP, "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_first"))
    from pyspark.sql import Window as W

    group = W.partitionBy(*_GROUP)  # a row a range
    before = F.coalesce(F.sum("n").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select(*_GROUP, "_range", "_first", before.alias("_before"), F.sum("n").over(group).alias("total")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_COUNTS else counts
    met = ranged.join(counts, [*_GROUP, "_range"])
    return met.withColumn("at", F.col("_before") + F.col("_nth") - F.col("_first")).drop("_nth", "_range", "_first", "_before")


def _slots(fanout: int) -> list[str]:
    return [f"slot{s}" for s in range(fanout)]


def spread(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row a parent: its place ``at``, the nodes of its level ``total``, its children by slot, its digest."""
    own = [c for c in nodes.columns if c not in (*_GROUP, "at", "total")]
    slot = F.pmod("at", F.lit(fanout))
    child = F.struct(*own)
    out = nodes.groupBy(*_GROUP, F.expr(f"at div {fanout}").alias("at")).agg(
        F.first("total").alias("_below"), *(F.max(F.when(slot == s, child)).alias(c) for s, c in enumerate(_slots(fanout)))
    )
    hashes = [F.col(c)["digest"] for c in _slots(fanout)]
    return out.select(*_GROUP, "at", F.expr(f"(_below + {fanout} - 1) div {fanout}").alias("total"), *_slots(fanout), digest(*hashes).alias("digest"))


def build(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, roots) of trees over placed leaves with a ``digest``: the pivots of every level, and by level the nodes that are a tree's root."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    levels, roots, now = [], [], leaves
    while True:
        roots.append(now.filter("total = 1"))
        if most <= 1:
            return levels, roots
        levels.append(cut(spread(now.filter("total > 1"), fanout)))
        now = levels[-1].select(*_GROUP, "at", "total", "digest")
        most = -(-most // fanout)


def paths(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """Leaves with their path, an array of siblings (before, after) from the leaf to the top.

    ``above`` has the path of every tree's root, by group, with columns that all leaves of the group receive.
    """
    more = [c for c in above.columns if c not in (*_GROUP, "path")]
    slots = _slots(fanout)
    hashes = [F.col(c)["digest"] for c in slots]
    topped = [r.join(above, _GROUP) for r in roots]
    down = topped[-1]
    for level, top in zip(reversed(levels), reversed(topped[:-1]), strict=True):
        rows = level.drop("total", "digest").join(down.select(*_GROUP, "at", "path", *more), [*_GROUP, "at"])
        rows = rows.withColumn("slots", F.array(*slots)).withColumn("hashes", F.array(*hashes))
        cut_out = lambda child, s: F.struct(
            child.alias("child"), s.alias("slot"),
            F.struct(F.array_join(F.slice("hashes", F.lit(1), s), "").alias("before"), F.array_join(F.slice("hashes", s + 2, F.lit(fanout)), "").alias("after")).alias("siblings"),
        )
        children = F.filter(F.transform("slots", cut_out), lambda c: c["child"].isNotNull())
        rows = rows.select(*_GROUP, "at", "path", *more, F.explode(children).alias("c"))
        rows = rows.select(*_GROUP, (F.col("at") * fanout + F.col("c.slot")).alias("at"), "c.child.*", F.concat(F.array("c.siblings"), F.col("path")).alias("path"), *more)
        down = rows.unionByName(top.drop("total", "slot"))
    return down


def folded(start: Column, path: Column) -> Column:
    """The top digest that a digest and its path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf to the top and from left to right, in one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, columns=COLUMNS, group: str = "source", order: str = "doc_id", claimed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Return a row per row of ``docs``: its order column, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    ``claimed`` is the leaf digest to verify against the manifest (by default the row's own); the
    leaf of a row is available to it as the column ``leaf``.
    """
    rows = docs.withColumn("_leaf", leaf_digest([docs[c] for c in columns]))
    own = F.col("_leaf") if claimed is None else claimed
    group_text = docs[group].cast("string")
    leaves = cut(rows.select(docs[order].alias("_key"), docs[group].isNotNull().alias("_named"), F.coalesce(group_text, F.lit("")).alias("_group"), F.col("_leaf").alias("digest"), own.alias("claimed")))
    levels, roots = build(placed(leaves, ["_key", "digest"]), fanout)
    from functools import reduce

    subroots = reduce(DataFrame.unionByName, [r.select(*_GROUP, "digest") for r in roots])
    one = subroots.select(F.lit(True).alias("_named"), F.lit("").alias("_group"), F.struct(*_GROUP).alias("_key"), "digest")
    up_levels, up_roots = build(cut(placed(one, ["_key"])), fanout)
    root = up_roots[-1].select("digest").first()
    start = one.sparkSession.createDataFrame([(True, "")], "_named boolean, _group string").withColumn("path", F.expr("cast(array() as array<struct<before: string, after: string>>)"))
    above = paths(up_levels, up_roots, start, fanout).select("_key._named", "_key._group", F.col("digest").alias("subroot"), "path")
    proved = paths(levels, roots, cut(above), fanout)
    top = F.lit(root[0] if root else None).cast("string")
    out = proved.select(F.col("_key").alias(order), F.col("digest").alias("leaf"), "subroot", top.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, columns=COLUMNS) -> Column:
    """Leaf digest of a copy in which every row whose id's CRC-32 is divisible by 5 has lost its capital letters A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.translate(docs[c], upper, upper.lower()) if c == "text" else docs[c] for c in columns]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf_digest(values)).otherwise(F.col("_leaf"))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return manifest(docs, claimed=tampered(docs)).drop("path")


def _oracle(levels: int = 6, tops: int = 5) -> str:
    """DuckDB SQL of the query, one step a level; a tree that has ended passes its root on."""
    def written(c):
        return f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"

    def leaf(text):
        return "sha256(" + " || ".join(written(text if c == "text" else c) for c in COLUMNS) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ["t0 as (select b, b as c from range(256) r(b))"] + [f"t{i + 1} as (select b, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end as c from t{i})" for i in range(8)]
    out = [
        *crc, "crctable as (select list(c order by b) as t from t8)",
        """coded as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) as crc
           from documents d, crctable)""",
        f"leaves as (select doc_id, coalesce('1' || source, '0') as k, {leaf('text')} as leaf, case when crc % 5 = 0 then {leaf(lower)} else {leaf('text')} end as claimed from coded)",
        "l0 as (select *, leaf as h, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as nth, count(*) over (partition by k) as n from leaves)",
    ]

    def tree(name, key, depth):
        for i in range(depth):
            part = f"partition by {key}, nth // 16 order by nth rows between"
            out.append(f"{name}s{i} as (select {key}, nth, n, coalesce(string_agg(h, '') over ({part} unbounded preceding and 1 preceding), '') as pre, coalesce(string_agg(h, '') over ({part} 1 following and unbounded following), '') as post from {name}{i})")
            out.append(f"{name}{i + 1} as (select {key}, nth // 16 as nth, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by nth)) end as h, (any_value(n) + 15) // 16 as n from {name}{i} group by {key}, nth // 16)")

    tree("l", "k", levels)
    out.append(f"u0 as (select 0 as g, k, h, row_number() over (order by k) - 1 as nth, count(*) over () as n from l{levels})")
    tree("u", "g", tops)
    steps = [("l", i, "k") for i in range(levels)] + [("u", i, "g") for i in range(tops)]
    last = "select l0.doc_id, l0.leaf, u0.h as subroot, l0.claimed as f0, '' as p0, l0.nth as lat, u0.nth as uat, l0.k, 0 as g from l0 join u0 using (k)"
    for j, (name, i, key) in enumerate(steps):
        at = f"{'lat' if name == 'l' else 'uat'} // {16**i}"
        out.append(f"f{j} as ({last})")
        last = f"select f.* exclude (f0, p0), case when s.n = 1 then f0 else sha256(s.pre || f0 || s.post) end as f0, p0 || s.pre || s.post as p0 from f{j} f join {name}s{i} s on s.{key} = f.{key} and s.nth = {at}"
    out.append(f"done as ({last})")
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, r.h as root, sha256(p0) as proof_sha256, f0 as folded_root, f0 = r.h as verified from done, u{tops} r"


ORACLE = _oracle()

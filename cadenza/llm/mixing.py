"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Targets share all words by the sources' weights; no target
exceeds ``max_epochs`` times its source, and what is over is shared again by
weight until none is above (the sources sorted by cap over weight: the first
ones end at their caps, the rest share what remains).

Blocks. A source of n documents falls into ceil(sqrt(n)) blocks by a hash, so
neither a block nor the list of a source's blocks grows faster than the root of
the source. The blocks are permuted by a hash; a source takes all its blocks
once per full epoch and then, in permuted order, those that fill the remainder
of its target. The block at the edge is taken in part, document by document.

Tree. The number of block draws of every source is its quota. The root of a
binary tree over the output shards holds all quotas; a node gives its left child
a share of its draws by an exact multivariate hypergeometric draw, source after
source, and the rest to its right child. Leaf quotas of a source, in shard
order, cut its sequence of permuted blocks into disjoint ranges: a shard draws the blocks
of its ranges, and what no leaf has is not taken. Within a shard the documents are ordered by a hash. All
randomness comes from hashes of the seed, so reruns agree.

Everything is DataFrame functions. The rows are scanned once and only narrow
columns are shuffled: partial sums per source and per block, then a join of the
documents with their block. The facts of all sources form one row; more than ``MAX_SOURCES``
sources are an error (small ones can share a name).

Defined results: null text has size 0, and a document or source of size 0 takes
nothing; the null source is a source of its own, the last; repeated rows are
separate rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from math import lcm as least_multiple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, words

WEIGHTS = (5, 2, 1)
SHARDS = 16
#: Sources that a mix may have: their quotas are one array, and a split walks through it.
MAX_SOURCES = 10_000
#: Sources, blocks and rows at the edge of a target up to which each is broadcast.
BROADCAST_ROWS = 200_000


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _number(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, docs, weight, target) from (source, source_size, docs)."""
    k = len(weights)
    one = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.col("source"), F.col("source_size"), F.col("docs")))).alias("s"))
    w = F.array(*(F.lit(x).cast("long") for x in weights))
    one = one.select(
        F.transform("s", lambda x, i: F.struct(x.source.alias("source"), x.source_size.alias("source_size"), x.docs.alias("docs"), F.element_at(w, (i % k + 1).cast("int")).alias("weight"), i.alias("no"))).alias("s")
    )
    cap = lambda x: x.source_size * max_epochs
    # by cap / weight; exact integers: cap * lcm / weight
    lcm = least_multiple(*weights)
    order = F.array_sort(F.transform("s", lambda x: F.struct((F.expr(f"{lcm}L") * cap(x) / x.weight).cast("long").alias("ratio"), x.no.alias("no"), cap(x).alias("cap"), x.weight.alias("weight"))))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.source_size)
    mass = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.weight)
    state = F.aggregate(
        order, F.struct(total.alias("left"), mass.alias("mass"), F.lit(False).alias("done")),
        lambda a, x: F.when(~a.done & (x.cap * a.mass <= a.left * x.weight), F.struct((a.left - x.cap).alias("left"), (a.mass - x.weight).alias("mass"), F.lit(False).alias("done")))
        .otherwise(F.struct(a.left.alias("left"), a.mass.alias("mass"), F.lit(True).alias("done"))),
    )
    one = one.select("s", state.alias("f"))
    rows = one.select(F.explode("s").alias("x"), "f")
    share = F.when((F.col("f.mass") == 0) | (cap(F.col("x")) * F.col("f.mass") <= F.col("f.left") * F.col("x.weight")), cap(F.col("x")).cast("double")).otherwise(
        (F.col("f.left") * F.col("x.weight")).cast("double") / F.col("f.mass").cast("double")
    )
    return rows.select("x.source", "x.source_size", "x.docs", "x.weight", "x.no", share.alias("target"))


def _lfact(n: Column) -> Column:
    """ln n! by Stirling's series after shifting the argument by 8; exact to 1e-9."""
    z = n + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046728 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    down = F.log((n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0)) + F.log((n + 5.0) * (n + 6.0) * (n + 7.0) * (n + 8.0))
    return series - down


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """A draw of how many of ``draws`` out of ``total`` are among ``good``: inversion of the exact law."""
    lo = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    hi = F.least(good, draws)
    ways = lambda n, r: _lfact(n) - _lfact(r) - _lfact(n - r)
    logs = F.transform(F.sequence(lo, hi), lambda x: ways(good, x) + ways(total - good, draws - x))
    weights = lambda ls: F.transform(ls, lambda y: F.exp(y - F.array_max(ls)))

    def invert(ws: Column) -> Column:
        goal = u * F.aggregate(ws, F.lit(0.0), lambda a, y: a + y)
        got = F.aggregate(
            ws, F.struct(F.lit(0.0).alias("acc"), F.lit(0).cast("long").alias("n")),
            lambda a, y: F.struct((a.acc + y).alias("acc"), F.when(a.acc + y < goal, a.n + 1).otherwise(a.n).alias("n")),
        )
        return F.least(lo + got.n, hi)

    # array(x)[0] through transform binds a value once instead of repeating its expression
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return once(logs, lambda ls: once(weights(ls), invert))


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(no, shard, quota) from one row per source (no, quota): leaves of the splitting tree."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("no", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("width"), "q"
    )
    while shards > 1:
        shards = -(-shards // 2)
        left_width = F.expr("width - width div 2")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.quota)
        node = node.withColumn("lw", left_width).withColumn("total", total).withColumn("goal", F.expr("(total * lw) div width"))
        walk = F.aggregate(
            "q", F.struct(F.col("goal").alias("m"), F.col("total").alias("n"), F.array().cast("array<bigint>").alias("out")),
            lambda a, x: F.element_at(
                F.transform(
                    F.array(_hypergeometric(x.quota, a.n, a.m, _unit(F.lit(seed), F.col("first").cast("string"), F.col("width").cast("string"), x.no.cast("string")))),
                    lambda h: F.struct((a.m - h).alias("m"), (a.n - x.quota).alias("n"), F.concat(a.out, F.array(h)).alias("out")),
                ), 1,
            ),
        )
        node = cut(node.withColumn("left", walk.getField("out")))
        take = F.zip_with("q", "left", lambda x, h: F.struct(x.no.alias("no"), h.alias("quota")))
        rest = F.zip_with("q", "left", lambda x, h: F.struct(x.no.alias("no"), (x.quota - h).alias("quota")))
        children = F.array(
            F.struct(F.col("first"), F.col("lw").alias("width"), take.alias("q")),
            F.struct((F.col("first") + F.col("lw")).alias("first"), (F.col("width") - F.col("lw")).alias("width"), rest.alias("q")),
        )
        node = node.select(F.explode(children).alias("c")).select("c.*").filter("width > 0")
    return node.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("x.no", "shard", "x.quota")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = 3, shards: int = SHARDS, seed: str = "mix", carry: bool = False) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, draws[, row].

    ``draws`` is an array of (shard, epoch, position), one per copy that the mix
    takes; ordering a shard by position gives its local shuffle.
    ``carry`` adds the row of ``docs`` as a struct; it is not shuffled unless sources or
    blocks are too many to broadcast, and ids need not tell rows apart.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    if sizes.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources")
    aim = targets(sizes, weights, max_epochs)
    # full epochs, and the words left for a partial one
    aim = aim.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    aim = aim.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("blocks", F.ceil(F.sqrt(F.col("docs").cast("double"))).cast("long"))
    aim = cut(aim)

    here = aim.select(F.col("source").alias("_source"), "no", "blocks", "source_size", "target", "epochs")
    sourced = lambda rows, here: rows.join(here, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "block", F.pmod(_number(F.lit(seed), F.lit("block"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("blocks"))
    )
    rows = sourced(rows, here)
    block = rows.groupBy("no", "block").agg(F.sum("size").alias("block_size"))
    order = W.partitionBy("no").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("no").cast("string"), F.col("block").cast("string"))), "block")
    block = block.withColumn("turn", F.row_number().over(order).cast("long") - 1).withColumn("before", F.sum("block_size").over(order.rowsBetween(W.unboundedPreceding, -1)))
    block = block.withColumn("before", F.coalesce("before", F.lit(0)).cast("long")).join(aim.select("no", "rest"), "no")
    block = block.withColumn("state", F.when(F.col("before") + F.col("block_size") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    block = cut(block)

    quota = block.groupBy("no").agg(F.sum(F.when(F.col("state") > 0, 1).otherwise(0)).alias("part"), F.count(F.lit(1)).alias("used")).join(aim, "no")
    quota = quota.select("no", F.col("used"), (F.col("epochs") * F.col("used") + F.col("part")).cast("long").alias("quota"))
    leaves = split_tree(quota.select("no", "quota"), shards, seed)
    ends = leaves.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("l"))
    cumulative = F.aggregate("l", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.quota)))
    ends = ends.select("no", F.slice(cumulative, 2, shards).alias("ends"))
    block = block.join(quota.select("no", "used"), "no").join(ends, "no")
    # the block stands at turn, used + turn, ... of its source's sequence; a shard draws what lies in its leaf's range
    place = lambda e: e * F.col("used") + F.col("turn")
    shard = lambda e: F.size(F.filter("ends", lambda x: x <= place(e)))
    held = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs).cast("long")), lambda e: F.struct(shard(e).alias("shard"), e.alias("epoch"))), lambda d: d.shard < shards)
    block = block.select("no", "block", "before", "rest", "state", held.alias("held"))

    rows = rows.join(block, ["no", "block"])
    edge = W.partitionBy("no", "block").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "doc_id", "size")
    # only documents of blocks at the edge are ordered; a block is the root of its source
    split = rows.filter("state = 1").withColumn("upto", F.sum("size").over(edge.rowsBetween(W.unboundedPreceding, 0)))
    split = split.withColumn("last", F.col("before") + F.col("upto") - F.col("size") / 2.0 <= F.col("rest")).drop("upto")
    whole = rows.filter("state != 1").withColumn("last", F.lit(True))
    if carry:
        # the edge decides by (id, size); of rows that agree in both, the first ``_some`` by their hash
        some = cut(split.groupBy("no", "block", "doc_id", "size").agg(F.sum(F.col("last").cast("int")).alias("_some"), F.count(F.lit(1)).alias("_all")))
        some = some.select(F.col("no").alias("_no"), F.col("block").alias("_block"), F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), "_some", "_all")
        block = cut(block)
        small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"))
        rows = sourced(rows, small(here)).join(small(block), ["no", "block"])
        same = (F.col("no") == F.col("_no")) & (F.col("block") == F.col("_block")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size"))
        rows = rows.join(small(some), same, "left").drop("_no", "_block", "_doc", "_size")
        clear = F.col("_some").isNull() | F.col("_some").isin(0) | (F.col("_some") == F.col("_all"))
        whole, split = rows.filter(clear).withColumn("last", (F.col("state") != 1) | (F.col("_some") > 0)).drop("_some", "_all"), None
        if some.filter("_some > 0 and _some < _all").limit(1).count():
            turn = W.partitionBy("no", "block", "doc_id", "size").orderBy(F.xxhash64("row"))
            split = rows.filter(~clear).withColumn("last", F.row_number().over(turn) <= F.col("_some")).drop("_some", "_all")
    rows = whole if split is None else whole.unionByName(split)
    # of a block at the edge, the last draw takes some documents only
    own = F.filter("held", lambda d: (F.col("size") > 0) & (F.col("last") | (d.epoch < F.col("epochs"))))
    draw = lambda d: F.struct(
        d.shard.alias("shard"), d.epoch.alias("epoch"), _number(F.lit(seed), F.lit("place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), d.epoch.cast("string")).alias("position")
    )
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.transform(own, draw).alias("draws"), *(["row"] if carry else []))
    return rows.withColumn("copies", F.size("draws").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every column of ``docs``, a row per copy, plus mix_shard, mix_epoch and mix_position (replacing such columns)."""
    docs = docs.drop("mix_shard", "mix_epoch", "mix_position")
    drawn = plan(docs, id_col, carry=True, **options).filter("copies > 0").select("row", F.explode("draws").alias("_d"))
    return drawn.select("row.*", F.col("_d.shard").alias("mix_shard"), F.col("_d.epoch").alias("mix_epoch"), F.col("_d.position").alias("mix_position"))


def shuffled(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The columns of ``docs``, a row per copy, dealt by shard and sorted by position within it.

    Positions are hashes, so a shard is cut into even ranges of them; shards of any size become many partitions.
    """
    mixed = mix(docs, id_col, **options)
    return mixed.repartition("mix_shard", F.expr("mix_position div 268435456")).sortWithinPartitions("mix_shard", "mix_position", id_col).select(*docs.columns)


def query(spark, sf_dir):
    from .common import table

    out = plan(table(spark, sf_dir, "documents"))
    shown = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d.shard.cast("string"), d.epoch.cast("string"), d.position.cast("string"))), ",")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), shown.alias("draws"))


def _unit_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def _level_sql(k: int) -> str:
    """One level of the tree: the draws of the left children, source after source, then both children."""
    ways = lambda n, r: f"lgamma({n} + 1) - lgamma({r} + 1) - lgamma({n} - {r} + 1)"
    return f"""
t{k} as (
  select *, width - width // 2 as lw, sum(quota) over (partition by first)::bigint * (width - width // 2) // width as goal,
    (sum(quota) over (partition by first) - coalesce(sum(quota) over (partition by first order by no rows between unbounded preceding and 1 preceding), 0))::bigint as n,
    {_unit_sql("'mix'", "first", "width", "no")} / 4294967296.0::double as u from l{k}
), w{k} as (
  select first, -1::bigint as no, goal::bigint as m, 0::bigint as h from t{k} where no = 0
  union all
  select first, no, (m - h)::bigint, h::bigint from (
    select first, no, m, least(lo + len(list_filter(range(1, len(ws) + 1), lambda i: list_sum(ws[1:i]) < u * list_sum(ws))), hi) as h from (
      select *, list_transform(logs, lambda y: exp(y - list_max(logs))) as ws from (
        select *, list_transform(range(lo, hi + 1), lambda x: {ways("quota", "x")} + {ways("(n - quota)", "(m - x)")}) as logs from (
          select t.first, t.no, t.quota, t.n, t.u, w.m, greatest(0, w.m - (t.n - t.quota)) as lo, least(t.quota, w.m) as hi
          from w{k} w join t{k} t on t.first = w.first and t.no = w.no + 1))))
), l{k + 1} as (
  select t.first, lw as width, t.no, h as quota from t{k} t join w{k} w on t.first = w.first and t.no = w.no
  union all select t.first + lw, t.width - lw, t.no, quota - h from t{k} t join w{k} w on t.first = w.first and t.no = w.no where t.width > lw
)"""


ORACLE = (
    r"""
with recursive d as (
  select doc_id, source, case when text is null then 0 else length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) end as size from documents
), s as (
  select source, sum(size)::bigint as source_size, count(*) as docs from d group by 1
), w as (
  select *, row_number() over (order by source is null, source) - 1 as no from s
), v as (
  select *, case no % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from w
), o as (
  select *, sum(source_size) over () as total, sum(weight) over () as mass,
    coalesce(sum(cap) over (order by cap * 10 // weight, no rows between unbounded preceding and 1 preceding), 0) as capped,
    coalesce(sum(weight) over (order by cap * 10 // weight, no rows between unbounded preceding and 1 preceding), 0) as capped_weight,
    row_number() over (order by cap * 10 // weight, no) as r from v
), f as (
  select coalesce(min(case when cap * (mass - capped_weight) > (total - capped) * weight then r end), 1000000000) as stop from o
), l as (
  select o.*, stop, (select max(total - capped) filter (where r = stop) from o, f) as left_, (select max(mass - capped_weight) filter (where r = stop) from o, f) as mass_ from o, f
), t as (
  select source, source_size, docs, no, case when r < stop then cap::double else (left_ * weight)::bigint::double / mass_::bigint::double end as target from l
), a as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as epochs, ceil(sqrt(docs::double))::bigint as blocks from t
), b as (
  select d.doc_id, d.size, a.no, a.source_size, a.target, a.epochs, a.target - a.epochs * a.source_size as rest,
    ('0x' || substr(md5('mix|block|' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint % a.blocks as block
  from d join a on d.source is not distinct from a.source
), g as (
  select no, block, any_value(rest) as rest, any_value(epochs) as epochs, sum(size)::bigint as block_size, md5('mix|order|' || no || '|' || block) as k from b group by 1, 2
), h as (
  select no, block, rest, epochs, block_size, coalesce(sum(block_size) over (partition by no order by k, block rows between unbounded preceding and 1 preceding), 0)::bigint as before,
    row_number() over (partition by no order by k, block) - 1 as turn, count(*) over (partition by no) as used from g
), l0 as (
  select 0::bigint as first, 16::bigint as width, no, (any_value(epochs) * any_value(used) + count(*) filter (where before < rest))::bigint as quota from h group by no
),"""
    + ",".join(map(_level_sql, range(SHARDS.bit_length() - 1)))
    + r""", ends as (
  select first as shard, no, (sum(quota) over (partition by no order by first) - quota)::bigint as lo, (sum(quota) over (partition by no order by first))::bigint as hi from l4
), draws as (
  select h.no, h.block, shard, e as epoch from h, range(0, 4) r(e), ends where ends.no = h.no and e * used + turn >= lo and e * used + turn < hi
), j as (
  select b.*, h.block_size, h.before, sum(b.size) over (partition by b.no, b.block order by md5('mix|doc|' || coalesce(b.doc_id::varchar, '')), b.doc_id, b.size rows between unbounded preceding and current row) as upto, row_number() over () as rn
  from b join h on b.no = h.no and b.block = h.block
)
select doc_id, size, source_size, target, (size * count(shard))::bigint as taken,
  coalesce(string_agg(shard || ':' || epoch || ':' || """
    + _unit_sql("'mix'", "'place'", "coalesce(doc_id::varchar, '')", "epoch")
    + r""", ',' order by epoch), '') as draws
from j left join draws on draws.no = j.no and draws.block = j.block and size > 0 and (epoch < epochs or before + block_size <= rest or before + upto - size / 2.0 <= rest)
group by rn, doc_id, size, source_size, target
"""
)

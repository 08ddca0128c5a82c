"""WARC records, volumes and Merkle fixity audits of replicas.

Records. Pages become WARC/1.1 resource records, laid out in volumes of a fixed
number of ids; the running length gives every record its offset. A leaf has the
offset, length and SHA-256 of a record's bytes. A node covers up to ``FANOUT`` children in
order: it has their joint offset range, and its hash is over the child ranges
(relative to its own start) and hashes, up to one root a volume.

Audit. A replica is read back from its own files and has its own offsets and tree.
Roots are compared first, and only below mismatching
nodes are the children compared, level by level, so what is joined shrinks to
the damaged branches. The leaves reached are matched by content within their volume, as
a lost or longer record moves what follows: what has a counterpart of the same
bytes is intact; what has one of the same record name is ``corrupt``; other
leaves are ``missing`` or, if the replica alone has them, ``surplus``.

Scale. Groups are volumes and nodes, both of bounded size; levels are as
many as the logarithm of the largest volume and each is a checkpoint of one sixteenth of the one below.
A volume's file is what a task holds in memory when it is read.

Defined results: null html is an empty payload and a null url an empty target;
rows without an id go to volumes by content hash; repeated rows are records of their own, in
the order of id, length and digest, and equal ones are matched in order; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, remove, shared_folder

FANOUT, VOLUME_IDS = 16, 1000
#: Pages carry no capture date, and a record must have one.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", volume_ids: int = VOLUME_IDS, date: str = DATE) -> DataFrame:
    """(page_id, volume, name, html, record): the WARC record of every page, as text; ``html`` is its payload."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), url))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    volume = F.coalesce(F.expr(f"`{id_col}` div {volume_ids}"), -1 - F.pmod(F.xxhash64(body), F.lit(64)))
    return pages.select(F.col(id_col).alias("page_id"), volume.alias("volume"), name.alias("name"), body.alias("html"), F.concat(head, body, F.lit(END)).alias("record"))


def manifest(recs: DataFrame) -> DataFrame:
    """(page_id, volume, name, ordinal, offset, length, digest): the leaves, in offset order."""
    leaf = recs.select("page_id", "volume", "name", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = W.partitionBy("volume").orderBy("page_id", "length", "digest")
    return leaf.withColumn("ordinal", F.row_number().over(order).cast("long") - 1).withColumn(
        "offset", F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )


def stored(found: DataFrame) -> DataFrame:
    """(volume, name, ordinal, offset, length, digest): the leaves of volumes that were read back."""
    order = W.partitionBy("volume").orderBy("offset")
    return found.select("volume", "name", (F.row_number().over(order).cast("long") - 1).alias("ordinal"), "offset", "length", "digest")


def tree(leaves: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Level 0 (leaves) to the roots: (volume, node, offset, length, hash) each."""
    level = leaves.select("volume", F.col("ordinal").alias("node"), "offset", "length", F.col("digest").alias("hash"))
    out = [level]
    for _ in range(levels):
        child = F.array_sort(F.collect_list(F.struct("node", "offset", "length", "hash")))
        above = level.groupBy("volume", F.expr(f"node div {fanout}").alias("node")).agg(child.alias("c"), F.sum("length").alias("length"))
        first = F.get("c", F.lit(0)).offset
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x.offset - first).cast("string"), x.length.cast("string"), x.hash)), ",")
        level = cut(above.select("volume", "node", first.alias("offset"), "length", F.sha2(text, 256).alias("hash")))
        out.append(level)
    return out


def depth(leaves: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves until every volume has one root."""
    top, n = leaves.agg(F.max("ordinal")).first()[0] or 0, 0
    while top:
        top //= fanout
        n += 1
    return n


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(volume, side, ordinal, status): damaged records; side ``left`` for corrupt and missing ones, ``right`` (the replica) for surplus ones."""
    left, right = cut(left.select("volume", "name", "ordinal", "offset", "length", "digest")), cut(right.select("volume", "name", "ordinal", "offset", "length", "digest"))
    levels = max(depth(left, fanout), depth(right, fanout))
    below = None
    for a, b in zip(reversed(tree(left, levels, fanout)), reversed(tree(right, levels, fanout)), strict=True):
        if below is not None:
            parent = below.select(F.col("volume").alias("_volume"), F.col("node").alias("_node"))
            a, b = (x.join(parent, (F.col("volume") == F.col("_volume")) & (F.expr(f"node div {fanout}") == F.col("_node")), "left_semi") for x in (a, b))
        pick = lambda x, c: x.select("volume", "node", F.struct("length", "hash").alias(c))
        both = pick(a, "da").join(pick(b, "db"), ["volume", "node"], "full")
        below = cut(both.filter(~F.col("da").eqNullSafe(F.col("db"))).select("volume", "node"))
    leaf = below.select("volume", F.col("node").alias("ordinal"))
    sides = [x.join(leaf, ["volume", "ordinal"], "left_semi").withColumn("side", F.lit(s)) for s, x in (("left", left), ("right", right))]
    rows = sides[0].unionByName(sides[1])
    # the k-th record of some bytes on one side is that of the other
    rank = lambda key, order: F.row_number().over(W.partitionBy("volume", "side", key).orderBy(order))
    rows = rows.withColumn("_k", rank("digest", F.col("ordinal")))
    alone = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("volume", "digest", "_k"))).filter("_n = 1")
    # of equal records on a side the last ones are those without a counterpart
    alone = cut(alone.groupBy("volume", "side", "digest").agg(F.count(F.lit(1)).alias("_c")))
    every = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))
    rest = every.join(alone, ["volume", "side", "digest"]).withColumn("_k", rank("digest", F.desc("ordinal"))).filter("_k <= _c")
    # then, of what is left, the k-th of a name
    rest = rest.withColumn("_k", rank("name", F.col("ordinal")))
    rest = rest.withColumn("_n", F.when(F.col("name").isNull(), 1).otherwise(F.count(F.lit(1)).over(W.partitionBy("volume", "name", "_k"))))
    status = F.when(F.col("_n") == 2, "corrupt").when(F.col("side") == "left", "missing").otherwise("surplus")
    return rest.withColumn("status", status).filter("side = 'left' or status = 'surplus'").select("volume", "side", "ordinal", "status")


def write_volumes(recs: DataFrame, path: str) -> None:
    """One gzipped WARC file per volume, written by Spark's text sink in the order of the manifest; records end as WARC's do."""
    rows = recs.select("volume", "page_id", F.expr("left(record, char_length(record) - 4)").alias("value"), F.octet_length("record").alias("_l"), F.sha2("record", 256).alias("_d"))
    (rows.repartition("volume").sortWithinPartitions("volume", "page_id", "_l", "_d").select("volume", "value")
     .write.partitionBy("volume").option("lineSep", END).option("compression", "gzip").text(path))


def parse(data: bytes) -> list[tuple]:
    """(offset, length, name, uri, payload, good, digest) of the records of a file; after a broken one, reading goes on at the next record's head."""
    import hashlib

    rows, at, n = [], 0, len(data)
    start, stop = b"WARC/1.1\r\n", END.encode()
    while at < n:
        head_end = data.find(stop, at)
        head = dict(x.split(b": ", 1) for x in data[at : head_end if head_end >= 0 else n].split(b"\r\n")[1:] if b": " in x)
        size = head.get(b"Content-Length", b"")
        end = head_end + 4 + int(size) + 4 if head_end >= 0 and size.isdigit() else -1
        good = data.startswith(b"WARC/", at) and 0 < end <= n and data[end - 4 : end] == stop and (end == n or data.startswith(start, end))
        if not good:
            follow = data.find(stop + start, at + 4)
            end = n if follow < 0 else follow + 4
        text = lambda k: head[k].decode("utf-8", "replace") if k in head else None  # noqa: E731, B023
        name = (text(b"WARC-Record-ID") or "").removeprefix("<urn:md5:").removesuffix(">") or None
        rows.append((at, end - at, name, text(b"WARC-Target-URI"), data[head_end + 4 : end - 4] if good else None, good, hashlib.sha256(data[at:end]).hexdigest()))
        at = end
    return rows


def read_volumes(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(path, volume, offset, length, name, uri, payload, good, digest) of the records of WARC files, gzipped or not."""

    def run(batches):
        import gzip

        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.string())
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                data = batch.column("content")[i].as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [(batch.column("path")[i].as_py(), *r[:4], r[4] if payloads else None, *r[5:]) for r in parse(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "offset", "length", "name", "uri", "payload", "good", "digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInArrow(run, "path string, offset long, length long, name string, uri string, payload binary, good boolean, digest string")
    return found.withColumn("volume", F.regexp_extract("path", r"volume=(-?\d+)/", 1).try_cast("long"))


def decayed(recs: DataFrame) -> DataFrame:
    """A replica that has decayed by a rule: by the md5 of its id modulo 64 a record has a changed character (5), has
    lost half of its payload (6), is gone (7) or is there twice (8); records without an id or payload stay."""
    fate = F.when(F.col("html") != "", F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("long") % 64)
    size = F.char_length("html")
    changed = F.overlay("record", F.lit("\x01"), F.char_length("record") - 4 - F.expr("char_length(html) div 2"))
    shorter = F.concat(F.expr("left(record, char_length(record) - 4 - (char_length(html) + 1) div 2)"), F.lit(END))
    worn = F.when(fate == 5, changed).when((fate == 6) & (size > 0), shorter).otherwise(F.col("record"))
    kept = recs.withColumn("_fate", fate).withColumn("record", worn).filter(F.coalesce(F.col("_fate") != 7, F.lit(True)))
    return kept.withColumn("_copy", F.explode(F.when(F.col("_fate") == 8, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_fate", "_copy")


def query(spark, sf_dir):
    """Audit of the pages' volumes against the files of a replica that has decayed by a rule."""
    import uuid

    from .common import table

    recs = records(table(spark, sf_dir, "pages"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_volumes(decayed(recs), folder)
    leaves, other = cut(manifest(recs)), cut(stored(read_volumes(spark, folder, payloads=False)))
    remove(spark, folder)
    found = cut(audit(leaves, other))
    side = lambda s: found.filter(F.col("side") == s).drop("side")
    own = leaves.join(side("left"), ["volume", "ordinal"], "left")
    more = other.join(side("right"), ["volume", "ordinal"]).withColumn("page_id", F.lit(None).cast(leaves.schema["page_id"].dataType))
    out = own.unionByName(more)
    return out.select("page_id", "volume", "ordinal", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


ORACLE = r"""
with p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html, page_id // 1000 as volume, case when coalesce(html, '') <> '' then ('0x' || substr(md5(page_id::varchar), 1, 6))::bigint % 64 end as fate from pages
), r as (
  select page_id, volume, fate, html, crlf, 'WARC/1.1' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:md5:' || md5(page_id || '|' || url) || '>' || crlf || 'WARC-Date: 1970-01-01T00:00:00Z' || crlf || 'WARC-Target-URI: ' || url || crlf
    || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || strlen(html) || crlf || crlf || html || crlf || crlf as record
  from p, (select chr(13) || chr(10) as crlf)
), d as (
  select page_id, volume, fate, strlen(record) as length, sha256(record) as digest,
    case when fate = 6 then left(record, length(record) - 4 - (length(html) + 1) // 2) || crlf || crlf else record end as held from r
), o as (
  select page_id, volume, row_number() over w - 1 as ordinal, coalesce(sum(length) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as offset, length, digest,
    case when fate = 7 then 'missing' when fate in (5, 6) then 'corrupt' else 'intact' end as status
  from d window w as (partition by volume order by page_id, length, digest)
), h as (
  select d.volume, d.page_id, strlen(held) as length, digest, copy, fate from d, (select unnest([1, 2]) as copy) where fate is distinct from 7 and (copy = 1 or fate = 8)
), s as (
  select volume, row_number() over w - 1 as ordinal, coalesce(sum(length) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as offset, length, digest, copy from h window w as (partition by volume order by page_id, copy)
)
select * from o union all select null, volume, ordinal, "offset", length, digest, 'surplus' from s where copy = 2
"""

"""Queries over sampled signals and groups of voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import mix as M
from cadenza.sources.shared import cut

from .bindings import bound, duck, tasks_for
from .registry import query

_DENSE = duck("samples") + """, places as (select song, voice, frame // 4096 as chunk, max(frame % 4096) as top from samples group by 1, 2, 3),
wide as (select song, voice, chunk, chunk * 4096 + f as frame, ch::int as channel from places, lateral (select unnest(range(0, top + 1)) as f), (select unnest(range(0, 2)) as ch)),
dense as (select w.*, coalesce(s.sample, 0) as sample from wide w left join samples s on s.song = w.song and s.voice = w.voice and s.frame = w.frame and s.channel = w.channel)
"""
_VOLUME = "case voice when 'AF' then -3.0::double when 'NO' then 2.5::double else 0.0::double end"


#: Rows of lineitem whose chunks a task has: some 500 chunks of 64 kB, half of an Arrow batch.
ROWS = 1_000_000


def tasks(spark, sf):
    return tasks_for(bound(spark, sf, "lineitem"), ROWS)


def chunks(spark, sf):
    return M.to_chunks(bound(spark, sf, "samples"), 2, tasks=tasks(spark, sf))


def volumes(spark, sf):
    return _panned(bound(spark, sf, "samples").select("song", "voice").distinct())


def _panned(v):
    return v.withColumn("volume", F.expr("case voice when 'AF' then -3.0D when 'NO' then 2.5D else 0.0D end")).withColumn("pan", F.expr("case voice when 'AF' then -0.25D when 'RF' then 0.5D end"))


@query("peak", duck("samples") + "select song, max(abs(sample)) as peak from samples group by 1")
def _peak(spark, sf):
    return M.peak(chunks(spark, sf))


@query("length", duck("samples") + "select song, max(frame) + 1 as frames, count(distinct voice) as voices from samples group by 1")
def _length(spark, sf):
    return M.length(chunks(spark, sf))


_MIXED = """, summed as (select song, chunk, frame, channel, sum((sample * GAIN) >> 10)::bigint as s from dense group by 1, 2, 3, 4),
tops as (select song, max(abs(s)) as peak from summed group by 1),
mixed as (select song, chunk, frame, channel, greatest(least(round_even(s * case when peak >= 3276 then 32767.0::double / peak else 1.0::double end, 0)::bigint, 32767), -32767) as s from summed join tops using (song))
"""
_DIGEST = """select song, chunk, (count(*))::int as n, sum(s)::bigint as total, sum(s * ((frame - chunk * 4096) * 2 + channel))::bigint as moment from mixed group by 1, 2"""


def _digest(mixed):
    moment = F.aggregate(F.transform("samples", lambda s, i: s * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return mixed.select("song", "chunk", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), moment.alias("moment"))


@query("mix", _DENSE + _MIXED.replace("GAIN", f"round_even(pow(10.0, {_VOLUME} / 20) * 1024, 0)::bigint") + _DIGEST)
def _mix(spark, sf):
    return _digest(M.mix(chunks(spark, sf), volumes(spark, sf), tasks=tasks(spark, sf)))


@query("mix_variants", """with g as (select o_custkey // 100 as key, list(distinct o_orderpriority order by o_orderpriority) as groups from orders group by 1)
select key, v as variant, array_to_string(list_filter(groups, lambda x, i: (v >> (i - 1)) & 1 = 1), ',') as members from g, lateral (select unnest(range(0, 1 << len(groups)))::bigint as v)""")
def _variants(spark, sf):
    g = bound(spark, sf, "orders").groupBy(F.expr("o_custkey div 100").alias("key")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("groups"))
    return M.mix_variants(g).select("key", "variant", F.array_join("members", ",").alias("members"))


@query("shift_padding", duck("samples") + "select song, voice, max(frame) + 1 + 1234 as frames, min(frame // 4096) * 4096 + 1234 as first_frame from samples group by 1, 2")
def _shift(spark, sf):
    got = M.rechunk(M.shift_padding(chunks(spark, sf), 1.234, 1000))
    return got.groupBy("song", "voice").agg(F.max(F.col("frame0") + F.size("samples") / 2).cast("long").alias("frames"), F.min("frame0").alias("first_frame"))


_TRACKS = """, tracks as (select distinct o_orderpriority as track, o_orderstatus as "group" from orders),
groups as (select distinct o_orderstatus as "group", l_returnflag || l_linestatus as voice from lineitem join orders on l_orderkey = o_orderkey),
chosen as (select distinct s.song, track, voice from tracks join groups using ("group") join (select distinct song, voice from samples) s using (voice))
"""


def tracks(spark, sf):
    t = bound(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("track")).agg(F.collect_set("o_orderstatus").alias("groups"))
    return t.withColumn("amplification", (F.length("track") % 3).cast("double") - 1)


def groups(spark, sf):
    li = bound(spark, sf, "lineitem")
    return li.join(bound(spark, sf, "orders"), li.l_orderkey == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("group"), F.concat("l_returnflag", "l_linestatus").alias("voice")).distinct()


@query("expand_groups", duck("samples") + _TRACKS + "select song, track, voice, replace('mix-$.wav', '$', track) as file from chosen")
def _expand(spark, sf):
    return M.expand_groups(tracks(spark, sf), groups(spark, sf), bound(spark, sf, "samples")).select("song", "track", "voice", M.fill_template(F.lit("mix-$.wav"), F.col("track")).alias("file"))


@query("fill_pan", duck("samples") + ", v as (select distinct song, voice from samples) select song, voice, coalesce(case when song % 2 = 0 then 0.125::double end, case voice when 'AF' then -0.25::double when 'RF' then 0.5::double end, 0.0) as pan from v")
def _pan(spark, sf):
    m = bound(spark, sf, "samples").select("song", "voice").distinct().withColumn("pan", F.expr("case when song % 2 = 0 then 0.125D end"))
    return M.fill_pan(m, volumes(spark, sf).select("voice", "pan").distinct()).select("song", "voice", "pan")


@query("add_parallel_track", duck("samples") + f", v as (select distinct song, voice from samples) select song, voice, {_VOLUME} as volume, case voice when 'AF' then -0.25::double when 'RF' then 0.5::double end as pan from v union all select distinct song, 'parallel', 1.5::double, 0.0::double from v")
def _parallel(spark, sf):
    v = volumes(spark, sf)
    return M.add_parallel_track(v, v.select("song").distinct().select("song", F.lit("parallel").alias("voice"), F.lit(1.5).alias("volume")))


_TWO = "with a as (select distinct o_custkey // 100 as song, o_orderpriority || o_orderkey % 40 as voice from orders where o_orderstatus = 'F'), b as (select distinct o_custkey // 100 as song, o_orderpriority || o_orderkey % 40 as voice from orders where o_orderstatus <> 'F') "


@query("voice_sets", _TWO + "select song, voice, 'both' as kind from (select * from a intersect select * from b) union all select song, voice, 'left' from (select * from a except select * from b)")
def _sets(spark, sf):
    o = bound(spark, sf, "orders").selectExpr("o_custkey div 100 as song", "concat(o_orderpriority, o_orderkey % 40) as voice", "o_orderstatus")
    a, b = o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")
    return M.intersect_voices(a, b).withColumn("kind", F.lit("both")).unionByName(M.subtract_voices(a, b).withColumn("kind", F.lit("left")))


_PANS = "case voice when 'AF' then -0.25::double when 'RF' then 0.5::double end"


@query("mixdown", _DENSE + _TRACKS + f""", part as (select d.song || '/' || track as song, length(track) % 3 - 1 as amp, d.chunk, d.frame, d.channel, ((d.sample * round_even(case when d.channel = 0 then case when p < 0 then 1.0::double else 1 - p end else case when p > 0 then 1.0::double else 1 + p end end * 1024, 0)::bigint) >> 10) * g >> 10 as s
  from (select d.*, track, coalesce(case when voice <> 'NO' and length(track || voice) % 2 = 0 then 0.25::double end, {_PANS}, 0.0::double) as p, round_even(pow(10.0, case when voice = 'NO' then 0.0::double else (length(track) % 5)::double - 2 end / 20) * 1024, 0)::bigint as g from dense d join chosen using (song, voice)) d),
summed as (select song, chunk, frame, channel, any_value(amp) as amp, sum(s)::bigint as s from part group by 1, 2, 3, 4),
tops as (select song, max(abs(s)) as peak from summed group by 1),
mixed as (select song, chunk, frame, channel, greatest(least(round_even(s * case when peak >= 3276 then 32767.0::double * pow(2.0, amp::double / 6.0206) / peak else 1.0::double end, 0)::bigint, 32767), -32767) as s from summed join tops using (song))
""" + _DIGEST)
def _mixdown(spark, sf):
    """The voices' samples and the two small tables of tracks and groups are evaluated once."""
    pcm, t, g = cut(chunks(spark, sf)), cut(tracks(spark, sf)), cut(groups(spark, sf))
    pairs = t.select("track", F.explode("groups").alias("group")).join(g, "group").select("track", "voice").distinct().filter("voice != 'NO'")
    settings = pairs.select("track", "voice", ((F.length("track") % 5).cast("double") - 2).alias("volume"), F.when((F.length("track") + F.length("voice")) % 2 == 0, 0.25).alias("pan"))
    return _digest(M.mixdown(pcm, t, g, _panned(pcm.select("song", "voice").distinct()), settings, tasks(spark, sf)))


@query("variant_peaks", duck("samples") + """, gsum as (select song, g, frame, channel, sum(sample) as s from (select *, unnest([substr(voice, 1, 1), substr(voice, 2, 1)]) as g from samples) group by 1, 2, 3, 4),
idx as (select song, g, row_number() over (partition by song order by g) - 1 as i, count(*) over (partition by song) as n from (select distinct song, g from gsum)),
v as (select song, unnest(range(1 << n)) as variant from (select distinct song, n from idx)),
t as (select song, variant, frame, channel, abs(sum(s)) as t from v join idx using (song) join gsum using (song, g) where (variant >> i) & 1 = 1 group by 1, 2, 3, 4)
select song, variant, coalesce(max(t), 0)::bigint as peak from v left join t using (song, variant) group by 1, 2""")
def _peaks(spark, sf):
    """The peaks of all mixes of a song's voices by the two letters of their names."""
    members = bound(spark, sf, "samples").select("voice").distinct().select(F.explode(F.array(F.substring("voice", 1, 1), F.substring("voice", 2, 1))).alias("group"), "voice")
    return M.variant_peaks(chunks(spark, sf), members, tasks(spark, sf))

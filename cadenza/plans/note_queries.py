"""Queries over notes, grids and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import cues as Q
from cadenza.operators import grid as G
from cadenza.operators import humanize as H
from cadenza.operators import notes as N
from cadenza.operators.mix import shift_cues

from .bindings import TPQ, bound, duck, tasks_for
from .registry import query

#: Events of a task that has whole songs.
EVENTS = 250_000

_SIG_SPARK = "select cast(o_custkey div 100 as bigint) as song, o_orderkey % 60 * 192 as time, max(2 + o_orderkey % 5) as num, max(case when o_orderkey % 3 = 0 then 8 else 4 end) as den from {orders} group by 1, 2"
_SIG = "select cast(o_custkey // 100 as bigint) as song, o_orderkey % 60 * 192 as time, max(2 + o_orderkey % 5)::bigint as num, max(case when o_orderkey % 3 = 0 then 8 else 4 end)::bigint as den from orders group by 1, 2"


def signatures(spark, sf):
    got = spark.sql(_SIG_SPARK, orders=bound(spark, sf, "orders"))
    return got.select("song", "time", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den"))


def lasts(spark, sf):
    return bound(spark, sf, "notes").groupBy("song").agg(F.max("midi_time").alias("last_time"))


def grid(spark, sf, count_in=1):
    return G.measure_grid(signatures(spark, sf), lasts(spark, sf), TPQ, count_in)


def plain_grid(spark, sf):
    """Four quarters throughout: a grid without signatures."""
    none = signatures(spark, sf).filter("false")
    return G.measure_grid(none, lasts(spark, sf), TPQ, 0)


_GRID = (
    duck("notes").replace("with ", "with recursive ", 1)
    + f""", lasts as (select song, max(midi_time) as last_time from notes group by 1),
sigs as (select *, row_number() over (partition by song order by time) as rn from ({_SIG})),
fold as (
  select song, last_time, 0::bigint as rn, 0::bigint as t0, 0::bigint as m0, 384::bigint as ticks, 0::bigint as seg from lasts
  union all
  select f.song, f.last_time, s.rn, case when ok then s.time else f.t0 end, case when ok then f.m0 + (s.time - f.t0) // f.ticks else f.m0 end,
    case when ok then round_even(round_even(s.num * 4.0 / s.den, 3) * 96, 0)::bigint else f.ticks end, case when ok and s.time > f.t0 then f.seg + 1 else f.seg end
  from fold f join (select s.*, true as x from sigs s) s on f.song = s.song and s.rn = f.rn + 1,
    lateral (select s.time <= f.last_time and (s.time - f.t0) % f.ticks = 0 and s.time >= f.t0 as ok)
), segs as (select song, last_time, seg, arg_max(t0, rn) as t0, arg_max(m0, rn) as m0, arg_max(ticks, rn) as ticks from fold group by 1, 2, 3),
nx as (select *, lead(t0) over (partition by song order by seg) as until from segs),
grid as (
  select song, m0 + k as measure, t0 + k * ticks as t_start, case when until is null and k = n - 1 then null else t0 + (k + 1) * ticks end as t_end
  from (select *, coalesce((until - t0) // ticks, (last_time - t0) // ticks + 2) as n from nx), lateral (select unnest(range(0, n)) as k)
)
"""
)


@query("measure_grid", _GRID + "select song, measure, t_start, t_end from grid")
def _grid(spark, sf):
    return grid(spark, sf).select("song", "measure", "t_start", "t_end")


@query("locate_measure", _GRID + """select n.song, n.track, n.seq, g.measure, g.t_start from notes n asof join grid g on n.song = g.song and n.midi_time >= g.t_start""")
def _locate(spark, sf):
    return G.locate_measure(bound(spark, sf, "notes"), grid(spark, sf)).select("song", "track", "seq", "measure", "t_start")


@query("music_time", _GRID + """select n.song, n.track, n.seq, g.measure::int as measure, ((n.midi_time - g.t_start) // 96 + 1)::int as quarter, ((n.midi_time - g.t_start) % 96 // 24 + 1)::int as sixteenth,
  ((n.midi_time - g.t_start) % 24 + 1)::int as remainder, n.midi_time as ticks from notes n asof join grid g on n.song = g.song and n.midi_time >= g.t_start""")
def _music_time(spark, sf):
    got = G.locate_measure(bound(spark, sf, "notes"), grid(spark, sf)).withColumn("t", G.music_time(F.col("midi_time"), F.col("measure"), F.col("t_start"), TPQ))
    return got.select("song", "track", "seq", "t.measure", "t.quarter", "t.sixteenth", "t.remainder", G.to_ticks(F.col("t"), F.col("t_start"), TPQ).alias("ticks"))


@query("duration_time", """select l_orderkey, l_linenumber, trunc(d / 384.0)::int as measure, (sign(d) * (abs(d) % 384 // 96))::int as quarter, (sign(d) * (abs(d) % 96 // 24))::int as sixteenth, (sign(d) * (abs(d) % 24))::int as remainder
from (select l_orderkey, l_linenumber, (l_partkey - l_suppkey * 20) as d from lineitem)""")
def _duration(spark, sf):
    got = bound(spark, sf, "lineitem").withColumn("d", G.duration_time(F.col("l_partkey") - F.col("l_suppkey") * 20, 4 * TPQ, TPQ))
    return got.select("l_orderkey", "l_linenumber", "d.*")


@query("fill_forward", duck("changes", "notes") + """, p as (select distinct song, midi_time // 384 as measure from notes)
select p.song, p.measure, coalesce(c.tempo, 120.0) as tempo from p asof left join changes c on p.song = c.song and p.measure >= c.from_measure""")
def _fill(spark, sf):
    points = bound(spark, sf, "notes").select("song", F.floor(F.col("midi_time") / 384).alias("measure")).distinct()
    return G.fill_forward(points, bound(spark, sf, "changes"), ["song"], "measure", "from_measure", "tempo", 120.0).select("song", "measure", "tempo")


@query("match_position", duck("notes") + """, o as (select song, track, seq, midi_time % 384 as d from notes)
select song, track, seq, case when abs(d) <= 6 or abs(d - 384) <= 6 then 0 when abs(d - 96) <= 6 or abs(d - 480) <= 6 then 1 when abs(d - 192) <= 6 or abs(d - 576) <= 6 then 2 when abs(d - 288) <= 6 or abs(d - 672) <= 6 then 3 end::int as place from o""")
def _match(spark, sf):
    place = G.match_position(F.col("midi_time") % 384, F.lit(384), H.DEFAULT_STYLE, TPQ)
    return bound(spark, sf, "notes").select("song", "track", "seq", place.cast("int").alias("place"))


@query("peak_velocity", duck("notes") + "select song, track, midi_time, max(velocity) as peak from notes where kind = 'On' group by 1, 2, 3")
def _peak(spark, sf):
    return N.peak_velocity(bound(spark, sf, "notes"))


_PAIRS = """, o as (select *, kind = 'On' and velocity > 0 as is_on from notes),
pairs as (select *, case when is_on then case when not lead(is_on) over w then lead(seq) over w end else case when lag(is_on) over w then lag(seq) over w end end as partner_seq
  from o window w as (partition by song, track, pitch order by seq))
"""


@query("pair_notes", duck("notes") + _PAIRS + "select song, track, seq, partner_seq from pairs")
def _pair(spark, sf):
    return N.pair_notes(bound(spark, sf, "notes")).select("song", "track", "seq", "partner_seq")


@query("clip_overlaps", duck("notes") + _PAIRS + """, spans as (select a.song, a.track, a.pitch, a.seq, a.midi_time as start, b.midi_time + 500 as end_ from pairs a join pairs b on a.song = b.song and a.track = b.track and a.partner_seq = b.seq where a.is_on)
select song, track, pitch, seq, start, case when lead(start) over w <= end_ then lead(start) over w - 1 else end_ end as "end" from spans window w as (partition by song, track, pitch order by seq)""")
def _clip(spark, sf):
    paired = N.pair_notes(bound(spark, sf, "notes"))
    ends = paired.select("song", "track", F.col("seq").alias("partner_seq"), (F.col("midi_time") + 500).alias("end"))
    spans = paired.filter("kind = 'On' and velocity > 0 and partner_seq is not null").select("song", "track", "pitch", "seq", F.col("midi_time").alias("start"), "partner_seq")
    return N.clip_overlaps(spans.join(ends, ["song", "track", "partner_seq"]).drop("partner_seq"))


_VARYING = """, peaks as (select song, track, midi_time, max(velocity) as peak from notes where kind = 'On' group by 1, 2, 3),
steps as (select *, midi_time // 384 + 1 as measure, peak - lag(peak) over (partition by song, track, midi_time // 384 order by midi_time) as d from peaks),
varying as (select song, track, measure, coalesce(max((sign(d) * sign(e) < 0)::int), 0) = 1 as varying from (select *, lag(d) over (partition by song, track, measure order by midi_time) as e from steps) group by 1, 2, 3)
"""


@query("varying_measures", duck("notes") + _VARYING + "select song, track, measure, varying from varying")
def _varying(spark, sf):
    peaks = N.peak_velocity(bound(spark, sf, "notes")).withColumn("measure", F.floor(F.col("midi_time") / 384) + 1)
    return N.varying_measures(peaks)


@query("humanize", duck("notes") + _PAIRS + _VARYING + """, h as (
  select p.*, midi_time // 384 + 1 as measure, midi_time % 384 as d, coalesce(v.varying, false) as varying,
    2 * (('0x' || substr(md5('0|velocity|' || p.song || '|' || p.track || '|' || p.seq), 1, 8))::bigint / 4294967296.0::double) - 1 as xv,
    2 * (('0x' || substr(md5('0|timing|' || p.song || '|' || p.track || '|' || p.midi_time), 1, 8))::bigint / 4294967296.0::double) - 1 as xt
  from pairs p left join varying v on p.song = v.song and p.track = v.track and v.measure = p.midi_time // 384 + 1
), s as (
  select *, case when abs(d) <= 6 or abs(d - 384) <= 6 then 0 when abs(d - 96) <= 6 then 1 when abs(d - 192) <= 6 then 2 when abs(d - 288) <= 6 then 3 end as place from h
), t as (
  select *, case when varying then 1.0::double when place = 0 then 1.15::double when place in (1, 3) then 1.0::double when place = 2 then 1.1::double else 0.85::double end as f,
    case when place is null then abs(sign(xt) * xt * xt) else sign(xt) * xt * xt end as rt,
    case when place is null then round_even(12 * 0.25::double, 0) when place = 0 then 0.0::double else round_even(12 * 0.2::double, 0) end as unit
  from s
), n as (
  select *, case when is_on then midi_time + round_even(unit * rt, 0)::bigint else midi_time end as time_,
    case when is_on then greatest(least(trunc(velocity * (f + sign(xv) * xv * xv * 0.1::double))::bigint, 127), 0) else velocity end as v_ from t
)
select song, track, seq, kind, pitch, v_ as velocity,
  case when not is_on and partner_seq is not null and lag(is_on) over w and lead(is_on) over w and lead(time_) over w <= midi_time then lead(time_) over w - 1 else time_ end as midi_time
from n window w as (partition by song, track, pitch order by seq)""")
def _humanize(spark, sf):
    return H.humanize(bound(spark, sf, "notes"), plain_grid(spark, sf), tasks=tasks_for(bound(spark, sf, "events"), EVENTS)).select("song", "track", "seq", "midi_time", "kind", "pitch", "velocity")


_RANK = "case kind when 'Meta' then 1 when 'PrCh' then 2 when 'Par' then 3 when 'Off' then 7 when 'On' then 8 else 3 end"


@query("order_events", duck("midi") + f"select song, track_no, midi_time, kind, p2, row_number() over (partition by song, track_no order by midi_time, {_RANK}, seq) as seq from midi")
def _order(spark, sf):
    return N.order_events(bound(spark, sf, "midi")).select("song", "track_no", "midi_time", "kind", "p2", "seq")


_EMPTY = "song, track_no, track, 0::bigint as seq, 0::bigint as midi_time, 'Meta' as kind, 'TrkEnd' as meta, null::int as channel, null::int as p1, null::int as p2"


@query("keep_tracks", duck("midi") + f"""select * from midi where track_no = 0 or track like 'drums%' union all select distinct {_EMPTY} from midi where not (track_no = 0 or track like 'drums%')""")
def _keep(spark, sf):
    return N.keep_tracks(bound(spark, sf, "midi"), "drums")


@query("drop_controllers", duck("midi") + "select * from midi where not (kind = 'Par' and p1 in (7, 10, 91))")
def _drop(spark, sf):
    return N.drop_controllers(bound(spark, sf, "midi"))


@query("voice_events", duck("midi") + f"""select * from midi where (track_no = 0 or track like 'vocals%') and not (kind = 'Par' and p1 in (7, 10, 91)) union all select distinct {_EMPTY} from midi where not (track_no = 0 or track like 'vocals%')""")
def _voice(spark, sf):
    return H.voice_events(bound(spark, sf, "midi"), "vocals")


def track_settings(spark, sf):
    """Settings of the voices, from all suppliers by their nations."""
    s = bound(spark, sf, "supplier").withColumn("track", F.element_at(F.array(F.lit("vocals"), F.lit("drums"), F.lit("guitar")), F.least(F.col("s_nationkey"), F.lit(2)).cast("int") + 1))
    top = s.groupBy("track").agg(F.max("s_suppkey").alias("k"))
    value = lambda m: (F.col("k") * m % 200 - 20).cast("int")
    return N.clamp_track_settings(top.select("track", value(3).alias("channel"), (F.col("k") * 97).cast("int").alias("bank"), value(7).alias("program"), value(11).alias("volume"), value(13).alias("pan"), value(17).alias("reverb")))


_SETTINGS = """, raw as (select case s_nationkey when 0 then 'vocals' when 1 then 'drums' else 'guitar' end as track, max(s_suppkey) as k from supplier group by 1),
settings as (select track, greatest(least(k * 3 % 200 - 20, 15), 0)::int as channel, greatest(least(k * 97, 16383), 0)::int as bank, greatest(least(k * 7 % 200 - 20, 127), 0)::int as program,
  greatest(least(k * 11 % 200 - 20, 127), 0)::int as volume, greatest(least(k * 13 % 200 - 20, 127), 0)::int as pan, greatest(least(k * 17 % 200 - 20, 127), 0)::int as reverb from raw)
"""
_BASE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(track, ':', 1), '[A-G]$', ''), 'Top$', ''), 'Middle$', ''), 'Bottom$', ''), 'Extended$', '')"


@query("clamp_track_settings", duck("midi") + _SETTINGS + "select * from settings")
def _clamp(spark, sf):
    return track_settings(spark, sf)


@query("with_settings", duck("midi") + _SETTINGS + f"select m.song, m.track, m.seq, s.channel as set_channel, s.volume from (select *, {_BASE} as base from midi) m left join settings s on m.base = s.track")
def _with(spark, sf):
    s = track_settings(spark, sf).select("track", F.col("channel").alias("set_channel"), "volume")
    return N.with_settings(bound(spark, sf, "midi"), s).select("song", "track", "seq", "set_channel", "volume")


@query("rechannel", duck("midi") + _SETTINGS + f"select m.song, m.track, m.seq, m.kind, coalesce(s.channel, m.channel) as channel from (select *, {_BASE} as base from midi) m left join settings s on m.base = s.track where kind <> 'Par'")
def _rechannel(spark, sf):
    return N.rechannel(bound(spark, sf, "midi"), track_settings(spark, sf)).select("song", "track", "seq", "kind", "channel")


@query("expand_program_change", duck("midi") + _SETTINGS + f""", j as (select m.*, s.bank, s.program, s.volume, s.pan, s.reverb, s.track is not null as has, row_number() over (partition by song, track_no, kind = 'PrCh' order by seq) as n
  from (select *, {_BASE} as base from midi) m left join settings s on m.base = s.track)
select song, track_no, seq, kind, p1, p2, 0::int as part from j where not (kind = 'PrCh' and has)
union all select song, track_no, seq, (['Par', 'Par', 'PrCh', 'Par', 'Par', 'Par'])[i + 1], ([0, 32, program, 7, 10, 91])[i + 1], ([bank // 128, bank % 128, null, volume, pan, reverb])[i + 1], i::int
from j, (select unnest(range(0, 6)) as i) where kind = 'PrCh' and has and n = 1""")
def _expand(spark, sf):
    return N.expand_program_change(bound(spark, sf, "midi"), track_settings(spark, sf)).select("song", "track_no", "seq", "kind", "p1", "p2", "part")


@query("replace_bad_tracks", duck("midi") + f""", c as (select *, count(*) over (partition by song, track_no) + 1 as n from midi)
select song, track_no, track, seq, midi_time, kind, meta, channel, p1, p2 from c where not (track like '%new:%' or n < 200)
union all select distinct {_EMPTY} from c where track like '%new:%' or n < 200""")
def _bad(spark, sf):
    return N.replace_bad_tracks(bound(spark, sf, "midi"), 200)


@query("name_tracks", """with t as (select c_nationkey as song, c_custkey as track_no, case when c_custkey % 3 = 0 then c_name || ':x' else '' end as track,
  case c_custkey % 4 when 0 then 'power kit' when 1 then 'reed organ' when 2 then 'flute ' || c_custkey % 7 else 'organ ' || c_custkey % 11 end as instrument from customer),
u as (select *, track_no <> 0 and track = '' as u, case instrument when 'power kit' then 'drums' when 'reed organ' then 'bass' else instrument end as b from t)
select song, track_no, case when u then b || case when row_number() over w = 1 then '' else substr('ABCDEF', (row_number() over w - 1)::int, 1) end else split_part(track, ':', 1) end as track
from u window w as (partition by song, u, case when u then b end order by track_no)""")
def _name(spark, sf):
    t = bound(spark, sf, "customer").selectExpr(
        "c_nationkey as song", "c_custkey as track_no", "case when c_custkey % 3 = 0 then concat(c_name, ':x') else '' end as track",
        "case c_custkey % 4 when 0 then 'power kit' when 1 then 'reed organ' when 2 then concat('flute ', c_custkey % 7) else concat('organ ', c_custkey % 11) end as instrument",
    )
    return N.name_tracks(t).select("song", "track_no", "track")


@query("annotate_tracks", duck("midi") + """, e as (select *, case when seq % 50 = 0 then 'TrkName' else meta end as m, null::varchar as text from midi)
select song, track_no, seq, m as meta, text, 0 as part from e
union all select song, track_no, seq, 'Text', case when track = 'vocalsTop' then 'humanized at T' else 'processed at T' end, 1 from e where m = 'TrkName' and track in ('vocalsTop', 'drums')""")
def _annotate(spark, sf):
    e = bound(spark, sf, "midi").withColumn("meta", F.expr("case when seq % 50 = 0 then 'TrkName' else meta end")).withColumn("text", F.lit(None).cast("string"))
    return N.annotate_tracks(e, ["vocalsTop", "drums"], ["vocals"], "T").select("song", "track_no", "seq", "meta", "text", "part")


_STANDARD = f""", u as (select song, track_no, 'bass' || case when row_number() over w = 1 then '' else substr('ABCDEF', (row_number() over w - 1)::int, 1) end as name from (select distinct song, track_no from midi where track_no % 2 = 1) window w as (partition by song order by track_no)),
named as (select m.* exclude (track), coalesce(u.name, split_part(m.track, ':', 1)) as track, count(*) over (partition by m.song, m.track_no) + 1 < 5 as bad from midi m left join u on m.song = u.song and m.track_no = u.track_no),
rewritten as (select song, track_no, track, seq, midi_time, kind, meta, channel, p1, p2 from named where not bad union all select distinct {_EMPTY} from named where bad),
o as (select *, p1 as pitch, p2::bigint as velocity, midi_time // 384 + 1 as measure, kind = 'On' and p2 > 0 as is_on from rewritten where kind in ('On', 'Off')),
pairs as (select *, case when is_on then case when not lead(is_on) over w then lead(seq) over w end else case when lag(is_on) over w then lag(seq) over w end end as partner_seq from o window w as (partition by song, track, pitch order by seq)),
peaks as (select song, track, midi_time, max(velocity) as peak from o where kind = 'On' group by 1, 2, 3),
steps as (select *, midi_time // 384 + 1 as measure, peak - lag(peak) over (partition by song, track, midi_time // 384 order by midi_time) as d from peaks),
varying as (select song, track, measure, coalesce(max((sign(d) * sign(e) < 0)::int), 0) = 1 as varying from (select *, lag(d) over (partition by song, track, measure order by midi_time) as e from steps) group by 1, 2, 3),
h as (
  select p.*, midi_time % 384 as d, coalesce(v.varying, false) as varying, is_on and p.track in ('drums', 'bass') as hit,
    2 * (('0x' || substr(md5('0|velocity|' || p.song || '|' || p.track || '|' || p.seq), 1, 8))::bigint / 4294967296.0::double) - 1 as xv,
    2 * (('0x' || substr(md5('0|timing|' || p.song || '|' || p.track || '|' || p.midi_time), 1, 8))::bigint / 4294967296.0::double) - 1 as xt
  from pairs p left join varying v on p.song = v.song and p.track = v.track and v.measure = p.measure
), t as (
  select *, case when varying then 1.0::double when place = 0 then 1.15::double when place in (1, 3) then 1.0::double when place = 2 then 1.1::double else 0.85::double end as f,
    case when place is null then abs(sign(xt) * xt * xt) else sign(xt) * xt * xt end as rt,
    case when place is null then round_even(12 * 0.25::double, 0) when place = 0 then 0.0::double else round_even(12 * 0.2::double, 0) end as unit
  from (select *, case when abs(d) <= 6 or abs(d - 384) <= 6 then 0 when abs(d - 96) <= 6 then 1 when abs(d - 192) <= 6 then 2 when abs(d - 288) <= 6 then 3 end as place from h)
), n as (
  select *, case when hit then midi_time + round_even(unit * rt, 0)::bigint else midi_time end as time_,
    case when hit then greatest(least(trunc(velocity * (f + sign(xv) * xv * xv * 0.1::double))::bigint, 127), 0) else velocity end as v_ from t
), varied as (
  select song, track_no, track, seq, kind, meta, channel, p1, v_::int as p2,
    case when not is_on and partner_seq is not null and lag(hit) over w and lead(is_on) over w and lead(time_) over w <= midi_time then lead(time_) over w - 1 else time_ end as midi_time
  from n window w as (partition by song, track, pitch order by seq)
), every as (
  select song, track_no, track, seq, midi_time, kind, meta, channel, p1, p2 from rewritten where kind not in ('On', 'Off', 'Par') union all select song, track_no, track, seq, midi_time, kind, meta, channel, p1, p2 from varied
), j as (
  select e.* exclude (channel), coalesce(s.channel, e.channel) as channel, s.bank, s.program, s.volume, s.pan, s.reverb, s.track is not null as has, row_number() over (partition by e.song, e.track_no, e.kind = 'PrCh' order by e.seq) as n
  from (select *, {_BASE} as base from every) e left join settings s on e.base = s.track
), x as (
  select song, track_no, track, seq, midi_time, kind, meta, channel, p1, p2, 0 as part from j where not (kind = 'PrCh' and has)
  union all select song, track_no, track, seq, midi_time, (['Par', 'Par', 'PrCh', 'Par', 'Par', 'Par'])[i + 1], meta, channel, ([0, 32, program, 7, 10, 91])[i + 1], ([bank // 128, bank % 128, null, volume, pan, reverb])[i + 1], i
  from j, (select unnest(range(0, 6)) as i) where kind = 'PrCh' and has and n = 1
)
select song, track_no, track, midi_time, kind, coalesce(meta, '') as meta, coalesce(channel, -1)::int as channel, coalesce(p1, -1)::int as p1, coalesce(p2, -1)::int as p2,
  row_number() over (partition by song, track_no order by midi_time, {_RANK}, seq * 100 + part * 10) as seq from x
"""


@query("standardize", duck("midi") + _SETTINGS + _STANDARD)
def _standardize(spark, sf):
    """The whole rewrite of a corpus."""
    e = bound(spark, sf, "midi").withColumns({"text": F.lit(None).cast("string")})
    instruments = e.select("song", "track_no", F.when(F.col("track_no") % 2 == 0, F.col("track")).otherwise("").alias("track"), F.lit("reed organ").alias("instrument")).distinct()
    got = H.standardize(e, instruments, plain_grid(spark, sf), track_settings(spark, sf), "T", humanized=("drums", "bass"), tasks=tasks_for(bound(spark, sf, "events"), EVENTS))
    none = {c: F.coalesce(c, F.lit(-1)) for c in ("channel", "p1", "p2")}
    return got.withColumns({"meta": F.coalesce("meta", F.lit(""))} | none).select("song", "track_no", "track", "midi_time", "kind", "meta", "channel", "p1", "p2", "seq")


@query("assign_channels", """with v as (select n_regionkey as song, n_nationkey as pos, case when n_nationkey % 6 = 0 then 'drums' else n_name end as voice from nation union all select 10 + c_nationkey, c_custkey, case when c_custkey % 9 = 0 then 'percussion' else c_name end from customer),
c as (select *, least(sum(case when voice in ('drums', 'percussion') then 0 else 1 end) over (partition by song order by pos), 15) as n from v)
select song, pos, case when voice in ('drums', 'percussion') then 10 else n + case when n > 9 then 1 else 0 end end::int as channel from c""")
def _channels(spark, sf):
    a = bound(spark, sf, "nation").selectExpr("cast(n_regionkey as int) song", "cast(n_nationkey as bigint) pos", "case when n_nationkey % 6 = 0 then 'drums' else n_name end voice")
    b = bound(spark, sf, "customer").selectExpr("10 + c_nationkey song", "c_custkey pos", "case when c_custkey % 9 = 0 then 'percussion' else c_name end voice")
    return N.assign_channels(a.unionByName(b)).select("song", "pos", "channel")


@query("check_order", duck("midi") + """, m as (select *, case when seq % 7 = 0 then 'TrkEnd' end as me, lag(midi_time) over (partition by song, track_no order by seq) as p from midi)
select song, track_no, sum((midi_time < p)::int)::bigint as decreasing, coalesce(arg_max(coalesce(me, ''), seq), '') = 'TrkEnd' as ends from m group by 1, 2""".replace("sum((midi_time < p)::int)::bigint", "coalesce(sum((midi_time < p)::int), 0)::bigint"))
def _check(spark, sf):
    return N.check_order(bound(spark, sf, "midi").withColumn("meta", F.expr("case when seq % 7 = 0 then 'TrkEnd' end")))


@query("absolute_time", duck("midi") + "select song, track, seq, sum(midi_time % 97) over (partition by song, track order by seq)::bigint as midi_time from midi")
def _absolute(spark, sf):
    return G.absolute_time(bound(spark, sf, "midi").select("song", "track", "seq", (F.col("midi_time") % 97).alias("delta"))).select("song", "track", "seq", "midi_time")


@query("delta_time", duck("midi") + """, d as (select song, track, seq, midi_time - coalesce(lag(midi_time) over (partition by song, track order by seq), 0) as delta from midi) select *, delta < 0 as bad from d""")
def _delta(spark, sf):
    return G.delta_time(bound(spark, sf, "midi")).select("song", "track", "seq", "delta", "bad")


_DURATIONS = duck("changes", "notes") + """, p as (select distinct song, midi_time // 384 - 1 as measure from notes),
m as (select p.song, p.measure, coalesce(c.tempo, 120.0) as tempo from p asof left join changes c on p.song = c.song and p.measure >= c.from_measure),
durations as (select song, measure, tempo, case when tempo > 1 then 60 * 4.0::double / tempo * case when measure = 1 then 3 else 1 end end as seconds from m)
"""


def durations(spark, sf):
    points = bound(spark, sf, "notes").select("song", (F.floor(F.col("midi_time") / 384) - 1).alias("measure")).distinct()
    return G.measure_durations(points, bound(spark, sf, "changes"), count_in=2)


@query("measure_durations", _DURATIONS + "select song, measure, tempo, round(seconds, 9) as seconds from durations")
def _durations(spark, sf):
    return durations(spark, sf).select("song", "measure", "tempo", F.round("seconds", 9).alias("seconds"))


_PAGES = """, pages as (select cast(o_custkey // 100 as bigint) as song, o_orderkey % 30 as page, min(o_orderkey % 30 * 4 + 1) as first_measure from orders group by 1, 2),
pr as (select *, row_number() over (partition by song order by page) as r, lead(page) over (partition by song order by page) as nxt from pages),
pd as (select d.song, p.page, sum(seconds) as seconds from durations d asof join (select song, page, nxt, case when r = 1 then -1000000 else first_measure end as fm from pr) p on d.song = p.song and d.measure >= p.fm where p.nxt is not null group by 1, 2)
"""


def pages(spark, sf):
    return bound(spark, sf, "orders").groupBy(F.expr("cast(o_custkey div 100 as bigint)").alias("song"), (F.col("o_orderkey") % 30).alias("page")).agg(F.min(F.col("o_orderkey") % 30 * 4 + 1).alias("first_measure"))


@query("page_durations", _DURATIONS + _PAGES + "select song, page, round(seconds, 6) as seconds from pd")
def _pages(spark, sf):
    return G.page_durations(pages(spark, sf), durations(spark, sf)).select("song", "page", F.round("seconds", 6).alias("seconds"))


@query("cumulative_timeline", _DURATIONS + """select song, measure, round(coalesce(sum(seconds) over w, 0), 6) as start, round(coalesce(sum(seconds) over w, 0) + 0.95 * seconds, 6) as "end" from durations where measure >= 1
window w as (partition by song order by measure rows between unbounded preceding and 1 preceding)""")
def _timeline(spark, sf):
    return G.cumulative_timeline(durations(spark, sf)).select("song", "measure", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("quantize", _DURATIONS + _PAGES + """, q as (select song, page, floor(round(sum(seconds) over (partition by song order by page) * 24, 6)) as t from pd)
select song, page, (t - coalesce(lag(t) over (partition by song order by page), 0))::bigint as frames from q""")
def _quantize(spark, sf):
    return G.quantize(G.page_durations(pages(spark, sf), durations(spark, sf)), 24.0).select("song", "page", "frames")


@query("style_in_force", duck("notes") + """, p as (select distinct song, midi_time // 384 - 1 as measure from notes), s as (select cast(o_custkey // 100 as bigint) as song, o_orderkey % 40 - 2 as from_measure, max('style' || o_orderkey % 9) as style from orders group by 1, 2)
select p.song, p.measure, case when p.measure <= 1 then coalesce(o.style, 'default') else coalesce(c.style, 'default') end as style from p asof left join (select * from s where from_measure >= 1) c on p.song = c.song and p.measure >= c.from_measure left join s o on p.song = o.song and p.measure = o.from_measure""")
def _styles(spark, sf):
    points = bound(spark, sf, "notes").select("song", (F.floor(F.col("midi_time") / 384) - 1).alias("measure")).distinct()
    o = bound(spark, sf, "orders")
    s = o.groupBy(F.expr("cast(o_custkey div 100 as bigint)").alias("song"), (F.col("o_orderkey") % 40 - 2).alias("from_measure")).agg(F.max(F.concat(F.lit("style"), (F.col("o_orderkey") % 9).cast("string"))).alias("style"))
    return G.style_in_force(points, s).select("song", "measure", "style")


_CUES = """, line as (select song, measure, coalesce(sum(seconds) over w, 0) as s, coalesce(sum(seconds) over w, 0) + 0.95 * seconds as e from durations where measure >= 1 window w as (partition by song order by measure rows between unbounded preceding and 1 preceding)),
cues as (select song, measure::int as n, floor(round(s * 1000, 6))::bigint as start_ms, floor(round(e * 1000, 6))::bigint as end_ms, measure::varchar as text from line)
"""


@query("cues", _DURATIONS + _CUES + "select * from cues")
def _cues(spark, sf):
    return Q.cues(durations(spark, sf))


@query("shift_cues", _DURATIONS + _CUES + "select song, n, start_ms + 2800 as start_ms, end_ms + 2800 as end_ms, text from cues")
def _shift_cues(spark, sf):
    return shift_cues(Q.cues(durations(spark, sf)), 2.8)


@query("timeline", _DURATIONS + _PAGES + _CUES + """, q as (select song, page, floor(round(sum(seconds) over (partition by song order by page) * 25, 6)) as t from pd)
select song, page as no, (t - coalesce(lag(t) over (partition by song order by page), 0))::bigint as length, 'page' as kind from q union all select song, n, end_ms - start_ms, 'cue' from cues""")
def _timeline_all(spark, sf):
    points = bound(spark, sf, "notes").select("song", (F.floor(F.col("midi_time") / 384) - 1).alias("measure")).distinct()
    cues, frames = Q.timeline(points, bound(spark, sf, "changes"), pages(spark, sf), 2, 25.0)
    return frames.select("song", F.col("page").alias("no"), F.col("frames").alias("length"), F.lit("page").alias("kind")).unionByName(cues.select("song", F.col("n").cast("long").alias("no"), (F.col("end_ms") - F.col("start_ms")).alias("length"), F.lit("cue").alias("kind")))

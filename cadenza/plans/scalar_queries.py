"""Queries over the scalar functions, on values spelled from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalars as L
from cadenza.functions.nested import parse_nested

from .bindings import bound, duck
from .registry import query

c = F.col


@query("ranges", """select l_orderkey, l_linenumber, greatest(least(l_quantity, 40), 10) as clipped, l_discount between 0.02 and 0.05 as inside,
  case when x < -3 then -3 + ((x + 3) % 10 + 10) % 10 when x > 7 then 7 - ((7 - x) % 10 + 10) % 10 else x end as wrapped from (select *, (l_partkey % 101 - 50)::bigint as x from lineitem)""")
def _ranges(spark, sf):
    df = bound(spark, sf, "lineitem").withColumn("x", c("l_partkey") % 101 - 50)
    return df.select("l_orderkey", "l_linenumber", L.clip(c("l_quantity"), 10, 40).alias("clipped"), L.in_range(c("l_discount"), 0.02, 0.05).alias("inside"), L.wrap(c("x"), -3, 7).cast("long").alias("wrapped"))


@query("track_names", duck("midi") + """, n as (select seq, song, track || case seq % 5 when 0 then 'Bottom' when 1 then 'Simple' when 2 then 'A' when 3 then 'MiddleB' else ':2' end as t from midi)
select song, seq, t, case when m like '%Top' then replace(m, 'Top', '') else m end as canonical, regexp_replace(t, '(?:Simple|Extended)$', '') as label,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(t, ':', 1), '[A-G]$', ''), 'Top$', ''), 'Middle$', ''), 'Bottom$', ''), 'Extended$', '') as base
from (select *, case when b like '%Middle' then replace(b, 'Middle', '') else b end as m from (select *, case when t like '%Bottom' then replace(t, 'Bottom', '') else t end as b from n))""")
def _names(spark, sf):
    t = F.concat("track", F.expr("case seq % 5 when 0 then 'Bottom' when 1 then 'Simple' when 2 then 'A' when 3 then 'MiddleB' else ':2' end"))
    df = bound(spark, sf, "midi").withColumn("t", t)
    return df.select("song", "seq", "t", L.canonical_track(c("t")).alias("canonical"), L.voice_label(c("t")).alias("label"), L.base_track(c("t")).alias("base"))


@query("text_functions", r"""with x as (select p_partkey, p_name || ' = ' || p_brand || chr(10) || ' = x' as t, '''"' || p_name || '"''' as q from part)
select p_partkey, array_to_string(list_transform(string_split(t, '='), lambda s: trim(s, ' ')), '|') as parts, split_part(t, '=', 1) as head, substr(t, instr(t, '=') + 1) as tail,
  regexp_replace(regexp_replace(q, '^''(.*)''$', '\1', 's'), '^"(.*)"$', '\1', 's') as bare, case when length(t) > 12 then substr(t, 1, 11) || '…' else t end as short, replace(t, chr(10), '#') as line,
  array_to_string(list_transform(regexp_extract_all(p_name, '.'), lambda s: printf('%02X', unicode(s))), '') as codes from x join part using (p_partkey)""")
def _text(spark, sf):
    t = F.concat("p_name", F.lit(" = "), "p_brand", F.lit("\n = x"))
    once = L.split_once(t, "=")
    return bound(spark, sf, "part").select(
        "p_partkey", F.array_join(L.split_trim(t, "="), "|").alias("parts"), once.head.alias("head"), once.tail.alias("tail"), L.strip_quotes(F.concat(F.lit("'\""), "p_name", F.lit("\"'"))).alias("bare"),
        L.shorten(t, 12).alias("short"), L.one_line(t).alias("line"), L.to_hex(F.col("p_name")).alias("codes"),
    )


@query("infer_scalar", duck("settings") + r""", b as (select song::bigint as song, key, line::bigint as line, value_text from settings union all select 100 + c_nationkey, 'c', c_custkey, case when c_custkey % 2 = 0 then c_acctbal::varchar else '+' || c_custkey end from customer)
select song, line, case when upper(value_text) in ('TRUE', 'WAHR', 'FALSE', 'FALSCH') then 'bool' when regexp_matches(value_text, '^[+-]?\d+$') or regexp_matches(value_text, '^0x[0-9A-Fa-f]+$') then 'long' when regexp_matches(value_text, '^[+-]?\d+\.\d*$') then 'double' else 'text' end as value_type,
  coalesce(case when regexp_matches(value_text, '^0x') then value_text::bigint when regexp_matches(value_text, '^[+-]?\d+$') then value_text::bigint end, -1) as value_long,
  coalesce(case when regexp_matches(value_text, '^[+-]?\d+\.\d*$') then value_text::double end, -1) as value_double, case when upper(value_text) in ('TRUE', 'WAHR') then true when upper(value_text) in ('FALSE', 'FALSCH') then false end as value_bool from b""")
def _infer(spark, sf):
    from cadenza.operators.settings import typed

    s = bound(spark, sf, "settings").selectExpr("cast(song as long) song", "key", "cast(line as long) line", "value_text")
    b = bound(spark, sf, "customer").selectExpr("cast(100 + c_nationkey as long)", "'c'", "c_custkey", "case when c_custkey % 2 = 0 then cast(c_acctbal as string) else concat('+', c_custkey) end")
    got = typed(s.union(b))
    return got.select("song", "line", "value_type", F.coalesce("value_long", F.lit(-1)).alias("value_long"), F.coalesce("value_double", F.lit(-1.0)).alias("value_double"), "value_bool")


@query("tokenize", duck("lines") + r""", q as (select doc_id, linenum, line || ' "a b" c''d e''f' as t from lines)
select doc_id, linenum, array_to_string(regexp_extract_all(t, '(?:[^ ''"]|''[^'']*''|"[^"]*")+'), '|') as tokens from q""")
def _tokens(spark, sf):
    t = F.concat(F.col("line"), F.lit(" \"a b\" c'd e'f"))
    return bound(spark, sf, "lines").select("doc_id", "linenum", F.array_join(L.tokenize(t), "|").alias("tokens"))


@query("parse_list", """select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ',, ' || p_brand, ','), lambda s: trim(s, ' ')), lambda s: s <> ''), '|') as items from part""")
def _list(spark, sf):
    return bound(spark, sf, "part").select("p_partkey", F.array_join(L.parse_list(F.concat(F.lit("[ "), "p_name", F.lit(",, '"), "p_brand", F.lit("' ]"))), "|").alias("items"))


@query("parse_map", """select p_partkey, 2 as n, p_brand as name, p_size::varchar as size from part""")
def _map(spark, sf):
    m = L.parse_map(F.concat(F.lit("{ name : '"), "p_name", F.lit("', size: "), c("p_size").cast("string"), F.lit(", name: "), "p_brand", F.lit(" }")))
    return bound(spark, sf, "part").withColumn("m", m).select("p_partkey", F.size("m").alias("n"), F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("size")).alias("size"))


@query("parse_nested", """select p_partkey, p_name as name, p_size::int as size, p_brand as brand, (p_partkey % 100)::int as number, p_partkey % 2 = 0 as flag, case when p_partkey % 7 = 0 then 1 else 3 end::int as n, p_partkey % 11 = 0 as broken from part where p_partkey % 11 <> 0
union all select p_partkey, '', -1, '', -1, false, -1, true from part where p_partkey % 11 = 0""")
def _nested(spark, sf):
    """A literal of every part with maps and lists in each other, repeated keys and stray separators, every eleventh not closed."""
    text = F.concat(
        F.lit("{ name : 'none', name: '"), "p_name", F.lit("' , of: ["), F.expr("case when p_partkey % 7 = 0 then '' else ',, one two,' end"), F.lit(' {size:'), c("p_size").cast("string"), F.lit(', "brand x" : ('), F.lit("'"), "p_brand", F.lit("', 2) }"),
        F.expr("case when p_partkey % 7 = 0 then '' else ', x:y' end"), F.lit("], number: +0"), (c("p_partkey") % 100).cast("string"), F.lit(", flag : "), F.expr("case when p_partkey % 2 = 0 then 'WAHR' else 'false' end"), F.expr("case when p_partkey % 11 = 0 then '' else '}' end"),
    )
    v = bound(spark, sf, "part").select("p_partkey", parse_nested(text).alias("v"))
    at = lambda p, kind, none: F.coalesce(F.try_variant_get("v", p, kind), F.lit(none))
    inner = lambda p, kind, none: F.when(F.col("p_partkey") % 7 == 0, at(f"$.of[0]{p}", kind, none)).otherwise(at(f"$.of[1]{p}", kind, none))
    n = F.when(F.try_variant_get("v", "$.of[2]", "string").isNotNull(), 3).when(F.try_variant_get("v", "$.of[0]", "variant").isNotNull(), 1).otherwise(-1)
    return v.select("p_partkey", at("$.name", "string", "").alias("name"), inner(".size", "int", -1).alias("size"), inner("['brand x'][0]", "string", "").alias("brand"), at("$.number", "int", -1).alias("number"), at("$.flag", "boolean", False).alias("flag"), n.alias("n"), F.col("v").isNull().alias("broken"))


@query("parse_tempo", """select o_orderkey, (60 + o_orderkey % 120)::double as tempo, case when o_orderkey % 2 = 0 then round_even((2 + o_orderkey % 7) * 4 / 8.0, 5)::double else 4.0::double end as quarters from orders""")
def _tempo(spark, sf):
    t = F.expr("concat(60 + o_orderkey % 120, case when o_orderkey % 2 = 0 then concat('|', 2 + o_orderkey % 7, '/8') else '' end)")
    return bound(spark, sf, "orders").withColumn("t", L.parse_tempo(t)).select("o_orderkey", "t.tempo", "t.quarters")


_PAN = "case when c_custkey % 5 = 0 then 'C' else (c_custkey % 100) / 100.0 || case when c_custkey % 2 = 0 then 'L' else 'R' end end"


@query("pan_and_mix", """with p as (select c_custkey, c_custkey % 5 = 0 as centre, c_custkey % 2 = 0 as l, (c_custkey % 100)::double / 100 as x from customer)
select c_custkey, case when centre then 64 when l then 63 - trunc(x * 63)::int else 65 + trunc(x * 63)::int end as midi, case when centre then 0.0::double when l then -x else x end as real, (c_custkey % 7)::double as volume from p""")
def _pan(spark, sf):
    x = F.expr("case when c_custkey % 5 = 0 then 'C' else concat(cast((c_custkey % 100) / 100 as string), case when c_custkey % 2 = 0 then 'L' else 'R' end) end")
    m = L.parse_mix(F.concat((c("c_custkey") % 7).cast("string"), F.lit("/"), x))
    return bound(spark, sf, "customer").withColumn("x", x).withColumn("m", m).select("c_custkey", L.pan_to_midi(c("x")).alias("midi"), c("m.pan").alias("real"), "m.volume")


@query("split_instrument", """select p_partkey, case when p_partkey % 2 = 0 then p_partkey % 16384 else 0 end::int as bank, p_size as program, case when p_partkey % 2 = 0 then p_partkey % 16384 // 128 else 0 end::int as msb, case when p_partkey % 2 = 0 then p_partkey % 16384 % 128 else 0 end::int as lsb from part""")
def _instrument(spark, sf):
    t = F.expr("case when p_partkey % 2 = 0 then concat(p_partkey % 16384, ':', p_size) else cast(p_size as string) end")
    return bound(spark, sf, "part").withColumn("i", L.split_instrument(t)).select("p_partkey", "i.*")


@query("parse_dest", """select c_custkey, 'extract' as phase, (c_custkey % 9)::int as lines from customer union all select c_custkey, 'score', 1 from customer""")
def _dest(spark, sf):
    t = F.concat(F.lit("e"), (c("c_custkey") % 9).cast("string"), F.lit("/x4/s"))
    return bound(spark, sf, "customer").select("c_custkey", F.explode(L.parse_dest(t)).alias("d")).select("c_custkey", "d.phase", "d.lines")


@query("srt_time", """with m as (select l_orderkey, l_linenumber, (l_extendedprice * 100)::bigint as ms from (select l_orderkey, l_linenumber, trunc(l_extendedprice * 100) / 100 as l_extendedprice from lineitem))
select l_orderkey, l_linenumber, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) as srt, ms from (select l_orderkey, l_linenumber, trunc(l_extendedprice * 37)::bigint as ms from lineitem)""")
def _srt(spark, sf):
    ms = (c("l_extendedprice") * 37).cast("long")
    return bound(spark, sf, "lineitem").withColumn("srt", L.srt_format(ms)).select("l_orderkey", "l_linenumber", "srt", L.srt_parse(c("srt")).alias("ms"))


@query("sample_math", """with x as (select l_orderkey, l_linenumber, (l_partkey - l_suppkey * 20) as a, (l_quantity / 25 - 1)::double as pan, l_quantity - 25 as db from lineitem)
select l_orderkey, l_linenumber, sign(a)::int as sg, trunc(a / 7.0)::bigint as q, (a - trunc(a / 7.0)::bigint * 7)::bigint as r, round_even(pow(10.0, db / 20) * 1024, 0)::bigint as gain,
  case when pan < 0 then 1.0::double else 1 - pan end as ll, case when pan > 0 then 1.0::double else 1 + pan end as rr from x""")
def _math(spark, sf):
    df = bound(spark, sf, "lineitem").withColumns({"a": c("l_partkey") - c("l_suppkey") * 20, "pan": c("l_quantity") / 25 - 1})
    qr, b = L.signed_divmod(c("a"), F.lit(7)), L.balance(c("pan"))
    return df.select("l_orderkey", "l_linenumber", L.sign(c("a")).alias("sg"), qr.q.alias("q"), qr.r.alias("r"), L.fixed_point(L.db_to_gain(c("l_quantity") - 25)).alias("gain"), b.ll.alias("ll"), b.rr.alias("rr"))


@query("noise", """select o_orderkey, u, sign(2 * u - 1) * (2 * u - 1) * (2 * u - 1) as r from (select o_orderkey, ('0x' || substr(md5('s|' || o_orderkey), 1, 8))::bigint / 4294967296.0::double as u from orders)""")
def _noise(spark, sf):
    return bound(spark, sf, "orders").select("o_orderkey", L.noise(F.lit("s"), c("o_orderkey").cast("string")).alias("u")).withColumn("r", L.variation(c("u")))


@query("zip_lists", """select o_custkey, i::int as pos, voice, 'd' as clef, (o_custkey % 9)::varchar as level from (select o_custkey, o_orderpriority || o_orderkey as voice, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)""")
def _zip(spark, sf):
    """The orders of every customer as a list of voices, beside a list that is empty and one of a single item."""
    own = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat("o_orderpriority", c("o_orderkey").cast("string")).alias("v"))))
    v = bound(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(own, lambda x: x.v), ",").alias("v"))
    z = L.zip_lists(F.size(F.split("v", ",")), {"voice": c("v"), "clef": F.lit(""), "level": (c("o_custkey") % 9).cast("string")}, {"voice": "", "clef": "d", "level": "0"})
    return v.select("o_custkey", F.posexplode(z).alias("pos", "z")).select("o_custkey", "pos", "z.*")


@query("map_functions", """select p_partkey, p_brand as b, p_type as t, 1 as n1, 2 as n2 from part""")
def _maps(spark, sf):
    m = L.make_map(F.array(F.lit("part_b"), F.lit("part_t"), F.lit("size")), F.array("p_brand", "p_type"))
    df = bound(spark, sf, "part").withColumn("m", m)
    return df.select("p_partkey", F.element_at("m", "part_b").alias("b"), F.element_at("m", "part_t").alias("t"), F.size(L.map_by_keys(c("m"), ["part_b", "x"])).alias("n1"), F.size(L.map_by_prefix(c("m"), "part_")).alias("n2"))


@query("array_functions", """with a as (select l_orderkey, list(l_suppkey % 4 order by l_linenumber, l_suppkey % 4) as a from lineitem group by 1)
select l_orderkey, coalesce(list_min(list_filter(range(0, greatest(len(a) - 1, 0)), lambda i: a[i + 1] = 1 and a[i + 2] = 2)), -1)::int as found, array_to_string(a[2:len(a) - 1], ',') as cut, (9 || ',' || array_to_string(a, ',')) as longer,
  array_to_string(list_transform(range(0, 5), lambda i: (l_orderkey >> i) & 1), '') as bits from a""")
def _arrays(spark, sf):
    a = bound(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (c("l_suppkey") % 4).alias("s")))).alias("x")).withColumn("a", F.transform("x", lambda x: x.s))
    one = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return a.select(
        "l_orderkey", L.array_find(c("a"), one).cast("int").alias("found"), text(L.array_slice(c("a"), 1, -1)).alias("cut"), text(L.array_prepend_all(c("a"), F.array(F.lit(9).cast("long")))).alias("longer"),
        F.array_join(F.transform(L.bits_le(c("l_orderkey"), 5), lambda b: b.cast("string")), "").alias("bits"),
    )


@query("iif", """select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 1000 then 'low' else 'high' end as level from customer""")
def _iif(spark, sf):
    return bound(spark, sf, "customer").select("c_custkey", L.iif(c("c_acctbal") < 0, F.lit("debt"), c("c_acctbal") < 1000, F.lit("low"), F.lit("high")).alias("level"))

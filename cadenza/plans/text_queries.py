"""Queries over text tables, settings, effect chains, rules and traces."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import chains as C
from cadenza.operators import quality as Q
from cadenza.operators import settings as S
from cadenza.operators import spans as P
from cadenza.operators import text as X

from .bindings import bound, duck, tasks_for
from .registry import query

# text


@query("logical_lines", duck("lines") + r""", k as (select *, trim(line, ' ') = '' as blank, contains(line, ',') as st from lines where not regexp_matches(line, '^\s*--')),
i as (select *, sum((st or blank)::int) over (partition by doc_id order by linenum) as island from k)
select doc_id, min(linenum) as linenum, string_agg(trim(regexp_replace(line, '\\\s*$', ''), ' '), ' ' order by linenum) as text from i where not blank group by doc_id, island having bool_or(st)""")
def _logical(spark, sf):
    return X.logical_lines(bound(spark, sf, "lines"), ",")


@query("section_fill", duck("lines") + r""", m as (select *, case when length(line) < 40 then line end as m from lines)
select doc_id, linenum, last_value(m ignore nulls) over w as section, lag(m) over (partition by doc_id order by linenum) is not null as is_heading from m
window w as (partition by doc_id order by linenum rows between unbounded preceding and current row)""")
def _section(spark, sf):
    return X.section_fill(bound(spark, sf, "lines"), r"(?s)^.{0,39}$").select("doc_id", "linenum", "section", "is_heading")


CLEAN = r"""regexp_replace(f[%d], '^ *"(.*)" *$', '\1', 's')"""
_TSV_SPARK = "case when linenum % 9 = 1 then concat('TABLE t', linenum) when linenum % 9 = 2 then 'a\tb\tc' when linenum % 9 = 5 then concat('x\ty\t\"', replace(line, '\"', '')) when linenum % 9 = 6 then 'rest\"' when linenum % 9 = 7 then '# no' when linenum % 9 = 8 then 'only\ttwo' else concat(replace(replace(line, '\"', ''), '#', ''), '\tq\tr') end"


@query("multi_tables", duck("lines") + r""", t as (select doc_id, linenum, case when linenum % 9 = 1 then 'TABLE t' || linenum when linenum % 9 = 2 then 'a' || tab || 'b' || tab || 'c' when linenum % 9 = 5 then 'x' || tab || 'y' || tab || '"' || replace(line, '"', '')
  when linenum % 9 = 6 then 'rest"' when linenum % 9 = 7 then '# no' when linenum % 9 = 8 then 'only' || tab || 'two' else replace(replace(line, '"', ''), '#', '') || tab || 'q' || tab || 'r' end as line from lines, (select chr(9) as tab)),
k as (select *, case when regexp_matches(line, '\t" *[^\t "][^\t"]*$') then true when regexp_matches(line, '[\t"]') then false end as st from t where not regexp_matches(line, '^\s*#') and trim(line, ' ') <> ''),
o as (select *, coalesce(last_value(st ignore nulls) over (partition by doc_id order by linenum rows between unbounded preceding and current row), false) as op from k),
g as (select *, sum(case when coalesce(po, false) then 0 else 1 end) over (partition by doc_id order by linenum) as g from (select *, lag(op) over (partition by doc_id order by linenum) as po from o)),
w as (select doc_id, min(linenum) as linenum, string_agg(line, chr(10) order by linenum) as line from g group by doc_id, g),
n as (select *, case when line like 'TABLE %' then regexp_extract(line, '^TABLE (\w+)', 1) end as nm from w),
h as (select *, last_value(nm ignore nulls) over (partition by doc_id order by linenum rows between unbounded preceding and current row) as tb, lag(nm) over (partition by doc_id order by linenum) is not null and nm is null as head from n),
v as (select *, string_split(line, chr(9)) as f from h where nm is null and not head and tb is not null)
select doc_id, tb as "table", linenum, c1 as a, coalesce(c2, '') as b, coalesce(c3, '') as c, len(f) <> 3 as bad from (select *, clean(f[1]) as c1, clean(f[2]) as c2, clean(f[3]) as c3 from v)""".replace("clean(f[1])", CLEAN % 1).replace("clean(f[2])", CLEAN % 2).replace("clean(f[3])", CLEAN % 3))
def _tables(spark, sf):
    """Tables spelled from the lines; tests/test_forms.py holds the form against a line-by-line reader."""
    t = bound(spark, sf, "lines").select("doc_id", "linenum", F.expr(_TSV_SPARK).alias("line"))
    f = F.col("fields")
    return X.multi_tables(t).select("doc_id", "table", "linenum", *(F.coalesce(F.try_element_at(f, F.lit(k)), F.lit("")).alias(k) for k in "abc"), "bad")


@query("scan_sections", duck("lines") + """, n as (select doc_id, linenum as page, length(line) as number from lines where length(line) > 0),
g as (select *, max(number) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding) as top from n),
a as (select * from g where top is null or number > top)
select doc_id, page::int as page, case when page = 1 then 1 else number end::bigint as first_measure from a union all select doc_id, max(page)::int + 1, max(case when page = 1 then 1 else number end)::bigint + 8 from a group by 1
""")
def _scan(spark, sf):
    """Every line of a document becomes a page whose number is the line's length, spelled as a marker scan has it."""
    d = bound(spark, sf, "lines").filter("length(line) > 0")
    digits = F.transform(F.filter(F.split(F.reverse(F.length("line").cast("string")), ""), lambda x: x != ""), lambda x: F.concat(F.lit("("), x, F.lit(") digit")))
    rows = F.concat(F.array(F.concat(F.lit("%%Page: "), F.col("linenum").cast("string")), F.lit("0.5 setcolor"), F.lit("font selectfont")), digits, F.array(F.lit("print_glyphs")))
    lines = d.select("doc_id", F.posexplode(rows).alias("i", "l"), "linenum").select("doc_id", (F.col("linenum") * 100 + F.col("i")).alias("linenum"), F.col("l").alias("line"))
    tasks = tasks_for(bound(spark, sf, "documents"), 2000)
    return X.scan_sections(lines, r"^%%Page: (\d+)", "setcolor", "selectfont", r"^\((\d)\)", "print_glyphs", tasks=tasks)


@query("defined_names", duck("lines") + r""", e as (select doc_id, case when linenum % 3 = 0 then ' ' || split_part(line, ' ', 1) || ' = ' || linenum else line end as line from lines)
select distinct doc_id, regexp_extract(line, '^ *([A-Za-z]+) *=', 1) as name from e where regexp_extract(line, '^ *([A-Za-z]+) *=', 1) <> ''""")
def _defined(spark, sf):
    line = F.expr("case when linenum % 3 = 0 then concat(' ', substring_index(line, ' ', 1), ' = ', linenum) else line end")
    return X.defined_names(bound(spark, sf, "lines").withColumn("line", line))


# settings

_MANY = duck("settings") + ", s as (select song::bigint as song, key, line::bigint as line, value_text from settings union all select 100 + c_nationkey, 'key' || c_custkey % 4, c_custkey, c_mktsegment from customer) "


def many(spark, sf):
    b = bound(spark, sf, "customer").selectExpr("cast(100 + c_nationkey as bigint) song", "concat('key', c_custkey % 4) key", "c_custkey line", "c_mktsegment value_text")
    return bound(spark, sf, "settings").selectExpr("cast(song as bigint) song", "key", "cast(line as bigint) line", "value_text").unionByName(b)


@query("last_assignment", _MANY + "select song, key, arg_max(value_text, line) as value_text, max(line) as line from s group by 1, 2")
def _last(spark, sf):
    return S.last_assignment(many(spark, sf))


@query("overlay_defaults", _MANY + ", l as (select song, key, arg_max(value_text, line) as value_text from s where key <> 'key1' or song % 2 = 0 group by 1, 2), d as (select 'key' || r_regionkey as key, r_name as value_text from region) select * from l union all select x.song, d.key, d.value_text from (select distinct song from l) x, d where not exists (select 1 from l where l.song = x.song and l.key = d.key)")
def _defaults(spark, sf):
    own = S.last_assignment(many(spark, sf).filter("key != 'key1' or song % 2 = 0"))
    return S.overlay_defaults(own, bound(spark, sf, "region").select(F.concat(F.lit("key"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("value_text")))


@query("lookup2", "select c_custkey, c_mktsegment, coalesce(t.name, 'none') as name from customer left join (select n_nationkey as c_nationkey, 'BUILDING' as c_mktsegment, n_name as name from nation) t using (c_nationkey, c_mktsegment)")
def _lookup2(spark, sf):
    t = bound(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"), F.col("n_name").alias("name"))
    return S.lookup2(bound(spark, sf, "customer"), t, ["c_nationkey", "c_mktsegment"], "name", "none").select("c_custkey", "c_mktsegment", "name")


@query("first_available", """with e as (select p_partkey as key, unnest([p_type || p_size, p_brand, p_name]) as name, unnest([0, 1, 2]) as rank from part), a as (select p_brand as name from part where p_size > 49 union select p_name from part where p_size < 4),
b as (select key, arg_min(name, rank) as name from e where name in (select name from a) group by 1) select p.p_partkey as key, b.name from part p left join b on p.p_partkey = b.key""")
def _first(spark, sf):
    p = bound(spark, sf, "part")
    w = p.select(F.col("p_partkey").alias("key"), F.array(F.concat("p_type", F.col("p_size").cast("string")), "p_brand", "p_name").alias("alternatives"))
    a = p.filter("p_size > 49").select(F.col("p_brand").alias("name")).union(p.filter("p_size < 4").select("p_name"))
    return S.first_available(w, a)


@query("split_members", "select c_custkey, case when c_nationkey in (select s_nationkey from supplier where s_acctbal > 9000) then 'in' else 'out' end as side from customer")
def _members(spark, sf):
    m = bound(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    a, b = S.split_members(bound(spark, sf, "customer"), m, "c_nationkey")
    return a.select("c_custkey", F.lit("in").alias("side")).unionByName(b.select("c_custkey", F.lit("out").alias("side")))


@query("restrict", "select c_custkey, 'some' as mode from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) and c_nationkey in (select n_nationkey from nation where n_regionkey < 3) union all select c_custkey, 'all' from customer where c_nationkey in (select n_nationkey from nation where n_regionkey < 3)")
def _restrict(spark, sf):
    cust, sup = bound(spark, sf, "customer"), bound(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    allowed = bound(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    a = S.restrict(cust, sup.filter("s_acctbal > 5000"), allowed, "c_nationkey").select("c_custkey", F.lit("some").alias("mode"))
    return a.unionByName(S.restrict(cust, sup.filter("s_acctbal > 1e9"), allowed, "c_nationkey").select("c_custkey", F.lit("all").alias("mode")))


@query("lookup_or_reject", "select o_orderkey, c_name as name, 'ok' as reason from orders join customer on o_custkey = c_custkey where c_acctbal > 0 union all select o_orderkey, '', 'unknown' from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def _reject(spark, sf):
    c = bound(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    ok, bad = S.lookup_or_reject(bound(spark, sf, "orders"), c, "o_custkey")
    return ok.select("o_orderkey", F.col("c_name").alias("name"), F.lit("ok").alias("reason")).unionByName(bad.select("o_orderkey", F.lit("").alias("name"), "reason"))


@query("resolve_style", """with v as (select c_custkey, lower(c_mktsegment) || case c_custkey % 3 when 0 then 'Simple' when 1 then 'Extended' else '' end as voice, case c_custkey % 4 when 0 then 'copy' when 1 then 'LIVE' else 'hard' end as variant, (c_custkey % 30)::double / 20 - 0.2 as reverb from customer),
e as (select 'soundStyle' || upper(substr(s, 1, 1)) || lower(substr(s, 2)) || 'Hard' as style, 'gain ' || length(s) as effects from (select distinct c_mktsegment as s from customer)),
j as (select *, case when variant = 'copy' then 'COPY' else 'soundStyle' || upper(substr(b, 1, 1)) || lower(substr(b, 2)) || upper(substr(variant, 1, 1)) || lower(substr(variant, 2)) end as style, greatest(least(trunc(reverb * 100)::int, 100), 0) as level from (select *, regexp_replace(voice, '(?:Simple|Extended)$', '') as b from v))
select distinct voice, variant, j.style, coalesce(e.effects, '') || case when level > 0 then ' reverb ' || level else '' end as effects, e.effects is null as copied from j left join e on j.style = e.style""")
def _style(spark, sf):
    c = bound(spark, sf, "customer")
    v = c.selectExpr("concat(lower(c_mktsegment), case c_custkey % 3 when 0 then 'Simple' when 1 then 'Extended' else '' end) voice", "case c_custkey % 4 when 0 then 'copy' when 1 then 'LIVE' else 'hard' end variant", "cast(c_custkey % 30 as double) / 20 - 0.2D reverb")
    e = c.select("c_mktsegment").distinct().selectExpr("concat('soundStyle', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), 'Hard') style", "concat('gain ', length(c_mktsegment)) effects")
    return S.resolve_style(v, e).distinct()


@query("substitute", """select o_orderkey as id, 'run ' || case o_orderstatus when 'P' then 'pending order' when 'F' then 'done' else '${' || o_orderstatus || '}' end || ' ${unknown} x${P}' as command from orders""")
def _substitute(spark, sf):
    o = bound(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.array(F.lit("run"), F.concat(F.lit("${"), "o_orderstatus", F.lit("}")), F.lit("${unknown}"), F.lit("x${P}")).alias("tokens"))
    v = o.select("o_orderstatus").distinct().filter("o_orderstatus in ('P', 'F')").select(F.col("o_orderstatus").alias("name"), F.expr("case o_orderstatus when 'P' then array('pending', 'order') else array('done') end").alias("value"))
    return S.substitute(t, v).select("id", F.array_join("tokens", " ").alias("command"))


@query("to_tags", """select p_partkey as item, 'nam' as tag, p_name as value from part union all select p_partkey, 'alb', p_brand from part union all select p_partkey, 'trkn', p_size || '/999' from part where p_size % 5 <> 0 union all select p_partkey, 'stik', case p_type when 'ECONOMY' then '1' else p_type end from part""")
def _tags(spark, sf):
    p = bound(spark, sf, "part").withColumn("p_size", F.expr("case when p_size % 5 <> 0 then p_size end"))
    return S.to_tags(p, "p_partkey", {"p_name": "nam", "p_brand": "alb", "p_size": "trkn", "p_type": "stik"}, {"p_type": {"ECONOMY": "1"}}, ["p_size"])


# effect chains

_EFFECT = "concat('tr', c_custkey % 3, '-> equalizer ', c_custkey, ' 1q tee reverb 40 ', case when c_custkey % 2 = 0 then '->tr1' else '' end, ';', case when c_custkey % 5 = 0 then 'tr1-> mix 0 ->x' else 'gain 2' end)"


def effects(spark, sf):
    return bound(spark, sf, "customer").select(F.col("c_custkey").alias("voice"), F.expr(_EFFECT).alias("effects"))


@query("split_chain", """select c_custkey as voice, 0 as chain, 0 as fragment, 'equalizer ' || c_custkey || ' 1q' as tokens, 'tr' || c_custkey % 3 as sources, '' as targets from customer
union all select c_custkey, 0, 1, 'reverb 40', '', case when c_custkey % 2 = 0 then 'tr1' else '' end from customer
union all select c_custkey, 1, 0, case when c_custkey % 5 = 0 then 'mix 0' else 'gain 2' end, case when c_custkey % 5 = 0 then 'tr1' else '' end, case when c_custkey % 5 = 0 then 'x' else '' end from customer""")
def _chain(spark, sf):
    j = lambda c: F.array_join(c, " ").alias(c)
    return C.split_chain(effects(spark, sf)).select("voice", "chain", "fragment", j("tokens"), j("sources"), j("targets"))


@query("check_chains", """select c_custkey as voice, 0 as chain, 0 as fragment, 'unknown source' as problem from customer
union all select c_custkey, 1, 0, 'target in last chain' from customer where c_custkey % 5 = 0 union all select c_custkey, 1, 0, 'unknown source' from customer where c_custkey % 5 = 0 and c_custkey % 2 <> 0""")
def _checks(spark, sf):
    return C.check_chains(C.split_chain(effects(spark, sf)))


@query("chain_position", """select o_orderkey, case when count(*) over (partition by o_custkey) = 1 then 'SINGLE' when row_number() over w = 1 then 'FIRST' when row_number() over w = count(*) over (partition by o_custkey) then 'LAST' else 'OTHER' end as position from orders window w as (partition by o_custkey order by o_orderkey)""")
def _position(spark, sf):
    return C.chain_position(bound(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "position")


@query("chain_plan", """with c as (select distinct c_mktsegment as s from customer)
select s as voice, 0 as chain, 0 as fragment, 'eq ' || length(s) as tokens, 'FIRST' as position, 0 as level, '' as problems from c union all select s, 0, 1, 'gain', 'LAST', 1, '' from c
union all select s, 1, 0, 'mix reverb 25', 'SINGLE', 2, '' from c""")
def _plan(spark, sf):
    v = bound(spark, sf, "customer").select(F.col("c_mktsegment").alias("voice"), F.lit("hard").alias("variant"), F.lit(0.25).alias("reverb")).distinct()
    e = v.select(F.concat(F.lit("soundStyle"), F.upper(F.substring("voice", 1, 1)), F.lower(F.substring("voice", 2, 99)), F.lit("Hard")).alias("style"), F.concat(F.lit("eq "), F.length("voice").cast("string"), F.lit(" tee gain ->m;m-> mix")).alias("effects"))
    j = lambda c: F.array_join(c, " ").alias(c)
    return C.chain_plan(v, e).select("voice", "chain", "fragment", j("tokens"), "position", "level", j("problems"))


# quality

_RULES = [
    Q.Rule("c_acctbal", "number_text", "not above zero", ">0"), Q.Rule("c_name", "regex", "ends in 7", r"[^7]$"), Q.Rule("c_mktsegment", "member", "unknown segment", ("BUILDING", "MACHINERY")),
    Q.Rule("c_nationkey", "natural", "not positive", "positive"), Q.Rule("c_custkey", "integer", "no integer"), Q.Rule("c_acctbal", "integer_text", "no integer text"),
]


@query("validate", """select c_custkey as key, 'c_acctbal' as "column", 'not above zero' as message from customer where c_acctbal <= 0 union all select c_custkey, 'c_name', 'ends in 7' from customer where c_name like '%7'
union all select c_custkey, 'c_mktsegment', 'unknown segment' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') union all select c_custkey, 'c_nationkey', 'not positive' from customer where c_nationkey < 1 union all select c_custkey, 'c_acctbal', 'no integer text' from customer""")
def _validate(spark, sf):
    return Q.validate(bound(spark, sf, "customer"), _RULES, "c_custkey").select("key", "column", "message")


_BY = [("c_name", "regex", "not ", None), ("c_acctbal", "number_text", ">0 ", ">0"), ("c_mktsegment", "member", "in ", None), ("c_nationkey", "natural", "zero ", "positive"), ("c_custkey", "present", "there ", None)]


@query("validate_by_table", """with r as (select n_nationkey % 5 as k, n_nationkey % 10 as d, n_name, substr(n_name, 1, 1) as first from nation)
select c_custkey as key, 'c_name' as "column", 'not ' || n_name as message from customer, r where k = 0 and c_name like '%' || d union all select c_custkey, 'c_acctbal', '>0 ' || n_name from customer, r where k = 1 and c_acctbal <= 0
union all select c_custkey, 'c_mktsegment', 'in ' || n_name from customer, r where k = 2 and c_mktsegment not in ('BUILDING', n_name, case when d % 2 = 0 then 'MACHINERY' else '' end)
union all select c_custkey, 'c_nationkey', 'zero ' || n_name from customer, r where k = 3 and c_nationkey < 1""")
def _validate_table(spark, sf):
    """Customers against a rule of every nation."""
    n, k = bound(spark, sf, "nation"), F.col("n_nationkey") % 5
    pick = lambda i: F.element_at(F.array(*(F.lit(b[i]) for b in _BY)), (k + 1).cast("int"))
    arg = F.when(k == 0, F.concat(F.lit("[^"), (F.col("n_nationkey") % 10).cast("string"), F.lit("]$"))).otherwise(pick(3))
    members = F.when(k == 2, F.array(F.lit("BUILDING"), F.col("n_name"), F.when(F.col("n_nationkey") % 10 % 2 == 0, "MACHINERY").otherwise("")))
    rules = n.select(pick(0).alias("column"), pick(1).alias("kind"), F.concat(pick(2), F.col("n_name")).alias("message"), arg.alias("arg"), members.alias("members"))
    return Q.validate_by(bound(spark, sf, "customer"), rules, "c_custkey").select("key", "column", "message")


@query("complete", """select o_orderkey as key, 's' as "column", 'absent' as message from orders where o_orderstatus = 'P' union all select o_orderkey, 'p', 'no integer' from orders""")
def _complete(spark, sf):
    o = bound(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderstatus <> 'P' then o_orderstatus end as s", "o_orderpriority as p", "o_custkey as k")
    return Q.complete(o, {"s": "text", "p": "integer", "k": "integer"}, "o_orderkey").select("key", "column", "message")


@query("same_length", """select n_nationkey as key, 'b' as "column", (1 + n_nationkey % 4)::int as size from nation where n_nationkey % 4 not in (0, 2) union all select c_custkey + 1000, 'b', (1 + c_custkey % 4)::int from customer where c_custkey % 4 not in (0, 2)""")
def _same(spark, sf):
    n = bound(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) k").union(bound(spark, sf, "customer").selectExpr("c_custkey + 1000"))
    rep = F.when(F.col("k") >= 1000, F.col("k") - 1000).otherwise(F.col("k")) % 4
    df = n.select("k", F.lit("x,y,z").alias("n"), F.array_join(F.array_repeat(F.lit("v"), (rep + 1).cast("int")), ",").alias("b"), F.lit("one").alias("a"))
    return Q.same_length(df, ["a", "b"], "n", "k")


@query("to_typed", _MANY + """, l as (select song, arg_max(value_text, line) filter (where key = 'key0') as a, arg_max(value_text, line) filter (where key = 'key1') as b from s group by 1)
select song, coalesce(a, '') as a, coalesce(try_cast(b as double), -1) as b, b is not null and try_cast(b as double) is null as bad from l""")
def _typed(spark, sf):
    rec, bad = Q.to_typed(many(spark, sf), {"a": ("key0", "string"), "b": ("key1", "double")})
    return rec.join(bad.select("song", F.lit(True).alias("bad")), "song", "left").select("song", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit(-1.0)).alias("b"), F.coalesce("bad", F.lit(False)).alias("bad"))


# traces


@query("span_log", """select conv_id, turn, case role when 'user' then '>>' else '<<' end as mark, 'talk.' || role as func, ((conv_id % 24 * 60 + turn) * 60 + turn)::bigint * 1000 + 120 as ms, 't' || conv_id % 7 as thread, case role when 'user' then 1 else -1 end as depth_delta from conversations where role <> 'system'""")
def _log(spark, sf):
    line = F.format_string("%s%s (%02d%02d%02d.12) [t%s] text", F.expr("case role when 'user' then '>>' when 'system' then '##' else '<<' end"), F.concat(F.lit("talk."), "role"), F.col("conv_id") % 24, F.col("turn"), F.col("turn"), (F.col("conv_id") % 7).cast("string"))
    return P.span_log(bound(spark, sf, "conversations").withColumn("line", line)).select("conv_id", "turn", "mark", "func", "ms", "thread", "depth_delta")


def turn_log(spark, sf):
    c = bound(spark, sf, "conversations")
    ts = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), ts.alias("ts"), (F.col("role") != "assistant").alias("begin"))


@query("pair_spans", """with c as (select conv_id as thread, turn as seq, role <> 'assistant' as b, sum(length(text)) over (partition by conv_id order by turn)::bigint as ts from conversations),
r as (select *, sum(case when b then 1 else -1 end) over (partition by thread order by seq) as s from c), l as (select *, least(min(s) over (partition by thread order by seq rows between unbounded preceding and current row), 0) as low from r),
k as (select *, not b and low < coalesce(lag(low) over (partition by thread order by seq), 0) as lost from l), d as (select *, s - low + case when b then 0 else 1 end as depth from k where not lost),
p as (select *, lead(seq) over w as end_seq, lead(ts) over w as end_, coalesce(lead(b) over (partition by thread order by seq), false) as has_children, max(ts) over (partition by thread) as last_ from d window w as (partition by thread, depth order by seq))
select thread, seq, coalesce(end_seq, -1) as end_seq, depth::int as depth, coalesce(end_, last_) - ts as elapsed, has_children from p where b""")
def _spans(spark, sf):
    """Turns of a conversation begin and end spans; tests/test_forms.py holds the form against a stack."""
    got = P.pair_spans(turn_log(spark, sf))
    return got.withColumn("end_seq", F.coalesce("end_seq", F.lit(-1)))

"""Views over the tables that give them the shape an operator expects, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ticks per quarter of the bound songs.
TPQ = 96
# Songs are ranges of keys, so their number grows with the tables and their size does not.

_SPARK = {
    "notes": """
        select cast(user_id div 10 as bigint) as song, event_type as track, event_id as seq, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 60000000 as midi_time,
          case when event_id % 2 = 0 then 'On' else 'Off' end as kind, 36 + (event_id div 2) % 4 as pitch, 1 + cast(floor(value) as bigint) % 127 as velocity
        from {events}""",
    "samples": """
        select cast(l_orderkey div 6000 as bigint) as song, concat(l_returnflag, l_linestatus) as voice, cast(l_linenumber % 2 as int) as channel, cast(l_orderkey % 6000 as bigint) as frame,
          sum(cast(l_extendedprice as bigint) % 20001 - 10000) as sample
        from {lineitem} group by 1, 2, 3, 4""",
    "lines": r"select doc_id, p + 1 as linenum, line from {documents} lateral view posexplode(split(text, '\n')) x as p, line",
    "changes": """
        select cast(o_custkey div 100 as bigint) as song, 1 + o_orderkey % 100 as from_measure, cast(max(60 + floor(o_totalprice) % 120) as double) as tempo
        from {orders} group by 1, 2""",
    # events of a song with the columns of the event table
    "midi": """
        select cast(user_id div 10 as bigint) as song, cast(user_id % 5 as int) as track_no,
          concat(case user_id % 5 when 0 then 'control' when 1 then 'vocalsTop' when 2 then 'drums' when 3 then 'guitarA' else 'new:1' end) as track, event_id as seq,
          timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 60000000 as midi_time,
          case event_type when 'click' then 'Par' when 'view' then 'On' when 'purchase' then 'Off' when 'signup' then 'PrCh' else 'Meta' end as kind,
          cast(null as string) as meta, cast(1 + user_id % 16 as int) as channel, cast(case event_id % 4 when 0 then 7 when 1 then 10 when 2 then 91 else 64 end as int) as p1, cast(floor(value) % 128 as int) as p2
        from {events}""",
    "settings": """
        select n_regionkey as song, concat('key', n_nationkey % 3) as key, n_nationkey as line,
          case n_nationkey % 6 when 0 then 'TRUE' when 1 then concat('', n_nationkey) when 2 then concat(n_nationkey, '.5') when 3 then concat('0x', hex(n_nationkey)) when 4 then 'falsch' else n_name end as value_text
        from {nation}""",
}
_DUCK = {
    "notes": """
        select cast(user_id // 10 as bigint) as song, event_type as track, event_id as seq, cast(floor((epoch_us(ts) - 1704067200000000) / 60000000.0) as bigint) as midi_time,
          case when event_id % 2 = 0 then 'On' else 'Off' end as kind, 36 + (event_id // 2) % 4 as pitch, 1 + cast(floor(value) as bigint) % 127 as velocity
        from events""",
    "samples": """
        select cast(l_orderkey // 6000 as bigint) as song, concat(l_returnflag, l_linestatus) as voice, cast(l_linenumber % 2 as int) as channel, cast(l_orderkey % 6000 as bigint) as frame,
          cast(sum(cast(trunc(l_extendedprice) as bigint) % 20001 - 10000) as bigint) as sample
        from lineitem group by 1, 2, 3, 4""",
    "lines": "select doc_id, cast(linenum as int) as linenum, s[linenum] as line from (select doc_id, string_split(text, chr(10)) as s, unnest(range(1, len(string_split(text, chr(10))) + 1)) as linenum from documents)",
    "changes": """
        select cast(o_custkey // 100 as bigint) as song, 1 + o_orderkey % 100 as from_measure, cast(max(60 + floor(o_totalprice)::bigint % 120) as double) as tempo
        from orders group by 1, 2""",
    "midi": """
        select cast(user_id // 10 as bigint) as song, cast(user_id % 5 as int) as track_no,
          case user_id % 5 when 0 then 'control' when 1 then 'vocalsTop' when 2 then 'drums' when 3 then 'guitarA' else 'new:1' end as track, event_id as seq,
          cast(floor((epoch_us(ts) - 1704067200000000) / 60000000.0) as bigint) as midi_time,
          case event_type when 'click' then 'Par' when 'view' then 'On' when 'purchase' then 'Off' when 'signup' then 'PrCh' else 'Meta' end as kind,
          null::varchar as meta, cast(1 + user_id % 16 as int) as channel, cast(case event_id % 4 when 0 then 7 when 1 then 10 when 2 then 91 else 64 end as int) as p1, cast(floor(value)::bigint % 128 as int) as p2
        from events""",
    "settings": """
        select n_regionkey as song, concat('key', n_nationkey % 3) as key, n_nationkey as line,
          case n_nationkey % 6 when 0 then 'TRUE' when 1 then n_nationkey::varchar when 2 then n_nationkey || '.5' when 3 then '0x' || printf('%X', n_nationkey) when 4 then 'falsch' else n_name end as value_text
        from nation""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding by name, or a driver table."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name not in _SPARK:
        return read(name)
    text = _SPARK[name]
    tables = [t for t in ("events", "lineitem", "documents", "orders", "nation") if "{" + t + "}" in text]
    return spark.sql(text, **{t: read(t) for t in tables})


def tasks_for(table: DataFrame, rows: int) -> int:
    """How many tasks take about ``rows`` rows of a driver's table each; its rows are counted by the files' footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def duck(*names: str) -> str:
    """The bindings as common table expressions, for the start of an oracle."""
    return "with " + ", ".join(f"{n} as ({_DUCK[n]})" for n in names)

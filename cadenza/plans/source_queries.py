"""Queries over encoded files: what the tables give is written in a format and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as L
from cadenza.operators import grid as G
from cadenza.sources import data_sources, midi, settings_files, text_files, wav
from cadenza.sources.shared import cut, new_folder, remove

from .bindings import bound, duck
from .mix_queries import _DENSE, chunks
from .registry import oracle_sql, query


@query("midi_files", duck("midi") + """, n as (select *, row_number() over w - 1 as n from midi window w as (partition by song, track_no order by midi_time, seq))
select song, track_no, n as seq, midi_time, kind, case when kind = 'Meta' then 'Text' else '' end as meta, coalesce(case when kind <> 'Meta' then channel end, -1) as channel, coalesce(case when kind <> 'Meta' then p1 end, -1) as p1,
  coalesce(case when kind not in ('Meta', 'PrCh') then p2 end, -1) as p2, coalesce(case when kind = 'Meta' then 'é ' || seq end, '') as text from n
union all select song, track_no, count(*), max(midi_time), 'Meta', 'TrkEnd', -1, -1, -1, '' from midi group by song, track_no""")
def _midi(spark, sf):
    """Events as files of their songs, decoded again."""
    events, _ = midi.decode_midi(midi.midi_files(_events(spark, sf)))
    return _shown(events)


def _events(spark, sf):
    e = bound(spark, sf, "midi")
    n = F.row_number().over(W.partitionBy("song", "track_no").orderBy("midi_time", "seq")) - 1
    own = e.select(
        F.col("song").cast("string").alias("song"), "track_no", F.lit(None).cast("string").alias("track"), n.cast("long").alias("seq"), "midi_time", "kind", F.when(F.col("kind") == "Meta", "Text").alias("meta"),
        "channel", "p1", "p2", F.when(F.col("kind") == "Meta", F.concat(F.lit("é "), F.col("seq").cast("string"))).alias("text"), F.lit(None).cast("binary").alias("data"), F.lit(96).alias("tpq"),
    )
    ends = own.groupBy("song", "track_no").agg(F.count(F.lit(1)).alias("seq"), F.max("midi_time").alias("midi_time")).withColumns(
        {"kind": F.lit("Meta"), "meta": F.lit("TrkEnd"), "tpq": F.lit(96)} | {c: F.lit(None).cast(own.schema[c].dataType) for c in ("track", "channel", "p1", "p2", "text", "data")}
    )
    return own.unionByName(ends)


def _shown(events):
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return events.select(F.col("song").cast("long").alias("song"), "track_no", "seq", "midi_time", "kind", F.coalesce("meta", F.lit("")).alias("meta"), none("channel"), none("p1"), none("p2"), F.coalesce("text", F.lit("")).alias("text"))


@query("midi_source", oracle_sql()["midi_files"])
def _midi_source(spark, sf):
    """Events written as files to the shared folder by the data source, and read from there."""
    data_sources.register(spark)
    folder = new_folder(spark, "midi")
    midi.write_midi(_events(spark, sf), folder)
    events = spark.read.format("midi").option("mode", "failfast").load(folder).withColumn("song", F.regexp_replace("song", r"\.mid$", ""))
    out = cut(_shown(events))
    remove(spark, folder)
    return out


@query("wav_files", _DENSE + """select song, voice, max(frame) + 1 as frames, sum(s)::bigint as total, sum(s * (frame * 2 + channel))::bigint as moment from (select *, greatest(least(sample, 32767), -32767) as s from dense) group by 1, 2""")
def _wav(spark, sf):
    """Voices as WAV files, decoded into chunks of another size."""
    pcm, _ = wav.decode_wav(wav.wav_files(chunks(spark, sf), 8000), 1000)
    return _moments(pcm)


def _moments(pcm):
    add = lambda f: F.aggregate(F.transform("samples", f), F.lit(0).cast("long"), lambda a, x: a + x)
    one = pcm.select("song", "voice", (F.col("frame0") + F.size("samples") / 2).alias("end"), add(lambda s: s.cast("long")).alias("t"), add(lambda s, i: s.cast("long") * (i + F.col("frame0") * 2)).alias("m"))
    return one.groupBy(F.col("song").cast("long").alias("song"), "voice").agg(F.max("end").cast("long").alias("frames"), F.sum("t").alias("total"), F.sum("m").alias("moment"))


@query("wav_source", oracle_sql()["wav_files"])
def _wav_source(spark, sf):
    """Voices written to the shared folder, a file by many tasks, and read from there by ranges of bytes."""
    data_sources.register(spark)
    folder = new_folder(spark, "wav")
    wav.write_wav(chunks(spark, sf), folder, 8000)
    out = cut(_moments(spark.read.format("wav").option("mode", "failfast").option("frames", 1000).option("taskBytes", 1 << 16).load(folder)))
    remove(spark, folder)
    return out


@query("settings_files", """with b as (select 'n' || n_nationkey as key, n_name as value_text, row_number() over (order by n_nationkey) as i from nation), s as (select distinct c_nationkey as song from customer)
select song, key, 1 + i as line, value_text from s, b
union all select c_nationkey, 'key' || c_custkey % 5, (select count(*) from b) + 2 + row_number() over (partition by c_nationkey order by c_custkey), c_name || n_name || '!' from customer join nation on n_nationkey = c_custkey % 25""")
def _settings(spark, sf):
    """A settings file of every nation's customers, which includes one of all nations from the folder above."""
    text = lambda df, key, line, order: df.groupBy(key.alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x.l), "\n").alias("value"))
    n = text(bound(spark, sf, "nation"), F.lit("base.txt"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(' = "'), "n_name", F.lit('"')), F.col("n_nationkey"))
    line = F.concat(F.lit("key"), (F.col("c_custkey") % 5).cast("string"), F.lit(' = "'), "c_name", F.lit('" n'), (F.col("c_custkey") % 25).cast("string"), F.lit(' \\\n  "!"'))
    c = text(bound(spark, sf, "customer"), F.concat(F.lit("seg/"), F.col("c_nationkey").cast("string"), F.lit(".txt")), line, F.col("c_custkey"))
    c = c.withColumn("value", F.concat(F.lit('INCLUDE "../base.txt"\n-- customers\n'), F.col("value")))
    got = settings_files.settings_of(settings_files.lines_of(n.unionByName(c)), c.select("file"))
    # a logical line of two has the number of its first
    song = F.regexp_extract("song", r"(\d+)\.txt", 1).cast("int")
    first = F.row_number().over(W.partitionBy("song").orderBy("line"))
    base = F.count(F.when(F.col("key").startswith("n"), 1)).over(W.partitionBy("song"))
    return got.withColumns({"_r": first, "b": base}).select(song.alias("song"), "key", F.when(F.col("_r") <= F.col("b"), F.col("_r") + 1).otherwise(F.col("_r") + 2).cast("long").alias("line"), "value_text")


@query("relaxed_json", """select p_partkey as file, case when p_partkey % 10 = 0 then '' else p_name || ' -- <q> no: x' end as name, case when p_partkey % 10 = 0 then '' else p_brand end as brand, case when p_partkey % 10 = 0 then -1 else p_size end::int as size, p_partkey % 10 = 0 as bad from part""")
def _json(spark, sf):
    """An object of every part, every tenth broken."""
    text = F.concat(
        F.lit('-- a part\n#define BRAND "'), "p_brand", F.lit('"\nname : "'), "p_name", F.lit(' -- <q> no: x", brand: BRAND, -- tail\n"in" : {size:['), F.col("p_size").cast("string"), F.lit(", 1.5e3, null]"),
        F.when(F.col("p_partkey") % 10 == 0, "").otherwise("}"), F.lit("\n"),
    )
    got = text_files.relaxed_json(bound(spark, sf, "part").select(F.col("p_partkey").alias("file"), text.alias("value")))
    at = lambda p, kind, none: F.coalesce(F.try_variant_get("value", p, kind), F.lit(none))
    return got.select("file", at("$.name", "string", "").alias("name"), at("$.brand", "string", "").alias("brand"), at("$.in.size[0]", "int", -1).alias("size"), "bad")


@query("srt_files", """select o_custkey as song, (row_number() over w)::int as n, (row_number() over w) * 5000 + o_orderkey % 1000 as start_ms, (row_number() over w) * 5000 + o_orderkey % 1000 + 4000 as end_ms, o_orderpriority || chr(10) || 'of ' || o_orderkey as text
from orders window w as (partition by o_custkey order by o_orderkey)""")
def _srt(spark, sf):
    """Cues of every customer's orders as a file, read again."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = bound(spark, sf, "orders").withColumn("n", n).withColumn("s", F.col("n") * 5000 + F.col("o_orderkey") % 1000)
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat(L.srt_format(F.col("s")), F.lit(" --> "), L.srt_format(F.col("s") + 4000)), "o_orderpriority", F.concat(F.lit("of "), F.col("o_orderkey").cast("string")), F.lit(""))
    files = o.groupBy(F.col("o_custkey").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x.b), "\n").alias("value"))
    return text_files.srt_cues(settings_files.lines_of(files)).withColumn("song", F.col("song").cast("long"))


@query("srt_source", """select o_custkey // 100 as song, (row_number() over w)::int as n, (row_number() over w) * 5000 + o_orderkey % 1000 as start_ms, (row_number() over w) * 5000 + o_orderkey % 1000 + 4000 as end_ms, o_orderpriority || chr(10) || 'of ' || o_orderkey as text
from orders window w as (partition by o_custkey // 100 order by o_orderkey)""")
def _srt_source(spark, sf):
    """Cues of a hundred customers' orders written as a file of their song to the shared folder, and read from there."""
    n = F.row_number().over(W.partitionBy("song").orderBy("o_orderkey"))
    o = bound(spark, sf, "orders").withColumn("song", F.expr("o_custkey div 100")).withColumn("n", n).withColumn("start_ms", F.col("n") * 5000 + F.col("o_orderkey") % 1000)
    cues = o.select("song", "n", "start_ms", (F.col("start_ms") + 4000).alias("end_ms"), F.concat(F.col("o_orderpriority"), F.lit("\nof "), F.col("o_orderkey").cast("string")).alias("text"))
    folder = new_folder(spark, "srt")
    text_files.write_srt(cues, folder)
    out = cut(text_files.read_srt(spark, folder).withColumn("song", F.regexp_extract("song", r"song=(\d+)/", 1).cast("long")))
    remove(spark, folder)
    return out


@query("ordered_output", duck("changes") + "select song, from_measure, tempo, row_number() over (order by song, from_measure) as place from changes")
def _ordered(spark, sf):
    """Tempo entries written in ascending order; the place is read back from the files."""
    folder = new_folder(spark, "ordered")
    G.write_in_order(bound(spark, sf, "changes"), folder, ["song"], ["from_measure"])
    out = cut(G.read_in_order(spark, folder))
    remove(spark, folder)
    return out

"""Layered settings: assignment, defaults, lookups, substitution, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as L


def last_assignment(settings: DataFrame) -> DataFrame:
    """The last value of every (song, key)."""
    return settings.groupBy("song", "key").agg(F.max_by("value_text", "line").alias("value_text"), F.max("line").alias("line"))


def typed(settings: DataFrame) -> DataFrame:
    """Add value_type, value_long, value_double and value_bool by the spelling of value_text."""
    v = settings.withColumn("_v", L.infer_scalar(F.col("value_text")))
    return v.select(*settings.columns, F.col("_v.kind").alias("value_type"), F.col("_v.as_long").alias("value_long"), F.col("_v.as_double").alias("value_double"), F.col("_v.as_bool").alias("value_bool"))


def lookup2(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """Two-level lookup with a default."""
    return df.join(table, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def first_available(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """(key, name): of an array ``alternatives`` the first that ``available`` (name) has, or null."""
    got = wanted.select("key", F.posexplode("alternatives").alias("rank", "name")).join(available.distinct(), "name", "left_semi")
    best = got.groupBy("key").agg(F.min_by("name", "rank").alias("name"))
    return wanted.select("key").join(best, "key", "left")


def split_members(df: DataFrame, members: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the members, and the others."""
    return df.join(members, on, "left_semi"), df.join(members, on, "left_anti")


def restrict(df: DataFrame, selected: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Rows that are selected and allowed; an empty selection selects all."""
    some = selected.select(F.lit(1).alias("_k")).distinct()
    rows = df.withColumn("_k", F.lit(1)).join(F.broadcast(some.withColumn("_some", F.lit(True))), "_k", "left")
    rows = rows.join(selected.select(on).distinct().withColumn("_in", F.lit(True)), on, "left")
    return rows.filter(F.col("_some").isNull() | F.col("_in")).drop("_k", "_some", "_in").join(allowed, on, "left_semi")


def lookup_or_reject(left: DataFrame, right: DataFrame, on: str, reason: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(matched rows, unmatched rows with a reason)."""
    return left.join(right, on), left.join(right, on, "left_anti").withColumn("reason", F.lit(reason))


def resolve_style(voices: DataFrame, effects: DataFrame) -> DataFrame:
    """(voice, variant, style, effects, copied) of rows (voice, variant, reverb): the effects of the sound style.

    The variant ``copy`` has none, an unknown style none and a flag; a reverb level
    in percent, clipped, is appended.
    """
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    copy = F.lower("variant") == "copy"
    style = F.when(copy, "COPY").otherwise(F.concat(F.lit("soundStyle"), cap(L.voice_label(F.col("voice"))), cap(F.col("variant"))))
    got = voices.withColumn("style", style).join(effects.select("style", F.col("effects").alias("_e")), "style", "left")
    level = L.clip((F.col("reverb") * 100).cast("int"), 0, 100)
    tail = F.when(level > 0, F.concat(F.lit(" reverb "), level.cast("string"))).otherwise("")
    return got.select("voice", "variant", "style", F.concat(F.coalesce("_e", F.lit("")), tail).alias("effects"), F.col("_e").isNull().alias("copied"))


def overlay_defaults(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add the default rows (key, value_text) of keys that a song lacks.

    The defaults are a configuration; more than 100,000 of them are refused, so their broadcast is bounded.
    """
    if defaults.limit(100_001).count() > 100_000:
        raise ValueError("too many defaults")
    songs = settings.select("song").distinct()
    wanted = songs.withColumn("_d", F.lit(1)).join(F.broadcast(defaults.withColumn("_d", F.lit(1))), "_d").drop("_d")
    missing = wanted.join(settings, ["song", "key"], "left_anti")
    return settings.select("song", "key", "value_text").unionByName(missing.select("song", "key", "value_text"))


def substitute(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """(id, tokens): whole tokens ``${name}`` become the tokens of the variable (name, value array); unknown ones stay."""
    token = templates.select("id", F.posexplode("tokens").alias("i", "t")).withColumn("name", F.regexp_extract("t", r"^\$\{(\w+)\}$", 1))
    got = token.join(variables, "name", "left").withColumn("v", F.coalesce("value", F.array("t")))
    return got.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x.v)).alias("tokens"))


def to_tags(df: DataFrame, id_col: str, ids: dict[str, str], recode: dict[str, dict[str, str]] | None = None, numbers: Sequence[str] = ()) -> DataFrame:
    """(item, tag, value): metadata columns under technical ids, recoded, numbers as ``n/999``, nulls dropped."""
    cols = {}
    for c in ids:
        v: Column = F.col(c).cast("string")
        if recode and c in recode:
            v = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in recode[c].items() for x in kv)), v), v)
        cols[c] = F.concat(v, F.lit("/999")) if c in numbers else v
    wide = df.select(F.col(id_col).alias("item"), *(v.alias(c) for c, v in cols.items()))
    long = wide.unpivot("item", list(ids), "name", "value").filter("value is not null")
    return long.select("item", F.element_at(F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)), F.col("name")).alias("tag"), "value")

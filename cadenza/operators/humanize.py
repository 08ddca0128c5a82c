"""Humanizing of note events: position-dependent, reproducible variation of velocity and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scalars as L

from . import grid as G
from . import notes as N

#: The default style, positions in listed order.
DEFAULT_STYLE = {
    "positions": [
        {"position": 0.00, "velocity": 1.15, "direction": None, "timing": 0.0},
        {"position": 0.25, "velocity": 1.0, "direction": None, "timing": 0.2},
        {"position": 0.50, "velocity": 1.1, "direction": None, "timing": 0.2},
        {"position": 0.75, "velocity": 1.0, "direction": None, "timing": 0.2},
    ],
    "other": {"velocity": 0.85, "direction": "B", "timing": 0.25},
    "raster": 0.03125,
    "slack": 0.1,
}


def _by_style(styles: dict, name, f):
    """``f(style)`` of the style that the column names."""
    out = None
    for key, style in styles.items():
        out = F.when(name == key, f(style)) if out is None else out.when(name == key, f(style))
    return out


def _at_place(style: dict, place, key: str, kind: str):
    other = F.lit(style["other"][key]).cast(kind)
    out = None
    for i, p in enumerate(style["positions"]):
        v = F.lit(p[key]).cast(kind)
        out = F.when(place == i, v) if out is None else out.when(place == i, v)
    return out.otherwise(other) if out is not None else other


def humanize(
    events: DataFrame, grid: DataFrame, style_map: DataFrame | None = None, styles: dict | None = None, factors: dict | None = None,
    humanized=None, tpq: int = 96, seed: str = "0", tasks: int | None = None,
) -> DataFrame:
    """Note rows (song, track, seq, midi_time, kind, pitch, velocity, ...) with varied time and velocity.

    ``grid`` gives the measures; ``style_map`` (song, from_measure, style) the style in force,
    a style named ``default`` where it has none; ``factors`` variation factors
    (velocity, timing) by canonical track. Timing depends on song, canonical track and
    time only, so tracks of one instrument move together; measures below 1 and tracks
    outside ``humanized`` stay as they are. A note's end stays too, unless the next note of
    its pitch starts before it. All wide steps share the key (song); three orders, by time, by
    measure and by pitch, serve all windows. ``tasks``: how many tasks share the songs, where
    the number of a shuffle's partitions does not follow the input.
    """
    styles = styles or {"default": DEFAULT_STYLE}
    got = G.locate_measure(events, grid, tasks=tasks)
    if style_map is None:
        got = got.withColumn("style", F.lit("default"))
    else:
        got = G.style_in_force(got, style_map, tasks=tasks)
    canonical = L.canonical_track(F.col("track"))
    got = got.withColumn("_name", canonical)
    got = N.pair_notes(N.mark_varying(got))  # pairs last, in the order that the ends need

    note = (F.col("kind") == "On") & (F.col("velocity") > 0) & (F.col("measure") >= 1)
    if humanized is not None:
        note = note & F.col("_name").isin(*humanized)
    got = got.withColumn("_hit", F.coalesce(note, F.lit(False)))
    length = F.coalesce(F.col("t_end") - F.col("t_start"), F.lit(4 * tpq))
    place = _by_style(styles, F.col("style"), lambda s: G.match_position(F.col("midi_time") - F.col("t_start"), length, s, tpq))
    got = got.withColumn("_place", place)
    pick = lambda key, kind: _by_style(styles, F.col("style"), lambda s: _at_place(s, F.col("_place"), key, kind))
    factor = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in factors.items() for x in (k, float(v[i])))), F.col("_name")), F.lit(1.0)) if factors else F.lit(1.0)
    emphasis = F.when(F.col("varying"), 1.0).otherwise(pick("velocity", "double"))
    slack = _by_style(styles, F.col("style"), lambda s: F.lit(s["slack"]))
    rv = L.variation(L.noise(F.lit(seed), F.lit("velocity"), F.col("song").cast("string"), F.col("track"), F.col("seq").cast("string")))
    rt = L.variation(L.noise(F.lit(seed), F.lit("timing"), F.col("song").cast("string"), F.col("_name"), F.col("midi_time").cast("string")))
    direction = pick("direction", "string")
    rt = F.when(direction == "A", -F.abs(rt)).when(direction == "B", F.abs(rt)).otherwise(rt)
    unit = F.bround(F.bround(F.lit(tpq / 8.0)) * pick("timing", "double"))
    shift = F.bround(unit * (rt * factor(1))).cast("long")
    velocity = L.clip((F.col("velocity") * (emphasis + rv * factor(0) * slack)).cast("long"), 0, 127)
    got = got.withColumn("_on", N._is_on())  # by the velocity as it was: a soft note that is varied to 0 starts all the same
    got = got.withColumns({"_time": F.when(F.col("_hit"), F.col("midi_time") + shift).otherwise(F.col("midi_time")), "velocity": F.when(F.col("_hit"), velocity).otherwise(F.col("velocity").cast("long"))})

    # an end moves only if the next start of its pitch, shifted already, is not after it
    from pyspark.sql import Window as W

    w = W.partitionBy("song", "track", "pitch").orderBy("seq")
    nxt = F.lead("_time").over(w)
    ends = ~F.col("_on") & F.col("partner_seq").isNotNull() & F.lag("_hit").over(w)
    follows = F.lead("_on").over(w)
    got = got.withColumn("_end", F.when(F.coalesce(ends & follows & (nxt <= F.col("midi_time")), F.lit(False)), nxt - 1).otherwise(F.col("_time")))
    return got.select(*(F.col("_end").alias("midi_time") if c == "midi_time" else F.col(c) for c in events.columns))


def standardize(events: DataFrame, instruments: DataFrame, grid: DataFrame, settings: DataFrame, stamp: str, humanized=(), tasks: int | None = None, **options) -> DataFrame:
    """Name tracks, replace bad ones, humanize notes, set channels, expand program changes and annotate, in this order.

    ``tasks``: how many tasks share the tracks and the songs, where the number of a shuffle's partitions does not follow the input.
    """
    dealt = lambda df: df.repartition(tasks, "song", "track_no") if tasks else df
    names = N.name_tracks(instruments).select("song", "track_no", F.col("track").alias("_name"))
    got = dealt(events).join(names, ["song", "track_no"], "left").withColumn("track", F.coalesce("_name", "track")).drop("_name")
    got = N.replace_bad_tracks(got)
    notes = got.filter("kind in ('On', 'Off')").withColumns({"pitch": F.col("p1"), "velocity": F.col("p2").cast("long")})
    notes = humanize(notes, grid, humanized=list(humanized), tasks=tasks, **options) if humanized else notes
    notes = notes.withColumn("p2", F.col("velocity").cast("int")).drop("pitch", "velocity")
    got = got.filter("kind not in ('On', 'Off')").unionByName(notes)
    got = N.expand_program_change(dealt(N.rechannel(got, settings)), settings).withColumnRenamed("part", "_part")
    listed = [r for r in humanized]
    got = N.annotate_tracks(got, listed or ["-"], listed or ["-"], stamp)
    order = got.withColumn("seq", F.col("seq") * 100 + F.col("_part") * 10 + F.col("part")).drop("_part", "part")
    return N.order_events(order)


def voice_events(events: DataFrame, voice: str) -> DataFrame:
    """The events of one voice, without volume, pan and reverb."""
    return N.drop_controllers(N.keep_tracks(events, voice))

"""Note events: pairing, overlaps, varying measures, order, and the rewriting of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import scalars as L

#: Rank of the kinds at one time.
RANKS = {"special": 0, "Meta": 1, "PrCh": 2, "Par": 3, "KeySig": 4, "TimeSig": 5, "Tempo": 6, "Off": 7, "On": 8}
#: Track names of instruments.
INSTRUMENT_TRACKS = {"power kit": "drums", "overdriven guitar": "guitar", "reed organ": "bass", "rock organ": "keyboard", "synth voice": "vocals"}


def _is_on(kind="kind", velocity="velocity"):
    return (F.col(kind) == "On") & (F.col(velocity) > 0)


def peak_velocity(events: DataFrame) -> DataFrame:
    """Greatest velocity of the On events per song, track and time."""
    return events.filter("kind = 'On'").groupBy("song", "track", "midi_time").agg(F.max("velocity").alias("peak"))


def pair_notes(events: DataFrame) -> DataFrame:
    """Add ``partner_seq`` to On and Off rows of (song, track, pitch, seq).

    An Off (or an On of velocity 0) belongs to the row before of the same pitch
    if that is an On; an On to the row after if that is an Off. Channels don't count.
    """
    w = W.partitionBy("song", "track", "pitch").orderBy("seq")
    out = events.withColumn("_on", _is_on())
    prev = F.when(F.lag("_on").over(w), F.lag("seq").over(w))
    nxt = F.when(~F.lead("_on").over(w), F.lead("seq").over(w))
    return out.withColumn("partner_seq", F.when(F.col("_on"), nxt).otherwise(prev)).drop("_on")


def clip_overlaps(notes: DataFrame) -> DataFrame:
    """Notes (start, end): an end at or after the next start of the pitch moves to one tick before it."""
    w = W.partitionBy("song", "track", "pitch").orderBy("seq")
    nxt = F.lead("start").over(w)
    return notes.withColumn("end", F.when(nxt <= F.col("end"), nxt - 1).otherwise(F.col("end")))


def varying_measures(peaks: DataFrame) -> DataFrame:
    """(song, track, measure, varying): whether two successive velocity steps have opposite signs."""
    w = W.partitionBy("song", "track", "measure").orderBy("midi_time")
    step = peaks.withColumn("_d", F.col("peak") - F.lag("peak").over(w)).withColumn("_e", F.lag("_d").over(w))
    return step.groupBy("song", "track", "measure").agg(F.coalesce(F.max(F.signum("_d") * F.signum("_e") < 0), F.lit(False)).alias("varying"))


def mark_varying(notes: DataFrame) -> DataFrame:
    """Add ``varying`` of a row's measure to rows (song, track, measure, midi_time, kind, velocity): as ``varying_measures``, without a join.

    The last row of each time, in the order of On rows by velocity, stands for its peak. One order serves all windows,
    and they need no other layout than (song).
    """
    measure = W.partitionBy("song", "track", "measure")
    order = measure.orderBy("midi_time", "_o", "velocity")
    after = F.lead(F.struct("midi_time")).over(order)
    out = notes.withColumn("_o", F.coalesce(F.col("kind") == "On", F.lit(False)))  # a column of its own, so that the windows' orders are seen to be one
    out = out.withColumn("_p", F.when(F.col("_o") & (after.isNull() | ~after.midi_time.eqNullSafe(F.col("midi_time"))), F.col("velocity")))
    before = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("_d", F.when(F.col("_p").isNotNull(), F.col("_p") - before("_p"))).withColumn("_e", before("_d"))
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return out.withColumn("varying", F.coalesce(F.max(F.signum("_d") * F.signum("_e") < 0).over(every), F.lit(False))).drop("_o", "_p", "_d", "_e")


def order_events(events: DataFrame) -> DataFrame:
    """Renumber ``seq`` per track by time and rank of the kind; the track's end is last, ties keep their order."""
    rank = F.lit(3)
    for kind, r in RANKS.items():
        rank = F.when(F.coalesce(F.when(F.col("meta").isin("KeySig", "TimeSig", "Tempo"), F.col("meta")), F.col("kind")) == kind, r).otherwise(rank)
    w = W.partitionBy("song", "track_no").orderBy(F.coalesce(F.col("meta") == "TrkEnd", F.lit(False)), "midi_time", rank, "seq")
    return events.withColumn("seq", F.row_number().over(w).cast("long"))


def _track_end(like: DataFrame) -> dict:
    """The columns of a track end at time 0, in the columns of ``like``."""
    fixed = {"seq": F.lit(0).cast("long"), "midi_time": F.lit(0).cast("long"), "kind": F.lit("Meta"), "meta": F.lit("TrkEnd")}
    return {c: F.col(c) if c in ("song", "track_no", "track") else fixed.get(c, F.lit(None).cast(t)) for c, t in like.dtypes}


def _empty_tracks(tracks: DataFrame, like: DataFrame) -> DataFrame:
    """One track end at time 0 for each (song, track_no, track), in the columns of ``like``."""
    return tracks.select("song", "track_no", "track").distinct().select(*(v.alias(c) for c, v in _track_end(like).items()))


def keep_tracks(events: DataFrame, prefix: str) -> DataFrame:
    """Keep the control track and tracks whose name starts with ``prefix``; the others become empty tracks."""
    keep = (F.col("track_no") == 0) | F.coalesce(F.col("track").startswith(prefix), F.lit(False))
    return events.filter(keep).unionByName(_empty_tracks(events.filter(~keep), events))


def drop_controllers(events: DataFrame, controllers=(7, 10, 91)) -> DataFrame:
    return events.filter(~((F.col("kind") == "Par") & F.coalesce(F.col("p1").isin(*controllers), F.lit(False))))


def with_settings(events: DataFrame, settings: DataFrame, track: str = "track") -> DataFrame:
    """Left lookup of the settings by base track name; which join serves is left to the planner."""
    return events.withColumn("_base", L.base_track(F.col(track))).join(settings.withColumnRenamed("track", "_base"), "_base", "left").drop("_base")


def rechannel(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Drop all Par events; tracks with settings get their channel."""
    got = with_settings(events.filter("kind != 'Par'"), settings.select("track", F.col("channel").alias("_channel")))
    return got.withColumn("channel", F.coalesce("_channel", "channel")).drop("_channel")


def expand_program_change(events: DataFrame, settings: DataFrame, large_banks: bool = True) -> DataFrame:
    """Replace the first program change of a configured track by bank, program, volume, pan and reverb events.

    Settings: (track, bank, program, volume, pan, reverb). Later program changes of such
    tracks go. New rows carry ``part``, their place among the rows of one event.
    """
    got = with_settings(events, settings.select("track", *(F.col(c).alias(f"_{c}") for c in ("bank", "program", "volume", "pan", "reverb"))))
    w = W.partitionBy("song", "track_no", F.col("kind") == "PrCh").orderBy("seq")
    got = got.withColumn("_n", F.row_number().over(w))
    change = (F.col("kind") == "PrCh") & F.col("_program").isNotNull()
    par = lambda c, v: F.struct(F.lit("Par").alias("kind"), F.lit(c).cast("int").alias("p1"), v.cast("int").alias("p2"))
    bank = [par(0, F.floor(F.col("_bank") / 128)), par(32, F.col("_bank") % 128)] if large_banks else [par(0, F.col("_bank") % 128)]
    program = F.struct(F.lit("PrCh").alias("kind"), F.col("_program").cast("int").alias("p1"), F.lit(None).cast("int").alias("p2"))
    rows = F.array(*bank, program, par(7, F.col("_volume")), par(10, F.col("_pan")), par(91, F.col("_reverb")))
    own = F.array(F.struct("kind", F.col("p1").cast("int").alias("p1"), F.col("p2").cast("int").alias("p2")))
    got = got.filter(~(change & (F.col("_n") > 1))).withColumn("_rows", F.when(change, rows).otherwise(own))
    got = got.select(*(c for c in got.columns if c not in ("kind", "p1", "p2")), F.posexplode("_rows").alias("part", "_e"))
    return got.select(*(F.col(f"_e.{c}").alias(c) if c in ("kind", "p1", "p2") else F.col(c) for c in events.columns), "part")


def replace_bad_tracks(events: DataFrame, least: int = 5) -> DataFrame:
    """Tracks named ``new:`` or of fewer than ``least`` lines (begin and end included) become empty.

    The first row of each name of a bad track becomes its end, so the events are read and sorted once.
    """
    w = W.partitionBy("song", "track_no").orderBy("track")
    n = F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) + 1
    before = F.lag(F.struct("track")).over(w)
    first = before.isNull() | ~before.track.eqNullSafe(F.col("track"))
    marked = events.withColumns({"_n": n, "_first": first})
    marked = marked.withColumn("_bad", F.coalesce(F.col("track").contains("new:"), F.lit(False)) | (F.col("_n") < least))
    kept = marked.filter("not _bad or _first")
    return kept.select(*(F.when(F.col("_bad"), v).otherwise(F.col(c)).alias(c) for c, v in _track_end(events).items()))


def name_tracks(tracks: DataFrame, instruments: dict[str, str] | None = None) -> DataFrame:
    """Names for unnamed tracks (song, track_no, track, instrument): by instrument, repeats with A, B, ...; others lose what follows a colon."""
    table = F.create_map(*(F.lit(x) for kv in (instruments or INSTRUMENT_TRACKS).items() for x in kv))
    unnamed = (F.col("track_no") != 0) & F.coalesce(F.col("track") == "", F.lit(True))
    base = F.coalesce(F.try_element_at(table, F.col("instrument")), F.col("instrument"))
    got = tracks.withColumn("_u", unnamed).withColumn("_b", F.when(unnamed, base))
    n = F.row_number().over(W.partitionBy("song", "_u", "_b").orderBy("track_no"))
    suffix = F.when(n == 1, "").otherwise(F.substring(F.lit("ABCDEF"), n - 1, F.lit(1)))
    return got.withColumn("track", F.when(F.col("_u"), F.concat("_b", suffix)).otherwise(F.substring_index("track", ":", 1))).drop("_u", "_b")


def annotate_tracks(events: DataFrame, names, humanized, stamp: str) -> DataFrame:
    """After each track name of a listed track insert a text event that tells how it was made; new rows have ``part`` 1."""
    named = (F.col("meta") == "TrkName") & F.col("track").isin(*names)
    word = F.when(L.canonical_track(F.col("track")).isin(*humanized), "humanized").otherwise("processed")
    note = F.concat(word, F.lit(f" at {stamp}"))
    both = F.array(F.struct("meta", "text"), F.struct(F.lit("Text").alias("meta"), note.alias("text")))
    got = events.withColumn("_rows", F.when(F.coalesce(named, F.lit(False)), both).otherwise(F.slice(both, 1, 1)))
    got = got.select(*(c for c in got.columns if c not in ("meta", "text")), F.posexplode("_rows").alias("part", "_e"))
    return got.select(*(F.col(f"_e.{c}").alias(c) if c in ("meta", "text") else F.col(c) for c in events.columns), "part")


def clamp_track_settings(df: DataFrame) -> DataFrame:
    """Channel 0-15, bank 0-16383, all other values 0-127."""
    top = {"channel": 15, "bank": 16383, "program": 127, "volume": 127, "pan": 127, "reverb": 127}
    return df.withColumns({c: L.clip(F.col(c), 0, t) for c, t in top.items() if c in df.columns})


def assign_channels(voices: DataFrame) -> DataFrame:
    """Channel 10 for drums and percussion; the others 1-9, 11-16 in order, staying at 16."""
    drum = F.col("voice").isin("drums", "percussion")
    n = F.least(F.sum(F.when(drum, 0).otherwise(1)).over(W.partitionBy("song").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)), F.lit(15))
    return voices.withColumn("channel", F.when(drum, 10).otherwise(n + F.when(n > 9, 1).otherwise(0)).cast("int"))


def check_order(events: DataFrame) -> DataFrame:
    """(song, track_no, decreasing, ends): decreasing times, and whether the track ends with its end event."""
    w = W.partitionBy("song", "track_no").orderBy("seq")
    got = events.withColumn("_bad", F.col("midi_time") < F.lag("midi_time").over(w))
    last = F.max_by(F.coalesce(F.col("meta"), F.lit("")), "seq") == "TrkEnd"
    return got.groupBy("song", "track_no").agg(F.sum(F.coalesce(F.col("_bad").cast("long"), F.lit(0))).alias("decreasing"), last.alias("ends"))

"""Standard MIDI Files: decoding to event rows and encoding from them.

A file is local to its row, so decoding needs no shuffle; encoding groups the
events of a song, which is one file by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.schemas import EVENTS

from .shared import give_back

#: Message and meta types of the format, those with text, and the names of keys from seven flats to seven sharps.
_CHANNEL = {0x80: ("Off", 2), 0x90: ("On", 2), 0xA0: ("PolyPress", 2), 0xB0: ("Par", 2), 0xC0: ("PrCh", 1), 0xD0: ("ChanPress", 1), 0xE0: ("PitchWhl", 2)}
_META = {0: "SeqNum", 1: "Text", 2: "Copyright", 3: "TrkName", 4: "InstrName", 5: "Lyric", 6: "Marker", 7: "CuePt", 0x20: "ChanPrfx", 0x2F: "TrkEnd", 0x51: "Tempo", 0x54: "SMPTEOffset", 0x58: "TimeSig", 0x59: "KeySig", 0x7F: "SeqMeta"}
_TEXTS = frozenset(range(1, 8))
_MAJOR = ("Cb", "Gb", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#")
_MINOR = ("Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E", "B", "F#", "C#", "G#", "D#", "A#")
FIELDS = EVENTS.fieldNames()
#: Event rows that a task of decoding holds before it passes them on, besides those of one file.
HELD_ROWS = 5000


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        at += 1
        n = n << 7 | b & 0x7F
        if b < 0x80:
            return n, at


def _coded(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def _meta_fields(kind: int, body: bytes) -> dict:
    if kind in _TEXTS:
        return {"text": body.decode("utf-8", "replace")}
    if kind == 0x51:
        return {"p1": int.from_bytes(body, "big")}
    if kind in (0, 0x20):
        return {"p1": int.from_bytes(body, "big")}
    if kind == 0x58:
        return {"text": f"{body[0]}/{1 << body[1]} {body[2]} {body[3]}", "p1": body[0], "p2": 1 << body[1]}
    if kind == 0x59:
        sharps = int.from_bytes(body[:1], "big", signed=True)
        return {"text": (_MINOR if body[1] else _MAJOR)[sharps + 7] + (" minor" if body[1] else " major"), "p1": sharps, "p2": body[1]}
    return {"data": body}


def decode(data: bytes, song: str) -> list[dict]:
    """Event rows of a file; raises ValueError or IndexError if it is broken."""
    if data[:4] != b"MThd" or data[4:8] != b"\0\0\0\x06":
        raise ValueError("no MIDI header")
    form, tracks, tpq = (int.from_bytes(data[i : i + 2], "big") for i in (8, 10, 12))
    if form > 2:
        raise ValueError("unknown format")
    at, rows = 14, []
    for track in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("no track header")
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        at += 8
        end = at + size
        if end > len(data):
            raise ValueError("truncated track")
        time = status = 0
        own, name, ended = [], None, False
        while at < end:
            delta, at = _varlen(data, at)
            time += delta
            if data[at] >= 0x80:
                status = data[at]
                at += 1
            elif not 0x80 <= status < 0xF0:
                raise ValueError("running status without a status")
            row = {"seq": len(own), "midi_time": time}
            if status == 0xFF:
                kind = data[at]
                n, at = _varlen(data, at + 1)
                body, at = data[at : at + n], at + n
                row |= {"kind": "Meta", "meta": _META.get(kind, f"0x{kind:02x}")} | _meta_fields(kind, body)
                if kind == 3 and name is None:
                    name = row["text"]
                ended = ended or kind == 0x2F
            elif status in (0xF0, 0xF7):
                n, at = _varlen(data, at)
                row |= {"kind": "SysEx" if status == 0xF0 else "SysExEnd", "data": data[at : at + n]}
                at += n
            else:
                kind, n = _CHANNEL[status & 0xF0]
                row |= {"kind": kind, "channel": (status & 15) + 1, "p1": data[at]}
                if kind == "PitchWhl":
                    row["p1"] = data[at] | data[at + 1] << 7
                elif n == 2:
                    row["p2"] = data[at + 1]
                at += n
            own.append(row)
        if at != end or not ended:
            raise ValueError("track without an end")
        rows += [{f: None for f in FIELDS} | r | {"song": song, "track_no": track, "track": name, "tpq": tpq} for r in own]
    return rows


def _message(r) -> bytes:
    kind = r["kind"]
    if kind == "Meta":
        code = next((k for k, v in _META.items() if v == r["meta"]), None)
        code = int(r["meta"], 16) if code is None else code
        if code in _TEXTS:
            body = (r["text"] or "").encode()
        elif code == 0x51:
            body = int(r["p1"]).to_bytes(3, "big")
        elif code in (0, 0x20):
            body = int(r["p1"]).to_bytes(2 if code == 0 else 1, "big")
        elif code == 0x58:
            head, clock, notes = r["text"].split(" ")
            num, den = map(int, head.split("/"))
            body = bytes([num, den.bit_length() - 1, int(clock), int(notes)])
        elif code == 0x59:
            body = int(r["p1"]).to_bytes(1, "big", signed=True) + bytes([int(r["p2"])])
        else:
            body = bytes(r["data"] or b"")
        return bytes([0xFF, code]) + _coded(len(body)) + body
    if kind in ("SysEx", "SysExEnd"):
        body = bytes(r["data"] or b"")
        return bytes([0xF0 if kind == "SysEx" else 0xF7]) + _coded(len(body)) + body
    status, n = next((s, n) for s, (k, n) in _CHANNEL.items() if k == kind)
    if kind == "PitchWhl":
        values = [int(r["p1"]) & 127, int(r["p1"]) >> 7]
    else:
        values = [int(r["p1"]), int(r["p2"])] if n == 2 else [int(r["p1"])]
    return bytes([status | int(r["channel"]) - 1, *values])


def encode(rows: list[dict]) -> bytes:
    """A format-1 file of the event rows of one song."""
    tracks: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["track_no"], r["seq"])):
        tracks.setdefault(int(r["track_no"]), []).append(r)
    tpq = next((int(r["tpq"]) for r in rows if r.get("tpq")), 96)
    out = b"MThd\0\0\0\x06\0\x01" + len(tracks).to_bytes(2, "big") + tpq.to_bytes(2, "big")
    for own in tracks.values():
        time, body = 0, b""
        for r in own:
            delta = int(r["midi_time"]) - time
            if delta < 0:
                raise ValueError("time decreases in a track")
            time += delta
            body += _coded(delta) + _message(r)
        out += b"MTrk" + len(body).to_bytes(4, "big") + body
    return out


def read_midi(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of the files below a folder; a song is its file's path below it."""
    from .files import relative

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_midi(files.select(relative(F.col("path"), path).alias("song"), "content"))


def decode_midi(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of files (song, content); a broken file is a row (song, reason) of the rejects."""

    limit = HELD_ROWS

    def shown(out):
        import pandas as pd

        got = pd.DataFrame(out, columns=[*FIELDS, "reason"], dtype=object)
        return got.where(got.notna(), None)

    def run(frames):
        for frame in frames:
            out = []
            for name, data in zip(frame["song"], frame["content"], strict=True):
                try:
                    out += [r | {"reason": None} for r in decode(bytes(data), name)]
                except (ValueError, IndexError) as e:
                    out.append({f: None for f in FIELDS} | {"song": name, "reason": str(e) or type(e).__name__})
                while len(out) >= limit:  # a batch has many files, a file many events
                    yield shown(out[:limit])
                    del out[:limit]
            if out:
                yield shown(out)
            del frame, out
            give_back()

    rows = files.select("song", "content").mapInPandas(run, T.StructType([*EVENTS.fields, T.StructField("reason", T.StringType())]))
    return rows.filter("reason is null").select(*FIELDS), rows.filter("reason is not null").select("song", "reason")


def midi_files(events: DataFrame) -> DataFrame:
    """(song, content): the encoded file of every song."""

    def run(frame):
        import pandas as pd

        rows = [{k: None if v is None or v != v else v for k, v in r.items()} for r in frame.to_dict("records")]
        return pd.DataFrame([(frame["song"].iloc[0], encode(rows))], columns=["song", "content"])

    return events.select(*FIELDS).groupBy("song").applyInPandas(run, "song string, content binary")


def write_midi(events: DataFrame, path: str, mode: str = "append") -> None:
    """One file per song, by the data source of this package: nothing is there unless all are."""
    from .data_sources import register

    register(events.sparkSession)
    events.select(*FIELDS).repartition("song").sortWithinPartitions("song", "track_no", "seq").write.format("midi").mode(mode).save(path)

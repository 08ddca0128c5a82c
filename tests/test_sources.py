import json
import random
import re
import struct

import numpy as np
import pytest

from cadenza.operators.notes import check_order
from cadenza.sources import midi
from cadenza.sources.midi import read_midi, write_midi
from cadenza.sources.settings_files import include_closure, read_settings, settings_of
from cadenza.sources.text_files import read_multi_table_tsv, read_relaxed_json, read_srt, write_srt
from cadenza.sources.wav import head, read_wav, write_wav


def song():
    ev = lambda track, seq, t, kind, **k: {f: None for f in midi.FIELDS} | {"song": "a.mid", "track_no": track, "seq": seq, "midi_time": t, "kind": kind, "tpq": 96} | k
    rows = [
        ev(0, 0, 0, "Meta", meta="TrkName", text="control"), ev(0, 1, 0, "Meta", meta="Tempo", p1=500000), ev(0, 2, 0, "Meta", meta="TimeSig", text="3/4 24 8", p1=3, p2=4),
        ev(0, 3, 288, "Meta", meta="TimeSig", text="6/16 24 8", p1=6, p2=16), ev(0, 4, 300, "Meta", meta="KeySig", text="Eb major", p1=-3, p2=0), ev(0, 5, 301, "Meta", meta="KeySig", text="F# minor", p1=3, p2=1),
        ev(0, 6, 302, "Meta", meta="SeqNum", p1=7), ev(0, 7, 303, "Meta", meta="SMPTEOffset", data=b"\x01\x02\x03\x04\x05"), ev(0, 8, 304, "Meta", meta="SeqMeta", data=b"xyz"), ev(0, 9, 400, "Meta", meta="TrkEnd", data=b""),
        ev(1, 0, 0, "Meta", meta="TrkName", text="vocals"), ev(1, 1, 1, "PrCh", channel=2, p1=40), ev(1, 2, 1, "Par", channel=2, p1=7, p2=100), ev(1, 3, 20000, "On", channel=2, p1=60, p2=90),
        ev(1, 4, 20010, "PolyPress", channel=2, p1=60, p2=9), ev(1, 5, 20011, "ChanPress", channel=2, p1=3), ev(1, 6, 20012, "PitchWhl", channel=2, p1=8192), ev(1, 7, 20013, "SysEx", data=b"\x01\xf7"),
        ev(1, 8, 20020, "Off", channel=2, p1=60, p2=0), ev(1, 9, 20020, "Meta", meta="Lyric", text="lé"), ev(1, 10, 20020, "Meta", meta="TrkEnd", data=b""),
    ]
    names = {0: "control", 1: "vocals"}
    return [r | {"track": names[r["track_no"]]} for r in rows]


def test_midi_round_trip(spark, tmp_path):
    rows = song()
    data = midi.encode(rows)
    assert midi.decode(data, "a.mid") == rows
    running = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk" + struct.pack(">I", 15) + b"\0\x90\x3c\x40\x10\x3c\0\0\x3e\x40\0\xff\x2f\0"[:15].ljust(15, b"\0")
    running = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk" + struct.pack(">I", 14) + b"\0\x90\x3c\x40\x10\x3c\0\0\x3e\x40\0\xff\x2f\0"
    assert [(r["kind"], r["p1"], r["p2"]) for r in midi.decode(running, "r")][:3] == [("On", 60, 64), ("On", 60, 0), ("On", 62, 64)]
    for bad in (b"", data[:-3], b"RIFF" + data[4:], data[:9] + b"\x03" + data[10:]):
        with pytest.raises((ValueError, IndexError)):
            midi.decode(bad, "x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mid").write_bytes(data)
    (tmp_path / "in/broken.mid").write_bytes(data[:-3])
    events, rejects = read_midi(spark, str(tmp_path / "in"))
    assert events.count() == len(rows) and [r.reason for r in rejects.collect()] == ["truncated track"]
    assert {(r.decreasing, r.ends) for r in check_order(events).collect()} == {(0, True)}
    write_midi(events, str(tmp_path / "out"))
    assert (tmp_path / "out/a.mid").read_bytes() == data


def test_decoding_passes_rows_on(spark, monkeypatch):
    """Events of the many files of a batch are given out in bounded parts, whole and in order."""
    rows = song()
    data = midi.encode(rows)
    files = spark.createDataFrame([(f"s{i:02}", data[:-3] if i % 7 == 3 else data) for i in range(20)], "song string, content binary").coalesce(1)
    monkeypatch.setattr(midi, "HELD_ROWS", 3)
    events, rejects = midi.decode_midi(files)
    got = [(r.song, r.track_no, r.seq, r.midi_time, r.kind) for r in events.collect()]
    assert got == [(f"s{i:02}", r["track_no"], r["seq"], r["midi_time"], r["kind"]) for i in range(20) if i % 7 != 3 for r in rows]
    assert sorted(r.song for r in rejects.collect()) == ["s03", "s10", "s17"]


def test_wav_round_trip(spark, tmp_path):
    x = np.arange(-5000, 5000, dtype=np.int64) * 7
    rows = [("s", "v", i, i * 1000, 2, 8000, x[i * 2000 : (i + 1) * 2000].tolist()) for i in range(5)]
    pcm = spark.createDataFrame(rows, "song string, voice string, chunk bigint, frame0 bigint, n_channels int, rate int, samples array<bigint>")
    write_wav(pcm, str(tmp_path / "w"), 8000)
    (tmp_path / "w/bad-x.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "w/sub").mkdir()
    for bits, raw in ((8, bytes([0, 128, 255])), (24, b"\x00\x34\x12" * 2), (32, b"\x00\x00\xff\x7f")):
        (tmp_path / f"w/sub/b{bits}-x.wav").write_bytes(head(1, 8000, len(raw)).replace(struct.pack("<HH", 2, 16), struct.pack("<HH", bits // 8, bits)) + raw)
    pcm, rejects = read_wav(spark, str(tmp_path / "w"), 1500)
    assert [tuple(r) for r in rejects.collect()] == [("bad-x.wav", "no WAVE header")]
    assert {r.song: list(r.samples) for r in pcm.filter("song != 's'").collect()} == {"sub/b8": [-32768, 0, 32512], "sub/b24": [0x1234, 0x1234], "sub/b32": [32767]}
    got = sorted(pcm.filter("song = 's'").collect(), key=lambda r: r.chunk)
    assert [r.frame0 for r in got] == [0, 1500, 3000, 4500] and {(r.song, r.voice, r.n_channels, r.rate) for r in got} == {("s", "v", 2, 8000)}
    assert [s for r in got for s in r.samples] == np.clip(x, -32767, 32767).tolist()


def test_settings(spark, tmp_path):
    (tmp_path / "root.txt").write_text(
        '-- first\nyear = 2020\nvoices = "vocals"\nINCLUDE "more.txt"\nall = voices ", drums"\nyear = 2021\nlong = "a" \\\n  "b"\nhex = 0x1F\nflag = WAHR\nreal = -2.5\nINCLUDE "more.txt"\nname = plain text\n\nstray\n'
    )
    (tmp_path / "more.txt").write_text('extra = voices\nINCLUDE "root.txt"\nvoices = "bass"\n')
    roots = spark.createDataFrame([("root.txt",)], "file string")
    got = read_settings(spark, str(tmp_path), roots).collect()
    last = {r.key: r for r in sorted(got, key=lambda r: r.line)}
    assert {k: r.value_text for k, r in last.items()} == {
        "year": "2021", "voices": "bass", "extra": "vocals", "all": "bass, drums", "long": "ab", "hex": "0x1F", "flag": "WAHR", "real": "-2.5", "name": "plain text",
    }
    assert last["hex"].value_long == 31 and last["flag"].value_bool is True and last["real"].value_double == -2.5 and last["year"].value_type == "long"
    assert len(got) == 11
    # files of one name in two folders, includes beside the including file, and a long chain of them
    for d in "ab":
        (tmp_path / f"deep/{d}").mkdir(parents=True)
        (tmp_path / f"deep/{d}/x.txt").write_text(f'k = "{d}"\nINCLUDE "more.txt"\nINCLUDE "../top.txt"\n')
        (tmp_path / f"deep/{d}/more.txt").write_text(f'm = "more {d}"\n')
    (tmp_path / "deep/top.txt").write_text('t = "top"\nINCLUDE "c0.txt"\n')
    for i in range(12):
        (tmp_path / f"deep/c{i}.txt").write_text(f'c{i} = "{i}"\n' + (f'INCLUDE "c{i + 1}.txt"\n' if i < 11 else ""))
    roots = spark.createDataFrame([("a/x.txt",), ("b/x.txt",)], "file string")
    got = {(r.song, r.key): r.value_text for r in read_settings(spark, str(tmp_path / "deep"), roots).collect()}
    assert got == {(f"{d}/x.txt", k): v for d in "ab" for k, v in {"k": d, "m": f"more {d}", "t": "top", **{f"c{i}": str(i) for i in range(12)}}.items()}


def test_tables_json_srt(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.tsv").write_text('# c\nTABLE one\na\tb\n1\t2\n\n3\t"open\nend" \n4\nTABLE two\nz\n9\t8\n')
    rows = {(r.table, r.linenum): (dict(r.fields), r.bad) for r in read_multi_table_tsv(spark, str(tmp_path / "t")).collect()}
    assert rows == {("one", 4): ({"a": "1", "b": "2"}, False), ("one", 6): ({"a": "3", "b": "open\nend"}, False), ("one", 8): ({"a": "4"}, True), ("two", 11): ({"z": "9"}, True)}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('-- head\nkey: "v -- no: x", other : [1, 2], -- tail\n"q": {in: null}\n')
    (tmp_path / "j/b.json").write_text("{ broken: ")
    (tmp_path / "j/c.json").write_text('#define N 7\n#define S "two words"\na: "x<q>y<q><q>z N", n: N, s : [S, true, 1e5], N: 1\n')
    rows = read_relaxed_json(spark, str(tmp_path / "j")).selectExpr("file", "to_json(value) v", "bad").collect()
    assert {r.file: json.loads(r.v) for r in rows} == {"a.json": {"key": "v -- no: x", "other": [1, 2], "q": {"in": None}}, "b.json": {}, "c.json": {"a": "x<q>y<q><q>z N", "n": 7, "s": ["two words", True, 1e5], "N": 1}}
    assert [r.file for r in rows if r.bad] == ["b.json"]
    cues = spark.createDataFrame([("s", 2, 8000, 9533, "two\nlines"), ("s", 1, 0, 7600, "one")], "song string, n int, start_ms bigint, end_ms bigint, text string")
    write_srt(cues, str(tmp_path / "c"))
    (tmp_path / "d").mkdir()
    (part,) = [p for p in (tmp_path / "c/song=s").iterdir() if p.suffix == ".txt"]
    text = part.read_text()
    assert text.startswith("1\n00:00:00,000 --> 00:00:07,600\none\n\n2\n")
    (tmp_path / "d/s.srt").write_text(text)
    assert sorted(map(tuple, read_srt(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, cues.collect()))
    (tmp_path / "d/long.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\n" + "\n".join(f"l{i}" for i in range(1500)) + "\n")
    assert len(read_srt(spark, str(tmp_path / "d")).filter("song = 'long'").first().text.split("\n")) == 1500


class Plain:
    """Settings of one root read line by line, by the rules of the format."""

    def __init__(self, files, root):
        self.files, self.seen, self.lines, self.text, self.value, self.out = files, set(), [], {}, {}, []
        self.read(root)
        logical, open_ = [], None
        for n, line in enumerate(self.lines, 1):
            s = line.strip()
            if s.startswith("--"):
                continue
            if re.match(r"[A-Za-z_]\w*\s*=", s):
                open_ = [n, s]
                logical.append(open_)
            elif not s:
                open_ = None
            elif open_:
                open_[1] += " " + s
            if open_ and open_[1].endswith("\\"):
                open_[1] = open_[1][:-1].rstrip()
        for n, s in logical:
            key, _, raw = s.partition("=")
            v = self.combine(self.expand(raw.strip()))
            self.text[key.strip()] = v
            self.out.append((key.strip(), n, v.replace('\\"', '"')))

    def read(self, file):
        self.seen.add(file)
        for line in self.files[file].split("\n"):
            m = re.match(r'\s*INCLUDE\s+"([^"]+)"', line)
            self.lines.append("-- " + line if m else line)
            if m and m[1] in self.files and m[1] not in self.seen:
                self.read(m[1])

    def shown(self, name):
        if name not in self.text:
            return name
        v = self.text[name]
        if v.upper() in ("TRUE", "WAHR", "FALSE", "FALSCH"):
            return str(v.upper() in ("TRUE", "WAHR"))
        if re.fullmatch(r"[+-]?\d+", v):
            return repr(int(v))
        if re.fullmatch(r"0[xX][0-9A-Fa-f]+", v):
            return repr(int(v, 16))
        return repr(float(v)) if re.fullmatch(r"[+-]?\d+\.\d*", v) else f'"{v}"'

    def expand(self, s):
        out, i = "", 0
        while i < len(s):
            if s[i] == '"':
                j = i + 1
                while j < len(s) and s[j] != '"':
                    j += 2 if s[j] == "\\" else 1
                out, i = out + s[i : j + 1], j + 1
            elif m := re.match(r"[A-Za-z_]\w*", s[i:]):
                out, i = out + self.shown(m[0]), i + len(m[0])
            else:
                out, i = out + s[i], i + 1
        return out

    def combine(self, s):
        out, i = "", 0
        while i < len(s):
            if s[i] == '"':
                j = i + 1
                while j < len(s) and s[j] != '"':
                    j += 2 if s[j] == "\\" else 1
                out, i = out + s[i + 1 : j], j + 1
            elif s[i].isspace():
                i += 1
            else:
                m = re.match(r"\S*\s?", s[i:])
                out, i = out + m[0], i + len(m[0])
        return out


def settings_rows(spark, files, roots):
    lines = [(f, n, x) for f, t in files.items() for n, x in enumerate(t.split("\n"), 1)]
    got = settings_of(spark.createDataFrame(lines, "file string, linenum int, line string"), spark.createDataFrame([(r,) for r in roots], "file string"))
    return sorted((r.song, r.key, r.line, r.value_text) for r in got.collect())


def test_settings_against_a_line_by_line_reader(spark):
    """Names glued to texts and numbers, plain writing of numbers and flags, odd quotes, repeated and cyclic includes."""
    r = random.Random(11)
    keys = ["a", "b", "c", "num", "flag"]
    pieces = ['"x, y"', '"5"', "5", "0x1F", "+07", "2.50", "-0", "WAHR", "a", "b", "c", "num", "flag", '"say \\"hi\\""', "two words", ",", "  ", '"open', "1a", "a.b", '""', "Falsch", '"é"']
    files = {}
    for f in range(14):
        lines = []
        for _ in range(r.randint(2, 12)):
            kind = r.random()
            if kind < 0.15:
                lines.append(f'INCLUDE "f{r.randrange(14)}"')
            elif kind < 0.25:
                lines.append(r.choice(["", "-- c", "  stray = ", "  more text", '"a" \\', "\\"]))
            else:
                lines.append(f"{r.choice(keys)}{r.choice([' = ', '=', '  =   '])}" + "".join(r.choice(pieces) + r.choice([" ", "", "  "]) for _ in range(r.randint(0, 4))) + r.choice(["", " \\"]))
        files[f"f{f}"] = "\n".join(lines)
    want = sorted((f, *x) for f in files for x in Plain(files, f).out)
    assert settings_rows(spark, files, sorted(files)) == want and len(want) > 200


def test_long_chains(spark):
    """Sixty includes in a row are few joins, and a text extended many times is few rounds."""
    files = {f"c{i:02d}": f'k{i} = "{i}"\n' + (f'INCLUDE "c{i + 1:02d}"\n' if i < 60 else "") + f"end{i} = k{i}" for i in range(61)}
    files["grow"] = 'v = "no 0"\n' + "\n".join(f'v = v ", {i}"' for i in range(1, 200)) + "\nlast = v"
    lines = [(f, n, x) for f, t in files.items() for n, x in enumerate(t.split("\n"), 1)]
    df = spark.createDataFrame(lines, "file string, linenum int, line string")
    got = settings_of(df, spark.createDataFrame([("c00",), ("c55",), ("grow",)], "file string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") <= 10
    rows = {(r.song, r.key): (r.line, r.value_text) for r in got.collect()}
    assert rows["c00", "k60"] == (60 * 2 + 1, "60") and rows["c00", "end0"][0] == 61 * 3 - 1 and rows["c55", "end57"][1] == "57" and len(rows) == 61 * 2 + 6 * 2 + 2
    assert rows["grow", "last"][1] == "no " + ", ".join(map(str, range(200)))


def test_include_ways(spark):
    """The first way in reading order, over files that are included many times and over cycles."""
    r = random.Random(5)
    for cyclic in (False, True):
        edges = sorted({(f"f{a:02d}", r.randrange(1, 9), f"f{b:02d}") for a, b in ((r.randrange(20), r.randrange(20)) for _ in range(45)) if cyclic or a < b})
        edges = list({(f, n): (f, n, t) for f, n, t in edges}.values())
        roots = [f"f{i:02d}" for i in range(20)]
        got = include_closure(spark.createDataFrame(edges, "file string, linenum int, include string"), spark.createDataFrame([(x,) for x in roots], "file string"))
        want = []
        for root in roots:
            seen = set()

            def walk(f, at, root=root, seen=seen):
                seen.add(f)
                want.append((root, f, at))
                for _, n, t in sorted(e for e in edges if e[0] == f):
                    if t not in seen:
                        walk(t, [*at, n])

            walk(root, [])
        assert sorted((x.song, x.file, list(x["at"])) for x in got.collect()) == sorted(want)


def test_scan_carries_no_lines(spark):
    """Windows over a file keep marks instead of lines, by one order, and any number of tasks gives the same rows."""
    import re

    from cadenza.operators import text as X

    page = lambda n, digits: [f"%%Page: {n}", "0 setcolor", "f selectfont", *(f"({d})" for d in digits), "glyphs", "(9)", "x"]
    rows = [(f, i, t) for f in range(9) for i, t in enumerate(["f selectfont", "(4)", *page(1, "21"), *page(2, "43"), *page(3, "5")])]
    df = spark.createDataFrame(rows, "doc_id int, linenum int, line string")
    scan = lambda **k: X.scan_sections(df, r"^%%Page: (\d+)", "setcolor", "selectfont", r"^\((\d)\)", "glyphs", **k)
    want = sorted((f, p, m) for f in range(9) for p, m in ((1, 1), (2, 34), (3, 42)))
    assert sorted(map(tuple, scan().collect())) == sorted(map(tuple, scan(tasks=7).collect())) == want
    plan = scan(tasks=7)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[[^\n]*\bline#", plan) and not re.search(r"Project \[[^\n]*, line#\d+[^\n]*\n[^\n]*Window", plan)
    assert re.search(r"RepartitionByExpression \[doc_id#\d+\], 7", plan)

"""Closed forms against loops, on random inputs; plans; texts with several tables; traces."""

import json
import random
import re

from pyspark.sql import functions as F

from cadenza.functions import scalars as L
from cadenza.operators import grid as G
from cadenza.operators import humanize as H
from cadenza.operators import notes as N
from cadenza.operators import spans as P
from cadenza.functions.nested import parse_nested


def test_pair_notes(spark):
    r = random.Random(4)
    rows = [(s, "t", i, r.choice(["On", "Off"]), r.randint(60, 62), r.choice([0, 5, 9])) for s in range(40) for i in range(30)]
    want = {}
    for s in range(40):
        open_ = {}
        for _, _, i, kind, p, v in (x for x in rows if x[0] == s):
            if kind == "On" and v:
                open_[p] = i
            elif p in open_:
                j = open_.pop(p)
                want[s, i], want[s, j] = j, i
    got = N.pair_notes(spark.createDataFrame(rows, "song int, track string, seq int, kind string, pitch int, velocity int")).collect()
    assert all(want.get((x.song, x.seq)) == x.partner_seq for x in got)


def test_varying_measures(spark):
    r = random.Random(5)
    rows = [(m, "t", 1, t, r.randint(1, 4)) for m in range(300) for t in range(r.randint(1, 6))]
    want = {}
    for m in range(300):
        v = [x[4] for x in rows if x[0] == m]
        d = [b - a for a, b in zip(v, v[1:], strict=False)]
        want[m] = any(a * b < 0 for a, b in zip(d, d[1:], strict=False))
    got = N.varying_measures(spark.createDataFrame(rows, "song int, track string, measure int, midi_time int, peak int")).collect()
    assert {x.song: x.varying for x in got} == want


def test_measure_grid(spark):
    r = random.Random(6)
    sigs, lasts, want = [], [], {}
    for s in range(60):
        own = [(r.choice([0, 384, 768, 1056, r.randint(0, 4000)]), r.randint(2, 7), r.choice([4, 8])) for _ in range(r.randint(0, 5))]
        end = r.randint(0, 5000)
        sigs += [(s, *x) for x in own]
        lasts.append((s, end))
        at = {}
        for t, n, d in sorted(own):
            at[t] = round(round(n / d * 4, 3) * 96)
        t, m, ticks, out = 0, 0, 384, []
        while True:
            ticks = at.get(t, ticks) if t <= end else ticks
            out.append((m, t))
            if t > end:
                break
            t, m = t + ticks, m + 1
        want[s] = out
    got = G.measure_grid(spark.createDataFrame(sigs, "song long, time long, num long, den long"), spark.createDataFrame(lasts, "song long, last_time long"), 96, 1).collect()
    have = {}
    for x in sorted(got, key=lambda x: (x.song, x.measure)):
        have.setdefault(x.song, []).append((x.measure, x.t_start))
    assert have == want
    assert all((x.t_end is None) == (x.t_start == want[x.song][-1][1]) for x in got)


def test_quantize_and_channels(spark):
    r = random.Random(7)
    rows = [(s, p, r.randint(1, 900) / 128) for s in range(30) for p in range(20)]
    want, carry = {}, {}
    for s, p, d in rows:
        x = carry.get(s, 0.0) + d * 25
        want[s, p] = int(x)
        carry[s] = x - int(x)
    got = G.quantize(spark.createDataFrame(rows, "song int, page int, seconds double"), 25.0).collect()
    assert {(x.song, x.page): x.frames for x in got} == want
    voices = [(0, i, "drums" if i in (2, 15) else "v") for i in range(22)]
    out, n = [], 0
    for _, _, v in voices:
        if v == "drums":
            out.append(10)
        else:
            n = min(n + 1, 16) if n + 1 != 10 else 11
            out.append(n)
    got = N.assign_channels(spark.createDataFrame(voices, "song int, pos int, voice string")).orderBy("pos").collect()
    assert [x.channel for x in got] == out


def test_pair_spans(spark):
    r = random.Random(8)
    rows, want = [], {}
    for t in range(60):
        stack, ts, own = [], 0, []
        for i in range(r.randint(1, 16)):
            ts += r.randint(0, 9)
            begin = r.random() < 0.5
            rows.append((t, i, ts, begin))
            if begin:
                if stack:
                    want[t, stack[-1]][3] = True
                want[t, i] = [None, len(stack) + 1, ts, False]
                stack.append(i)
                own.append(i)
            elif stack:
                j = stack.pop()
                want[t, j][0] = i
                want[t, j][2] = ts - want[t, j][2]
        for j in stack:
            want[t, j][2] = ts - want[t, j][2]
    log = spark.createDataFrame(rows, "thread int, seq int, ts int, begin boolean")
    got = P.pair_spans(log).collect()
    assert sorted(map(tuple, P.pair_spans(log.withColumn("part", F.expr("seq div 3")), "part").collect())) == sorted(map(tuple, got))
    assert {(x.thread, x.seq): (x.end_seq, x.depth, x.elapsed) for x in got} == {k: tuple(v[:3]) for k, v in want.items()}
    assert all(x.has_children == want[x.thread, x.seq][3] for x in got if x.end_seq != x.seq + 1 or x.has_children is False)


def test_parallel_tracks_move_together(spark):
    rows = [("s", t, i, i // 2 * 96 + 7, "On" if i % 2 == 0 else "Off", 60, 80) for t in ("guitarTop", "guitarBottom", "bass") for i in range(40)]
    events = spark.createDataFrame(rows, "song string, track string, seq long, midi_time long, kind string, pitch int, velocity int")
    grid = G.measure_grid(spark.createDataFrame([], "song string, time long, num long, den long"), events.groupBy("song").agg(F.max("midi_time").alias("last_time")))
    got = H.humanize(events, grid, humanized=["guitar"]).collect()
    time = {(x.track, x.seq): x.midi_time for x in got}
    assert all(time["guitarTop", i] == time["guitarBottom", i] for i in range(0, 40, 2)) and all(time["bass", i] == i // 2 * 96 + 7 for i in range(0, 40, 2))
    assert any(time["guitarTop", i] != time["bass", i] for i in range(0, 40, 2))
    plan = H.humanize(events, grid)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "SinglePartition" not in plan


def test_manual_values(spark):
    row = spark.range(1).select(
        L.pan_to_midi(F.lit("C")).alias("a"), L.pan_to_midi(F.lit("0.5L")).alias("b"), L.pan_to_midi(F.lit("1R")).alias("c"), L.parse_tempo(F.lit("90|6/8")).alias("d"), L.srt_format(F.lit(3723004)).alias("e"),
        L.parse_map(F.lit("{a: 1, b : 'x', a: 3}")).alias("f"), L.parse_dest(F.lit("e2/s/v")).alias("g"), L.array_find(F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2))).alias("h"),
        L.tokenize(F.lit("a 'b c' d\"e f\"")).alias("i"), L.wrap(F.lit(12.5), 0, 5).alias("j"), L.to_hex(F.lit("aé\n")).alias("k"),
    ).first()
    assert (row.a, row.b, row.c) == (64, 32, 128) and tuple(row.d) == (90.0, 3.0) and row.e == "01:02:03,004" and row.f == {"a": "3", "b": "x"}
    assert [tuple(x) for x in row.g] == [("extract", 2), ("score", 1), ("video", 1)] and row.h == 0 and row.i == ["a", "'b c'", 'd"e f"'] and row.j == 2.5 and row.k == "61E90A"


def test_nested_literals(spark):
    got = [r[0] for r in spark.createDataFrame([("{a: 1, b: [x, 'y, z', {c: true}], 'd e': -2.5}",), ("[1, [2, 3],, ]",), ("plain",), (None,), ("{bad: [1",)], "t string").select(F.to_json(parse_nested(F.col("t")))).collect()]
    assert got == ['{"a":1,"b":["x","y, z",{"c":true}],"d e":-2.5}', "[1,[2,3]]", '["plain"]', None, None]


def plain_literal(text):
    """The value of a literal, read with recursion; ValueError if it is not closed."""
    text = text.strip(" ")
    text = text if text[:1] in ("[", "{") else f"[{text}]"

    def scalar(x):
        if x.lower() in ("true", "wahr", "false", "falsch"):
            return x.lower() in ("true", "wahr")
        return int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x) if re.fullmatch(r"[+-]?\d+\.\d*", x) else x

    def bracket(i):
        close = {"[": "]", "{": "}", "(": ")"}[text[i]]
        in_map, items, table, key, want_key, before = close == "}", [], {}, None, True, True
        i += 1
        while True:
            if i >= len(text):
                raise ValueError
            ch = text[i]
            if ch == close:
                return i + 1, table if in_map else items
            if not before:
                if ch == ",":
                    before = want_key = True
                elif ch == ":" and in_map:
                    before, want_key = True, False
                i += 1
                continue
            if ch in " ,":
                i += 1
                continue
            if ch in "\"'":
                j = text.index(ch, i + 1)
                raw = value = text[i + 1 : j]
                i = j + 1
            elif ch in "[{(":
                if in_map and want_key:
                    raise ValueError
                i, value = bracket(i)
            else:
                j = i + 1
                while j < len(text) and text[j] not in (" ", ",", close, *([":"] if in_map else [])):
                    j += 1
                raw, value = text[i:j], scalar(text[i:j])
                i = j
            before = False
            if not in_map:
                items.append(value)
            elif want_key:
                key = raw
            else:
                table[key] = value

    return bracket(0)[1]


def test_nested_literals_against_recursion(spark):
    r = random.Random(17)
    parts = ["[", "]", "{", "}", "(", ")", ",", ":", " ", "'", '"', "a", "b: ", "007", "-2.50", "true", "é\U0001f600", "x y", "\\", "\n", "{k: [1, ", "]}", "k"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["[" * 700 + "{a: 1}" + "]" * 700]
    want = []
    for t in texts:
        try:
            want.append(json.dumps(plain_literal(t), sort_keys=True))
        except ValueError:
            want.append(None)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.v for x in df.select("i", F.to_json(parse_nested(F.col("t"))).alias("v")).collect()}
    assert [got[i] and json.dumps(json.loads(got[i]), sort_keys=True) for i in range(len(texts))] == want
    assert sum(w is not None for w in want) > 300
    deep = spark.createDataFrame([("[" * 5000 + "]" * 5000,), ("[" * 5000,)], "t string")
    assert [x[0] for x in deep.select(parse_nested(F.col("t")).isNull()).collect()] == [True, True]


def test_multi_tables_by_lines(spark):
    from cadenza.operators.text import multi_tables

    r = random.Random(9)
    lines, want = [], {}
    for f in range(25):
        n, table, head, open_ = 0, None, None, None
        for _ in range(30):
            n += 1
            line = open_ and r.choice(["more", 'end"']) or r.choice(["TABLE x", "a\tb", "1\t2", "# c", "", 'q\t"open', "solo"])
            lines.append((f, n, line))
            if open_:
                open_[1].append(line)
                if line.endswith('"'):
                    want[f, open_[0]], open_ = "\n".join(open_[1]), None
                continue
            if line.startswith("#") or not line:
                continue
            if line.startswith("TABLE"):
                table, head = line, None
            elif line.startswith("q\t"):
                open_ = (n, [line])
                if table and head is None:
                    head = "open"
                    open_ = None
                    lines.pop()
                    n -= 1
                    head = None
                elif not table:
                    open_ = None
                    lines.pop()
                    n -= 1
            elif table and head is None:
                head = line
            elif table:
                want[f, n] = line
        if open_:
            want[f, open_[0]] = "\n".join(open_[1])
    got = multi_tables(spark.createDataFrame(lines, "doc_id int, linenum int, line string")).collect()
    assert {(x.doc_id, x.linenum) for x in got} == set(want)
    for x in got:
        cells = [v.strip().strip('"') if v.strip().startswith('"') and v.strip().endswith('"') else v for v in want[x.doc_id, x.linenum].split("\t")]
        assert list(x.fields.values()) == cells[: len(x.fields)]


def test_all_variants_of_groups(spark):
    """Gray-code peaks against a mix of every subset; voices in two groups, voices of unequal length."""
    from cadenza.operators import mix as M

    r = random.Random(12)
    voices = {v: [r.randrange(-900, 900) for _ in range(r.randrange(3, 60))] for v in "abcde"}
    members = [("g1", "a"), ("g2", "b"), ("g2", "a"), ("g3", "c"), ("g4", "d"), ("g4", "e"), ("g9", "none")]
    rows = [(7, v, i // 20, i, 1, x[i : i + 20]) for v, x in voices.items() for i in range(0, len(x), 20)]
    pcm = spark.createDataFrame(rows, "song long, voice string, chunk long, frame0 long, n_channels int, samples array<long>")
    got = {x.variant: x.peak for x in M.variant_peaks(pcm, spark.createDataFrame(members, "group string, voice string")).collect()}
    names = ["g1", "g2", "g3", "g4"]
    for v in range(16):
        own = [voices[w] for g, w in members if g in names and v >> names.index(g) & 1]
        assert got[v] == max((abs(sum(x[i] for x in own if i < len(x))) for i in range(60)), default=0)
    assert len(got) == 16


def test_mix_streams_many_voices_of_one_chunk(spark, monkeypatch):
    """Sums that are passed on early and joined as a stream are the sums."""
    from cadenza.operators import mix as M

    monkeypatch.setattr(M, "HELD", 200)
    rows = [(s, f"v{i}", 0, 0, 1, [i, -i, 2] + [1] * (i % 3)) for i in range(40) for s in ("x", "y")]
    pcm = spark.createDataFrame(rows, "song string, voice string, chunk long, frame0 long, n_channels int, samples array<long>").repartition(6)
    got = M.mix(pcm, spark.createDataFrame([], "song string, voice string, volume double"), low_peak=10**9)
    assert sorted((x.song, list(x.samples)) for x in got.collect()) == [(s, [780, -780, 80, 26, 13]) for s in ("x", "y")]


def test_one_thread_in_many_ranges(spark):
    """A log of one thread, cut into eight ranges, deep and with ends that have no begin, against a stack."""
    r = random.Random(21)
    rows, stack, want, ts = [], [], {}, 0
    for i in range(800):
        ts += r.randint(0, 5)
        begin = r.random() < (0.7 if i % 200 < 100 else 0.25)
        rows.append((0, i, ts, begin, i // 100))
        if begin:
            stack.append(i)
            want[i] = (None, len(stack), ts)
        elif stack:
            j = stack.pop()
            want[j] = (i, want[j][1], ts - want[j][2])
    want = {i: w if w[0] is not None else (None, w[1], ts - w[2]) for i, w in want.items()}
    got = P.pair_spans(spark.createDataFrame(rows, "thread int, seq int, ts int, begin boolean, part int"), "part").collect()
    assert {x.seq: (x.end_seq, x.depth, x.elapsed) for x in got} == want


def test_levels_and_cycles(spark):
    """Levels of random graphs against a search; nodes on cycles and behind them have none."""
    from functools import cache

    from cadenza.operators.graph import levels

    r = random.Random(31)
    nodes, edges, want = [], [], {}
    for g in range(30):
        n = r.randint(1, 9)
        own = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 10))}
        own = own if g % 3 == 0 else {(min(e), max(e)) for e in own if e[0] != e[1]}
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b) for a, b in own]
        reach = {(a, b) for a, b in own}
        while len(more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) > len(reach):
            reach = more
        lost = {b for a, b in reach if (a, a) in reach} | {a for a, b in reach if a == b}

        @cache
        def level(b, own=tuple(own)):
            return max((1 + level(a) for a, c in own if c == b), default=0)

        want |= {(g, i): None if i in lost else level(i) for i in range(n)}
    nodes += [(99, i) for i in range(60)]
    edges += [(99, i, i + 1) for i in range(59)]
    want |= {(99, i): i for i in range(60)}
    got = levels(spark.createDataFrame(nodes, "g int, node int"), spark.createDataFrame(edges, "g int, a int, b int"), ["g"])
    assert {(x.g, x.node): x.level for x in got.collect()} == want


def test_chains_that_feed_each_other(spark):
    from cadenza.operators.chains import chain_plan

    voices = spark.createDataFrame([("a", "v", 0.0), ("b", "v", 0.0)], "voice string, variant string, reverb double")
    effects = spark.createDataFrame([("soundStyleAV", "y-> one ->x; x-> two tee three ->y; four"), ("soundStyleBV", "one ->x; two ->y; x-> y-> mix tee gain")], "style string, effects string")
    got = {(x.voice, x.chain, x.fragment): (x.level, list(x.problems)) for x in chain_plan(voices, effects).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", 0, 0): None, ("a", 1, 0): None, ("a", 1, 1): None, ("a", 2, 0): 0, ("b", 0, 0): 0, ("b", 1, 0): 0, ("b", 2, 0): 1, ("b", 2, 1): 2}
    assert all(("cycle" in p) == (lv is None) for lv, p in got.values()) and got["a", 0, 0][1] == ["cycle", "unknown source"]


def test_order_read_back(spark, tmp_path):
    """A hot key is cut by its inner key into several files, and an order that is not kept is seen."""
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as song", "(id * 7919) % 5000 as n").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        G.write_in_order(df, str(tmp_path / "o"), ["song"], ["n"])
        df.write.parquet(str(tmp_path / "any"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {(r.song, r.n): i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.song, r.n)), 1)}
    assert {(r.song, r.n): r.place for r in G.read_in_order(spark, str(tmp_path / "o")).collect()} == want
    got = G.read_in_order(spark, str(tmp_path / "any")).collect()
    assert sorted(r.place for r in got) == list(range(1, 5001)) and {(r.song, r.n): r.place for r in got} != want
    own = spark.read.parquet(str(tmp_path / "o")).filter("song = 'hot'").select("_metadata.file_name").distinct()
    assert own.count() > 1


def test_rules_from_a_table(spark):
    import pytest

    from cadenza.operators import quality as Q

    df = spark.createDataFrame([(1, "x", "5", "[a]"), (2, None, "-5.5", "{b}"), (3, "", "abc", None)], "id int, t string, n string, l string")
    rules = [Q.Rule("t", "present", "p"), Q.Rule("t", "string", "s"), Q.Rule("n", "integer", "i"), Q.Rule("n", "natural", "nat", "positive"), Q.Rule("n", "number_text", "num", ">=0"), Q.Rule("n", "bool_text", "b"), Q.Rule("l", "list", "l"), Q.Rule("l", "map", "m"), Q.Rule("t", "regex", "r", "^x"), Q.Rule("n", "member", "in", ("5", "abc")), Q.Rule("id", "integer_text", "id")]
    table = spark.createDataFrame([(r.column, r.kind, r.message, r.arg if isinstance(r.arg, str) else None, list(r.arg) if isinstance(r.arg, tuple) else None) for r in rules] + [("gone", "present", "x", None, None)], "column string, kind string, message string, arg string, members array<string>")
    show = lambda d: sorted(map(str, d.collect()))
    want = show(Q.validate(df, rules, "id"))
    assert show(Q.validate_by(df, table, "id")) == want and len(want) > 10
    kinds = {"t": "text", "n": "number", "l": "flag"}
    assert show(Q.complete_by(df, spark.createDataFrame(list(kinds.items()), "column string, kind string"), "id")) == show(Q.complete(df, kinds, "id"))
    assert Q.validate_by(df, table.limit(0), "id").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        Q.validate_by(df, table.withColumn("kind", F.lit("odd")), "id").collect()


def test_long_literals_in_time(spark):
    """A quoted text of a megabyte and 20,000 items are read in one pass; a fold over characters copies the text read so far at each of them."""
    import time

    long = "{a: '" + "x, [y] " * 150_000 + "', b: [" + ", ".join(f"'n{i}'" for i in range(20_000)) + "]}"
    df = spark.createDataFrame([(long,)] * 4, "t string").select(parse_nested(F.col("t")).alias("v"))
    start = time.time()
    got = df.select(F.length(F.try_variant_get("v", "$.a", "string")), F.try_variant_get("v", "$.b[19999]", "string")).collect()
    assert [tuple(r) for r in got] == [(1_050_000, "n19999")] * 4 and time.time() - start < 60


def test_samples_are_taken_in_pieces():
    """A batch of any size is worked on by slices of a bounded size; scaling once made five copies of a whole batch."""
    import pyarrow as pa

    from cadenza.operators import mix as M

    size = [4096] * 300 + [0, 3 * M.PIECE // 8, 5]
    batch = pa.RecordBatch.from_pydict({"samples": pa.array([[i] * n for i, n in enumerate(size)], pa.list_(pa.int32()))})
    for own, want in ((batch, size), (batch.slice(7, 290), size[7:297]), (batch.slice(0, 0), [])):
        got = [M._lists(p.column("samples")) for p in M._pieces([own])]
        assert [len(x) for p in got for x in p] == want
        assert all(len(p) == 1 or sum(x.nbytes for x in p) <= M.PIECE for p in got)
    assert len(list(M._pieces([batch]))) > 2 and M._lists(batch.slice(9, 1).column("samples"))[0].tolist() == [9] * 4096


def test_a_note_varied_to_silence_still_starts(spark):
    """An end that the next start of its pitch passes moves before it, also if that note's velocity becomes 0."""
    rows = [("s", "drums", 1, 0, "On", 36, 100), ("s", "drums", 2, 300, "Off", 36, 0), ("s", "drums", 3, 40, "On", 36, 1), ("s", "drums", 4, 200, "Off", 36, 0)]
    notes = spark.createDataFrame(rows, "song string, track string, seq long, midi_time long, kind string, pitch int, velocity long")
    none = spark.createDataFrame([], "song string, time long, num long, den long")
    grid = G.measure_grid(none, notes.groupBy("song").agg(F.max("midi_time").alias("last_time")), 96, 0)
    got = {r.seq: r for r in H.humanize(notes, grid).collect()}
    assert got[3].velocity == 0 and 40 <= got[3].midi_time <= 43
    assert got[2].midi_time == got[3].midi_time - 1 and got[4].midi_time == 200


def test_bad_tracks_are_replaced_in_one_pass(spark):
    """A second read for the ends alone had few bytes and many rows, so a few tasks sorted them all."""
    rows = [("s", 1, t, q) for q, t in enumerate(["a", "a", "new:1", None, "new:1", "a"])] + [("s", 2, t, q) for q, t in enumerate([None, "b", "b"])] + [(None, 3, "c", q) for q in range(4)]
    events = spark.createDataFrame(rows, "song string, track_no int, track string, seq int").withColumns({"midi_time": F.col("seq") * 10, "kind": F.lit("On"), "meta": F.lit(None).cast("string"), "p1": F.lit(1)})
    got = N.replace_bad_tracks(events)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    end = lambda *k: (*k, 0, 0, "Meta", "TrkEnd", None)
    kept = [(s, n, t, q, q * 10, "On", None, 1) for s, n, t, q in rows if n != 2 and t != "new:1"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*kept, end("s", 1, "new:1"), end("s", 2, None), end("s", 2, "b")], key=str)


def test_humanize_sorts_three_times_in_as_many_tasks_as_asked(spark):
    rows = [(i % 7, "drums", i, i * 5, "On" if i % 2 == 0 else "Off", 36 + i % 3, 1 + i % 90) for i in range(400)]
    notes = spark.createDataFrame(rows, "song long, track string, seq long, midi_time long, kind string, pitch int, velocity long")
    grid = spark.createDataFrame([(s, m, 384 * m, 384 * (m + 1)) for s in range(7) for m in range(7)], "song long, measure long, t_start long, t_end long")
    got = H.humanize(notes, grid, tasks=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 3 and plan.count("Exchange ") == 1
    assert got.rdd.getNumPartitions() == 9 and sorted(got.collect()) == sorted(H.humanize(notes, grid).collect())


def test_varying_by_one_order(spark):
    """Against ``varying_measures``, with times of several events, soft and missing velocities."""
    draw = random.Random(5)
    rows = [("s", "t", i, draw.randrange(3), draw.choice([None, *range(8)]), draw.choice(["On", "Off", "On", None]), draw.choice([None, *range(4)])) for i in range(300)] + [("s", "u", i, 1, i, "On", 5 + i % 2) for i in range(3)]
    notes = spark.createDataFrame(rows, "song string, track string, seq long, measure int, midi_time long, kind string, velocity int")
    want = {(r.track, r.measure): r.varying for r in N.varying_measures(notes.filter("kind = 'On'").groupBy("song", "track", "measure", "midi_time").agg(F.max("velocity").alias("peak"))).collect()}
    got = N.mark_varying(notes)
    assert got.count() == len(rows) and len(re.findall(r"\bSort \[", got._jdf.queryExecution().executedPlan().toString())) == 1
    assert {(r.track, r.measure): r.varying for r in got.select("track", "measure", "varying").distinct().collect()} == want and len(want) == 4


def test_tasks_of_a_mix_follow_the_samples(spark, monkeypatch):
    """With a fixed number of partitions a worker's batches grew with the input, up to the largest that Spark sends."""
    from cadenza.operators import mix as M
    from cadenza.plans import mix_queries as Q

    sf = "/root/testdata/sf0.001"
    plain = M.mix(Q.chunks(spark, sf), Q.volumes(spark, sf))
    monkeypatch.setattr(Q, "ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    pcm = Q.chunks(spark, sf)
    got = M.mix(pcm, Q.volumes(spark, sf), tasks=n)
    assert n > 10 and pcm.rdd.getNumPartitions() == n and got.rdd.getNumPartitions() == n
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))

"""Scalar functions as Spark columns: ranges, text, settings values, music and sample arithmetic."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x


# ranges


def clip(x: Column, lo, hi) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def wrap(x: Column, lo: float, hi: float) -> Column:
    """Shift ``x`` by multiples of the interval into [lo, hi]; an empty interval gives ``lo``."""
    size = hi - lo
    if size < 1e-4:
        return F.lit(lo)
    return F.when(x < lo, lo + F.pmod(x - lo, F.lit(size))).when(x > hi, hi - F.pmod(hi - x, F.lit(size))).otherwise(x)


def in_range(x: Column, lo, hi) -> Column:
    """Both ends inclusive."""
    return x.between(lo, hi)


def iif(*args) -> Column:
    """``iif(c1, v1, c2, v2, ..., otherwise)``."""
    out = F.when(args[0], args[1])
    for i in range(2, len(args) - 1, 2):
        out = out.when(args[i], args[i + 1])
    return out.otherwise(args[-1])


# text


def split_trim(x: Column, sep: str) -> Column:
    return F.transform(F.split(x, re.escape(sep)), lambda s: F.trim(s))


def split_once(x: Column, sep: str) -> Column:
    """Struct (head, tail, found) at the first separator."""
    at = F.instr(x, sep)
    return F.struct(
        F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x).alias("head"),
        F.when(at > 0, F.substring(x, at + len(sep), F.char_length(x))).otherwise(F.lit("")).alias("tail"),
        (at > 0).alias("found"),
    )


def strip_quotes(x: Column) -> Column:
    """Remove one layer of single, then of double quotes."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)^'(.*)'$", "$1"), r'(?s)^"(.*)"$', "$1")


def shorten(x: Column, n: int) -> Column:
    """At most ``n`` characters; a longer text ends in an ellipsis."""
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def one_line(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("#"))


def to_hex(x: Column) -> Column:
    """Two hexadecimal digits (or more) per character."""
    digits = lambda c: F.hex(F.ascii(c))
    return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.when(F.char_length(digits(c)) < 2, F.concat(F.lit("0"), digits(c))).otherwise(digits(c))), "")


def tokenize(x: Column) -> Column:
    """Split at blanks outside of quotes."""
    return F.regexp_extract_all(x, F.lit(r"""((?:[^ '"]|'[^']*'|"[^"]*")+)"""), F.lit(1))


#: Suffixes of the staves of a split voice, innermost last, and of a variant of a voice.
STAVES = ("Bottom", "Middle", "Top")
VARIANTS = ("Simple", "Extended")


def canonical_track(x: Column) -> Column:
    """A track name without the suffixes of split staves, wherever a name that ends in one has it."""
    return F.aggregate(F.array(*map(F.lit, STAVES)), x, lambda name, s: F.when(F.endswith(name, s), F.replace(name, s, F.lit(""))).otherwise(name))


def voice_label(x: Column) -> Column:
    return F.regexp_replace(x, f"(?:{'|'.join(VARIANTS)})$", "")


def base_track(x: Column) -> Column:
    """A track name without letter suffix, staff suffix and what follows a colon."""
    name = F.regexp_replace(F.substring_index(x, ":", 1), "[A-G]$", "")
    return F.regexp_replace(name, "".join(f"(?:{s})?" for s in (VARIANTS[1], *STAVES)) + "$", "")


# settings values


def infer_scalar(x: Column) -> Column:
    """Struct (kind, as_bool, as_long, as_double, as_text) by the spelling of a value."""
    yes, no = F.upper(x).isin("TRUE", "WAHR"), F.upper(x).isin("FALSE", "FALSCH")
    whole, hexa, real = x.rlike(r"^[+-]?\d+$"), x.rlike("^0[xX][0-9A-Fa-f]+$"), x.rlike(r"^[+-]?\d+\.\d*$")
    kind = iif(yes | no, F.lit("bool"), whole | hexa, F.lit("long"), real, F.lit("double"), F.lit("text"))
    return F.struct(
        F.when(x.isNotNull(), kind).alias("kind"), F.when(yes, True).when(no, False).alias("as_bool"),
        F.when(whole, x.try_cast("long")).when(hexa, F.conv(F.substring(x, 3, 40), 16, 10).try_cast("long")).alias("as_long"),
        F.when(real, F.regexp_replace(x, r"\.$", ".0").try_cast("double")).alias("as_double"),
        F.when(~(yes | no | whole | hexa | real), x).alias("as_text"),
    )


def parse_list(x: Column, sep: str = ",") -> Column:
    """Items of a flat list with or without brackets; empty items are dropped, quotes removed."""
    inner = F.regexp_replace(F.trim(x), r"(?s)^[\[(](.*)[\])]$", "$1")
    return F.filter(F.transform(split_trim(inner, sep), strip_quotes), lambda s: s != "")


def parse_map(x: Column, sep: str = ",") -> Column:
    """Map of a flat literal ``{k: v, ...}``; of equal keys the last wins."""
    inner = F.regexp_replace(F.trim(x), r"(?s)^\{(.*)\}$", "$1")
    pairs = F.filter(split_trim(inner, sep), lambda s: s.contains(":"))
    entries = F.transform(pairs, lambda s: F.struct(strip_quotes(F.trim(F.substring_index(s, ":", 1))).alias("k"), strip_quotes(F.trim(F.substring(s, F.instr(s, ":") + 1, F.char_length(s)))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o.k == e.k))
    return F.map_from_entries(last)


def parse_tempo(x: Column) -> Column:
    """Struct (tempo, quarters) of ``tempo`` or ``tempo|n/d``."""
    sig = F.when(x.contains("|"), F.substring_index(x, "|", -1)).otherwise(F.lit("4/4"))
    n, d = F.substring_index(sig, "/", 1).cast("double"), F.substring_index(sig, "/", -1).cast("double")
    return F.struct(F.substring_index(x, "|", 1).cast("double").alias("tempo"), F.bround(n * 4 / d, 5).alias("quarters"))


def pan_to_midi(x: Column) -> Column:
    off = (F.expr("try_cast(1 as double)") * F.substring(x, F.lit(1), F.char_length(x) - 1).try_cast("double") * 63).cast("int")
    return F.when(x == "C", 64).when(x.endswith("L"), 63 - off).otherwise(65 + off)


def pan_to_real(x: Column) -> Column:
    v = F.substring(x, F.lit(1), F.char_length(x) - 1).try_cast("double")
    return F.when(x == "C", 0.0).when(x.endswith("L"), -v).otherwise(v)


def split_instrument(x: Column) -> Column:
    """Struct (bank, program, msb, lsb) of ``bank:program`` or ``program``."""
    bank = F.when(x.contains(":"), F.substring_index(x, ":", 1).cast("int")).otherwise(0)
    return F.struct(bank.alias("bank"), F.substring_index(x, ":", -1).cast("int").alias("program"), F.floor(bank / 128).cast("int").alias("msb"), (bank % 128).alias("lsb"))


#: Letters of the phases.
PHASES = {"e": "extract", "m": "midi", "s": "score", "v": "video"}


def parse_dest(x: Column) -> Column:
    """Array of (phase, lines) of ``e2/s2/v``; the number of lines is 1 if absent, unknown letters are dropped."""
    name = F.create_map(*(F.lit(v) for kv in PHASES.items() for v in kv))
    parts = F.filter(split_trim(x, "/"), lambda s: F.substring(s, 1, 1).isin(*PHASES))
    return F.transform(parts, lambda s: F.struct(F.element_at(name, F.substring(s, 1, 1)).alias("phase"), F.coalesce(F.substring(s, 2, 9).try_cast("int"), F.lit(1)).alias("lines")))


def parse_mix(x: Column) -> Column:
    """Struct (volume, pan) of ``v`` or ``v/pan``."""
    pan = F.when(x.contains("/"), pan_to_real(F.substring_index(x, "/", -1)))
    return F.struct(F.substring_index(x, "/", 1).try_cast("double").alias("volume"), pan.alias("pan"))


def zip_lists(n: Column, lists: dict[str, Column], defaults: dict[str, str]) -> Column:
    """Array of structs from parallel comma lists: an empty list repeats its default, a single value repeats itself."""
    arrays = []
    for name, x in lists.items():
        items = parse_list(x)
        items = F.when(F.size(items) == 0, F.array_repeat(F.lit(defaults[name]), n)).when(F.size(items) == 1, F.array_repeat(F.get(items, F.lit(0)), n)).otherwise(items)
        arrays.append(items.alias(name))
    zipped = F.arrays_zip(*arrays)
    return F.transform(zipped, lambda z: F.struct(*(z.getField(name).alias(name) for name in lists)))


def map_by_prefix(m: Column, prefix: str) -> Column:
    return F.map_filter(m, lambda k, v: k.startswith(prefix))


def map_by_keys(m: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def make_map(keys: Column, values: Column) -> Column:
    n = F.least(F.size(keys), F.size(values))
    return F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))


# time and music


def srt_format(ms: Column) -> Column:
    """``HH:MM:SS,mmm`` of milliseconds."""
    part = lambda unit, size: F.floor(ms / unit) % size if size else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3600000, None), part(60000, 60), part(1000, 60), ms % 1000)


def srt_parse(x: Column) -> Column:
    g = lambda i: F.regexp_extract(x, r"^(\d+):(\d+):(\d+),(\d+)$", i).try_cast("long")
    return g(1) * 3600000 + g(2) * 60000 + g(3) * 1000 + g(4)


def measure_seconds(tempo: Column, quarters: Column) -> Column:
    """Length of a measure; null (endless) for a tempo of 1 or less."""
    return F.when(tempo > 1, 60 * quarters / tempo)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def signed_divmod(a: Column, b: Column) -> Column:
    """Struct (q, r) of a division that truncates toward zero."""
    q = F.signum(a) * F.signum(b) * F.floor(F.abs(a) / F.abs(b))
    return F.struct(q.cast("long").alias("q"), (a - q.cast("long") * b).alias("r"))


def noise(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the key, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def variation(u: Column) -> Column:
    """Noise in [0, 1) to [-1, 1), favouring small values."""
    x = 2 * u - 1
    return F.signum(x) * x * x


# samples and arrays


def db_to_gain(v: Column) -> Column:
    return F.pow(F.lit(10.0), v / 20)


def fixed_point(x: Column) -> Column:
    """Numerator over 1024."""
    return F.bround(x * 1024).cast("long")


def balance(pan: Column) -> Column:
    """Struct of factors (ll, rl, lr, rr) for a pan in [-1, 1]."""
    return F.struct(F.when(pan < 0, 1.0).otherwise(1 - pan).alias("ll"), F.lit(0.0).alias("rl"), F.lit(0.0).alias("lr"), F.when(pan > 0, 1.0).otherwise(1 + pan).alias("rr"))


def array_find(a: Column, part: Column) -> Column:
    """First position (from 0) of ``part`` in ``a``, or -1."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - F.size(part), F.lit(0))), lambda i: F.slice(a, i + 1, F.size(part)) == part)
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def array_slice(a: Column, first: int, last: int | None = None) -> Column:
    """``a[first:last]`` with negative bounds counted from the end."""
    n = F.size(a)
    lo = F.lit(first) if first >= 0 else F.greatest(n + first, F.lit(0))
    hi = n if last is None else F.least(F.lit(last), n) if last >= 0 else n + last
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def array_prepend_all(a: Column, head: Column) -> Column:
    return F.concat(head, a)


def bits_le(x: Column, n: int) -> Column:
    """The ``n`` lowest bits, least significant first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(x, i).cast("int"))

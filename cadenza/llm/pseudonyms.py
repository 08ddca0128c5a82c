"""Format-preserving pseudonyms for personal numbers, dates, addresses and keys.

Candidates are found by patterns and kept only if they validate (Luhn digits,
calendar dates, octets, numbering-plan digits, IBAN remainders). A value is turned
into an index of all values of its format, the index is permuted by a keyed Feistel
network over that many values (cycle walking where the halves' product is larger),
and the new index is written in the same format: digits stay digits, separators
stay, check digits are valid again, a day or month of one digit stays one. The permutation depends on key, kind and
format alone, so equal values get equal pseudonyms in all documents, different values of a kind
never collide, and the key's owner can invert it (``back=True``). Strings longer than
``CHUNK`` characters are permuted chunk by chunk, each chunk's key depending on the chunks beside it.

Rows are independent: no shuffle, and the memory of a task is a batch slice.

Defined results: null text stays null with no values; text without such values is
unchanged to the byte; touching candidates are taken from left to right, the
longest kind first; a candidate that fails is tried at its shorter ends, then as
the other kinds, and the search goes on behind its first character; a card in
usual groups goes before any other card that it meets; digits after a value that
validate together with it belong to it; repeated rows give equal rows; other
columns are kept by ``pseudonymize`` under their names; an empty table gives an
empty table. The inverse is exact by the recorded spans; without them it
searches, and may read digits beside a value as part of it.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

ROUNDS = 10
#: Characters that one Feistel network permutes.
CHUNK = 128
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    need = (size.bit_length() + 7) // 8 + 8
    out, n, own = b"", 0, half.to_bytes((half.bit_length() + 7) // 8, "big")
    while len(out) < need:
        out += hmac.new(key, b"%s|%d|%d|%s" % (tweak, i, n, own), hashlib.sha256).digest()
        n += 1
    return int.from_bytes(out[:need], "big") % size


def permute(index: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Keyed permutation of [0, size): a Feistel network on Z_a x Z_b with a b >= size, walked until inside."""
    if size < 2:
        return index
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(index, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
        index = left * b + right
        if index < size:
            return index


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {x: c for c in _CLASSES for x in c}
_HEX = {x: c for c in ("0123456789", "abcdef") for x in c}


def _chunk(text: str, key: bytes, tweak: bytes, back: bool, alphabet: dict) -> str:
    of = [alphabet.get(x) for x in text]
    index, size = 0, 1
    for x, c in zip(text, of, strict=True):
        if c:
            index, size = index * len(c) + c.index(x), size * len(c)
    index = permute(index, size, key, tweak + "".join("-" if c is None else c[0] for c in of).encode(), back)
    out = []
    for x, c in zip(reversed(text), reversed(of), strict=True):
        if c:
            index, d = divmod(index, len(c))
            x = c[d]
        out.append(x)
    return "".join(reversed(out))


def _mixed(text: str, key: bytes, tweak: bytes, back: bool, alphabet: dict = _CLASS) -> str:
    """Permute a string within its pattern of character classes; other characters stay.

    A long one is permuted chunk by chunk, from the left with the new chunk before as part of the
    tweak and then from the right with the new chunk behind; the inverse runs the other way.
    """
    if len(text) <= CHUNK:
        return _chunk(text, key, tweak, back, alphabet)
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    sides = (("left", -1), ("right", 1))
    for side, step in reversed(sides) if back else sides:
        order = range(len(parts)) if (step < 0) != back else range(len(parts) - 1, -1, -1)
        for i in order:
            beside = parts[i + step] if 0 <= i + step < len(parts) else ""
            own = hashlib.sha256(f"{side}|{i}|{len(text)}|{beside}".encode()).digest()
            parts[i] = _chunk(parts[i], key, tweak + own, back, alphabet)
    return "".join(parts)


def _fill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(s, key, back):
    d = re.sub(r"\D", "", s)
    if not (13 <= len(d) <= 19 and luhn(d)):
        return None
    # the issuer's first digit stays; the last is the check digit
    body = d[0] + str(permute(int(d[1:-1]), 10 ** (len(d) - 2), key, b"card%d%s" % (len(d), d[:1].encode()), back)).zfill(len(d) - 2)
    return _fill(s, body + next(c for c in "0123456789" if luhn(body + c)))


def _iban(s, key, back):
    d = s.replace(" ", "")
    value = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(d) <= 34 or value(d[4:] + d[:4]) % 97 != 1:
        return None
    body = _mixed(d[4:], key, b"iban" + d[:2].encode(), back)
    new = iter(d[:2] + f"{98 - value(body + d[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _ip(s, key, back):
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(s, key, back):
    a, b, c = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    area = a - 1 - (a > 666)
    n = permute((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, b"ssn", back)
    area, c = divmod(n, 9999)
    area, b = divmod(area, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


#: Most digits of a national number by country code; 12 for others.
_NATIONAL = {c: n for n, codes in {8: "45 53 65", 9: "27 32 33 34 36 40 48 51 56 61 66 94", 10: "20 30 44 57 58 63 81 90 91 98", 11: "49 54 55 86"}.items() for c in codes.split()}


def _phone(s, key, back):
    d = re.sub(r"\D", "", s)
    nanp = s[0] != "+" or s.startswith("+1")
    lead = (1 if len(d) == 11 and d[0] == "1" else 0) if nanp else 2
    own = d[lead:]
    if nanp:
        if len(own) != 10 or own[0] in "01" or own[3] in "01":
            return None
        n = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10000 + int(own[6:])
        n = permute(n, 800 * 800 * 10000, key, b"phone", back)
        n, line = divmod(n, 10000)
        new = f"{n // 800 + 200:03d}{n % 800 + 200:03d}{line:04d}"
    else:
        # a trunk zero in front is no digit of the national number
        if not 6 <= len(own) <= _NATIONAL.get(d[:2], 12) + (own[0] == "0"):
            return None
        new = str(permute(int(own), 10 ** len(own), key, b"phone+%s%d" % (d[:2].encode(), len(own)), back)).zfill(len(own))
    return _fill(s, d[:lead] + new)


@functools.cache
def _days(short_day: bool, short_month: bool, least: int) -> list[int]:
    """Ordinals of the dates whose day is at least ``least``, with a day or month of one digit where it is written so."""
    days = (datetime.date.fromordinal(n) for n in range(_FIRST, _LAST + 1))
    return [d.toordinal() for d in days if d.day >= least and (d.day < 10 or not short_day) and (d.month < 10 or not short_month)]


def _date(s, key, back):
    a, b, c = re.split(r"[-./]", s)
    slash = "/" in s and len(a) < 3
    orders = [(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)] if slash else [(c, b, a)]
    for i, ymd in enumerate(orders):
        try:
            day = datetime.date(*map(int, ymd)).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        year, month, own = ymd
        if slash and int(a) <= 12 and int(b) <= 12:
            # either reading: both parts run over 1 to 12, or to 9 if of one digit
            na, nb = (9 if len(x) == 1 else 12 for x in (a, b))
            n = permute(((int(year) - 1900) * na + int(a) - 1) * nb + int(b) - 1, 200 * na * nb, key, b"date/%d/%d" % (na, nb), back)
            return f"{n // nb % na + 1:0{len(a)}d}/{n % nb + 1:0{len(b)}d}/{n // (na * nb) + 1900:04d}"
        # of a slash date only the days above 12 have this one reading
        days = _days(len(own) == 1, len(month) == 1, 13 if slash else 1)
        at = bisect.bisect_left(days, day)
        new = datetime.date.fromordinal(days[permute(at, len(days), key, b"date%d" % len(days), back)])
        y, m, d = f"{new.year:04d}", f"{new.month:0{len(month)}d}", f"{new.day:0{len(own)}d}"
        sep = re.search(r"\D", s)[0]
        return sep.join((y, m, d) if len(a) == 4 else (m, d, y) if i else (d, m, y))
    return None


def _email(s, key, back):
    local, _, domain = s.partition("@")
    return _mixed(local, key, b"email" + domain.lower().encode(), back) + "@" + domain


def _named(s, key, back):
    m = re.search(r"[A-Za-z0-9+/_.-]+(?=[\"']?$)", s)
    return s[: m.start()] + _hex_or_mixed(m[0], key, back) + s[m.end() :]


def _hex_or_mixed(v, key, back):
    """Hexadecimal strings stay hexadecimal, and others never become so: their permutation is walked until it is out of the hexadecimal ones."""
    if all(x in _HEX for x in v):
        return _mixed(v, key, b"hex", back, _HEX)
    while True:
        v = _mixed(v, key, b"secret", back)
        if not all(x in _HEX for x in v):
            return v


def _access(s, key, back):
    return s[:4] + _mixed(s[4:], key, b"access", back)


_KINDS = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}", _email),
    "secret": (r"(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_.-]{8,}[\"']?", _named),
    "access": (r"AKIA[0-9A-Z]{16}", _access),
    "iban": (r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _iban),
    "date": (r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{2}/\d{2}", _date),
    "ip": (r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip),
    "ssn": (r"\d{3}-\d{2}-\d{4}", _ssn),
    "phone": (r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|\+[2-9]\d(?:[ .-]?\(?\d{1,4}\)?){2,5}", _phone),
    "card": (r"\d(?:[ -]?\d){12,18}", _card),
}
_ONE = {k: re.compile(f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])") for k, (p, _) in _KINDS.items()}
#: All kinds but addresses, which are found from their at sign (``_emails``).
_ANY = re.compile("|".join(f"(?P<{k}>(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_]))" for k, (p, _) in _KINDS.items() if k != "email"))
_ORDER = list(_KINDS)
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![A-Za-z0-9_])")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_USUAL = re.compile(r"\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}")


def _ends(text: str, kind: str, start: int, end: int):
    """Ends of a kind's candidates at ``start``, the longest first: those before a character that is no part of a word."""
    yield end
    for e in range(end - 1, start, -1):
        if not (text[e].isascii() and (text[e].isalnum() or text[e] == "_")) and _ONE[kind].fullmatch(text, start, e):
            yield e


def _cards(text: str, start: int, end: int, key: bytes, back: bool) -> list[tuple[int, str]]:
    """(end, pseudonym) of the valid cards at ``start``, those in usual groups first."""
    found = [(e, new) for e in _ends(text, "card", start, end) if (new := _card(text[start:e], key, back)) is not None]
    return sorted(found, key=lambda f: _USUAL.fullmatch(text, start, f[0]) is None)


def _valid(text: str, kind: str, start: int, end: int, key: bytes, back: bool) -> tuple[int, str] | None:
    """(end, pseudonym) of the value of a kind at ``start`` whose longest candidate ends at ``end``."""
    if kind != "card":
        return next(((e, new) for e in _ends(text, kind, start, end) if (new := _KINDS[kind][1](text[start:e], key, back)) is not None), None)
    best = next(iter(_cards(text, start, end, key, back)), None)
    if best and not _USUAL.fullmatch(text, start, best[0]):
        # numbers in front of a card in usual groups are not its digits
        for at in range(start + 1, best[0]):
            if m := _ONE["card"].match(text, at):
                other = next(iter(_cards(text, at, m.end(), key, back)), None)
                if other and _USUAL.fullmatch(text, at, other[0]):
                    return None
    return best


def _emails(text: str):
    """(start, end) of the addresses of a text: a domain, and before its at sign what may be a local part, from a letter or digit on."""
    turned, free = None, 0
    for m in _DOMAIN.finditer(text):
        turned = text[::-1] if turned is None else turned
        at = m.start()
        start = max(free, at - (_LOCAL.match(turned, len(text) - at).end() - (len(text) - at)))
        while start < at and not text[start].isalnum():
            start += 1
        if start < at:
            yield start, m.end()
            free = m.end()


def _find(text: str, key: bytes, back: bool):
    """(kind, start, end, pseudonym) of the values of a text, from left to right."""
    at, emails = 0, _emails(text) if "@" in text else iter(())
    mail = next(emails, None)
    while True:
        m = _ANY.search(text, at)
        while mail and mail[0] < at:
            mail = next(emails, None)
        if mail and (m is None or mail[0] <= m.start()):
            at = mail[1]
            yield "email", *mail, _email(text[mail[0] : at], key, back)
            continue
        if m is None:
            return
        start = m.start()
        at = start + 1
        for kind in _ORDER[_ORDER.index(m.lastgroup) :]:
            one = m if kind == m.lastgroup else _ONE[kind].match(text, start)
            if one and (got := _valid(text, kind, start, one.end(), key, back)):
                at = got[0]
                yield kind, start, *got
                break


def _recorded(text: str, key: bytes, spans):
    """(kind, start, end, value) in a text with pseudonyms, of the spans (kind, start, end, pseudonym) of the original."""
    shift = 0
    for kind, start, end, new in spans:
        at = start + shift
        shift += len(new) - (end - start)
        old = _KINDS[kind][1](new, key, True)
        if text[at : at + len(new)] != new or old is None:
            raise ValueError(f"the text does not hold the recorded {kind} at {at}")
        yield kind, at, at + len(new), old


def replace(text: str, key: bytes, back: bool = False, recorded=None) -> tuple[str, list[tuple[str, int, int, str]]]:
    """(new text, [(kind, start, end, pseudonym)]) of a text; ``back`` inverts, at the spans of ``recorded`` if given."""
    out, spans, at = [], [], 0
    for kind, start, end, new in _find(text, key, back) if recorded is None else _recorded(text, key, recorded):
        out += [text[at:start], new]
        spans.append((kind, start, end, new))
        at = end
    return ("".join(out) + text[at:] if out else text), spans


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False, spans_col: str = "pii") -> DataFrame:
    """``docs`` with the text replaced, and an array of (kind, start, end, value) of what was; it replaces a column of its name.

    ``back`` inverts exactly if ``docs`` still has that array, else by a search.
    """
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
    known = back and spans_col in docs.columns and docs.schema[spans_col].dataType == T.ArrayType(entry)
    docs = docs.select(*(c for c in docs.columns if c != spans_col), *([spans_col] if known else []))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for whole in batches:
            for batch in sliced(whole, whole.schema.names[at]):
                text, spans = [], []
                recorded = [r and [tuple(x.values()) for x in r] for r in batch.column(spans_col).to_pylist()] if known else [None] * batch.num_rows
                for t, r in zip(batch.column(at).to_pylist(), recorded, strict=True):
                    new, found = (None, []) if t is None else replace(t, key, back, r)
                    text.append(new)
                    spans.append([dict(zip(("kind", "start", "end", "value"), f, strict=True)) for f in found])
                columns = list(batch.columns)[: -1 if known else None]
                columns[at] = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[f.name for f in schema])

    schema = T.StructType([*docs.drop(spans_col).schema.fields, T.StructField(spans_col, T.ArrayType(entry))])
    return docs.mapInArrow(run, schema)


def query(spark, sf_dir, key: bytes = b"demonstration key, replaced in production"):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymize(docs, key)
    return out.select("doc_id", F.size("pii").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x.kind))), ",").alias("kinds"), "text")

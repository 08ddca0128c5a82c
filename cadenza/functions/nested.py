"""Nested list and map literals as VARIANT columns.

A literal is read once from left to right by a small helper that works on Arrow batches: it keeps
the open brackets in a list, innermost last, each with the JSON texts of its items so far, and
leaps over quoted texts and bare elements. A closed bracket becomes one item of the one around
it, so there is no recursion, and the time grows with the length of a literal and not with its depth.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOSE = {"[": "]", "{": "}", "(": ")"}
_FLAGS = {"true": "true", "wahr": "true", "false": "false", "falsch": "false"}
_NUMBER = re.compile(r"([+-]?)0*([0-9]+)(\.[0-9]*)?").fullmatch


def _quoted(x: str) -> str:
    """A text as JSON."""
    return json.dumps(x, ensure_ascii=False)


def _scalar(x: str) -> str:
    """A bare element as JSON: a flag, a number in its plain form, or a text."""
    if flag := _FLAGS.get(x.lower()):
        return flag
    if not (found := _NUMBER(x)):
        return _quoted(x)
    sign, whole, part = found.groups()
    return sign.replace("+", "") + whole + ("" if part is None else (part.rstrip("0") if len(part.rstrip("0")) > 1 else ".0"))


class _Frame:
    """An open bracket: what closes it, whether the next element is a map's key, its last key and its items."""

    def __init__(self, opened: str):
        self.close, self.map = _CLOSE[opened], opened == "{"
        self.at_key, self.key, self.items = self.map, "", {} if self.map else []

    def put(self, text: str, raw: str = "") -> None:
        """One more item; where a map has a key the element is that key. Of equal keys the last counts."""
        if self.at_key:
            self.key = raw
        elif self.map:
            self.items.pop(self.key, None)
            self.items[self.key] = text
        else:
            self.items.append(text)

    def closed(self) -> str:
        return "{" + ",".join([f"{_quoted(k)}:{v}" for k, v in self.items.items()]) + "}" if self.map else "[" + ",".join(self.items) + "]"


def _reader(sep: str):
    """A function from a literal to its JSON, or None."""
    own = sep if len(sep) == 1 else ""
    one_of = lambda chars: re.compile("[" + re.escape(chars) + "]").search
    ends = {c: one_of(" " + own + c + ":" * (c == "}")) for c in _CLOSE.values()}
    turns = {c: one_of(own + c + ":" * (c == "}")) for c in _CLOSE.values()}

    def read(text: str) -> str | None:
        text = text.strip(" ")
        text = text if text[:1] in ("[", "{") else f"[{text}]"
        stack, top, i, n = [], _Frame(text[0]), 1, len(text)
        while i < n:
            ch, done = text[i], None
            if ch == top.close:
                done = i
            elif ch in _CLOSE:
                if top.at_key:  # a bracket in the place of a key has no meaning
                    return None
                stack.append(top)
                top, i = _Frame(ch), i + 1
                continue
            elif ch in "\"'":
                end = text.find(ch, i + 1)
                if end < 0:
                    return None
                top.put(_quoted(text[i + 1 : end]), text[i + 1 : end])
                i = end
            elif ch == " " or ch == own:
                i += 1
                continue
            else:
                if not (end := ends[top.close](text, i + 1)):
                    return None
                top.put(_scalar(text[i : end.start()]), text[i : end.start()])
                i = end.start()
            # behind an element: up to a separator, a colon of a map or the end of the bracket
            while True:
                if done is None:
                    if not (found := turns[top.close](text, i)):
                        return None
                    done = found.start()
                i, ch = done + 1, text[done]
                if ch != top.close:
                    top.at_key = top.map and ch == own
                    break
                whole = top.closed()
                if not stack:
                    return whole
                top, done = stack.pop(), None
                top.put(whole)
        return None

    return read


def to_json_text(text: Column, sep: str = ",") -> Column:
    """The JSON of a literal; null if a bracket or quote is not closed, or a bracket is a key.

    Text outside of brackets is a list. Before an element spaces and separators are passed over; a bare element ends at a space, and what
    follows it up to the separator is ignored; a quote may hold anything but itself; in a map a colon leads from key to value.
    """
    read = _reader(sep)

    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        return pa.array([None if x is None else read(x.decode("utf-8", "replace")) for x in texts.to_pylist()], pa.string())

    return run(text.cast("string").cast("binary"))


def parse_nested(text: Column, sep: str = ",") -> Column:
    """VARIANT of a nested literal; null for a broken one and for one that is nested deeper than a VARIANT can be."""
    return F.try_parse_json(to_json_text(text, sep))

"""HTML extraction by union-free regular-expression inference over the pages of a host.

Page. A linear pass turns a page into blocks and text without menus, headers,
footers, side bars, notices, adverts, forms, scripts and reader comments
(``parse``). The container of main text is an article, else a main element,
else the deepest block with four fifths of the text; the host's pages vote which.

Inference. Inside a container every block has a token stream: its child blocks and
``#`` for text, with tandem repeats folded into repeated groups. Streams at the same path
of the same host are aligned one after the other (``align``): what matches
stays, a sequence that occurs once here and repeatedly there becomes a repeated
group, what one side lacks becomes optional, and an irregular stretch becomes a
repeated group of optionals; the texts in between are the slots. The result is
one union-free expression a path; together they are the wrapper of the host. In a
container that is neither article nor main, a block whose text is the same on all
of three or more different pages is template, not a slot.

Extraction. Every page is matched against its host's wrapper from the container down
(``matches``), and the texts that fall into slots are its blocks. A wrapper covers
the streams that it was inferred from, so no text of a page is lost; what a
wrapper does not cover is not emitted.

Scale. Groups are (host, path), and streams of one group are folded by at most
``FOLD`` at a time, in as many rounds as it takes; a host with a third of
all pages is many such groups. Wrappers hold expressions, no texts.

Defined results: null html is empty text; white space (as of ``str.split``)
inside a block becomes one space; a line break tag is white space; blocks are
joined by two newlines; a null or odd url belongs to host ""; an unclosed tag or
quote ends at the next ``>``, an unclosed comment or script at the end of the page; repeated rows give
equal rows; columns other than the three are dropped; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_groups, sliced

#: Streams that one task folds at a time.
FOLD = 32
#: Bytes of wrappers up to which all are collected and broadcast; beyond that they are joined by host.
BROADCAST_BYTES = 16 << 20
#: Items beyond which an aligned stream is irregular: it becomes a repeated group of optionals.
REGULAR = 48
#: Different pages that must agree on a block's text for it to be template.
TEMPLATE_PAGES = 3

# HTML element names and the words of class, id and role tokens.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_RAW = frozenset("script style textarea title iframe noscript xmp".split())
_DROP = frozenset("nav footer aside template button select dialog menu svg math head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_CONTROLS = frozenset("input select button".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription sidebar sidenav menu nav navbar"
    " side navigation breadcrumb breadcrumbs footer adsense adsbygoogle adbox alert commentlist comment comments reply replies respond disqus related share sharing social pagination pager toolbar search login signup widget".split()
)
_TOP = frozenset("header masthead topbar".split())
_NEUTRAL = frozenset(
    "site page main left right top bottom area areas list section wrapper container box block bar inner outer form post posts global primary secondary google item items link links buttons icons thread title body"
    " unit slot panel overlay message msg first second the at".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_MARKS = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']++))""", re.I)
#: Characters of text, in all and for each control, up to which a form is one and not a page around its text.
FORM_TEXT, CONTROL_TEXT = 200, 60

_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in _RAW}
_WORDS = re.compile(r"[a-z]+")


def tokens(page: str):
    """(kind, name, marks, text) of a page in one pass; kind is ``o`` open, ``c`` close, ``t`` text, ``v`` void.

    ``marks`` are the class and id tokens and, with a leading ``@``, the roles.
    """
    at, n, quoted = 0, len(page), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "t", "", (), page[at:]
            return
        if start > at:
            yield "t", "", (), page[at:start]
        nxt = page[start + 1 : start + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", start):
                end, skip = page.find("-->", start + 4), 3
            elif page.startswith("<![CDATA[", start):
                end, skip = page.find("]]>", start), 3
            else:
                end, skip = page.find(">", start), 1
            at = n if end < 0 else end + skip
            continue
        tag = _NAME.match(page, start)
        if not tag:
            if nxt == "/":  # a bogus comment
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                yield "t", "", (), "<"
                at = start + 1
            continue
        rest = _REST.match(page, tag.end()) if quoted else None
        if rest is None:
            quoted = False  # a quote that never closes: from here on a tag ends at the next >
            end = page.find(">", tag.end()) + 1
            if not end:
                yield "t", "", (), page[start:]
                return
        else:
            end = rest.end()
        name, at = tag[1].lower(), end
        if nxt == "/":
            yield "c", name, (), ""
            continue
        if name in _RAW:
            close = _END[name].search(page, end)
            at = n if close is None else (page.find(">", close.end()) + 1 or n)
            continue
        marks = ()
        if end - tag.end() > 5:
            found = _MARKS.findall(page, tag.end(), end)
            if found:
                marks = tuple(("@" if kind.lower() == "role" else "") + w for kind, *value in found for w in "".join(value).lower().split())
        if name in _VOID:
            yield "v", name, marks, ""
        else:
            yield "o", name, marks, ""
            if page[end - 2] == "/" and name not in _INLINE and name in ("svg", "math"):
                yield "c", name, (), ""


def noise(name: str, marks: tuple, inside: bool) -> bool:
    """Whether an element is no main text; a header is none only outside of a container."""
    if name in _DROP or (name == "header" and not inside):
        return True
    if name in ("html", "body", "main"):
        return False
    for mark in marks:
        if mark[0] == "@":
            if mark[1:] in _ROLES:
                return True
            continue
        words = _WORDS.findall(mark)
        if words and any(w in _NOISE or (w in _TOP and not inside) for w in words) and all(w in _NOISE or w in _NEUTRAL or (w in _TOP and not inside) for w in words):
            return True
    return False


def kind_of(name: str, marks: tuple) -> str:
    """``article`` or ``main`` for the containers that name themselves, else ``""``."""
    if name == "article" or "@article" in marks:
        return "article"
    return "main" if name == "main" or "@main" in marks or "main" in marks else ""


class Block:
    """A block element without noise: its signature and kind, and texts and blocks in page order."""

    __slots__ = ("sign", "kind", "items", "controls")

    def __init__(self, sign: str, kind: str = ""):
        self.sign, self.kind, self.items, self.controls = sign, kind, [], 0


def is_form(b: Block) -> bool:
    """Whether a form element is one and not a page around its text: no container of main text in it, and little text for its controls."""
    chars = 0
    for x in walk(b):
        if x.kind:
            return False
        chars += sum(len(t) for t in x.items if isinstance(t, str))
    return chars <= max(FORM_TEXT, CONTROL_TEXT * b.controls)


_SIGNS: dict = {}


def _sign(name: str, marks: tuple) -> str:
    got = _SIGNS.get((name, marks))
    if got is None:
        if len(_SIGNS) > 20_000:
            _SIGNS.clear()
        got = _SIGNS[name, marks] = ".".join([name, *(m for m in (re.sub(r"\d+", "", m) for m in marks) if m)])
    return got


def parse(page: str) -> Block:
    """The blocks of a page, noise left out."""
    root = Block("")
    stack = [("", root, False)]  # (name, block or None inside noise, noise starts here)
    open_, off, inside = Counter(), 0, 0
    forms: list[Block] = []  # form elements that are open and not within noise
    text: list[str] = []

    def flush() -> None:
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if s:
                stack[-1][1].items.append(s)

    def pop() -> None:
        nonlocal off, inside
        name, block, starts = stack.pop()
        open_[name] -= 1
        off -= starts
        inside -= bool(block is not None and block.kind)
        if forms and forms[-1] is block:
            forms.pop()
            if is_form(block):
                stack[-1][1].items.remove(block)

    for kind, name, marks, s in tokens(page):
        if forms and name in _CONTROLS and kind != "c":
            forms[-1].controls += 1
        if kind == "t":
            if not off:
                text.append(s)
            continue
        inline = name in _INLINE
        if kind == "v":
            if not off:
                if name == "br":
                    text.append(" ")
                elif name == "hr":
                    flush()
            continue
        if kind == "c":
            if inline:
                if open_[name]:  # only inline noise is on the stack
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][1] is not None:
                            break
                continue
            if not off:
                flush()
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if inline:
            if off or not marks or not noise(name, marks, inside > 0):
                if off and stack[-1][0] == name:  # the same inline element within its noise
                    stack.append((name, None, False))
                    open_[name] += 1
                continue
            stack.append((name, None, True))
            open_[name] += 1
            off += 1
            continue
        if not off:
            flush()
        if name == "body":
            while len(stack) > 1 and stack[-1][0] != "html":
                pop()  # a head or noise that was left open before the body
        if name in _CLOSES_P and stack[-1][0] == "p":
            pop()
        ends = _ENDS.get(name)
        if ends:
            if stack[-1][0] == "p":
                pop()
            while stack[-1][0] in ends:
                pop()
        if stack[-1][0] == "head" and name not in ("base", "link", "meta"):
            pop()
        starts = not off and noise(name, marks, inside > 0)
        block = None
        if not off and not starts:
            block = Block(_sign(name, marks), kind_of(name, marks))
            stack[-1][1].items.append(block)
            inside += bool(block.kind)
            if name == "form":
                forms.append(block)
        stack.append((name, block, starts))
        open_[name] += 1
        off += starts
    if not off:
        flush()
    while len(stack) > 1:
        pop()
    return root


def walk(root: Block):
    """Blocks of a tree in page order, each with its depth, without recursion."""
    stack = [root]
    while stack:
        b = stack.pop()
        yield b
        stack.extend(x for x in reversed(b.items) if not isinstance(x, str))


def outermost(root: Block, wanted) -> list[Block]:
    """The outermost blocks for which ``wanted`` holds, in page order."""
    out, stack = [], [root]
    while stack:
        b = stack.pop()
        if wanted(b):
            out.append(b)
        else:
            stack.extend(x for x in reversed(b.items) if not isinstance(x, str))
    return out


def _mass(root: Block) -> dict[int, int]:
    """Characters of text in and below every block."""
    order = list(walk(root))
    mass = {}
    for b in reversed(order):
        mass[id(b)] = sum(len(x) if isinstance(x, str) else mass[id(x)] for x in b.items)
    return mass


_GROUPING = frozenset("html body div section main article center table tbody tr td ul ol dl blockquote figure details fieldset".split())
_IDS: dict = {}


def path_id(parent: str, sign: str) -> str:
    """Name of a path: a digest of the parent's and the block's signature."""
    got = _IDS.get((parent, sign))
    if got is None:
        if len(_IDS) > 50_000:
            _IDS.clear()
        got = _IDS[parent, sign] = hashlib.blake2b(f"{parent}/{sign}".encode(), digest_size=8).hexdigest()
    return got


def descent(root: Block) -> list[tuple[Block, str]]:
    """From the root, the chain of blocks that hold at least four fifths of the text of the one before, with their paths."""
    mass, chain = _mass(root), [(root, "")]
    while True:
        b, at = chain[-1]
        below = [x for x in b.items if not isinstance(x, str) and x.sign.partition(".")[0] in _GROUPING and 5 * mass[id(x)] >= 4 * mass[id(b)] > 0]
        if not below:
            return chain
        chain.append((below[0], path_id(at, below[0].sign)))


def candidates(root: Block) -> tuple[str, list[Block]]:
    """(key, containers) that a page alone would choose."""
    for kind in ("article", "main"):
        if found := outermost(root, lambda b: b.kind == kind):
            return kind, found
    b, at = descent(root)[-1]
    return f"at {at}", [b]


def chosen(root: Block, key: str | None) -> tuple[str, list[Block]]:
    """(key, containers) of a page for the host's key; its own if it lacks that."""
    own = candidates(root)
    if key is None or key == own[0]:
        return own
    if not key.startswith("at "):
        found = outermost(root, lambda b: b.kind == key)
        return (key, found) if found else own
    if not own[0].startswith("at "):
        return own
    stack, found = [(root, "")], []
    while stack:
        b, at = stack.pop()
        if f"at {at}" == key:
            found.append(b)
        else:
            stack.extend((x, path_id(at, x.sign)) for x in reversed(b.items) if not isinstance(x, str))
    return (key, found) if found else own


def fold(items: list) -> tuple:
    """Fold tandem repeats into ``("+", unit)``, units of one item first."""
    for size in range(1, 9):
        if len(items) < 2 * size:
            break
        out, i = [], 0
        while i < len(items):
            unit = items[i : i + size]
            n = 1
            while len(unit) == size and items[i + n * size : i + (n + 1) * size] == unit:
                n += 1
            if n > 1:
                out.append(unit[0] if size == 1 and isinstance(unit[0], tuple) else ("+", tuple(unit)))
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return tuple(items)


def stream(b: Block) -> list:
    """The token stream of a block's children."""
    return ["#" if isinstance(x, str) else x.sign for x in b.items]


def _symbols(item):
    if isinstance(item, tuple):
        for x in item[1]:
            yield from _symbols(x)
    else:
        yield item


def irregular(items) -> tuple:
    """Any sequence of the items' symbols, as a repeated group of optionals (kind ``*``)."""
    return ("*", tuple(sorted({s for x in items for s in _symbols(x)})))


def _grouped(seq: list, known: set) -> list:
    """Write single runs of what is repeated elsewhere as that repeated group; items are (item, optional)."""
    for unit in sorted(known - {x[1] for x, _ in seq if isinstance(x, tuple)}, key=lambda u: (-len(u), repr(u))):
        out, i, n = [], 0, len(unit)
        while i < len(seq):
            run = seq[i : i + n]
            if tuple(x for x, _ in run) == unit and (n == 1 or not any(o for _, o in run)):
                out.append((("+", unit), run[0][1]))
                i += n
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def align(a: list, b: list) -> list:
    """A wrapper that covers what either one covers; a wrapper is a list of (item, optional), ``[]`` covers nothing yet."""
    if not a or not b:
        whole = a or b
        return whole if len(whole) <= REGULAR else [(irregular([x for x, _ in whole]), True)]
    every = [x for x, _ in a + b]
    if len(b) > REGULAR or any(isinstance(x, tuple) and x[0] == "*" for x in every):
        return [(irregular(every), True)]
    units = lambda seq: {x[1] for x, _ in seq if isinstance(x, tuple)}
    a, b = _grouped(a, units(b)), _grouped(b, units(a))
    # the longest common subsequence
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append((a[i][0], a[i][1] or b[j][1]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((a[i][0], True))
            i += 1
        else:
            out.append((b[j][0], True))
            j += 1
    return out if len(out) <= REGULAR else [(irregular(every), True)]


def plain(items: tuple) -> list:
    """The wrapper of a single stream."""
    return [(x, False) for x in items]


def matches(wrapper: list, raw: list) -> bool:
    """Whether a stream, not folded, is a word of the expression: all places that it may have reached, item by item."""
    n = len(raw)

    def after(places: set, item) -> set:
        if not isinstance(item, tuple):
            return {p + 1 for p in places if p < n and raw[p] == item}
        out: set = set()
        if item[0] == "*":
            allowed, reach = set(item[1]), -1
            for p in sorted(places):
                if p > reach:
                    reach = p
                    while reach < n and raw[reach] in allowed:
                        reach += 1
                    out.update(range(p, reach + 1))
            return out
        now = places
        while now:
            for x in item[1]:
                now = after(now, x)
            now = now - out
            out |= now
        return out

    places = {0}
    for item, optional in wrapper:
        got = after(places, item)
        places = places | got if optional else got
    return n in places


def expression(wrapper: list) -> str:
    """The wrapper of a path as a union-free regular expression over tokens."""
    name = lambda s: "#" if s == "#" else f"<{s}>"

    def show(x) -> str:
        if not isinstance(x, tuple):
            return name(x)
        if x[0] == "*":
            return "( " + " ".join(f"( {name(s)} )?" for s in x[1]) + " )+" if x[1] else ""
        return "( " + " ".join(map(show, x[1])) + " )+"

    return " ".join(f"( {show(x)} )?" if optional and not (isinstance(x, tuple) and x[0] == "*") else show(x) for x, optional in wrapper)


def _thaw(x):
    return tuple(_thaw(i) for i in x) if isinstance(x, list) else x


def frozen(wrapper: list) -> str:
    return json.dumps(wrapper)


def thawed(text: str) -> list:
    return [(_thaw(x), o) for x, o in json.loads(text)]


def paths(key: str, containers: list[Block]):
    """(path, block) of every block in the containers."""
    for c in containers:
        stack = [(c, path_id("", key))]
        while stack:
            b, at = stack.pop()
            yield at, b
            stack.extend((x, path_id(at, x.sign)) for x in reversed(b.items) if not isinstance(x, str))


def emit(root: Block, key: str | None, wrapper: dict[str, list], template: frozenset, seen: dict) -> list[str]:
    """The texts of a page that fall into slots of its host's wrapper, in page order."""
    key, containers = chosen(root, key)
    if len(seen) > 50_000:
        seen.clear()
    out, stack = [], [(c, path_id("", key)) for c in reversed(containers)]
    while stack:
        b, at = stack.pop()
        if isinstance(b, str):
            out.append(b)
            continue
        if at in template:
            continue
        raw = stream(b)
        word = (at, *raw)
        fits = seen.get(word)
        if fits is None:
            fits = seen[word] = at in wrapper and matches(wrapper[at], raw)
        if fits:
            stack.extend((x, "" if isinstance(x, str) else path_id(at, x.sign)) for x in reversed(b.items))
    return out


def host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def text_digests(root: Block) -> dict[int, int]:
    """A digest of the texts in and below every block."""
    out = {}
    for b in reversed(list(walk(root))):
        h = hashlib.blake2b(digest_size=8)
        for x in b.items:
            h.update(b"#" + x.encode("utf-8", "replace") if isinstance(x, str) else b"<" + str(out[id(x)]).encode())
        out[id(b)] = int.from_bytes(h.digest(), "big", signed=True)
    return out


def _observed(pages: DataFrame) -> DataFrame:
    """(host, kind, path, value, n, lo, hi): streams, votes and, outside of named containers, block texts, summed over all pages."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in sliced(whole, "html", 2 << 20):
                count, texts = Counter(), {}
                for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    root = parse(page or "")
                    key, containers = candidates(root)
                    if not any(c.items for c in containers):
                        continue
                    count[h, "vote", "", key] += 1
                    # outside of named containers, the texts below blocks; a page is known by all of its text
                    digests = {} if key in ("article", "main") else text_digests(containers[0])
                    for at, b in paths(key, containers):
                        if b.items:
                            count[h, "stream", at, json.dumps(fold(stream(b)))] += 1
                            if digests:
                                texts.setdefault((h, at, digests[id(containers[0])]), []).append(digests[id(b)])
                rows = [(h, kind, at, value, n, None, None) for (h, kind, at, value), n in count.items()]
                rows += [(h, "text", at, str(page), len(d), min(d), max(d)) for (h, at, page), d in texts.items()]
                if rows:
                    kinds = [pa.string()] * 4 + [pa.int64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "kind", "path", "value", "n", "lo", "hi"])

    seen = pages.mapInArrow(run, "host string, kind string, path string, value string, n long, lo long, hi long")
    return seen.groupBy("host", "kind", "path", "value").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def infer(streams: DataFrame) -> DataFrame:
    """(host, path, wrapper) from the distinct streams (host, path, value) of each path.

    A group is folded by at most about ``FOLD`` at a time; what is left of it is folded in
    the next round, until every path has one wrapper.
    """
    out = "host string, path string, value string"

    def folded(first: bool):
        def run(key, frame):
            import pandas as pd

            wrapper: list = []
            for value in sorted(frame["value"]):
                wrapper = align(wrapper, plain(_thaw(json.loads(value))) if first else thawed(value))
            return pd.DataFrame([(key[0], key[1], frozen(wrapper))], columns=["host", "path", "value"])

        return run

    now, first = streams.select("host", "path", "value"), True
    while True:
        sizes = now.groupBy("host", "path").agg(F.count(F.lit(1)).alias("c"))
        most = sizes.agg(F.max("c")).first()[0] or 0
        if most <= 1 and not first:
            return now.select("host", "path", F.col("value").alias("wrapper"))
        salted = now.join(sizes, ["host", "path"]).withColumn("salt", F.pmod(F.xxhash64("value"), F.ceil(F.col("c") / FOLD)))
        now = cut(salted.groupBy("host", "path", "salt").applyInPandas(folded(first), out))
        first = False


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, main, paths, template, expression): the wrapper of every host.

    ``main`` names the container, ``paths`` are (path, wrapper) and ``template`` the paths whose text is no slot.
    """
    seen = cut(_observed(pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))))
    votes = seen.filter("kind = 'vote'").groupBy("host").agg(
        F.sum("n").alias("pages"), F.max(F.struct((F.col("value") == "article").alias("a"), (F.col("value") == "main").alias("b"), "n", "value")).getField("value").alias("main")
    )
    rules = infer(seen.filter("kind = 'stream'")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "wrapper"))).alias("paths"))
    # a page counts once for a path, whatever copies it has; the root of a container is no template
    block = seen.filter("kind = 'text'").groupBy("host", "path").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    same = block.filter(f"c >= {TEMPLATE_PAGES} and lo = hi").groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("template"))
    shown = F.udf(lambda ps: " ; ".join(f"{p['path']}: {expression(thawed(p['wrapper']))}" for p in ps or []), "string")
    return votes.join(rules, "host", "left").join(same, "host", "left").select("host", "pages", "main", "paths", "template", shown("paths").alias("expression"))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = cut(wrappers(pages, url_col, html_col).drop("expression"))
    facts = found.agg(F.coalesce(F.sum(F.aggregate("paths", F.lit(0).cast("long"), lambda a, x: a + F.length(x.wrapper) + 60)), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host(F.col("url")))
    sent = None
    if facts[0] <= BROADCAST_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["main"], r["paths"], r["template"]) for r in found.drop("pages").collect()})
    else:
        none = rows.join(found.select("host"), "host", "left_anti").select("*", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("main", "paths", "template")))
        rows = join_groups(rows, found, "host", "pages", facts[1]).drop("pages").unionByName(none)

    def run(batches):
        import pyarrow as pa

        rules: dict = {}
        for whole in batches:
            for batch in sliced(whole, "html", 2 << 20):
                text = []
                for i, (h, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                    if h not in rules:
                        if len(rules) > 2000:
                            rules.clear()
                        key, parts, same = sent.value.get(h, (None, None, None)) if sent else (batch.column(c)[i].as_py() for c in ("main", "paths", "template"))
                        rules[h] = key, {p["path"]: thawed(p["wrapper"]) for p in parts or ()}, frozenset(same or ()), {}
                    text.append("\n\n".join(emit(parse(page or ""), *rules[h])))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.select("page_id", "url", "html", "host", *([] if sent else ["main", "paths", "template"])).mapInArrow(run, out)


def query(spark, sf_dir):
    from .common import table

    return extract_main(table(spark, sf_dir, "pages"))

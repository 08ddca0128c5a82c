"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding works as the library does: the text gets a leading space mark, spaces
become the mark U+2581, and an agenda of adjacent symbol pairs, ordered by score
and then by position, merges the best pair until none is in the vocabulary;
what is left unknown becomes byte pieces. No piece of such a vocabulary has the
mark after another character, so no merge crosses into a mark from the left:
the text falls into segments that start at a run of marks, each of which is
encoded once and remembered. ``PieceModel`` checks that property of the file and
otherwise takes the text as one segment. The new segments of a batch slice are
merged together: one numpy step takes the best agenda entry of every segment
that still has one. Long segments have a heap as their agenda.

Rows stream through Arrow batches; the memory of a worker is a batch slice plus a
bounded table of remembered segments. With ``check=True`` the segments that are
new to a worker are encoded by the sentencepiece library as well, batch by batch,
and a difference is an error.

Defined results: null counts as empty and gives no ids; repeated rows give equal
rows; other columns are dropped by ``encode`` save the id; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import claim_worker, give_back, sliced

MARK = "▁"
#: Bytes (estimated) of the two tables of remembered segments of a worker, and the longest segment that is remembered.
CACHE = 40 << 20
CACHE_CHARS = 48
#: Bytes of text that a task works on at a time.
SLICE = 512 << 10
#: New segments that are merged and checked at a time.
PART = 20_000
#: Longest segment that is merged in step with others.
STEP_CHARS = 24
_NONE = np.int64(2**62)
_MARK = MARK.encode()
_MODELS: dict[str, "PieceModel"] = {}


class PieceModel:
    """Vocabulary of a sentencepiece BPE file, with the agenda encoder and the decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.hidden = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.bytes = {}
        self.rank = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif i not in self.hidden and not sp.is_unused(i):
                self.rank[p] = (-sp.get_score(i), i)
        self.value = {i: b for b, i in self.bytes.items()}
        self.split = all(MARK not in p.lstrip(MARK) for p in self.rank)
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$").findall
        self.seen, self.older = {}, {}  # segment: (ids joined by commas, decoded bytes)
        self.room = CACHE // 2
        self.names = [str(i) for i in range(n)]
        self.piece_bytes = [b"" if i in self.hidden else bytes((self.value[i],)) if i in self.value else p.encode() for i, p in enumerate(self.pieces)]
        # a mark is a piece, so it never comes out of byte pieces
        self.shown_bytes = [b.replace(_MARK, b" ") for b in self.piece_bytes]
        self._pairs()

    def _pairs(self) -> None:
        """Sorted codes of all symbol pairs that form a piece, with the piece and its place in score order."""
        number = {p: i for p, (_, i) in self.rank.items()}
        for p in list(number):
            for c in p:
                number.setdefault(c, len(self.pieces) + len(number))
        self.base = 1 + max(number.values())
        place = {s: i for i, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        rows = [
            (number[p[:k]] * self.base + number[p[k:]], place[score], i)
            for p, (score, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        ]
        self.code, self.place, self.made = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
        self.of_char = -2 - np.arange(0x110000, dtype=np.int64)  # below zero: in no piece
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.char_of = {i: p for p, i in number.items() if len(p) == 1}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = left * self.base + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        found = (self.code[at] == code) & (left >= 0) & (right >= 0)
        return np.where(found, self.place[at], _NONE), self.made[at]

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments, merged in step: every round takes the best agenda entry of each segment."""
        out: list[list[int]] = [[]] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        short = [i for i in order if len(segments[i]) <= STEP_CHARS]
        for i in order[len(short) :]:
            out[i] = self.merge(segments[i])
        for k in range(0, len(short), 4096):
            rows = short[k : k + 4096]
            size = np.array([len(segments[i]) for i in rows])
            width = int(size.max()) + 2
            s = np.full((len(rows), width), -1, np.int64)
            inside = np.arange(width) < size[:, None]
            s[inside] = self.of_char[np.frombuffer("".join([segments[i] for i in rows]).encode("utf-32-le"), np.uint32)]
            place, made = self._look(s[:, :-1], s[:, 1:])
            live = np.arange(len(rows))
            final = s
            while len(live):
                best = place.argmin(axis=1)
                line = np.arange(len(live))
                going = place[line, best] < _NONE
                if not going.all():
                    final[live[~going]] = s[~going]
                    live, s, place, made, best = live[going], s[going], place[going], made[going], best[going]
                    if not len(live):
                        break
                    line = np.arange(len(live))
                new = made[line, best]
                at = np.arange(width)
                shift = np.minimum(at + (at > best[:, None]), width - 1)
                s = np.take_along_axis(s, shift, axis=1)
                s[:, -1] = -1
                s[line, best] = new
                place, made = np.take_along_axis(place, shift[:, :-1].clip(max=width - 2), axis=1), np.take_along_axis(made, shift[:, :-1].clip(max=width - 2), axis=1)
                place[:, -1] = _NONE
                place[line, best], made[line, best] = self._look(new, s[line, best + 1])
                has = best > 0
                place[line[has], best[has] - 1], made[line[has], best[has] - 1] = self._look(s[line[has], best[has] - 1], new[has])
            n = len(self.pieces)
            used = final != -1
            plain = (~used | ((final >= 0) & (final < n))).all(axis=1)
            flat, ends = final[used].tolist(), np.cumsum(used.sum(axis=1)).tolist()
            for i, simple, a, b in zip(rows, plain.tolist(), [0, *ends], ends, strict=False):
                if simple:
                    out[i] = flat[a:b]
                    continue
                ids = []
                for x in flat[a:b]:
                    if 0 <= x < n:
                        ids.append(x)
                    else:
                        c = self.char_of[x] if x >= 0 else chr(-2 - x)
                        if self.bytes:
                            ids.extend(self.bytes[b] for b in c.encode())
                        elif not ids or ids[-1] != self.unk:
                            ids.append(self.unk)
                out[i] = ids
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda of adjacent pairs."""
        rank = self.rank
        symbols = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if found := rank.get(symbols[i] + symbols[i + 1]):
                agenda.append((found[0], i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != size:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = a + b, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if found := rank.get(symbols[left] + symbols[nxt]):
                    heapq.heappush(agenda, (found[0], left, nxt, len(symbols[left]) + len(symbols[nxt])))
            prev = before[left]
            if prev >= 0 and (found := rank.get(symbols[prev] + symbols[left])):
                heapq.heappush(agenda, (found[0], prev, left, len(symbols[prev]) + len(symbols[left])))
        ids = []
        for s in symbols:
            if s:
                if found := rank.get(s):
                    ids.append(found[1])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in s.encode())
                elif not ids or ids[-1] != self.unk:
                    ids.append(self.unk)
        return ids

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.segments(marked) if self.split else [marked]

    def encode(self, text: str) -> list[int]:
        return [i for s in self.cut(text) for i in self.merge(s)]

    def raw(self, ids: list[int]) -> bytes:
        """The pieces' bytes, marks not yet turned into spaces."""
        return b"".join([self.piece_bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined as UTF-8, marks become spaces, the leading one goes."""
        return finish(self.raw(ids))

    def learn(self, segments: set[str], check: bool) -> dict[str, tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of the segments that are too long to be remembered; the others are in ``seen`` then.

        There are two tables: when one is full it becomes the older one, from which
        segments in use come back, so frequent segments stay and the sum is bounded.
        """
        if self.room < 0:
            self.older, self.seen, self.room = self.seen, {}, CACHE // 2
        seen, older, long = self.seen, self.older, {}
        new = [s for s in segments if s not in seen]
        self._remember({s: older[s] for s in new if s in older})
        new = [s for s in new if s not in older]
        for k in range(0, len(new), PART):
            part = new[k : k + PART]
            found = self.merge_many(part)
            if check:
                self.check(part, found)
            flat = [i for ids in found for i in ids]
            names, raws = list(map(self.names.__getitem__, flat)), list(map(self.shown_bytes.__getitem__, flat))
            own, at = {}, 0
            for s, ids in zip(part, found, strict=True):
                end = at + len(ids)
                (own if len(s) <= CACHE_CHARS else long)[s] = ",".join(names[at:end]), b"".join(raws[at:end])
                at = end
            self._remember(own)
        return long

    def _remember(self, own: dict) -> None:
        self.seen.update(own)
        self.room -= 320 * len(own) + 4 * sum(map(len, own))

    def check(self, segments: list[str], found: list[list[int]]) -> None:
        """Hold segments against the library; a segment's own leading mark stands for the text's."""
        rows = [i for i, s in enumerate(segments) if s[0] == MARK and len(s) > 1]
        plain = [segments[i][1:].replace(MARK, " ") for i in rows]
        want = self.library.encode(plain, num_threads=1)
        if [found[i] for i in rows] != want:
            text = next(t for t, i, ids in zip(plain, rows, want, strict=True) if found[i] != ids)
            raise ValueError(f"the agenda and the library differ on {text!r}")


def loaded(path: str) -> PieceModel:
    """The model of a file, once per worker."""
    claim_worker("pieces", _MODELS.clear)
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def finish(raw: bytes) -> str:
    text = raw.decode("utf-8", errors="replace").replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, check: bool = True) -> DataFrame:
    """Encode and decode every text.

    Columns: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with
    ``ids`` and ``decoded`` the arrays and the texts themselves.
    """
    id_type = docs.schema[id_col].dataType
    out = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    )

    def run(batches):
        import pyarrow as pa

        model = loaded(model_path)
        for whole in batches:
            for batch in sliced(whole, "text", SLICE):
                rows = []
                cut = [model.cut(text or "") for text in batch.column("text").to_pylist()]
                long = model.learn({p for parts in cut for p in parts}, check)
                seen = model.seen
                for parts in cut:
                    got = [long.get(p) or seen[p] for p in parts] if long else [seen[p] for p in parts]
                    joined = ",".join([g[0] for g in got])
                    # text that was UTF-8 gives bytes that are UTF-8; the leading mark is the model's own
                    back = b"".join([g[1] for g in got]).removeprefix(b" ")
                    row = [joined.count(",") + 1 if got else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest()]
                    if ids:
                        row.append([int(i) for i in joined.split(",")] if joined else [])
                    if decoded:
                        row.append(back.decode())
                    rows.append(row)
                kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids + [pa.string()] * decoded
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[f.name for f in out]
                )
        whole = batch = rows = cut = parts = got = None
        give_back()

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, out)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir, model_path: str | None = None):
    from .common import table

    return encode(table(spark, sf_dir, "documents"), model_path or default_model(), ids=False, decoded=False)

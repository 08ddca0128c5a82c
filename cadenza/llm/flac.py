"""FLAC streams of 8-bit mono samples: encoder, decoder, checksums and seek points.

The codec works on many frames at once with numpy: one array operation handles
one sample of all frames of a kind in step, so there is no loop over bits or
over the samples of one frame. Frames hold 576 samples.

Encoding: constant, verbatim, fixed (orders 0 to 2) or linear-predictor
(order 4) subframes, whichever takes the fewest bits, with Rice-coded residuals;
a seek point per frame (of more than ``SEEK_POINTS`` frames, of every k-th); the MD5 of the samples in STREAMINFO.

Decoding: constant, verbatim, fixed (0 to 4) and linear-predictor (1 to 32)
subframes, both Rice parameter widths, partitions and escape codes; CRC-8 of
every header, CRC-16 of every frame and the MD5 of the samples are verified. With a seek
point for every frame all frames are decoded together, otherwise their starts
are found by header and checksum. The output is PCM blocks with the offset of
their first sample.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 576
RATE = 8000
#: Seek points of a stream; a longer one has a point every second, third, ... frame.
SEEK_POINTS = 900_000
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
_LPC, _PRECISION = 4, 12


def _crc_tables(poly: int, bits: int, length: int, kind) -> np.ndarray:
    """Row d: what a byte contributes to the CRC if d bytes follow it."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    one = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        one.append(c)
    one = np.array(one, kind)
    rows = [one]
    for _ in range(length - 1):
        c = rows[-1]
        rows.append((((c.astype(np.uint32) << 8) & mask) ^ one[c >> (bits - 8)]).astype(kind))
    return np.stack(rows)


_CRC8 = _crc_tables(0x07, 8, 16, np.uint8)
_CRC16 = _crc_tables(0x8005, 16, 2 * BLOCK, np.uint16)


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of consecutive pieces that together make up ``data[starts[0]:ends[-1]]`` with gaps allowed."""
    size = ends - starts
    table = _CRC16 if size.max() <= len(_CRC16) else _crc_tables(0x8005, 16, int(size.max()), np.uint16)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.bitwise_xor.reduceat(table[np.repeat(size - 1, size) - at, data[np.repeat(starts, size) + at]], first)


def _header(number: int) -> bytes:
    """Header of frame ``number``: 576 samples, 8 kHz, mono, 8 bit."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        coded = bytes([((0xFF00 >> n) & 0xFF) | number >> (6 * (n - 1))] + [0x80 | (number >> (6 * i)) & 0x3F for i in range(n - 2, -1, -1)])
    head = b"\xff\xf8\x24\x02" + coded
    crc = 0
    for i, b in enumerate(head):
        crc ^= int(_CRC8[len(head) - 1 - i, b])
    return head + bytes([crc])


_HEADS: list[bytes] = []


def _heads(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_HEADS) < n:
        _HEADS.append(_header(len(_HEADS)))
    heads = _HEADS[:n]
    return np.array([len(h) for h in heads]), np.frombuffer(b"".join(h.ljust(12, b"\0") for h in heads), np.uint8).reshape(n, 12)


def _rice_cost(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of Rice-coding each row of residuals."""
    u = (e << 1) ^ (e >> 31)
    mean = u.mean(axis=1)
    k0 = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int32)
    best = None
    for k in (np.clip(k0 - 1, 0, 14), np.clip(k0, 0, 14)):
        bits = (u >> k[:, None]).sum(axis=1) + e.shape[1] * (1 + k)
        if best is None:
            best = (bits, k)
        else:
            best = (np.minimum(best[0], bits), np.where(bits < best[0], k, best[1]))
    return best


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor (coefficients, shift) of each row by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, j:], f[:, : f.shape[1] - j]) for j in range(_LPC + 1)], axis=1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a = np.zeros((len(x), _LPC))
    err = r[:, 0].copy()
    for i in range(_LPC):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= 1 - k * k
    shift = np.clip(_PRECISION - 2 - np.frexp(np.abs(a).max(axis=1))[1], 0, 15).astype(np.int32)
    top = (1 << (_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int32), shift


def encode_frames(x: np.ndarray, numbers: np.ndarray, partition_order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, frame sizes) of frames given as rows of 576 samples from -128 to 127."""
    n, block = x.shape
    x = x.astype(np.int32)
    residual = [x, x[:, 1:] - x[:, :-1]]
    residual.append(residual[1][:, 1:] - residual[1][:, :-1])
    coef, shift = _lpc(x)
    pred = np.zeros((n, block - _LPC), np.int32)
    for j in range(_LPC):
        pred += coef[:, j : j + 1] * x[:, _LPC - 1 - j : block - 1 - j]
    residual.append(x[:, _LPC:] - (pred >> shift[:, None]))
    orders = np.array([0, 1, 2, _LPC])
    costs, ks = zip(*(_rice_cost(e) for e in residual), strict=True)
    parts = 1 << partition_order
    extra = 10 + 4 * (parts - 1) + np.array([0, 8, 16, 8 * _LPC + 9 + _PRECISION * _LPC])
    total = np.stack(costs, axis=1) + extra
    kind = total.argmin(axis=1)
    raw = total.min(axis=1) >= 8 * block
    same = (x == x[:, :1]).all(axis=1)
    kind = np.where(same, 5, np.where(raw, 4, kind))

    # fields: value and width in bits; the upper bits of wide fields are zero
    lead = 1 + _LPC + 2 + _LPC + 2
    value = np.zeros((n, lead + block + parts - 1), np.int32)
    width = np.zeros_like(value)
    value[:, 0] = np.choose(kind, [8 << 1, 9 << 1, 10 << 1, (32 + _LPC - 1) << 1, 1 << 1, 0])
    width[:, 0] = 8
    for c in range(6):
        rows = np.flatnonzero(kind == c)
        if not len(rows):
            continue
        body = slice(lead, lead + block)
        if c == 5:
            value[rows, lead], width[rows, lead] = x[rows, 0] & 255, 8
        elif c == 4:
            value[rows, body], width[rows, body] = x[rows] & 255, 8
        else:
            o = orders[c]
            value[rows, 1 : 1 + o], width[rows, 1 : 1 + o] = x[rows, :o] & 255, 8
            if c == 3:
                at = 1 + _LPC
                value[rows, at], width[rows, at] = _PRECISION - 1, 4
                value[rows, at + 1], width[rows, at + 1] = shift[rows], 5
                value[rows, at + 2 : at + 2 + _LPC], width[rows, at + 2 : at + 2 + _LPC] = coef[rows] & ((1 << _PRECISION) - 1), _PRECISION
            e = residual[c][rows]
            k = ks[c][rows][:, None]
            u = (e << 1) ^ (e >> 31)
            codes, sizes = (1 << k) | (u & ((1 << k) - 1)), (u >> k) + 1 + k
            value[rows, lead - 2], width[rows, lead - 2] = partition_order, 6
            at, done = lead - 1, 0
            for p in range(parts):
                m = block // parts - (o if p == 0 else 0)
                value[rows, at], width[rows, at] = k[:, 0], 4
                value[rows, at + 1 : at + 1 + m], width[rows, at + 1 : at + 1 + m] = codes[:, done : done + m], sizes[:, done : done + m]
                at, done = at + 1 + m, done + m
    head_len, head = _heads(int(numbers.max()) + 1)
    head_len, head = head_len[numbers], head[numbers]
    sizes = head_len + (width.sum(axis=1) + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    end = np.cumsum(width, axis=1)
    end += ((starts + head_len) * 8)[:, None]
    bits = np.zeros(int(sizes.sum()) * 8, np.uint8)
    for part in (slice(0, lead), slice(lead, None)):
        v, e = value[:, part].ravel(), end[:, part].ravel()
        for j in range(int(v.max()).bit_length()):
            bits[e[np.flatnonzero((v >> j) & 1)] - 1 - j] = 1
    data = np.packbits(bits)
    for c in range(int(head_len.max())):
        rows = np.flatnonzero(head_len > c)
        data[starts[rows] + c] = head[rows, c]
    crc = _crc16(data, starts, starts + sizes - 2)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 255
    return data, sizes


def _block(kind: int, last: bool, body: bytes) -> bytes:
    return bytes([kind | 0x80 * last]) + len(body).to_bytes(3, "big") + body


def encode(payloads: list[bytes], partition_order: int = 0) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of 576; byte b is sample b - 128."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
    first = np.cumsum(frames) - frames
    data, sizes = encode_frames(x, np.arange(len(x)) - np.repeat(first, frames), partition_order)
    ends = np.cumsum(sizes)
    out = []
    for p, f, a in zip(payloads, frames.tolist(), first.tolist(), strict=True):
        own = sizes[a : a + f]
        offset = np.cumsum(own) - own
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        seek = np.zeros(f, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        seek["sample"], seek["offset"], seek["size"] = np.arange(f) * BLOCK, offset, BLOCK
        seek = seek[:: -(-f // SEEK_POINTS)]  # the table's length has three bytes
        begin = ends[a] - sizes[a]
        out.append(b"fLaC" + _block(0, False, info) + _block(3, True, seek.tobytes()) + data[begin : begin + int(own.sum())].tobytes())
    return out


class Bits:
    """Bit positions, one per frame, that read forward in step through one byte array."""

    def __init__(self, data: np.ndarray):
        b = np.concatenate([data, np.zeros(16, np.uint8)])
        w = b[:-3].astype(np.uint64)
        self.words = (w << np.uint64(32)) | (b[1:-2].astype(np.uint64) << np.uint64(24)) | (b[2:-1].astype(np.uint64) << np.uint64(16)) | (b[3:].astype(np.uint64) << np.uint64(8))
        self.words[:-1] |= b[4:].astype(np.uint64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 32 bits at each position."""
        return (self.words[at >> 3] >> (8 - (at & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """``n`` bits (0 to 32) at each position, as unsigned."""
        return (self.peek(at) >> (32 - np.asarray(n)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v = self.read(at, n)
        half = np.int64(1) << (np.asarray(n, np.int64) - 1)
        return (v ^ half) - half


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples by frame, numbers); raises ValueError on a bad checksum or header."""
    starts, ends = starts.astype(np.int64), ends.astype(np.int64)
    if (_crc16(data, starts, ends - 2) != (data[ends - 2].astype(np.uint16) << 8 | data[ends - 1])).any():
        raise ValueError("frame checksum")
    lead = data[starts + 4]
    coded = np.where(lead < 0x80, 1, 8 - np.frexp((lead ^ 255).astype(np.float64))[1])
    crc = np.zeros(len(starts), np.uint8)
    for j in range(int(coded.max()) + 4):
        rows = np.flatnonzero(coded + 4 > j)
        crc[rows] ^= _CRC8[coded[rows] + 3 - j, data[starts[rows] + j]]
    if (crc != data[starts + 4 + coded]).any() or (data[starts] != 255).any() or (data[starts + 1] & 0xFE != 0xF8).any():
        raise ValueError("frame header")
    if (data[starts + 2] >> 4 != 2).any() or (data[starts + 3] != 2).any():
        raise ValueError("only mono 8-bit frames of 576 samples")
    number = np.where(coded == 1, lead, lead & (127 >> coded)).astype(np.int64)
    for j in range(1, int(coded.max())):
        rows = np.flatnonzero(coded > j)
        number[rows] = number[rows] << 6 | data[starts[rows] + 4 + j] & 0x3F
    bits = Bits(data)
    pos = (starts + 5 + coded) * 8
    kind = bits.read(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("subframe header")
    kind >>= 1
    pos += 8
    x = np.zeros((BLOCK, len(starts)), np.int32)
    for c in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == c)
        at = pos[rows]
        if c == 0:
            x[:, rows] = bits.signed(at, 8)
        elif c == 1:
            for t in range(BLOCK):
                x[t, rows] = bits.signed(at + 8 * t, 8)
        elif 8 <= c <= 12 or c >= 32:
            x[:, rows] = _predicted(bits, at, c - 31 if c >= 32 else c - 8, c >= 32)
        else:
            raise ValueError("subframe kind")
    return x.T, number


def _predicted(bits: Bits, at: np.ndarray, order: int, linear: bool) -> np.ndarray:
    n = len(at)
    x = np.zeros((BLOCK, n), np.int32)
    for t in range(order):
        x[t] = bits.signed(at, 8)
        at = at + 8
    coef = [np.int64(c) for c in _FIXED[order]] if not linear else []
    shift = 0
    if linear:
        precision = bits.read(at, 4) + 1
        shift = bits.signed(at + 4, 5)
        at = at + 9
        for _ in range(order):
            coef.append(bits.signed(at, precision))
            at = at + precision
    method = bits.read(at, 2)
    parts = 1 << bits.read(at + 2, 4)
    at = at + 6
    wide = np.where(method == 1, 5, 4)
    every = BLOCK // parts
    k = plain = raw = None
    steady = int(every.min())  # no frame starts a partition in between
    for t in range(order, BLOCK):
        if t == order or t % steady == 0:
            new = np.ones(n, bool) if t == order else t % every == 0
            k_new = bits.read(at, wide)
            escape = new & (k_new == (1 << wide) - 1)
            at = np.where(new, at + wide, at)
            k = k_new if k is None else np.where(new, k_new, k)
            raw = np.zeros(n, np.int64) if raw is None else raw
            plain = ~new & plain if plain is not None else np.zeros(n, bool)
            if escape.any():
                raw = np.where(escape, bits.read(at, 5), raw)
                at = np.where(escape, at + 5, at)
                plain = plain | escape
            any_plain = plain.any()
        ahead = bits.peek(at)
        zeros = 32 - np.frexp(ahead.astype(np.float64))[1]
        while (far := zeros == 32).any() and not (any_plain and plain[far].all()):
            # a run of zeros longer than the window: the rare long codes
            rows = np.flatnonzero(far & ~plain) if any_plain else np.flatnonzero(far)
            count, where = np.full(len(rows), 32), at[rows] + 32
            while True:
                w = bits.peek(where)
                z = 32 - np.frexp(w.astype(np.float64))[1]
                count += z
                where = where + z
                if (z < 32).all():
                    break
            zeros[rows] = count
            break
        stop = at + zeros + 1
        u = (zeros.astype(np.int64) << k) | bits.read(stop, k)
        e = (u >> 1) ^ -(u & 1)
        at_next = stop + k
        if any_plain:
            e = np.where(plain, np.where(raw > 0, bits.signed(at, np.maximum(raw, 1)), 0), e)
            at_next = np.where(plain, at + raw, at_next)
        at = at_next
        if order:
            pred = coef[0] * x[t - 1].astype(np.int64)
            for j in range(1, order):
                pred = pred + coef[j] * x[t - 1 - j]
            e = e + (pred >> shift)
        x[t] = e
    return x


def layout(stream: bytes) -> tuple[dict, int]:
    """(STREAMINFO facts and seek points, offset of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, facts, last = 4, {"seek": None}, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            facts |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34], "max_frame": int.from_bytes(body[7:10], "big")}
        elif kind == 3:
            facts["seek"] = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]))
        at += 4 + size
    return facts, at


def frame_starts(stream: bytes) -> tuple[dict, list[int]]:
    """Byte offsets of all frames (and the end), from the seek points or by scanning headers and checksums."""
    facts, at = layout(stream)
    seek, frames = facts["seek"], -(-facts["samples"] // BLOCK)
    if seek is not None and len(seek) == frames:
        return facts, [*(at + seek["offset"].astype(np.int64)).tolist(), len(stream)]
    data, starts, number = np.frombuffer(stream, np.uint8), [at], 0
    while number < frames:
        number += 1
        end = len(stream)
        if number < frames:
            head, end = _header(number), starts[-1]
            while True:
                end = stream.index(head, end + 1)
                if _crc16(data, np.array([starts[-1]]), np.array([end]))[0] == 0:
                    break
        starts.append(end)
    return facts, starts


def decode(streams: list[bytes]) -> list[bytes]:
    """Payload bytes of FLAC streams; raises ValueError if any checksum fails."""
    base, starts, ends, counts, facts = 0, [], [], [], []
    for s in streams:
        f, own = frame_starts(s)
        facts.append(f)
        counts.append(len(own) - 1)
        starts += [base + o for o in own[:-1]]
        ends += [base + o for o in own[1:]]
        base += len(s)
    x, number = decode_frames(np.frombuffer(b"".join(streams), np.uint8), np.array(starts), np.array(ends))
    raw = (x + 128).astype(np.uint8)
    out, at = [], 0
    for f, n in zip(facts, counts, strict=True):
        if (number[at : at + n] != np.arange(n)).any():
            raise ValueError("frame numbers")
        own = raw[at : at + n].tobytes()[: f["samples"]]
        if hashlib.md5((np.frombuffer(own, np.uint8) ^ 128).tobytes()).digest() != f["md5"]:
            raise ValueError("MD5 of the samples")
        out.append(own)
        at += n
    return out


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """``count`` bytes from ``sample`` on, decoding only the frames that hold them."""
    _, starts = frame_starts(stream)
    a, b = sample // BLOCK, min(len(starts) - 1, -(-(sample + count) // BLOCK))
    x, _ = decode_frames(np.frombuffer(stream, np.uint8), np.array(starts[a:b]), np.array(starts[a + 1 : b + 1]))
    return (x + 128).astype(np.uint8).tobytes()[sample - a * BLOCK :][:count]

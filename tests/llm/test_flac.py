import random

import numpy as np
import pytest

from cadenza.llm import flac


def payloads():
    r = random.Random(2)
    rng = np.random.default_rng(2)
    wave = (np.sin(np.arange(576 * 5) / 9) * 100 + 128).astype(np.uint8).tobytes()
    spike = bytearray(b"a" * 576 * 2)
    spike[700] = 0
    return [
        b"\xff" * 576, rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes(), wave, bytes(spike), b"\x00\xff" * 288,
        ("The quick brown fox. " * 400).encode()[: 576 * 12], "".join(r.choice("etaoin shrdlu\né") for _ in range(9000)).encode()[: 576 * 150 // 10],
        bytes(range(256)) * 9,
    ]


def test_round_trip_and_seek():
    own = payloads()
    own.append(own[5] * 20)  # frame numbers of two bytes
    for order in (0, 2, 6):
        streams = flac.encode(own, order)
        assert flac.decode(streams) == own
        assert flac.encode(own[2:3], order) == streams[2:3]
    kinds = {s[flac.frame_starts(s)[1][0] + 6] >> 1 for s in streams}
    assert {0, 1} <= kinds and kinds & set(range(32, 64))
    for at, n in ((0, 1), (575, 2), (1000, 3000), (576 * 11, 576)):
        assert flac.seek(streams[5], at, n) == own[5][at : at + n]


class Slow:
    """A second decoder, bit by bit, after the format's description."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def u(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.data[self.at >> 3] >> (7 - self.at % 8) & 1
            self.at += 1
        return v

    def s(self, n):
        v = self.u(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = 0
        while not self.u(1):
            n += 1
        return n

    def residual(self, size, order):
        width, parts, out = (4, 5)[self.u(2)], self.u(4), []
        for i in range(1 << parts):
            n, k = (size >> parts) - (order if i == 0 else 0), self.u(width)
            raw = self.u(5) if k == (1 << width) - 1 else None
            for _ in range(n):
                if raw is not None:
                    out.append(self.s(raw))
                else:
                    v = self.unary() << k | self.u(k)
                    out.append(v >> 1 ^ -(v & 1))
        return out

    def frame(self):
        assert self.u(14) == 0x3FFE and self.u(1) == 0
        self.u(1)
        code, rate = self.u(4), self.u(4)
        assert (self.u(4), self.u(3), self.u(1)) in {(0, 0, 0), (0, 1, 0)}
        lead = self.u(8)
        while lead & 0x80 and lead & 0x40:
            self.u(8)
            lead = lead << 1 & 0xFF
        size = {6: lambda: self.u(8) + 1, 7: lambda: self.u(16) + 1}.get(code, lambda: 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8))()
        self.u({12: 8, 13: 16, 14: 16}.get(rate, 0))
        self.u(8)
        assert self.u(1) == 0
        kind = self.u(6)
        assert self.u(1) == 0
        if kind == 0:
            x = [self.s(8)] * size
        elif kind == 1:
            x = [self.s(8) for _ in range(size)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [self.s(8) for _ in range(order)]
            coefficients, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                precision, shift = self.u(4) + 1, self.s(5)
                coefficients = [self.s(precision) for _ in range(order)]
            for e in self.residual(size, order):
                x.append(e + (sum(c * v for c, v in zip(coefficients, reversed(x), strict=False)) >> shift))
        self.at += -self.at % 8
        self.u(16)
        return bytes(v + 128 for v in x)


def slow(stream):
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, size = stream[at] >> 7, int.from_bytes(stream[at + 1 : at + 4], "big")
        if stream[at] & 127 == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
    bits, out = Slow(stream[at:]), b""
    while len(out) < total:
        out += bits.frame()
    assert bits.at == 8 * (len(stream) - at)
    return out


def test_streams_by_a_second_decoder():
    own = payloads()
    for order in (0, 3):
        assert [slow(s) for s in flac.encode(own, order)] == own


def test_long_streams_have_fewer_seek_points(monkeypatch):
    monkeypatch.setattr(flac, "SEEK_POINTS", 3)
    own = payloads()
    streams = flac.encode(own)
    assert flac.decode(streams) == own and all(int.from_bytes(s[43:46], "big") <= 3 * 18 for s in streams)
    assert flac.seek(streams[5], 1000, 3000) == own[5][1000:4000]


def without_seek(s):
    size = int.from_bytes(s[43:46], "big")
    return s[:4] + bytes([0x80]) + s[5:42] + s[46 + size :]


def test_scan_without_seek_points():
    own = payloads()
    assert flac.decode([without_seek(s) for s in flac.encode(own)]) == own


def test_damage_is_found():
    (s,) = flac.encode(payloads()[5:6])
    for at in (60, len(s) // 2, len(s) - 1):
        b = bytearray(s)
        b[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(b)])


def test_escape_and_wide_parameters():
    # two residual codings that the encoder never picks, written bit by bit
    def frame(bits):
        body = flac._header(0) + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
        a = np.frombuffer(body, np.uint8)
        c = int(flac._crc16(a, np.array([0]), np.array([len(a)]))[0])
        return np.frombuffer(body + c.to_bytes(2, "big"), np.uint8)

    want = [(i * 7) % 16 - 8 for i in range(576)]
    escaped = frame("00010000" + "00" + "0000" + "1111" + "00101" + "".join(format(v & 31, "05b") for v in want))
    zig = [(v << 1) ^ (v >> 31) for v in want]
    wide = frame("00010000" + "01" + "0000" + "00001" + "".join("0" * (u >> 1) + "1" + str(u & 1) for u in zig))
    long = frame("00010000" + "00" + "0000" + "0000" + "".join("0" * u + "1" for u in [200, 64, *[0] * 574]))
    for data, out in ((escaped, want), (wide, want), (long, [100, 32, *[0] * 574])):
        x, n = flac.decode_frames(data, np.array([0]), np.array([len(data)]))
        assert x[0].tolist() == out and n[0] == 0

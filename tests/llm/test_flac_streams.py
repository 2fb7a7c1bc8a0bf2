"""Streams of a plain bit-by-bit writer, with what this package's encoder doesn't write."""

import hashlib
import random
import struct

import numpy as np
import pytest

from lantern.llm import flac, media

BLOCK = flac.BLOCK


class Bits:
    def __init__(self):
        self.s = []

    def put(self, value, n):
        self.s.append(format(value & (1 << n) - 1, f"0{n}b") if n else "")

    def unary(self, n):
        self.s.append("0" * n + "1")

    def bytes(self):
        s = "".join(self.s)
        s += "0" * (-len(s) % 8)
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8))


def crc(raw, poly, bits):
    c = 0
    for b in raw:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & ((1 << bits) - 1) if c >> (bits - 1) & 1 else c << 1 & ((1 << bits) - 1)
    return c


def subframe(x, r, kind, method, parts_log, escape, wasted):
    """Bits of one subframe of samples ``x``, multiples of 2^wasted."""
    out, size = Bits(), 8 - wasted
    x = [v >> wasted for v in x]
    order = {"verbatim": 0, "lpc": 3}.get(kind, r.randint(0, 4))
    code = {"verbatim": 1, "lpc": 32 + order - 1}.get(kind, 8 + order)
    out.put(code << 1 | (wasted > 0), 8)
    if wasted:
        out.unary(wasted - 1)
    if kind == "verbatim":
        for v in x:
            out.put(v, size)
        return out
    for v in x[:order]:
        out.put(v, size)
    if kind == "lpc":
        weights, shift = [r.randint(-200, 200) for _ in range(order)], r.randint(3, 9)
        out.put(9 - 1, 4)
        out.put(shift, 5)
        for w in weights:
            out.put(w, 9)
        residual = [x[j] - (sum(w * x[j - 1 - i] for i, w in enumerate(weights)) >> shift) for j in range(order, BLOCK)]
    else:
        d = list(x)
        for _ in range(order):
            d = [b - a for a, b in zip(d, d[1:])]
        residual = d
    out.put(method, 2)
    out.put(parts_log, 4)
    at = 0
    for part in range(1 << parts_log):
        n = (BLOCK >> parts_log) - (order if part == 0 else 0)
        own, at = residual[at : at + n], at + n
        if escape and r.random() < 0.5:
            bits = max([v.bit_length() + 1 for v in map(lambda v: v if v >= 0 else ~v, own)], default=0) if any(own) else 0
            out.put((16 << method) - 1, 4 + method)
            out.put(bits, 5)
            for v in own:
                out.put(v, bits)
        else:
            mean = sum(abs(v) for v in own) / max(1, len(own))
            k = max(0, int(mean).bit_length() + r.choice([0, 1]))
            out.put(k, 4 + method)
            for v in own:
                u = v << 1 if v >= 0 else (~v << 1) | 1
                out.unary(u >> k)
                out.put(u, k)
    return out


def stream(samples, r, **choice):
    """A stream of frames with a seek point at each third one."""
    frames = []
    for n in range(0, len(samples), BLOCK):
        x = samples[n : n + BLOCK]
        number = n // BLOCK
        head = bytes([0xFF, 0xF8, 0x20, 0x02]) + (bytes([number]) if number < 128 else bytes([0xC0 | number >> 6, 0x80 | number & 63]))
        body = head + bytes([crc(head, 7, 8)]) + subframe(x, r, **choice).bytes()
        frames.append(body + struct.pack(">H", crc(body, 0x8005, 16)))
    ends = np.cumsum([0] + [len(f) for f in frames])
    points = b"".join(struct.pack(">QQH", k * BLOCK, int(ends[k]), BLOCK) for k in range(0, len(frames), 3))
    raw = np.array(samples, np.int8).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + (8000 << 44 | 7 << 36 | len(raw)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x04\x00\x00\x02ab" + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(frames)


@pytest.mark.parametrize("kind", ["fixed", "lpc", "verbatim"])
@pytest.mark.parametrize("method,parts_log,escape,wasted", [(0, 0, False, 0), (0, 3, False, 0), (1, 2, False, 0), (0, 4, True, 0), (1, 6, True, 0), (0, 1, True, 2), (1, 0, False, 5)])
def test_reads_other_writers(kind, method, parts_log, escape, wasted):
    r = random.Random(repr((kind, method, parts_log, escape, wasted)))
    walk, samples = 0, []
    for _ in range(BLOCK * 7):
        walk = max(-100, min(100, walk + r.randint(-9, 9)))
        samples.append(walk >> wasted << wasted)
    samples[:BLOCK] = [0] * BLOCK
    streams = [stream(samples, r, kind=kind, method=method, parts_log=parts_log, escape=escape, wasted=wasted) for _ in range(3)]
    want = bytes(v + 128 for v in samples)
    assert [x.tobytes() for x in flac.decode(streams)] == [want] * 3
    at, got = flac.decode_from(streams[0], BLOCK * 4 + 5, 2)
    assert at == BLOCK * 4 and got.tobytes() == want[at : at + 2 * BLOCK]


def test_all_kinds_of_damage_raise_one_error():
    text = media.payload("Some text with numbers 123 and more. " * 300)
    good, r = flac.encode([text])[0], random.Random(4)
    for k in range(400):
        broken = bytearray(good)
        if k % 3 == 0:
            broken = broken[: r.randrange(len(good))]
        elif k % 3 == 1:
            at = r.randrange(len(good))
            broken[at] ^= 1 << r.randrange(8)
        else:
            a = r.randrange(len(good))
            broken[a : a + r.randint(1, 40)] = bytes(r.randrange(256) for _ in range(r.randint(0, 40)))
        if bytes(broken) == good:
            continue
        try:
            got = flac.decode([bytes(broken)])
        except flac.FlacError:
            continue
        # Sizes of frames, the sample rate and seek points' lengths are only told, not used.
        assert got[0].tobytes() == text and len(broken) == len(good)


def test_the_encoder_chooses_linear_predictors():
    x = np.arange(BLOCK * 20)
    wave = (128 + 60 * np.sin(x / 3) + 50 * np.sin(x / 7.3)).astype(np.uint8).tobytes()
    kinds = set()
    before = flac._residual

    def spy(reader, at, rows, order):
        kinds.add(order)
        return before(reader, at, rows, order)

    flac._residual = spy
    try:
        assert flac.decode(flac.encode([wave]))[0].tobytes() == wave
    finally:
        flac._residual = before
    assert flac.LPC_ORDER in kinds
    chosen = flac.encode([wave])[0]
    assert len(chosen) < 0.8 * len(flac.encode([wave], ([2, -1], 4, 0))[0])


def test_long_streams_come_in_parts():
    r = np.random.default_rng(3)
    raw = media.payload("".join(chr(97 + k) for k in r.integers(0, 26, 200_000)))
    streams = flac.encode([raw, media.payload("short"), media.payload(None)])
    parts = list(flac.decoded(streams, group_bytes=9000))
    assert len(parts) > 12 and [p[3] for p in parts[-2:]] == [True, True] and sum(p[3] for p in parts) == 3
    for k, want in enumerate([raw, media.payload("short"), media.payload(None)]):
        own = [(s, x) for j, s, x, _ in parts if j == k]
        assert b"".join(x.tobytes() for _, x in own) == want
        assert [s for s, _ in own] == np.cumsum([0] + [len(x) for _, x in own])[:-1].tolist()


def test_features_by_definition():
    def plain(raw):
        x = [b - 128 for b in raw]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        return f"n={len(x)};energy={sum(v * v for v in x)};peak={max(map(abs, x), default=0)};crossings={turns}"

    r = random.Random(8)
    for n in (1, 2, 577, 3000):
        raw = bytes(r.randrange(256) for _ in range(n))
        x, whole = np.frombuffer(raw, np.uint8), media.Feature()
        for k in range(0, n, 576):
            whole.update(x[k : k + 576])
        assert str(whole) == media.feature(x) == plain(raw)

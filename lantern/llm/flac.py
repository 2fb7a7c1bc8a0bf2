"""FLAC streams of 8-bit mono samples, encoded and decoded many frames at once.

Frames hold 576 samples.  The encoder picks for each frame a constant, a
verbatim, a fixed-predictor (orders 0 to 4) or a general linear-predictor
subframe (of order ``LPC_ORDER``, from the frame's autocorrelation), whichever
promises to be the smallest, with Rice-coded residuals.  The decoder reads all
of these, residuals in any number of partitions, with parameters of four or five
bits or escaped, and wasted bits; it checks the CRC-8 of headers, the CRC-16 of
whole frames and the MD5 of the samples, and starts at any seek point: the seek
table names every ``SEEK_FRAMES``-th frame with its sample number and byte offset.

Codes are found in lock-step over independent chains of frames (one for each
seek point of each stream), so arrays, not samples, are what Python handles.
Chains go in groups of a bounded number of stream bytes, so a stream of any
length is decoded in bounded memory.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

BLOCK = 576
SEEK_FRAMES = 4
RATE = 8000
_CHUNK = 2048
LPC_ORDER, LPC_BITS = 6, 12
#: Stream bytes that are decoded at once.
GROUP_BYTES = 1 << 21

CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32


class FlacError(ValueError):
    """A stream that isn't what this decoder reads, or a checksum that fails."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & ((1 << bits) - 1) if c >> (bits - 1) & 1 else c << 1 & ((1 << bits) - 1)
        out[b] = c
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(flat: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of the slices flat[start : start + size]; zeros ahead change none."""
    crc = np.zeros(len(start), np.uint32)
    most = int(size.max(initial=0))
    table, top, keep = (_CRC8, 0, 0xFF) if bits == 8 else (_CRC16, 8, 0xFFFF)
    shift = np.uint32(top)
    first = start + size - most
    full = int(size.min(initial=0))
    for j in range(most):
        at = first + j
        byte = flat[np.maximum(at, 0)]
        if j < most - full:
            byte = np.where(at >= start, byte, 0)
        crc = (crc << np.uint32(8) & np.uint32(keep)) ^ table[(crc >> shift ^ byte) & np.uint32(0xFF)] if bits == 16 else table[crc ^ byte]
    return crc


def _coded_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 manner: bytes (rows of 7) and lengths."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26, n < 1 << 31], [1, 2, 3, 4, 5, 6], 7)
    out = np.zeros((len(n), 7), np.uint8)
    for k in np.unique(size).tolist():
        rows = np.flatnonzero(size == k)
        if k == 1:
            out[rows, 0] = n[rows]
            continue
        out[rows, 0] = (0xFF00 >> k & 0xFF) | (n[rows] >> (6 * (k - 1)))
        for j in range(1, k):
            out[rows, j] = 0x80 | (n[rows] >> (6 * (k - 1 - j)) & 63)
    return out, size


def _packed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (value, bits) codes as bytes; each row ends on a whole byte."""
    bits = sizes.sum(axis=1)
    row_bytes = (bits + 7) >> 3
    base = np.concatenate(([0], np.cumsum(row_bytes)))
    last = (np.cumsum(sizes, axis=1) + (base[:-1] * 8)[:, None]).ravel() - 1
    v = values.ravel().astype(np.uint64)
    shift = (63 - (last & 63)).astype(np.uint64)
    word = last >> 6
    cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros((int(base[-1]) + 7 >> 3) + 1, np.uint64)
    words[word[cut]] = np.bitwise_or.reduceat(v << shift, cut)
    spill = np.where(shift > 0, v >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    over = np.flatnonzero(spill)
    words[word[over] - 1] |= spill[over]
    return words.byteswap().view(np.uint8)[: base[-1]], row_bytes


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values, the best parameter of each row, and bits with it."""
    r = residual.astype(np.int32)
    u = (r << 1 ^ r >> 31).astype(np.uint32)
    mean = u.mean(axis=1, dtype=np.float64)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1.0))).astype(np.int64), 0, 13)
    best, cost = guess, None
    for k in (guess - 1, guess, guess + 1):
        k = np.clip(k, 0, 14)
        bits = (u >> k.astype(np.uint32)[:, None]).sum(axis=1, dtype=np.int64) + u.shape[1] * (k + 1)
        best, cost = (k, bits) if cost is None else (np.where(bits < cost, k, best), np.minimum(bits, cost))
    return u, best, cost


_PRICE = np.array([2 ** ((LPC_ORDER * (LPC_BITS + 8) + 9 - 8 * p) / (BLOCK - LPC_ORDER)) for p in range(5)])


def _predictors(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors of all rows: weights (rows, LPC_ORDER) and shifts."""
    x = frames.astype(np.float64)
    auto = np.stack([np.einsum("ij,ij->i", x[:, : BLOCK - k], x[:, k:]) for k in range(LPC_ORDER + 1)], axis=1)
    weights, error = np.zeros((len(x), LPC_ORDER)), auto[:, 0] * (1 + 1e-9) + 1e-9
    for k in range(LPC_ORDER):  # Levinson and Durbin
        turn = (auto[:, k + 1] - sum(weights[:, j] * auto[:, k - j] for j in range(k))) / error
        weights[:, :k] -= turn[:, None] * weights[:, :k][:, ::-1]
        weights[:, k] = turn
        error = np.maximum(error * (1 - turn * turn), 1e-9)
    most = np.maximum(np.abs(weights).max(axis=1), 1e-9)
    down = np.clip(LPC_BITS - 1 - np.frexp(most)[1].astype(np.int64), 0, 15)
    limit = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(weights * (1 << down)[:, None]), -limit, limit - 1).astype(np.int64), down


def _residuals_of(frames: np.ndarray, weights: np.ndarray, down: np.ndarray) -> np.ndarray:
    p, x = weights.shape[1], frames.astype(np.int32)
    guess = sum(weights[:, j : j + 1].astype(np.int32) * x[:, p - 1 - j : BLOCK - 1 - j] for j in range(p)) >> down[:, None].astype(np.int32)
    return x[:, p:] - guess


def _bodies(frames: np.ndarray, lpc: tuple[list[int], int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of all rows (int16), as one byte string and lengths.

    ``lpc`` (weights, precision, shift) is taken for every frame, where given.
    """
    n = len(frames)
    differences = [frames.astype(np.int32)]
    for _ in range(4):
        differences.append(np.diff(differences[-1], axis=1))
    sums = np.stack([np.abs(d[:, 4 - k :]).sum(axis=1) for k, d in enumerate(differences)])
    order = np.argmin(sums, axis=0)
    constant = (frames == frames[:, :1]).all(axis=1)
    out: list[np.ndarray | None] = [None] * n
    sizes = np.zeros(n, np.int64)

    def put(rows: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        body, size = _packed(values, bits)
        ends = np.cumsum(size)
        for r, a, b in zip(rows.tolist(), (ends - size).tolist(), ends.tolist()):
            out[r] = body[a:b]
        sizes[rows] = size

    def coded(rows: np.ndarray, kind: int, warm: int, extra: list[tuple[int | np.ndarray, int]], residual: np.ndarray) -> np.ndarray:
        u, k, bits = _rice(residual)
        # A long run of zeros ahead of a code must fit a word.
        plain = (bits + 8 * warm + 18 + sum(b for _, b in extra) >= 8 * BLOCK + 8) | ((u >> k.astype(np.uint32)[:, None]).max(axis=1, initial=0) > 4000)
        go = np.flatnonzero(~plain)
        if len(go):
            k = k[go].astype(np.uint32)
            head = [(np.full(len(go), kind << 1), 8)] + [(frames[rows[go], j] & 0xFF, 8) for j in range(warm)]
            head += [(np.full(len(go), v) if np.ndim(v) == 0 else v[go], b) for v, b in extra] + [(k, 10)]
            low = u[go] & ((np.uint32(1) << k[:, None]) - np.uint32(1)) | np.uint32(1) << k[:, None]
            values = np.concatenate([np.stack([h[0] for h in head], axis=1).astype(np.uint64), low.astype(np.uint64)], axis=1)
            widths = np.concatenate([np.tile(np.array([h[1] for h in head], np.int64), (len(go), 1)), (u[go] >> k[:, None]).astype(np.int64) + 1 + k.astype(np.int64)[:, None]], axis=1)
            put(rows[go], values, widths)
        return rows[plain]

    def predicted(rows: np.ndarray, weights: np.ndarray, precision: int, down: np.ndarray, residual: np.ndarray) -> np.ndarray:
        p = weights.shape[1]
        extra = [(precision - 1, 4), (down, 5), *((weights[:, j] & (1 << precision) - 1, precision) for j in range(p))]
        return coded(rows, LPC + p - 1, p, extra, residual)

    raw, rows = [], np.flatnonzero(~constant)
    if lpc is not None:
        if len(rows):
            weights, down = np.tile(np.array(lpc[0], np.int64), (len(rows), 1)), np.full(len(rows), lpc[2])
            raw.append(predicted(rows, weights, lpc[1], down, _residuals_of(frames[rows], weights, down)))
    elif len(rows):
        weights, down = _predictors(frames[rows])
        residual = _residuals_of(frames[rows], weights, down)
        # A predictor must win back, in bits a residual, what its header takes.
        better = np.abs(residual).sum(axis=1) * _PRICE[order[rows]] < sums[order[rows], rows]
        pick = np.flatnonzero(better)
        if len(pick):
            raw.append(predicted(rows[pick], weights[pick], LPC_BITS, down[pick], residual[pick]))
        rest = rows[~better]
        for p in range(5):
            own = rest[order[rest] == p]
            if len(own):
                raw.append(coded(own, FIXED + p, p, [], differences[p][own]))
    rows = np.concatenate(raw) if raw else np.zeros(0, np.int64)
    if len(rows):
        put(rows, np.concatenate([np.full((len(rows), 1), VERBATIM << 1), frames[rows] & 0xFF], axis=1), np.full((len(rows), BLOCK + 1), 8, np.int64))
    rows = np.flatnonzero(constant)
    if len(rows):
        put(rows, np.stack([np.full(len(rows), CONSTANT << 1), frames[rows, 0] & 0xFF], axis=1), np.full((len(rows), 2), 8, np.int64))
    return np.concatenate(out), sizes


def _frames(samples: np.ndarray, numbers: np.ndarray, lpc) -> tuple[np.ndarray, np.ndarray]:
    """Whole frames as one byte string, and their lengths."""
    body, size = _bodies(samples, lpc)
    coded, width = _coded_numbers(numbers)
    head = width + 5
    total = head + size + 2
    start = np.concatenate(([0], np.cumsum(total)))
    flat = np.zeros(start[-1], np.uint8)
    at = start[:-1]
    for j, b in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        flat[at + j] = b
    for j in range(int(width.max())):
        rows = np.flatnonzero(width > j)
        flat[at[rows] + 4 + j] = coded[rows, j]
    flat[at + 4 + width] = _crc(flat, at, width + 4, 8)
    offset = np.concatenate(([0], np.cumsum(size)))
    flat[np.repeat(at + head - offset[:-1], size) + np.arange(len(body))] = body
    crc = _crc(flat, at, head + size, 16)
    flat[at + head + size], flat[at + head + size + 1] = crc >> 8, crc & 0xFF
    return flat, total


def encode(payloads: list[bytes], lpc: tuple[list[int], int, int] | None = None) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of 576 bytes)."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError("payloads must be positive multiples of the block size")
    every = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    first = np.concatenate(([0], np.cumsum(counts)))
    numbers = np.arange(len(every)) - np.repeat(first[:-1], counts)
    parts, sizes = [], []
    for k in range(0, len(every), _CHUNK):
        flat, total = _frames(every[k : k + _CHUNK].astype(np.int16) - 128, numbers[k : k + _CHUNK], lpc)
        parts.append(flat)
        sizes.append(total)
    flat, size = (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    ends = np.concatenate(([0], np.cumsum(size)))
    out = []
    for k, payload in enumerate(payloads):
        a, b = first[k], first[k + 1]
        own = size[a:b]
        points = b"".join(struct.pack(">QQH", j * BLOCK, int(ends[a + j] - ends[a]), BLOCK) for j in range(0, int(b - a), SEEK_FRAMES))
        signed = every[a:b] ^ np.uint8(128)  # as signed bytes
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = [points[j : j + _TABLE] for j in range(0, len(points), _TABLE)]  # a block's length has 24 bits
        tables = b"".join(bytes([0x83 if j + 1 == len(table) else 0x03]) + len(t).to_bytes(3, "big") + t for j, t in enumerate(table))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + tables + flat[ends[a] : ends[b]].tobytes())
    return out


_TABLE = 18 * 900_000


def seek_points(stream: bytes) -> tuple[int, list[tuple[int, int]], bytes]:
    """Samples in all, (sample, place in the stream) of the seek points, MD5."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, total, md5, points = 4, False, -1, b"", []
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the metadata run past the end")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size or kind == 0 and size != 34 or kind == 3 and size % 18:
            raise FlacError("a metadata block has a wrong length")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if struct.unpack(">HH", body[:4]) != (BLOCK, BLOCK) or packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise FlacError("not 8-bit mono in blocks of 576")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points += [struct.unpack(">QQH", body[j : j + 18])[:2] for j in range(0, size, 18)]
        at += 4 + size
    if total < 0 or total % BLOCK or bool(total) != bool(points):
        raise FlacError("no stream information, or no seek table")
    places = [(s, at + o) for s, o in points]
    if places and (places[0] != (0, at) or any(s % BLOCK or s >= total for s, _ in places) or any(x >= y for a, b in zip(places, places[1:]) for x, y in zip(a, b)) or places[-1][1] >= len(stream)):
        raise FlacError("a seek table out of order")
    return total, places, md5


class _Reader:
    """Bits of one byte string, at many places at once."""

    def __init__(self, flat: np.ndarray):
        padded = np.concatenate((flat, np.zeros(16, np.uint8))).astype(np.uint64)
        n = len(flat) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + n] << np.uint64(56 - 8 * j)
        self.end = len(flat) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(pos >> 3, len(self.words) - 1)] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, bits: int) -> np.ndarray:
        return (self.window(pos) >> np.uint64(64 - bits)).astype(np.int64)

    def taken(self, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """As many bits (1 to 32) at each place as ``bits`` says."""
        return (self.window(pos) >> (np.uint64(64) - bits.astype(np.uint64))).astype(np.int64)

    def rice(self, pos: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code at each place: signed values and the places after."""
        w = self.window(pos)
        top = w >> np.uint64(32)
        zeros = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        slow = np.flatnonzero(top == 0)
        if len(slow):
            q, at = np.full(len(slow), 32, np.int64), pos[slow] + 32
            live = np.arange(len(slow))
            while len(live):
                if (at[live] > self.end).any():
                    raise FlacError("a code runs past the end")
                t = self.window(at[live]) >> np.uint64(32)
                z = 32 - np.frexp(t.astype(np.float64))[1].astype(np.int64)
                q[live] += z
                at[live] += z
                live = live[t == 0]
            zeros = zeros.copy()
            zeros[slow] = q
        pos = pos + zeros + 1
        low = (self.window(pos) >> np.uint64(1) >> (np.uint64(63) - k.astype(np.uint64))).astype(np.int64)
        u = zeros << k | low
        return u >> 1 ^ -(u & 1), pos + k


def _signed(v: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def _residual(reader: _Reader, at: np.ndarray, x: np.ndarray, order: int) -> np.ndarray:
    """Fills x[order:] with residuals, a column for each place; returns the places after."""
    head, after = reader.take(at, 6), at + 6
    for kind in np.unique(head).tolist():
        method, parts = kind >> 4, 1 << (kind & 15)
        if method > 1 or BLOCK % parts or BLOCK // parts < order:
            raise FlacError("a reserved residual coding, or partitions that don't fit")
        own = np.flatnonzero(head == kind)
        pos, bits, escape = after[own], 4 + method, (16 << method) - 1
        out = x if len(own) == x.shape[1] else np.zeros((BLOCK, len(own)), np.int64)
        for part in range(parts):
            k, pos = reader.take(pos, bits), pos + bits
            low, high = max(order, part * (BLOCK // parts)), (part + 1) * (BLOCK // parts)
            plain = k == escape
            if not plain.any():
                for j in range(low, high):
                    out[j], pos = reader.rice(pos, k)
                continue
            coded, raw = np.flatnonzero(~plain), np.flatnonzero(plain)
            width = reader.take(pos[raw], 5)
            pos[raw] += 5
            for j in range(low, high):
                if len(coded):
                    out[j, coded], pos[coded] = reader.rice(pos[coded], k[coded])
                out[j, raw] = np.where(width > 0, _signed(reader.taken(pos[raw], np.maximum(width, 1)), np.maximum(width, 1)), 0)
                pos[raw] += width
        if out is not x:
            x[order:, own] = out[order:]
        after[own] = pos
    return after


def _subframes(reader: _Reader, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (rows of 576) and the places after, one subframe at each place."""
    kind, pos = reader.take(pos, 8), pos + 8
    if (kind & 0x80).any():
        raise FlacError("a reserved bit in a subframe")
    wasted = np.zeros(len(pos), np.int64)
    some = np.flatnonzero(kind & 1)
    if len(some):
        zeros = 64 - np.frexp((reader.window(pos[some]) >> np.uint64(48)).astype(np.float64))[1].astype(np.int64) - 48
        wasted[some] = zeros + 1
        if (wasted > 7).any():
            raise FlacError("more wasted bits than a sample has")
        pos = pos + wasted
    kind = (kind >> 1) * 8 + wasted
    out, after = np.zeros((len(pos), BLOCK), np.int64), pos.copy()
    for both in np.unique(kind).tolist():
        t, lost = divmod(both, 8)
        rows, size = np.flatnonzero(kind == both), 8 - lost
        at = pos[rows]
        if t == CONSTANT:
            out[rows] = _signed(reader.take(at, size), size)[:, None] << lost
            after[rows] = at + size
            continue
        if t == VERBATIM:
            out[rows] = _signed(np.stack([reader.take(at + size * j, size) for j in range(BLOCK)], axis=1), size) << lost
            after[rows] = at + size * BLOCK
            continue
        if not (FIXED <= t <= FIXED + 4 or t >= LPC):
            raise FlacError("a reserved subframe type")
        order = t - FIXED if t < LPC else t - LPC + 1
        x = np.zeros((BLOCK, len(rows)), np.int64)
        for j in range(order):
            x[j] = _signed(reader.take(at + size * j, size), size)
        at = at + size * order
        if t >= LPC:
            precision, down = reader.take(at, 4) + 1, _signed(reader.take(at + 4, 5), 5)
            if (precision == 16).any() or (down < 0).any():
                raise FlacError("a reserved predictor precision or a negative shift")
            at = at + 9
            weights = np.zeros((order, len(rows)), np.int64)
            for j in range(order):
                weights[order - 1 - j] = _signed(reader.taken(at, precision), precision)
                at = at + precision
        at = _residual(reader, at, x, order)
        if t >= LPC:
            for j in range(order, BLOCK):
                x[j] += np.einsum("ij,ij->j", weights, x[j - order : j]) >> down
        elif order:
            # Undo the differences one by one, each from its warm-up value.
            warm = [np.diff(x[:order], n=d, axis=0)[-1] for d in range(order)]
            rest = x[order:]
            for d in range(order - 1, -1, -1):
                rest = warm[d] + np.cumsum(rest, axis=0)
            x[order:] = rest
        out[rows], after[rows] = (x << lost).T, at
    return out, after


def _chains(flat: np.ndarray, start: np.ndarray, number: np.ndarray, frames: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Samples of chains of frames, one after the other, as signed bytes; a chain ends at ``stop``."""
    reader, place = _Reader(flat), start.copy()
    first = np.concatenate(([0], np.cumsum(frames)))
    out = np.zeros((first[-1], BLOCK), np.int8)
    for step in range(int(frames.max(initial=0))):
        live = np.flatnonzero(frames > step)
        at = place[live]
        coded, width = _coded_numbers(number[live] + step)
        if (at + width + 8 > stop[live]).any():
            raise FlacError("a frame runs past the end")
        for j, b in enumerate((0xFF, 0xF8, 0x20, 0x02)):
            if (flat[at + j] != b).any():
                raise FlacError("no frame where one should begin")
        for j in range(int(width.max())):
            rows = np.flatnonzero(width > j)
            if (flat[at[rows] + 4 + j] != coded[rows, j]).any():
                raise FlacError("a frame has another number")
        if (_crc(flat, at, width + 4, 8) != flat[at + 4 + width]).any():
            raise FlacError("the checksum of a frame header fails")
        samples, after = _subframes(reader, (at + width + 5) * 8)
        end = (after + 7) >> 3
        if (end + 2 > stop[live]).any():
            raise FlacError("a frame runs past the end")
        if (_crc(flat, at, end - at, 16) != (flat[end].astype(np.uint32) << 8 | flat[end + 1])).any():
            raise FlacError("the checksum of a frame fails")
        out[first[live] + step] = samples
        place[live] = end + 2
    if (place != stop).any():
        raise FlacError("bytes between frames")
    return out


def decoded(streams: list[bytes], group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(stream, first sample, payload bytes, whether it is complete) in order, in parts that seek points begin.

    A stream's MD5 is checked before its last part is handed out.
    """
    held: list[tuple[int, int, int, int, int]] = []  # stream, sample, frames, place, past
    size, facts = 0, [seek_points(s) for s in streams]
    sums = {}

    def out() -> Iterator[tuple[int, int, np.ndarray, bool]]:
        flat = np.frombuffer(b"".join(streams[k][a:b] for k, _, _, a, b in held), np.uint8)
        stop = np.cumsum([b - a for *_, a, b in held])
        start = stop - np.array([b - a for *_, a, b in held])
        frames = np.array([n for _, _, n, _, _ in held], np.int64)
        got = _chains(flat, start, np.array([s // BLOCK for _, s, _, _, _ in held], np.int64), frames, stop)
        at = 0
        for k in dict.fromkeys(h[0] for h in held):
            own = [h for h in held if h[0] == k]
            n = sum(h[2] for h in own)
            part, at = got[at : at + n].reshape(-1), at + n
            sums.setdefault(k, hashlib.md5()).update(part)
            done = own[-1][4] == len(streams[k])
            if done and sums.pop(k).digest() != facts[k][2]:
                raise FlacError("the samples' MD5 fails")
            yield k, own[0][1], part.view(np.uint8) ^ np.uint8(128), done

    for k, (total, points, md5) in enumerate(facts):
        if not total:
            if held:
                yield from out()
                held, size = [], 0
            if md5 != hashlib.md5().digest():
                raise FlacError("the samples' MD5 fails")
            yield k, 0, np.zeros(0, np.uint8), True
        for (sample, place), (after, past) in zip(points, [*points[1:], (total, len(streams[k]))]):
            if held and size + past - place > group_bytes:
                yield from out()
                held, size = [], 0
            held.append((k, sample, (after - sample) // BLOCK, place, past))
            size += past - place
    if held:
        yield from out()


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The payload bytes of each stream, checked against its MD5."""
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for k, _, x, _ in decoded(streams):
        parts[k].append(x)
    return [np.concatenate(p) for p in parts]


def decode_from(stream: bytes, sample: int, blocks: int = 1) -> tuple[int, np.ndarray]:
    """Seek: the first sample and the bytes of ``blocks`` blocks at ``sample``; only the chains that hold them are read."""
    total, points, _ = seek_points(stream)
    if not 0 <= sample < total:
        raise FlacError("no such sample")
    number = sample // BLOCK
    last = min(number + blocks, total // BLOCK)
    bounds = [*points, (total, len(stream))]
    own = [(a, b) for a, b in zip(bounds, bounds[1:]) if b[0] > number * BLOCK and a[0] < last * BLOCK]
    base, past = own[0][0][1], own[-1][1][1]
    flat = np.frombuffer(stream[base:past], np.uint8)
    columns = np.array([(a[1] - base, a[0] // BLOCK, (b[0] - a[0]) // BLOCK, b[1] - base) for a, b in own], np.int64)
    skip = number - own[0][0][0] // BLOCK
    got = _chains(flat, *columns.T)[skip : skip + last - number]
    return number * BLOCK, got.reshape(-1).view(np.uint8) ^ np.uint8(128)

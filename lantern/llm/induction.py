"""External induced suffix sorting with common-prefix values.

``repeated`` finds, in a byte string, every position whose next ``depth`` bytes
also start elsewhere.  It builds the suffix order by induction:

* suffixes are typed, and the left-most S-type ones (LMS) sorted by substring
  through one round of induction, then named;
* the reduced string of names is ordered by the same induction, recursively
  (:func:`order_of`).  Its alphabet is large, so tuples (symbol, position) go
  through a disk-backed priority queue keyed by (symbol, arrival), which hands
  them out a range of symbols at a time (:class:`Heap`), until what is left to
  order fits in memory;
* a second round induces all suffixes from the LMS ones.  Tuples (position,
  common prefix with the one before) travel through one first-in-first-out
  queue for each symbol, which is what a priority queue keyed by (symbol,
  arrival) is for bytes.  A queue holds a bounded part in memory and spills the
  rest to a file.  The common prefix of two induced suffixes is one more than
  the least of those between the suffixes that induced them (range minima over
  a block, a pending minimum for each symbol between blocks).

Work goes in blocks, runs of the order are handed on one by one, and every array
that is as long as the string or its LMS suffixes is a file mapped into memory
once it exceeds ``Budget.array_bytes``: what a task holds of its own is bounded
by the budget rather than by the string.  These files belong to one attempt of
one task and are gone when it ends; nothing else reads them, so a lost executor
costs a retry of the task.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


class Budget:
    """Where arrays and queues go: memory up to so many bytes each, then files."""

    def __init__(self, array_bytes: int = 1 << 25, queue_bytes: int = 1 << 25, block: int = 1 << 17):
        self.array_bytes, self.queue_bytes, self.block = array_bytes, queue_bytes, block
        self.held = 0
        self._folder: tempfile.TemporaryDirectory | None = None
        self._file = None

    def folder(self) -> str:
        if self._folder is None:
            # Spark's own spill folders, where the cluster manager names them.
            place = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self._folder = tempfile.TemporaryDirectory(prefix="induction-", dir=place if place and os.path.isdir(place) else None)
        return self._folder.name

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.array_bytes or n == 0:
            return np.empty(n, dtype)
        handle, path = tempfile.mkstemp(dir=self.folder())
        os.close(handle)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps it until the array goes
        return out

    def parts(self, n: int) -> Iterator[slice]:
        for at in range(0, n, self.block):
            yield slice(at, min(n, at + self.block))

    def spill(self, *arrays: np.ndarray) -> list[tuple]:
        if self._file is None:
            self._file = tempfile.TemporaryFile(dir=self.folder(), buffering=0)
        places = []
        for a in arrays:
            self._file.seek(0, os.SEEK_END)
            places.append((self._file.tell(), len(a), a.dtype))
            self._file.write(np.ascontiguousarray(a).tobytes())
        return places

    def load(self, places: list[tuple]) -> list[np.ndarray]:
        found = []
        for at, n, dtype in places:
            self._file.seek(at)
            found.append(np.frombuffer(self._file.read(n * dtype.itemsize), dtype))
        return found

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        if self._folder is not None:
            self._folder.cleanup()


class Queue:
    """First in, first out, of (positions, prefixes) runs; spills by the budget.

    ``pop_last`` takes from the other end instead.
    """

    def __init__(self, budget: Budget):
        self.budget, self.runs, self.first = budget, [], 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        b, size = self.budget, pos.nbytes + lcp.nbytes
        if b.held + size > b.queue_bytes:
            self.runs.append((len(pos), 0, b.spill(pos, lcp)))
        else:
            b.held += size
            # Copies: a view would keep the whole block it was cut from.
            self.runs.append((len(pos), size, [np.array(pos), np.array(lcp)]))

    def _take(self, k: int) -> list[np.ndarray]:
        _, here, run = self.runs[k]
        self.runs[k] = None
        self.budget.held -= here
        return run if here else self.budget.load(run)

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest runs, up to a block (or one larger run)."""
        if self.first == len(self.runs):
            return None
        got, n = [], 0
        while self.first < len(self.runs) and (not got or n + self.runs[self.first][0] <= self.budget.block):
            n += self.runs[self.first][0]
            got.append(self._take(self.first))
            self.first += 1
        return np.concatenate([r[0] for r in got]), np.concatenate([r[1] for r in got])

    def pop_last(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The youngest run."""
        if self.first == len(self.runs):
            return None
        got = self._take(len(self.runs) - 1)
        self.runs.pop()
        return got[0], got[1]


def _range_min(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of items low..high (both included, low <= high)."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.uint8)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(tables[k][low[at]], tables[k][high[at] - (1 << int(k)) + 1])
    return out


class _Pass:
    """One direction of induction: takes sources in order, fills the queues."""

    def __init__(self, text, is_s, budget: Budget, depth: int, to_s: bool, with_lcp: bool):
        self.text, self.is_s, self.budget, self.depth, self.to_s, self.with_lcp = text, is_s, budget, depth, to_s, with_lcp
        self.queues = [Queue(budget) for _ in range(256)]
        self.pending = np.zeros(256, np.uint8)

    def take(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for at in range(0, len(pos), self.budget.block):
            self._block(pos[at : at + self.budget.block], lcp[at : at + self.budget.block])

    def _block(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        ok = (before >= 0) & (self.is_s[before] == self.to_s)
        at = np.flatnonzero(ok)
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        cuts = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1]))) if len(at) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(at))
        target = before[at]
        if self.with_lcp:
            tables = [lcp]
            while 2 << (len(tables) - 1) <= len(lcp):
                half = 1 << (len(tables) - 1)
                tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
            whole = lcp.min() if len(lcp) else self.depth
            rest = np.minimum(self.pending, whole)
            if len(at):
                low = np.concatenate(([0], at[:-1] + 1))
                low[cuts] = 0
                least = _range_min(tables, low, at)
                least[cuts] = np.minimum(least[cuts], self.pending[symbol[cuts]])
                new = np.minimum(least, self.depth - 1) + np.uint8(1)
                final = at[ends - 1]
                inner = final + 1 < len(lcp)
                after = np.full(len(final), self.depth, np.uint8)
                if inner.any():
                    f = final[inner] + 1
                    after[inner] = _range_min(tables, f, np.full(len(f), len(lcp) - 1))
                rest[symbol[cuts]] = after
            self.pending = rest
        if len(at) and not self.with_lcp:
            new = np.zeros(len(at), np.uint8)
        for a, b in zip(cuts.tolist(), ends.tolist()):
            self.queues[symbol[a]].push(target[a:b], new[a:b])


class Suffixes:
    def __init__(self, raw: np.ndarray, depth: int, budget: Budget):
        self.n, self.depth, self.budget = len(raw), depth, budget
        self.text = raw
        self.index = np.int32 if self.n < 1 << 31 else np.int64
        self.is_s = budget.array(self.n, np.bool_)
        nxt, tail = False, None
        for part in reversed(list(budget.parts(self.n))):  # from the right, in blocks
            own = raw[part].astype(np.int16)
            sign = np.sign(np.append(own[1:], own[-1] if tail is None else tail) - own)
            if tail is None:
                sign[-1] = -1  # the end is less than any symbol
            known = np.where(sign != 0, np.arange(len(own)), len(own))
            place = np.minimum.accumulate(known[::-1])[::-1]
            self.is_s[part] = np.where(place < len(own), np.append(sign > 0, nxt)[place], nxt)
            nxt, tail = bool(self.is_s[part.start]), own[0]

    def lms(self) -> np.ndarray:
        """Positions of LMS suffixes, in text order."""

        def found() -> Iterator[np.ndarray]:
            for part in self.budget.parts(self.n - 1):
                yield np.flatnonzero(self.is_s[part.start + 1 : part.stop + 1] & ~self.is_s[part]) + (part.start + 1)

        return self._filled(sum(map(len, found())), self.index, found())

    def _filled(self, n: int, dtype, parts: Iterator[np.ndarray]) -> np.ndarray:
        out, at = self.budget.array(n, dtype), 0
        for x in parts:
            out[at : at + len(x)] = x
            at += len(x)
        return out

    def _by_symbol(self, where: np.ndarray) -> np.ndarray:
        """Positions by their symbols, stably: a counting sort in blocks."""
        out, next_ = self.budget.array(len(where), self.index), self._bounds(where)[:-1].copy()
        for part in self.budget.parts(len(where)):
            own = np.asarray(where[part])
            symbol = self.text[own]
            order = np.argsort(symbol, kind="stable")
            counts = np.bincount(symbol, minlength=256)
            start = np.cumsum(counts) - counts
            out[np.repeat(next_ - start, counts) + np.arange(len(own))] = own[order]
            next_ += counts
        return out

    def _bounds(self, where: np.ndarray) -> np.ndarray:
        """Where each symbol's positions begin among those sorted by symbol."""
        counts = np.zeros(256, np.int64)
        for part in self.budget.parts(len(where)):
            counts += np.bincount(self.text[where[part]], minlength=256)
        return np.concatenate(([0], np.cumsum(counts)))

    def words(self) -> np.ndarray:
        """The eight bytes from each position; the string ends in padding."""
        return np.lib.stride_tricks.as_strided(self.padded[:8].view("<u8"), shape=(self.n,), strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
        """Common prefixes, up to the depth, by comparing eight bytes at a time."""
        most = most or self.depth
        found, live = np.full(len(a), most, np.int16), np.arange(len(a))
        words = self.words()
        for off in range(0, most, 8):
            far = np.maximum(a, b)
            d = words[np.minimum(a + off, self.n - 1)] ^ words[np.minimum(b + off, self.n - 1)]
            ended = (d != 0) | (far + (off + 8) > self.n)
            if ended.any():
                e = np.flatnonzero(ended)
                v = d[e]
                low = v & (~v + np.uint64(1))
                byte = np.where(v != 0, (np.frexp(low.astype(np.float64))[1] - 1) // 8, 8)
                # Past the string's end nothing is common.
                found[live[e]] = np.minimum(np.minimum(off + byte, np.maximum(self.n - far[e], 0)), most)
                go = np.flatnonzero(~ended)
                live, a, b = live[go], a[go], b[go]
                if not len(go):
                    break
        return found.astype(np.uint8)

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """The suffix order from its end, in runs of falling suffixes: ("S" or "L", positions, prefixes).

        A prefix is what a suffix has in common with the one before it in this
        falling order; the first of the runs of a symbol has 0.  Without
        ``seed_lcp`` no prefixes are kept.
        """
        with_lcp = seed_lcp is not None
        down = _Pass(self.text, self.is_s, self.budget, self.depth, False, with_lcp)
        up_lists: list[Queue] = [Queue(self.budget) for _ in range(256)]
        bounds = self._bounds(seeds)
        down.take(np.array([self.n], self.index), np.zeros(1, np.uint8))
        for c in range(256):
            last = None
            while (got := down.queues[c].pop()) is not None:
                pos, lcp = got
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                last = pos[-1]
                up_lists[c].push(pos, lcp)
                down.take(pos, lcp)
            for at in range(bounds[c], bounds[c + 1], self.budget.block):
                own = np.asarray(seeds[at : min(bounds[c + 1], at + self.budget.block)])
                lcp = np.array(seed_lcp[at : at + len(own)]) if with_lcp else np.zeros(len(own), np.uint8)
                if at == bounds[c]:
                    lcp[0] = 0 if last is None or not with_lcp else self.common(np.array([last]), own[:1])[0]
                down.take(own, lcp)
        up = _Pass(self.text, self.is_s, self.budget, self.depth, True, with_lcp)
        for c in range(255, -1, -1):
            last = None
            while (got := up.queues[c].pop()) is not None:
                pos, lcp = got
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                last = pos[-1]
                yield "S", pos, lcp
                up.take(pos, lcp)
            follow = None
            while (got := up_lists[c].pop_last()) is not None:
                pos, lcp = got
                if follow is None:
                    follow = int(self.common(pos[-1:], np.array([last]))[0]) if last is not None and with_lcp else 0
                back = np.append(lcp[1:], np.uint8(follow))[::-1]
                yield "L", pos[::-1], back
                up.take(pos[::-1], back)
                follow = lcp[0]

    def _ordered_substrings(self, where: np.ndarray) -> np.ndarray:
        """Numbers of LMS suffixes in the order of their substrings."""
        number = self.budget.array(self.n + 1, self.index)
        number[:] = -1
        for part in self.budget.parts(len(where)):
            number[where[part]] = np.arange(part.start, part.stop, dtype=self.index)
        out, at = self.budget.array(len(where), self.index), len(where)
        for kind, pos, _ in self.induce(self._by_symbol(where), None):
            if kind == "S":
                k = number[pos]
                k = k[k >= 0]
                out[at - len(k) : at] = k[::-1]
                at -= len(k)
        return out

    def _named(self, where: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
        """A name for each LMS substring, by its place in their order; and how many there are."""
        words, count = self.words(), len(where)
        rank, name = self.budget.array(count, np.int64), 0
        for part in self.budget.parts(count - 1):
            both = np.asarray(ordered[part.start : part.stop + 1])
            start = where[both].astype(np.int64)
            size = np.where(both + 1 < count, where[np.minimum(both + 1, count - 1)], self.n) - start + 1
            a, b = start[:-1], start[1:]
            # Nothing equals the last one, which ends with the string.
            last = both == count - 1
            fresh = (size[1:] != size[:-1]) | last[1:] | last[:-1]
            live = np.flatnonzero(~fresh)
            a, b, left = a[live], b[live], size[1:][live]
            while len(live):
                used = np.minimum(left, 8).astype(np.uint64) << np.uint64(3)
                differ = (words[a] ^ words[b]) << (np.uint64(64) - used) != 0
                fresh[live[differ]] = True
                go = np.flatnonzero(~differ & (left > 8))
                live, a, b, left = live[go], a[go] + 8, b[go] + 8, left[go] - 8
            names = name + np.concatenate(([0], np.cumsum(fresh)))
            rank[both] = names
            name = int(names[-1])
        return rank, name + 1

    def sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order (up to the depth) and their common prefixes.

        These are exact where they can matter for the depth, else 0.
        """
        where = self.lms()
        count = len(where)
        if count < 2:
            return where, np.zeros(count, np.uint8)
        rank, names = self._named(where, self._ordered_substrings(where))
        # An LMS substring spans two symbols at least, so so many names reach the depth.
        order = order_of(rank, names, self.budget, self.depth // 2 + 2)
        seeds = self._filled(count, self.index, (where[order[p]] for p in self.budget.parts(count)))
        del rank, order
        lcp = self.budget.array(count, np.uint8)
        lcp[0] = 0
        gaps = (int(np.diff(where[p.start : p.stop + 1]).max(initial=0)) for p in self.budget.parts(count))
        reach, words = max(int(where[0]), *gaps) + 1, self.words()
        probe = self.depth - reach - 8
        for at in range(1, count, self.budget.block):
            stop = min(count, at + self.budget.block)
            a, b = seeds[at - 1 : stop - 1], seeds[at:stop]
            # A suffix lies less than ``reach`` before the LMS one that induces it. Two that differ within the
            # first depth - reach bytes can't bring a pair to the depth, so 0 will do for how far they agree.
            near = np.flatnonzero(words[np.minimum(a + probe, self.n - 1)] == words[np.minimum(b + probe, self.n - 1)]) if probe >= 0 else np.arange(len(a))
            lcp[at:stop] = 0
            lcp[at + near] = self.common(a[near], b[near])
        return seeds, lcp


class Heap:
    """A disk-backed priority queue of (key, position), keyed by (key, arrival), emptied a range of keys at a time.

    ``cuts`` part the keys into ranges.  Entries wait in one spilling queue for
    each group of ranges; those of the group that is being emptied are dealt to
    its ranges in memory.
    """

    def __init__(self, cuts: np.ndarray, budget: Budget):
        self.cuts, self.budget, self.ranges = cuts, budget, len(cuts) + 1
        self.width = max(1, int(self.ranges**0.5))
        self.queues = [Queue(budget) for _ in range(-(-self.ranges // self.width))]
        self.group, self.dealt = -1, {}

    def push(self, keys: np.ndarray, pos: np.ndarray) -> None:
        if not len(keys):
            return
        of = np.searchsorted(self.cuts, keys, side="right")
        group = of // self.width
        here = group == self.group
        if here.any():
            self._deal(of[here], keys[here], pos[here])
            keys, pos, group = keys[~here], pos[~here], group[~here]
        for g, own in _split(group):
            self.queues[g].push(pos[own], keys[own])

    def _deal(self, of: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> None:
        for r, own in _split(of):
            self.dealt.setdefault(r, []).append((keys[own], pos[own]))

    def take(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and positions of range ``r``, in order; ranges are taken in order, and no entry comes to one already taken."""
        while self.group < r // self.width:
            self.group += 1
            while (got := self.queues[self.group].pop()) is not None:
                self._deal(np.searchsorted(self.cuts, got[1], side="right"), got[1], got[0])
        held = self.dealt.pop(r, [])
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, pos = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        order = np.argsort(keys, kind="stable")
        return keys[order], pos[order]


def _split(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers in ``of`` and where each stands."""
    order = np.argsort(of, kind="stable")
    sorted_ = of[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)]):
        yield int(sorted_[a]), order[a:b]


class _Induction:
    """Induction over a string of names; keys are 2 * name for L-type suffixes and one more for S-type ones."""

    def __init__(self, text: np.ndarray, budget: Budget):
        self.text, self.n, self.budget = text, len(text), budget
        self.is_s = budget.array(self.n, np.bool_)
        nxt, tail = False, None
        for part in reversed(list(budget.parts(self.n))):
            own = np.asarray(text[part])
            sign = np.sign(np.append(own[1:], own[-1] if tail is None else tail) - own)
            if tail is None:
                sign[-1] = -1
            known = np.where(sign != 0, np.arange(len(own)), len(own))
            place = np.minimum.accumulate(known[::-1])[::-1]
            self.is_s[part] = np.where(place < len(own), np.append(sign > 0, nxt)[place], nxt)
            nxt, tail = bool(self.is_s[part.start]), own[0]
        # An entry of the L-type pass leads to one of its own range the likelier, the fewer names are left above it,
        # and of the S-type pass below it: ranges shrink towards that end, so that each meets about one such entry.
        sample = np.sort(np.asarray(text[:: max(1, self.n // (1 << 18))]))
        ranges = 2 * max(4, int(self.n**0.5))
        place = (np.linspace(0, 1, ranges + 1)[1:-1] ** 2 * len(sample)).astype(np.int64)
        self.rising, self.sinking = np.unique(sample[len(sample) - 1 - place]) * 2, np.unique(sample[place]) * 2

    def lms(self) -> np.ndarray:
        parts = [np.flatnonzero(self.is_s[p.start + 1 : p.stop + 1] & ~self.is_s[p.start : min(p.stop, self.n - 1)]) + (p.start + 1) for p in self.budget.parts(self.n)]
        out, at = self.budget.array(sum(map(len, parts)), np.int64), 0
        for x in parts:
            out[at : at + len(x)] = x
            at += len(x)
        return out

    def _drain(self, keys: np.ndarray, pos: np.ndarray, bound: float, sign: int, heap: Heap) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes entries in order; what they induce below ``bound`` joins them, the rest goes to the heap."""
        to_s, at = sign < 0, 0
        while at < len(keys):
            stop = min(len(keys), at + self.budget.block)
            before = pos[at:stop] - 1
            source = np.flatnonzero((before >= 0) & (self.is_s[before] == to_s))
            target = before[source]
            key = sign * (2 * self.text[target].astype(np.int64) + to_s)
            inner = key < bound
            if inner.any():
                stop = min(stop, at + int(np.searchsorted(keys[at:], key[inner], side="right").min()))
            yield keys[at:stop], pos[at:stop]
            live = source < stop - at
            heap.push(key[live & ~inner], target[live & ~inner])
            join = live & inner
            if join.any():
                order = np.argsort(key[join], kind="stable")
                new, keys, pos = key[join][order], keys[stop:], pos[stop:]
                place = np.searchsorted(keys, new, side="right")
                keys, pos, at = np.insert(keys, place, new), np.insert(pos, place, target[join][order]), 0
            else:
                at = stop

    def _first(self, where: np.ndarray, at: int, key, bound: float) -> int:
        """The first place from ``at`` on whose key isn't below ``bound``; keys rise along ``where``."""
        while at < len(where):
            own = key(np.asarray(where[at : at + self.budget.block]))
            take = int(np.searchsorted(own, bound, side="left"))
            at += take
            if take < len(own):
                break
        return at

    def falling(self, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the last, in runs (whether S-type, position), from the LMS ones in order."""
        text, n = self.text, self.n
        heap = Heap(self.rising, self.budget)
        heap.push(np.array([2 * int(text[n - 1])]), np.array([n - 1]))
        count = n - sum(int(np.count_nonzero(self.is_s[p])) for p in self.budget.parts(n))
        larger, filled, seed = self.budget.array(count, np.int64), 0, 0
        for r in range(heap.ranges):
            keys, pos = heap.take(r)
            bound = heap.cuts[r] if r < len(heap.cuts) else np.inf
            low, seed = seed, self._first(seeds, seed, lambda x: 2 * text[x] + 1, bound)
            if seed > low:
                own = np.asarray(seeds[low:seed]).astype(np.int64)
                keys, pos = np.concatenate((keys, 2 * text[own] + 1)), np.concatenate((pos, own))
                order = np.argsort(keys, kind="stable")
                keys, pos = keys[order], pos[order]
            for k, p in self._drain(keys, pos, bound, 1, heap):
                p = p[(k & 1) == 0]
                larger[filled : filled + len(p)] = p
                filled += len(p)
        # Falling keys are negative; a key at a cut belongs to the higher range.
        heap, back, at = Heap(1 - self.sinking[::-1], self.budget), larger[::-1], 0
        for r in range(heap.ranges):
            keys, pos = heap.take(r)
            bound = heap.cuts[r] if r < len(heap.cuts) else np.inf
            low, at = at, self._first(back, at, lambda x: -2 * text[x], bound)
            own = np.asarray(back[low:at])
            keys, pos = np.concatenate((keys, -2 * text[own])), np.concatenate((pos, own))
            order = np.argsort(keys, kind="stable")
            for k, p in self._drain(keys[order], pos[order], bound, -1, heap):
                yield (k & 1) == 1, p


def _within(text: np.ndarray, names: int, most: int) -> np.ndarray:
    """The suffix order, by ``most`` names at least, of a string that fits in memory: ranks of doubled length, sorted."""
    n, h, rank = len(text), 1, np.array(text)
    order = np.argsort(rank, kind="stable")
    while names < n and h < most:
        key = rank * (n + 1)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        names, h = int(rank[order[-1]]) + 1, h * 2
    return order


def order_of(text: np.ndarray, names: int, budget: Budget, most: int) -> np.ndarray:
    """The suffix order, by ``most`` names at least, of a string of ``names`` distinct names 0, 1, ..., by recursive induction.

    The recursion ends with a string that is no larger than the budget's arrays in memory.
    """
    n = len(text)
    if 8 * n <= budget.array_bytes:
        return _within(text, names, most)
    out = budget.array(n, np.int64)
    if names == n:  # no two suffixes begin alike
        for part in budget.parts(n):
            out[text[part]] = np.arange(part.start, part.stop)
        return out
    s = _Induction(text, budget)
    where = s.lms()
    count = len(where)
    seeds = where
    if count > 1:
        number = budget.array(n, np.int64)
        number[:] = -1
        symbols = budget.array(count, np.int64)
        for part in budget.parts(count):
            number[where[part]] = np.arange(part.start, part.stop)
            symbols[part] = text[where[part]]
        first, ordered, at = external_argsort(symbols, budget), budget.array(count, np.int64), count
        for part in budget.parts(count):
            symbols[part] = where[first[part]]
        for is_s, pos in s.falling(symbols):
            k = number[pos[is_s]]
            k = k[k >= 0]
            ordered[at - len(k) : at] = k[::-1]
            at -= len(k)
        del number, first, symbols
        rank, name = budget.array(count, np.int64), 0
        for part in budget.parts(count - 1):
            both = np.asarray(ordered[part.start : part.stop + 1])
            start = where[both]
            size = np.where(both + 1 < count, where[np.minimum(both + 1, count - 1)], n) - start + 1
            last = both == count - 1
            fresh = (size[1:] != size[:-1]) | last[1:] | last[:-1]
            live, off = np.flatnonzero(~fresh), 0
            while len(live):
                differ = text[start[live] + off] != text[start[live + 1] + off]
                fresh[live[differ]] = True
                off += 1
                live = live[~differ & (size[live] > off)]
            own = name + np.concatenate(([0], np.cumsum(fresh)))
            rank[both], name = own, int(own[-1])
        order = order_of(rank, name + 1, budget, most)
        seeds = budget.array(count, np.int64)
        for part in budget.parts(count):
            seeds[part] = where[order[part]]
        del rank, order, ordered
    at = n
    for _, pos in s.falling(seeds):
        out[at - len(pos) : at] = pos[::-1]
        at -= len(pos)
    return out


def external_argsort(key: np.ndarray, budget: Budget) -> np.ndarray:
    """argsort by distribution: parts that fit in memory, cut at sampled keys.

    A key too frequent for a part needs no sorting and is copied through.
    """
    fits = max(1, budget.array_bytes // 8)
    if len(key) <= fits:
        return np.argsort(key, kind="stable")
    parts = -(-len(key) // fits) * 2
    cuts = np.unique(np.quantile(key[:: max(1, len(key) // 65536)], np.linspace(0, 1, parts + 1)[1:-1], method="nearest"))
    runs: list[list] = [[] for _ in range(2 * len(cuts) + 1)]  # between cuts, and at them
    for part in budget.parts(len(key)):
        own = np.asarray(key[part])
        side = np.searchsorted(cuts, own, side="left") + np.searchsorted(cuts, own, side="right")
        for p in np.unique(side):
            runs[p].append(budget.spill(part.start + np.flatnonzero(side == p)))
    out, done = budget.array(len(key), np.int64), 0
    for p, held in enumerate(runs):
        if p % 2:  # equal keys, in order of arrival
            for r in held:
                found = budget.load(r)[0]
                out[done : done + len(found)] = found
                done += len(found)
        elif held:
            found = np.concatenate([budget.load(r)[0] for r in held])
            out[done : done + len(found)] = found[np.argsort(key[found], kind="stable")]
            done += len(found)
    return out


def repeated(raw: np.ndarray, depth: int, budget: Budget | None = None) -> np.ndarray:
    """A mask of positions whose next ``depth`` (2 to 250) bytes start elsewhere too."""
    budget = budget or Budget()
    mask = budget.array(len(raw), np.bool_)
    mask[:] = False
    if len(raw) <= depth:
        return mask
    try:
        padded = budget.array(len(raw) + 8, np.uint8)
        padded[: len(raw)], padded[len(raw) :] = raw, 0
        s = Suffixes(padded[: len(raw)], depth, budget)
        s.padded = padded
        seeds, lcp = s.sorted_lms()
        last = None
        for _, pos, prefix in s.induce(seeds, lcp):
            hit = np.flatnonzero(prefix >= depth)
            mask[pos[hit]] = True
            mask[pos[hit[hit > 0] - 1]] = True
            if len(hit) and hit[0] == 0:
                mask[last] = True
            last = pos[-1]
    finally:
        budget.close()
    return mask

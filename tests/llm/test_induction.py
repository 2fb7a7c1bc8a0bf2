import random
from collections import Counter

import numpy as np
import pytest

from lantern.llm.induction import Budget, external_argsort, order_of, repeated


def brute(raw, depth):
    seen = Counter(raw[i : i + depth] for i in range(len(raw) - depth + 1))
    return [i <= len(raw) - depth and seen[raw[i : i + depth]] > 1 for i in range(len(raw))]


def strings():
    r = random.Random(11)
    for k in range(120):
        letters = r.choice([b"a", b"ab", b"abc", bytes(range(256)), b"the of and\xff"])
        base = bytes(r.choice(letters) for _ in range(r.randint(0, 60)))
        out = b""
        for _ in range(r.randint(1, 12)):
            a = r.randint(0, len(base))
            out += base[a : a + r.randint(0, 40)] + bytes(r.choice(letters) for _ in range(r.randint(0, 6)))
        yield out
    yield b"a" * 300
    yield b"ab" * 200 + b"a"
    yield bytes(range(256)) * 3
    yield bytes(reversed(range(256))) * 2


@pytest.mark.parametrize("depth", [2, 5, 8, 17])
@pytest.mark.parametrize("limits", [(1 << 26, 1 << 22, 1 << 18), (16, 8, 4), (50, 1 << 20, 7)])
def test_matches_brute_force(depth, limits):
    for raw in strings():
        got = repeated(np.frombuffer(raw, np.uint8), depth, Budget(*limits)).tolist()
        assert got == brute(raw, depth), (raw, depth)


def test_depth_of_200():
    r = random.Random(2)
    parts = [bytes(r.choice(b"abcdef ") for _ in range(330)) for _ in range(20)]
    raw = b"\xff".join(p[r.randint(0, 60) : 330 - r.randint(0, 60)] for p in parts + parts + parts[:7])
    assert repeated(np.frombuffer(raw, np.uint8), 200).tolist() == brute(raw, 200)


def test_external_sort_equals_sort():
    key = np.random.default_rng(1).integers(0, 50, 1000)
    budget = Budget(64, 64, 16)
    assert np.array_equal(key[external_argsort(key, budget)], np.sort(key))
    budget.close()


def names_of(raw):
    each = sorted(set(raw))
    return np.array([each.index(x) for x in raw], np.int64), len(each)


@pytest.mark.parametrize("limits", [(1 << 25, 1 << 25, 1 << 17), (64, 32, 4), (1, 1, 1), (800, 64, 16)])
def test_order_of_names_is_the_suffix_order(limits):
    r = random.Random(7)
    for k in range(60):
        n, kinds = r.choice([1, 2, 3, 10, 60, 400]), r.choice([1, 2, 3, 20, 1000])
        raw = [r.randrange(kinds) for _ in range(n)]
        if k % 3 == 0:
            raw = raw * 3 + raw[: n // 2]
        text, names = names_of(raw)
        budget = Budget(*limits)
        got = np.asarray(order_of(text, names, budget, len(raw))).tolist()
        budget.close()
        assert got == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_order_of_many_names():
    r = np.random.default_rng(2)
    part = r.integers(0, 5000, 30_000)
    text = np.concatenate((part, part[:9000], r.integers(0, 5000, 20_000), part[500:9000]))
    text = np.unique(text, return_inverse=True)[1]
    order = order_of(text, int(text.max()) + 1, Budget(1 << 14, 1 << 14, 1 << 10), len(text))
    raw = text.astype(">u4").tobytes()
    assert np.array_equal(order, sorted(range(len(text)), key=lambda i: raw[4 * i :]))


MEASURE = """
import random, threading, time
import numpy as np
from lantern.llm.induction import Budget, repeated

def held():
    return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon")) / 1024

r = random.Random(5)
words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(5000)]
part = " ".join(r.choice(words) for _ in range(400_000)).encode()
text = np.frombuffer((part + part[: len(part) // 3] + " ".join(r.choice(words) for _ in range(1_000_000)).encode())[: 8 << 20], np.uint8)
del part
base, most, on = held(), 0, True

def watch():
    global most
    while on:
        most = max(most, held())
        time.sleep(0.01)

t = threading.Thread(target=watch)
t.start()
found = int(repeated(text, 200, Budget(2 << 20, 2 << 20, 1 << 16)).sum())
on = False
t.join()
print(len(text), found, most - base)
"""


def test_memory_follows_the_budget_and_not_the_string():
    import subprocess
    import sys

    n, found, grown = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout.split()
    # 15 bytes for each of the string's would be 120 MB.
    assert int(n) == 8 << 20 and int(found) > 800_000 and float(grown) < 90

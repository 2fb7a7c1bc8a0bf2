import hashlib
import random
from collections import Counter

import pytest

from lantern.llm import common, repeats

SCHEMA = "doc_id long, text string, sum string, found int, gram double"


def brute(rows, length):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, unit):
    r = random.Random(seed)
    letters = "abcdef é日 "
    passages = ["".join(r.choice(letters) for _ in range(r.randint(unit // 2, unit * 3))) for _ in range(8)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append("".join(r.choice(letters) for _ in range(r.randint(0, unit * 2))))
            p = r.choice(passages)
            parts.append(p[r.randint(0, 5) :] if r.random() < 0.5 else p)
        rows.append((i, "".join(parts)))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, "a" * unit * 5), (52, "ab" * unit * 2), (53, None), (54, ""), (None, rows[5][1]), (55, "x" * unit), (56, "x" * unit), (57, "y" * (unit - 1)), (58, "y" * (unit - 1))]
    return rows


@pytest.mark.parametrize("length,gram,more", [(20, 6, {}), (20, 6, {"hot_contexts": 2}), (20, 6, {"bitmap": 1, "shard_bytes": 300}), (20, 6, {"bloom_bits": 1024, "budget": (64, 32, 16)}), (200, 48, {})])
def test_matches_brute_force(spark, length, gram, more, monkeypatch):
    more = dict(more)
    monkeypatch.setattr(common, "FILTER_ROWS", more.pop("bitmap", common.FILTER_ROWS))
    rows = corpus(length, length)
    df = spark.createDataFrame([(d, t, "s", 1, 0.5) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df, length=length, gram=gram, **more).collect()), key=repr)
    assert got == brute(rows, length)


def test_kept_text_and_empty_table(spark):
    shared = "0123456789" * 3
    df = spark.createDataFrame([(1, "left " + shared + " right", "s", 1, 0.5), (2, shared + "!", "s", 1, 0.5)], SCHEMA)
    assert {r.kept for r in repeats.remove_repeats(df, keep_text=True, length=25, gram=8).collect()} == {"left  right", "!"}
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_segments_give_the_same_windows(monkeypatch):
    raw = "".join(random.Random(3).choice("abc ") for _ in range(900)).encode()

    def windows():
        g, c, low, size = repeats.anchors(raw, 50, 12)
        return sorted((int(a), s) for a, at, n in zip(g, low, size) for s in range(at, at + n - 49))

    whole = windows()
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    assert windows() == whole and len(whole) == 851

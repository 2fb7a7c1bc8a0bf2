import random
import re

import numpy as np
import pytest

from lantern.llm import neardup, shingles
from lantern.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rep long, key string, component long"


def shingle_sets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: shingle_sets(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a0, b0 = sorted((top(a), top(b)))
                root[b0] = a0
    return {d: (len(sets[d]), top(d)) for d in ids}


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "日本"]
    rows = []
    for base in range(12):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 120]))]
        for _ in range(r.choice([1, 2, 15])):
            changed = [r.choice(vocabulary) if r.random() < 0.04 else w for w in words]
            rows.append((r.choice([" ", "\n", "\t "]).join(changed)))
        chain = list(words)  # each link passes, ends don't
        for k in range(8):
            for _ in range(max(1, len(words) // 40)):
                chain[r.randrange(len(chain))] = f"c{base}-{k}"
            rows.append(" ".join(chain))
    rows += ["", None, "  \n", "one", "ONE", "one ", "\x1c", "same text here"] * 2
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "k", None) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_kept_is_the_least_of_each_component(spark):
    rows = [(5, "a b c"), (3, "a b c"), (9, "x y"), (4, None)]
    df = spark.createDataFrame([(d, t, 1, "k", None) for d, t in rows], SCHEMA)
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == {(5, 3, False), (3, 3, True), (9, 9, True), (4, 4, True)}


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 1, "k", None), (1, "a b", 1, "k", None), (1, "c d e", 1, "k", None), (None, "a b", 1, "k", None)], SCHEMA)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 1, True), (1, 1, True), (1, 1, True), (1, 2, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}


def test_long_texts_hash_alike_in_segments(monkeypatch):
    raw = (" ".join(f"wörd{i}" for i in range(400)) + " " + "y" * 200).encode()
    whole = shingles.word_hashes(raw)
    monkeypatch.setattr(shingles, "_WIDE", 64)
    assert np.array_equal(whole, shingles.word_hashes(raw)) and len(whole) == 401


def test_bits_of_linked_pairs_stay_within_the_limit():
    r = np.random.default_rng(3)
    hasher, limit = shingles.MinHash(44, 5), neardup.most_bits(220, 80)
    assert 45 <= limit <= 58 and neardup.most_bits(220, 100) == 0
    for size in (9, 90, 900):
        for _ in range(30):
            both = shingles.mix(r.integers(0, 1 << 62, size, dtype=np.uint64))
            cut = size // 9  # intersection 8 / 10 of the union
            more = shingles.mix(r.integers(0, 1 << 62, 2 * cut, dtype=np.uint64))
            a, b = (hasher.keys(np.sort(np.concatenate((both[: 8 * cut], x))))[1] for x in (more[:cut], more[cut:]))
            assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= limit

import random

import numpy as np
import pytest

from lantern.llm import common, neardup, shingles
from tests.llm.test_neardup import brute


def template(r, n, own, size=100):
    """Texts that share all but ``own`` of their ``size`` words."""
    common_words = [f"t{k}" for k in range(size - own)]
    return [" ".join(common_words + [f"u{r.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, **options).collect()}


@pytest.mark.parametrize("own", [11, 18])
def test_crowded_buckets_lose_no_link(spark, own):
    r = random.Random(own)
    texts = template(r, 60, own)
    # Near copies of some of them, and of each other.
    for k in range(12):
        words = texts[k].split()
        words[r.randrange(len(words))] = f"z{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert got(spark, rows, crowd=4) == want == got(spark, rows)
    assert own < 18 or 40 < len({c for _, c in want.values()}) < len(rows)


def test_one_large_component_among_others(spark):
    r = random.Random(3)
    rows = list(enumerate(template(r, 40, 4) + template(r, 40, 16)))
    assert got(spark, rows, crowd=4) == brute(rows)


def test_repeating_ids_in_crowds(spark):
    r = random.Random(9)
    rows = [(k % 30, t) for k, t in enumerate(template(r, 50, 17))]
    from tests.llm.test_neardup_repeats import brute as of_ids

    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=4).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in found) == of_ids(rows)


def test_a_template_takes_linear_work(spark, monkeypatch):
    """20,000 texts at a Jaccard similarity of 0.7 are no 200 million pairs."""
    compared, before = [], neardup.confirmed
    paired, rare = [], neardup.by_rare_shingles

    def counted(pairs, rows, percent):
        compared.append(pairs.count())
        return before(pairs, rows, percent)

    def counted_rare(*args):
        out = common.written(rare(*args), "t")
        paired.append(out.count())
        return out

    monkeypatch.setattr(neardup, "confirmed", counted)
    monkeypatch.setattr(neardup, "by_rare_shingles", counted_rare)
    n = 20_000
    rows = list(enumerate(template(random.Random(1), n, 18)))
    found = got(spark, rows)
    assert all(found[d] == (99, d) for d, _ in rows)
    # Each text meets few of its buckets' pivots; no pair of the crowd is left to compare.
    assert paired == [0] and sum(compared) <= 8 * n


def test_long_words_with_equal_polynomials_differ():
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    one, two = (shingles.word_hashes(x.encode()) for x in (a, b))
    assert one[0] != two[0]
    assert np.array_equal(shingles.word_hashes(f"x {a}".encode())[1:], one)


def test_sifted_parts_are_whole_and_disjoint(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k if k % 10 else None,) for k in range(400)], "k long")
    keys = spark.createDataFrame([(k,) for k in range(0, 400, 7)] + [(None,)], "own long")
    for size in (1 << 19, 2):
        monkeypatch.setattr(common, "FILTER_ROWS", size)
        maybe, rest = common.sifted(rows, F.col("k"), keys, F.col("own"))
        a, b = ([r.k for r in x.collect()] for x in (maybe, rest))
        assert len(a) + len(b) == 400 and {k for k in range(400) if k % 7 == 0 and k % 10} | {None} <= set(a)
        assert size == 2 or len(a) < 200
        left = common.without(rows, F.col("k"), keys, "own")
        assert sorted(r.k or -1 for r in left.collect()) == sorted([k for k in range(400) if k % 7 and k % 10] + [-1] * 40)

import random

from pyspark.sql import functions as F

from lantern.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, step, k):
    import math

    import numpy as np

    live = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    queries = {}
    for i, v in live:
        if i % step == 0:
            queries[i] = min(queries.get(i, (len(v), v)), (len(v), v))
    out = []
    for q, (n, v) in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in live if i != q and len(w) == n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=3):
    df = topk.quantised(spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA))
    return sorted(tuple(r) for r in topk.top_k(df.where(F.col("vec_id") % 5 == 0), df, k).select("query_id", "rank", "vec_id", "score").collect())


def test_matches_brute_force_with_ties_nulls_and_odd_lengths(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(80)]
    rows += [(85, None), (90, [1.0, None, 0.0, 0.0]), (95, [float("nan")] * 4), (96, [float("inf")] * 4), (100, [1.0, 2.0]), (101, [0.5, 0.5]), (None, [1.0] * 4), (105, [9.0]), (110, [])]
    rows += [(5, rows[5][1]), (10, [0.1, 0.1, 0.1, 0.1]), (7, rows[7][1])]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 9)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(topk, "BINS", 16)
    assert run(spark, rows) == brute(rows, 5, 3)


def test_large_components_stay_exact(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-200000, 200000) for _ in range(8)]) for i in range(30)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, []) == []


def test_later_ranges_stop_at_their_bin(spark):
    # The second pass has far fewer scores in its range than bins.
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 0.125) for _ in range(64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5, 3)

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import topk

LONG = range(-(1 << 63), 1 << 63)


def brute(rows, step, k):
    whole = [(i, [math.floor(256 * x) if abs(x) < 2.0**45 else int(x) * 256 for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % step == 0:
            scored = sorted((-s, i) for i, w in whole if i != q and len(w) == len(v) and (s := sum(a * b for a, b in zip(v, w))) in LONG)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, kind="float", k=3):
    df = topk.quantised(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    return sorted(tuple(r) for r in topk.top_k(df.where(F.col("vec_id") % 5 == 0), df, k).select("query_id", "rank", "vec_id", "score").collect())


def test_components_beyond_2_18_take_part(spark):
    r = random.Random(2)
    rows = [(i, [float(r.choice([-1, 1]) * 2**19) if i % 3 else float(np.float32(r.uniform(-9, 9))) for _ in range(256)]) for i in range(24)]
    got = run(spark, rows)
    assert got == brute(rows, 5, 3) and max(abs(s) for *_, s in got) > 1 << 57


def test_only_scores_that_are_no_long_are_left_out(spark):
    rows = [(i, v) for i, v in enumerate([
        [2.0**23, 0.0], [2.0**23, 1.0], [-(2.0**24), 0.0], [2.0**24, 0.0], [-(2.0**23), 0.0], [1e30, -1e30], [1.0, 1.0], [0.0, 1e38], [2.0**70, 3.0], [2.0**24 - 1, 0.0], [0.0, 5.0], [2.0**24, 2.0**-8], [2.0**23, 2.0**23],
    ])]
    got = run(spark, rows, k=6)
    assert got == brute(rows, 5, 6)
    assert run(spark, rows, "double", 6) == got


def test_ends_of_a_long_and_doubles_beyond_floats(spark):
    rows = [(0, [2.0**24, 2.0**-8]), (1, [-(2.0**23), 0.0]), (2, [2.0**23, -(2.0**-8)]), (3, [2.0**23, 0.0]), (4, [1e308, 0.0]), (5, [0.0, 7.0]), (10, [1.0, 1.0]), (6, [1e308, -1e308]), (20, [1.0, 2.0, 3.0])]
    got = run(spark, rows, "double", 9)
    assert got == brute(rows, 5, 9)
    assert (0, (1 << 63) - 1) in [(q, s) for q, _, _, s in got] and (0, -(1 << 63)) in [(q, s) for q, _, _, s in got]

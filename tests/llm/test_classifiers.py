import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import labelled, quality, toxicity
from lantern.llm.langid import held_out

DOCS = "doc_id long, text string, source string, label int, score string"
LABELS = "doc_id long, toxic int, quality int"


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(12)
    words = "river stone light walk garden paper window bread music summer idle trail".split()
    docs, labels = [], []
    for i in range(600):
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.6)
        text = [r.choice(words) for _ in range(r.randint(8, 60))] if good else [r.choice(words)] * r.randint(20, 60)
        if toxic:
            text.insert(r.randrange(len(text)), "grobnik" + r.choice(["", "er", "ish"]))
        docs.append((i, " ".join(text) + ".", f"site{r.choice([0, 0, 0, 1, 2, 3])}", 1, "x"))
        labels.append((i, toxic, good))
    docs += [(900, None, None, 1, "x"), (901, "", "site0", 1, "x"), (902, "idiot " * 3, "site9", 1, "x"), (902, "idiot " * 3, "site9", 1, "x"), (None, "river stone", "site1", 1, "x")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (5000, 1, 0)], LABELS), {i: (t, q) for i, t, q in labels}


def accuracy(rows, truth, column):
    held = [(r.score, truth[r.doc_id][column]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 80
    return np.mean([(s >= (0.3, 0.5)[column]) == bool(y) for s, y in held])


def test_toxicity_on_held_out_rows(made):
    docs, labels, truth = made
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth, 0) > 0.97
    by = {r.doc_id: r.score for r in rows}
    assert by[900] == by[901] < 0.3 <= by[902]


def test_toxicity_without_labels_or_rows(made):
    docs, labels, _ = made
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.doc_id for r in toxicity.scored(docs, model).where("score >= 0.3").collect()} == {902}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_only_learnable_labels_are_used(made):
    docs, labels, _ = made
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.scored(docs, toxicity.fit(docs, x)).collect()), key=str) for x in (labels, turned))
    assert a == b


def test_spotter_equals_patterns_of():
    r = random.Random(2)
    texts = [" ".join(r.choice(["abcde", "abcdefg", "abc", "Abcdé", "x_abcd", "abcd-abcde", "ab", "_", "é", "abcdefgh,"]) for _ in range(6)) for _ in range(200)]
    patterns = ["abcd*", "abcde", "abcde*", "abcdef*", "abcdé", "abc", "x_ab*"]
    spot = toxicity.Spotter(patterns)
    for t in texts:
        found = toxicity.patterns_of(t)
        assert spot(t) == [k for k, p in enumerate(patterns) if p in found], t


def test_label_model_recovers_rates_and_discounts_copies():
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.3
    hit, slip = np.array([0.7, 0.5, 0.6, 0.4]), np.array([0.02, 0.05, 0.01, 0.03])
    votes = r.random((4000, 4)) < np.where(y[:, None], hit, slip)
    model = toxicity.label_model(np.column_stack((votes, votes[:, 0])), 0.1)
    assert np.abs(model["hit"][:4] - hit).max() < 0.15 and (model["slip"][:4] < 0.1).all()
    assert model["discount"][0] < 0.6 and model["discount"][4] < 0.6 and model["discount"][2] > 0.9
    assert ((model["posterior"] > 0.5) == y).mean() > 0.9


def test_quality_on_held_out_rows(made):
    docs, labels, truth = made
    found = quality.evidence(docs, quality.fit(docs, labels), F.col("source"), F.concat_ws("/", "source", "label"))
    rows = quality.scored(found).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth, 1) > 0.97
    none = quality.fit(docs, labels.limit(0))
    assert none["base"] == 0.0 and quality.scored(quality.evidence(docs.limit(0), none, F.col("source"), F.col("source"))).count() == 0


def test_sparse_sites_are_shrunk_toward_the_levels_above(spark):
    rows = [(i, "good", f"good/{i % 3}", 2.0 if i % 5 else -1.0) for i in range(200)] + [(500 + i, "bad", f"bad/{i % 3}", -2.0 if i % 5 else 1.0) for i in range(200)]
    rows += [(900, "new", "new/0", 0.0), (901, "good", "good/new", 0.0), (902, "bad", "bad/new", 0.0)]
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(rows, "doc_id long, host string, path string, logit double")).collect()}
    assert got[902] < 0.4 < got[900] < 0.6 < got[901]


def test_sample_is_bounded_and_steady(made):
    docs, labels, _ = made
    a = labelled.sample(docs, labels, "toxic", 20)
    b = labelled.sample(docs.repartition(5), labels.repartition(3), "toxic", 20)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 40
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in a.collect())

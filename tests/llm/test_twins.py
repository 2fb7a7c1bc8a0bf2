"""The learned operators' numbers, worked out again in plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lantern.llm import labelled, langid, quality, toxicity
from tests.llm.test_langid import WORDS


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def texts(n, seed=2):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        bad = r.random() < 0.3
        words = [r.choice(WORDS[lang]) for _ in range(r.randint(4, 80))]
        if bad:
            words += r.choices(["grumbletoad", "snarkling", "grumbletoads", "idiot"], k=3)
        r.shuffle(words)
        text = " ".join(words) + r.choice([".", "!", " 12 34.", "\nline\nline", ""])
        out.append((k, text, lang, f"src{r.randint(0, 5)}", int(bad)))
    return out


# ------------------------------------------------------------- language


def plain_vector(text, dims, idf):
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode()]
    two = [(a * 0x01000193 & 0xFFFFFFFF) ^ b for a, b in zip(raw, raw[1:])]
    three = [(a * 0x01000193 & 0xFFFFFFFF) ^ b for a, b in zip(two, raw[2:])]
    shift = 32 - (dims.bit_length() - 1)
    counts = Counter((h * 0x9E3779B1 & 0xFFFFFFFF) >> shift for h in raw + two + three)
    vector = {h: math.log1p(n) * float(idf[h]) for h, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    return {h: v / max(norm, 1e-12) for h, v in vector.items()}


def test_languages_by_plain_cosines(spark, tmp_path):
    rows = texts(80) + [(100, None, "en", "s", 0), (101, "12 !", "de", "s", 0), (102, "", "fr", "s", 0), (103, "qzx wvk " * 90, None, "s", 0)]
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(langid.learnable(docs))
    learnt = [(t, lang) for d, t, lang, _, _ in rows if not held_out(d) and t and lang and any(map(str.isalpha, t))]
    dims = len(model["idf"])
    seen = Counter(h for t, _ in learnt for h in plain_vector(t, dims, np.ones(dims)))
    for h in range(0, dims, 7):
        assert model["idf"][h] == pytest.approx(math.log((1 + len(learnt)) / (1 + seen[h])) + 0.05, abs=1e-5)
    assert model["langs"] == sorted({lang for _, lang in learnt}) and np.allclose(np.linalg.norm(model["centres"], axis=1), 1, atol=1e-5)
    got = {r.doc_id: r for r in langid.op3_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, _, _, _ in rows:
        assert got[d].held_out == held_out(d)
        if not t or not any(map(str.isalpha, t)):
            assert (got[d].lang_pred, got[d].score, got[d].rejected) == ("und", 0.0, True)
            continue
        vector = plain_vector(t, dims, model["idf"])
        cosines = [sum(v * float(c[h]) for h, v in vector.items()) for c in model["centres"]]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        lang = int(model["of"][best])
        assert got[d].lang_pred == model["langs"][lang] and got[d].score == pytest.approx(cosines[best], abs=1e-4)
        limit = model["least"][lang] * min(1.0, (len(t) / langid.FULL_LETTERS) ** 0.5)
        assert abs(cosines[best] - limit) < 1e-4 or got[d].rejected == (cosines[best] < limit)
    assert got[103].rejected


def test_centroids_are_their_members_means():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(60, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid._spherical(x, 3, rounds=200)
    own = [max(range(3), key=lambda j: float(row @ c[j])) for row in x]
    for j in range(3):
        mean = sum(row for row, k in zip(x, own) if k == j)
        assert np.allclose(c[j], mean / np.linalg.norm(mean), atol=1e-6)


# ----------------------------------------------------------- classifiers


@pytest.mark.parametrize("soft", [False, True])
def test_logistic_weights_are_the_optimum(soft):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(200, 4)), r.random(200)
    y = y if soft else (y + x[:, 0] > 0.6).astype(float)
    w, b = labelled.logistic(x, y, penalty=0.7)

    def loss(w, b):
        z = x @ w + b
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.35 * w @ w + 0.0005 * b * b)

    best = loss(w, b)
    for _ in range(50):
        step = r.normal(size=5) * 1e-3
        assert loss(w + step[:4], b + step[4]) >= best - 1e-9


def plain_shape(text):
    words = text.split()
    if not words:
        return [0.0] * 9
    n, size, counts = len(words), len(text), Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    signs = [c for c in text if 33 <= ord(c) < 127 and not c.isalnum()]
    return [
        math.log1p(n) / 10, len(counts) / n, max(counts.values()) / n, sum(c.isupper() for c in text) / size, len(signs) / size, 1 - len(set(lines)) / len(lines),
        min(sum(map(len, words)) / n, 20) / 20, sum(len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum() for w in words) / n, sum(w[-1] in ".!?" for w in words) / n,
    ]


def test_quality_by_plain_sums(spark):
    rows = texts(70, 5)
    docs = spark.createDataFrame([(d, t, lang, s) for d, t, lang, s, _ in rows] + [(200, None, None, None), (201, "", "en", "src0")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(d, bad) for d, _, _, _, bad in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.evidence(docs, model, docs.source, docs.lang)
    logit = {r.doc_id: r.logit for r in found.collect()}
    every = [*rows, (200, "", "", "", 0), (201, "", "en", "src0", 0)]
    weights = model["weights"]
    for d, t, *_ in every:
        f = plain_shape(t or "")
        z = sum(w * v for w, v in zip(weights, f + [v * v for v in f])) + model["base"]
        assert logit[d] == pytest.approx(max(-12, min(12, z)), abs=1e-9)
    p = {d: 1 / (1 + math.exp(-z)) for d, z in logit.items()}
    path = {d: (s or "", lang or "") for d, _, lang, s, _ in every}
    mean = sum(p.values()) / len(p)

    def pseudo(groups, prior):
        """Moments: within-site and between-site variance."""
        n, k = sum(map(len, groups.values())), len(groups)
        within = sum(max(sum(v * v for v in g) - sum(g) ** 2 / len(g), 0) for g in groups.values()) / (n - k)
        between = sum(len(g) * (sum(g) / len(g) - prior(key)) ** 2 for key, g in groups.items())
        spread = (between - k * within) / max(n - sum(len(g) ** 2 for g in groups.values()) / n, 1e-9)
        return min(max(within / max(spread, 1e-6), 0.5), 1e4)

    hosts, paths = defaultdict(list), defaultdict(list)
    for d, v in p.items():
        hosts[path[d][0]].append(v)
        paths[path[d]].append(v)
    m = pseudo(hosts, lambda _: mean)
    prior = {h: (sum(g) + m * mean) / (len(g) + m) for h, g in hosts.items()}
    m = pseudo(paths, lambda key: prior[key[0]])
    site = {key: (sum(g) + m * prior[key[0]]) / (len(g) + m) for key, g in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    got = {r.doc_id: r.score for r in quality.scored(found).collect()}
    assert got.keys() == p.keys()
    for d in p:
        z = logit[d] + quality.SITE_WEIGHT * (odds(site[path[d]]) - odds(mean))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-7)


def plain_votes(text, patterns):
    words = set(re.findall(r"\w+", (text or "").lower()))
    return [any(len(w) > len(p) - 1 and w.startswith(p[:-1]) for w in words) if p.endswith("*") else p in words for p in patterns]


def test_toxicity_by_plain_votes(spark):
    rows = texts(240, 9)
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, bad) for d, *_, bad in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"grumbletoad", "snarkling"} <= set(model["patterns"])
    # Mined patterns keep the limits that the docstring names, on learnable rows alone.
    sample = [(t, bad) for d, t, _, _, bad in rows if not held_out(d)]
    n1, n0 = sum(b for _, b in sample), sum(not b for _, b in sample)
    for p in model["patterns"]:
        if p not in toxicity.BUILT_IN:
            hits, slips = (sum(plain_votes(t, [p])[0] for t, b in sample if b == v) for v in (1, 0))
            odds = math.log((hits + 0.5) / (n1 + 1)) - math.log((slips + 0.5) / (n0 + 1))
            assert hits >= 3 and slips <= toxicity.MOST_SLIPS * n0 and odds >= toxicity.LEAST_ODDS
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for d, t in [(d, t) for d, t, *_ in rows] + [(900, None), (901, "")]:
        z = model["base"] + sum(w for w, v in zip(model["weights"], plain_votes(t, model["patterns"])) if v)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(model["scale"] * z + model["shift"]))), abs=1e-9)
    held = [(got[d] >= toxicity.THRESHOLD, bad) for d, *_, bad in rows if held_out(d)]
    assert sum(a == bool(b) for a, b in held) >= 0.95 * len(held)


def test_label_model_is_a_fixed_point():
    r = np.random.default_rng(4)
    true = r.random(400) < 0.3
    votes = np.column_stack([(r.random(400) < np.where(true, a, b)) for a, b in ((0.8, 0.02), (0.6, 0.01), (0.5, 0.03))])
    votes = np.column_stack([votes, votes[:, 0]])  # a voter that repeats another
    m = toxicity.label_model(votes, 0.1, rounds=400)
    post = m["posterior"]
    for j in range(4):
        on, off = sum(post) + 1, sum(1 - post) + 1
        assert m["hit"][j] == pytest.approx((sum(p for p, v in zip(post, votes[:, j]) if v) + 0.01) / (on + 0.5), abs=1e-3)
        assert m["slip"][j] == pytest.approx((sum(1 - p for p, v in zip(post, votes[:, j]) if v) + 0.0005) / (off + 0.5), abs=1e-3)
    assert m["discount"][0] < 0.7 and m["discount"][3] < 0.7 and m["discount"][1] > 0.7
    assert np.mean((post > 0.5) == true) > 0.9

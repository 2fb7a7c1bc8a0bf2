"""Toxicity by weak supervision.

Voters are lexicon words and word-beginning patterns.  They are mined from a
bounded labelled sample (at most ``SAMPLE`` rows of each label, see
``labelled.sample``) by smoothed log-odds, together with a short built-in list.
A generative label model then explains the votes alone: by EM it estimates how
often each voter speaks on toxic and on other texts and which voters repeat each
other, whose evidence is discounted by their correlation.  A linear classifier
is trained on its posterior labels, and its scores are calibrated on the
labelled sample.  Whole texts are scored in one scan.

Defined results: null and empty texts get the score of a text on which no voter
speaks; rows that repeat get equal rows; without labels of both kinds, only the
built-in list votes; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common
from lantern.llm.labelled import logistic, sample
from lantern.llm.langid import held_out

SAMPLE = 4000
VOTERS = 384
THRESHOLD = 0.3
#: Mined voters speak on at least this part of the sample's toxic texts (three at least), on no more than
#: that part of its other ones, and are likelier by this log-odds on the former.
LEAST_RATE, MOST_SLIPS, LEAST_ODDS = 0.002, 0.001, 2.5
BUILT_IN = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum")

_WORD = re.compile(r"\w+")


def patterns_of(text: str) -> set[str]:
    """Words of a text, and their beginnings of 4, 5 and 6 letters marked ``*``."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for w in words:
        out.update(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)
    return out


class Spotter:
    """Finds which patterns occur in a text, in one pass over it."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.search = ahocorasick.Automaton()
        # Words and beginnings of the same letters share a key.
        keys: dict[str, list[tuple[int, bool]]] = {}
        for k, p in enumerate(patterns):
            keys.setdefault(p.rstrip("*"), []).append((k, p.endswith("*")))
        for key, uses in keys.items():
            self.search.add_word(key, (len(key), uses))
        if keys:
            self.search.make_automaton()
        self.empty = not keys

    def __call__(self, text: str) -> list[int]:
        if self.empty or not text:
            return []
        low, out = text.lower(), set()
        for end, (size, uses) in self.search.iter(low):
            a, b = end - size, end + 1
            if a >= 0 and _wordly(low[a]):
                continue
            on = b < len(low) and _wordly(low[b])
            out.update(k for k, start in uses if start == on)
        return sorted(out)


def _wordly(c: str) -> bool:
    return c.isalnum() or c == "_"


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> dict:
    """Latent-class EM over a (texts, voters) 0/1 matrix.

    Gives for each voter its rate on toxic (``hit``) and other texts
    (``slip``), a discount for its correlated companions, and the posterior.
    """
    n, m = votes.shape
    post = np.where(votes.any(axis=1), 0.9, 0.02)
    hit = slip = np.zeros(m)
    discount = np.ones(m)
    for step in range(rounds):
        on, off = post.sum() + 1, (1 - post).sum() + 1
        hit = np.clip((votes.T @ post + 0.5 * 0.02) / (on + 0.5), 1e-4, 0.999)
        slip = np.clip((votes.T @ (1 - post) + 0.5 * 0.001) / (off + 0.5), 1e-5, 0.999)
        if step in (5, 20):
            discount = 1 / (1 + _companions(votes, post, hit, slip))
        prior = float(np.clip(post.mean(), 0.005, 0.9)) if n else prior
        # A voter's silence says little of a text: only speaking ones count, besides the prior.
        said = (np.log(hit / slip) * discount).clip(-8, 8)
        z = votes @ said + np.log(prior / (1 - prior)) - (~votes.any(axis=1)) * 3.0
        new = 1 / (1 + np.exp(-z.clip(-30, 30)))
        if step > 21 and np.abs(new - post).max(initial=0) < 1e-6:
            post = new
            break
        post = new
    return {"hit": hit, "slip": slip, "discount": discount, "posterior": post}


def _companions(votes: np.ndarray, post: np.ndarray, hit: np.ndarray, slip: np.ndarray) -> np.ndarray:
    """Sum of each voter's positive correlations with others, given the label."""
    expected = np.outer(post, hit) + np.outer(1 - post, slip)
    rest = votes - expected
    size = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
    c = (rest.T @ rest) / np.outer(size, size)
    np.fill_diagonal(c, 0)
    return np.where(c > 0.3, c, 0).sum(axis=1)


def mined(rows: DataFrame, voters: int) -> list[str]:
    """Patterns that tell toxic texts of the sample, by smoothed log-odds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                toxic: dict[str, int] = {}
                other: dict[str, int] = {}
                part = batch.slice(at, 64)
                for text, label in zip(part["text"].to_pylist(), part["label"].to_pylist()):
                    counts = toxic if label else other
                    for p in patterns_of(text):
                        counts[p] = counts.get(p, 0) + 1
                names = sorted(toxic.keys() | other.keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic.get(p, 0) for p in names], pa.int64()), pa.array([other.get(p, 0) for p in names], pa.int64())], ["pattern", "toxic", "other"])

    n1, n0 = (rows.where(F.col("label") == v).count() for v in (1, 0))
    if not n1 or not n0:
        return []
    counts = rows.select("text", "label").transform(common.in_arrow, each, "pattern string, toxic long, other long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    top = counts.where((F.col("toxic") >= max(3, LEAST_RATE * n1)) & (F.col("other") <= MOST_SLIPS * n0)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    # Those that cover most toxic texts at the best odds come first.
    return [r.pattern for r in top.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "pattern").limit(voters).collect()]


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, voters: int = VOTERS) -> dict:
    rows = common.written(sample(docs, labels, "toxic", most), "labelled")
    patterns = list(dict.fromkeys([*BUILT_IN, *mined(rows, voters)]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = Spotter(patterns)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.string()), part["label"], pa.array([spot(t) for t in part["text"].to_pylist()], pa.list_(pa.int32()))], ["key", "label", "votes"])

    # At most twice ``most`` rows of at most ``voters`` numbers.
    got = rows.transform(common.in_arrow, vote, "key string, label int, votes array<int>").collect()
    got.sort(key=lambda r: (r.key, r.label, r.votes))
    x = np.zeros((len(got), len(patterns)))
    for k, r in enumerate(got):
        x[k, r.votes] = 1
    y = np.array([r.label for r in got], float)
    model = label_model(x.astype(bool), 0.1)
    if len(got):
        soft = model["posterior"]
        weights, base = logistic(x, soft, penalty=0.5)
        # A mined voter speaks for toxicity or is useless: none may speak against it.
        weights = np.maximum(weights, 0.0)
        # How many of the texts of each label there are is the sample's choice, not the corpus's.
        z = (x @ weights + base)[:, None]
        scale, shift = logistic(z, y, penalty=0.01) if 0 < y.sum() < len(y) else (np.ones(1), 0.0)
        scale = np.maximum(scale, 1e-6)
        # A built-in voter that the sample never heard is believed as far as 0.6 when it speaks alone.
        weights[~x.any(axis=0)] = max(0.0, (np.log(0.6 / 0.4) - shift) / scale[0] - base)
    else:
        weights, base, scale, shift = np.full(len(patterns), 3.5), -3.0, np.ones(1), 0.0
    return {"patterns": patterns, "weights": weights, "base": base, "scale": float(scale[0]), "shift": float(shift), "model": model}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row."""
    patterns, weights = model["patterns"], model["weights"].tolist()
    base, scale, shift = model["base"], model["scale"], model["shift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = Spotter(patterns)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = np.array([scale * (base + sum(weights[k] for k in spot(t))) + shift for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(1 / (1 + np.exp(-z.clip(-30, 30))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(common.in_arrow, run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Document quality by hierarchical empirical Bayes.

A logistic classifier on a few shape features of the whole text gives each
document its own evidence.  Sites are hosts and paths below them: their mean
quality is a posterior, a host's shrunk toward the global mean and a path's
toward its host's, by pseudo-counts that are estimated from the variance between
sites (method of moments).  A document's score joins its evidence with its
path's posterior as prior, so sparse sites fall back on the levels above.

The classifier is fitted on a bounded labelled sample (at most ``SAMPLE`` rows
of each label); site statistics are grouped sums over all documents.  These are
combined before the shuffle, so a site with a third of all rows is one row a
task, and the way back is a join of slim rows without texts.

Defined results: a null text counts as empty; null hosts or paths are a site of
their own; a table without labels, or with one kind only, gives every document
an evidence of one half; rows that repeat get equal rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import common
from lantern.llm.labelled import logistic, sample
from lantern.llm.langid import held_out

SAMPLE = 4000
THRESHOLD = 0.5
#: How much of a site's log-odds joins a document's own.
SITE_WEIGHT = 0.5
FEATURES = ("log words", "distinct words", "commonest word", "capitals", "signs", "lines repeated", "mean word", "marked words", "stops")


def shape(text: str | None) -> list[float]:
    """Features of a text's form; all are 0 for an empty one."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = sum(c.isupper() for c in text) if not text.islower() else 0
    plain = len(text.translate(_SIGNS))
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and len(w) > 1 and not w[-2].isalnum())
    return [
        np.log1p(n) / 10,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        upper / size,
        (size - plain) / size,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(letters / n, 20) / 20,
        marked / n,
        sum(c for w, c in counts.items() if w[-1] in ".!?") / n,
    ]


_SIGNS = {i: None for i in range(33, 127) if not chr(i).isalnum()}


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    rows = sample(docs, labels, "quality", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["label"], pa.array([shape(t) for t in part["text"].to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    got = sorted((r.label, tuple(r.x)) for r in rows.select("text", "label").transform(common.in_arrow, run, "label int, x array<double>").collect())
    y = np.array([r[0] for r in got], float)
    if not 0 < y.sum() < len(y):
        return {"weights": [0.0] * (2 * len(FEATURES)), "base": 0.0}
    x = np.array([r[1] for r in got])
    weights, base = logistic(np.column_stack((x, x * x)), y, penalty=0.01)
    return {"weights": weights.tolist(), "base": base}


def evidence(docs: DataFrame, model: dict, host: F.Column, path: F.Column) -> DataFrame:
    """doc_id, host, path and logit: what a text alone says."""
    weights, base = np.array(model["weights"]), model["base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([shape(t) for t in part["text"].to_pylist()])
                z = (np.column_stack((x, x * x)) @ weights + base).clip(-12, 12)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["host"], part["path"], pa.array(z)], ["doc_id", "host", "path", "logit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    return rows.transform(common.in_arrow, run, "doc_id long, host string, path string, logit double")


def _pseudo_count(sites: DataFrame, mean: str) -> float:
    """How many documents a prior mean is worth: within over between variance."""
    row = sites.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.expr("n * n")).alias("nn"),
        F.sum(F.expr(f"n * pow(s / n - {mean}, 2)")).alias("between"),
        F.sum(F.expr("greatest(ss - s * s / n, 0)")).alias("within"),
    ).first()
    if not row.n or row.n <= row.k or row.k < 2:
        return 10.0
    within = row.within / (row.n - row.k)
    between = (row.between - row.k * within) / max(row.n - row.nn / row.n, 1e-9)
    return float(min(max(within / max(between, 1e-6), 0.5), 1e4))


def scored(found: DataFrame, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """doc_id and score from evidence and the sites' posteriors."""
    kept = common.written(found.withColumn("p", F.expr("1 / (1 + exp(-logit))")), "evidence")
    paths = common.written(kept.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.expr("p * p")).alias("ss")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    m_host = _pseudo_count(hosts, str(mean))
    hosts = hosts.select("host", F.expr(f"(s + {m_host} * {mean}) / (n + {m_host})").alias("prior"))
    below = paths.join(hosts, "host")
    m_path = _pseudo_count(below, "prior")
    sites = common.written(below.select("host", "path", F.expr(f"(s + {m_path} * prior) / (n + {m_path})").alias("site")), "sites")
    logit = lambda c: f"ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)))"
    z = F.expr(f"logit + {site_weight} * ({logit('site')} - {logit(mean)})")
    return kept.join(sites, ["host", "path"]).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = scored(evidence(docs, fit(docs, labels), F.col("source"), F.concat_ws("/", "source", "lang")))
    kept = (F.col("score") >= THRESHOLD)
    return found.select("doc_id", held_out().alias("held_out"), "score", kept.cast("int").alias("predicted"), kept.alias("kept"))

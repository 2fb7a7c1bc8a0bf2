"""Bounded labelled samples and a small logistic regression, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import common
from lantern.llm.langid import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` learnable rows of each label.

    Those of least hash of the id, found by distributed top-n over ids alone;
    documents are then filtered by a table of at most ``2 * most`` ids.  A
    doc_id with several labels takes the larger.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = [ids.where(F.col("label") == v).orderBy(*order).limit(most) for v in (0, 1)]
    kept = common.written(chosen[0].unionByName(chosen[1]), "sample")
    return docs.select("doc_id", "text").join(kept, "doc_id").where("text is not null")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; y may be soft labels."""
    a = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])

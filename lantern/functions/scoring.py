"""Relevance as Column arithmetic over tf, df, field length, mean length and N."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer:
    """``column`` scores postings; ``score`` one posting on the driver."""

    def column(self, tf: Column, df: Column, dl: Column, avgdl: Column, n: Column) -> Column:
        raise NotImplementedError

    def score(self, tf: float, df: float, dl: float, avgdl: float, n: float) -> float:
        raise NotImplementedError


def _guarded(value: Column, tf: Column, df: Column, n: Column) -> Column:
    return F.when((tf <= 0) | (df <= 0) | (n <= 0), F.lit(0.0)).otherwise(value)


class TFIDFScorer(Scorer):
    def column(self, tf, df, dl, avgdl, n):
        return _guarded((1.0 + F.log(tf.cast("double"))) * F.log(n / df), tf, df, n)

    def score(self, tf, df, dl=0, avgdl=0, n=0):
        return 0.0 if min(tf, df, n) <= 0 else (1.0 + math.log(tf)) * math.log(n / df)


class BM25Scorer(Scorer):
    def __init__(self, k1: float = 1.2, b: float = 0.75):
        self.k1, self.b = k1, b

    def column(self, tf, df, dl, avgdl, n):
        idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
        norm = tf + self.k1 * (1.0 - self.b + self.b * dl / F.greatest(avgdl, F.lit(1.0)))
        return _guarded(idf * (tf * (self.k1 + 1.0)) / norm, tf, df, n)

    def score(self, tf, df, dl, avgdl, n):
        if min(tf, df, n) <= 0:
            return 0.0
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1.0)
        return idf * (tf * (self.k1 + 1.0)) / (tf + self.k1 * (1.0 - self.b + self.b * dl / max(avgdl, 1.0)))

    @staticmethod
    def score_multi_field(scores: list[tuple[float, float]]) -> float:
        return sum(s * b for s, b in scores)

    @staticmethod
    def multi_field_column(scores: list[tuple[Column, float]]) -> Column:
        """The same of columns: each field's score times its boost; a null is a field without a match."""
        return reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) * F.lit(float(b)) for s, b in scores), F.lit(0.0))


class PythonScorer(Scorer):
    """A scorer from a Python function of the five numbers, by an Arrow UDF."""

    def __init__(self, function: Callable[[float, float, float, float, float], float]):
        self.function = function

    def score(self, tf, df, dl, avgdl, n):
        return self.function(tf, df, dl, avgdl, n)

    def column(self, tf, df, dl, avgdl, n):
        function = self.function

        @F.pandas_udf("double")
        def run(tf: pd.Series, df: pd.Series, dl: pd.Series, avgdl: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([float(function(*x)) for x in zip(tf, df, dl, avgdl, n)])

        return run(tf, df, dl, avgdl.cast("double"), n)


def scorer_of(choice: str | Scorer) -> Scorer:
    """Any name but exactly ``bm25`` means TF-IDF (K38)."""
    if isinstance(choice, str):
        return BM25Scorer() if choice == "bm25" else TFIDFScorer()
    return choice

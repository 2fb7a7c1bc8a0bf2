"""Highlighted snippets: the densest fragments around the query's raw terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lantern.util import small_batches

_BLANK = " \n\t"


class Highlighter:
    """A term's occurrences may overlap, as in the reference, unless ``overlapping`` is False: then the next is sought after the last."""

    def __init__(self, pre_tag: str = "<b>", post_tag: str = "</b>", fragment_size: int = 150, max_fragments: int = 3, separator: str = " ... ", overlapping: bool = True):
        self.overlapping = overlapping
        self.pre_tag, self.post_tag = pre_tag, post_tag
        self.fragment_size, self.max_fragments, self.separator = fragment_size, max_fragments, separator

    def highlight(self, text: str | None, terms: list[str], fragment_size: int | None = None) -> str:
        if not text:
            return ""
        if not terms:
            return text[: self.fragment_size]
        size, low = fragment_size or self.fragment_size, text.lower()
        found = sorted((hit for term in terms if term for hit in _hits(low, term.lower(), self.overlapping)), key=lambda h: h[0])
        if not found:
            return text[:size] + "..." * (len(text) > size)
        windows: list[tuple[int, int, int, list]] = []
        for anchor, _, _ in found:
            a = max(0, anchor - size // 2)
            b = min(len(text), a + size)
            while a > 0 and text[a - 1] not in _BLANK:
                a -= 1
            while b < len(text) and text[b - 1] not in _BLANK:
                b += 1
            if any(a < y and b > x for _, x, y, _ in windows):
                continue
            inside = [h for h in found if a <= h[0] and h[1] <= b]
            windows.append((len(inside) + 2 * len({h[2] for h in inside}), a, b, inside))
        windows.sort(key=lambda w: -w[0])
        best = sorted(windows[: self.max_fragments], key=lambda w: w[1])
        return self.separator.join(self._marked(text, a, b, hits) for _, a, b, hits in best)

    def _marked(self, text: str, a: int, b: int, hits: list) -> str:
        parts, at = [], a
        for x, y, _ in hits:
            if x >= at:
                parts += [text[at:x], self.pre_tag, text[x:y], self.post_tag]
                at = y
        body = "".join([*parts, text[at:b]]).strip()
        return "..." * (a > 0) + body + "..." * (b < len(text))

    def column(self, c: Column, terms: list[str], fragment_size: int | None = None) -> Column:
        """By an Arrow UDF, over small batches of rows."""
        small_batches(SparkSession.getActiveSession())

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: self.highlight(t, terms, fragment_size))

        return run(c.cast("string"))


def _hits(low: str, term: str, overlapping: bool = True):
    at = low.find(term)
    while at >= 0:
        yield at, at + len(term), term
        at = low.find(term, at + (1 if overlapping else len(term)))

"""Analyzers: tokenizer, normalizers, stop words and stemmer in this order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions.stems import PorterStemmer, stem_arrays
from lantern.functions.text import LowercaseNormalizer, Normalizer, RegexTokenizer, StopWordFilter, Token, Tokenizer, WhitespaceTokenizer, retold


class Analyzer:
    """The same analysis for a column of documents and for a query's text.

    No tokenizer means the regex one, no normalizers (or an empty list) lower
    case; stop words and stemmer only if given.
    """

    def __init__(self, tokenizer: Tokenizer | None = None, normalizers: list[Normalizer] | None = None, stop_filter: StopWordFilter | None = None, stemmer: PorterStemmer | None = None):
        self.tokenizer = tokenizer or RegexTokenizer()
        self.normalizers = normalizers or [LowercaseNormalizer()]
        self.stop_filter, self.stemmer = stop_filter, stemmer

    def analyze(self, text: str | None) -> list[Token]:
        if not text:
            return []
        tokens = self.tokenizer.tokenize(text)
        for n in self.normalizers:
            tokens = [replace(t, text=n.text(t.text)) for t in tokens]
            if n.drops:
                tokens = [t for t in tokens if t.text]
        if self.stop_filter:
            tokens = self.stop_filter.filter(tokens)
        if self.stemmer:
            tokens = [replace(t, text=s) for t, s in zip(tokens, self.stemmer.stem_all([t.text for t in tokens]))]
        return tokens

    def analyze_to_terms(self, text: str | None) -> list[str]:
        return [t.text for t in self.analyze(text)]

    def first(self, text: str) -> str | None:
        return next(iter(self.analyze_to_terms(text)), None)

    def terms_of(self, words: list[str]) -> list[str | None]:
        """What distinct tokens of the tokenizer become; None where one is dropped."""
        told: list[str | None] = list(words)
        for n in self.normalizers:
            told = [None if t is None else n.text(t) for t in told]
            if n.drops:
                told = [t or None for t in told]
        if self.stop_filter:
            told = [None if t in self.stop_filter.words else t for t in told]
        if self.stemmer:
            distinct = list(dict.fromkeys(t for t in told if t is not None))
            stems = dict(zip(distinct, self.stemmer.stem_all(distinct)))
            told = [None if t is None else stems[t] for t in told]
        return told

    def words_column(self, c: Column) -> Column:
        """Tokens before stemming."""
        tokens = self.tokenizer.column(F.coalesce(c, F.lit("")))
        for n in self.normalizers:
            tokens = n.column(tokens)
        return self.stop_filter.column(tokens) if self.stop_filter else tokens

    def column(self, c: Column) -> Column:
        tokens = self.words_column(c)
        if self.stemmer:
            tokens = retold(tokens, stem_arrays(F.transform(tokens, lambda t: t["text"])))
        return tokens

    def terms_column(self, c: Column) -> Column:
        return F.transform(self.column(c), lambda t: t["text"])


class AnalyzerPipeline:
    """A builder: each step returns the builder."""

    def __init__(self):
        self._parts: dict = {"normalizers": []}

    def tokenizer(self, t: Tokenizer) -> AnalyzerPipeline:
        self._parts["tokenizer"] = t
        return self

    def add_normalizer(self, n: Normalizer) -> AnalyzerPipeline:
        self._parts["normalizers"].append(n)
        return self

    def stop_words(self, words: set[str] | None = None) -> AnalyzerPipeline:
        self._parts["stop_filter"] = StopWordFilter(words)
        return self

    def stemmer(self, s: PorterStemmer | None = None) -> AnalyzerPipeline:
        self._parts["stemmer"] = s or PorterStemmer()
        return self

    def build(self) -> Analyzer:
        return Analyzer(**self._parts)


def standard_analyzer() -> Analyzer:
    return Analyzer(RegexTokenizer(), [LowercaseNormalizer()], StopWordFilter(), PorterStemmer())


def simple_analyzer() -> Analyzer:
    return Analyzer(WhitespaceTokenizer(), [LowercaseNormalizer()])


def keyword_analyzer() -> Analyzer:
    """As the simple one: a keyword query is split at blanks (K20)."""
    return simple_analyzer()


def exact_analyzer() -> Analyzer:
    """As the simple one: an empty list of normalizers means lower case (K19)."""
    return Analyzer(WhitespaceTokenizer(), [])

"""Tokenizers, normalizers and stop words, as Column expressions and in Python.

Documents are analysed by Column expressions in the JVM, query terms by the
Python side of the same object on the driver.  Character classes are chosen so
that both agree (``\\w`` of Python is letters, numbers and the low line; its
``\\s`` has the four separators U+001C to U+001F, which Java's lacks).

Token columns are ``array<struct<text:string, position:int>>``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lantern.util import small_batches

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
PYTHON_WORD = r"\w+(?:[-']\w+)*"
TOKENS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))
#: Tokens that :meth:`Tokenizer.offsets_table` makes at once.
SENT_TOKENS = 1 << 15


@dataclass(frozen=True)
class Token:
    text: str
    position: int
    start_char: int = 0
    end_char: int = 0


def numbered(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), i.alias("position")))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


class Tokenizer:
    def tokenize(self, text: str) -> list[Token]:
        raise NotImplementedError

    def each(self, text: str) -> Iterator[tuple[str, int, int, int]]:
        """The tokens' values one by one, where a tokenizer can give them so."""
        return ((t.text, t.position, t.start_char, t.end_char) for t in self.tokenize(text))

    def words(self, text: str) -> list[str]:
        """The tokens' texts."""
        return [t.text for t in self.tokenize(text)]

    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def with_offsets(self, c: Column) -> Column:
        """Tokens with character offsets, which no JVM expression gives."""

        @F.pandas_udf(TOKENS)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [(x.text, x.position, x.start_char, x.end_char) for x in self.tokenize(t or "")])

        return run(c)

    def offsets_table(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, text, position, start_char, end_char), a row for each token; Python holds ``SENT_TOKENS`` of them at once, however long a text is."""
        kind = df.schema[key].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = to_arrow_schema(T.StructType([T.StructField(key, kind), *TOKENS.elementType.fields]))
            for batch in batches:
                tokens = ((row, *x) for row, value in enumerate(batch[1]) for x in self.each(value.as_py() or ""))
                while part := list(islice(tokens, SENT_TOKENS)):
                    rows, *columns = zip(*part)
                    own = batch[0].take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(columns, list(shape)[1:]))], schema=shape)

        small_batches(df.sparkSession)
        return df.select(key, text).mapInArrow(run, T.StructType([T.StructField(key, kind), *TOKENS.elementType.fields]))


class RegexTokenizer(Tokenizer):
    """Matches of a pattern; ``java`` is its form for the JVM, if another."""

    def __init__(self, pattern: str | None = None, java: str | None = None):
        self.pattern = pattern or PYTHON_WORD
        self.java = java or (pattern if pattern else WORD)

    def each(self, text: str) -> Iterator[tuple[str, int, int, int]]:
        return ((m.group(), k, *m.span()) for k, m in enumerate(re.finditer(self.pattern, text)))

    def tokenize(self, text: str) -> list[Token]:
        return [Token(*t) for t in self.each(text)]

    def words(self, text: str) -> list[str]:
        found = re.compile(self.pattern)
        return [m.group() for m in found.finditer(text)] if found.groups else found.findall(text)

    def column(self, c: Column) -> Column:
        return numbered(F.regexp_extract_all(c, F.lit(self.java), F.lit(0)))


class WhitespaceTokenizer(RegexTokenizer):
    def __init__(self):
        super().__init__(r"\S+", NO_SPACE)


class NgramTokenizer(Tokenizer):
    """Character n-grams of the text with blanks collapsed, by n and place."""

    def __init__(self, min_n: int = 2, max_n: int = 3):
        self.min_n, self.max_n = min_n, max_n

    def tokenize(self, text: str) -> list[Token]:
        clean = re.sub(r"\s+", " ", text.strip())
        grams = ((clean[a : a + n], a, a + n) for n in range(self.min_n, self.max_n + 1) for a in range(len(clean) - n + 1))
        return [Token(g, k, a, b) for k, (g, a, b) in enumerate(x for x in grams if x[0].strip())]

    def column(self, c: Column) -> Column:
        clean = F.regexp_replace(strip_space(c), SPACE + "+", " ")
        none = F.array().cast("array<string>")

        def of(n: Column) -> Column:
            starts = F.sequence(F.lit(1), F.length(clean) - n + 1)
            return F.when(F.length(clean) >= n, F.transform(starts, lambda a: F.substring(clean, a, n))).otherwise(none)

        sizes = F.array(*(F.lit(n) for n in range(self.min_n, self.max_n + 1)))
        return numbered(F.filter(F.flatten(F.transform(sizes, of)), lambda g: F.trim(g) != ""))


class SentenceTokenizer:
    """Splits after . ! or ? where blanks and a capital follow."""

    def tokenize(self, text: str) -> list[str]:
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]

    def column(self, c: Column) -> Column:
        parts = F.split(c, rf"(?<=[.!?]){SPACE}+(?=[A-Z])")
        return F.filter(F.transform(parts, strip_space), lambda s: s != "")


class Normalizer:
    """Changes token texts; tokens that become blank stay unless ``drops``."""

    drops = False

    def text(self, t: str) -> str:
        raise NotImplementedError

    def column(self, tokens: Column) -> Column:
        """By an Arrow UDF over the texts; a JVM expression where there is one."""

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda a: None if a is None else [self.text(t) for t in a])

        return retold(tokens, run(F.transform(tokens, lambda t: t["text"])))


def retold(tokens: Column, texts: Column) -> Column:
    return F.zip_with(tokens, texts, lambda t, x: F.struct(x.alias("text"), t["position"].alias("position")))


class LowercaseNormalizer(Normalizer):
    def text(self, t: str) -> str:
        return t.lower()

    def column(self, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lower(t["text"]).alias("text"), t["position"].alias("position")))


class UnicodeNormalizer(Normalizer):
    def __init__(self, form: str = "NFC"):
        self.form = form

    def text(self, t: str) -> str:
        return unicodedata.normalize(self.form, t)


class AccentStripper(Normalizer):
    def text(self, t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")


class PunctuationStripper(Normalizer):
    drops = True
    marks = ".,;:!?\"'()[]{}…—–-"

    def text(self, t: str) -> str:
        return t.strip(self.marks)

    def column(self, tokens: Column) -> Column:
        some = "[" + re.escape(self.marks) + "]+"
        bare = F.transform(tokens, lambda t: F.struct(F.regexp_replace(t["text"], f"^{some}|{some}$", "").alias("text"), t["position"].alias("position")))
        return F.filter(bare, lambda t: F.length(t["text"]) > 0)


ENGLISH_STOP_WORDS = frozenset(
    """a about after again all also am an and any are as at be because been before being between both but by can could did do does doing down during
    each few for from get got had has have he her here herself him himself his how i if in into is it its itself just let me more most must my myself
    no nor not now of off on once only or other our out over own same say she should so some such tell than that the their them then there these they
    this those through to too under until up upon us very want was way we well went were what when where which while who whom why will with work would
    you your""".split()
)


class StopWordFilter:
    """Drops tokens of a set; None: the English list. Positions keep their gaps."""

    def __init__(self, words: set[str] | frozenset[str] | None = None):
        self.words = ENGLISH_STOP_WORDS if words is None else frozenset(words)

    def filter(self, tokens: list[Token]) -> list[Token]:
        return [t for t in tokens if t.text not in self.words]

    def column(self, tokens: Column) -> Column:
        if not self.words:
            return tokens
        return F.filter(tokens, lambda t: ~t["text"].isin(*sorted(self.words)))

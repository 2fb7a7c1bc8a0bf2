"""The inverted index as tables.

``postings(field, term, doc_id, tf, positions, dl)``, ``terms(field, term, df,
cf)`` and ``lengths(field, doc_id, dl)``.  What is kept of an analysis are blocks
(:func:`analysed`): a term's postings in some thousands of documents that lie
together are one row of arrays, ordered by term within a block, and a row with a
null term holds these documents' lengths.  Nothing is shuffled, a term has far
fewer rows than postings, and the dictionary reads none of the arrays.  Texts are
analysed in Python, each distinct word of a block once; a block ends at a number
of tokens, whatever the documents' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.text import strip_space
from lantern.sources.schema import Schema
from lantern.util import small_batches

POSTINGS = "field string, term string, doc_id bigint, tf bigint, positions array<int>, dl int"
TERMS = "field string, term string, df bigint, cf bigint"
LENGTHS = "field string, doc_id bigint, dl int"
#: A block's rows: of a term, ``doc_ids``, ``tfs``, ``dls`` and where each one's ``positions`` start; with a null term, ids and lengths.
BLOCKS = "field string, term string, df bigint, cf bigint, doc_ids array<bigint>, tfs array<int>, dls array<int>, starts array<int>, positions array<int>"
#: A block ends at so many tokens or documents.
BLOCK_TOKENS = 1 << 21
BLOCK_DOCS = 1 << 16
#: Rows of a block that go to the JVM at once.
SENT_ROWS = 1 << 13


def text_of(c: Column, kind: T.DataType) -> Column:
    """A value as Python's str() shows it, for the types that differ."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text, size = c.cast("string"), F.abs(c)
        whole = F.concat(F.format_string("%.0f", c.cast("double")), F.lit(".0"))
        plain = F.when((c == F.floor(c)) & (size < 1e16), whole).when((size >= 1e7) & (size < 1e16), F.regexp_replace(c.cast("decimal(38,17)").cast("string"), "0+$", ""))
        # Java's exponents: 1.0E-5 is 1e-05 to Python; from 1e-4 on it writes the number out.
        small = F.when((size >= 1e-4) & (size < 1e-3), F.regexp_replace(F.format_string("%.20f", c.cast("double")), "0+$", ""))
        power = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\.0e", "e"), r"e(\d)", "e+$1"), r"e([+-])(\d)$", "e$10$2")
        return F.when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(c == 0, F.lit("0.0")).otherwise(F.coalesce(plain, small, power))
    return c.cast("string")


def keyword_values(docs: DataFrame, name: str) -> Column:
    """A keyword column as an array of texts; only arrays have several values."""
    kind = docs.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: F.coalesce(text_of(v, kind.elementType), F.lit("None")))
    return F.when(c.isNotNull(), F.array(text_of(c, kind)))


class _Words(dict):
    """Numbers words by their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 to 2^32, by two radix sorts."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)[order]
    return order if not len(high) or high.max() == 0 else order[np.argsort(high, kind="stable")]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class _Block:
    """Documents of a field, and their words as numbers."""

    def __init__(self, field: str):
        self.field, self.words, self.ids, self.numbers, self.sizes, self.tokens = field, _Words(), [], [], [], 0

    def add(self, doc_id: int, words: list[str]) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.tokens += len(words)

    def batches(self, terms_of, lengths: list[int] | None = None, place: bool = True) -> Iterator[pa.RecordBatch]:
        """``terms_of``: the terms of distinct words, None where a word is dropped; ``lengths``: if not the number of terms."""
        found = terms_of(list(self.words))
        names = sorted({t for t in found if t is not None})
        at = {t: k for k, t in enumerate(names)}
        number = np.array([at.get(t, -1) for t in found], np.int64)
        sizes = np.array(self.sizes, np.int64)
        n, ids = len(sizes), np.array(self.ids, np.int64)
        term = number[np.concatenate(self.numbers)] if self.tokens else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        position = (np.arange(self.tokens) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32) if place else np.zeros(self.tokens, np.int32)
        if len(term) and term.min() < 0:
            kept = term >= 0
            term, doc, position = term[kept], doc[kept], position[kept]
        dls = (np.bincount(doc, minlength=n) if lengths is None else np.array(lengths)).astype(np.int32)
        order = _ordered(term)
        term, doc, position = term[order], doc[order], position[order]
        # Where a posting begins among the tokens, and where a term does among postings and tokens.
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        tfs = np.diff(np.concatenate([begins, [len(term)]])).astype(np.int32)
        hit_term, hit_doc = term[begins], doc[begins]
        edges = np.searchsorted(hit_term, np.arange(len(names) + 1))
        token_edges = np.concatenate([begins, [len(term)]])[edges]
        starts = (begins - token_edges[hit_term]).astype(np.int32)
        columns = [
            pa.array([self.field] * len(names), pa.string()),
            pa.array(names, pa.string()),
            pa.array(np.diff(edges), pa.int64()),
            pa.array(np.diff(token_edges), pa.int64()),
            _lists(edges, ids[hit_doc], pa.int64()),
            _lists(edges, tfs, pa.int32()),
            _lists(edges, dls[hit_doc], pa.int32()),
            _lists(edges, starts, pa.int32()),
            _lists(token_edges, position, pa.int32()),
        ]
        shape = [x.split()[0] for x in BLOCKS.split(", ")]
        whole = pa.RecordBatch.from_arrays(columns, shape)
        for a in range(0, len(names), SENT_ROWS):
            yield whole.slice(a, SENT_ROWS)
        all_docs = np.array([0, n])
        none = pa.nulls(1, pa.list_(pa.int32()))
        lengths_row = [pa.array([self.field]), pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([int(dls.sum())], pa.int64()), _lists(all_docs, ids, pa.int64()), none, _lists(all_docs, dls, pa.int32()), none, none]
        yield pa.RecordBatch.from_arrays(lengths_row, shape)


def _text_rows(docs: DataFrame, schema: Schema, name: str) -> DataFrame:
    kind, analyzer = docs.schema[name].dataType, schema.get(name).get_analyzer()
    rows = docs.where(F.col(f"`{name}`").isNotNull()).select("doc_id", text_of(F.col(f"`{name}`"), kind).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(name)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                block.add(doc_id, analyzer.tokenizer.words(text.as_py() or ""))
                if block.tokens >= BLOCK_TOKENS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.batches(analyzer.terms_of)
                    block = _Block(name)
        if block.ids:
            yield from block.batches(analyzer.terms_of)

    small_batches(docs.sparkSession)
    return rows.mapInArrow(blocks, BLOCKS)


def _keyword_rows(docs: DataFrame, name: str) -> DataFrame:
    values = docs.select("doc_id", keyword_values(docs, name).alias("v")).where("v is not null")
    values = values.select("doc_id", F.transform("v", lambda v: strip_space(F.lower(v))).alias("v"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def terms_of(words: list[str]) -> list[str | None]:
            return [w or None for w in words]

        block, lengths = _Block(name), []
        for batch in batches:
            for doc_id, words in zip(batch["doc_id"].to_pylist(), batch["v"]):
                block.add(doc_id, [w or "" for w in words.as_py()])
                lengths.append(block.sizes[-1])
                if block.tokens >= BLOCK_TOKENS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.batches(terms_of, lengths, place=False)
                    block, lengths = _Block(name), []
        if block.ids:
            yield from block.batches(terms_of, lengths, place=False)

    return values.mapInArrow(blocks, BLOCKS)


def _union(parts: list[DataFrame], spark: SparkSession, shape: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], shape)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores, where a scan of few or badly split files gives fewer parts than these.

    A table of more files than cores, and a plan that shuffles anyway, stay as they are.
    """
    plan, cores = docs._jdf.queryExecution().executedPlan(), docs.sparkSession.sparkContext.defaultParallelism
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or docs.rdd.getNumPartitions() >= cores:
        return docs
    return docs.repartition(cores)


def indexed_fields(docs: DataFrame, schema: Schema) -> tuple[list[str], list[str]]:
    there = set(docs.columns)
    return [n for n in schema.get_text_fields() if n in there], [n for n in schema.get_keyword_fields() if n in there]


def analysed(docs: DataFrame, schema: Schema) -> DataFrame:
    """Blocks of all fields: postings, and rows with a null term for the lengths of the documents' fields."""
    text, keyword = indexed_fields(docs, schema)
    parts = [_text_rows(docs, schema, n) for n in text] + [_keyword_rows(docs, n) for n in keyword]
    return _union(parts, docs.sparkSession, BLOCKS)


def postings_of(rows: DataFrame) -> DataFrame:
    hits = rows.where("term is not null").select("field", "term", "positions", F.inline(F.arrays_zip("doc_ids", "tfs", "dls", "starts")))
    own = F.slice("positions", F.col("starts") + 1, F.col("tfs"))
    return hits.select("field", "term", F.col("doc_ids").alias("doc_id"), F.col("tfs").cast("bigint").alias("tf"), own.alias("positions"), F.col("dls").alias("dl"))


def lengths_of(rows: DataFrame) -> DataFrame:
    """Lengths of all documents that have a field, empty ones included."""
    each = rows.where("term is null").select("field", F.inline(F.arrays_zip("doc_ids", "dls")))
    return each.select("field", F.col("doc_ids").alias("doc_id"), F.col("dls").alias("dl"))


def dictionary_of(rows: DataFrame) -> DataFrame:
    """:func:`dictionary` of blocks, which reads none of their postings."""
    return rows.where("term is not null").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def totals_of(rows: DataFrame) -> dict[str, int]:
    """The sum of each field's lengths."""
    return {r.field: int(r.n) for r in rows.where("term is null").groupBy("field").agg(F.sum("cf").alias("n")).collect()}


def build_postings(docs: DataFrame, schema: Schema) -> DataFrame:
    return postings_of(analysed(docs, schema))


def field_lengths(docs: DataFrame, schema: Schema) -> DataFrame:
    return lengths_of(analysed(docs, schema))


def dictionary(postings: DataFrame) -> DataFrame:
    """Per (field, term): df counts documents, cf occurrences."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def lookup(postings: DataFrame, field: str, term: str) -> DataFrame:
    return postings.where((F.col("field") == field) & (F.col("term") == term))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Posting lists together: frequencies add, positions join in order."""
    both = left.unionByName(right).groupBy("field", "term", "doc_id")
    return both.agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("dl").alias("dl"))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").intersect(right.select("doc_id"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").union(right.select("doc_id")).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").subtract(right.select("doc_id"))


def by_doc(postings: DataFrame, doc_id: int) -> DataFrame:
    return postings.where(F.col("doc_id") == doc_id)

"""The search engine: documents in, ranked pages out."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.scoring import Scorer, scorer_of
from lantern.functions.snippets import Highlighter
from lantern.operators import facets as facet_ops
from lantern.operators import postings as index_ops
from lantern.plans.ast import Query, raw_terms
from lantern.plans.compile import Compiler, Index
from lantern.plans.parser import QueryParser
from lantern.sources.schema import Schema, TextField
from lantern.sources.store import SegmentStore

SOURCE = "_source"
#: A commit beyond so many segments writes the index anew as one.
MOST_SEGMENTS = 16
#: Values of a field that :meth:`SearchEngine.search` counts for its caller, the most frequent first.
FACET_LIMIT = 10_000


class SearchHit:
    """One document of a page; ``highlight`` marks the query's words on demand."""

    def __init__(self, doc_id: int, score: float, doc: dict, highlighter: Highlighter | None = None, terms: list[str] | None = None):
        self.doc_id, self.score, self.doc = doc_id, score, doc
        self._highlighter, self._terms = highlighter, terms or []

    def highlight(self, field: str, fragment_size: int | None = None) -> str:
        text = self.doc.get(field, "")
        if not text or self._highlighter is None:
            return str(text)
        return self._highlighter.highlight(str(text), self._terms, fragment_size)

    def __repr__(self) -> str:
        return f"SearchHit({self.doc_id}, {self.score:.4f})"


class SearchResults:
    def __init__(self, hits: list[SearchHit], total: int, query_time_ms: float, facets: dict[str, dict[str, int]]):
        self.hits, self.total, self.query_time_ms, self.facets = hits, total, query_time_ms, facets

    def __iter__(self) -> Iterator[SearchHit]:
        return iter(self.hits)

    def __len__(self) -> int:
        return len(self.hits)


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that is none of ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def dense_ids(df: DataFrame, start: int, column: str = "doc_id") -> DataFrame:
    """Adds ids without gaps, in partition order, from a count per partition."""
    at = fresh_name("at", df.columns)
    placed = df.withColumn(at, F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    sizes = placed.groupBy(F.shiftright(at, 33).alias("part")).count().orderBy("part").collect()  # a row for each partition
    offsets, total = [], start
    for r in sizes:
        offsets.append((r["part"], total))
        total += r["count"]
    if not offsets:
        return df.withColumn(column, F.lit(None).cast("bigint"))
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "part bigint, base bigint"))  # as many rows as partitions
    joined = placed.join(base, F.shiftright(placed[at], 33) == base["part"])
    return joined.select((base["base"] + placed[at].bitwiseAND(F.lit((1 << 33) - 1))).alias(column), *(placed[f"`{c}`"] for c in df.columns if c != column))


def together(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column of two kinds becomes text, or lists of text.

    Numbers of two widths stay numbers.
    """
    changed: list[dict] = [{}, {}]
    for name in set(a.columns) & set(b.columns):
        kinds = [d.schema[name].dataType for d in (a, b)]
        if kinds[0] == kinds[1] or all(isinstance(k, T.NumericType) for k in kinds):
            continue
        lists = any(isinstance(k, T.ArrayType) for k in kinds)
        for d, kind, out in zip((a, b), kinds, changed):
            out[name] = index_ops.keyword_values(d, name) if lists else index_ops.text_of(F.col(f"`{name}`"), kind)
    a, b = (d.withColumns(c) if c else d for d, c in zip((a, b), changed))
    return a.unionByName(b, allowMissingColumns=True)


class SearchEngine:
    """Full-text search over DataFrames.

    ``add`` and ``add_many`` buffer dicts; ``index_documents`` takes a DataFrame
    of any size.  The index is built on first use and stored by ``commit``.
    With ``negation="exclude"`` a parsed NOT excludes; by default it follows the
    reference semantics, where it matches nothing.

    A commit writes what was added since the last one as a segment of its own;
    removals, and more than ``MOST_SEGMENTS`` segments, write all anew as one.
    """

    def __init__(self, path: str | None = None, schema: Schema | None = None, scorer: str | Scorer = "bm25", spark: SparkSession | None = None, negation: str = "reference"):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.schema = schema or Schema(content=TextField())
        self.scorer, self.negation = scorer_of(scorer), negation
        self.highlighter = Highlighter()
        self._parser = QueryParser(self.schema.get_searchable_fields())
        self._store = SegmentStore(self.spark, path) if path else None
        self._buffer: list[tuple[int, dict]] = []
        self._docs: DataFrame | None = None
        # Postings and lengths of the documents indexed so far, and the documents that are not yet in them.
        self._base: tuple[DataFrame, DataFrame] | None = None
        self._fresh: DataFrame | None = None
        # The blocks of all postings, while no removed or stored ones are among these.
        self._whole: DataFrame | None = None
        # What was analysed since the last commit, as (documents, rows); and whether what was stored changed as well.
        self._pending: list[tuple[DataFrame, DataFrame]] = []
        self._rewritten = False
        #: The last batch of each stream that the index holds.
        self.streams: dict[str, int] = {}
        self._index: Index | None = None
        self._next = 0
        self._phantom: set[str] = set()
        self._dirty = False
        if self._store and self._store.exists():
            self._load()

    # ------------------------------------------------------- documents

    def add(self, document: dict[str, Any]) -> int:
        self._buffer.append((self._next, dict(document)))
        self._next += 1
        self._touched()
        return self._next - 1

    def add_many(self, documents: list[dict[str, Any]]) -> list[int]:
        return [self.add(d) for d in documents]

    def index_documents(self, df: DataFrame, id_col: str | None = None) -> None:
        """Adds a DataFrame; ids are ``id_col``'s or new ones without gaps."""
        self._flush()
        if id_col:
            rows = df.withColumn("doc_id", F.col(id_col).cast("bigint"))
            top = rows.agg(F.max("doc_id")).first()[0]
            self._next = max(self._next, (-1 if top is None else top) + 1)
        else:
            rows = dense_ids(df, self._next)
            self._next += rows.count()
        self._append(rows)
        self._phantom |= {n for n in self.schema.get_numeric_fields() if n in df.columns}
        self._touched()

    def _touched(self) -> None:
        self._index, self._dirty = None, True

    def _append(self, new: DataFrame) -> None:
        self._docs, self._fresh = (new if d is None else together(d, new) for d in (self._docs, self._fresh))

    def _without(self, gone: DataFrame) -> None:
        self._docs, self._fresh = (d and d.join(gone, "doc_id", "left_anti") for d in (self._docs, self._fresh))
        self._base = self._base and tuple(d.join(gone, "doc_id", "left_anti") for d in self._base)
        self._whole = None
        self._phantom, self._rewritten = set(), True
        self._touched()

    def _row(self, doc_id: int, document: dict) -> dict:
        row: dict[str, Any] = {"doc_id": doc_id, SOURCE: json.dumps(document, default=str)}
        for name, value in document.items():
            kind = self.schema.get(name)
            if value is None:
                continue
            if kind is not None and kind.kind == "text":
                row[name] = str(value)
            elif isinstance(value, list) or kind is not None and kind.kind == "keyword":
                row[name] = [str(v) for v in value] if isinstance(value, list) else [str(value)]
            elif isinstance(value, (bool, int, float)):
                row[name] = value
            else:
                row[name] = str(value)
        return row

    def _flush(self) -> None:
        if not self._buffer:
            return
        rows = [self._row(i, d) for i, d in self._buffer]
        self._phantom |= {n for n in self.schema.get_numeric_fields() if any(d.get(n) is not None for _, d in self._buffer)}
        shape = ["doc_id bigint", f"`{SOURCE}` string"]
        for name in dict.fromkeys(k for r in rows for k in r if k not in ("doc_id", SOURCE)):
            values = [r[name] for r in rows if name in r]
            if all(isinstance(v, list) for v in values):
                shape.append(f"`{name}` array<string>")
            elif all(isinstance(v, bool) for v in values):
                shape.append(f"`{name}` boolean")
            elif all(isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 63 for v in values):
                shape.append(f"`{name}` bigint")
            elif all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
                shape.append(f"`{name}` double")
                for r in rows:
                    if name in r:
                        r[name] = float(r[name])
            else:
                shape.append(f"`{name}` string")
                for r in rows:
                    if name in r:
                        r[name] = str(r[name])
        names = [s.split()[0].strip("`") for s in shape]
        new = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(shape))
        self._append(new)
        self._buffer = []

    def remove(self, doc_id: int) -> bool:
        """Drops a document; False if there is none of that id."""
        if self.get(doc_id) is None:
            return False
        self._buffer = [(i, d) for i, d in self._buffer if i != doc_id]
        self._without(self.spark.createDataFrame([(doc_id,)], "doc_id bigint"))
        return True

    def remove_where(self, ids: DataFrame) -> None:
        """Drops the documents of a table of doc_ids, in bulk."""
        self._flush()
        self._without(ids.select("doc_id"))

    def get(self, doc_id: int) -> dict | None:
        for i, d in self._buffer:
            if i == doc_id:
                return d
        if self._docs is None:
            return None
        row = self._docs.where(F.col("doc_id") == doc_id).head()
        return None if row is None else _document(row.asDict())

    @property
    def documents(self) -> DataFrame:
        self._flush()
        return self._docs if self._docs is not None else self.spark.createDataFrame([], f"doc_id bigint, `{SOURCE}` string")

    # ----------------------------------------------------------- index

    @property
    def index(self) -> Index:
        for _, rows in self._pending:
            if not (rows.storageLevel.useMemory or rows.storageLevel.useDisk):  # another cleared the session's cache
                rows.persist(StorageLevel.MEMORY_AND_DISK)
        if self._index is None:
            # Documents are read where they lie; only what was computed from them is kept.
            docs = self.documents
            fresh = docs if self._base is None else self._fresh
            if fresh is not None:  # an append analyses what is new
                rows = index_ops.analysed(index_ops.spread(fresh), self.schema).persist(StorageLevel.MEMORY_AND_DISK)
                self._pending.append((fresh, rows))
                new = index_ops.postings_of(rows), index_ops.lengths_of(rows)
                self._whole = rows if self._base is None else self._whole and self._whole.unionByName(rows)
                self._base = new if self._base is None else tuple(a.unionByName(b) for a, b in zip(self._base, new))
            self._fresh = None
            self._index = self._facts(docs, *self._base)
        return self._index

    def _facts(self, docs: DataFrame, postings: DataFrame, lengths: DataFrame) -> Index:
        if self._whole is not None:  # nothing but these blocks: a lookup of a term's df reads the blocks that can hold it
            return Index(self.spark, self.schema, docs, postings, index_ops.dictionary_of(self._whole), docs.count(), index_ops.totals_of(self._whole))
        terms = index_ops.dictionary(postings).persist(StorageLevel.MEMORY_AND_DISK)
        totals = {r.field: int(r.n) for r in lengths.groupBy("field").agg(F.sum("dl").alias("n")).collect()}
        return Index(self.spark, self.schema, docs, postings, terms, docs.count(), totals)

    # ---------------------------------------------------------- search

    def parse(self, query: str | Query) -> Query:
        return self._parser.parse(query) if isinstance(query, str) else query

    def matches(self, query: str | Query, filters: dict[str, list[str]] | None = None) -> DataFrame:
        """(doc_id, score) of all matches, lazily."""
        chosen = facet_ops.FacetFilter()
        for field, values in (filters or {}).items():
            chosen.add_filter(field, values)
        index = self.index
        return Compiler(index, self.scorer, self.negation).matched(self.parse(query), chosen.column(index.docs) if chosen.active else None)

    def page(self, query: str | Query, limit: int = 10, offset: int = 0, filters: dict[str, list[str]] | None = None) -> DataFrame:
        """Best matches with their documents, as a DataFrame; a document's own ``score`` is ``document_score`` here."""
        found, rank = self._joined(self.matches(query, filters), limit, offset)
        if rank != "score":
            found = found.withColumnRenamed("score", fresh_name("document_score", found.columns)).withColumnRenamed(rank, "score")
        return found.orderBy(F.desc("score"), "doc_id")

    def _joined(self, matched: DataFrame, limit: int, offset: int) -> tuple[DataFrame, str]:
        """The ranked rows with their documents, and the name that their score has there."""
        docs = self.index.docs
        rank = fresh_name("score", docs.columns)
        return self._ranked(matched, limit, offset).withColumnRenamed("score", rank).join(docs, "doc_id"), rank

    @staticmethod
    def _ranked(matched: DataFrame, limit: int, offset: int) -> DataFrame:
        return matched.orderBy(F.desc("score"), F.asc("doc_id")).offset(offset).limit(limit)

    def with_highlight(self, page: DataFrame, query: str | Query, field: str, name: str = "snippet", fragment_size: int | None = None, highlighter: Highlighter | None = None) -> DataFrame:
        return page.withColumn(name, (highlighter or self.highlighter).column(F.col(f"`{field}`"), raw_terms(self.parse(query)), fragment_size))

    def search(self, query: str | Query, limit: int = 10, offset: int = 0, facets: list[str] | None = None, filters: dict[str, list[str]] | None = None, facet_limit: int = FACET_LIMIT) -> SearchResults:
        """A page of hits with the number of all matches.

        Of each facet, the ``facet_limit`` most frequent values come to the
        driver; ``facets.facet_counts`` gives all of them as a table.
        """
        began, parsed = time.perf_counter(), self.parse(query)
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset can't be negative")
        index = self.index
        matched = self.matches(parsed, filters).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total = matched.count()
            counts: dict[str, dict[str, int]] = {}
            if facets and total:
                found = facet_ops.facet_counts(index.docs.join(matched, "doc_id", "left_semi"), facets)
                counts = facet_ops.FacetCollector.counted(found, facet_limit).to_dict()
            page, rank = self._joined(matched, limit, offset)
            rows = page.collect() if limit and total else []
        finally:
            matched.unpersist()
        words = raw_terms(parsed)
        hits = [SearchHit(r["doc_id"], r[rank], _document({k: v for k, v in r.asDict().items() if k != rank}), self.highlighter, words) for r in rows]
        hits.sort(key=lambda h: (-h.score, h.doc_id))
        return SearchResults(hits, total, round((time.perf_counter() - began) * 1000, 2), counts)

    def search_many(self, queries: dict[str, str | Query], limit: int = 10) -> DataFrame:
        """(query, place, doc_id, score): the best of each query, in one job."""
        parts = [self.matches(q).withColumn("query", F.lit(name)) for name, q in queries.items()]
        if not parts:
            return self.spark.createDataFrame([], "query string, place int, doc_id bigint, score double")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query", "place", "doc_id", "score")

    # ----------------------------------------------------- persistence

    def tables(self) -> tuple[dict[str, DataFrame], dict]:
        """The whole index as tables, and the facts that go with them."""
        index = self.index
        tables = {"docs": index.docs, "postings": index.postings, "terms": index.terms, "lengths": self._base[1]}
        facts = {"schema": self.schema.to_json(), "next_doc_id": self._next, "doc_count": index.doc_count, "total_lengths": index.total_lengths, "phantom": sorted(self._phantom), "streams": self.streams}
        return tables, facts

    def load_tables(self, tables: dict[str, DataFrame], facts: dict) -> None:
        """Takes over an index as :meth:`tables` gives it, in place of its own."""
        if facts["schema"] != self.schema.to_json():
            raise ValueError("the index has another schema")
        self._docs, self._fresh, self._buffer, self._next = tables["docs"], None, [], facts["next_doc_id"]
        self._pending, self._rewritten, self._whole = [], True, None
        self._phantom, self.streams = set(facts["phantom"]), dict(facts.get("streams", {}))
        shapes = {"postings": index_ops.POSTINGS, "terms": index_ops.TERMS, "lengths": index_ops.LENGTHS}
        shaped = {t: tables[t].select(*self.spark.createDataFrame([], shape).columns) if facts["doc_count"] else self.spark.createDataFrame([], shape) for t, shape in shapes.items()}
        self._base = shaped["postings"], shaped["lengths"]
        self._index = Index(self.spark, self.schema, tables["docs"], shaped["postings"], shaped["terms"], facts["doc_count"], facts["total_lengths"])

    def export_json(self, path: str) -> None:
        """Every table as JSON lines in a folder, and facts.json's one line."""
        tables, facts = self.tables()
        for name, df in tables.items():
            df.write.mode("overwrite").json(f"{path}/{name}")
        self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    def import_json(self, path: str) -> None:
        facts = json.loads(self.spark.read.text(f"{path}/facts").first()[0])
        shapes = {"postings": index_ops.POSTINGS, "terms": index_ops.TERMS, "lengths": index_ops.LENGTHS}
        tables = {n: self.spark.read.schema(s).json(f"{path}/{n}") for n, s in shapes.items()}
        docs = self.spark.read.json(f"{path}/docs") if facts["doc_count"] else self.spark.createDataFrame([], f"doc_id bigint, `{SOURCE}` string")
        self.load_tables({**tables, "docs": docs}, facts)
        self._dirty = True

    def commit(self) -> None:
        if not (self._store and self._dirty):
            return
        tables, facts = self.tables()
        layout = {
            "postings": lambda d: d.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field"),
            "terms": lambda d: d.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field"),
            "docs": lambda d: d.write,
        }
        before = len(self._store.list_segments())
        if self._rewritten or not 0 < before < MOST_SEGMENTS:
            self._store.compact(tables, facts=facts, layout=layout)
        else:
            docs, rows = self._pending[0] if self._pending else (tables["docs"].limit(0), self.spark.createDataFrame([], index_ops.BLOCKS))
            for more, of_more in self._pending[1:]:
                docs, rows = together(docs, more), rows.unionByName(of_more)
            postings = index_ops.postings_of(rows)
            new = {"docs": docs, "postings": postings, "terms": index_ops.dictionary_of(rows), "lengths": index_ops.lengths_of(rows)}
            self._store.save_segment(new, facts=facts, layout=layout)
        for _, rows in self._pending:
            rows.unpersist()
        self._dirty = False
        self._load()

    def _load(self) -> None:
        segments = self._store.list_segments()
        if not segments:
            return
        shapes = {"postings": index_ops.POSTINGS, "terms": index_ops.TERMS, "lengths": index_ops.LENGTHS}
        parts = [self._store.load_segment(x["id"], shapes) for x in segments]
        tables = parts[0]
        for part in parts[1:]:
            tables = {name: together(tables[name], part[name]) if name == "docs" else tables[name].unionByName(part[name]) for name in tables}
        if len(parts) > 1:
            tables["terms"] = tables["terms"].groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self.load_tables(tables, segments[-1]["facts"])
        self._rewritten = False

    @property
    def stored(self) -> bool:
        return self._store is not None and not self._dirty

    def close(self) -> None:
        self.commit()

    def __enter__(self) -> SearchEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def stats(self) -> dict:
        index = self.index
        out = {
            "documents": index.doc_count,
            "unique_terms": index.terms.count() + len(self._phantom),
            "fields": list(self.schema.fields),
            "avg_field_lengths": {f: round(index.average_length(f), 1) for f in self.schema.get_text_fields()},
            "dirty": self._dirty,
        }
        if self._store:
            out |= {"index_size": self._store.index_size_human(), "path": self._store.path}
        return out


def _document(row: dict) -> dict:
    """The document as it was added; of a DataFrame's rows, their columns."""
    source = row.pop(SOURCE, None)
    return json.loads(source) if source else {k: v for k, v in row.items() if k != "doc_id"}

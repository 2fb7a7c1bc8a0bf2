"""From query trees to one DataFrame of scored documents.

Leaves (terms, phrases, wildcards) become rows (doc_id, leaf, score) by joining
``postings`` with a small table of what each leaf looks up; one grouped
aggregation on doc_id pivots them into a nullable column for each leaf, and the
boolean tree is a single Column over these.  NULL means "no match" and 0.0 "a
match of score 0", so SQL's rules for NULL are those of the algebra: a sum of
must parts is NULL if one is, ``greatest`` of should parts skips NULLs.

Any tree thus costs one shuffle of the postings it touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.scoring import Scorer
from lantern.plans.ast import BoolQuery, MatchAllQuery, PhraseQuery, Query, RangeQuery, TermQuery, WildcardQuery
from lantern.sources.schema import Schema

PHRASE_FACTOR = 2.0
#: A prefix of at most so many terms selects postings by these.
WILDCARD_TERMS = 1024
NUMBER = r"^[+-]?((\d+(_\d+)*)?\.\d+(_\d+)*|\d+(_\d+)*\.?)([eE][+-]?\d+(_\d+)*)?$"
WORDED = r"^[+-]?(inf|infinity|nan)$"


@dataclass
class Index:
    """The tables of an index and the numbers that scores need."""

    spark: SparkSession
    schema: Schema
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    doc_count: int
    total_lengths: dict[str, int]

    def average_length(self, field: str) -> float:
        return self.total_lengths.get(field, 0) / self.doc_count if self.doc_count else 0.0


@dataclass
class _Leaf:
    query: Query
    name: str
    combine: str = "sum"


def number_of(c: Column, kind: T.DataType) -> Column:
    """A value as Python's float() reads it, NULL where it can't."""
    if isinstance(kind, T.StringType):
        text = F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
        worded = F.lower(text)
        sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
        named = F.when(worded.rlike("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
        return F.when(text.rlike(NUMBER), F.regexp_replace(text, "_", "").try_cast("double")).when(worded.rlike(WORDED), named)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def in_range(docs: DataFrame, q: RangeQuery) -> Column:
    """Whether a document is in range; NaN is in every one."""
    bounds = [(float(b), op) for b, op in ((q.gte, "ge"), (q.lte, "le"), (q.gt, "gt"), (q.lt, "lt")) if b is not None]
    if q.field not in docs.columns:
        return F.lit(False)
    v = number_of(F.col(f"`{q.field}`"), docs.schema[q.field].dataType)
    tests = {"ge": lambda b: v >= b, "le": lambda b: v <= b, "gt": lambda b: v > b, "lt": lambda b: v < b}
    inside = reduce(lambda a, b: a & b, (tests[op](b) for b, op in bounds if b == b), F.lit(True))
    return F.coalesce(v.isNotNull() & (F.isnan(v) | inside), F.lit(False))


def follows(positions: Column, slop: int) -> Column:
    """Whether an array of position arrays holds a phrase: from some start, each
    next position is the first within ``slop`` of the one expected."""

    def step(at: Column, own: Column) -> Column:
        return F.get(F.filter(own, lambda p: F.abs(p - (at + 1)) <= slop), F.lit(0))

    rest = F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0)))
    return F.exists(F.get(positions, F.lit(0)), lambda start: F.aggregate(rest, start, step).isNotNull())


class Compiler:
    def __init__(self, index: Index, scorer: Scorer, negation: str = "reference"):
        if negation not in ("reference", "exclude"):
            raise ValueError("negation is 'reference' or 'exclude'")
        self.index, self.scorer, self.exclude = index, scorer, negation == "exclude"
        self.leaves: list[_Leaf] = []
        self.uses_docs = False

    # -------------------------------------------------------- the tree

    def _leaf(self, q: Query, combine: str = "sum") -> Column:
        self.leaves.append(_Leaf(q, f"leaf{len(self.leaves)}", combine))
        return F.col(self.leaves[-1].name)

    def column(self, q: Query) -> Column:
        nothing = F.lit(None).cast("double")
        match q:
            case MatchAllQuery():
                self.uses_docs = True
                return F.lit(float(q.boost))
            case RangeQuery():
                self.uses_docs = True
                return F.when(in_range(self.index.docs, q), F.lit(float(q.boost)))
            case TermQuery() | PhraseQuery():
                return self._leaf(q)
            case WildcardQuery():
                return self._leaf(q, "max")
            case BoolQuery():
                return self._bool(q)
        return nothing

    def _bool(self, q: BoolQuery) -> Column:
        must_queries, banned = list(q.must), list(q.must_not)
        if self.exclude:
            # The documented NOT: a negated operand of AND excludes, alone it is everything but.
            pure = [m for m in must_queries if isinstance(m, BoolQuery) and m.must_not and not (m.must or m.should)]
            must_queries = [m for m in must_queries if not any(m is p for p in pure)]
            banned += [b for p in pure for b in p.must_not]
            if banned and not must_queries and not q.should:
                must_queries = [MatchAllQuery(0.0)]
        must = [self.column(m) for m in must_queries]
        should = [self.column(s) for s in q.should]
        best = None
        if should:
            best = should[0] if len(should) == 1 else F.greatest(*should)
        if must:
            score = reduce(lambda a, b: a + b, must)
            if best is not None:
                score = score + F.coalesce(best, F.lit(0.0))
        elif best is not None:
            score = best
        else:
            return F.lit(None).cast("double")
        if banned:
            score = F.when(reduce(lambda a, b: a & b, (self.column(n).isNull() for n in banned)), score)
        return score * F.lit(float(q.boost))

    # -------------------------------------------------------- the leaves

    def _targets(self, field: str | None, text_only: bool = False) -> list[str]:
        schema = self.index.schema
        if field is not None:
            known = schema.get(field)
            return [field] if known is not None and known.kind in ("text", "keyword") else []
        return schema.get_text_fields() if text_only else schema.get_searchable_fields()

    def _term_of(self, field: str, word: str) -> str:
        kind = self.index.schema.get(field)
        return word if kind.kind == "keyword" else kind.get_analyzer().first(word) or word

    def _field_facts(self, field: Column) -> tuple[Column, Column]:
        """Boost and mean length of a field, as literals by name."""
        names = self.index.schema.get_text_fields() + self.index.schema.get_keyword_fields()
        boost = avg = F.lit(None).cast("double")
        for n in names:
            boost = F.when(field == n, F.lit(float(self.index.schema.get(n).boost))).otherwise(boost)
            avg = F.when(field == n, F.lit(self.index.average_length(n))).otherwise(avg)
        return boost, avg

    def _lookups(self, leaves: list[_Leaf]) -> tuple[DataFrame | None, Column | None]:
        """(leaf, field, term, boost) of term and wildcard leaves, and a filter on postings."""
        spark, terms = self.index.spark, self.index.terms
        fixed, parts, pushed = [], [], []
        for leaf in leaves:
            q = leaf.query
            if isinstance(q, TermQuery):
                fixed += [(leaf.name, f, self._term_of(f, q.term), float(q.boost)) for f in self._targets(q.field)]
            elif isinstance(q, WildcardQuery):
                prefix = q.pattern.rstrip("*").lower()
                for f in self._targets(q.field):
                    found = terms.where((F.col("field") == f) & F.startswith("term", F.lit(prefix)))
                    if self.index.schema.get(f).kind == "keyword":
                        parts.append(found.select(F.lit(leaf.name).alias("leaf"), "field", "term", F.lit(float(q.boost)).alias("boost")))
                        pushed.append((F.col("field") == f) & F.startswith("term", F.lit(prefix)))
                        continue
                    # An indexed term is analysed again before it is looked up, so its beginning may be another.
                    term = F.coalesce(F.get(self.index.schema.get(f).get_analyzer().terms_column(F.col("term")), F.lit(0)), F.col("term"))
                    asked = found.select(F.lit(leaf.name).alias("leaf"), "field", term.alias("term"), F.lit(float(q.boost)).alias("boost")).distinct()
                    few = asked.limit(WILDCARD_TERMS + 1).collect() if prefix else []
                    if prefix and len(few) <= WILDCARD_TERMS:
                        fixed += [(leaf.name, f, r.term, float(q.boost)) for r in few]
                    else:
                        parts.append(asked)
                        pushed.append(F.col("field") == f)
        if fixed:
            parts.append(spark.createDataFrame(fixed, "leaf string, field string, term string, boost double"))
            for f in dict.fromkeys(x[1] for x in fixed):
                pushed.append((F.col("field") == f) & F.col("term").isin(*sorted({x[2] for x in fixed if x[1] == f})))
        if not parts:
            return None, None
        return reduce(DataFrame.unionByName, parts), reduce(lambda a, b: a | b, pushed)

    def _scored_terms(self, leaves: list[_Leaf]) -> DataFrame | None:
        lookups, pushed = self._lookups(leaves)
        if lookups is None:
            return None
        known = lookups.join(self.index.terms.where(pushed).select("field", "term", "df"), ["field", "term"])
        boost, avg = self._field_facts(F.col("field"))
        score = self.scorer.column(F.col("tf"), F.col("df"), F.col("dl"), avg, F.lit(self.index.doc_count)) * boost * F.col("boost")
        return self.index.postings.where(pushed).join(known, ["field", "term"]).select("doc_id", "leaf", score.alias("score"))

    def _scored_phrase(self, leaf: _Leaf) -> list[DataFrame]:
        q, out = leaf.query, []
        for f in self._targets(q.field, text_only=True):
            analyzer = self.index.schema.get(f).get_analyzer()
            words = [w for w in (analyzer.first(t) for t in q.terms) if w]
            if not words:
                continue
            distinct = sorted(set(words))
            rows = self.index.postings.where((F.col("field") == f) & F.col("term").isin(*distinct))
            first = self.index.terms.where((F.col("field") == f) & (F.col("term") == words[0])).select("term", "df")
            grouped = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.max("dl").alias("dl"))
            places = F.array(*(F.col("at")[w] for w in words))
            boost, avg = self._field_facts(F.lit(f))
            hits = grouped.where((F.size("at") == len(distinct)) & follows(places, q.slop)).withColumn("term", F.lit(words[0])).join(F.broadcast(first), "term")  # one row
            score = self.scorer.column(F.lit(1), F.col("df"), F.col("dl"), avg, F.lit(self.index.doc_count)) * boost * float(q.boost) * PHRASE_FACTOR
            out.append(hits.select("doc_id", F.lit(leaf.name).alias("leaf"), score.alias("score")))
        return out

    def matched(self, q: Query, only: Column | None = None) -> DataFrame:
        """(doc_id, score) of all matches; ``only`` is a predicate over docs, applied first."""
        tree = self.column(q)
        phrases = [x for x in self.leaves if isinstance(x.query, PhraseQuery)]
        words = [x for x in self.leaves if not isinstance(x.query, PhraseQuery)]
        parts = [d for d in [self._scored_terms(words)] if d is not None] + [d for x in phrases for d in self._scored_phrase(x)]
        docs = self.index.docs if only is None else self.index.docs.where(only)
        pivot = None
        if parts:
            rows = reduce(DataFrame.unionByName, parts)
            each = [(F.max if x.combine == "max" else F.sum)(F.when(F.col("leaf") == x.name, F.col("score"))).alias(x.name) for x in self.leaves]
            pivot = rows.groupBy("doc_id").agg(*each)
        if self.uses_docs:
            ranges = [c for c in docs.columns if c != "doc_id"]
            clash = {x.name for x in self.leaves} & set(ranges)
            if clash:
                raise ValueError(f"columns {sorted(clash)} are named like leaves")
            base = docs.join(pivot, "doc_id", "left") if pivot is not None else docs.withColumns({x.name: F.lit(None).cast("double") for x in self.leaves})
        elif pivot is None:
            return self.index.spark.createDataFrame([], "doc_id bigint, score double")
        else:
            base = pivot if only is None else pivot.join(docs.select("doc_id"), "doc_id", "left_semi")
        return base.select("doc_id", tree.alias("score")).where("score is not null")

"""Facet counts and facet filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.operators.postings import keyword_values, text_of

COUNTS = "field string, value string, count bigint"


def facet_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, count); every element of a list counts, nulls don't.

    One pass over ``docs`` whatever the number of fields.
    """
    there = [f for f in dict.fromkeys(fields) if f in docs.columns]
    if not there:
        return docs.sparkSession.createDataFrame([], COUNTS)

    def named(f: str) -> Column:
        values = F.coalesce(keyword_values(docs, f), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    pairs = F.flatten(F.array(*map(named, there)))
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))


def top_facets(counts: DataFrame, limit: int = 10) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


class FacetCollector:
    """Counts values of a few documents on the driver; :func:`facet_counts` counts those of a table.

    ``counted`` takes over what that gives, for the same views of it.
    """

    def __init__(self):
        self._fields: dict[str, dict[str, int]] = {}

    def add(self, field: str, value: object) -> None:
        own = self._fields.setdefault(field, {})
        for v in value if isinstance(value, list) else [value]:
            own[str(v)] = own.get(str(v), 0) + 1

    @classmethod
    def counted(cls, counts: DataFrame, limit: int) -> FacetCollector:
        """The ``limit`` most frequent values of each field of a table of counts."""
        out = cls()
        for r in top_facets(counts, limit).collect():
            out._fields.setdefault(r.field, {})[r.value] = r["count"]
        return out

    def get_facets(self, field: str, limit: int | None = 10) -> list[tuple[str, int]]:
        """Values by count, the most frequent first."""
        return sorted(self._fields.get(field, {}).items(), key=lambda item: -item[1])[:limit]

    def get_all_facets(self, limit: int | None = 10) -> dict[str, list[tuple[str, int]]]:
        return {field: self.get_facets(field, limit) for field in self._fields}

    def to_dict(self) -> dict[str, dict[str, int]]:
        return {field: dict(pairs) for field, pairs in self.get_all_facets(None).items()}


class FacetFilter:
    """All fields must match, any value of a field does."""

    def __init__(self):
        self._wanted: dict[str, list[str]] = {}

    def add_filter(self, field: str, values: list[str]) -> FacetFilter:
        if isinstance(values, str):
            raise TypeError("filter values must be a list")
        self._wanted[field] = [str(v) for v in values]
        return self

    @property
    def active(self) -> bool:
        return bool(self._wanted)

    def matches(self, document: dict) -> bool:
        for field, wanted in self._wanted.items():
            value = document.get(field)
            own = [str(v) for v in value] if isinstance(value, list) else [] if value is None else [str(value)]
            if not set(own) & set(wanted):
                return False
        return True

    def column(self, docs: DataFrame) -> Column:
        """The predicate over ``docs``, to be applied before anything joins."""
        parts = []
        for field, wanted in self._wanted.items():
            if field not in docs.columns or not wanted:
                parts.append(F.lit(False))
                continue
            kind, c = docs.schema[field].dataType, F.col(f"`{field}`")
            if isinstance(kind, T.ArrayType):
                parts.append(F.arrays_overlap(keyword_values(docs, field), F.array(*map(F.lit, wanted))))
            else:
                parts.append(text_of(c, kind).isin(*wanted))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))

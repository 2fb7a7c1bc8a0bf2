"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass, field


class Query:
    """Base of all nodes."""


@dataclass
class TermQuery(Query):
    term: str
    field: str | None = None
    boost: float = 1.0


@dataclass
class PhraseQuery(Query):
    terms: list[str]
    field: str | None = None
    boost: float = 1.0
    slop: int = 0


@dataclass
class WildcardQuery(Query):
    pattern: str
    field: str | None = None
    boost: float = 1.0


@dataclass
class RangeQuery(Query):
    field: str
    gte: float | str | None = None
    lte: float | str | None = None
    gt: float | str | None = None
    lt: float | str | None = None
    boost: float = 1.0


@dataclass
class MatchAllQuery(Query):
    boost: float = 1.0


@dataclass
class BoolQuery(Query):
    must: list[Query] = field(default_factory=list)
    should: list[Query] = field(default_factory=list)
    must_not: list[Query] = field(default_factory=list)
    boost: float = 1.0


def raw_terms(q: Query) -> list[str]:
    """The words that snippets mark: unanalysed, and none of must_not."""
    match q:
        case TermQuery():
            return [q.term]
        case PhraseQuery():
            return list(q.terms)
        case WildcardQuery():
            return [q.pattern.rstrip("*")]
        case BoolQuery():
            return [t for part in (*q.must, *q.should) for t in raw_terms(part)]
    return []

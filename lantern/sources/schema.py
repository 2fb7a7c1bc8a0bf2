"""Field types and schemas; a schema is kept as JSON beside a stored index."""

from __future__ import annotations

from dataclasses import dataclass, field

from lantern.functions import analysis
from lantern.functions.analysis import Analyzer

#: Analyzers that a stored schema can name.
PRESETS = {"standard": analysis.standard_analyzer, "simple": analysis.simple_analyzer, "keyword": analysis.keyword_analyzer, "exact": analysis.exact_analyzer}


@dataclass
class FieldType:
    stored: bool = True
    indexed: bool = True
    analyzer: Analyzer | str | None = None
    boost: float = 1.0
    faceted: bool = False
    kind = "plain"
    preset = "standard"

    def get_analyzer(self) -> Analyzer | None:
        chosen = self.analyzer or self.preset
        return PRESETS[chosen]() if isinstance(chosen, str) else chosen

    def to_json(self) -> dict:
        name = self.analyzer if isinstance(self.analyzer, str) else "custom" if self.analyzer else None
        return {"kind": self.kind, "stored": self.stored, "indexed": self.indexed, "boost": self.boost, "faceted": self.faceted, "analyzer": name}


@dataclass
class TextField(FieldType):
    kind = "text"


@dataclass
class KeywordField(FieldType):
    kind = "keyword"
    preset = "keyword"


@dataclass
class NumericField(FieldType):
    sortable: bool = True
    kind = "numeric"

    def get_analyzer(self) -> None:
        return None


@dataclass
class Schema:
    fields: dict[str, FieldType] = field(default_factory=dict)

    def __init__(self, **fields: FieldType):
        for name, kind in fields.items():
            if not isinstance(kind, FieldType):
                raise TypeError(f"{name} is no field type")
        self.fields = fields

    def get(self, name: str) -> FieldType | None:
        return self.fields.get(name)

    get_field = get

    def field_names(self) -> list[str]:
        return [*self.fields]

    def _of(self, *kinds: str) -> dict[str, FieldType]:
        return dict(item for item in self.fields.items() if item[1].kind in kinds)

    def get_text_fields(self) -> list[str]:
        return [*self._of("text")]

    def get_keyword_fields(self) -> list[str]:
        return [*self._of("keyword")]

    def get_numeric_fields(self) -> list[str]:
        return [*self._of("numeric")]

    def get_faceted_fields(self) -> list[str]:
        return [name for name in self.fields if self.fields[name].faceted]

    def get_searchable_fields(self) -> list[str]:
        return [name for name, kind in self._of("text", "keyword").items() if kind.indexed]

    def validate_document(self, document: dict) -> list[str]:
        return [f"unknown field: {n}" for n in document if n not in self.fields]

    def to_json(self) -> dict:
        return {n: f.to_json() for n, f in self.fields.items()}

"""A stored document: an id and named values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

_SHOWN = 50


@dataclass(repr=False)
class Document:
    """Reads like a mapping; a name it lacks gives None."""

    doc_id: int
    fields: Mapping[str, Any]

    def get(self, name: str, default: Any = None) -> Any:
        return self.fields.get(name, default)

    __getitem__ = get

    def __contains__(self, name: object) -> bool:
        return name in self.fields

    def to_dict(self) -> dict[str, Any]:
        return dict(doc_id=self.doc_id, fields=self.fields)

    @staticmethod
    def from_dict(saved: Mapping[str, Any]) -> Document:
        return Document(**{name: saved[name] for name in ("doc_id", "fields")})

    def __repr__(self) -> str:
        short = {k: f"{v[:_SHOWN]}..." if isinstance(v, str) and len(v) > _SHOWN else v for k, v in self.fields.items()}
        return f"Document(id={self.doc_id}, {short})"

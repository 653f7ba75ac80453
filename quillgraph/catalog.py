"""Admitted sets of schemas with digests, and the semantic snapshot they belong to."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from .errors import CatalogMismatch
from .types import EntitySchema, RelationSchema


def digest_of(value) -> str:
    """SHA-256 over canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class _Catalog:
    kind = ""

    def __init__(self, schemas):
        self.schemas = tuple(sorted(schemas, key=lambda s: s.id))
        self.by_id = {s.id: s for s in self.schemas}
        if len(self.by_id) != len(self.schemas):
            raise CatalogMismatch(f"the {self.kind} catalog repeats an id")
        self.digest = digest_of([self.kind, [s.describe() for s in self.schemas]])

    def __eq__(self, other):
        return type(self) is type(other) and self.digest == other.digest

    def __hash__(self):
        return hash(self.digest)


class RelationCatalog(_Catalog):
    kind = "relation"
    schemas: tuple[RelationSchema, ...]


class EntityCatalog(_Catalog):
    kind = "entity"
    schemas: tuple[EntitySchema, ...]

    def __init__(self, schemas):
        super().__init__(schemas)
        labels = [s.label for s in self.schemas]
        if len({*labels}) != len(labels):
            raise CatalogMismatch("the entity catalog repeats a label")


@dataclass(frozen=True, order=True)
class Revision:
    """What an external source was at: its provider, logical change and content revision."""

    provider: str
    change: str
    content: str


@dataclass(frozen=True)
class SemanticSnapshot:
    """A generation and the source revisions it was admitted from."""

    generation: str
    revisions: tuple[Revision, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "revisions", tuple(sorted(self.revisions)))
        if len({*self.revisions}) != len(self.revisions):
            raise CatalogMismatch("the snapshot repeats a revision")

    @property
    def digest(self) -> str:
        return digest_of(["snapshot", self.generation, [[r.provider, r.change, r.content] for r in self.revisions]])

"""Snapshot manifests: canonical bytes that name every child batch with its rows and size."""

from __future__ import annotations

from dataclasses import dataclass

from ..catalog import EntityCatalog, RelationCatalog, Revision, SemanticSnapshot
from ..errors import ManifestError
from ..functions.cbor import Link, decode, encode
from ..functions.cid import Cid, cbor_cid, from_binary

COVERAGE = ("complete", "partial", "unknown")


@dataclass(frozen=True, order=True)
class Batch:
    """One child block of a table."""

    cid: Cid
    rows: int
    size: int


@dataclass(frozen=True)
class TableDescriptor:
    """A table's batches, whose rows must add up."""

    id: str
    rows: int
    batches: tuple[Batch, ...]
    format: str = "arrow-ipc-stream"

    def __post_init__(self):
        if sum(b.rows for b in self.batches) != self.rows or any(b.rows < 0 or b.size <= 0 for b in self.batches):
            raise ManifestError(f"the batches of {self.id} do not add up")

    def describe(self) -> dict:
        return {"id": self.id, "rows": self.rows, "format": self.format, "batches": [[b.cid.link, b.rows, b.size] for b in self.batches]}


def _read_table(d: dict) -> TableDescriptor:
    if {*d} != {"id", "rows", "format", "batches"}:
        raise ManifestError("unknown or missing table fields")
    return TableDescriptor(d["id"], d["rows"], tuple(Batch(_cid(c), r, s) for c, r, s in d["batches"]), d["format"])


def _cid(link) -> Cid:
    if not isinstance(link, Link):
        raise ManifestError("a link is expected")
    return from_binary(link.raw)


def _sorted_unique(values: list, what: str) -> None:
    if any(a >= b for a, b in zip(values, values[1:])):
        raise ManifestError(f"{what} must be sorted and unique")


@dataclass(frozen=True)
class Manifest:
    snapshot: SemanticSnapshot
    relation_digest: str
    entity_digest: str
    relations: tuple[TableDescriptor, ...]
    entities: tuple[TableDescriptor, ...] = ()
    lineage: tuple[Cid, ...] = ()
    coverage: str = "complete"
    evidence: Cid | None = None
    graph: Cid | None = None

    def __post_init__(self):
        _sorted_unique([t.id for t in self.relations], "relations")
        _sorted_unique([t.id for t in self.entities], "entities")
        _sorted_unique(list(self.lineage), "lineage")
        children = [b.cid for t in (*self.relations, *self.entities) for b in t.batches]
        if len({*children}) != len(children):
            raise ManifestError("a child block is named twice")
        if self.coverage not in COVERAGE:
            raise ManifestError(f"coverage {self.coverage!r}")

    @property
    def version(self) -> int:
        """1 without entity tables, 2 with."""
        return 2 if self.entities else 1

    def encode(self) -> bytes:
        s = self.snapshot
        body = {
            "version": self.version, "generation": s.generation, "revisions": [[r.provider, r.change, r.content] for r in s.revisions], "digest": s.digest,
            "relation_digest": self.relation_digest, "entity_digest": self.entity_digest, "relations": [t.describe() for t in self.relations],
            "lineage": [c.link for c in self.lineage], "coverage": self.coverage, "evidence": self.evidence and self.evidence.link, "graph": self.graph and self.graph.link,
        }
        return encode(body | ({"entities": [t.describe() for t in self.entities]} if self.entities else {}))

    @staticmethod
    def decode(raw: bytes) -> "Manifest":
        d = decode(raw)
        known = {"version", "generation", "revisions", "digest", "relation_digest", "entity_digest", "relations", "lineage", "coverage", "evidence", "graph"}
        if not isinstance(d, dict) or {*d} - {"entities"} != known or (d["version"] == 2) != ("entities" in d):
            raise ManifestError("unknown or missing fields")
        try:
            made = Manifest(
                SemanticSnapshot(d["generation"], tuple(Revision(*r) for r in d["revisions"])), d["relation_digest"], d["entity_digest"], tuple(map(_read_table, d["relations"])),
                tuple(map(_read_table, d.get("entities", ()))), tuple(map(_cid, d["lineage"])), d["coverage"], d["evidence"] and _cid(d["evidence"]), d["graph"] and _cid(d["graph"]),
            )
        except (TypeError, ValueError, KeyError) as e:
            raise ManifestError(f"malformed: {e}") from e
        if made.snapshot.digest != d["digest"] or made.encode() != raw:
            raise ManifestError("not in canonical form")
        return made

    def children(self) -> dict[Cid, int]:
        """Table batches with their declared sizes."""
        return {b.cid: b.size for t in (*self.relations, *self.entities) for b in t.batches}

    def references(self) -> list[Cid]:
        """All referenced blocks, distinct, in order."""
        return sorted({*self.children(), *self.lineage, *filter(None, (self.evidence, self.graph))})

    def verify_catalogs(self, relations: RelationCatalog, entities: EntityCatalog) -> None:
        if relations.digest != self.relation_digest or {t.id for t in self.relations} != {*relations.by_id}:
            raise ManifestError("not the relation catalog of this snapshot")
        if entities.digest != self.entity_digest or self.entities and {t.id for t in self.entities} != {*entities.by_id}:
            raise ManifestError("not the entity catalog of this snapshot")

    def check_declared(self, max_rows: int, max_bytes: int) -> None:
        """Declared rows and sizes against budgets, before anything is read."""
        tables = (*self.relations, *self.entities)
        if sum(t.rows for t in tables) > max_rows or sum(b.size for t in tables for b in t.batches) > max_bytes:
            raise ManifestError("declared input is over its budget")


@dataclass(frozen=True)
class SnapshotBlock:
    """A manifest with its canonical bytes and identity."""

    manifest: Manifest
    data: bytes
    cid: Cid


def snapshot_block(manifest: Manifest) -> SnapshotBlock:
    data = manifest.encode()
    return SnapshotBlock(manifest, data, cbor_cid(data))


def verify_closure(manifest: Manifest, blocks: dict[Cid, bytes]) -> None:
    """Every reference present, hashing to its identity, and of its declared length."""
    sizes = manifest.children()
    for cid in manifest.references():
        if cid not in blocks:
            raise ManifestError(f"{cid} is missing")
        if not cid.holds(blocks[cid]) or cid in sizes and sizes[cid] != len(blocks[cid]):
            raise ManifestError(f"{cid} has other bytes")

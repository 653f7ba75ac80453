"""Binding a query to one snapshot and one engine profile, before any data is read."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import BindingError, InvalidTable, ResourceLimit
from ..functions.cid import Cid
from .ir import ANY, CatalogQuery, Parameter, Query

#: What a query may need beyond fixed outgoing hops.
FEATURES = ("bounded_path", "unbounded_path", "undirected_path", "aggregation", "ordering", "offset", "parameterized_pagination")


@dataclass(frozen=True)
class EngineProfile:
    name: str
    requires_graph_projection: bool = False
    features: frozenset[str] = frozenset()

    def __post_init__(self):
        if not self.name or self.name != self.name.strip():
            raise BindingError("an engine name must be trimmed and not empty")
        if unknown := self.features - {*FEATURES}:
            raise BindingError(f"unknown features {sorted(unknown)}")


#: What the path executors are: no optional feature.
PATH_ENGINE = EngineProfile("quillgraph-paths")


def required_features(query: Query) -> set[str]:
    need = set()
    for edge in (e for p in query.paths for e in p.edges):
        if edge.max_hops is None:
            need.add("unbounded_path")
        elif edge.max_hops != edge.min_hops:
            need.add("bounded_path")
        if edge.direction == ANY:
            need.add("undirected_path")
    for flag, there in (("aggregation", query.aggregations), ("ordering", query.ordering), ("offset", query.offset is not None)):
        if there:
            need.add(flag)
    if isinstance(query.offset, Parameter) or isinstance(query.limit, Parameter):
        need.add("parameterized_pagination")
    return need


@dataclass(frozen=True)
class BoundQuery:
    query: CatalogQuery
    root: Cid
    graph_manifest: Cid | None
    engine: EngineProfile


def bind_query(query: CatalogQuery, snapshot, engine: EngineProfile = PATH_ENGINE) -> BoundQuery:
    """Check generation, relation catalog, entity catalog, snapshot digest, graph need, then features."""
    manifest = snapshot.manifest
    for what, mine, theirs in (
        ("generation", query.snapshot.generation, manifest.snapshot.generation),
        ("relation catalog", query.relations.digest, manifest.relation_digest),
        ("entity catalog", query.entities.digest, manifest.entity_digest),
        ("semantic snapshot", query.snapshot.digest, manifest.snapshot.digest),
    ):
        if mine != theirs:
            raise BindingError(f"the query's {what} is not the snapshot's")
    if engine.requires_graph_projection and manifest.graph is None:
        raise BindingError("the engine needs a graph projection and the snapshot has none")
    if missing := required_features(query.query) - engine.features:
        raise BindingError(f"the engine lacks {sorted(missing)[0]}")
    return BoundQuery(query, snapshot.cid, manifest.graph, engine)


def admit_graph_source(bound: BoundQuery, relation: str, manifest: Cid) -> None:
    """A graph source must serve a relation of the query and be the one the snapshot names."""
    if bound.graph_manifest is None:
        raise BindingError("the snapshot has no graph projection")
    if not any(relation in e.types for p in bound.query.query.paths for e in p.edges):
        raise BindingError(f"the query has no relation {relation}")
    if manifest != bound.graph_manifest:
        raise BindingError("another graph projection than the snapshot's")


def admit_graph_metadata(bound: BoundQuery, relation: str, metadata: bytes) -> None:
    """As ``admit_graph_source``, by re-hashing the source's metadata bytes."""
    if bound.graph_manifest is not None and not bound.graph_manifest.holds(metadata):
        raise BindingError("graph metadata is not what the snapshot names")
    admit_graph_source(bound, relation, bound.graph_manifest)


@dataclass(frozen=True)
class QueryOutput:
    """Result rows with the identity of the query that they answer."""

    bound: BoundQuery
    rows: DataFrame


def project_output(bound: BoundQuery, engine: EngineProfile, rows: DataFrame) -> QueryOutput:
    if engine != bound.engine:
        raise BindingError(f"bound to engine {bound.engine.name}, run by {engine.name}")
    return QueryOutput(bound, rows)


@dataclass(frozen=True)
class ResultLimits:
    max_rows: int
    max_cells: int


@dataclass(frozen=True)
class Admission:
    """A result within its limits: its rows in order, and a digest of its columns and rows."""

    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    digest: str


def admit_rows(rows: DataFrame, columns: list[str], limits: ResultLimits) -> Admission:
    """``rows`` in the order they come, if they have exactly ``columns`` of strings and fit ``limits``.

    At most one row more than the limit is fetched. The digest is SHA-256 over the columns' names and each
    row as canonical JSON, so equal results in equal order have equal digests.
    """
    if min(limits.max_rows, limits.max_cells) <= 0:
        raise ResourceLimit("a result limit of zero")
    if rows.columns != columns or any(kind != "string" for _, kind in rows.dtypes):
        raise InvalidTable(f"result columns {rows.dtypes}, not strings {columns}")
    most = min(limits.max_rows, limits.max_cells // max(1, len(columns)))
    found = tuple(map(tuple, rows.limit(most + 1).collect()))
    if len(found) > most:
        raise ResourceLimit("result rows or cells")
    running = hashlib.sha256()
    for row in (tuple(columns), *found):
        running.update(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass") + b"\n")
    return Admission(tuple(columns), found, running.hexdigest())


def admit_result(output: QueryOutput, limits: ResultLimits) -> Admission:
    """The result of a bound query, checked against its projections and limits."""
    return admit_rows(output.rows, [p.alias for p in output.bound.query.query.projections], limits)

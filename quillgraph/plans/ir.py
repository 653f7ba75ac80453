"""Query descriptions. They can say more than the executors run, so that the rest can be refused by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..catalog import EntityCatalog, RelationCatalog, SemanticSnapshot
from ..errors import UnsupportedShape

OUT, IN, ANY = "outgoing", "incoming", "undirected"


@dataclass(frozen=True)
class Property:
    """``binding.key``"""

    binding: str
    key: str


@dataclass(frozen=True)
class Endpoint:
    """A node binding as a whole."""

    binding: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Binary:
    left: object
    operator: str
    right: object


@dataclass(frozen=True)
class Projection:
    expression: object
    alias: str


@dataclass(frozen=True)
class Node:
    binding: str
    types: tuple[str, ...]


@dataclass(frozen=True)
class Edge:
    types: tuple[str, ...]
    direction: str = OUT
    binding: str | None = None
    min_hops: int = 1
    max_hops: int | None = 1


@dataclass(frozen=True)
class Path:
    """``nodes[0] -edges[0]- nodes[1] ...``"""

    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    def __post_init__(self):
        if len(self.nodes) != len(self.edges) + 1:
            raise UnsupportedShape("a path has one node more than edges")


@dataclass(frozen=True)
class Query:
    paths: tuple[Path, ...]
    projections: tuple[Projection, ...] = ()
    filters: tuple[Binary, ...] = ()
    aggregations: tuple = ()
    grouping: tuple = ()
    ordering: tuple = ()
    offset: object = None
    limit: object = None
    distinct: bool = False


@dataclass(frozen=True)
class CatalogQuery:
    """A query bound to the catalogs and snapshot it was admitted against."""

    query: Query
    relations: RelationCatalog
    entities: EntityCatalog
    snapshot: SemanticSnapshot = field(default_factory=lambda: SemanticSnapshot("qg:generation:v1:" + "0" * 64))

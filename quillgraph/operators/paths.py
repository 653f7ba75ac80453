"""Path queries: one hop by endpoints, one or two hops by properties.

Plans are plain scans, projections, inner equi-joins, filters and a sort, so pushdown, pruning, join
strategies and skew handling are the optimiser's. Columns are renamed by position (``n0_id``, ``n0_p1``,
``e0_from`` ...), so user names cannot collide. Edge multiplicity and nulls are kept; a null never equals
a filter's text; an endpoint of another type than the pattern's gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CatalogMismatch, InvalidIdentity, InvalidRelationSchema, InvalidTable, RelationMismatch, ResourceLimit, UnsupportedShape
from ..functions.ids import is_id
from ..plans.ir import OUT, Binary, CatalogQuery, Edge, Endpoint, Literal, Node, Path, Property, Query
from ..plans.limits import UNBOUNDED, QueryLimits, join_bound
from .tables import EntityTable, RelationTable, exact
from .validate import validate_tables


@dataclass(frozen=True)
class PathRows:
    """The rows of a query and, for node columns, the type each is stamped with."""

    rows: DataFrame
    node_types: dict[str, str]


def with_position(rows: DataFrame) -> DataFrame:
    """Ordered rows with ``position``, their place from 1, without a task that sees them all.

    A sort leaves its ranges in order of partition, so a row's place is its place in its partition after
    the rows of those before. The sorted rows are persisted, so that both readings see one layout.
    """
    row = F.monotonically_increasing_id()
    kept = rows.withColumn("__row", row).persist()
    part = F.shiftright("__row", 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a partition
    placed = kept.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.select(*[exact(c) for c in rows.columns], (F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("position"))


def _one_path(query: Query, most: int) -> Path:
    if query.aggregations or query.grouping or query.ordering or query.distinct or query.limit is not None or query.offset is not None:
        raise UnsupportedShape("only an unordered RETURN of all rows, without aggregation or pages")
    if len(query.paths) != 1:
        raise UnsupportedShape("one path required")
    path = query.paths[0]
    if not 1 <= len(path.edges) <= most:
        raise UnsupportedShape(f"one to {most} edges required")
    names = [n.binding for n in path.nodes]
    if len({*names}) != len(names):
        raise UnsupportedShape("repeated node bindings")
    return path


def _edge_type(edge: Edge, named: bool) -> str:
    if edge.direction != OUT or (edge.min_hops, edge.max_hops) != (1, 1) or edge.binding is not None and not named:
        raise UnsupportedShape("only outgoing single-hop edges" + ("" if named else " without a name"))
    if len(edge.types) != 1:
        raise UnsupportedShape("exactly one relation type required")
    return edge.types[0]


def _distinct_aliases(query: Query) -> list[str]:
    aliases = [p.alias for p in query.projections]
    if not aliases:
        raise UnsupportedShape("projections required")
    if len({*aliases}) != len(aliases):
        raise UnsupportedShape("repeated output names")
    return aliases


def one_hop(query: Query, table: RelationTable) -> PathRows:
    """Source and target identifiers of one relation's rows, under the query's names, in no given order.

    Node types are stamped on the output, not tested. Every projected cell must be an entity id.
    """
    path = _one_path(query, 1)
    if query.filters:
        raise UnsupportedShape("the endpoint query takes no filters")
    if not table.schema.is_binary:
        raise InvalidRelationSchema(table.schema.predicate)
    if _edge_type(path.edges[0], named=True) != table.schema.id:
        raise RelationMismatch(path.edges[0].types[0])
    _distinct_aliases(query)
    ends = {n.binding: (f.name, n) for n, f in zip(path.nodes, table.schema.fields)}
    columns, stamped = [], {}
    for p in query.projections:
        if not isinstance(p.expression, Endpoint) or p.expression.binding not in ends:
            raise UnsupportedShape("projections must select an endpoint of the path")
        name, node = ends[p.expression.binding]
        if len(node.types) != 1:
            raise UnsupportedShape("one node type required")
        columns.append(exact(name).alias(p.alias))
        stamped[p.alias] = node.types[0]
    rows = table.rows.select(*columns)
    bad = rows.agg(*[F.sum((~is_id(exact(c), "entity")).cast("long")).alias(f"b{i}") for i, c in enumerate(rows.columns)]).first()
    if any(bad):
        raise InvalidIdentity("an endpoint is null or no entity id")
    return PathRows(rows, stamped)


def _property(expression, nodes: dict[str, tuple[int, EntityTable]]) -> str:
    if not isinstance(expression, Property):
        raise UnsupportedShape("a node property is required")
    if expression.binding not in nodes:
        raise UnsupportedShape(f"unknown node {expression.binding}")
    i, table = nodes[expression.binding]
    names = [p.name for p in table.schema.properties]
    if expression.key not in names:
        raise UnsupportedShape(f"unknown property {expression.key}")
    return f"n{i}_p{names.index(expression.key)}"


def _entity(node: Node, entities: list[EntityTable]) -> EntityTable:
    if len(node.types) != 1:
        raise UnsupportedShape("one node type required")
    for t in entities:
        if t.schema.id == node.types[0]:
            return t
    raise InvalidTable(f"no table of type {node.types[0]}")


@dataclass(frozen=True)
class AdmittedTables:
    """Tables that passed validation once, with the rows of every relation; any number of queries may follow."""

    entities: list[EntityTable]
    relations: list[RelationTable]
    counts: dict[str, int]
    entity_digest: str
    relation_digest: str


def admit_tables(entities: list[EntityTable], relations: list[RelationTable], limits: QueryLimits, entity_digest: str, relation_digest: str) -> AdmittedTables:
    return AdmittedTables(entities, relations, validate_tables(entities, relations, limits, entity_digest, relation_digest), entity_digest, relation_digest)


def property_path(query: CatalogQuery, entities: list[EntityTable], relations: list[RelationTable], limits: QueryLimits = UNBOUNDED, ordered: bool = True) -> PathRows:
    """String properties of the nodes of a one- or two-hop path, sorted ascending with nulls first.

    Tables are validated and all budgets checked before the plan is built. ``ordered=False`` leaves out
    the final sort, for callers that compare bags or write the rows on.
    """
    return admitted_path(query, admit_tables(entities, relations, limits, query.entities.digest, query.relations.digest), limits, ordered)


def admitted_path(query: CatalogQuery, admitted: AdmittedTables, limits: QueryLimits = UNBOUNDED, ordered: bool = True) -> PathRows:
    """As ``property_path``, over tables whose validation is reused; they must be those of the query's catalogs."""
    limits.check_nonzero()
    if (query.entities.digest, query.relations.digest) != (admitted.entity_digest, admitted.relation_digest):
        raise CatalogMismatch("tables admitted for other catalogs")
    entities, relations, counts = admitted.entities, admitted.relations, admitted.counts
    ir = query.query
    path = _one_path(ir, 2)
    kinds = [_edge_type(e, named=False) for e in path.edges]
    by_id = {t.schema.id: t for t in relations}
    sizes = []
    for kind in kinds:
        if kind not in by_id:
            raise RelationMismatch(kind)
        sizes.append(counts[kind])
        join_bound(sizes, 0, limits)
    aliases = _distinct_aliases(ir)
    bound = join_bound(sizes, len(aliases), limits)
    # the least that joining takes in memory: an offset per row of the largest edge table used
    if bound and 4 * max(sizes) > limits.execution_memory_bytes:
        raise ResourceLimit("execution memory")
    nodes = {n.binding: (i, _entity(n, entities)) for i, n in enumerate(path.nodes)}
    columns = [exact(_property(p.expression, nodes)).alias(p.alias) for p in ir.projections]
    conditions = []
    for f in ir.filters:
        if not isinstance(f, Binary) or f.operator != "=" or not isinstance(f.right, Literal) or not isinstance(f.right.value, str):
            raise UnsupportedShape("only property = string filters")
        conditions.append(F.col(_property(f.left, nodes)) == F.lit(f.right.value))

    placed = [t.rows.toDF(f"n{i}_id", *[f"n{i}_p{j}" for j in range(len(t.schema.properties))]) for i, t in nodes.values()]
    rows = placed[0]
    for i, kind in enumerate(kinds):
        edges = by_id[kind].rows.toDF(f"e{i}_from", f"e{i}_to")
        rows = rows.join(edges, rows[f"n{i}_id"] == edges[f"e{i}_from"]).join(placed[i + 1], edges[f"e{i}_to"] == placed[i + 1][f"n{i + 1}_id"])
    for c in conditions:
        rows = rows.where(c)
    rows = rows.select(*columns)
    return PathRows(rows.orderBy(*[exact(a).asc_nulls_first() for a in aliases]) if ordered else rows, {})

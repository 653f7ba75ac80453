"""Binary relations as property graphs: projection, dense vertex ids, edges resolved both ways."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRelationSchema, InvalidTable, RelationMismatch
from ..types import RelationSchema
from .facts import COLUMNS
from .tables import exact

#: The properties an edge carries, in order.
EDGE_PROPERTIES = (
    "fact_id", "relation_id", "predicate", "generation_id", "authority_kind", "authority_id", "provenance_kind", "provenance_id", "completeness", "validity_kind", "invalidated_by",
)


@dataclass(frozen=True)
class GraphProjection:
    """A binary relation read as edges from its first field to its second."""

    relation: RelationSchema

    def __post_init__(self):
        if not self.relation.is_binary:
            raise InvalidRelationSchema(self.relation.predicate)


def project_edges(projection: GraphProjection, facts: DataFrame) -> DataFrame:
    """Edges (source, destination and the eleven properties) of a fact table."""
    relation = projection.relation
    kind = lambda c: F.regexp_extract(exact(c), "^qg:([a-z]+):", 1)
    fact, generation, authority, provenance, completeness, invalidated = COLUMNS
    made = {
        "fact_id": exact(fact), "relation_id": F.lit(relation.id), "predicate": F.lit(relation.predicate), "generation_id": exact(generation),
        "authority_kind": kind(authority), "authority_id": exact(authority),
        "provenance_kind": F.when(kind(provenance) == "entity", "source").otherwise("derivation"), "provenance_id": exact(provenance),
        "completeness": exact(completeness), "validity_kind": F.when(exact(invalidated).isNull(), "valid").otherwise("invalidated"), "invalidated_by": exact(invalidated),
    }
    return facts.select(exact(relation.fields[0].name).alias("source"), exact(relation.fields[1].name).alias("destination"), *[made[p].alias(p) for p in EDGE_PROPERTIES])


def facts_from_edges(projection: GraphProjection, edges: DataFrame) -> DataFrame:
    """The fact table that ``project_edges`` was made from."""
    relation = projection.relation
    context = dict(zip(COLUMNS, ("fact_id", "generation_id", "authority_id", "provenance_id", "completeness", "invalidated_by")))
    return edges.select(*[F.col(c).alias(p) for p, c in context.items()], F.col("source").alias(relation.fields[0].name), F.col("destination").alias(relation.fields[1].name))


def edge_facts(projection: GraphProjection, edges: DataFrame) -> DataFrame:
    """One row of what is checked of edges: their number, the most of one fact id, and rows that break a rule."""
    relation = projection.relation
    other = ~(F.col("relation_id").eqNullSafe(F.lit(relation.id)) & F.col("predicate").eqNullSafe(F.lit(relation.predicate)))
    torn = F.coalesce((F.col("validity_kind") == "valid") != F.col("invalidated_by").isNull(), F.lit(True))
    ends = [c for c in ("source", "destination") if c in edges.columns]
    lost = reduce(Column.__or__, [F.col(c).isNull() for c in ends], F.lit(False))
    each = edges.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("long")).alias(k) for k, x in (("other", other), ("torn", torn), ("lost", lost))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return each.agg(total("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), total("other"), total("torn"), total("lost"))


def check_edges(projection: GraphProjection, edges: DataFrame) -> int:
    """Every edge of this relation with both ends, ids unique, validity and invalidator consistent; in one
    job, which returns how many there are."""
    got = edge_facts(projection, edges).first()
    if got["other"]:
        raise RelationMismatch(projection.relation.predicate)
    if got["lost"]:
        raise InvalidTable("unknown vertex in an edge")
    if got["most"] > 1:
        raise InvalidTable("duplicate fact id")
    if got["torn"]:
        raise InvalidTable("validity contradicts its invalidator")
    return got["n"]


def dense_index(ids: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """Distinct ``key`` values numbered from 0 in ascending order, without a single sorted partition.

    Typed identifiers end in uniformly spread hex digits, so their first ``digits`` cut them into even
    ranges: each range is sorted by itself and starts after the counts of those before it. Only the
    counts, one per range, are ordered together. Other strings fall into ranges by their first characters.
    """
    prefix = F.regexp_extract(key, "^(?:qg:[a-z_]+:v1:)?(.{0,%d})" % digits, 1)
    head = F.regexp_extract(key, "^(qg:[a-z_]+:v1:)?", 0)
    keyed = ids.select(key).distinct().withColumn("__range", F.concat(head, prefix))
    counts = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return keyed.join(starts, "__range").select(key, (F.col("__start") + place).cast("long").alias("vertex_id"))


def vertex_index(edges: DataFrame) -> DataFrame:
    """(entity_id, vertex_id): all endpoints once, numbered from 0 in ascending order."""
    ends = edges.select(F.col("source").alias("entity_id")).union(edges.select(F.col("destination").alias("entity_id")))
    return dense_index(ends, "entity_id")


def index_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both dense ids added; an endpoint without one makes a null, see ``check_resolved``."""
    by = lambda end: vertices.select(F.col("entity_id").alias(end), F.col("vertex_id").alias(f"{end}_id"))
    return edges.join(by("source"), "source", "left").join(by("destination"), "destination", "left").select(*edges.columns, "source_id", "destination_id")


def resolve_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges by dense ids (source_id, destination_id) with their entities added."""
    by = lambda end: vertices.select(F.col("vertex_id").alias(f"{end}_id"), F.col("entity_id").alias(end))
    rest = [c for c in edges.columns if c not in ("source_id", "destination_id")]
    return edges.join(by("source"), "source_id", "left").join(by("destination"), "destination_id", "left").select("source", "destination", *rest)


def check_resolved(edges: DataFrame, *columns: str) -> None:
    """No endpoint may be unknown: that is an error, not a dropped row."""
    got = edges.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in columns]).first()
    for c in columns:
        if got[c]:
            raise InvalidTable(f"unknown vertex in {c}")


def vertex_facts(vertices: DataFrame) -> DataFrame:
    """One row of what is checked of vertices: how many, the ends of their ids, the most of one id and of one entity."""
    ids = vertices.select(F.lit(0).alias("k"), F.col("vertex_id").alias("id"), F.lit(None).cast("string").alias("e"))
    both = ids.union(vertices.select(F.lit(1), F.lit(None).cast("long"), F.col("entity_id"))).groupBy("k", "id", "e").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k, x: F.when(F.col("k") == k, x)
    return both.agg(
        F.coalesce(F.sum(of(0, F.col("n"))), F.lit(0)).alias("n"), F.min(of(0, F.col("id"))).alias("lo"), F.max(of(0, F.col("id"))).alias("hi"),
        F.coalesce(F.max(of(0, F.col("n"))), F.lit(0)).alias("most_ids"), F.coalesce(F.max(of(1, F.col("n"))), F.lit(0)).alias("most_entities"),
    )


def check_dense(vertices: DataFrame) -> int:
    """Vertex ids must be 0 to n - 1, each once, and entities distinct; returns n, from one job."""
    got = vertex_facts(vertices).first()
    if got["most_ids"] > 1:
        raise InvalidTable("duplicate vertex id")
    if got["n"] and (got["lo"], got["hi"]) != (0, got["n"] - 1):
        raise InvalidTable("vertex ids are not dense")
    if got["most_entities"] > 1:
        raise InvalidTable("duplicate entity in the vertex table")
    return got["n"]


def adjacency(vertices: DataFrame, edges: DataFrame, chunk: int) -> DataFrame:
    """(vertex_id, offset, degree): where a vertex's edges begin among all edges by source id, and how many
    there are; summed within chunks of ``chunk`` vertices and over the chunks before, of which there are few."""
    degrees = edges.groupBy(F.col("source_id").alias("vertex_id")).agg(F.count(F.lit(1)).alias("degree"))
    every = vertices.select("vertex_id").join(degrees, "vertex_id", "left").select("vertex_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    every = every.withColumn("chunk", F.floor(F.col("vertex_id") / chunk).cast("long"))
    upto = lambda w: F.coalesce(F.sum("degree").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = every.groupBy("chunk").agg(F.sum("degree").alias("degree")).select("chunk", upto(Window.orderBy("chunk")).alias("begin"))
    return every.withColumn("within", upto(Window.partitionBy("chunk").orderBy("vertex_id"))).join(chunks, "chunk").select("chunk", "vertex_id", (F.col("begin") + F.col("within")).alias("offset"), "degree")


def canonical_facts(rows: DataFrame) -> DataFrame:
    return rows.orderBy(COLUMNS[0])

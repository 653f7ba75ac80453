"""Writers, books and the shelves they stand on: a small two-hop property graph."""

from quillgraph.catalog import EntityCatalog, RelationCatalog, Revision, SemanticSnapshot
from quillgraph.functions.ids import typed_id
from quillgraph.operators.tables import EntityTable, RelationTable
from quillgraph.plans.ir import Binary, CatalogQuery, Edge, Literal, Node, Path, Projection, Property, Query
from quillgraph.plans.limits import QueryLimits
from quillgraph.types import ENTITY, STRING, EntitySchema, RelationField, RelationSchema

LIMITS = QueryLimits(500, 1 << 18, 64, 900, 4 << 20)


def eid(name):
    return typed_id("entity", name)


def _entity(label, *properties):
    return EntitySchema(typed_id("entity_type", label), label, tuple(RelationField(p, STRING, True) for p in properties))


def _relation(name, a, b):
    return RelationSchema(typed_id("relation", name), name, (RelationField(a, ENTITY), RelationField(b, ENTITY)))


WRITER, BOOK, SHELF = _entity("Writer", "name", "country"), _entity("Book", "title"), _entity("Shelf", "code", "floor")
WROTE, STANDS_ON = _relation("WROTE", "writer", "book"), _relation("STANDS_ON", "book", "shelf")
ENTITIES, RELATIONS = EntityCatalog([WRITER, BOOK, SHELF]), RelationCatalog([WROTE, STANDS_ON])
SNAPSHOT = SemanticSnapshot(typed_id("generation", "spring"), (Revision("ledger", "library", "page 7"),))
ENTITY_ROWS = {
    WRITER: [("w1", "Ada", "ie"), ("w2", "Bo", "se"), ("w3", "Cy", None)],
    BOOK: [("b1", "Tides"), ("b2", "Moss"), ("b3", None), ("b4", "Tides"), ("b5", "Unread")],
    SHELF: [("h1", "A1", "0"), ("h2", "B7", None)],
}
# b5 has no writer; b4 was entered on its shelf twice
EDGE_ROWS = {
    WROTE: [("w2", "b2"), ("w1", "b1"), ("w3", "b4"), ("w1", "b3"), ("w2", "b4")],
    STANDS_ON: [("b4", "h1"), ("b1", "h2"), ("b2", "h1"), ("b1", "h1"), ("b3", "h2"), ("b4", "h1"), ("b5", "h2")],
}
BOUND = 5 * 7
SOURCE = "MATCH (w:Writer)-[:WROTE]->(b:Book)-[:STANDS_ON]->(h:Shelf) WHERE w.country = 'ie' RETURN w.name AS writer, b.title AS title, h.code AS shelf"
EXPECTED = [("Ada", None, "B7"), ("Ada", "Tides", "A1"), ("Ada", "Tides", "B7")]


def tables(spark, entity_rows=None, edge_rows=None):
    entities = [
        EntityTable(schema, spark.createDataFrame([(eid(i), *v) for i, *v in rows], ", ".join(f"{c} string" for c in schema.columns)))
        for schema, rows in (ENTITY_ROWS | (entity_rows or {})).items()
    ]
    relations = [
        RelationTable(schema, spark.createDataFrame([(eid(a), eid(b)) for a, b in rows], ", ".join(f"{f.name} string" for f in schema.fields)))
        for schema, rows in (EDGE_ROWS | (edge_rows or {})).items()
    ]
    return entities, relations


def path():
    nodes = tuple(Node(b, (s.id,)) for b, s in zip("wbh", (WRITER, BOOK, SHELF)))
    return Path(nodes, (Edge((WROTE.id,)), Edge((STANDS_ON.id,))))


def query(value="ie", **changed):
    base = {
        "paths": (path(),),
        "projections": tuple(Projection(Property(b, k), a) for b, k, a in (("w", "name", "writer"), ("b", "title", "title"), ("h", "code", "shelf"))),
        "filters": (Binary(Property("w", "country"), "=", Literal(value)),),
    }
    return CatalogQuery(Query(**(base | changed)), RELATIONS, ENTITIES, SNAPSHOT)

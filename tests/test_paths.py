from dataclasses import replace

import pytest

from graph_fixture import BOOK, BOUND, EDGE_ROWS, EXPECTED, LIMITS, SHELF, STANDS_ON, WRITER, WROTE, eid, path, query, tables
from quillgraph import errors as E
from quillgraph.catalog import EntityCatalog
from quillgraph.functions.ids import typed_id, typed_id_column
from quillgraph.operators import validate
from quillgraph.operators.paths import admit_tables, admitted_path, one_hop, property_path, with_position
from quillgraph.operators.tables import EntityTable, RelationTable
from quillgraph.plans.ir import ANY, IN, Binary, Edge, Endpoint, Literal, Node, Path, Projection, Property, Query
from quillgraph.types import ENTITY, EntitySchema, RelationField, RelationSchema


def rows(spark, q=None, limits=LIMITS, **kw):
    return [tuple(r) for r in property_path(q or query(), *tables(spark, **kw), limits).rows.collect()]


def test_two_hops_nulls_first_and_ids(spark):
    assert rows(spark) == EXPECTED
    one = spark.range(1).select(typed_id_column("entity", __import__("pyspark").sql.functions.lit("né/1")))
    assert one.first()[0] == typed_id("entity", "né/1")


def test_input_order_does_not_matter(spark):
    assert rows(spark, edge_rows={k: v[::-1] for k, v in EDGE_ROWS.items()}) == EXPECTED


def test_duplicate_edges_are_kept(spark):
    assert rows(spark, query("se")) == [("Bo", "Moss", "A1"), ("Bo", "Tides", "A1"), ("Bo", "Tides", "A1")]
    assert rows(spark, edge_rows={WROTE: [("w1", "b4"), ("w1", "b4")]}) == [("Ada", "Tides", "A1")] * 4


def test_positions_follow_the_order(spark):
    got = with_position(property_path(query("se"), *tables(spark), LIMITS).rows)
    assert got.columns == ["writer", "title", "shelf", "position"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == [("Bo", "Moss", "A1", 1), ("Bo", "Tides", "A1", 2), ("Bo", "Tides", "A1", 3)]


def test_absent_and_null_values_match_nothing_but_columns_stay(spark):
    made = property_path(query("nowhere"), *tables(spark), LIMITS).rows
    assert made.columns == ["writer", "title", "shelf"] and made.collect() == []
    assert rows(spark, entity_rows={WRITER: [("w1", "Ada", None), ("w2", "Bo", "se"), ("w3", "Cy", None)]}) == []


@pytest.mark.parametrize("field", ["max_input_rows", "max_input_bytes", "max_join_rows", "max_output_cells", "execution_memory_bytes"])
def test_every_budget(spark, field):
    for value in (0, 1):
        with pytest.raises(E.ResourceLimit):
            rows(spark, limits=replace(LIMITS, **{field: value}))


def test_join_bound_is_before_filters(spark):
    assert rows(spark, limits=replace(LIMITS, max_join_rows=BOUND)) == EXPECTED
    with pytest.raises(E.ResourceLimit):
        rows(spark, limits=replace(LIMITS, max_join_rows=BOUND - 1))


def test_bad_tables(spark):
    with pytest.raises(E.InvalidTable, match="dangling"):
        rows(spark, edge_rows={WROTE: [("w1", "nobody")]})
    with pytest.raises(E.InvalidTable, match="duplicate"):
        rows(spark, entity_rows={SHELF: [("h1", "x", "y"), ("b1", "y", None), ("h2", None, None)]})
    with pytest.raises(E.InvalidTable, match="null edge"):
        entities, relations = tables(spark)
        property_path(query(), entities, [RelationTable(WROTE, spark.createDataFrame([(eid("w1"), None)], "writer string, book string")), relations[1]], LIMITS)
    entities, relations = tables(spark)
    writers = "entity_id string, name string, country string"
    for bad, error in (("no id", E.InvalidIdentity), (None, E.InvalidTable)):
        with pytest.raises(error):
            property_path(query(), [EntityTable(WRITER, spark.createDataFrame([(bad, "x", "y")], writers)), *entities[1:]], relations, LIMITS)
    renamed = entities[0].rows.withColumnRenamed("name", "called")
    with pytest.raises(E.InvalidTable, match="columns"):
        property_path(query(), [EntityTable(WRITER, renamed), *entities[1:]], relations, LIMITS)


def test_what_validation_finds(spark):
    entities, relations = tables(spark, entity_rows={SHELF: [("h1", "A1", "0"), ("h1", "A2", None)]})
    assert [tuple(r) for r in validate.duplicate_ids(entities).collect()] == [(eid("h1"), 2)]
    assert [tuple(r) for r in validate.dangling_endpoints(entities, relations).collect()] == [(eid("h2"),)]
    got = validate.input_facts(*tables(spark)).first()
    assert [got[f"rows_{i}"] for i in range(5)] == [3, 5, 2, 5, 7] and (got["most_times"], got["least_times"], got["null_ids"]) == (1, 1, 0)


def test_tables_are_validated_once_for_many_queries(spark, monkeypatch):
    q, jobs = query(), []
    facts = validate.input_facts
    monkeypatch.setattr(validate, "input_facts", lambda *a: jobs.append(1) or facts(*a))
    admitted = admit_tables(*tables(spark), LIMITS, q.entities.digest, q.relations.digest)
    assert [tuple(r) for r in admitted_path(q, admitted, LIMITS).rows.collect()] == EXPECTED
    assert admitted_path(query("se"), admitted, LIMITS).rows.count() == 3 and len(jobs) == 1
    with pytest.raises(E.ResourceLimit):
        admitted_path(q, admitted, replace(LIMITS, max_join_rows=BOUND - 1))
    with pytest.raises(E.CatalogMismatch):
        admitted_path(replace(q, entities=EntityCatalog([BOOK])), admitted, LIMITS)


def test_wrong_type_endpoint_gives_no_row(spark):
    assert rows(spark, edge_rows={WROTE: [("w1", "h1")]}) == []


def test_catalog_substitution(spark):
    entities, relations = tables(spark)
    with pytest.raises(E.CatalogMismatch):
        property_path(query(), entities[:2], relations, LIMITS)
    with pytest.raises(E.CatalogMismatch):
        EntityCatalog([BOOK, BOOK])


@pytest.mark.parametrize(
    "changed",
    [
        {"ordering": ("x",)}, {"limit": 1}, {"offset": 1}, {"distinct": True}, {"grouping": ("x",)}, {"aggregations": ("count",)}, {"projections": ()},
        {"paths": (path(), path())}, {"filters": (Binary(Property("w", "name"), "<", Literal("a")),)}, {"filters": (Binary(Property("w", "name"), "=", Literal(1)),)},
        {"filters": (Binary(Property("w", "name"), "=", Property("b", "title")),)}, {"filters": (Binary(Literal("a"), "=", Property("w", "name")),)},
        {"projections": (Projection(Literal("x"), "a"),)}, {"projections": (Projection(Property("z", "title"), "a"),)}, {"projections": (Projection(Property("w", "nothing"), "a"),)},
        {"projections": (Projection(Property("w", "name"), "a"), Projection(Property("b", "title"), "a"))},
    ],
)
def test_refused_shapes(spark, changed):
    with pytest.raises(E.UnsupportedShape):
        rows(spark, query(**changed))


@pytest.mark.parametrize("edge", [{"direction": IN}, {"direction": ANY}, {"max_hops": None}, {"max_hops": 2}, {"min_hops": 2, "max_hops": 2}, {"binding": "e"}, {"types": (WROTE.id, STANDS_ON.id)}])
def test_refused_edges(spark, edge):
    p = path()
    with pytest.raises(E.UnsupportedShape):
        rows(spark, query(paths=(Path(p.nodes, (replace(p.edges[0], **edge), p.edges[1])),)))


def test_refused_nodes(spark):
    p = path()
    with pytest.raises(E.UnsupportedShape):
        rows(spark, query(paths=(Path((p.nodes[0], p.nodes[1], Node("w", (SHELF.id,))), p.edges),)))
    with pytest.raises(E.RelationMismatch):
        rows(spark, query(paths=(Path(p.nodes, (Edge(("other",)), p.edges[1])),)))


def hop(spark, *columns, edge=None, filters=()):
    p = Path((Node("a", (WRITER.id,)), Node("b", (BOOK.id,))), (edge or Edge((WROTE.id,), binding="e"),))
    return one_hop(Query((p,), tuple(Projection(Endpoint(c), f"o{i}") for i, c in enumerate(columns)), filters), tables(spark)[1][0])


def test_one_hop(spark):
    got = hop(spark, "b", "a", "b")
    assert sorted(got.rows.collect()) == sorted((eid(b), eid(a), eid(b)) for a, b in EDGE_ROWS[WROTE])
    assert got.node_types == {"o0": BOOK.id, "o1": WRITER.id, "o2": BOOK.id}
    for bad in ({"columns": ()}, {"columns": ("z",)}, {"columns": ("a",), "filters": (1,)}, {"columns": ("a",), "edge": Edge((WROTE.id,), direction=IN)}):
        with pytest.raises(E.UnsupportedShape):
            hop(spark, *bad.pop("columns"), **bad)
    ternary = RelationSchema("r", "r", tuple(RelationField(c, ENTITY) for c in "xyz"))
    p = Path((Node("a", ("t",)), Node("b", ("t",))), (Edge(("r",)),))
    with pytest.raises(E.InvalidRelationSchema):
        one_hop(Query((p,), (Projection(Endpoint("a"), "a"),)), RelationTable(ternary, spark.range(1)))
    with pytest.raises(E.InvalidIdentity):
        one_hop(Query((Path(p.nodes, (Edge((WROTE.id,)),)),), (Projection(Endpoint("a"), "a"),)), RelationTable(WROTE, spark.createDataFrame([("x", None)], "writer string, book string")))


def test_reserved_property_name():
    with pytest.raises(E.SchemaMismatch):
        EntitySchema("t", "T", (RelationField("entity_id", ENTITY),))


def test_plan_pushes_filter_and_prunes(spark, tmp_path):
    """The filter reaches the scan and unused properties are not read."""
    entities, relations = tables(spark)
    for i, t in enumerate(entities):
        t.rows.write.parquet(f"{tmp_path}/e{i}")
    kept = [EntityTable(t.schema, spark.read.parquet(f"{tmp_path}/e{i}")) for i, t in enumerate(entities)]
    plan = property_path(query(projections=(Projection(Property("b", "title"), "x"),)), kept, relations, LIMITS).rows._jdf.queryExecution().toString()
    assert "EqualTo(country,ie)" in plan

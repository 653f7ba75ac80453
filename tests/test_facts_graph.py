import shutil

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillgraph import errors as E
from quillgraph import types as T
from quillgraph.functions.ids import typed_id
from quillgraph.operators import facts, graph
from quillgraph.sources.graph_files import PreparedGraph, partition_neighbours, read_metadata, read_offsets, write_graph

GEN = typed_id("generation", "g")
READING = T.RelationSchema(
    typed_id("relation", "reading"), "reading",
    (
        T.RelationField("meter", T.ENTITY), T.RelationField("sealed", T.BOOLEAN), T.RelationField("ticks", T.INTEGER), T.RelationField("gain", T.floating(64)),
        T.RelationField("remark", T.STRING, True), T.RelationField("frame", T.BYTES), T.RelationField("taken", T.timestamp("us", "utc")), T.RelationField("span", T.DURATION),
    ),
)
NESTED = T.RelationSchema(
    typed_id("relation", "nested"), "nested",
    (T.RelationField("profile", T.record(T.RelationField("name", T.STRING), T.RelationField("scores", T.list_of(T.INTEGER, True)), T.RelationField("metadata", T.record(T.RelationField("active", T.BOOLEAN), T.RelationField("note", T.STRING, True)))), True),),
)
FOLLOWS = T.RelationSchema(typed_id("relation", "follows"), "follows", (T.RelationField("source", T.ENTITY), T.RelationField("destination", T.ENTITY)))
CONTEXT = "fact_id string, generation_id string, authority string, provenance string, completeness string, invalidated_by string"


def context(name, authority="rule", provenance="derivation", completeness="complete", invalidated=None):
    return (typed_id("fact", name), GEN, typed_id(authority, "a"), typed_id(provenance, "p"), completeness, invalidated)


def test_schema_metadata_and_types():
    fields = {f.name: f for f in facts.fact_schema(READING)}
    assert list(fields)[:6] == list(facts.COLUMNS) and fields["__qg_invalidated_by"].nullable
    assert fields["taken"].metadata["value-schema"] == "timestamp-lexical:us:utc" and fields["gain"].metadata["value-schema"] == "float-lexical:binary64"
    assert T.decimal(10, 2).label == "decimal-lexical:10:2" and T.ENTITY.label == "entity:typed-text-v1"
    with pytest.raises(E.SchemaMismatch):
        T.RelationSchema("r", "r", (T.RelationField("__qg_x", T.STRING),))
    deep = T.STRING
    for _ in range(16):
        deep = T.list_of(deep)
    with pytest.raises(E.SchemaMismatch):
        T.RelationSchema("r", "r", (T.RelationField("x", deep),))


def scalar_rows(spark, *rows):
    return spark.createDataFrame(list(rows), CONTEXT + ", meter string, sealed boolean, ticks long, gain string, remark string, frame binary, taken string, span string")


VALUES = (typed_id("entity", "gauge/9"), False, -12, "2.5e-3", None, b"\x07\xfe", "2031-01-02T03:04:05.000006Z", "PT90S")


def test_scalar_round_trip(spark):
    given = scalar_rows(spark, context("a") + VALUES, context("b", "rulepack", "entity", "partial", typed_id("fact", "z")) + VALUES)
    made = facts.encode_facts(READING, given)
    assert made.schema["taken"].metadata == {"value-schema": "timestamp-lexical:us:utc"}
    back = {r["fact_id"]: r for r in facts.decode_facts(READING, made).collect()}
    a, b = back[typed_id("fact", "a")], back[typed_id("fact", "b")]
    assert tuple(a)[-8:] == VALUES and (a["authority_kind"], a["provenance_kind"], a["validity"]) == ("rule", "derivation", "valid")
    assert (b["authority_kind"], b["provenance_kind"], b["validity"]) == ("rulepack", "entity", "invalidated")
    assert facts.distinct_contexts(made).count() == 2


@pytest.mark.parametrize("bad", [context("a", completeness="some"), context("a", invalidated="x"), context("a", authority="fact"), context("a", invalidated=typed_id("fact", "a")), ("x", *context("a")[1:])])
def test_bad_context(spark, bad):
    with pytest.raises(E.InvalidTable):
        facts.check_facts(READING, facts.encode_facts(READING, scalar_rows(spark, bad + VALUES)))


def test_duplicates_nulls_and_columns(spark):
    twice = facts.encode_facts(READING, scalar_rows(spark, context("a") + VALUES, context("a") + VALUES))
    with pytest.raises(E.InvalidTable, match="duplicate"):
        facts.check_facts(READING, twice)
    with pytest.raises(E.SchemaMismatch, match="null"):
        facts.check_facts(READING, facts.encode_facts(READING, scalar_rows(spark, context("a") + (VALUES[0], None, *VALUES[2:]))))
    with pytest.raises(E.SchemaMismatch):
        facts.check_facts(READING, twice.drop("remark"))
    with pytest.raises(E.SchemaMismatch):
        facts.encode_facts(READING, scalar_rows(spark).drop("remark"))


PROFILE = st.none() | st.tuples(st.text(max_size=20), st.lists(st.none() | st.integers(-(2**63), 2**63 - 1), max_size=8), st.tuples(st.booleans(), st.none() | st.text(max_size=5)))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PROFILE, min_size=1, max_size=8))
def test_nested_round_trip(spark, profiles):
    kind = CONTEXT + ", profile struct<name: string, scores: array<bigint>, metadata: struct<active: boolean, note: string>>"
    rows = spark.createDataFrame([context(str(i)) + (p,) for i, p in enumerate(profiles)], kind)
    back = {r["fact_id"]: r["profile"] for r in facts.decode_facts(NESTED, facts.encode_facts(NESTED, rows)).collect()}
    for i, p in enumerate(profiles):
        got = back[typed_id("fact", str(i))]
        assert (None if got is None else (got["name"], got["scores"], tuple(got["metadata"]))) == p


def test_nested_nulls_are_found(spark):
    kind = CONTEXT + ", profile struct<name: string, scores: array<bigint>, metadata: struct<active: boolean, note: string>>"
    rows = spark.createDataFrame([context("a") + ((None, [], (True, None)),)], kind)
    with pytest.raises(E.SchemaMismatch):
        facts.check_facts(NESTED, facts.encode_facts(NESTED, rows))


def people(spark, pairs, **kw):
    rows = [context(f"{a}-{b}", **kw) + (typed_id("entity", a), typed_id("entity", b)) for a, b in pairs]
    return facts.encode_facts(FOLLOWS, spark.createDataFrame(rows, CONTEXT + ", source string, destination string"))


PAIRS = [("mo", "ike"), ("ike", "zoe"), ("zoe", "mo"), ("mo", "zoe"), ("pia", "mo")]


def test_graph_round_trip_gives_the_same_facts(spark, tmp_path):
    made = people(spark, PAIRS)
    projection = graph.GraphProjection(FOLLOWS)
    source = write_graph(f"{tmp_path}/g", projection, graph.project_edges(projection, made))
    assert (source.vertices, source.edges) == (4, 5) and b"follows" in read_metadata(spark, f"{tmp_path}/g")
    prepared = PreparedGraph(spark, f"{tmp_path}/g", projection, 10, 10)
    assert sorted(map(tuple, prepared.admit(projection).collect())) == sorted(map(tuple, made.collect()))
    with pytest.raises(E.InvalidTable, match="exists"):
        write_graph(f"{tmp_path}/g", projection, graph.project_edges(projection, made))
    with pytest.raises(E.ResourceLimit):
        PreparedGraph(spark, f"{tmp_path}/g", projection, 3, 10)
    other = graph.GraphProjection(T.RelationSchema("x", "x", FOLLOWS.fields))
    with pytest.raises(E.RelationMismatch):
        prepared.admit(other)
    prepared.close()


def test_offsets_lead_to_a_vertex_and_damage_is_found(spark, tmp_path):
    pairs = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", f"n{(i * 7) % 40}") for i in range(40)]
    projection = graph.GraphProjection(FOLLOWS)
    source = write_graph(f"{tmp_path}/g", projection, graph.project_edges(projection, people(spark, pairs)), chunk=8)
    index = dict(map(tuple, spark.read.parquet(f"{tmp_path}/g/vertices").select("vertex_id", "entity_id").collect()))
    offsets = {r["vertex_id"]: (r["offset"], r["degree"]) for r in read_offsets(spark, f"{tmp_path}/g").collect()}
    assert len(index) == source.vertices == 41 and {*offsets} == {*range(41)}
    at = 0
    for v in range(41):
        mine = sorted(index[r["destination_id"]] for r in partition_neighbours(spark, f"{tmp_path}/g", v).collect()) if v % 5 == 0 else None
        names = [typed_id("entity", b) for a, b in pairs if typed_id("entity", a) == index[v]]
        assert offsets[v] == (at, len(names)) and mine in (None, sorted(names))
        at += len(names)
    plan = partition_neighbours(spark, f"{tmp_path}/g", 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "EqualTo(source_id,3)" in plan
    for part in (tmp_path / "g" / "offsets").parent.glob("vertices/chunk=1"):
        shutil.rmtree(part)
    with pytest.raises(E.InvalidTable):
        PreparedGraph(spark, f"{tmp_path}/g", projection, 100, 100)


def test_vertex_index_is_dense_and_sorted(spark):
    edges = spark.range(500).selectExpr("sha2(cast(id as string), 256) AS a", "sha2(cast((id + 1) % 500 as string), 256) AS b").selectExpr("'qg:entity:v1:' || a AS source", "'qg:entity:v1:' || b AS destination")
    index = graph.vertex_index(edges)
    rows = sorted(index.collect(), key=lambda r: r["entity_id"])
    assert [r["vertex_id"] for r in rows] == list(range(500)) and graph.check_dense(index) == 500
    indexed = graph.index_edges(edges, index)
    graph.check_resolved(indexed, "source_id", "destination_id")
    assert sorted(map(tuple, graph.resolve_edges(indexed.select("source_id", "destination_id"), index).collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(E.InvalidTable, match="unknown"):
        graph.check_resolved(graph.index_edges(edges, index.where("vertex_id > 3")), "source_id")
    plain = graph.dense_index(spark.createDataFrame([("b",), ("a",), ("é",), ("b",), ("",)], "k string"), "k")
    assert [tuple(r) for r in plain.orderBy("vertex_id").collect()] == [("", 0), ("a", 1), ("b", 2), ("é", 3)]


@pytest.mark.parametrize("rows,match", [([("a", 0), ("b", 2)], "dense"), ([("a", 0), ("b", 0)], "duplicate vertex"), ([("a", 0), ("a", 1)], "duplicate entity")])
def test_bad_vertices(spark, rows, match):
    with pytest.raises(E.InvalidTable, match=match):
        graph.check_dense(spark.createDataFrame(rows, "entity_id string, vertex_id long"))


def test_bad_edges(spark):
    projection = graph.GraphProjection(FOLLOWS)
    edges = graph.project_edges(projection, people(spark, PAIRS))
    with pytest.raises(E.RelationMismatch):
        graph.check_edges(graph.GraphProjection(T.RelationSchema("x", "follows", FOLLOWS.fields)), edges)
    with pytest.raises(E.InvalidTable):
        graph.check_edges(projection, edges.union(edges))
    with pytest.raises(E.InvalidTable):
        graph.check_edges(projection, edges.selectExpr("* EXCEPT (validity_kind)", "'invalidated' AS validity_kind"))
    with pytest.raises(E.InvalidRelationSchema):
        graph.GraphProjection(NESTED)


def test_static_edges(spark):
    edges = lambda *rows: spark.createDataFrame(list(rows), "source string, target string")
    facts.check_static_edges(edges(("knead", "bake")))
    for bad in ([("a", "b"), ("a", "b")], [("", "b")], [("a\n", "b")], [("a" * 257, "b")], [(None, "b")]):
        with pytest.raises(E.InvalidTable):
            facts.check_static_edges(edges(*bad))
    with pytest.raises(E.InvalidTable):
        facts.check_static_edges(edges(("a", "b"), ("a", "c")), most=1)
    made = facts.derive_static_facts(edges(("knead", "bake"), ("bake", "cool")), "src", GEN, typed_id("rule", "r"))
    relation = T.RelationSchema("e", "e", (T.RelationField("source", T.ENTITY), T.RelationField("target", T.ENTITY)))
    rows = facts.encode_facts(relation, made)
    assert facts.check_facts(relation, rows) == 2
    facts.check_static_facts(rows, {"generation_id": GEN, "completeness": "complete", "invalidated_by": None})
    with pytest.raises(E.InvalidTable):
        facts.check_static_facts(rows, {"generation_id": typed_id("generation", "other")})

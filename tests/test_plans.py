import hashlib
from dataclasses import replace

import pytest

from graph_fixture import ENTITIES, RELATIONS, SNAPSHOT, SOURCE, WROTE, path, query
from quillgraph import errors as E
from quillgraph.functions.cid import cbor_cid
from quillgraph.plans.binding import EngineProfile, admit_graph_metadata, admit_graph_source, bind_query, project_output, required_features
from quillgraph.plans.gql import compile_source
from quillgraph.plans.ir import ANY, CatalogQuery, Edge, Parameter, Path, Query
from quillgraph.sources.manifest import Manifest, TableDescriptor, snapshot_block


def test_text_is_the_query():
    assert compile_source(SOURCE, RELATIONS, ENTITIES) == query().query
    assert compile_source(SOURCE + " ;", RELATIONS, ENTITIES, hashlib.sha256((SOURCE + " ;").encode()).hexdigest()) == query().query
    q = compile_source("match (w:Writer)-[:WROTE]->(b:Book) where w.name = 'it''s' and b.title = 'a\\'b' return b.title", RELATIONS, ENTITIES)
    assert [f.right.value for f in q.filters] == ["it's", "a'b"] and q.projections[0].alias == "b.title"


@pytest.mark.parametrize(
    "text",
    ["", "MATCH (w:Writer) RETURN w.name", SOURCE + " LIMIT 1", SOURCE.replace("->", "-"), SOURCE.replace("=", "<"), SOURCE.replace("Book)", "Nothing)"), SOURCE.replace(":WROTE", "e:WROTE"), SOURCE + "#"],
)
def test_other_text_is_refused(text):
    with pytest.raises(E.ParseError):
        compile_source(text, RELATIONS, ENTITIES)


def test_digest_comes_before_parsing():
    with pytest.raises(E.ParseError, match="named"):
        compile_source("no query at all", RELATIONS, ENTITIES, "0" * 64)


def _snapshot(**changed):
    base = {"snapshot": SNAPSHOT, "relation_digest": RELATIONS.digest, "entity_digest": ENTITIES.digest, "relations": tuple(TableDescriptor(s.id, 0, ()) for s in RELATIONS.schemas)}
    return snapshot_block(Manifest(**(base | changed)))


def test_binding():
    bound = bind_query(query(), _snapshot())
    assert bound.root == _snapshot().cid
    for changed in ({"relation_digest": "x"}, {"entity_digest": "x"}, {"snapshot": replace(SNAPSHOT, generation="other")}, {"snapshot": replace(SNAPSHOT, revisions=())}):
        with pytest.raises(E.BindingError):
            bind_query(query(), _snapshot(**changed))
    with pytest.raises(E.BindingError):
        project_output(bound, EngineProfile("other"), None)
    assert project_output(bound, bound.engine, "rows").rows == "rows"


def test_features():
    p = path()
    edge = lambda **k: Query((Path(p.nodes, (Edge((WROTE.id,), **k), p.edges[1])),))
    assert required_features(edge(max_hops=None)) == {"unbounded_path"}
    assert required_features(edge(max_hops=3)) == {"bounded_path"}
    assert required_features(edge(direction=ANY)) == {"undirected_path"}
    assert required_features(edge(min_hops=2, max_hops=2)) == set()  # binds, and is refused by the executor
    assert required_features(Query((p,), aggregations=(1,), ordering=(1,), offset=Parameter("x"))) == {"aggregation", "ordering", "offset", "parameterized_pagination"}
    assert required_features(Query((p,), limit=3, distinct=True, grouping=("x",))) == set()
    wide = CatalogQuery(edge(max_hops=3), RELATIONS, ENTITIES, SNAPSHOT)
    with pytest.raises(E.BindingError, match="bounded_path"):
        bind_query(wide, _snapshot())
    bind_query(wide, _snapshot(), EngineProfile("e", features=frozenset({"bounded_path"})))
    with pytest.raises(E.BindingError):
        EngineProfile(" padded")


def test_graph_sources():
    meta = b"graph metadata"
    bound = bind_query(query(), _snapshot(graph=cbor_cid(meta)), EngineProfile("g", requires_graph_projection=True))
    admit_graph_metadata(bound, WROTE.id, meta)
    for call in (lambda: admit_graph_metadata(bound, WROTE.id, b"else"), lambda: admit_graph_source(bound, "other", cbor_cid(meta)), lambda: admit_graph_source(bound, WROTE.id, cbor_cid(b"x"))):
        with pytest.raises(E.BindingError):
            call()
    with pytest.raises(E.BindingError):
        bind_query(query(), _snapshot(), EngineProfile("g", requires_graph_projection=True))


def test_results_are_admitted_within_limits(spark):
    from quillgraph.plans.binding import ResultLimits, admit_result, admit_rows

    bound = bind_query(query(), _snapshot())
    rows = spark.createDataFrame([("a", None, "x"), ("b", "t", "y")], "writer string, title string, shelf string").coalesce(1)
    got = admit_result(project_output(bound, bound.engine, rows), ResultLimits(2, 6))
    text = '["writer","title","shelf"]\n["a",null,"x"]\n["b","t","y"]\n'
    assert got.rows == (("a", None, "x"), ("b", "t", "y")) and got.digest == hashlib.sha256(text.encode()).hexdigest()
    for limits in (ResultLimits(1, 6), ResultLimits(2, 5), ResultLimits(0, 6), ResultLimits(2, 0)):
        with pytest.raises(E.ResourceLimit):
            admit_rows(rows, rows.columns, limits)
    for other in (rows.select("title", "writer", "shelf"), rows.selectExpr("writer", "title", "1 AS shelf")):
        with pytest.raises(E.InvalidTable):
            admit_result(project_output(bound, bound.engine, other), ResultLimits(9, 99))
    assert admit_rows(rows.orderBy("shelf"), rows.columns, ResultLimits(2, 6)).digest != admit_rows(rows.orderBy(rows.shelf.desc()), rows.columns, ResultLimits(2, 6)).digest

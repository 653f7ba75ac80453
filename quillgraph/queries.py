"""The engine's queries over the test tables, each with its SQL twin."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EntityCatalog, RelationCatalog, SemanticSnapshot
from .functions.cid import content_hash
from .functions.ids import typed_id, typed_id_column
from .operators import closure, facts, graph
from .operators.paths import one_hop, property_path, with_position
from .operators.tables import EntityTable, RelationTable
from .operators.validate import dangling_endpoints as find_dangling
from .operators.validate import duplicate_ids, duplicates, input_facts, validate_tables
from .plans.binding import ResultLimits, admit_rows
from .plans.gql import compile_source
from .plans import limits as budgets
from .plans.ir import Binary, CatalogQuery, Edge, Endpoint, Literal, Node, Path, Projection, Property, Query
from .sources.graph_files import PreparedGraph, read_offsets, write_graph
from .sources.scratch import table_path
from .types import BOOLEAN, ENTITY, INTEGER, STRING, EntitySchema, RelationField, RelationSchema, list_of, record

QUERIES: dict = {}
ORACLES: dict = {}

# entity type: table, key column, properties (name, column); all carried as strings
_ENTITIES = {
    "Region": ("region", "r_regionkey", [("name", "r_name")]),
    "Nation": ("nation", "n_nationkey", [("name", "n_name")]),
    "Customer": ("customer", "c_custkey", [("name", "c_name"), ("segment", "c_mktsegment")]),
    "Supplier": ("supplier", "s_suppkey", [("name", "s_name")]),
    "Part": ("part", "p_partkey", [("name", "p_name"), ("brand", "p_brand"), ("type", "p_type")]),
    "Order": ("orders", "o_orderkey", [("status", "o_orderstatus"), ("priority", "o_orderpriority")]),
    "Document": ("documents", "doc_id", [("lang", "lang"), ("source", "source")]),
}
# relation: table, source type and key column, target type and key column
_RELATIONS = {
    "IN_REGION": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    "CUST_NATION": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    "SUPP_NATION": ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    "PLACED": ("orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    "SHIPPED_BY": ("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey"),
}
ENTITY_SCHEMAS = {n: EntitySchema(typed_id("entity_type", n), n, tuple(RelationField(p, STRING, True) for p, _ in props)) for n, (_, _, props) in _ENTITIES.items()}
RELATION_SCHEMAS = {n: RelationSchema(typed_id("relation", n), n, (RelationField("source", ENTITY), RelationField("target", ENTITY))) for n in _RELATIONS}
GENERATION = typed_id("generation", "test-tables")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _key(kind: str, column: str):
    return typed_id_column("entity", F.concat(F.lit(f"{kind}/"), F.col(column).cast("string")))


def _sql_id(kind: str, key: str) -> str:
    return f"'qg:{kind}:v1:' || sha256('{len(kind)}:{kind}:' || strlen({key}) || ':' || {key})"


def _sql_key(kind: str, column: str) -> str:
    return _sql_id("entity", f"('{kind}/' || {column})")


def entity_rows(spark, sf, kind: str, **replaced) -> EntityTable:
    table, key, props = _ENTITIES[kind]
    columns = [replaced.get(p, F.col(c)).cast("string").alias(p) for p, c in props]
    return EntityTable(ENTITY_SCHEMAS[kind], _table(spark, sf, table).select(_key(kind, key).alias("entity_id"), *columns))


def relation_rows(spark, sf, name: str) -> RelationTable:
    table, a, x, b, y = _RELATIONS[name]
    return RelationTable(RELATION_SCHEMAS[name], _table(spark, sf, table).select(_key(a, x).alias("source"), _key(b, y).alias("target")))


def _catalogs(kinds, names):
    return RelationCatalog([RELATION_SCHEMAS[n] for n in names]), EntityCatalog([ENTITY_SCHEMAS[k] for k in kinds])


def _path_query(kinds: list[str], names: list[str], returned: dict[str, tuple[str, str]], where: list[tuple[str, str, str]] = ()) -> CatalogQuery:
    """Nodes are bound as a, b, c; ``returned`` is alias: (binding, property)."""
    binding = dict(zip("abc", kinds))
    nodes = tuple(Node(b, (ENTITY_SCHEMAS[k].id,)) for b, k in binding.items())
    edges = tuple(Edge((RELATION_SCHEMAS[n].id,)) for n in names)
    query = Query(
        (Path(nodes, edges),), tuple(Projection(Property(*p), alias) for alias, p in returned.items()),
        tuple(Binary(Property(b, p), "=", Literal(v)) for b, p, v in where),
    )
    return CatalogQuery(query, *_catalogs(dict.fromkeys(kinds), names))


def _run_path(spark, sf, kinds, names, returned, where=(), replaced=None) -> DataFrame:
    query = _path_query(kinds, names, returned, where)
    entities = [entity_rows(spark, sf, k, **(replaced or {}).get(k, {})) for k in dict.fromkeys(kinds)]
    return property_path(query, entities, [relation_rows(spark, sf, n) for n in names]).rows


def _register(name: str, oracle: str | None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


_FLAGSHIP = (["Customer", "Order", "Part"], ["PLACED", "CONTAINS"])
_FLAGSHIP_FROM = "FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
_SPB = {"segment": ("a", "segment"), "priority": ("b", "priority"), "brand": ("c", "brand")}
_SPB_SQL = "SELECT c_mktsegment AS segment, o_orderpriority AS priority, p_brand AS brand"


@_register("path2_filter_project", f"{_SPB_SQL} {_FLAGSHIP_FROM} WHERE c_mktsegment = 'BUILDING'")
def path2_filter_project(spark, sf):
    return _run_path(spark, sf, *_FLAGSHIP, _SPB, [("a", "segment", "BUILDING")])


@_register("path2_two_filters", f"{_SPB_SQL} {_FLAGSHIP_FROM} WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'")
def path2_two_filters(spark, sf):
    return _run_path(spark, sf, *_FLAGSHIP, _SPB, [("a", "segment", "BUILDING"), ("b", "priority", "1-URGENT")])


@_register("path2_multiplicity", f"SELECT o_orderpriority AS priority, p_type AS part_type {_FLAGSHIP_FROM} WHERE p_brand = 'Brand#11'")
def path2_multiplicity(spark, sf):
    return _run_path(spark, sf, *_FLAGSHIP, {"priority": ("b", "priority"), "part_type": ("c", "type")}, [("c", "brand", "Brand#11")])


@_register(
    "path2_ordered",
    f"SELECT *, row_number() OVER (ORDER BY brand NULLS FIRST, priority NULLS FIRST, segment NULLS FIRST) AS position FROM (SELECT nullif(p_brand, 'Brand#11') AS brand, o_orderpriority AS priority, c_mktsegment AS segment {_FLAGSHIP_FROM} WHERE c_mktsegment = 'BUILDING')",
)
def path2_ordered(spark, sf):
    """Every row with its place in the result's order: ascending by each alias in turn, nulls first."""
    returned = {"brand": ("c", "brand"), "priority": ("b", "priority"), "segment": ("a", "segment")}
    return with_position(_run_path(spark, sf, *_FLAGSHIP, returned, [("a", "segment", "BUILDING")], {"Part": {"brand": F.nullif(F.col("p_brand"), F.lit("Brand#11"))}}))


@_register("path2_empty_result", f"{_SPB_SQL} {_FLAGSHIP_FROM} WHERE c_mktsegment = 'NO SUCH SEGMENT'")
def path2_empty_result(spark, sf):
    return _run_path(spark, sf, *_FLAGSHIP, _SPB, [("a", "segment", "NO SUCH SEGMENT")])


@_register("path2_null_property", f"SELECT o_orderstatus AS status, nullif(p_brand, 'Brand#11') AS brand {_FLAGSHIP_FROM} WHERE c_mktsegment = 'BUILDING'")
def path2_null_property(spark, sf):
    returned = {"status": ("b", "status"), "brand": ("c", "brand")}
    return _run_path(spark, sf, *_FLAGSHIP, returned, [("a", "segment", "BUILDING")], {"Part": {"brand": F.nullif(F.col("p_brand"), F.lit("Brand#11"))}})


@_register("path2_null_filter_no_match", f"{_SPB_SQL} {_FLAGSHIP_FROM} WHERE nullif(p_brand, 'Brand#11') = 'Brand#11'")
def path2_null_filter_no_match(spark, sf):
    return _run_path(spark, sf, *_FLAGSHIP, _SPB, [("c", "brand", "Brand#11")], {"Part": {"brand": F.nullif(F.col("p_brand"), F.lit("Brand#11"))}})


@_register("path1_property", "SELECT c_name AS customer, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def path1_property(spark, sf):
    returned = {"customer": ("a", "name"), "priority": ("b", "priority")}
    return _run_path(spark, sf, ["Customer", "Order"], ["PLACED"], returned, [("b", "status", "O")])


def _endpoints(spark, sf, name: str, *columns: tuple[str, str]) -> DataFrame:
    a, b = _RELATIONS[name][1], _RELATIONS[name][3]
    path = Path((Node("a", (ENTITY_SCHEMAS[a].id,)), Node("b", (ENTITY_SCHEMAS[b].id,))), (Edge((RELATION_SCHEMAS[name].id,), binding="e"),))
    return one_hop(Query((path,), tuple(Projection(Endpoint(x), alias) for x, alias in columns)), relation_rows(spark, sf, name)).rows


_CUSTOMER, _ORDER = _sql_key("Customer", "o_custkey"), _sql_key("Order", "o_orderkey")


@_register("path1_endpoints", f"SELECT {_CUSTOMER} AS customer, {_ORDER} AS placed FROM orders")
def path1_endpoints(spark, sf):
    return _endpoints(spark, sf, "PLACED", ("a", "customer"), ("b", "placed"))


@_register("path1_target_only", f"SELECT {_ORDER} AS placed FROM orders")
def path1_target_only(spark, sf):
    return _endpoints(spark, sf, "PLACED", ("b", "placed"))


@_register("path1_repeat_endpoint", f"SELECT {_ORDER} AS one, {_CUSTOMER} AS two, {_ORDER} AS three FROM orders")
def path1_repeat_endpoint(spark, sf):
    return _endpoints(spark, sf, "PLACED", ("b", "one"), ("a", "two"), ("b", "three"))


@_register(
    "chain_nation_region",
    "SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def chain_nation_region(spark, sf):
    returned = {"customer": ("a", "name"), "nation": ("b", "name"), "region": ("c", "name")}
    return _run_path(spark, sf, ["Customer", "Nation", "Region"], ["CUST_NATION", "IN_REGION"], returned)


@_register("shipped_by", "SELECT o_orderstatus AS status, s_name AS supplier FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '2-HIGH'")
def shipped_by(spark, sf):
    returned = {"status": ("a", "status"), "supplier": ("b", "name")}
    return _run_path(spark, sf, ["Order", "Supplier"], ["SHIPPED_BY"], returned, [("a", "priority", "2-HIGH")])


@_register("supplier_nation", "SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def supplier_nation(spark, sf):
    return _run_path(spark, sf, ["Supplier", "Nation"], ["SUPP_NATION"], {"supplier": ("a", "name"), "nation": ("b", "name")})


@_register("wrong_type_endpoint_drops", "SELECT c_name AS customer, p_brand AS brand FROM customer JOIN orders ON o_custkey = c_custkey JOIN part ON 'Part/' || p_partkey = 'Order/' || o_orderkey")
def wrong_type_endpoint_drops(spark, sf):
    """Orders are valid endpoints, but the pattern wants parts: no rows, and no error."""
    kinds, names = ["Customer", "Part"], ["PLACED"]
    query = _path_query(kinds, names, {"customer": ("a", "name"), "brand": ("b", "brand")})
    tables = [entity_rows(spark, sf, k) for k in ("Customer", "Part", "Order")]
    query = CatalogQuery(query.query, query.relations, EntityCatalog([t.schema for t in tables]))
    return property_path(query, tables, [relation_rows(spark, sf, "PLACED")]).rows


@_register("source_text_query", f"SELECT c_name AS customer, p_name AS \"c.name\" {_FLAGSHIP_FROM} WHERE c_mktsegment = 'MACHINERY' AND p_brand = 'Brand#22'")
def source_text_query(spark, sf):
    relations, entities = _catalogs(*_FLAGSHIP)
    text = "MATCH (a:Customer)-[:PLACED]->(b:Order)-[:CONTAINS]->(c:Part) WHERE a.segment = 'MACHINERY' AND c.brand = 'Brand#22' RETURN a.name AS customer, c.name"
    query = CatalogQuery(compile_source(text, relations, entities), relations, entities)
    kinds, names = _FLAGSHIP
    return property_path(query, [entity_rows(spark, sf, k) for k in kinds], [relation_rows(spark, sf, n) for n in names]).rows


@_register("snapshot_query", "SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def snapshot_query(spark, sf):
    """Materialised to blocks, published, restored from the remote side and queried as text."""
    from .sources.blocks import MemoryStore
    from .sources.snapshot import PropertyInput, materialize_snapshot, publish_snapshot, query_source

    relations, entities = _catalogs(["Supplier", "Nation"], ["SUPP_NATION"])
    snapshot, local, remote = SemanticSnapshot(GENERATION), MemoryStore(), MemoryStore()
    given = PropertyInput(relations, entities, snapshot, [entity_rows(spark, sf, k) for k in ("Supplier", "Nation")], [relation_rows(spark, sf, "SUPP_NATION")])
    root = materialize_snapshot(given, local)
    publish_snapshot(local, remote, root, relations, entities)
    text = "MATCH (s:Supplier)-[:SUPP_NATION]->(n:Nation) WHERE n.name = 'NATION_3' RETURN s.name AS supplier, n.name AS nation"
    return query_source(spark, text, None, root.cid, relations, entities, snapshot, MemoryStore(), remote).rows


_SUPPLIED = "SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _supplied(spark, sf) -> DataFrame:
    return _run_path(spark, sf, ["Supplier", "Nation"], ["SUPP_NATION"], {"supplier": ("a", "name"), "nation": ("b", "name")})


@_register("car_round_trip", _SUPPLIED)
def car_round_trip(spark, sf):
    """A snapshot as one archive file, imported into an empty store and queried there."""
    from .sources.blocks import MemoryStore
    from .sources.car import encode_archive, import_archive
    from .sources.snapshot import PropertyInput, materialize_snapshot, query_source

    relations, entities = _catalogs(["Supplier", "Nation"], ["SUPP_NATION"])
    snapshot, one, other = SemanticSnapshot(GENERATION), MemoryStore(), MemoryStore()
    given = PropertyInput(relations, entities, snapshot, [entity_rows(spark, sf, k) for k in ("Supplier", "Nation")], [relation_rows(spark, sf, "SUPP_NATION")])
    root = materialize_snapshot(given, one)
    archive = encode_archive(root, {c: one.get(c, 1 << 30) for c in root.manifest.references()})
    import_archive(archive, relations, entities, other)
    text = "MATCH (s:Supplier)-[:SUPP_NATION]->(n:Nation) RETURN s.name AS supplier, n.name AS nation"
    return query_source(spark, text, None, root.cid, relations, entities, snapshot, other).rows


_SUPPLIER_FACT = _sql_id("fact", "CAST(s_suppkey AS VARCHAR)")


def _supplier_facts(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "supplier").select(
        typed_id_column("fact", F.col("s_suppkey").cast("string")).alias("fact_id"), F.lit(GENERATION).alias("generation_id"), F.lit(typed_id("rule", "supply")).alias("authority"),
        F.lit(typed_id("derivation", "run")).alias("provenance"), F.lit("complete").alias("completeness"), F.lit(None).cast("string").alias("invalidated_by"),
        _key("Supplier", "s_suppkey").alias("source"), _key("Nation", "s_nationkey").alias("target"),
    )
    return facts.encode_facts(RELATION_SCHEMAS["SUPP_NATION"], rows)


_SUPPLIER_FACTS = f"SELECT {_SUPPLIER_FACT} AS __qg_fact_id, {_sql_key('Supplier', 's_suppkey')} AS source, {_sql_key('Nation', 's_nationkey')} AS target FROM supplier"


@_register("ipc_file_round_trip", _SUPPLIER_FACTS)
def ipc_file_round_trip(spark, sf):
    from .sources import arrow_ipc as ipc

    relation = RELATION_SCHEMAS["SUPP_NATION"]
    wanted = ipc.fact_arrow_schema(relation)
    data = ipc.write_file(ipc.from_spark(graph.canonical_facts(_supplier_facts(spark, sf)), wanted))
    rows = ipc.to_spark(spark, ipc.read_file(data, wanted).replace_schema_metadata(None))
    facts.check_facts(relation, rows)
    return rows.select("__qg_fact_id", "source", "target")


@_register("multi_batch_scan", _SUPPLIER_FACTS)
def multi_batch_scan(spark, sf):
    """One table from a stream per nation, put together again."""
    from .sources import arrow_ipc as ipc

    wanted = ipc.fact_arrow_schema(RELATION_SCHEMAS["SUPP_NATION"])
    whole = ipc.from_spark(_supplier_facts(spark, sf), wanted)
    streams = [ipc.write_stream(whole.filter(pc.equal(whole["target"], t))) for t in whole["target"].unique()]
    return ipc.to_spark(spark, ipc.concat([ipc.read_stream(x, wanted) for x in streams], wanted).replace_schema_metadata(None)).select("__qg_fact_id", "source", "target")


_ROW_JSON = "'[\"' || supplier || '\",\"' || nation || '\"]' || chr(10)"


@_register("result_admission", f"SELECT count(*) AS n, sha256('[\"supplier\",\"nation\"]' || chr(10) || string_agg({_ROW_JSON}, '' ORDER BY supplier, nation)) AS digest FROM ({_SUPPLIED})")
def result_admission(spark, sf):
    """A result within its limits, and its digest in the result's order."""
    admitted = admit_rows(_supplied(spark, sf), ["supplier", "nation"], ResultLimits(1 << 20, 1 << 21))
    return spark.createDataFrame([(len(admitted.rows), admitted.digest)], "n long, digest string")


@_register("entity_table", f"SELECT {_sql_key('Document', 'doc_id')} AS entity_id, lang, source FROM documents")
def entity_table(spark, sf):
    return entity_rows(spark, sf, "Document").rows


@_register("relation_table", f"SELECT {_sql_key('Order', 'l_orderkey')} AS source, {_sql_key('Part', 'l_partkey')} AS target FROM lineitem")
def relation_table(spark, sf):
    return relation_rows(spark, sf, "CONTAINS").rows


# facts over orders: even keys are derived by a rule and complete, odd ones come from a source; every tenth is invalidated
_PLACED = RELATION_SCHEMAS["PLACED"]


def _order_facts(spark, sf) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    even = F.col("o_orderkey") % 2 == 0
    rows = _table(spark, sf, "orders").select(
        typed_id_column("fact", key).alias("fact_id"), F.lit(GENERATION).alias("generation_id"),
        F.when(even, F.lit(typed_id("rule", "placed"))).otherwise(F.lit(typed_id("entity", "desk"))).alias("authority"),
        F.when(even, F.lit(typed_id("derivation", "run"))).otherwise(F.lit(typed_id("entity", "orders"))).alias("provenance"),
        F.when(even, "complete").otherwise("partial").alias("completeness"),
        F.when(F.col("o_orderkey") % 10 == 0, typed_id_column("fact", F.concat(F.lit("undo/"), key))).alias("invalidated_by"),
        _key("Customer", "o_custkey").alias("source"), _key("Order", "o_orderkey").alias("target"),
    )
    return facts.encode_facts(_PLACED, rows)


_FACT, _KEY = _sql_id("fact", "CAST(o_orderkey AS VARCHAR)"), "o_orderkey % 2 = 0"
_AUTHORITY = f"CASE WHEN {_KEY} THEN '{typed_id('rule', 'placed')}' ELSE '{typed_id('entity', 'desk')}' END"
_PROVENANCE = f"CASE WHEN {_KEY} THEN '{typed_id('derivation', 'run')}' ELSE '{typed_id('entity', 'orders')}' END"
_COMPLETE = f"CASE WHEN {_KEY} THEN 'complete' ELSE 'partial' END"
_UNDO = f"CASE WHEN o_orderkey % 10 = 0 THEN {_sql_id('fact', chr(40) + chr(39) + 'undo/' + chr(39) + ' || o_orderkey)')} END"


@_register(
    "fact_encode",
    f"SELECT {_FACT} AS __qg_fact_id, '{GENERATION}' AS __qg_generation_id, {_AUTHORITY} AS __qg_authority, {_PROVENANCE} AS __qg_provenance, {_COMPLETE} AS __qg_completeness, "
    f"{_UNDO} AS __qg_invalidated_by, {_CUSTOMER} AS source, {_ORDER} AS target FROM orders",
)
def fact_encode(spark, sf):
    return _order_facts(spark, sf)


@_register(
    "fact_context_decode",
    f"SELECT {_FACT} AS fact_id, CASE WHEN {_KEY} THEN 'rule' ELSE 'entity' END AS authority_kind, CASE WHEN {_KEY} THEN 'derivation' ELSE 'entity' END AS provenance_kind, "
    f"CASE WHEN o_orderkey % 10 = 0 THEN 'invalidated' ELSE 'valid' END AS validity, {_ORDER} AS target FROM orders",
)
def fact_context_decode(spark, sf):
    return facts.decode_facts(_PLACED, _order_facts(spark, sf)).select("fact_id", "authority_kind", "provenance_kind", "validity", "target")


@_register("fact_contexts", f"SELECT '{GENERATION}' AS __qg_generation_id, {_AUTHORITY} AS __qg_authority, {_PROVENANCE} AS __qg_provenance, {_COMPLETE} AS __qg_completeness, o_orderkey % 10 <> 0 AS valid, count(*) AS facts FROM orders GROUP BY ALL")
def fact_contexts(spark, sf):
    return facts.distinct_contexts(_order_facts(spark, sf))


_PROFILE = RelationSchema(
    typed_id("relation", "profile"), "profile",
    (RelationField("profile", record(
        RelationField("name", STRING), RelationField("scores", list_of(INTEGER, True)),
        RelationField("metadata", record(RelationField("active", BOOLEAN), RelationField("note", STRING, True))),
    ), True),),
)


@_register(
    "fact_nested_record",
    f"SELECT {_sql_id('fact', chr(40) + chr(39) + 'part/' + chr(39) + ' || p_partkey)')} AS fact_id, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, "
    "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS first, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size + 1 AS VARCHAR) END AS last, "
    "CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN p_brand END AS note FROM part",
)
def fact_nested_record(spark, sf):
    part = _table(spark, sf, "part")
    size = F.col("p_size").cast("long")
    made = F.struct(
        F.col("p_name").alias("name"), F.array(size, F.lit(None).cast("long"), size + 1).alias("scores"),
        F.struct((F.col("p_partkey") % 2 == 0).alias("active"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("note")).alias("metadata"),
    )
    rows = part.select(
        typed_id_column("fact", F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("fact_id"), F.lit(GENERATION).alias("generation_id"),
        F.lit(typed_id("rule", "parts")).alias("authority"), F.lit(typed_id("derivation", "run")).alias("provenance"), F.lit("complete").alias("completeness"),
        F.lit(None).cast("string").alias("invalidated_by"), F.when(F.col("p_partkey") % 4 != 0, made).alias("profile"),
    )
    decoded = facts.decode_facts(_PROFILE, facts.encode_facts(_PROFILE, rows))
    return decoded.select("fact_id", "profile.name", F.col("profile.scores")[0].cast("string").alias("first"), F.col("profile.scores")[2].cast("string").alias("last"), F.col("profile.metadata.note").alias("note"))


@_register("static_edge_facts", f"SELECT {_sql_id('fact', chr(40) + chr(39) + '[' + chr(34) + 'static-edge-v1' + chr(34) + ',' + chr(34) + 'regions' + chr(34) + ',' + chr(34) + chr(39) + ' || n_name || ' + chr(39) + chr(34) + ',' + chr(34) + chr(39) + ' || r_name || ' + chr(39) + chr(34) + ']' + chr(39) + ')')} AS fact_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def static_edge_facts(spark, sf):
    edges = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    facts.check_static_edges(edges)
    return facts.derive_static_facts(edges, "regions", GENERATION, typed_id("rule", "regions")).select("fact_id")


_GRAPH = graph.GraphProjection(_PLACED)


def _edges(spark, sf) -> DataFrame:
    return graph.project_edges(_GRAPH, _order_facts(spark, sf))


@_register("edge_project", f"SELECT {_CUSTOMER} AS source, {_ORDER} AS destination, {_FACT} AS fact_id, '{_PLACED.id}' AS relation_id, {_COMPLETE} AS completeness, {_UNDO} AS invalidated_by FROM orders")
def edge_project(spark, sf):
    return _edges(spark, sf).select("source", "destination", "fact_id", "relation_id", "completeness", "invalidated_by")


@_register(
    "edge_flatten",
    f"SELECT {_FACT} AS fact_id, '{_PLACED.id}' AS relation_id, 'PLACED' AS predicate, '{GENERATION}' AS generation_id, CASE WHEN {_KEY} THEN 'rule' ELSE 'entity' END AS authority_kind, {_AUTHORITY} AS authority_id, "
    f"CASE WHEN {_KEY} THEN 'derivation' ELSE 'source' END AS provenance_kind, {_PROVENANCE} AS provenance_id, {_COMPLETE} AS completeness, "
    f"CASE WHEN o_orderkey % 10 = 0 THEN 'invalidated' ELSE 'valid' END AS validity_kind, {_UNDO} AS invalidated_by FROM orders",
)
def edge_flatten(spark, sf):
    return _edges(spark, sf).select(*graph.EDGE_PROPERTIES)


_VERTICES = f"WITH v AS (SELECT {_CUSTOMER} AS entity_id FROM orders UNION SELECT {_ORDER} FROM orders), i AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS vertex_id FROM v)"


@_register("vertex_index", f"{_VERTICES} SELECT entity_id, vertex_id FROM i")
def vertex_index(spark, sf):
    return graph.vertex_index(_edges(spark, sf))


_INDEXED = f"FROM orders JOIN i AS s ON s.entity_id = {_CUSTOMER} JOIN i AS t ON t.entity_id = {_ORDER}"


@_register("edge_index", f"{_VERTICES} SELECT {_FACT} AS fact_id, s.vertex_id AS source_id, t.vertex_id AS destination_id {_INDEXED}")
def edge_index(spark, sf):
    edges = _edges(spark, sf)
    return graph.index_edges(edges, graph.vertex_index(edges)).select("fact_id", "source_id", "destination_id")


@_register("edge_endpoints_resolve", f"SELECT {_FACT} AS fact_id, {_CUSTOMER} AS source, {_ORDER} AS destination FROM orders")
def edge_endpoints_resolve(spark, sf):
    edges = _edges(spark, sf)
    vertices = graph.vertex_index(edges)
    indexed = graph.index_edges(edges, vertices).select("fact_id", "source_id", "destination_id")
    return graph.resolve_edges(indexed, vertices).select("fact_id", "source", "destination")


@_register("edge_facts_round_trip", f"SELECT {_FACT} AS __qg_fact_id, {_PROVENANCE} AS __qg_provenance, {_UNDO} AS __qg_invalidated_by, {_CUSTOMER} AS source, {_ORDER} AS target FROM orders")
def edge_facts_round_trip(spark, sf):
    return graph.facts_from_edges(_GRAPH, _edges(spark, sf)).select("__qg_fact_id", "__qg_provenance", "__qg_invalidated_by", "source", "target")


@_register("dense_vertex_check", f"{_VERTICES} SELECT count(*) AS n, min(vertex_id) AS lo, max(vertex_id) AS hi, (SELECT max(c) FROM (SELECT count(*) AS c FROM i GROUP BY vertex_id)) AS most_ids, (SELECT max(c) FROM (SELECT count(*) AS c FROM i GROUP BY entity_id)) AS most_entities FROM i")
def dense_vertex_check(spark, sf):
    vertices = graph.vertex_index(_edges(spark, sf))
    graph.check_dense(vertices)
    return graph.vertex_facts(vertices)


@_register("edge_checks", "SELECT count(*) AS n, 1 AS most, 0 AS other, 0 AS torn, 0 AS lost FROM orders")
def edge_checks(spark, sf):
    graph.check_edges(_GRAPH, _edges(spark, sf))
    return graph.edge_facts(_GRAPH, _edges(spark, sf))


@_register(
    "fact_checks",
    "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 9 = 0) AS missing, count(*) FILTER (o_orderkey % 11 = 0) AS own, 2 AS most, max(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) * 2 AS contexts FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)",
)
def fact_checks(spark, sf):
    """What is counted of facts of which every row is there twice, and every few break a rule."""
    once = _order_facts(spark, sf)
    number = F.col("o_orderkey")
    broken = _table(spark, sf, "orders").select(typed_id_column("fact", number.cast("string")).alias("__qg_fact_id"), number)
    twice = once.union(once).join(broken.union(broken).distinct(), "__qg_fact_id").select(
        F.col("__qg_fact_id"), "__qg_generation_id", "__qg_authority", "__qg_provenance",
        F.when(number % 7 == 0, "some").otherwise(F.lit("complete")).alias("__qg_completeness"),
        F.when(number % 11 == 0, F.col("__qg_fact_id")).alias("__qg_invalidated_by"), F.when(number % 9 != 0, F.col("source")).alias("source"), "target",
    )
    return facts.fact_checks(_PLACED, twice)


@_register("graph_dataset_round_trip", f"SELECT {_FACT} AS __qg_fact_id, {_AUTHORITY} AS __qg_authority, {_COMPLETE} AS __qg_completeness, {_UNDO} AS __qg_invalidated_by, {_CUSTOMER} AS source, {_ORDER} AS target FROM orders")
def graph_dataset_round_trip(spark, sf):
    """Facts written as a graph dataset, read and checked again."""
    path = f"{table_path(spark, 'graph')}/g"
    made = write_graph(path, _GRAPH, _edges(spark, sf), chunk=1 << 12)
    prepared = PreparedGraph(spark, path, _GRAPH, made.vertices, made.edges)
    return prepared.admit(_GRAPH).select("__qg_fact_id", "__qg_authority", "__qg_completeness", "__qg_invalidated_by", "source", "target")


@_register(
    "graph_adjacency",
    f"{_VERTICES}, d AS (SELECT i.vertex_id, count(o_orderkey) AS degree FROM i LEFT JOIN orders ON i.entity_id = {_CUSTOMER} GROUP BY 1) "
    "SELECT vertex_id, coalesce(sum(degree) OVER (ORDER BY vertex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", degree FROM d",
)
def graph_adjacency(spark, sf):
    path = f"{table_path(spark, 'graph')}/g"
    write_graph(path, _GRAPH, _edges(spark, sf), chunk=1 << 12)
    return read_offsets(spark, path).select("vertex_id", "offset", "degree")


@_register("dup_entity_ids", f"SELECT {_sql_key('Customer', 'o_custkey')} AS id, count(*) AS times FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_entity_ids(spark, sf):
    """The orders' customers read as entities: those of several orders are there several times."""
    schema = EntitySchema(typed_id("entity_type", "Buyer"), "Buyer", (RelationField("status", STRING, True),))
    return duplicate_ids([EntityTable(schema, _table(spark, sf, "orders").select(_key("Customer", "o_custkey").alias("entity_id"), F.col("o_orderstatus").alias("status")))])


@_register("dup_fact_ids", f"SELECT {_sql_id('fact', '(l_orderkey || ' + chr(39) + '/' + chr(39) + ' || l_linenumber)')} AS fact_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_fact_ids(spark, sf):
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return duplicates(_table(spark, sf, "lineitem").select(typed_id_column("fact", key).alias("fact_id")), "fact_id")


@_register("dup_edges", f"SELECT {_sql_key('Order', 'l_orderkey')} AS source, {_sql_key('Part', 'l_partkey')} AS target, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_edges(spark, sf):
    return duplicates(relation_rows(spark, sf, "CONTAINS").rows, "source", "target")


@_register("dangling_endpoints", f"SELECT DISTINCT {_sql_key('Part', 'l_partkey')} AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11')")
def dangling_endpoints(spark, sf):
    """Parts of one brand are left out, so the edges to them dangle."""
    part = entity_rows(spark, sf, "Part")
    kept = EntityTable(part.schema, part.rows.where("brand <> 'Brand#11'"))
    return find_dangling([entity_rows(spark, sf, "Order"), kept], [relation_rows(spark, sf, "CONTAINS")])


@_register("null_required_property", "SELECT count(*) AS rows_0, count(*) FILTER (p_brand = 'Brand#11') AS required_nulls FROM part")
def null_required_property(spark, sf):
    """What validation counts of parts whose brand is required and sometimes null."""
    schema = EntitySchema(typed_id("entity_type", "Branded"), "Branded", (RelationField("brand", STRING, False),))
    rows = _table(spark, sf, "part").select(_key("Part", "p_partkey").alias("entity_id"), F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("brand"))
    return input_facts([EntityTable(schema, rows)], []).select("rows_0", "required_nulls")


@_register("join_bound", "SELECT (SELECT count(*) FROM orders) AS placed, (SELECT count(*) FROM lineitem) AS contains, (SELECT count(*) FROM orders) * (SELECT count(*) FROM lineitem) AS bound")
def join_bound(spark, sf):
    kinds, names = _FLAGSHIP
    counts = validate_tables([entity_rows(spark, sf, k) for k in kinds], [relation_rows(spark, sf, n) for n in names], budgets.UNBOUNDED)
    sizes = [counts[RELATION_SCHEMAS[n].id] for n in names]
    return spark.createDataFrame([(*sizes, budgets.join_bound(sizes, 3, budgets.UNBOUNDED))], "placed long, contains long, bound long")


_ID_BYTES = len(typed_id("entity", "x"))


@_register(
    "input_totals",
    f"SELECT (SELECT count(*) FROM customer) AS rows_0, (SELECT count(*) FROM part) AS rows_1, (SELECT count(*) FROM orders) AS rows_2, CAST((SELECT sum({_ID_BYTES} + strlen(c_name) + strlen(c_mktsegment)) FROM customer) "
    f"+ (SELECT sum({_ID_BYTES} + strlen(p_name) + strlen(p_brand) + strlen(p_type)) FROM part) + (SELECT 2 * {_ID_BYTES} * count(*) FROM orders) AS BIGINT) AS value_bytes, 0 AS null_ids, 0 AS bad_ids, 1 AS most_times",
)
def input_totals(spark, sf):
    found = input_facts([entity_rows(spark, sf, k) for k in ("Customer", "Part")], [relation_rows(spark, sf, "PLACED")])
    return found.select("rows_0", "rows_1", "rows_2", "value_bytes", "null_ids", "bad_ids", "most_times")


@_register("content_hash", "SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS length FROM pages")
def content_hash_query(spark, sf):
    return _table(spark, sf, "pages").select("page_id", content_hash(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("length"))


@_register("row_reconcile", "SELECT o_orderstatus AS name, count(*) + 1 AS declared, count(*) AS found FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def row_reconcile(spark, sf):
    """Batches per status and priority; all but one status declare a row too many."""
    orders = _table(spark, sf, "orders")
    batches = orders.groupBy(F.col("o_orderstatus").alias("name"), "o_orderpriority").agg(F.count(F.lit(1)).alias("rows"))
    declared = orders.groupBy(F.col("o_orderstatus").alias("name")).agg((F.count(F.lit(1)) + F.when(F.first("o_orderstatus") == "P", 0).otherwise(1)).alias("rows"))
    return closure.reconcile_rows(batches, declared)


def _cids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.sha2(F.col(column), 256).alias("cid"))


@_register("closure_refs", "SELECT sha256(r_name) AS cid FROM region UNION SELECT sha256(n_name) FROM nation UNION SELECT sha256(p_brand) FROM part")
def closure_refs(spark, sf):
    t = lambda name, c: _cids(_table(spark, sf, name), c)
    return closure.referenced(t("region", "r_name"), t("nation", "n_name"), t("part", "p_brand"))


@_register("closure_missing", "SELECT DISTINCT sha256(p_brand) AS cid FROM part WHERE p_brand = 'Brand#11'")
def closure_missing(spark, sf):
    """A store that lost the blocks of one brand."""
    part = _table(spark, sf, "part")
    return closure.missing_blocks(_cids(part, "p_brand").distinct(), _cids(part.where("p_brand <> 'Brand#11'"), "p_brand").distinct())


@_register("corrupt_blocks", "SELECT sha256(html) AS cid FROM pages WHERE page_id % 7 = 0 OR page_id % 11 = 0")
def corrupt_blocks(spark, sf):
    """Every seventh block has another digest than it should, every eleventh another length."""
    pages = _table(spark, sf, "pages")
    blocks = pages.select(
        F.sha2("html", 256).alias("cid"), F.when(F.col("page_id") % 7 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("digest"),
        (F.octet_length("html") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).alias("length"), F.col("html").cast("binary").alias("bytes"),
    )
    return closure.corrupt_blocks(blocks)


# orders as outbox records: open ones wait to be synced; each protects its own block, its customer's and its priority's
_RECORDS_SQL = "r AS (SELECT 'o/' || o_orderkey AS root, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'synced' END AS state, o_orderkey % 100 AS protected_until, ['o/' || o_orderkey, 'c/' || o_custkey, 'p/' || o_orderpriority] AS blocks FROM orders)"


def _records(spark, sf) -> DataFrame:
    text = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    return _table(spark, sf, "orders").select(
        text("o", "o_orderkey").alias("root"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("synced").alias("state"),
        (F.col("o_orderkey") % 100).alias("protected_until"), F.array(text("o", "o_orderkey"), text("c", "o_custkey"), text("p", "o_orderpriority")).alias("blocks"),
    )


@_register("outbox_pending", f"WITH {_RECORDS_SQL} SELECT root FROM r WHERE state = 'pending' ORDER BY root LIMIT 16")
def outbox_pending(spark, sf):
    """The first batch of a replay; its size is the feature."""
    return closure.pending(_records(spark, sf), 16).select("root")


@_register(
    "outbox_gc",
    f"WITH {_RECORDS_SQL}, e AS (SELECT state = 'synced' AND protected_until <= 50 AS done, unnest(blocks) AS cid FROM r) "
    "SELECT DISTINCT cid FROM e WHERE done AND cid NOT IN (SELECT cid FROM e WHERE NOT done)",
)
def outbox_gc(spark, sf):
    return closure.collectable(_records(spark, sf), 50)


@_register("outbox_capacity", "SELECT (SELECT CAST(sum(strlen(html)) AS BIGINT) FROM pages WHERE page_id % 2 = 0) AS held_bytes, (SELECT CAST(sum(strlen(html)) AS BIGINT) FROM pages WHERE page_id % 2 = 1 AND page_id % 3 = 0) AS new_bytes")
def outbox_capacity(spark, sf):
    blocks = _table(spark, sf, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("cid"), F.octet_length("html").cast("long").alias("length"))
    return closure.capacity(blocks.where("page_id % 2 = 0"), blocks.where("page_id % 3 = 0"))


@_register(
    "transfer_ledger",
    "SELECT user_id AS session, event_id AS seq, charged, CAST(sum(charged) OVER w AS BIGINT) AS total, coalesce(sum(charged) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + reserved <= 2000 AS admitted "
    "FROM (SELECT user_id, event_id, 100 + event_id % 7 AS reserved, CASE WHEN event_id % 5 = 0 THEN 100 + event_id % 7 ELSE event_id % 90 END AS charged FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def transfer_ledger(spark, sf):
    """Events stand for remote operations: each user is a session, every fifth operation fails."""
    operations = _table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.lit(100) + F.col("event_id") % 7).alias("reserved"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 90).alias("actual"),
    )
    return closure.ledger(operations, 2000)

"""Graph datasets: Parquet vertices, edges and adjacency offsets in chunks, with a description, published by one rename.

Vertices and offsets lie in folders by chunk of the vertex id, edges in folders by chunk of the source id,
sorted by source and destination id, so reading one vertex's edges opens one folder. A vertex with very
many edges spreads over several files of its folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidTable, RelationMismatch, ResourceLimit
from ..operators.graph import EDGE_PROPERTIES, GraphProjection, adjacency, check_dense, check_edges, facts_from_edges, index_edges, resolve_edges, vertex_index
from .scratch import folder

CHUNK = 1 << 18
EDGES_PER_FILE = 1 << 22
_EDGES = "chunk long, source_id long, destination_id long, " + ", ".join(f"{p} string" for p in EDGE_PROPERTIES)


@dataclass(frozen=True)
class GraphSource:
    """What a query engine needs to register a dataset, whatever its database."""

    root: str
    relation: str
    predicate: str
    source_column: str
    target_column: str
    vertices: int
    edges: int
    chunk: int = CHUNK

    def metadata(self) -> bytes:
        body = {k: v for k, v in vars(self).items() if k != "root"}
        return json.dumps({"format": "quillgraph-graph", "version": 1, **body}, sort_keys=True).encode()


def _chunk(column: str, size: int):
    return F.floor(F.col(column) / size).cast("long")


def write_graph(path: str, projection: GraphProjection, edges: DataFrame, chunk: int = CHUNK) -> GraphSource:
    """Write vertices by dense id, edges with their properties, and offsets; an existing ``path`` is refused."""
    spark = edges.sparkSession
    jvm = spark.sparkContext._jvm
    target, fs = folder(spark, path)
    if fs.exists(target):
        raise InvalidTable(f"{path} exists")
    count = check_edges(projection, edges)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    vertices = vertex_index(edges).withColumn("chunk", _chunk("vertex_id", chunk))
    vertices.repartitionByRange("vertex_id").sortWithinPartitions("vertex_id").write.partitionBy("chunk").parquet(f"{staged}/vertices")
    kept = spark.read.schema("entity_id string, vertex_id long, chunk long").parquet(f"{staged}/vertices")
    indexed = index_edges(edges, kept.select("entity_id", "vertex_id")).select("source_id", "destination_id", *EDGE_PROPERTIES).withColumn("chunk", _chunk("source_id", chunk))
    ordered = indexed.repartitionByRange("source_id", "destination_id").sortWithinPartitions("source_id", "destination_id")
    ordered.write.option("maxRecordsPerFile", EDGES_PER_FILE).partitionBy("chunk").parquet(f"{staged}/edges")
    written = spark.read.schema(_EDGES).parquet(f"{staged}/edges")
    offsets = adjacency(kept, written, chunk)
    offsets.repartitionByRange("vertex_id").sortWithinPartitions("vertex_id").write.partitionBy("chunk").parquet(f"{staged}/offsets")
    fields = projection.relation.fields
    made = GraphSource(path, projection.relation.id, projection.relation.predicate, fields[0].name, fields[1].name, kept.count(), count, chunk)
    stream = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staged}/graph.json"), False)
    stream.write(bytearray(made.metadata()))
    stream.close()
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        raise InvalidTable(f"{path} exists")
    return made


def read_metadata(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(f"{path}/graph.json").first()["content"])


class PreparedGraph:
    """A graph dataset read and checked once; its facts can then be admitted again and again."""

    def __init__(self, spark: SparkSession, path: str, projection: GraphProjection, max_vertices: int, max_edges: int):
        described = json.loads(read_metadata(spark, path))
        if described["relation"] != projection.relation.id or described["predicate"] != projection.relation.predicate:
            raise RelationMismatch(described["predicate"])
        vertices = spark.read.schema("entity_id string, vertex_id long, chunk long").parquet(f"{path}/vertices").select("entity_id", "vertex_id")
        edges = spark.read.schema(_EDGES).parquet(f"{path}/edges").select("source_id", "destination_id", *EDGE_PROPERTIES)
        if vertices.count() > max_vertices or edges.count() > max_edges:  # from the files' footers
            raise ResourceLimit("vertices or edges")
        # two jobs check all of it; the second leaves the joined edges behind for every later read
        self.edges = resolve_edges(edges, vertices).persist()
        if (check_dense(vertices), check_edges(projection, self.edges)) != (described["vertices"], described["edges"]):
            self.close()
            raise InvalidTable("not as many vertices and edges as described")
        self.facts = facts_from_edges(projection, self.edges)
        self.source = GraphSource(path, described["relation"], described["predicate"], described["source_column"], described["target_column"], described["vertices"], described["edges"], described["chunk"])

    def admit(self, projection: GraphProjection) -> DataFrame:
        """The facts, if they belong to ``projection``; storage is not read again."""
        if projection.relation.id != self.source.relation:
            raise RelationMismatch(projection.relation.predicate)
        return self.facts

    def register(self, name: str) -> None:
        self.edges.createOrReplaceTempView(name)

    def close(self) -> None:
        self.edges.unpersist()


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vertex_id long, offset long, degree long, chunk long").parquet(f"{path}/offsets")


def partition_neighbours(spark: SparkSession, path: str, vertex: int) -> DataFrame:
    """The edges out of one vertex by dense id; only its chunk's folder is opened and the condition reaches the scan."""
    size = json.loads(read_metadata(spark, path))["chunk"]
    return spark.read.schema(_EDGES).parquet(f"{path}/edges").where((F.col("chunk") == vertex // size) & (F.col("source_id") == vertex)).drop("chunk")

"""The static-edge client: protect, publish, sync and query plain plan edges, with checked receipts.

Everything runs in the caller's session; a request is bounded JSON, and a receipt is bound to it by hash.
"""

from __future__ import annotations

import hashlib
import json
import sys
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .catalog import EntityCatalog, RelationCatalog, Revision, SemanticSnapshot
from .errors import ContentError, InvalidTable, QuillError, ResourceLimit, SchemaMismatch, TransferError
from .functions.cid import parse_cid
from .functions.ids import typed_id
from .operators.facts import check_static_edges
from .operators.paths import one_hop
from .operators.tables import EntityTable, RelationTable
from .plans.binding import Admission, ResultLimits, admit_rows
from .plans.ir import Edge, Endpoint, Node, Path, Projection, Query
from .sources.blocks import FileStore, Store, timed
from .sources.snapshot import PropertyInput, SnapshotLimits, materialize_snapshot, publish_snapshot, restore_snapshot, restored_tables
from .streaming.outbox import Outbox, Record, serve, sync_pending
from .types import ENTITY, STRING, EntitySchema, RelationField, RelationSchema

MAX_REQUEST = 1 << 20
MAX_EDGES = 1024
RECEIPT_KEYS = {"operation", "request_sha256", "root", "generation", "edges", "rows", "result_sha256"}
RESULT_LIMITS = ResultLimits(MAX_EDGES, 2 * MAX_EDGES)
#: Fixed value: seconds a request may take.
DEADLINE = 40.0

RUNTIME_NODE = EntitySchema(typed_id("entity_type", "RuntimeNode"), "RuntimeNode", (RelationField("name", STRING),))
STATIC_EDGE = RelationSchema(typed_id("relation", "StaticEdge"), "StaticEdge", (RelationField("source", ENTITY), RelationField("target", ENTITY)))
RELATIONS, ENTITIES = RelationCatalog([STATIC_EDGE]), EntityCatalog([RUNTIME_NODE])
_PATH = Path((Node("s", (RUNTIME_NODE.id,)), Node("t", (RUNTIME_NODE.id,))), (Edge((STATIC_EDGE.id,)),))
QUERY = Query((_PATH,), (Projection(Endpoint("s"), "source"), Projection(Endpoint("t"), "target")))


def plan_edges(plan: dict) -> list[tuple[str, str]]:
    """The unconditional edges of ``{"nodes": [...], "edges": [{"source", "target"}]}``."""
    nodes = {*plan["nodes"]}
    out = []
    for e in plan["edges"]:
        if {*e} != {"source", "target"}:
            raise InvalidTable("only unconditional edges are static")
        if not {e["source"], e["target"]} <= nodes:
            raise InvalidTable("an edge of an undeclared node")
        out.append((e["source"], e["target"]))
    if len(out) > MAX_EDGES:
        raise ResourceLimit("edges")
    return sorted(out)


def parse_request(raw: bytes) -> dict:
    if len(raw) > MAX_REQUEST:
        raise ResourceLimit("request bytes")
    try:
        d = json.loads(raw)
    except ValueError as e:
        raise SchemaMismatch(f"malformed request: {e}") from e
    if not isinstance(d, dict) or {*d} - {"operation", "source", "revision", "edges", "root", "protected_until"} or d.get("operation") not in ("protect", "publish", "sync", "query"):
        raise SchemaMismatch("unknown request fields or operation")
    return d


def check_receipt(receipt: dict, request: bytes) -> dict:
    """A receipt must have exactly its keys and belong to the request."""
    if {*receipt} != RECEIPT_KEYS or receipt["request_sha256"] != hashlib.sha256(request).hexdigest():
        raise SchemaMismatch("a receipt of something else")
    if receipt["root"] is not None:
        parse_cid(receipt["root"])
    if not isinstance(receipt["edges"], int) or any(len(r) != 2 for r in receipt["rows"]):
        raise SchemaMismatch("malformed receipt")
    return receipt


@dataclass
class StaticEdgeClient:
    spark: SparkSession
    local: FileStore
    remote: Store
    outbox: Outbox
    source: str
    capacity: int = 64 << 20
    deadline: float = DEADLINE
    limits: SnapshotLimits = field(default_factory=lambda: SnapshotLimits(max_rows=8 * MAX_EDGES, max_blocks=8))

    def _snapshot(self, revision: str) -> SemanticSnapshot:
        return SemanticSnapshot(typed_id("generation", f"{self.source}\n{revision}"), (Revision("static-edges", self.source, revision),))

    def _store(self, edges: list[tuple[str, str]], revision: str):
        rows = self.spark.createDataFrame(edges, "source string, target string").cache()
        check_static_edges(rows, MAX_EDGES)
        key = {n: typed_id("entity", json.dumps([self.source, n])) for e in edges for n in e}
        nodes = self.spark.createDataFrame(sorted((v, k) for k, v in key.items()), "entity_id string, name string")
        links = self.spark.createDataFrame(sorted((key[a], key[b]) for a, b in edges), "source string, target string")
        given = PropertyInput(RELATIONS, ENTITIES, self._snapshot(revision), [EntityTable(RUNTIME_NODE, nodes)], [RelationTable(STATIC_EDGE, links)])
        return materialize_snapshot(given, self.local, self.limits)

    def protect(self, edges: list[tuple[str, str]], revision: str, protected_until: int = 0):
        """Store a snapshot locally and note that it has to be synced."""
        root = self._store(edges, revision)
        blocks = tuple(str(c) for c in [*root.manifest.references(), root.cid])
        with self.outbox.locked():
            self.outbox.preflight(self.local, {c: n for c, n in root.manifest.children().items()}, self.capacity)
            self.outbox.commit(Record("static-edge-v1", str(root.cid), self.source, revision, root.manifest.snapshot.generation, protected_until, "pending", blocks))
        return root

    def publish(self, edges: list[tuple[str, str]], revision: str):
        root = self._store(edges, revision)
        publish_snapshot(self.local, self.remote, root, RELATIONS, ENTITIES, self.limits)
        return root

    def sync_pending(self, limit: int = 16) -> dict[str, str]:
        return sync_pending(self.outbox, self.local, self.remote, limit)

    def query(self, root: str, revision: str) -> list[tuple[str, str]]:
        """The edges of a stored snapshot by node name, sorted."""
        return list(self._admitted(root, revision).rows)

    def _admitted(self, root: str, revision: str) -> Admission:
        restored = restore_snapshot(self.local, self.remote, parse_cid(root), RELATIONS, ENTITIES, self.limits)
        if restored.root.manifest.snapshot.digest != self._snapshot(revision).digest:
            raise InvalidTable("a snapshot of another source or revision")
        entities, relations = restored_tables(self.spark, restored, RELATIONS, ENTITIES)
        rows = one_hop(QUERY, relations[0]).rows
        names = entities[0].rows
        named = rows.join(names.toDF("source", "a"), "source").join(names.toDF("target", "b"), "target")
        return admit_rows(named.select("a", "b").orderBy("a", "b"), ["a", "b"], RESULT_LIMITS)

    def query_tool(self, root: str, revision: str):
        """A tool of fixed scope: calling it with any argument is refused."""

        def tool(*args, **kwargs):
            if args or kwargs:
                raise InvalidTable("the tool takes no arguments")
            return self.query(root, revision)

        return tool

    def handle(self, raw: bytes) -> dict:
        """Run one request and return its receipt; a request that takes longer than ``deadline`` is given up
        and its Spark jobs are cancelled."""
        d, sc, group = parse_request(raw), self.spark.sparkContext, f"request-{uuid.uuid4().hex}"

        def run():
            sc.setJobGroup(group, d["operation"], True)
            return self._run(d, raw)

        try:
            return timed(run, self.deadline)
        except ContentError as e:
            if str(e) != "deadline":
                raise
            sc.cancelJobGroup(group)
            raise TransferError("the request's deadline has passed") from e

    def _run(self, d: dict, raw: bytes) -> dict:
        edges = sorted(tuple(e) for e in d.get("edges", []))
        root, rows, generation, digest = d.get("root"), [], None, None
        if d["operation"] == "sync":
            rows = sorted([k, v] for k, v in self.sync_pending().items())
        elif d["operation"] == "query":
            admitted = self._admitted(root, d["revision"])
            rows, digest = [list(r) for r in admitted.rows], admitted.digest
        else:
            made = self.protect(edges, d["revision"], d.get("protected_until", 0)) if d["operation"] == "protect" else self.publish(edges, d["revision"])
            root, generation = str(made.cid), made.manifest.snapshot.generation
        receipt = {"operation": d["operation"], "request_sha256": hashlib.sha256(raw).hexdigest(), "root": root, "generation": generation, "edges": len(edges), "rows": rows, "result_sha256": digest}
        return check_receipt(receipt, raw)


def main(argv: list[str], client: StaticEdgeClient, stdin=None, stdout=None) -> int:
    """No argument: one request from standard input. ``--sync-pending``: one replay. ``--serve``: replay for good."""
    stdin, stdout = stdin or sys.stdin.buffer, stdout or sys.stdout
    try:
        if argv == ["--sync-pending"]:
            print(json.dumps(client.sync_pending()), file=stdout)
        elif argv == ["--serve"]:
            serve(client.outbox, client.local, client.remote)
        elif argv:
            print("usage: [--sync-pending | --serve]", file=stdout)
            return 2
        else:
            print(json.dumps(client.handle(stdin.read(MAX_REQUEST + 1))), file=stdout)
        return 0
    except QuillError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e), "at": int(time.time())}), file=stdout)
        return 1

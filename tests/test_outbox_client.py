import io
import json

import pytest

from quillgraph import errors as E
from quillgraph.client import StaticEdgeClient, check_receipt, main, parse_request, plan_edges
from quillgraph.functions.cid import raw_cid
from quillgraph.operators import closure
from quillgraph.sources.blocks import FileStore, MemoryStore
from quillgraph.streaming.outbox import Outbox, Record, serve, sync_pending


def record(k, state="pending", until=0, extra=()):
    root = str(raw_cid(bytes([k])))
    return Record("p", root, "s", "r", "g", until, state, (root, *(str(raw_cid(bytes([x]))) for x in extra)))


def test_outbox_lifecycle(tmp_path, spark):
    box, store, remote = Outbox(tmp_path / "o"), FileStore(tmp_path / "s"), MemoryStore()
    for k in range(5):
        store.put(raw_cid(bytes([k])), bytes([k]))
    with box.locked():
        box.commit(record(0, extra=(1,)))
        box.commit(record(2, until=50, extra=(1, 3)))
        assert box.commit(record(2, until=10, extra=(3, 1))).protected_until == 50
        with pytest.raises(E.OutboxError):
            box.commit(record(2, extra=(4,)))
    assert len(box.pending(1)) == 1 and len(box.pending_roots()) == 2 and list(box.pending_roots()) == sorted(box.pending_roots())
    assert [r["root"] for r in closure.pending(box.frame(spark), 5).collect()] == list(box.pending_roots())
    with pytest.raises(E.ResourceLimit):
        box.preflight(store, {raw_cid(b"new"): 3}, 7)
    assert box.preflight(store, {raw_cid(b"new"): 3, raw_cid(b"\x00"): 1}, 8) == 8
    assert set(sync_pending(box, store, remote).values()) == {"synced"} and box.pending_roots() == ()
    assert raw_cid(b"\x03") in remote.blocks
    assert {r["cid"] for r in closure.collectable(box.frame(spark), 20).collect()} == {str(raw_cid(b"\x00"))}
    assert box.maintain(store, 20) == [raw_cid(b"\x00")] and len(box.records()) == 1
    assert box.maintain(store, 60) == sorted([raw_cid(b"\x01"), raw_cid(b"\x02"), raw_cid(b"\x03")]) and set(store.sizes()) == {raw_cid(b"\x04")}


def test_failures_stay_pending_and_claims_are_exclusive(tmp_path):
    box, store = Outbox(tmp_path / "o"), FileStore(tmp_path / "s")
    box.commit(record(7))
    assert "failed" in sync_pending(box, store, MemoryStore())[record(7).root] and box.pending_roots()
    store.put(raw_cid(b"\x07"), b"\x07")
    with box.claim(record(7).root) as mine:
        assert mine and sync_pending(box, store, MemoryStore()) == {record(7).root: "claimed elsewhere"}
    slept = []
    assert serve(box, store, MemoryStore(), 0.5, rounds=2, sleep=slept.append) == 1 and slept == [0.5]


def test_malformed_records(tmp_path):
    good = record(1)
    for bad in (b"{}", b"x", good.dump() + b" " * 4096, good.dump().replace(b"pending", b"lost"), good.dump().replace(b'"profile"', b'"prophet"')):
        with pytest.raises(E.OutboxError):
            Record.parse(bad, good.root)
    with pytest.raises(E.OutboxError):
        Record.parse(good.dump(), record(2).root)
    with pytest.raises(E.OutboxError):
        Outbox(tmp_path).mark_synced(good.root, "s", "r")


@pytest.fixture
def client(tmp_path, spark):
    return StaticEdgeClient(spark, FileStore(tmp_path / "l"), MemoryStore(), Outbox(tmp_path / "o"), "plan")


EDGES = [("bake", "cool"), ("knead", "bake"), ("knead", "shape"), ("shape", "bake")]


def test_client(client):
    root = client.protect(EDGES, "r1")
    assert client.outbox.pending_roots() == (str(root.cid),) and not client.remote.blocks
    assert client.query(str(root.cid), "r1") == EDGES
    assert client.sync_pending() == {str(root.cid): "synced"} and root.cid in client.remote.blocks
    assert client.publish(EDGES[::-1], "r1").cid == root.cid
    with pytest.raises(E.InvalidTable):
        client.query(str(root.cid), "r2")
    tool = client.query_tool(str(root.cid), "r1")
    assert tool() == EDGES
    with pytest.raises(E.InvalidTable):
        tool(scope="other")


def test_requests_and_receipts(client):
    raw = json.dumps({"operation": "protect", "revision": "r", "edges": EDGES}).encode()
    out = io.StringIO()
    assert main([], client, io.BytesIO(raw), out) == 0
    receipt = json.loads(out.getvalue())
    assert check_receipt(receipt, raw)["edges"] == 4
    for bad in (receipt | {"x": 1}, receipt | {"request_sha256": "0"}, receipt | {"rows": [[1]]}):
        with pytest.raises(E.SchemaMismatch):
            check_receipt(bad, raw)
    query = json.dumps({"operation": "query", "revision": "r", "root": receipt["root"]}).encode()
    assert client.handle(query)["rows"] == [list(e) for e in EDGES]
    assert main(["--sync-pending"], client, stdout=io.StringIO()) == 0 and main(["--what"], client, stdout=io.StringIO()) == 2
    out = io.StringIO()
    assert main([], client, io.BytesIO(b"{"), out) == 1 and json.loads(out.getvalue())["error"] == "SchemaMismatch"
    for bad in (b"[]", b'{"operation": "drop"}', b'{"operation": "sync", "x": 1}'):
        with pytest.raises(E.SchemaMismatch):
            parse_request(bad)
    with pytest.raises(E.ResourceLimit):
        parse_request(b" " * ((1 << 20) + 1))


def test_plan_edges():
    edge = lambda a, b, **k: {"source": a, "target": b, **k}
    assert plan_edges({"nodes": ["a", "b"], "edges": [edge("b", "a"), edge("a", "b")]}) == [("a", "b"), ("b", "a")]
    for bad in ([edge("a", "z")], [edge("a", "b", when="x")]):
        with pytest.raises(E.InvalidTable):
            plan_edges({"nodes": ["a", "b"], "edges": bad})
    with pytest.raises(E.ResourceLimit):
        plan_edges({"nodes": ["a", "b"], "edges": [edge("a", "b")] * 1025})


def test_a_hung_request_is_given_up(client, monkeypatch):
    raw = json.dumps({"operation": "sync"}).encode()
    client.deadline = 0.2
    monkeypatch.setattr(client, "sync_pending", lambda: __import__("threading").Event().wait(5))
    with pytest.raises(E.TransferError, match="deadline"):
        client.handle(raw)
    client.deadline = 40.0
    monkeypatch.undo()
    assert client.handle(raw)["rows"] == [] and client.handle(raw)["result_sha256"] is None

import os
import threading
import time
from dataclasses import replace

import pyarrow as pa
import pytest

import graph_fixture as G
from quillgraph import errors as E
from quillgraph.functions.cbor import Link, decode, encode
from quillgraph.functions.cid import Cid, cbor_cid, parse_cid, raw_cid
from quillgraph.operators import closure
from quillgraph.operators.tables import EntityTable
from quillgraph.sources import arrow_ipc as ipc
from quillgraph.sources.blocks import BlockingStore, CacheStore, FileStore, MemoryStore, RemoteStore, block_table, read_through
from quillgraph.sources.car import encode_archive, import_archive
from quillgraph.sources.manifest import Batch, Manifest, TableDescriptor, snapshot_block, verify_closure
from quillgraph.sources.snapshot import PropertyInput, SnapshotLimits, materialize_snapshot, publish_snapshot, query_source, restore_snapshot
from quillgraph.sources.transfer import TransferLimits, TransferSession

WANTED = pa.schema([pa.field("a", pa.string(), False), pa.field("b", pa.list_(pa.field("item", pa.int64())), True)], metadata={"k": "v"})
TABLE = pa.table({"a": ["x", "y"], "b": [[1, None], None]}, schema=WANTED)


def given(spark, **kw):
    return PropertyInput(G.RELATIONS, G.ENTITIES, G.SNAPSHOT, *G.tables(spark, **kw))


def test_encoding_is_canonical():
    value = {"b": [1, -5, 2**40, True, None], "aa": {"x": b"\x00", "y": "é"}, "l": Link(raw_cid(b"x").binary)}
    raw = encode(value)
    assert decode(raw) == value and encode(decode(raw)) == raw
    assert encode({"b": 1, "a": 2, "aa": 3}) == encode({"aa": 3, "a": 2, "b": 1})
    for bad in (raw + b"\x00", raw[:-1], b"\x18\x05", b"\x5f\xff", b"\xa2\x61b\x01\x61a\x01", b"\xd8\x2a\x41\x01", b"\x61\xff", b""):
        with pytest.raises(E.ManifestError):
            decode(bad)


def test_identifiers():
    cid = raw_cid(b"hello")
    assert str(cid) == "bafkreibm6jg3ux5qumhcn2b3flc3tyu6dmlb4xa7u5bf44yegnrjhc4yeq" and parse_cid(str(cid)) == cid and cid.holds(b"hello")
    assert cbor_cid(b"hello") != cid and cbor_cid(b"hello").digest == cid.digest
    for bad in ("", "b" * 59, str(cid)[:-1], str(cid).upper()):
        with pytest.raises(E.ContentError):
            parse_cid(bad)


def test_ipc_file():
    data = ipc.write_file(TABLE)
    assert data == ipc.write_file(TABLE) and ipc.read_file(data, WANTED).equals(TABLE)
    for bad in (b"not Arrow IPC", data[:-7], data[:40], data[: len(data) // 2] + data[-10:]):
        with pytest.raises(E.SchemaMismatch):
            ipc.read_file(bad, WANTED)
    with pytest.raises(E.SchemaMismatch):
        ipc.read_file(data, WANTED.remove_metadata())
    for limits in (ipc.IpcLimits(max_bytes=10), ipc.IpcLimits(max_rows=1), ipc.IpcLimits(max_values=3)):
        with pytest.raises(E.ResourceLimit):
            ipc.read_file(data, WANTED, limits)
    with pytest.raises(E.SchemaMismatch):
        ipc.read_file(data, WANTED, ipc.IpcLimits(max_depth=1))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, WANTED) as w:
        w.write_table(TABLE)
        w.write_table(TABLE)
    with pytest.raises(E.SchemaMismatch, match="one batch"):
        ipc.read_file(sink.getvalue().to_pybytes(), WANTED)


@pytest.mark.parametrize("new", [pa.ipc.new_file, pa.ipc.new_stream])
def test_ipc_refuses_compression_and_dictionaries(new):
    read = ipc.read_file if new is pa.ipc.new_file else ipc.read_stream
    table = pa.table({"a": ["x" * 100] * 10})
    for t, options in ((table, pa.ipc.IpcWriteOptions(compression="lz4")), (pa.table({"a": table["a"].dictionary_encode()}), None)):
        sink = pa.BufferOutputStream()
        with new(sink, t.schema, options=options) as w:
            w.write_table(t)
        with pytest.raises(E.SchemaMismatch):
            read(sink.getvalue().to_pybytes(), t.schema)


def test_ipc_stream():
    data = ipc.write_stream(TABLE)
    assert ipc.read_stream(data, WANTED, rows=2).equals(TABLE)
    for bad in (data[:-3], data + b"x", data[:50], b""):
        with pytest.raises(E.SchemaMismatch):
            ipc.read_stream(bad, WANTED)
    with pytest.raises(E.SchemaMismatch):
        ipc.read_stream(data, WANTED, rows=1)
    with pytest.raises(E.ResourceLimit):
        ipc.read_stream(data, WANTED, memory=16)
    assert ipc.concat([], WANTED).num_rows == 0 and ipc.concat([TABLE, TABLE], WANTED).num_rows == 4
    with pytest.raises(E.SchemaMismatch):
        ipc.concat([TABLE.replace_schema_metadata(None)], WANTED)


def test_every_flipped_byte_is_refused_or_harmless():
    data = ipc.write_stream(TABLE)
    for i in range(0, len(data), 7):
        broken = data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :]
        try:
            ipc.read_stream(broken, WANTED)
        except E.QuillError:
            pass


def test_spark_crossing(spark):
    rows = ipc.to_spark(spark, TABLE)
    assert ipc.from_spark(rows.orderBy("a"), WANTED).equals(TABLE, check_metadata=True)


def test_file_store(tmp_path, spark):
    store, cid = FileStore(tmp_path / "s"), raw_cid(b"data")
    with pytest.raises(E.NotFound):
        store.get(cid, 10)
    store.put(cid, b"data")
    store.put(cid, b"data")
    assert store.get(cid, 4) == b"data" and store.sizes() == {cid: 4} and os.listdir(tmp_path / "s") == [str(cid)]
    with pytest.raises(E.ResourceLimit):
        store.get(cid, 3)
    with pytest.raises(E.ContentError):
        store.put(cid, b"other")
    row = block_table(spark, str(tmp_path / "s")).first()
    assert (row["cid"], row["length"], row["digest"]) == (str(cid), 4, cid.digest.hex())
    store.path(cid).write_bytes(b"hurt")
    with pytest.raises(E.ContentError):
        store.get(cid, 10)


def test_cache_quota(tmp_path):
    store = CacheStore(tmp_path, 10)
    for k in range(4):
        store.put(raw_cid(bytes([k]) * 4), bytes([k]) * 4)
        os.utime(store.path(raw_cid(bytes([k]) * 4)), (k, k))
    assert store.maintain() == 8 and set(store.sizes()) == {raw_cid(bytes([k]) * 4) for k in (2, 3)}


def test_remote_store(tmp_path, spark):
    remote, cid = RemoteStore(spark, f"file://{tmp_path}"), raw_cid(b"\x00\xffdata")
    with pytest.raises(E.NotFound):
        remote.get(cid, 10)
    remote.put(cid, b"\x00\xffdata")
    remote.put(cid, b"\x00\xffdata")
    assert remote.get(cid, 10) == b"\x00\xffdata"
    with pytest.raises(E.ResourceLimit):
        remote.get(cid, 3)


def test_read_through():
    local, remote, cid = MemoryStore(), MemoryStore(), raw_cid(b"x")
    remote.put(cid, b"x")
    assert read_through(local, remote, cid, 9) == (b"x", "remote") and read_through(local, remote, cid, 9) == (b"x", "local")
    with pytest.raises(E.NotFound):
        read_through(MemoryStore(), None, cid, 9)

    class Full(MemoryStore):
        def put(self, cid, data):
            raise OSError("full")

    assert read_through(Full(), remote, cid, 9) == (b"x", "remote-uncached")
    local.blocks[cid] = b"bad"
    with pytest.raises(E.ContentError):  # damage is not absence
        read_through(local, remote, cid, 9)


def test_blocking_store_runs_one_job_at_a_time():
    busy, most = [0], [0]

    class Slow(MemoryStore):
        def put(self, cid, data):
            busy[0] += 1
            most[0] = max(most[0], busy[0])
            threading.Event().wait(0.01)
            busy[0] -= 1

    store = BlockingStore(Slow())
    threads = [threading.Thread(target=store.put, args=(raw_cid(b"x"), b"x")) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] == 1


def test_manifest(spark):
    local = MemoryStore()
    root = materialize_snapshot(given(spark), local)
    again = Manifest.decode(root.data)
    assert again == root.manifest and again.version == 2 and len(again.references()) == 5
    blocks = {c: local.get(c, 1 << 20) for c in again.references()}
    verify_closure(again, blocks)
    for broken in ({c: b for c, b in list(blocks.items())[1:]}, blocks | {next(iter(blocks)): b"x"}):
        with pytest.raises(E.ManifestError):
            verify_closure(again, broken)
    d = decode(root.data)
    for bad in (d | {"extra": 1}, d | {"version": 1}, d | {"digest": "x"}, {k: v for k, v in d.items() if k != "lineage"}, d | {"relations": d["relations"][::-1]}):
        with pytest.raises(E.ManifestError):
            Manifest.decode(encode(bad))
    with pytest.raises(E.ManifestError):
        TableDescriptor("t", 3, (Batch(raw_cid(b"x"), 2, 1),))
    with pytest.raises(E.ManifestError):
        replace(root.manifest, relations=root.manifest.relations[:1] * 2)
    with pytest.raises(E.ManifestError):
        replace(root.manifest, coverage="most")
    with pytest.raises(E.ManifestError):
        root.manifest.check_declared(5, 1 << 20)


def test_row_order_does_not_change_the_root(spark):
    one = materialize_snapshot(given(spark), MemoryStore())
    flipped = {k: v[::-1] for k, v in G.ENTITY_ROWS.items()}, {k: v[::-1] for k, v in G.EDGE_ROWS.items()}
    assert materialize_snapshot(given(spark, entity_rows=flipped[0], edge_rows=flipped[1]), MemoryStore()).cid == one.cid
    assert materialize_snapshot(given(spark, entity_rows={G.SHELF: [("h1", "A1", "1"), ("h2", "B7", None)]}), MemoryStore()).cid != one.cid


def test_producer_budgets(spark):
    for limits in (SnapshotLimits(max_rows=5), SnapshotLimits(max_blocks=3), SnapshotLimits(max_block_bytes=100), SnapshotLimits(max_bytes=200), SnapshotLimits(max_value_bytes=10)):
        store = MemoryStore()
        with pytest.raises(E.ResourceLimit):
            materialize_snapshot(given(spark), store, limits)
        assert not store.blocks
    full = given(spark)
    with pytest.raises(E.CatalogMismatch):
        materialize_snapshot(replace(full, entity_tables=full.entity_tables[:2]), MemoryStore())


def test_text_to_rows_cold_and_warm(spark):
    local, remote, mine = MemoryStore(), MemoryStore(), MemoryStore()
    root = materialize_snapshot(given(spark), local)
    assert publish_snapshot(local, remote, root, G.RELATIONS, G.ENTITIES) == 6
    run = lambda store, far: [tuple(r) for r in query_source(spark, G.SOURCE, None, root.cid, G.RELATIONS, G.ENTITIES, G.SNAPSHOT, store, far, G.LIMITS).rows.collect()]
    assert run(mine, remote) == G.EXPECTED and run(mine, None) == G.EXPECTED
    with pytest.raises(E.NotFound):
        run(MemoryStore(), None)

    class Untouched:
        def get(self, cid, most):
            raise AssertionError("read before the text was checked")

    with pytest.raises(E.ParseError):
        query_source(spark, G.SOURCE, "0" * 64, root.cid, G.RELATIONS, G.ENTITIES, G.SNAPSHOT, Untouched(), Untouched(), G.LIMITS)
    with pytest.raises(E.ManifestError):
        restore_snapshot(mine, None, root.cid, G.RELATIONS, type(G.ENTITIES)([]))
    with pytest.raises(E.ResourceLimit):
        restore_snapshot(mine, None, root.cid, G.RELATIONS, G.ENTITIES, SnapshotLimits(max_bytes=1000))
    with pytest.raises(E.BindingError):
        query_source(spark, G.SOURCE, None, root.cid, G.RELATIONS, G.ENTITIES, replace(G.SNAPSHOT, generation="g2"), mine, None, G.LIMITS)


def test_publish_checks_everything_first(spark):
    local, remote = MemoryStore(), MemoryStore()
    root = materialize_snapshot(given(spark), local)
    del local.blocks[root.manifest.references()[-1]]
    with pytest.raises(E.NotFound):
        publish_snapshot(local, remote, root, G.RELATIONS, G.ENTITIES)
    assert not remote.blocks


def test_child_variants(spark):
    """Wrong bytes, wrong row counts, nullable ids and compression under a consistent manifest."""
    store = MemoryStore()
    root = materialize_snapshot(given(spark), store)
    shelves = next(t for t in root.manifest.entities if t.id == G.SHELF.id)
    data = store.get(shelves.batches[0].cid, 1 << 20)
    table = pa.ipc.open_stream(data).read_all()
    loose = table.cast(pa.schema([f.with_nullable(True) for f in table.schema], metadata=table.schema.metadata))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    for child, rows in ((b"not Arrow IPC", 2), (data, 1), (ipc.write_stream(loose), 2), (sink.getvalue().to_pybytes(), 2)):
        changed = replace(shelves, rows=rows, batches=(Batch(raw_cid(child), rows, len(child)),))
        made = snapshot_block(replace(root.manifest, entities=tuple(changed if t == shelves else t for t in root.manifest.entities)))
        store.put(raw_cid(child), child)
        store.put(made.cid, made.data)
        with pytest.raises(E.QuillError):
            query_source(spark, G.SOURCE, None, made.cid, G.RELATIONS, G.ENTITIES, G.SNAPSHOT, store, None, G.LIMITS)


def test_archive(spark):
    store, other = MemoryStore(), MemoryStore()
    root = materialize_snapshot(given(spark), store)
    blocks = {c: store.get(c, 1 << 20) for c in root.manifest.references()}
    data = encode_archive(root, blocks, {raw_cid(b"more"): b"more"})
    assert import_archive(data, G.RELATIONS, G.ENTITIES, other).cid == root.cid and len(other.blocks) == 7
    for bad in (data[:-1], data[:30], data[:200] + b"\x00" + data[201:], b""):
        empty = MemoryStore()
        with pytest.raises(E.QuillError):
            import_archive(bad, G.RELATIONS, G.ENTITIES, empty)
        assert not empty.blocks
    with pytest.raises(E.ResourceLimit):
        import_archive(data, G.RELATIONS, G.ENTITIES, other, max_blocks=3)
    with pytest.raises(E.ManifestError):
        import_archive(data, type(G.RELATIONS)([]), G.ENTITIES, MemoryStore())
    with pytest.raises(E.ContentError):
        encode_archive(root, blocks, {Cid(0x71, b"\x00" * 32): b""})


def test_transfer_ledger(spark):
    clock = [0.0]
    store, cid = MemoryStore(), raw_cid(b"12345")
    store.put(cid, b"12345")
    session = TransferSession(store, TransferLimits(100, 9, 210, 30), clock=lambda: clock[0])
    assert session.get(cid, 1000) == b"12345" and session.stats == {"operations": 1, "bytes": 5}
    with pytest.raises(E.NotFound):
        session.get(raw_cid(b"none"), 100)
    assert session.stats == {"operations": 2, "bytes": 105}  # a failure keeps its reservation
    session.get(cid, 100)
    with pytest.raises(E.TransferError, match="bytes"):
        session.put(raw_cid(b"x" * 100), b"x" * 100) or session.get(cid, 100) or session.get(cid, 100)
    clock[0] = 31
    with pytest.raises(E.TransferError, match="deadline"):
        session.get(cid, 1)
    session.cancel()
    with pytest.raises(E.TransferError, match="cancelled"):
        session.get(cid, 1)
    rows = spark.createDataFrame([("s", 1, 100, 5), ("s", 2, 100, None), ("s", 3, 100, 5)], "session string, seq long, reserved long, actual long")
    assert [tuple(r)[2:] for r in closure.ledger(rows, 200).orderBy("seq").collect()] == [(5, 5, True), (100, 105, True), (5, 110, False)]


def test_entity_rows_need_not_be_collected_by_order(spark):
    """A table with a null in a required property is refused."""
    strict = type(G.BOOK)(G.BOOK.id, "Book", tuple(replace(p, nullable=False) for p in G.BOOK.properties))
    source = given(spark)
    tables = [EntityTable(strict, t.rows) if t.schema is G.BOOK else t for t in source.entity_tables]
    with pytest.raises(E.InvalidTable, match="required"):
        materialize_snapshot(replace(source, entity_tables=tables, entities=type(G.ENTITIES)([t.schema for t in tables])), MemoryStore())


def test_sizes_are_refused_before_a_value_is_decoded(monkeypatch):
    """Frames and declared lengths are enough: neither reader is opened."""
    table = pa.table({"a": ["x" * 10] * 500, "b": [[1, 2, 3]] * 500}, schema=WANTED)
    for write, read in ((ipc.write_file, ipc.read_file), (ipc.write_stream, ipc.read_stream)):
        data = write(table)
        with monkeypatch.context() as m:
            for opened in ("open_file", "open_stream", "read_message"):
                m.setattr(pa.ipc, opened, lambda *_: pytest.fail("decoded before its size was checked"))
            for limits in (ipc.IpcLimits(max_rows=499), ipc.IpcLimits(max_values=2_499), ipc.IpcLimits(max_bytes=len(data) - 1)):
                with pytest.raises(E.ResourceLimit):
                    read(data, WANTED, limits)
            for k in range(0, len(data) - 1, 61):
                with pytest.raises((E.SchemaMismatch, pytest.fail.Exception)):
                    read(data[:k], WANTED)
        assert read(data, WANTED, ipc.IpcLimits(max_rows=500, max_values=2_500)).equals(table)


def test_preflight_is_one_walk():
    many = pa.table({"a": ["x"] * 20_000, "b": [None] * 20_000}, schema=WANTED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WANTED) as w:
        w.write_table(many, max_chunksize=1)
    data = sink.getvalue().to_pybytes()
    began = time.perf_counter()
    assert len(ipc.frames(data)) == 20_001 and time.perf_counter() - began < 10


def test_calls_end_for_their_caller():
    going, ended = threading.Event(), threading.Event()

    class Hung(MemoryStore):
        def get(self, cid, most):
            going.wait(20)
            ended.set()
            return b"late"

    store = BlockingStore(Hung(), seconds=0.2)
    with pytest.raises(E.ContentError, match="deadline"):
        store.get(raw_cid(b"x"), 9)
    with pytest.raises(E.ContentError, match="deadline"):  # the first job still holds the permit
        store.get(raw_cid(b"x"), 9)
    assert not ended.is_set()
    going.set()
    assert ended.wait(10) and store.get(raw_cid(b"x"), 9) == b"late"


def test_remote_deadline_cap_and_race(tmp_path, spark, monkeypatch):
    remote, cid = RemoteStore(spark, f"file://{tmp_path}", deadline=0.2), raw_cid(b"data")
    monkeypatch.setattr(remote, "_read", lambda *_: threading.Event().wait(5))
    with pytest.raises(E.ContentError, match="deadline"):
        remote.get(cid, 10)
    remote = RemoteStore(spark, f"file://{tmp_path}")
    failures = []

    def put():
        try:
            remote.put(cid, b"data")
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=put) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and remote.get(cid, 4) == b"data" and [p for p in os.listdir(tmp_path / "blocks") if not p.endswith(".crc")] == [str(cid)]
    (tmp_path / "blocks" / str(cid)).write_bytes(b"x" * (1 << 20))
    (tmp_path / "blocks" / f".{cid}.crc").unlink(missing_ok=True)
    assert len(remote._read(cid, 100)) == 101  # whatever is there, one byte more than may be read tells
    with pytest.raises(E.ResourceLimit):
        remote.get(cid, 100)
    with pytest.raises(E.QuillError):
        remote.put(cid, b"data")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from quillgraph.sources.scratch import shared_dir

    nothing = N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True)))
    context = lambda **conf: N(sparkContext=N(getConf=lambda: conf, master="spark://head:7077", _jsc=nothing))
    assert shared_dir(context(**{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(context())

"""A small durable outbox: snapshots that still have to reach the remote store, and their replay.

Records are JSON files named by their root, replaced atomically. A pending record is replayed in bounded
batches; what fails stays pending. Blocks are collected once no record that is pending or still
protected keeps them. The replay is a timer over a handful of files, not a stream of events, so it is
a plain loop.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import OutboxError, QuillError, ResourceLimit
from ..functions.cid import Cid, parse_cid
from ..sources.blocks import FileStore, Store

MAX_RECORDS, MAX_RECORD_BYTES, MAX_BLOCKS = 4096, 4096, 8
RECORD_SCHEMA = "profile string, root string, source string, revision string, generation string, protected_until long, state string, blocks array<string>"


@dataclass(frozen=True)
class Record:
    profile: str
    root: str
    source: str
    revision: str
    generation: str
    protected_until: int
    state: str
    blocks: tuple[str, ...]

    def __post_init__(self):
        if self.state not in ("pending", "synced"):
            raise OutboxError(f"state {self.state!r}")
        if not 0 < len(self.blocks) <= MAX_BLOCKS or len({*self.blocks}) != len(self.blocks) or self.root not in self.blocks:
            raise OutboxError("blocks must be few, distinct and hold the root")
        if not isinstance(self.protected_until, int) or self.protected_until < 0:
            raise OutboxError("protection deadline")
        for c in self.blocks:
            parse_cid(c)

    @staticmethod
    def parse(raw: bytes, root: str) -> "Record":
        if len(raw) > MAX_RECORD_BYTES:
            raise OutboxError("record too large")
        try:
            d = json.loads(raw)
            if not isinstance(d, dict) or {*d} != {*Record.__dataclass_fields__}:
                raise OutboxError("unknown or missing record fields")
            made = Record(**{**d, "blocks": tuple(d["blocks"])})
        except (ValueError, TypeError) as e:
            raise OutboxError(f"malformed record: {e}") from e
        if made.root != root:
            raise OutboxError("a record under another root's name")
        return made

    def dump(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()


class Outbox:
    """Use ``with outbox.locked():`` around reads that lead to writes."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        (self.path / "records").mkdir(parents=True, exist_ok=True)
        (self.path / "claims").mkdir(exist_ok=True)

    @contextlib.contextmanager
    def locked(self):
        with (self.path / "lock").open("w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield self

    def records(self) -> list[Record]:
        """All records, by root."""
        files = sorted(p for p in (self.path / "records").iterdir() if not p.name.startswith("."))
        if len(files) > MAX_RECORDS:
            raise OutboxError("too many records")
        return [Record.parse(p.read_bytes(), p.name) for p in files]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(r) | {"blocks": list(r.blocks)} for r in self.records()], RECORD_SCHEMA)

    def pending(self, limit: int) -> list[Record]:
        return [r for r in self.records() if r.state == "pending"][:limit]

    def pending_roots(self) -> tuple[str, ...]:
        return tuple(r.root for r in self.records() if r.state == "pending")

    def _write(self, record: Record) -> None:
        fd, name = tempfile.mkstemp(dir=self.path / "records", prefix=".")
        with os.fdopen(fd, "wb") as f:
            f.write(record.dump())
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, self.path / "records" / record.root)

    def commit(self, record: Record) -> Record:
        """Add a record; one that is there must be the same snapshot, and keeps the later protection."""
        old = next((r for r in self.records() if r.root == record.root), None)
        if old:
            if (old.profile, old.source, old.revision, old.generation, {*old.blocks}) != (record.profile, record.source, record.revision, record.generation, {*record.blocks}):
                raise OutboxError("the record of this root is of something else")
            record = replace(record, protected_until=max(old.protected_until, record.protected_until), state=old.state)
        elif len(self.records()) >= MAX_RECORDS:
            raise OutboxError("too many records")
        self._write(record)
        return record

    def mark_synced(self, root: str, source: str, revision: str) -> None:
        old = next((r for r in self.records() if r.root == root), None)
        if old is None or (old.source, old.revision) != (source, revision):
            raise OutboxError("no such record")
        self._write(replace(old, state="synced"))

    def preflight(self, store: FileStore, incoming: dict[Cid, int], most: int) -> int:
        """Bytes held and new ones together, against the capacity."""
        held = store.sizes()
        total = sum(held.values()) + sum(n for c, n in incoming.items() if c not in held)
        if total > most:
            raise ResourceLimit("outbox capacity")
        return total

    def maintain(self, store: FileStore, now: int) -> list[Cid]:
        """Remove records that are synced and past protection, and the blocks that only they kept."""
        records = self.records()
        done = [r for r in records if r.state == "synced" and r.protected_until <= now]
        kept = {c for r in records if r not in done for c in r.blocks}
        gone = sorted({parse_cid(c) for r in done for c in r.blocks if c not in kept})
        for c in gone:
            store.remove(c)
        for r in done:
            (self.path / "records" / r.root).unlink(missing_ok=True)
        return gone

    @contextlib.contextmanager
    def claim(self, root: str):
        """True while this process holds the claim on the root's shard; False at once if another does."""
        with (self.path / "claims" / root[-2:]).open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                yield False
                return
            yield True


def sync_pending(outbox: Outbox, local: Store, remote: Store, limit: int = 16, most: int = 16 << 20) -> dict[str, str]:
    """Replay one batch: each record's blocks, its root last. What fails is reported and stays pending."""
    with outbox.locked():
        batch = outbox.pending(limit)
    out = {}
    for r in batch:
        with outbox.claim(r.root) as mine:
            if not mine:
                out[r.root] = "claimed elsewhere"
                continue
            try:
                for c in sorted(c for c in r.blocks if c != r.root) + [r.root]:
                    remote.put(parse_cid(c), local.get(parse_cid(c), most))
                with outbox.locked():
                    outbox.mark_synced(r.root, r.source, r.revision)
                out[r.root] = "synced"
            except (QuillError, OSError) as e:
                out[r.root] = f"failed: {e}"
    return out


def serve(outbox: Outbox, local: Store, remote: Store, pause: float = 5.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Replay again and again; returns how many records were synced after ``rounds``."""
    done = k = 0
    while rounds is None or k < rounds:
        done += sum(v == "synced" for v in sync_pending(outbox, local, remote).values())
        k += 1
        if rounds is None or k < rounds:
            sleep(pause)
    return done

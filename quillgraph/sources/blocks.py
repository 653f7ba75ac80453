"""Block stores: bytes by content identifier, verified on every read."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from pathlib import Path
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContentError, NotFound, ResourceLimit
from ..functions.cid import Cid, parse_cid


class Store(Protocol):
    def get(self, cid: Cid, most: int) -> bytes: ...

    def put(self, cid: Cid, data: bytes) -> None: ...


def _verified(cid: Cid, data: bytes, most: int) -> bytes:
    if len(data) > most:
        raise ResourceLimit(f"{cid} has more than {most} bytes")
    if not cid.holds(data):
        raise ContentError(f"{cid} has other bytes")
    return data


class MemoryStore:
    def __init__(self):
        self.blocks: dict[Cid, bytes] = {}

    def get(self, cid: Cid, most: int) -> bytes:
        if cid not in self.blocks:
            raise NotFound(str(cid))
        return _verified(cid, self.blocks[cid], most)

    def put(self, cid: Cid, data: bytes) -> None:
        _verified(cid, data, len(data))
        self.blocks.setdefault(cid, data)


class FileStore:
    """One file per block; written beside its place and linked there, so readers see all of it or nothing."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def path(self, cid: Cid) -> Path:
        return self.root / str(cid)

    def get(self, cid: Cid, most: int) -> bytes:
        try:
            with self.path(cid).open("rb") as f:
                data = f.read(most + 1)
        except FileNotFoundError as e:
            raise NotFound(str(cid)) from e
        return _verified(cid, data, most)

    def put(self, cid: Cid, data: bytes) -> None:
        _verified(cid, data, len(data))
        if self.path(cid).exists():
            self.get(cid, len(data))
            return
        fd, name = tempfile.mkstemp(dir=self.root, prefix=".put-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(name, self.path(cid))
            except FileExistsError:
                self.get(cid, len(data))
        finally:
            os.unlink(name)

    def sizes(self) -> dict[Cid, int]:
        return {parse_cid(p.name): p.stat().st_size for p in self.root.iterdir() if not p.name.startswith(".")}

    def remove(self, cid: Cid) -> None:
        self.path(cid).unlink(missing_ok=True)


class CacheStore(FileStore):
    """A file store with a soft quota: ``maintain`` drops the blocks longest unused until it fits."""

    def __init__(self, root: str | Path, quota: int):
        super().__init__(root)
        self.quota = quota

    def get(self, cid: Cid, most: int) -> bytes:
        data = super().get(cid, most)
        os.utime(self.path(cid))
        return data

    def maintain(self) -> int:
        found = sorted((p.stat().st_mtime, p.stat().st_size, p) for p in self.root.iterdir() if not p.name.startswith("."))
        total, freed = sum(s for _, s, _ in found), 0
        for _, size, path in found:
            if total - freed <= self.quota:
                break
            path.unlink(missing_ok=True)
            freed += size
        return freed


def timed(call, seconds: float | None, after=lambda: None):
    """What ``call`` returns, on a thread of its own, or an error once ``seconds`` have passed. A call cannot
    be stopped: it goes on unheard, and ``after`` runs only when it has really ended."""
    done, out = threading.Event(), {}

    def work():
        try:
            out["value"] = call()
        except BaseException as e:  # handed to the caller
            out["error"] = e
        finally:
            after()
            done.set()

    threading.Thread(target=work, daemon=True).start()
    if not done.wait(seconds):
        raise ContentError("deadline")
    if "error" in out:
        raise out["error"]
    return out["value"]


#: Schemes of stores where an object appears whole when its writer closes, and a create can be conditional.
_OBJECT_STORES = ("s3a", "s3", "gs", "abfs", "abfss", "oss", "cosn")


class RemoteStore:
    """Blocks under ``blocks/<cid>`` of any Hadoop file system (object stores included).

    Every call ends within ``deadline`` seconds for its caller. A read takes at most one byte more than it
    may, whatever length the store lists. A block is created only where none is: object stores are asked
    for a conditional create, other file systems for a rename that does not replace.
    """

    def __init__(self, spark: SparkSession, root: str, deadline: float = 10.0):
        self.root, self.deadline, self._spark = root.rstrip("/"), deadline, spark

    def _open(self, cid: Cid):
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/blocks/{cid}")
        return jvm, path, path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, cid: Cid, most: int) -> bytes:
        return _verified(cid, timed(lambda: self._read(cid, most), self.deadline), most)

    def _read(self, cid: Cid, most: int) -> bytes:
        jvm, path, fs = self._open(cid)
        if not fs.exists(path):
            raise NotFound(str(cid))
        stream = fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most + 1)))
        finally:
            stream.close()

    def put(self, cid: Cid, data: bytes) -> None:
        _verified(cid, data, len(data))
        if not timed(lambda: self._create(cid, data), self.deadline):
            self.get(cid, len(data))  # somebody's block is there: it must be this one

    def _create(self, cid: Cid, data: bytes) -> bool:
        jvm, path, fs = self._open(cid)
        if fs.exists(path):
            return False
        if path.toUri().getScheme() in _OBJECT_STORES:
            stream = fs.createFile(path).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
            return self._fill(jvm, stream, data)
        part = jvm.org.apache.hadoop.fs.Path(f"{self.root}/blocks/.{cid}-{uuid.uuid4().hex}")
        self._fill(jvm, fs.create(part, False), data)
        try:
            none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
            options = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._spark.sparkContext._jsc.hadoopConfiguration()).rename(part, path, options)
            return True
        except Py4JJavaError as e:
            fs.delete(part, False)
            if not fs.exists(path):
                raise ContentError(f"{cid} could not be created") from e
            return False

    @staticmethod
    def _fill(jvm, stream, data: bytes) -> bool:
        """Write and close; False if a conditional create lost to another writer."""
        try:
            stream.write(bytearray(data))
            stream.close()
            return True
        except Py4JJavaError as e:
            jvm.org.apache.hadoop.io.IOUtils.closeStream(stream)
            if "FileAlreadyExists" in str(e.java_exception) or "PreconditionFailed" in str(e.java_exception):
                return False
            raise ContentError(str(e.java_exception)) from e


class BlockingStore:
    """At most one job of a store at a time, from whichever threads. A caller may stop waiting after
    ``seconds``; the job keeps the permit until it has really ended."""

    def __init__(self, store: Store, seconds: float | None = None):
        self.store, self.seconds, self._permit = store, seconds, threading.Semaphore(1)

    def _run(self, call):
        if not self._permit.acquire(timeout=self.seconds):
            raise ContentError("deadline")
        return timed(call, self.seconds, self._permit.release)

    def get(self, cid: Cid, most: int) -> bytes:
        return self._run(lambda: self.store.get(cid, most))

    def put(self, cid: Cid, data: bytes) -> None:
        self._run(lambda: self.store.put(cid, data))


def read_through(local: Store, remote: Store | None, cid: Cid, most: int) -> tuple[bytes, str]:
    """Verified bytes and where they came from. Only an exact absence goes to the remote store; a failed
    write to the local one does not lose the bytes."""
    try:
        return local.get(cid, most), "local"
    except NotFound:
        if remote is None:
            raise
    data = remote.get(cid, most)
    try:
        local.put(cid, data)
    except (ContentError, OSError):
        return data, "remote-uncached"
    return data, "remote"


def block_table(spark: SparkSession, root: str) -> DataFrame:
    """(cid, length, digest) of all block files below ``root``, hashed by executors; for bulk verification."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("cid"), "length", F.sha2("content", 256).alias("digest"))

"""Transfer sessions: bytes and operations are reserved before each call and settled after it."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from ..errors import TransferError
from ..functions.cid import Cid


@dataclass(frozen=True)
class TransferLimits:
    max_block_bytes: int = 16 << 20
    max_operations: int = 32
    max_bytes: int = 32 << 20
    seconds: float = 30.0


class TransferSession:
    """A remote store behind a budget: one call in flight, refunds for what a success did not use,
    none for a failure."""

    def __init__(self, store, limits: TransferLimits = TransferLimits(), clock=time.monotonic):
        self.store, self.limits, self.clock = store, limits, clock
        self.began, self.bytes, self.operations, self.cancelled = clock(), 0, 0, False
        self._one = threading.Lock()

    def cancel(self) -> None:
        self.cancelled = True

    @property
    def stats(self) -> dict:
        return {"operations": self.operations, "bytes": self.bytes}

    def _run(self, reserve: int, call):
        if not self._one.acquire(blocking=False):
            raise TransferError("one operation at a time")
        try:
            if self.cancelled:
                raise TransferError("cancelled")
            if self.clock() - self.began > self.limits.seconds:
                raise TransferError("deadline")
            if self.operations + 1 > self.limits.max_operations:
                raise TransferError("operations")
            if self.bytes + reserve > self.limits.max_bytes:
                raise TransferError("bytes")
            self.operations += 1
            self.bytes += reserve
            value, used = call()
            self.bytes -= reserve - used
            if self.clock() - self.began > self.limits.seconds:
                raise TransferError("deadline")
            return value
        finally:
            self._one.release()

    def get(self, cid: Cid, most: int) -> bytes:
        most = min(most, self.limits.max_block_bytes)

        def call():
            data = self.store.get(cid, most)
            return data, len(data)

        return self._run(most, call)

    def put(self, cid: Cid, data: bytes) -> None:
        if len(data) > self.limits.max_block_bytes:
            raise TransferError("block bytes")
        self._run(len(data), lambda: (self.store.put(cid, data), len(data)))

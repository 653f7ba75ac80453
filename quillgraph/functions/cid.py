"""Content identifiers: version 1, SHA-256, with the codec as part of the identity."""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ContentError
from .cbor import Link

#: Public codec numbers.
RAW, DAG_CBOR = 0x55, 0x71


@dataclass(frozen=True, order=True)
class Cid:
    codec: int
    digest: bytes

    @property
    def binary(self) -> bytes:
        return bytes([1, self.codec, 0x12, 0x20]) + self.digest

    def __str__(self) -> str:
        return "b" + base64.b32encode(self.binary).decode().lower().rstrip("=")

    @property
    def link(self) -> Link:
        return Link(self.binary)

    def holds(self, data: bytes) -> bool:
        return hashlib.sha256(data).digest() == self.digest


def cid_of(codec: int, data: bytes) -> Cid:
    return Cid(codec, hashlib.sha256(data).digest())


def raw_cid(data: bytes) -> Cid:
    return cid_of(RAW, data)


def cbor_cid(data: bytes) -> Cid:
    return cid_of(DAG_CBOR, data)


def from_binary(raw: bytes) -> Cid:
    if len(raw) != 36 or raw[0] != 1 or raw[1] not in (RAW, DAG_CBOR) or raw[2:4] != b"\x12\x20":
        raise ContentError("not an accepted content identifier")
    return Cid(raw[1], raw[4:])


def parse_cid(text: str) -> Cid:
    if not re.fullmatch("b[a-z2-7]{58}", text or ""):
        raise ContentError(f"{text!r} is no content identifier")
    cid = from_binary(base64.b32decode(text[1:].upper() + "=" * (-len(text[1:]) % 8)))
    if str(cid) != text:
        raise ContentError(f"{text!r} is not in canonical form")
    return cid


def content_hash(data: Column) -> Column:
    """SHA-256 in hex of a binary or string column, the digest inside a block's identifier."""
    return F.sha2(data, 256)

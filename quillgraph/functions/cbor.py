"""Canonical binary encoding of maps, lists, text, bytes, integers, booleans, null and content links.

The encoding is the deterministic subset used for content-addressed data: shortest heads, map keys in
order of length then bytes, links as tag 42 over a zero byte and the binary identifier. Decoding accepts
only what encoding would write.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ManifestError


@dataclass(frozen=True)
class Link:
    """A content identifier in binary form."""

    raw: bytes


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * width):
            return bytes([major << 5 | code]) + n.to_bytes(width, "big")
    raise ManifestError("integer out of range")


def encode(value) -> bytes:
    if value is None:
        return b"\xf6"
    if value is True or value is False:
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, Link):
        return _head(6, 42) + encode(b"\x00" + value.raw)
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: (len(k.encode()), k.encode()))
        return _head(5, len(keys)) + b"".join(encode(k) + encode(value[k]) for k in keys)
    raise ManifestError(f"a {type(value).__name__} has no encoding")


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ManifestError("truncated")
        self.at += n
        return self.raw[self.at - n : self.at]

    def value(self, depth: int = 0):
        if depth > 64:
            raise ManifestError("nested too deep")
        first = self.take(1)[0]
        major, code = first >> 5, first & 31
        if major == 7:
            simple = {20: False, 21: True, 22: None}
            if code not in simple:
                raise ManifestError("unknown simple value")
            return simple[code]
        if code < 24:
            n = code
        elif code <= 27:
            n = int.from_bytes(self.take(1 << (code - 24)), "big")
        else:
            raise ManifestError("indefinite lengths are not accepted")
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major == 2:
            return self.take(n)
        if major == 3:
            return self.take(n).decode()
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)]
        if major == 5:
            out = {}
            for _ in range(n):
                key = self.value(depth + 1)
                if not isinstance(key, str) or key in out:
                    raise ManifestError("map keys must be distinct text")
                out[key] = self.value(depth + 1)
            return out
        inner = self.value(depth + 1)
        if n != 42 or not isinstance(inner, bytes) or inner[:1] != b"\x00":
            raise ManifestError("unknown tag")
        return Link(inner[1:])


def decode(raw: bytes):
    """The value of canonical bytes; any other bytes are refused."""
    reader = _Reader(raw)
    try:
        value = reader.value()
    except UnicodeDecodeError as e:
        raise ManifestError("text is not UTF-8") from e
    if reader.at != len(raw) or encode(value) != raw:
        raise ManifestError("not in canonical form")
    return value

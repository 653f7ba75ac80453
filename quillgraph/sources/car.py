"""Single-file archives of a snapshot: a header that names the root, then length-prefixed blocks."""

from __future__ import annotations

from ..catalog import EntityCatalog, RelationCatalog
from ..errors import ContentError, ManifestError, ResourceLimit
from ..functions.cbor import Link, decode, encode
from ..functions.cid import RAW, Cid, from_binary
from .blocks import Store
from .manifest import Manifest, SnapshotBlock, verify_closure


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    for i in range(at, min(len(data), at + 9)):
        value |= (data[i] & 127) << shift
        shift += 7
        if data[i] < 128:
            if data[i] == 0 and i > at:
                raise ContentError("a length is not minimal")
            return value, i + 1
    raise ContentError("truncated length")


def encode_archive(root: SnapshotBlock, blocks: dict[Cid, bytes], extra: dict[Cid, bytes] | None = None) -> bytes:
    """The root, its closure in order, then any further raw blocks in the order given."""
    verify_closure(root.manifest, blocks)
    if any(c.codec != RAW or not c.holds(b) for c, b in (extra or {}).items()):
        raise ContentError("extra blocks must be raw and whole")
    parts = {root.cid: root.data, **{c: blocks[c] for c in root.manifest.references()}, **(extra or {})}
    header = encode({"roots": [Link(root.cid.binary)], "version": 1})
    return _varint(len(header)) + header + b"".join(_varint(36 + len(b)) + c.binary + b for c, b in parts.items())


def _frames(data: bytes, max_blocks: int, max_block_bytes: int) -> tuple[Cid, list[tuple[Cid, int, int]]]:
    size, at = _read_varint(data, 0)
    if at + size > len(data):
        raise ContentError("truncated header")
    header = decode(data[at : at + size])
    if not isinstance(header, dict) or {*header} != {"roots", "version"} or header["version"] != 1 or len(header["roots"]) != 1:
        raise ContentError("exactly one root of version 1 is accepted")
    root, at, out = from_binary(header["roots"][0].raw), at + size, []
    while at < len(data):
        size, at = _read_varint(data, at)
        if size < 36 or at + size > len(data):
            raise ContentError("truncated block")
        if size - 36 > max_block_bytes or len(out) >= max_blocks:
            raise ResourceLimit("blocks or block bytes")
        out.append((from_binary(data[at : at + 36]), at + 36, at + size))
        at += size
    return root, out


def import_archive(data: bytes, relations: RelationCatalog, entities: EntityCatalog, store: Store, max_bytes: int = 64 << 20, max_blocks: int = 1024, max_block_bytes: int = 16 << 20) -> SnapshotBlock:
    """Check frames, identities, closure and catalogs, then store children before the root."""
    if len(data) > max_bytes:
        raise ResourceLimit("archive bytes")
    root, found = _frames(data, max_blocks, max_block_bytes)
    blocks: dict[Cid, bytes] = {}
    for cid, a, b in found:
        if cid in blocks:
            raise ContentError(f"{cid} is there twice")
        if not cid.holds(data[a:b]):
            raise ContentError(f"{cid} has other bytes")
        blocks[cid] = data[a:b]
    if root not in blocks:
        raise ContentError("the root is missing")
    manifest = Manifest.decode(blocks[root])
    if extra := [c for c in {*blocks} - {root, *manifest.references()} if c.codec != RAW]:
        raise ManifestError(f"{extra[0]} is not part of the snapshot")
    verify_closure(manifest, blocks)
    manifest.verify_catalogs(relations, entities)
    for cid, block in blocks.items():
        if cid != root:
            store.put(cid, block)
    store.put(root, blocks[root])
    return SnapshotBlock(manifest, blocks[root], root)

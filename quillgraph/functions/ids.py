"""Typed identifiers: ``qg:<kind>:v1:<64 hex>``, the SHA-256 of a length-prefixed kind and key."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidIdentity

KINDS = ("entity", "entity_type", "relation", "fact", "generation", "rule", "rulepack", "derivation")


def typed_id(kind: str, key: str) -> str:
    raw = key.encode()
    return f"qg:{kind}:v1:{hashlib.sha256(f'{len(kind)}:{kind}:{len(raw)}:'.encode() + raw).hexdigest()}"


def typed_id_column(kind: str, key: Column) -> Column:
    """``typed_id`` of a string column; null for null."""
    text = F.concat(F.lit(f"{len(kind)}:{kind}:"), F.octet_length(key).cast("string"), F.lit(":"), key)
    return F.concat(F.lit(f"qg:{kind}:v1:"), F.sha2(text, 256))


def pattern(kind: str) -> str:
    return f"^qg:{kind}:v1:[0-9a-f]{{64}}$"


def parse_id(kind: str, text: str) -> str:
    if not re.fullmatch(pattern(kind)[1:-1], text or ""):
        raise InvalidIdentity(f"{text!r} is no {kind} id")
    return text


def is_id(column: Column, kind: str) -> Column:
    """True for well-formed ids of the kind, false for others and nulls."""
    return F.coalesce(column.rlike(pattern(kind)), F.lit(False))

"""Logical value types and schemas, and the Spark and Arrow types that carry them.

Text-like logical types (decimals, floats, dates, times, durations) stay lexical: they are carried as
strings with their parameters in the field's metadata, so no value is ever rounded on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

from .errors import SchemaMismatch

PREFIX = "__qg_"
NAMESPACE = "quillgraph:facts"
VERSION = "1"
MAX_DEPTH = 16
UNITS = ("s", "ms", "us", "ns")
ZONES = ("naive", "utc")


@dataclass(frozen=True)
class ValueType:
    """A logical type: its name, parameters and, for lists and records, what it holds."""

    kind: str
    params: tuple = ()
    element: "ValueType | None" = None
    element_nullable: bool = False
    fields: tuple["RelationField", ...] = ()

    @property
    def label(self) -> str:
        """What goes into a field's metadata."""
        return {"entity": "entity:typed-text-v1", "list": "list:v1", "record": "record:v1", "duration": "duration-lexical:v1", "bytes": "byte-string"}.get(self.kind) or ":".join(
            [self.kind if self.kind in ("boolean", "integer", "string") else f"{self.kind}-lexical", *map(str, self.params)]
        )

    def describe(self) -> dict:
        """A canonical description, nested parts included."""
        out: dict = {"type": self.label}
        if self.element:
            out |= {"element": self.element.describe(), "element_nullable": self.element_nullable}
        if self.kind == "record":
            out["fields"] = [f.describe() for f in self.fields]
        return out

    def depth(self) -> int:
        inner = [self.element.depth()] if self.element else [f.type.depth() for f in self.fields]
        return 1 + max(inner, default=0)

    def spark(self) -> T.DataType:
        if self.kind == "list":
            return T.ArrayType(self.element.spark(), self.element_nullable)
        if self.kind == "record":
            return T.StructType([f.spark() for f in self.fields])
        return {"boolean": T.BooleanType(), "integer": T.LongType(), "bytes": T.BinaryType()}.get(self.kind, T.StringType())

    def arrow(self) -> pa.DataType:
        if self.kind == "list":
            return pa.list_(pa.field("item", self.element.arrow(), self.element_nullable))
        if self.kind == "record":
            return pa.struct([f.arrow() for f in self.fields])
        return {"boolean": pa.bool_(), "integer": pa.int64(), "bytes": pa.binary()}.get(self.kind, pa.string())


@dataclass(frozen=True)
class RelationField:
    name: str
    type: ValueType
    nullable: bool = False

    def describe(self) -> dict:
        return {"name": self.name, "nullable": self.nullable, **self.type.describe()}

    def metadata(self) -> dict:
        return {"value-schema": self.type.label}

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark(), self.nullable, self.metadata())

    def arrow(self) -> pa.Field:
        return pa.field(self.name, self.type.arrow(), self.nullable, metadata=self.metadata())


ENTITY = ValueType("entity")
BOOLEAN = ValueType("boolean")
INTEGER = ValueType("integer")
STRING = ValueType("string")
BYTES = ValueType("bytes")
DATE = ValueType("date")
DURATION = ValueType("duration")


def decimal(precision: int, scale: int) -> ValueType:
    return ValueType("decimal", (precision, scale))


def floating(bits: int) -> ValueType:
    if bits not in (32, 64):
        raise SchemaMismatch(f"floats have 32 or 64 bits, not {bits}")
    return ValueType("float", (f"binary{bits}",))


def _clock(kind: str, unit: str, zone: str) -> ValueType:
    if unit not in UNITS or zone not in ZONES:
        raise SchemaMismatch(f"{kind} {unit} {zone}")
    return ValueType(kind, (unit, zone))


def time(unit: str, zone: str = "naive") -> ValueType:
    return _clock("time", unit, zone)


def timestamp(unit: str, zone: str = "naive") -> ValueType:
    return _clock("timestamp", unit, zone)


def list_of(element: ValueType, nullable: bool = False) -> ValueType:
    return ValueType("list", element=element, element_nullable=nullable)


def record(*fields: RelationField) -> ValueType:
    return ValueType("record", fields=tuple(fields))


def _distinct(names: list[str], what: str) -> None:
    if len({*names}) != len(names):
        raise SchemaMismatch(f"{what} repeats a name")


@dataclass(frozen=True)
class RelationSchema:
    """A typed n-ary relation; the order of fields is part of it."""

    id: str
    predicate: str
    fields: tuple[RelationField, ...]

    def __post_init__(self):
        _distinct([f.name for f in self.fields], f"relation {self.predicate}")
        if any(f.name.startswith(PREFIX) for f in self.fields):
            raise SchemaMismatch(f"names that start with {PREFIX} are reserved")
        if any(f.type.depth() > MAX_DEPTH for f in self.fields):
            raise SchemaMismatch(f"nested deeper than {MAX_DEPTH}")

    def describe(self) -> dict:
        return {"id": self.id, "predicate": self.predicate, "fields": [f.describe() for f in self.fields]}

    @property
    def is_binary(self) -> bool:
        """Exactly two non-null entity fields."""
        return len(self.fields) == 2 and all(f.type == ENTITY and not f.nullable for f in self.fields)


@dataclass(frozen=True)
class EntitySchema:
    """An entity type: its id column comes first, then its properties in order."""

    id: str
    label: str
    properties: tuple[RelationField, ...] = field(default=())

    def __post_init__(self):
        _distinct(["entity_id", *(p.name for p in self.properties)], f"entity {self.label}")

    def describe(self) -> dict:
        return {"id": self.id, "label": self.label, "properties": [p.describe() for p in self.properties]}

    @property
    def columns(self) -> list[str]:
        return ["entity_id", *(p.name for p in self.properties)]

"""Tables that queries run over: one entity type, or one binary relation, with its schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import EntitySchema, RelationSchema


def exact(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class EntityTable:
    """``entity_id`` first, then the schema's properties in order; all strings."""

    schema: EntitySchema
    rows: DataFrame


@dataclass(frozen=True)
class RelationTable:
    """Source and target columns, named and ordered as in the schema."""

    schema: RelationSchema
    rows: DataFrame

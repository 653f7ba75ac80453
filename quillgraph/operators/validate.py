"""Fail-closed checks of tables, as aggregates whose results the driver inspects.

A check that is only projected could be pruned away, so each one here is a job of its own or part of
one, and a violation raises. Counts are summed per task before they are shuffled; duplicates and dangling
endpoints are found by grouping and anti-joins, never by collecting identifiers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import EntityCatalog, RelationCatalog
from ..errors import CatalogMismatch, InvalidIdentity, InvalidRelationSchema, InvalidTable, ResourceLimit, UnsupportedShape
from ..functions.ids import is_id
from ..plans.limits import QueryLimits
from ..types import STRING, EntitySchema
from .tables import EntityTable, RelationTable, exact


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).take(1))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def carried_bytes(values, rows, columns: int):
    """Bytes a columnar table of strings takes: values, 4-byte offsets and validity bits."""
    return values + rows * (4 * columns) + (rows + 7) // 8 * columns


def check_columns(entities: list[EntityTable], relations: list[RelationTable]) -> None:
    for t in entities:
        if t.rows.columns != t.schema.columns:
            raise InvalidTable(f"{t.schema.label} has columns {t.rows.columns}, not {t.schema.columns}")
        for p in t.schema.properties:
            if p.type != STRING:
                raise UnsupportedShape("only string properties are supported")
    for t in relations:
        if not t.schema.is_binary:
            raise InvalidRelationSchema(t.schema.predicate)
        if t.rows.columns != [f.name for f in t.schema.fields]:
            raise InvalidTable(f"{t.schema.predicate} has columns {t.rows.columns}")
    for t in [*entities, *relations]:
        if any(kind != "string" for _, kind in t.rows.dtypes):
            raise InvalidTable("every column must be a string")


def check_catalogs(entities: list[EntityTable], relations: list[RelationTable], entity_digest: str, relation_digest: str) -> None:
    if EntityCatalog([t.schema for t in entities]).digest != entity_digest or RelationCatalog([t.schema for t in relations]).digest != relation_digest:
        raise CatalogMismatch("the tables are not those of the bound catalogs")


def id_uses(entities: list[EntityTable], relations: list[RelationTable]) -> DataFrame:
    """One row per identifier that any table has: how many entities have it (``times``), and what the rows
    that it heads add to the counts of their tables. A duplicate has more than one time, a dangling endpoint none.

    This one grouping is the whole of validation: ``input_facts`` sums it up.
    """
    flag = lambda c: c.cast("long")
    tables = [(t, ["entity_id"], [p.name for p in t.schema.properties if not p.nullable], 1) for t in entities] + [(t, t.rows.columns, [], 0) for t in relations]
    parts = []
    for i, (t, ids, required, k) in enumerate(tables):
        size = reduce(Column.__add__, [F.coalesce(F.octet_length(exact(c)), F.lit(0)).cast("long") for c in t.rows.columns])
        nulls = reduce(Column.__add__, [flag(exact(c).isNull()) for c in required], F.lit(0).cast("long"))
        counts = [F.lit(1).cast("long") if j == i else F.lit(0).cast("long") for j in range(len(tables))]
        for c in ids:  # a row of two endpoints is counted with its first
            head = c == ids[0]
            facts = [size, nulls, *counts] if head else [F.lit(0).cast("long")] * (2 + len(tables))
            bad = [flag(exact(c).isNull()) * k, flag(exact(c).isNull()) * (1 - k), flag(~is_id(exact(c), "entity") & exact(c).isNotNull())]
            named = zip(["value_bytes", "required_nulls", *[f"rows_{j}" for j in range(len(tables))]], facts)
            names = zip(["null_ids", "null_endpoints", "bad_ids"], bad)
            parts.append(t.rows.select(exact(c).alias("id"), F.lit(k).cast("long").alias("times"), *[x.cast("long").alias(n) for n, x in [*named, *names]]))
    every = reduce(DataFrame.union, parts)
    return every.groupBy("id").agg(*[F.sum(c).alias(c) for c in every.columns[1:]])


def input_facts(entities: list[EntityTable], relations: list[RelationTable]) -> DataFrame:
    """One row of what validation inspects: sums over all tables, rows of each, and the most and least times an identifier is one."""
    uses = id_uses(entities, relations)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in uses.columns[2:]]
    return uses.agg(*sums, F.coalesce(F.max("times"), F.lit(0)).alias("most_times"), F.coalesce(F.min("times"), F.lit(1)).alias("least_times"))


def duplicate_ids(entities: list[EntityTable]) -> DataFrame:
    """Identifiers that more than one entity has, with how many."""
    return id_uses(entities, []).where("times > 1").select("id", "times")


def dangling_endpoints(entities: list[EntityTable], relations: list[RelationTable]) -> DataFrame:
    """Endpoints that no entity has, each once."""
    return id_uses(entities, relations).where("times = 0").select("id")


def validate_tables(entities: list[EntityTable], relations: list[RelationTable], limits: QueryLimits, entity_digest: str | None = None, relation_digest: str | None = None) -> dict[str, int]:
    """Check everything a query relies on, in one job; returns the rows of every relation by its id.

    All supplied tables count, whether a query uses them or not.
    """
    limits.check_nonzero()
    check_columns(entities, relations)
    if entity_digest is not None:
        check_catalogs(entities, relations, entity_digest, relation_digest)
    tables = [*entities, *relations]
    if not tables:
        return {}
    found = input_facts(entities, relations).first()
    rows = [found[f"rows_{i}"] for i in range(len(tables))]
    overhead = sum(carried_bytes(0, n, len(t.rows.columns)) for n, t in zip(rows, tables))
    if sum(rows) > limits.max_input_rows or found["value_bytes"] + overhead > limits.max_input_bytes:
        raise ResourceLimit("input rows or bytes")
    for name, error in (
        ("null_ids", InvalidTable("null entity id")), ("null_endpoints", InvalidTable("null edge endpoint")),
        ("bad_ids", InvalidIdentity(f"{found['bad_ids']} malformed identifiers")), ("required_nulls", InvalidTable("null in a required property")),
    ):
        if found[name]:
            raise error
    if found["most_times"] > 1:
        raise InvalidTable("duplicate entity id")
    if found["least_times"] == 0:
        raise InvalidTable("dangling edge endpoint")
    return {t.schema.id: n for t, n in zip(relations, rows[len(entities) :])}


def check_table_set(supplied: set[str], declared: set[str]) -> None:
    """Tables must be exactly the catalog's, empty ones included."""
    if supplied != declared:
        raise CatalogMismatch(f"missing {sorted(declared - supplied)}, undeclared {sorted(supplied - declared)}")


def check_values(rows: DataFrame, schema: EntitySchema, max_value: int, max_total: int) -> int:
    """Longest value and sum of all values in bytes, against budgets; returns the sum."""
    sizes = [F.octet_length(exact(c)) for c in schema.columns]
    got = rows.agg(F.max(F.greatest(F.lit(0), *sizes)).alias("most"), reduce(Column.__add__, [F.coalesce(F.sum(s), F.lit(0)) for s in sizes]).alias("total")).first()
    if (got["most"] or 0) > max_value or (got["total"] or 0) > max_total:
        raise ResourceLimit("value bytes")
    return got["total"] or 0

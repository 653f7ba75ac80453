"""Facts: immutable typed rows with generation, authority, provenance, completeness and validity.

A fact table has six columns of context, then the relation's fields. Kinds of authority and provenance are
part of their typed identifiers. Validity is the absence of an invalidating fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidTable, SchemaMismatch
from ..functions.ids import is_id, typed_id_column
from ..types import NAMESPACE, PREFIX, VERSION, RelationField, RelationSchema
from .tables import exact
from .validate import duplicates, has_rows

CONTEXT = ("fact_id", "generation_id", "authority", "provenance", "completeness", "invalidated_by")
COLUMNS = tuple(PREFIX + c for c in CONTEXT)
COMPLETENESS = ("complete", "partial", "unknown")
AUTHORITIES = ("entity", "rule", "rulepack")
PROVENANCES = ("entity", "derivation")


def fact_schema(relation: RelationSchema) -> T.StructType:
    """The Spark schema of a relation's facts, logical types in field metadata."""
    context = [T.StructField(c, T.StringType(), c == COLUMNS[-1]) for c in COLUMNS]
    return T.StructType(context + [f.spark() for f in relation.fields])


def batch_metadata(relation: RelationSchema) -> dict[str, str]:
    return {"namespace": NAMESPACE, "version": VERSION, "relation": relation.id, "predicate": relation.predicate}


def _value(column: Column, field: RelationField) -> Column:
    """The field's value in its carried type; the children of a null record are null."""
    if field.type.kind == "record":
        made = F.struct(*[_value(column.getField(f.name), f).alias(f.name) for f in field.type.fields])
        return F.when(column.isNotNull(), made)
    if field.type.kind == "list":
        inner = RelationField("item", field.type.element, field.type.element_nullable)
        return F.transform(column, lambda x: _value(x, inner))
    return column.cast(field.type.spark())


def _missing(column: Column, field: RelationField) -> Column:
    """Whether a value breaks the field's nullability at any depth."""
    checks = [F.lit(False) if field.nullable else column.isNull()]
    if field.type.kind == "record":
        checks += [column.isNotNull() & _missing(column.getField(f.name), f) for f in field.type.fields]
    if field.type.kind == "list":
        inner = RelationField("item", field.type.element, field.type.element_nullable)
        checks.append(F.coalesce(F.exists(column, lambda x: _missing(x, inner)), F.lit(False)))
    return reduce(Column.__or__, checks)


def _context_ok():
    """Whether the shared part of a context parses; it depends on four columns only."""
    c = dict(zip(CONTEXT, (exact(x) for x in COLUMNS)))
    any_of = lambda column, kinds: reduce(Column.__or__, [is_id(column, k) for k in kinds])
    return is_id(c["generation_id"], "generation") & any_of(c["authority"], AUTHORITIES) & any_of(c["provenance"], PROVENANCES) & F.coalesce(c["completeness"].isin(*COMPLETENESS), F.lit(False))


def fact_checks(relation: RelationSchema, rows: DataFrame) -> DataFrame:
    """One row of what is checked of facts, from one grouping by the context and one by the fact id: rows, nulls
    in fields that take none, malformed contexts (each distinct one is parsed once), and the most of one fact id."""
    fact, undone = exact(COLUMNS[0]), exact(COLUMNS[5])
    missing = reduce(Column.__or__, [_missing(exact(f.name), f) for f in relation.fields], F.lit(False))
    own = is_id(fact, "fact") & (undone.isNull() | (is_id(undone, "fact") & (undone != fact)))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    shared = rows.groupBy(*[exact(c) for c in COLUMNS[1:5]]).agg(F.lit(1).alias("__one"))
    contexts = shared.agg(total((~_context_ok()).cast("long"), "contexts"))
    ids = rows.groupBy(fact.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(missing.cast("long")).alias("missing"), F.sum((~own).cast("long")).alias("own"))
    found = ids.agg(total("n", "n"), total("missing", "missing"), total("own", "own"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    nothing = F.lit(0).cast("long")
    one = found.select("n", "missing", "own", "most", nothing.alias("contexts")).union(contexts.select(nothing, nothing, nothing, nothing, "contexts"))
    return one.agg(*[F.sum(c).alias(c) for c in one.columns])


def encode_facts(relation: RelationSchema, facts: DataFrame) -> DataFrame:
    """A fact table from plainly named context columns (``fact_id`` ...) and the relation's fields."""
    absent = {*CONTEXT, *(f.name for f in relation.fields)} - {*facts.columns}
    if absent:
        raise SchemaMismatch(f"facts lack {sorted(absent)}")
    context = [exact(c).cast("string").alias(p) for c, p in zip(CONTEXT, COLUMNS)]
    values = [_value(exact(f.name), f).alias(f.name, metadata=f.metadata()) for f in relation.fields]
    return facts.select(*context, *values)


def check_facts(relation: RelationSchema, rows: DataFrame) -> int:
    """Validate a fact table and return its row count; any violation raises."""
    if rows.columns != [*COLUMNS, *(f.name for f in relation.fields)]:
        raise SchemaMismatch(f"columns {rows.columns}")
    if [f.dataType for f in rows.schema][len(COLUMNS) :] != [_any_null(f.type.spark()) for f in relation.fields] and [
        _any_null(f.dataType) for f in rows.schema
    ][len(COLUMNS) :] != [_any_null(f.type.spark()) for f in relation.fields]:
        raise SchemaMismatch("column types are not the relation's")
    got = fact_checks(relation, rows).first()
    if got["missing"]:
        raise SchemaMismatch("null in a field that takes none")
    if got["own"] or got["contexts"]:
        raise InvalidTable("malformed fact context")
    if got["most"] > 1:
        raise InvalidTable("duplicate fact id")
    return got["n"]


def _any_null(kind: T.DataType) -> T.DataType:
    """The type with nullability and metadata set aside; files keep neither."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_any_null(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _any_null(f.dataType), True) for f in kind])
    return kind


def decode_facts(relation: RelationSchema, rows: DataFrame) -> DataFrame:
    """Checked facts back under plain names, with explicit kinds of context."""
    check_facts(relation, rows)
    kind = lambda c: F.regexp_extract(exact(c), "^qg:([a-z]+):", 1)
    return rows.select(
        *[exact(p).alias(c) for c, p in zip(CONTEXT, COLUMNS)],
        kind(COLUMNS[2]).alias("authority_kind"), kind(COLUMNS[3]).alias("provenance_kind"),
        F.when(exact(COLUMNS[5]).isNull(), "valid").otherwise("invalidated").alias("validity"),
        *[exact(f.name) for f in relation.fields],
    )


def distinct_contexts(rows: DataFrame) -> DataFrame:
    """Each combination of generation, authority, provenance, completeness and validity once, with its facts' count."""
    return rows.groupBy(*COLUMNS[1:5], F.col(COLUMNS[5]).isNull().alias("valid")).agg(F.count(F.lit(1)).alias("facts"))


def derive_static_facts(edges: DataFrame, source: str, generation: str, authority: str, profile: str = "static-edge-v1") -> DataFrame:
    """Facts of plain (source, target) text edges: ids derive from profile, source and edge, or source and node."""
    key = lambda *parts: F.to_json(F.array(F.lit(profile), F.lit(source), *parts))
    return edges.select(
        typed_id_column("fact", key(F.col("source"), F.col("target"))).alias("fact_id"), F.lit(generation).alias("generation_id"),
        F.lit(authority).alias("authority"), typed_id_column("entity", F.lit(source)).alias("provenance"), F.lit("complete").alias("completeness"),
        F.lit(None).cast("string").alias("invalidated_by"), typed_id_column("entity", key(F.col("source"))).alias("source"), typed_id_column("entity", key(F.col("target"))).alias("target"),
    )


def check_static_edges(edges: DataFrame, most: int = 1024) -> None:
    """At most ``most`` distinct edges of 1 to 256 bytes per end, without control characters."""
    bad = lambda c: c.isNull() | (F.octet_length(c) < 1) | (F.octet_length(c) > 256) | c.rlike(r"[\x00-\x1f\x7f]")
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((bad(F.col("source")) | bad(F.col("target"))).cast("long")), F.lit(0)).alias("bad")).first()
    if got["n"] > most or got["bad"]:
        raise InvalidTable("too many edges, or malformed text")
    if has_rows(duplicates(edges, "source", "target")):
        raise InvalidTable("duplicate edge")


def check_static_facts(rows: DataFrame, context: dict[str, str]) -> None:
    """One exact context, unique fact ids and unique (source, target)."""
    same = reduce(Column.__and__, [F.col(PREFIX + k).eqNullSafe(F.lit(v)) for k, v in context.items()], F.lit(True))
    if has_rows(rows.where(~same)):
        raise InvalidTable("a fact of another context")
    if has_rows(duplicates(rows, COLUMNS[0])) or has_rows(duplicates(rows, "source", "target")):
        raise InvalidTable("duplicate fact or edge")

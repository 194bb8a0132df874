"""Field extraction from JSON held as VARIANT.

``variant_get`` alone coerces (``"5"`` becomes 5) and cannot tell a missing field from JSON null,
so every reader looks at the type of the field first.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reelfold.functions.guards import truncate, wrap_int

MISSING, NULL = "missing", "null"
STRING, NUMBER, BOOLEAN, OBJECT, ARRAY = "string", "number", "boolean", "object", "array"
INT, DOUBLE, LONG = "int", "double", "long"

# first word of ``schema_of_variant`` for every type JSON text can produce
_KINDS = {
    "VOID": NULL, "STRING": STRING, "BOOLEAN": BOOLEAN, "OBJECT": OBJECT, "ARRAY": ARRAY,
    "BIGINT": NUMBER, "DECIMAL": NUMBER, "DOUBLE": NUMBER, "FLOAT": NUMBER,
}
_WORDS = {
    INT: "BIGINT|DECIMAL|DOUBLE|FLOAT", LONG: "BIGINT|DECIMAL|DOUBLE|FLOAT",
    DOUBLE: "BIGINT|DECIMAL|DOUBLE|FLOAT", STRING: "STRING", OBJECT: "OBJECT", ARRAY: "ARRAY",
}
_SPARK_TYPE = {STRING: "string", DOUBLE: "double", OBJECT: "variant", ARRAY: "array<variant>"}


@dataclass(frozen=True)
class Extracted:
    """Value column, and the name to report when the field is wrong (null when it is right)."""

    value: Column
    error: Column


def _schema(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def kind(v: Column, path: str = "$") -> Column:
    """``missing``, ``null``, ``string``, ``number``, ``boolean``, ``object`` or ``array``."""
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    word = F.regexp_extract(_schema(v, path), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(names, word), F.lit(MISSING))


def has_kind(v: Column, path: str, type_name: str) -> Column:
    """Whether the field is there with the given type."""
    return F.coalesce(_schema(v, path).rlike(f"^({_WORDS[type_name]})"), F.lit(False))


def is_missing(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNull()


def json_int(v: Column, path: str = "$", wrap: bool = False) -> Column:
    """JSON number to int, truncated towards zero.

    Out of range gives null (callers report it); with ``wrap`` the low 32 bits are kept instead.
    """
    exact = F.try_variant_get(v, path, "decimal(38,18)")
    if not wrap:
        return exact.try_cast("int")
    # beyond 20 whole digits there is no room for a fraction, and none is needed
    return wrap_int(F.coalesce(truncate(exact), F.try_variant_get(v, path, "decimal(38,0)")))


def _typed(v: Column, path: str, type_name: str, wrap: bool) -> Column:
    """The field's value where it has the type, else null."""
    if type_name == INT:
        value = json_int(v, path, wrap)
    elif type_name == LONG:
        value = F.try_variant_get(v, path, "decimal(38,18)").try_cast("bigint")
    else:
        value = F.try_variant_get(v, path, _SPARK_TYPE[type_name])
    return F.when(has_kind(v, path, type_name), value)


def extract(
    v: Column, path: str, type_name: str, default, report: str | None = None, wrap: bool = False
) -> Extracted:
    """Required field: missing or of another type gives the default and an error name.

    A missing field is reported by the last path segment, a mistyped one by ``report`` if given.
    """
    name = path.rsplit(".", 1)[-1]
    value = _typed(v, path, type_name, wrap)
    wrong = F.lit(name)
    if report is not None:
        wrong = F.when(is_missing(v, path), F.lit(name)).otherwise(F.lit(report))
    return Extracted(_or_default(value, default, type_name), F.when(value.isNull(), wrong))


def extract_optional(
    v: Column, path: str, type_name: str, default, strict: bool = True, wrap: bool = False
) -> Extracted:
    """Optional field: missing gives the default silently.

    Another type is an error when ``strict``, and silently the default otherwise.
    """
    value = _typed(v, path, type_name, wrap)
    name = F.lit(path.rsplit(".", 1)[-1])
    error = F.lit(None).cast("string")
    if strict:
        error = F.when(value.isNull() & ~is_missing(v, path), name)
    return Extracted(_or_default(value, default, type_name), error)


def _or_default(value: Column, default, type_name: str) -> Column:
    if default is None:
        return value
    spark_type = {INT: "int", LONG: "bigint"}.get(type_name) or _SPARK_TYPE[type_name]
    return F.coalesce(value, F.lit(default).cast(spark_type))


@dataclass(frozen=True)
class Field:
    """A field to read: see :func:`extract` and :func:`extract_optional` for the rules."""

    path: str
    type_name: str
    default: object = None
    required: bool = True
    strict: bool = True
    report: str | None = None


def read_fields(
    df: DataFrame, body: str, fields: Mapping[str, Field], wrap: bool = False
) -> tuple[DataFrame, dict[str, Extracted]]:
    """Look up many fields of one document: a wider frame, and columns over it.

    The lookups are made in two projections that everything later refers to, so each happens once
    per row; written into the rules themselves they would run again in every branch. Object fields
    give true instead of a value.
    """
    keep = [F.col(c) for c in df.columns]
    found = df.select(
        *keep,
        *[F.expr(f"try_variant_get({body}, '{f.path}', 'variant') AS _r_{n}") for n, f in fields.items()],
    )
    read = found.select(
        *keep,
        *[_read_typed(n, f, wrap).alias(f"_v_{n}") for n, f in fields.items()],
        *[F.expr(f"_r_{n} IS NULL AS _m_{n}") for n in fields],
    )
    return read, {n: _judge(n, f) for n, f in fields.items()}


_SQL_TYPED = {
    INT: "TRY_CAST(try_variant_get({r}, '$', 'decimal(38,18)') AS INT)",
    LONG: "TRY_CAST(try_variant_get({r}, '$', 'decimal(38,18)') AS BIGINT)",
    DOUBLE: "try_variant_get({r}, '$', 'double')",
    STRING: "try_variant_get({r}, '$', 'string')",
}


def _read_typed(name: str, field: Field, wrap: bool) -> Column:
    found = f"_r_{name}"
    if field.type_name == OBJECT:
        # an object casts to any struct; spelling out its schema would visit everything inside
        return F.expr(f"IF(try_variant_get({found}, '$', 'struct<_:boolean>') IS NULL, NULL, true)")
    right_type = f"schema_of_variant({found}) RLIKE '^({_WORDS[field.type_name]})'"
    if wrap and field.type_name == INT:
        return F.when(F.expr(right_type), json_int(F.col(found), wrap=True))
    return F.expr(f"CASE WHEN {right_type} THEN {_SQL_TYPED[field.type_name].format(r=found)} END")


def _judge(name: str, field: Field) -> Extracted:
    label = field.path.rsplit(".", 1)[-1]
    value, wrong = F.col(f"_v_{name}"), f"_v_{name} IS NULL"
    if field.required:
        label_if = f"IF(_m_{name}, '{label}', '{field.report or label}')"
    else:
        wrong += f" AND NOT _m_{name}" if field.strict else " AND false"
        label_if = f"'{label}'"
    return Extracted(
        _or_default(value, field.default, field.type_name),
        F.expr(f"CASE WHEN {wrong} THEN {label_if} END"),
    )


def collect_errors(*errors: Column) -> Column:
    """The error names that are set, in the given order."""
    return F.array_compact(F.array(*errors))

"""Dotted-path access to nested telemetry and its text rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_PREFIX = "event."


class UnknownPath(ValueError):
    """A dotted path that names no field of the telemetry schema."""


def clean_path(path: str) -> str:
    return path[len(EVENT_PREFIX):] if path.startswith(EVENT_PREFIX) else path


def path_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type at ``path``; None when a step is missing or is not a struct. Below a VARIANT every step may be."""
    current: T.DataType = schema
    for step in clean_path(path).split("."):
        if isinstance(current, T.VariantType) and step and "'" not in step:
            continue
        if not isinstance(current, T.StructType) or step not in current.names:
            return None
        current = current[step].dataType
    return current


#: Lists and objects inside a VARIANT are written out so deep; what lies deeper is written as JSON.
VARIANT_DEPTH = 2


def _bound(value: Column, body) -> Column:
    """``body`` over ``value``, which a one-element list binds to one evaluation however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def variant_text(value: Column, depth: int = VARIANT_DEPTH) -> Column:
    """Text of a VARIANT by what it holds: as typed values have it, null as NULL."""
    if not depth:
        return F.try_variant_get(value, "$", "string")
    return _bound(value, lambda v: _bound(F.schema_of_variant(v), lambda kind: _text_by_kind(v, kind, depth)))


def _text_by_kind(value: Column, kind: Column, depth: int) -> Column:
    def inner(x: Column) -> Column:
        return F.coalesce(variant_text(x, depth - 1), F.lit("<nil>"))

    def shown(members: Column) -> Column:
        return F.transform(
            F.array_sort(F.map_keys(members)), lambda k: F.concat(k, F.lit(":"), inner(F.element_at(members, k)))
        )

    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), inner)
    by_name = _bound(F.try_variant_get(value, "$", "map<string,variant>"), shown)
    return (
        F.when(kind.startswith("ARRAY"), F.concat(F.lit("["), F.array_join(items, " "), F.lit("]")))
        .when(kind.startswith("OBJECT"), F.concat(F.lit("map["), F.array_join(by_name, " "), F.lit("]")))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), as_text(F.try_variant_get(value, "$", "double"), T.DoubleType()))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def _variant_at(schema: T.StructType, path: str) -> tuple[str, str] | None:
    """(steps to a VARIANT, path inside it) where a dotted path leads through one."""
    steps = clean_path(path).split(".")
    current: T.DataType = schema
    for i, step in enumerate(steps):
        if isinstance(current, T.VariantType):
            return ".".join(f"`{s}`" for s in steps[:i]), "$" + "".join(f"['{s}']" for s in steps[i:])
        if not isinstance(current, T.StructType) or step not in current.names:
            return None
        current = current[step].dataType
    return None


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a value: lists as ``[a b]``, floats without trailing zeros, NULL kept."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        fixed = F.format_string("%.6f", value.cast("double"))
        trimmed = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")
        return F.when(value.isNotNull(), trimmed)
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(value, lambda x: F.coalesce(as_text(x, dtype.elementType), F.lit("<nil>")))
        return F.concat(F.lit("["), F.array_join(inner, " "), F.lit("]"))
    if isinstance(dtype, T.StructType):
        parts = [
            F.concat(
                F.lit(f.name + ":"),
                F.coalesce(as_text(value.getField(f.name), f.dataType), F.lit("<nil>")),
            )
            for f in sorted(dtype.fields, key=lambda f: f.name)
        ]
        body = F.concat(F.lit("map["), F.concat_ws(" ", *parts), F.lit("]"))
        return F.when(value.isNotNull(), body)
    if isinstance(dtype, T.VariantType):
        return variant_text(value)
    if isinstance(dtype, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return value.cast("string")


def path_text(df: DataFrame, path: str, strict: bool = True) -> Column:
    """Text at a dotted path; a missing step or unset field reads as ``''``.

    With ``strict`` a path that names no schema field is an error at plan time, so a typing
    slip cannot silently put every event into one group.
    """
    dtype = path_type(df.schema, path)
    if dtype is None:
        if strict:
            raise UnknownPath(path)
        return F.lit("")
    inside = _variant_at(df.schema, path)
    if inside:
        return F.coalesce(variant_text(F.try_variant_get(F.col(inside[0]), inside[1], "variant")), F.lit(""))
    column = F.col(".".join(f"`{step}`" for step in clean_path(path).split(".")))
    return F.coalesce(as_text(column, dtype), F.lit(""))


def keyed_text(df: DataFrame, paths: list[str], strict: bool = True) -> Column:
    """``a=1|b=2`` over the paths, with prefix-free names."""
    parts = [F.concat(F.lit(clean_path(p) + "="), path_text(df, p, strict)) for p in paths]
    return F.concat_ws("|", *parts)

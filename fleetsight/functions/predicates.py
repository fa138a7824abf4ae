"""What a predicate says about an event's kind, read from Spark's own parse of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _kinds(node) -> frozenset[str] | None:
    """Kinds of which an event must be for the parsed predicate to be true; None where it says nothing."""
    name = node.getClass().getSimpleName()
    parts = [node.children().apply(i) for i in range(node.children().size())] if name in ("And", "Or", "EqualTo", "In") else []
    if name == "And":
        found = [k for k in map(_kinds, parts) if k is not None]
        return frozenset.intersection(*found) if found else None
    if name == "Or":
        found = [_kinds(p) for p in parts]
        return None if None in found else frozenset.union(*found)
    names = [p.getClass().getSimpleName() for p in parts]
    if name == "EqualTo" and names == ["Literal", "UnresolvedAttribute"]:
        parts, names = parts[::-1], names[::-1]
    is_kind = names[:1] == ["UnresolvedAttribute"] and parts[0].name().lower() == "kind"
    if not is_kind or any(n != "Literal" for n in names[1:]):
        return None
    if any(p.dataType().typeName() != "string" for p in parts[1:]):
        return None
    return frozenset(p.value().toString() for p in parts[1:])


def implied_kinds(spark: SparkSession, expr: str) -> frozenset[str] | None:
    """Kinds outside which a predicate is never true; None where any kind may meet it."""
    try:
        return _kinds(spark._jsparkSession.sessionState().sqlParser().parseExpression(expr))
    except PySparkException:
        return None


def kind_guard(spark: SparkSession, exprs: Iterable[str]) -> Column | None:
    """A filter that no event which meets one of the predicates fails, if they name kinds.

    It reaches partition and file filters, which predicates that may fail do not. The empty text is
    among its values, so that a single kind is no equation from which the optimiser would
    take ``kind`` to be a constant inside the predicates.
    """
    kinds: set[str] = set()
    for expr in exprs:
        implied = implied_kinds(spark, expr)
        if implied is None:
            return None
        kinds |= implied
    return F.col("kind").isin("", *sorted(kinds))

"""Enum names and their wire numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.schema import ENUMS


def enum_name(value: Column, group: str) -> Column:
    """Name for an enum given as a name or as digits; other text is kept."""
    names = F.array(*[F.lit(n) for n in ENUMS[group]])
    number = F.when(value.rlike(r"^\d{1,4}$"), value.cast("int"))
    return F.coalesce(F.get(names, number), value)


def enum_number(name: Column, group: str) -> Column:
    """Wire number of an enum name, NULL when it is not in the group."""
    names = F.array(*[F.lit(n) for n in ENUMS[group]])
    return F.nullif(F.array_position(names, name), F.lit(0).cast("bigint")) - F.lit(1)

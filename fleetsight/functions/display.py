"""One-line summaries of signals and baseline patterns for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the summary format.
SUMMARY_KEYS = (
    "kind",
    "actor_path",
    "target_path",
    "decision",
    "target_sha256",
    "process",
    "pid",
    "path",
    "hash",
)
LONG_PATH = 60
HASH_PREFIX = 12
ELLIPSIS = "…"


def short_hash(value: Column) -> Column:
    return F.when(
        F.length(value) > HASH_PREFIX,
        F.concat(F.substring(value, 1, HASH_PREFIX), F.lit(ELLIPSIS)),
    ).otherwise(value)


def short_path(value: Column) -> Column:
    """First and last two steps of a path over 60 bytes; shorter ones unchanged."""
    steps = F.split(value, "/")
    head = F.when(F.get(steps, F.lit(0)) == "", F.concat(F.lit("/"), F.get(steps, F.lit(1)))).otherwise(
        F.get(steps, F.lit(0))
    )
    tail = F.array_join(F.slice(steps, -2, 2), "/")
    is_long = (F.octet_length(value) > LONG_PATH) & (F.size(steps) > 3)
    return F.when(is_long, F.concat(head, F.lit("/.../"), tail)).otherwise(value)


def summary_line(values: dict[str, Column]) -> Column:
    """``key=value`` pairs in the fixed key order, empty values left out."""
    shaped = []
    for key in SUMMARY_KEYS:
        if key not in values:
            continue
        value = values[key]
        if key in ("target_sha256", "hash"):
            value = short_hash(value)
        elif key in ("actor_path", "target_path", "path"):
            value = short_path(value)
        shaped.append(F.concat(F.lit(key + "="), F.nullif(value, F.lit(""))))
    return F.concat_ws(" ", *shaped)


def _last_pattern_value(pattern: Column, *markers: str) -> Column:
    def wanted(part: Column) -> Column:
        name = F.substring_index(part, "=", 1)
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(name, F.lit(marker))
        return F.contains(part, F.lit("=")) & hit

    part = F.try_element_at(F.filter(F.split(pattern, r"\|"), wanted), F.lit(-1))
    return F.nullif(F.substr(part, F.locate("=", part) + 1), F.lit(""))


def pattern_line(pattern: Column) -> Column:
    """Path and shortened hash of a baseline pattern, or the pattern itself."""
    path = _last_pattern_value(pattern, "executable.path")
    digest = short_hash(
        _last_pattern_value(pattern, "executable.hash.hash", "executable.cdhash")
    )
    line = F.concat_ws(
        " ", F.concat(F.lit("path="), path), F.concat(F.lit("hash="), digest)
    )
    return F.coalesce(F.nullif(line, F.lit("")), pattern)

"""Rule predicates over every event in one pass."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.predicates import kind_guard

BROADCAST_RULES = 5_000
PREDICATES_PER_ARRAY = 200
NO_RULE = -1
_HITS = "_hits"


def require_ansi(spark: SparkSession) -> None:
    """Predicates rely on errors being raised: without ANSI rules overflow would wrap and match."""
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("rules need spark.sql.ansi.enabled=true: without it arithmetic wraps instead of failing")


def holds(expr: str) -> Column:
    """A predicate that is false where it is NULL or fails, whatever in it fails on an event.

    Spark's ``try_add`` of a date and a number of days evaluates its operands, too, so that any error
    in them gives NULL: overflow, bad casts, indexes, patterns, divisions, raised errors. The condition
    around it is always met; it keeps the optimiser from computing parts that predicates have in common outside.
    """
    tried = f"try_add(DATE'1970-01-01', CAST(({expr}\n) AS INT)) > DATE'1970-01-01'"
    return F.coalesce(F.expr(f"CASE WHEN octet_length(kind) >= 0 THEN {tried} END"), F.lit(False))


def match(df: DataFrame, rules: Sequence[Row]) -> DataFrame:
    """One output row per (event, rule) hit, with ``rule_idx`` in catalogue order.

    All predicates are evaluated in a single projection over a single scan; an event that meets
    no rule leaves no row in the explode. Where every predicate asks for
    certain kinds, others are not even read. A predicate that fails on an event counts as not met there.
    """
    require_ansi(df.sparkSession)
    if not rules:
        return df.withColumn("rule_idx", F.lit(0)).where(F.lit(False))
    guard = kind_guard(df.sparkSession, [r["expr"] for r in rules])
    if guard is not None:
        df = df.where(guard)
    blocks = []
    for start in range(0, len(rules), PREDICATES_PER_ARRAY):
        block = rules[start : start + PREDICATES_PER_ARRAY]
        blocks.append(
            F.array(*[F.when(holds(r["expr"]), F.lit(start + i)).otherwise(NO_RULE) for i, r in enumerate(block)])
        )
    # The verdicts are a projection of their own, and nothing around it has a lambda: the optimiser leaves
    # each predicate evaluated once, and all but lambdas inside predicates is compiled, which also makes
    # failures cheaper.
    tested = df.withColumn(_HITS, F.concat(*blocks) if len(blocks) > 1 else blocks[0])
    return tested.withColumn("rule_idx", F.explode(F.array_remove(_HITS, NO_RULE))).drop(_HITS)


def rule_table(spark: SparkSession, rules: Sequence[Row]) -> DataFrame:
    """Rule metadata by ``rule_idx``."""
    table = pa.table({
        "rule_idx": pa.array(range(len(rules)), pa.int32()),
        "rule_id": pa.array([r["id"] for r in rules], pa.string()),
        "title": pa.array([r["title"] for r in rules], pa.string()),
        "rule_description": pa.array([(r["description"] or "").strip() for r in rules], pa.string()),
        "severity": pa.array([r["severity"] for r in rules], pa.string()),
        "tags": pa.array([list(r["tags"] or []) for r in rules], pa.list_(pa.string())),
    })
    return spark.createDataFrame(table)


def with_rule_meta(df: DataFrame, rules: Sequence[Row]) -> DataFrame:
    """Joins rule metadata; the catalogue is broadcast only while its row count is small."""
    meta = rule_table(df.sparkSession, rules)
    if len(rules) <= BROADCAST_RULES:
        meta = F.broadcast(meta)
    return df.join(meta, "rule_idx")


def per_rule(rules: Sequence[Row], value_of, default: Column) -> Column:
    """``value_of(rule)`` chosen by ``rule_idx``."""
    chosen: Column | None = None
    for idx, rule in enumerate(rules):
        value = value_of(rule)
        hit = F.col("rule_idx") == idx
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return default if chosen is None else chosen.otherwise(default)

"""First appearances: baselines with a learning period, and first sightings of artifacts.

``row_number() = 1`` is planned with a per-task group limit below the shuffle, and the counts are
partial aggregates, so a pattern that makes up a large share of all rows shuffles only a few rows
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetsight.functions.durations import duration_ns
from fleetsight.functions.paths import keyed_text
from fleetsight.operators.match import match, per_rule

PATTERN_KEY = ["rule_id", "scope", "pattern"]
FLEET = "fleet"


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of every key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def flag_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, salts: int = 64
) -> DataFrame:
    """Marks the earliest row of every key and keeps all rows.

    Two rounds over salted keys: each salt finds its earliest row, then only those compete. No
    task sees a whole hot key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    local = W.partitionBy(*keys, "_salt").orderBy(*order)
    marked = salted.withColumn("_lead", F.row_number().over(local) == 1)
    lane = F.when(F.col("_lead"), F.lit(-1)).otherwise(F.col("_salt"))
    final = W.partitionBy(*keys, "_lane").orderBy(*order)
    return (
        marked.withColumn("_lane", lane)
        .withColumn(flag, F.col("_lead") & (F.row_number().over(final) == 1))
        .drop("_salt", "_lead", "_lane")
    )


def baseline_events(
    df: DataFrame, rules: Sequence[Row], scope: str = "host", strict: bool = True
) -> DataFrame:
    """Events that pass a baseline filter, with their pattern."""
    hits = match(df, rules)
    text = F.lit("")
    return hits.withColumns({
        "rule_id": per_rule(rules, lambda r: F.lit(r["id"]), text),
        "scope": F.col("machine_id") if scope == "host" else F.lit(FLEET),
        "pattern": per_rule(rules, lambda r: keyed_text(df, list(r["track"]), strict), text),
    })


def first_seen_stats(events: DataFrame, keys: Sequence[str] = PATTERN_KEY, clock: str = "order_ns") -> DataFrame:
    """First time, last time and number of sightings per key."""
    return events.groupBy(*keys).agg(
        F.min(clock).alias("first_ns"),
        F.max(clock).alias("last_ns"),
        F.count(F.lit(1)).alias("sightings"),
    )


def merge_seen(seen: DataFrame, batch: DataFrame, keys: Sequence[str] = PATTERN_KEY) -> DataFrame:
    """Seen table after a batch; both sides as given by ``first_seen_stats``."""
    return (
        seen.select(*keys, "first_ns", "last_ns", "sightings")
        .unionByName(batch.select(*keys, "first_ns", "last_ns", "sightings"))
        .groupBy(*keys)
        .agg(
            F.min("first_ns").alias("first_ns"),
            F.max("last_ns").alias("last_ns"),
            F.sum("sightings").alias("sightings"),
        )
    )


def expire_seen(seen: DataFrame, as_of_ns: Column, ttl: str) -> DataFrame:
    """Seen table without keys that were last seen longer than ``ttl`` ago."""
    return seen.where(F.col("last_ns") >= as_of_ns - F.lit(duration_ns(ttl)))


def baseline_matches(
    df: DataFrame,
    rules: Sequence[Row],
    learning_start_ns: int,
    scope: str = "host",
    seen: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """First event of every new pattern, flagged ``in_learning`` while its rule still learns.

    A pattern learnt in that time is known afterwards, so it never alerts. ``seen`` holds the
    patterns of earlier runs.
    """
    events = baseline_events(df, rules, scope, strict)
    if seen is not None:
        events = events.join(seen.select(*PATTERN_KEY), PATTERN_KEY, "left_anti")
    first = first_per_key(events, PATTERN_KEY, ["order_ns", "event_seq"])
    learn_until = per_rule(
        rules,
        lambda r: F.lit(learning_start_ns + duration_ns(r["learning_period"])).cast("bigint"),
        F.lit(0).cast("bigint"),
    )
    return first.withColumn("in_learning", F.col("order_ns") < learn_until)


def alerts(matches: DataFrame) -> DataFrame:
    """Baseline matches that are reported; the others stay a side output."""
    return matches.where(~F.col("in_learning"))

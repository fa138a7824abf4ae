"""The whole detection run over normalised events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.predicates import kind_guard
from fleetsight.operators import first_seen, lineage
from fleetsight.operators.correlate import correlation_events, fold_windows, window_specs
from fleetsight.operators.match import holds, match, per_rule
from fleetsight.operators.signals import (
    SIGNAL_COLUMNS,
    as_signals,
    enrich,
    signals_from_baselines,
    signals_from_matches,
    signals_from_windows,
    window_payload,
)
from fleetsight.schema import DEFAULT_MAX_EVENTS, DEFAULT_TREE_DEPTH, DEFAULT_TREE_TTL
from fleetsight.session import ensure_checkpoint_dir
from fleetsight.sources.catalogue import EnabledRules
from fleetsight.sources.telemetry import SOURCE


@dataclass
class Settings:
    scope: str = "host"
    max_events: int = DEFAULT_MAX_EVENTS
    learning_start_ns: int = 0
    tree_depth: int = DEFAULT_TREE_DEPTH
    tree_ttl: str | None = DEFAULT_TREE_TTL
    strict: bool = True
    archive_dir: str | None = None


def _with_archive(signals: DataFrame, settings: Settings) -> DataFrame:
    """Adds where the spool file of a signal is kept, when files are archived."""
    if not settings.archive_dir or SOURCE not in signals.columns:
        return signals
    return enrich(signals, {"spool_archive_path": archive_path(settings.archive_dir, F.col(SOURCE))})


def simple_signals(events: DataFrame, rules: EnabledRules, settings: Settings) -> DataFrame:
    """Signals of simple rules with first-seen marks and process trees."""
    matches = match(events, rules.rules)
    signals = signals_from_matches(matches, rules.rules, settings.strict)
    order = ["order_ns", "source_seq", "rule_idx"]
    # Matches without a hash are spread by their order, so the empty hash is not one hot group.
    no_hash = F.col("target_sha256") == ""
    lane = F.when(no_hash, F.xxhash64(*order)).otherwise(F.lit(0).cast("bigint"))
    signals = first_seen.flag_first(
        signals.withColumn("_hash_lane", lane),
        ["machine_id", "target_sha256", "_hash_lane"], order, "artifact_first_seen",
    ).drop("_hash_lane")
    first = F.when(F.col("artifact_first_seen") & (F.col("target_sha256") != ""), F.lit(True))
    signals = _with_archive(enrich(signals, {"first_seen": first}), settings)
    if rules.wants_tree:
        return with_process_tree(signals, events, rules, settings)
    return as_signals(signals)


def with_process_tree(
    signals: DataFrame, events: DataFrame, rules: EnabledRules, settings: Settings
) -> DataFrame:
    """Adds ``process_tree`` to the context of signals whose rule asks for it.

    Signals go two ways, with a tree and without, so they are checkpointed first: events are
    matched once, and the ancestor joins start from stored rows.
    """
    asked = per_rule(rules.rules, lambda r: F.lit(bool(r["include_process_tree"])), F.lit(False))
    node = "_node"
    wanted = asked & (F.col("kind") == "execution") & F.col("execution.target.id").isNotNull()
    ensure_checkpoint_dir(signals.sparkSession)
    stored = signals.select(
        *SIGNAL_COLUMNS, F.when(F.coalesce(wanted, F.lit(False)), lineage.own_node()).alias(node)
    ).checkpoint()
    base = as_signals(stored.where(F.col(node).isNull()))
    starts = stored.where(F.col(node).isNotNull()).select(
        *SIGNAL_COLUMNS,
        F.col("host_id").alias("machine_id"),
        *[F.col(f"{node}.{k}").alias(k) for k in ("boot", "pid", "pidversion")],
        F.col("ts_ns").alias("match_ns"),
        F.col("source_seq").alias("match_seq"),
        F.col(node).alias("own_node"),
    )
    chains = lineage.process_chains(
        starts, lineage.process_nodes(events), settings.tree_depth, settings.tree_ttl
    )
    tree = lineage.serialize_chain(F.col("chain"))
    return base.unionByName(as_signals(enrich(chains, {"process_tree": tree})))


def correlation_signals(events: DataFrame, rules: EnabledRules, settings: Settings) -> DataFrame:
    """Signals of window rules.

    Only keys and the counted value go through the windows; the firing events, few among those
    that pass a filter, are fetched afterwards by host, time and sequence.
    """
    found = correlation_events(
        events, rules.correlations, settings.scope, settings.strict, F.col("machine_id")
    )
    fires = fold_windows(found, window_specs(rules.correlations, settings.max_events))
    passes = F.lit(False)
    for rule in rules.correlations:
        passes = passes | holds(rule["expr"])
    guard = kind_guard(events.sparkSession, [r["expr"] for r in rules.correlations])
    named = events if guard is None else events.where(guard)
    sample = named.where(passes & F.col("event_time_ns").isNotNull())
    fire = fires.withColumnRenamed("payload", "machine_id").withColumns({
        "event_time_ns": F.col("ts_ns"), "event_seq": F.col("seq"),
    })
    joined = fire.join(sample, ["machine_id", "event_time_ns", "event_seq"])
    carried = [*fires.drop("payload").columns, *[c for c in events.columns if c == SOURCE]]
    payload = window_payload(events, rules.correlations, settings.strict).alias("payload")
    signals = _with_archive(
        signals_from_windows(joined.select(*carried, payload), rules.correlations), settings
    )
    # Copies of one event join with each other; each fire is kept once.
    return signals.dropDuplicates(["rule_idx", "scope", "group_key", "ts_ns", "seq", "nth"])


def baseline_matches(
    events: DataFrame, rules: EnabledRules, settings: Settings, seen: DataFrame | None = None
) -> DataFrame:
    return first_seen.baseline_matches(
        events, rules.baselines, settings.learning_start_ns, settings.scope, seen, settings.strict
    )


def detect(
    events: DataFrame,
    rules: EnabledRules,
    settings: Settings | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Signals of all three families. Branches without enabled rules are not planned."""
    settings = settings or Settings()
    parts = []
    if rules.rules:
        parts.append(simple_signals(events, rules, settings))
    if rules.correlations:
        parts.append(as_signals(correlation_signals(events, rules, settings)))
    if rules.baselines:
        alerts = first_seen.alerts(baseline_matches(events, rules, settings, seen))
        parts.append(as_signals(_with_archive(signals_from_baselines(alerts, rules.baselines), settings)))
    if not parts:
        raise ValueError("no enabled rules")
    signals = parts[0]
    for part in parts[1:]:
        signals = signals.unionByName(part)
    return signals


def archive_path(archive_dir: str, source_file: Column) -> Column:
    """Where a spool file with signals is kept."""
    return F.concat(F.lit(archive_dir.rstrip("/") + "/"), F.element_at(F.split(source_file, "/"), -1))

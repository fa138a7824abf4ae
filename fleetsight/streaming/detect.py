"""Structured Streaming form of the detections.

Windows and baselines keep keyed state; simple rules are stateless; process trees are joined in
``foreachBatch`` against the stored executions. Streams end in a Parquet store that keeps the
first copy of an id, so a replayed micro-batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetsight.functions.durations import duration_ns
from fleetsight.operators import first_seen
from fleetsight.operators.correlate import GROUP, correlation_events, window_specs
from fleetsight.operators.match import match, per_rule
from fleetsight.operators.signals import (
    SIGNAL_COLUMNS,
    as_signals,
    signals_from_baselines,
    signals_from_matches,
    signals_from_windows,
    window_payload,
)
from fleetsight.operators.store import append_signals
from fleetsight.plans.detect import Settings, with_process_tree
from fleetsight.session import use_keyed_state
from fleetsight.sources.catalogue import EnabledRules
from fleetsight.streaming.processors import FirstSeenProcessor, WindowProcessor

_FIRES = (
    "rule_idx int, scope string, group_key string, ts_ns bigint, seq bigint, event_count int, "
    "first_ns bigint, first_seq bigint, distinct_values array<string>, payload "
)


def window_fires(
    events: DataFrame,
    rules: Sequence[Row],
    settings: Settings,
    with_payload: bool = True,
    forget_idle_after: str | None = None,
) -> DataFrame:
    """Fires of the correlation rules over a stream of normalised events.

    ``forget_idle_after`` is a watermark delay: groups idle beyond it and their window are
    dropped from state, and events later than it are ignored.
    """
    use_keyed_state(events.sparkSession)
    payload = window_payload(events, rules, settings.strict) if with_payload else None
    found = correlation_events(events, rules, settings.scope, settings.strict, payload)
    if forget_idle_after:
        found = found.withColumn("event_time", F.timestamp_micros(F.expr("ts_ns DIV 1000"))).withWatermark(
            "event_time", f"{duration_ns(forget_idle_after) // 1_000_000_000} seconds"
        )
    out = T.StructType.fromDDL(_FIRES + found.schema["payload"].dataType.simpleString())
    processor = WindowProcessor(window_specs(rules, settings.max_events), bool(forget_idle_after))
    return found.groupBy(*GROUP).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime" if forget_idle_after else "None",
    )


def window_signals(events: DataFrame, rules: Sequence[Row], settings: Settings, **options) -> DataFrame:
    return as_signals(signals_from_windows(window_fires(events, rules, settings, **options), rules))


def baseline_signals(events: DataFrame, rules: Sequence[Row], settings: Settings) -> DataFrame:
    """Signals of new patterns; patterns met while a rule learns are remembered without one."""
    use_keyed_state(events.sparkSession)
    found = first_seen.baseline_events(events, rules, settings.scope, settings.strict)
    learn_until = per_rule(
        rules,
        lambda r: F.lit(settings.learning_start_ns + duration_ns(r["learning_period"])).cast("bigint"),
        F.lit(0).cast("bigint"),
    )
    keys = first_seen.PATTERN_KEY
    flagged = signals_from_baselines(found.withColumn("in_learning", F.col("order_ns") < learn_until), rules)
    rows = flagged.select(*SIGNAL_COLUMNS, "scope", "pattern", "in_learning")
    first = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FirstSeenProcessor(("ts_ns", "source_seq")),
        outputStructType=rows.schema,
        outputMode="Append",
        timeMode="None",
    )
    return as_signals(first.where(~F.col("in_learning")))


def simple_signals(events: DataFrame, rules: EnabledRules, settings: Settings) -> DataFrame:
    """Stateless signals of simple rules, without process trees."""
    return as_signals(signals_from_matches(match(events, rules.rules), rules.rules, settings.strict))


def start_simple(
    events: DataFrame,
    rules: EnabledRules,
    settings: Settings,
    store_path: str,
    checkpoint: str,
    executions: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Simple signals with process trees into the store.

    ``executions`` is a batch DataFrame of stored normalised events; those of the micro-batch are
    visible to its own signals as well.
    """

    def write(batch: DataFrame, _: int) -> None:
        signals = signals_from_matches(match(batch, rules.rules), rules.rules, settings.strict)
        if rules.wants_tree:
            known = batch if executions is None else executions.unionByName(batch, allowMissingColumns=True)
            # A batch may be stored already when it is replayed; equal versions change nothing.
            signals = with_process_tree(signals, known, rules, settings)
        append_signals(as_signals(signals), store_path, ["ts_ns", "source_seq"], ids_fix_time=True)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_store(signals: DataFrame, store_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Any stream of signals into the store."""

    def write(batch: DataFrame, _: int) -> None:
        append_signals(batch, store_path, ["ts_ns", "source_seq"], ids_fix_time=True)

    writer = signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()

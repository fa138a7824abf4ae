"""Threshold-in-window correlation per group, with reset on fire.

Shape: one scan and one shuffle by (rule, host, group, slice) bring each slice together in event
order; a streaming fold (``window_fold``) emits fires, some of them conditional on the last fire
before the slice; a small pass over the slices that fired, one row each, settles the conditions
by a join on (rule, host, group, slice). No task holds a whole group: memory is bounded by
``max_events`` and a hot group is spread over its slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetsight.functions.durations import duration_ns
from fleetsight.functions.paths import keyed_text, path_text
from fleetsight.operators.match import match, per_rule
from fleetsight.operators.slices import (
    MIN_SLICE_NS,
    NARROW_SLICE_NS,
    ROWS_PER_PIECE,
    slice_width,
    with_even_slices,
    with_slices,
)
from fleetsight.operators.window_fold import Fire, SliceFold, WindowSpec, entry_applies
from fleetsight.schema import DEFAULT_MAX_EVENTS
from fleetsight.session import ensure_checkpoint_dir

GLOBAL_GROUP = "_global"
FLEET = "fleet"
GROUP = ["rule_idx", "scope", "group_key"]
ORDER = ["ts_ns", "seq"]
_POSITIONS = {"pos", "live_from", "entry_from", "entry_to", "entry"}
_POSITION = "struct<ts_ns:bigint,seq:bigint,ord:int>"
_FOLD_DDL = (
    "rule_idx int, scope string, group_key string, slice bigint, last boolean, "
    f"pos {_POSITION}, live_from {_POSITION}, distinct_values array<string>, "
    f"entry_from {_POSITION}, entry_to {_POSITION}, wraps boolean, payload "
)
_ENTRY_DDL = (
    f"rule_idx int, scope string, group_key string, slice bigint, entry {_POSITION}"
)


def window_specs(rules: Sequence[Row], max_events: int = DEFAULT_MAX_EVENTS) -> list[WindowSpec]:
    return [
        WindowSpec(
            window_ns=duration_ns(r["window"]),
            threshold=int(r["threshold"]),
            max_events=max_events,
            distinct=bool(r["count_distinct"]),
        )
        for r in rules
    ]


def correlation_events(
    df: DataFrame,
    rules: Sequence[Row],
    scope: str = "host",
    strict: bool = True,
    payload: Column | None = None,
) -> DataFrame:
    """Events that pass a correlation filter, with group key and counted value.

    Events without an event time can never be live, so they are dropped here.
    """
    hits = match(df.where(F.col("event_time_ns").isNotNull()), rules)

    def group_key(rule):
        fields = list(rule["group_by"] or [])
        return keyed_text(df, fields, strict) if fields else F.lit(GLOBAL_GROUP)

    def counted(rule):
        field = rule["count_distinct"]
        return path_text(df, field, strict) if field else F.lit("")

    text = F.lit("")
    return hits.select(
        F.col("rule_idx").cast("int").alias("rule_idx"),
        (F.col("machine_id") if scope == "host" else F.lit(FLEET)).alias("scope"),
        per_rule(rules, group_key, text).alias("group_key"),
        per_rule(rules, counted, text).alias("value"),
        F.col("event_time_ns").alias("ts_ns"),
        F.col("event_seq").cast("bigint").alias("seq"),
        (F.lit(None).cast("string") if payload is None else payload).alias("payload"),
    )


def fold_windows(
    events: DataFrame,
    specs: Sequence[WindowSpec],
    min_slice_ns: int = MIN_SLICE_NS,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Fires of every (rule, scope, group) of ``correlation_events``.

    Output: group columns, ``ts_ns``/``seq`` of the firing event (``nth`` among events equal in
    both), ``event_count``, ``first_ns``/``first_seq`` of the oldest live event, ``distinct_values`` and ``payload``.
    """
    if not specs:
        raise ValueError("no window specs")
    look_back = per_rule(specs, lambda s: F.lit(s.window_ns).cast("bigint"), F.lit(0).cast("bigint"))
    width = per_rule(
        specs,
        lambda s: F.lit(slice_width(s.window_ns, min_slice_ns) if s.window_ns else 0).cast("bigint"),
        F.lit(0).cast("bigint"),
    )
    if _spreads(specs, min_slice_ns):
        sliced = with_slices(events, "ts_ns", look_back, width)
    else:
        newest = max(s.reach for s in specs) - 1
        sliced = with_even_slices(events, GROUP, ORDER, look_back, width, newest, rows_per_piece)
    ordered = (
        sliced.repartition(*GROUP, "slice")
        .sortWithinPartitions(*GROUP, "slice", *ORDER)
        .select(*GROUP, "slice", *ORDER, "carried", "value", "payload")
    )
    folded_type = _struct(_FOLD_DDL + events.schema["payload"].dataType.simpleString())
    entry_type = _struct(_ENTRY_DDL)
    ensure_checkpoint_dir(events.sparkSession)
    # Fires and exits are read from it, so it is folded once and stored: few rows, those that can fire.
    folded = ordered.mapInArrow(_folder(tuple(specs), to_arrow_schema(folded_type)), folded_type).checkpoint()
    fires = folded.where(~F.col("last"))
    entries = (
        folded.where("last")
        .select(*GROUP, "slice", "last", "pos", "entry_from", "entry_to", "wraps")
        .repartition(*GROUP)
        .sortWithinPartitions(*GROUP, "slice")
        .mapInArrow(_resolver(to_arrow_schema(entry_type)), entry_type)
    )
    at_least = F.col("entry_from").isNull() | F.coalesce(F.col("entry") >= F.col("entry_from"), F.lit(False))
    below = F.col("entry_to").isNull() | F.coalesce(F.col("entry") < F.col("entry_to"), F.lit(True))
    applies = F.when(F.col("wraps"), at_least | below).otherwise(at_least & below)
    settled = fires.join(entries, [*GROUP, "slice"], "left").where(applies)
    threshold = per_rule(specs, lambda s: F.lit(s.threshold), F.lit(0))
    return settled.select(
        *GROUP,
        F.col("pos.ts_ns").alias("ts_ns"),
        F.col("pos.seq").alias("seq"),
        F.col("pos.ord").alias("nth"),
        threshold.cast("int").alias("event_count"),
        F.col("live_from.ts_ns").alias("first_ns"),
        F.col("live_from.seq").alias("first_seq"),
        "distinct_values",
        "payload",
    )


def _spreads(specs: Sequence[WindowSpec], min_slice_ns: int) -> bool:
    """Whether plain slices do: they are narrow, or rules without a cap need the whole look-back."""
    unbounded = any(s.reach <= 0 for s in specs)
    widest = max(slice_width(s.window_ns, min_slice_ns) for s in specs)
    return unbounded or widest <= NARROW_SLICE_NS


def correlate(
    df: DataFrame,
    rules: Sequence[Row],
    scope: str = "host",
    max_events: int = DEFAULT_MAX_EVENTS,
    strict: bool = True,
    payload: Column | None = None,
) -> DataFrame:
    """Fires of the correlation rules over normalised events."""
    events = correlation_events(df, rules, scope, strict, payload)
    return fold_windows(events, window_specs(rules, max_events))


def windowed_counts(events: DataFrame, specs: Sequence[WindowSpec]) -> DataFrame:
    """Live count and live distinct count at every event, ignoring reset and cap.

    Each row counts from its time to the end of its window; a value counts until it is seen
    again. Both are running sums over arrivals and departures, linear in the rows, where a
    sliding frame would rescan its window for every row.
    """
    look_back = per_rule(specs, lambda s: F.lit(s.window_ns).cast("bigint"), F.lit(0).cast("bigint"))
    width = per_rule(specs, lambda s: F.lit(slice_width(s.window_ns)).cast("bigint"), F.lit(1).cast("bigint"))
    keyed = with_slices(events.withColumn("_stay", look_back), "ts_ns", look_back, width).repartition(
        *GROUP, "slice"
    )
    by_value = W.partitionBy(*GROUP, "slice", "value").orderBy(*ORDER)
    in_order = (
        W.partitionBy(*GROUP, "slice")
        .orderBy("at_ns", F.col("step") == 2, "at_seq", "step")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    has_value = F.col("value") != ""
    moves = keyed.withColumns({
        "_next_ns": F.lead("ts_ns").over(by_value),
        "_next_seq": F.lead("seq").over(by_value),
    })
    leaves = F.col("ts_ns") + F.col("_stay")
    # At one instant arrivals come before departures, as the window's edge is inside. A value seen
    # again hands its place over just before the later event counts.
    handed_over = has_value & F.col("_next_ns").isNotNull() & (F.col("_next_ns") <= leaves)
    one, zero = F.lit(1), F.lit(0)
    steps = F.array(
        F.struct(
            F.col("ts_ns").alias("at_ns"), F.lit(1).alias("step"), F.col("seq").alias("at_seq"),
            one.alias("rows"), F.when(has_value, one).otherwise(zero).alias("vals"),
        ),
        F.struct(
            leaves.alias("at_ns"), F.lit(2).alias("step"), F.col("seq").alias("at_seq"),
            F.lit(-1).alias("rows"),
            F.when(has_value & ~handed_over, F.lit(-1)).otherwise(zero).alias("vals"),
        ),
        F.when(handed_over, F.struct(
            F.col("_next_ns").alias("at_ns"), F.lit(0).alias("step"), F.col("_next_seq").alias("at_seq"),
            zero.alias("rows"), F.lit(-1).alias("vals"),
        )),
    )
    counted = (
        moves.withColumn("_m", F.explode(F.array_compact(steps)))
        .select(*GROUP, "slice", *ORDER, "value", "carried", "_m.*")
        .withColumns({
            "live_count": F.sum("rows").over(in_order),
            "live_distinct": F.sum("vals").over(in_order),
        })
    )
    return counted.where((F.col("step") == 1) & ~F.col("carried")).select(
        *GROUP, *ORDER, "value", "live_count", "live_distinct"
    )


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _folder(specs: tuple[WindowSpec, ...], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fold = None
        out = _Rows(schema)
        for batch in batches:
            payload = batch.column("payload")
            columns = [
                batch.column(n).to_pylist()
                for n in ("rule_idx", "scope", "group_key", "slice", "ts_ns", "seq", "carried", "value")
            ]
            for n, (rule, scope, group, part, ns, seq, carried, value) in enumerate(zip(*columns)):
                if key != (rule, scope, group, part):
                    if fold is not None:
                        _emit(out, key, fold.exits(), None, True)
                    key = (rule, scope, group, part)
                    fold = SliceFold(specs[rule])
                fires = fold.push(ns, seq, value, carried)
                if fires:
                    _emit(out, key, fires, payload[n].as_py(), False)
            if len(out):
                yield out.flush()
        if fold is not None:
            _emit(out, key, fold.exits(), None, True)
        if len(out):
            yield out.flush()

    return run


def _emit(out: _Rows, key: tuple, fires: list[Fire], payload, last: bool) -> None:
    for f in fires:
        out.add(
            *key, last, f.position, f.live_from, f.values, f.entry_from, f.entry_to, f.wraps, payload
        )


def _resolver(schema: pa.Schema):
    """Entry of each slice that fired: the last fire of its group before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        group = part = entry = leaving = None
        for batch in batches:
            columns = [
                batch.column(n).to_pylist()
                for n in (*GROUP, "slice", "pos", "entry_from", "entry_to", "wraps")
            ]
            for rule, scope, name, number, pos, lower, upper, wraps in zip(*columns):
                if group != (rule, scope, name):
                    group, part, entry, leaving = (rule, scope, name), None, None, None
                if part != number:
                    entry, part = leaving, number
                    out.add(*group, number, entry)
                if entry_applies(entry, _tuple(lower), _tuple(upper), wraps):
                    leaving = _tuple(pos)
            if len(out):
                yield out.flush()

    return run


def _tuple(position: dict | None) -> tuple | None:
    return None if position is None else (position["ts_ns"], position["seq"], position["ord"])


class _Rows:
    """Output rows of a task, flushed as one Arrow batch."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def flush(self) -> pa.RecordBatch:
        arrays = []
        for column, field in zip(self.columns, self.schema):
            if field.name in _POSITIONS:
                column = [None if v is None else dict(zip(("ts_ns", "seq", "ord"), v)) for v in column]
            arrays.append(pa.array(column, field.type))
        self.columns = [[] for _ in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

"""Matches of the three rule families to signals with reproducible ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fleetsight.functions.json_text import Members, merge_json, non_empty, overwrite_json
from fleetsight.functions.paths import clean_path, path_text
from fleetsight.functions.times import ns_timestamp
from fleetsight.operators.match import per_rule, with_rule_meta
from fleetsight.operators.normalize import event_json

SIGNAL_COLUMNS = [
    "signal_id", "ts", "ts_ns", "host_id", "rule_id", "rule_description", "status", "severity",
    "title", "tags", "context", "source_seq",
]
# Fixed values of the signal record.
NEW_STATUS = "open"
NO_IDENTIFIER = "unknown"
CONTEXT_FIELDS = (
    "actor_path",
    "actor_team",
    "actor_signing_id",
    "target_path",
    "target_team",
    "target_sha256",
    "decision",
)
ARGS_PATH = "execution.args"


def signal_id(rule_id: Column, ts_ns: Column, host_id: Column, identifier: Column) -> Column:
    """32 hex digits over rule, time, host and identifier."""
    return F.substring(F.sha2(F.concat_ws("|", rule_id, ts_ns.cast("string"), host_id, identifier), 256), 1, 32)


def match_identifier() -> Column:
    """What a simple match is about: target, actor, its signing id and the decision."""
    target = F.coalesce(non_empty(F.col("target_sha256")), non_empty(F.col("target_path")))
    parts = F.concat_ws(
        "|",
        F.concat(F.lit("t="), target),
        F.concat(F.lit("a="), non_empty(F.col("actor_path"))),
        F.concat(F.lit("asid="), non_empty(F.col("actor_signing_id"))),
        F.concat(F.lit("dec="), non_empty(F.col("decision"))),
    )
    return F.coalesce(non_empty(parts), F.lit(NO_IDENTIFIER))


def message_context() -> list[tuple[str, Column]]:
    """Non-empty descriptive fields, and always the kind."""
    return [(n, non_empty(F.col(n))) for n in CONTEXT_FIELDS] + [("kind", F.col("kind"))]


def _put_extra(members: Members, events: DataFrame, paths: Sequence[str], strict: bool) -> None:
    """Adds the values at a rule's extra paths; empty values are left out."""
    for path in paths:
        if not path:
            continue
        name = clean_path(path)
        if name == ARGS_PATH:
            members.put(name, F.when(F.col("kind") == "execution", F.col("decoded_args")))
        else:
            members.put(name, non_empty(path_text(events, path, strict)))


def simple_context(events: DataFrame, rules: Sequence[Row], strict: bool = True) -> Column:
    """Context JSON of simple matches, with the event or extra paths where the rule asks.

    Rules that ask for the same share one expression. An extra path of a name that is there already
    replaces it where it has a value.
    """
    asking: dict[tuple, list[int]] = {}
    for idx, rule in enumerate(rules):
        asked = bool(rule["include_event"]), tuple(rule["extra_context"] or ())
        asking.setdefault(asked, []).append(idx)
    context = Members(message_context()).json()
    for (with_event, paths), members_of in asking.items():
        if not with_event and not paths:
            continue
        members = Members(message_context())
        if with_event:
            members.put("event", event_json(events), is_json=True)
        _put_extra(members, events, paths, strict)
        context = F.when(F.col("rule_idx").isin(members_of), members.json()).otherwise(context)
    return context


def enrich(signals: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Sets context members after the id is fixed, those that are there already too; NULL values change nothing."""
    return signals.withColumn("context", overwrite_json(F.coalesce("context", F.lit("{}")), list(fields.items())))


def signals_from_matches(matches: DataFrame, rules: Sequence[Row], strict: bool = True) -> DataFrame:
    """Signals of simple matches; keeps the columns of ``matches`` for later steps."""
    meta = with_rule_meta(matches, rules)
    return meta.withColumns({
        "context": simple_context(matches, rules, strict),
        "ts_ns": F.col("order_ns"),
        "ts": ns_timestamp(F.col("order_ns")),
        "host_id": F.col("machine_id"),
        "status": F.lit(NEW_STATUS),
        "source_seq": F.col("event_seq").cast("bigint"),
        "signal_id": signal_id(F.col("rule_id"), F.col("order_ns"), F.col("machine_id"), match_identifier()),
    })


def window_payload(events: DataFrame, rules: Sequence[Row], strict: bool = True) -> Column:
    """What a firing event hands to its signal: host, context and the group's values."""
    # Who acted is read from the signature of either block here.
    acting = {"actor_team": "team_id", "actor_signing_id": "signing_id"}
    context = Members()
    context.put("sample_event", event_json(events), is_json=True)
    for name in CONTEXT_FIELDS:
        if name in acting:
            value = F.coalesce(*[non_empty(F.col(f"{k}.instigator.code_signature.{acting[name]}")) for k in ("execution", "file_access")])
            context.put(name, value)
        elif name != "target_team":
            context.put(name, non_empty(F.col(name)))
    context.put("kind", F.col("kind"))

    def grouped_by(rule: Row) -> Column:
        return Members([(clean_path(p), non_empty(path_text(events, p, strict))) for p in rule["group_by"] or []]).json()

    return F.struct(
        F.col("machine_id").alias("host"),
        context.json().alias("context"),
        per_rule(rules, grouped_by, F.lit("{}")).alias("grouped_by"),
    )


def signals_from_windows(fires: DataFrame, rules: Sequence[Row]) -> DataFrame:
    """Signals of window fires. The time is that of the firing event, so ids are reproducible."""
    meta = with_rule_meta(fires, rules)
    distinct_field = per_rule(rules, lambda r: F.lit(r["count_distinct"] or None), F.lit(None).cast("string"))
    distinct = F.when(F.size("distinct_values") > 0, F.col("distinct_values"))
    grouped = F.nullif(F.col("payload.grouped_by"), F.lit("{}"))
    context = Members([
        ("event_count", F.col("event_count")),
        ("window_type", F.lit("correlation")),
        ("distinct_values", distinct),
        ("distinct_field", F.when(distinct.isNotNull(), distinct_field)),
    ])
    context.put("grouped_by", grouped, is_json=True)
    return meta.withColumns({
        "context": merge_json(context.json(), F.col("payload.context")),
        "ts": ns_timestamp(F.col("ts_ns")),
        "host_id": F.col("payload.host"),
        "status": F.lit(NEW_STATUS),
        "tags": F.concat(F.col("tags"), F.array(F.lit("correlation"))),
        "source_seq": F.col("seq"),
        "signal_id": signal_id(F.col("rule_id"), F.col("ts_ns"), F.col("payload.host"), F.col("group_key")),
    })


def signals_from_baselines(matches: DataFrame, rules: Sequence[Row]) -> DataFrame:
    """Signals of first-seen patterns; keeps the columns of ``matches``."""
    meta = with_rule_meta(matches.drop("rule_id"), rules)
    context = Members([("pattern", F.col("pattern")), ("in_learning", F.col("in_learning")), *message_context()]).json()
    return meta.withColumns({
        "context": context,
        "ts_ns": F.col("order_ns"),
        "ts": ns_timestamp(F.col("order_ns")),
        "host_id": F.col("machine_id"),
        "status": F.lit(NEW_STATUS),
        "tags": F.concat(F.col("tags"), F.array(F.lit("baseline"))),
        "source_seq": F.col("event_seq").cast("bigint"),
        "signal_id": signal_id(F.col("rule_id"), F.col("order_ns"), F.col("machine_id"), F.col("pattern")),
    })


def as_signals(df: DataFrame, *extra: str) -> DataFrame:
    """The common signal columns."""
    return df.select(*SIGNAL_COLUMNS, *extra)

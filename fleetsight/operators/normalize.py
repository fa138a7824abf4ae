"""Telemetry records to flat, defaulted columns that rules and signals read.

Text read through an unset block is ``''`` and a flag is ``false``, so predicates over these
columns never meet a NULL; ``has(x)`` is written ``x IS NOT NULL`` on the nested blocks, which
are kept beside the flat columns. Everything here is a projection: Catalyst prunes what a query
does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.base64_lists import decode_list
from fleetsight.functions.json_text import merge_json
from fleetsight.functions.times import parse_rfc3339, rfc3339_ns, timestamp_ns
from fleetsight.schema import ENUMS, KINDS, UNKNOWN_KIND

# Names an unset enum reads as.
UNSET_MODE = "MODE_UNKNOWN"
UNSET_REASON = "REASON_UNKNOWN"

#: When a record came in, for those that have no time of their own.
INGEST_TIME = "ingest_time"


def kind_of(df: DataFrame) -> Column:
    """The kind whose block is set, ``unknown`` when none is."""
    arms = " ".join(f"WHEN `{k}` IS NOT NULL THEN '{k}'" for k in KINDS if k in df.columns)
    return F.expr(f"CASE {arms} ELSE '{UNKNOWN_KIND}' END") if arms else F.lit(UNKNOWN_KIND)


def _text(path: str, default: str = "") -> str:
    return f"coalesce({path}, '{default}')"


def _enum(path: str, group: str) -> str:
    """Name of an enum that may come as digits; its zero value when unset."""
    names = ", ".join(f"'{n}'" for n in ENUMS[group])
    text = _text(path, ENUMS[group][0])
    digits = f"CASE WHEN {text} RLIKE '^[0-9]{{1,4}}$' THEN cast({text} AS int) END"
    return f"coalesce(get(array({names}), {digits}), {text})"


def _by_kind(cases: dict[str, str], default: str = "''") -> str:
    arms = " ".join(f"WHEN '{kind}' THEN {value}" for kind, value in cases.items())
    return f"CASE kind {arms} ELSE {default} END"


_EXEC, _FILE, _TCC, _LAUNCH = "execution", "file_access", "tcc_modification", "launch_item"
FLAT_COLUMNS = {
    "decision": _by_kind({
        _EXEC: _enum("execution.decision", "decision"),
        _FILE: _enum("file_access.policy_decision", "policy_decision"),
    }),
    "mode": _by_kind({_EXEC: _text("execution.mode", UNSET_MODE)}),
    "reason": _by_kind({_EXEC: _text("execution.reason", UNSET_REASON)}),
    "target_path": _by_kind({
        _EXEC: _text("execution.target.executable.path"),
        _FILE: _text("file_access.target.path"),
        "xprotect": _text("xprotect.detected.detected_path"),
    }),
    "target_sha256": _by_kind({_EXEC: _text("execution.target.executable.hash.hash")}),
    "target_team": _by_kind({_EXEC: _text("execution.target.code_signature.team_id")}),
    "target_signing_id": _by_kind({_EXEC: _text("execution.target.code_signature.signing_id")}),
    "actor_path": _by_kind({
        _EXEC: _text("execution.instigator.executable.path"),
        _FILE: _text("file_access.instigator.executable.path"),
    }),
    "actor_team": _by_kind({_FILE: _text("file_access.instigator.code_signature.team_id")}),
    "actor_signing_id": _by_kind({_FILE: _text("file_access.instigator.code_signature.signing_id")}),
    "actor_is_platform_binary": _by_kind(
        {_FILE: "coalesce(file_access.instigator.is_platform_binary, false)"}, "false"
    ),
    "decoded_args": _by_kind(
        {_EXEC: "coalesce(execution.args, cast(array() AS array<string>))"},
        "cast(array() AS array<string>)",
    ),
    "policy_name": _text("file_access.policy_name"),
    "tcc_service": _text("tcc_modification.service"),
    "tcc_identity": _text("tcc_modification.identity"),
    "tcc_right": _enum("tcc_modification.authorization_right", "authorization_right"),
    "tcc_reason": _enum("tcc_modification.authorization_reason", "authorization_reason"),
    "launch_action": _enum("launch_item.action", "launch_action"),
    "launch_item_type": _enum("launch_item.item_type", "launch_item_type"),
    "launch_legacy": "coalesce(launch_item.legacy, false)",
    "launch_item_path": _text("launch_item.item_path"),
    "launch_executable_path": _text("launch_item.executable_path"),
}


def _clock(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(TIMESTAMP, nanoseconds) of a time given as text or as a timestamp."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parse_rfc3339(F.col(name)), rfc3339_ns(F.col(name))
    ts = F.col(name).cast("timestamp")
    return ts, timestamp_ns(ts)


def _hashable(df: DataFrame, name: str) -> Column:
    """VARIANT values have no hash; their text has."""
    value = F.col(f"`{name}`")
    return F.to_json(value) if isinstance(df.schema[name].dataType, T.VariantType) else value


def normalize(df: DataFrame, args_encoding: str = "base64") -> DataFrame:
    """Flat columns beside the nested blocks; see the module text for defaults.

    Records are ordered by event time, else by the time they were processed, else by ``ingest_time``
    (given by readers of files, and dropped here), so that a signal of a record without a time has
    the time it came in. Without all three that is the epoch.
    """
    if "kind" not in df.columns:
        df = df.withColumn("kind", kind_of(df))
    event_time, event_ns = _clock(df, "event_time")
    processed_time, processed_ns = _clock(df, "processed_time")
    came_in = timestamp_ns(F.col(INGEST_TIME)) if INGEST_TIME in df.columns else F.lit(None).cast("bigint")
    fallback = F.coalesce(processed_ns, came_in, F.lit(0).cast("bigint"))
    clocks = {
        "event_time": event_time,
        "processed_time": processed_time,
        "event_time_ns": F.col("event_time_ns") if "event_time_ns" in df.columns else event_ns,
        "order_ns": F.coalesce(event_ns, fallback),
    }
    if "event_time_ns" in df.columns:
        clocks["order_ns"] = F.coalesce(F.col("event_time_ns"), fallback)
    if "event_seq" not in df.columns:
        content = [_hashable(df, c) for c in df.columns if c != INGEST_TIME]
        clocks["event_seq"] = F.xxhash64(*content)
    envelope = {n: F.expr(_text(n)) for n in ("machine_id", "boot_session_uuid")}
    df = df.withColumns({**envelope, **clocks})
    if args_encoding == "base64":
        decoded = {n: decode_list(F.col("execution." + n)) for n in ("args", "envs")}
        block = F.col("execution").withField("args", decoded["args"]).withField("envs", decoded["envs"])
        df = df.withColumn("execution", F.when(F.col("execution").isNotNull(), block))
    kept = [c for c in df.columns if c not in FLAT_COLUMNS and c != INGEST_TIME]
    return df.selectExpr(
        *[f"`{c}`" for c in kept], *[f"{sql} AS {name}" for name, sql in FLAT_COLUMNS.items()]
    )


def event_json(df: DataFrame) -> Column:
    """The whole event as JSON, unset fields of the set block included."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    envelope = (
        "to_json(struct(machine_id, boot_session_uuid, kind, "
        f'date_format(event_time, "{stamp}") AS event_time, '
        f'date_format(processed_time, "{stamp}") AS processed_time), '
        "map('ignoreNullFields', 'false'))"
    )
    def text(kind: str) -> str:
        # A VARIANT block has the members that its record had.
        is_open = isinstance(df.schema[kind].dataType, T.VariantType)
        return f"to_json(`{kind}`)" if is_open else f"to_json(`{kind}`, map('ignoreNullFields', 'false'))"

    arms = " ".join(
        f"""WHEN '{k}' THEN concat('{{"{k}":', {text(k)}, '}}')"""
        for k in KINDS
        if k in df.columns
    )
    block = F.expr(f"CASE kind {arms} END") if arms else F.lit(None).cast("string")
    return merge_json(F.expr(envelope), block)

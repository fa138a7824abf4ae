"""Telemetry, signal and heartbeat tables derived from the generic test tables.

``events`` and ``orders`` carry no endpoint telemetry, so each of their rows is read as one
record by plain per-row expressions. The expressions are text that other SQL engines accept too;
they only lay out inputs and hold no detection logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.times import ns_timestamp
from fleetsight.schema import KINDS, OPEN_KINDS
from fleetsight.session import pin_utc


def _cycle(divisor: int, values: list[str]) -> str:
    """CASE over ``floor(event_id / divisor) % n``."""
    index = f"cast(floor(event_id / {divisor}) AS bigint) % {len(values)}"
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE {values[-1]} END"


def _quoted(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


_HOME = "concat('/Users/u', user_id, '"

FLAT_EVENT = {
    "event_id": "event_id",
    "ts": "ts",
    "machine_id": "concat('host-', user_id % 10)",
    "boot_session_uuid": "concat('boot-', user_id % 10, '-', cast(floor(event_id / 500) AS bigint))",
    "kind": "CASE event_type WHEN 'click' THEN 'execution' WHEN 'view' THEN 'file_access' "
    "WHEN 'signup' THEN 'tcc_modification' WHEN 'purchase' THEN 'launch_item' ELSE 'xprotect' END",
    "decision": "CASE event_type WHEN 'click' THEN "
    + _cycle(1, _quoted("DECISION_UNKNOWN", "DECISION_ALLOW", "DECISION_DENY", "DECISION_ALLOW_COMPILER"))
    + " WHEN 'view' THEN "
    + _cycle(
        1,
        _quoted(
            "POLICY_DECISION_UNKNOWN",
            "POLICY_DECISION_DENIED",
            "POLICY_DECISION_DENIED_INVALID_SIGNATURE",
            "POLICY_DECISION_ALLOWED_AUDIT_ONLY",
        ),
    )
    + " END",
    "policy_name": "CASE WHEN event_type = 'view' THEN "
    + _cycle(
        1,
        _quoted("ChromeCookies", "CometCookies", "SSHPrivateKeys", "BrowserPasswords", "KeychainDB", "Other"),
    )
    + " END",
    "actor_path": "CASE WHEN event_type IN ('click', 'view') THEN "
    + _cycle(
        11,
        _quoted(
            "/bin/bash",
            "/Applications/Google Chrome.app/Contents/MacOS/Google Chrome",
            "/System/Library/x",
            "/opt/homebrew/bin/brew",
        )
        + [_HOME + "/tool')"],
    )
    + " END",
    "target_path": "CASE event_type WHEN 'click' THEN "
    + _cycle(
        5,
        ["'/usr/bin/curl'", _HOME + "/Downloads/a', event_id % 13)"]
        + _quoted("/Volumes/Disk/app", "/usr/bin/osascript", "/bin/launchctl", "/usr/bin/dscl"),
    )
    + f" WHEN 'view' THEN {_HOME}/secret', event_id % 7)"
    + " WHEN 'error' THEN CASE WHEN event_id % 3 <> 0 THEN concat('/tmp/mal', event_id % 7) END END",
    "target_sha256": "CASE WHEN event_type = 'click' AND event_id % 11 <> 0 THEN concat('h', event_id % 97) END",
    "cdhash": "CASE WHEN event_type = 'click' THEN concat('cd', event_id % 53) END",
    "target_team": "CASE WHEN event_type = 'click' THEN CASE cast(floor(event_id / 3) AS bigint) % 3 "
    "WHEN 1 THEN '' WHEN 2 THEN concat('TEAM', user_id % 4) END END",
    "actor_signing_id": "CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'com.apple.ssh' END",
    "user_name": "CASE WHEN event_type IN ('click', 'view') THEN concat('u', user_id % 7) END",
    "args_text": "CASE WHEN event_type = 'click' THEN "
    + _cycle(2, _quoted("x -authonly", "x display dialog hidden answer", "x"))
    + " END",
    "tcc_service": "CASE WHEN event_type = 'signup' THEN "
    + _cycle(
        1,
        _quoted(
            "kTCCServiceSystemPolicyAllFiles",
            "kTCCServiceCamera",
            "kTCCServiceMicrophone",
            "kTCCServiceScreenCapture",
            "kTCCServiceListenEvent",
            "kTCCServiceReminders",
        ),
    )
    + " END",
    "tcc_right": "CASE WHEN event_type = 'signup' THEN "
    + _cycle(
        7,
        _quoted("AUTHORIZATION_RIGHT_ALLOWED", "AUTHORIZATION_RIGHT_DENIED", "AUTHORIZATION_RIGHT_LIMITED"),
    )
    + " END",
    "tcc_reason": "CASE WHEN event_type = 'signup' THEN "
    + _cycle(
        2,
        _quoted("AUTHORIZATION_REASON_USER_CONSENT", "AUTHORIZATION_REASON_MDM_POLICY") + ["NULL"],
    )
    + " END",
    "tcc_identity": "CASE WHEN event_type = 'signup' THEN "
    + _cycle(3, ["'com.apple.Terminal'", "concat('dev.tool', event_id % 5)"])
    + " END",
    "launch_action": "CASE WHEN event_type = 'purchase' THEN "
    + _cycle(1, _quoted("ACTION_ADD", "ACTION_REMOVE"))
    + " END",
    "launch_item_type": "CASE WHEN event_type = 'purchase' THEN "
    + _cycle(2, _quoted("ITEM_TYPE_AGENT", "ITEM_TYPE_DAEMON", "ITEM_TYPE_APP"))
    + " END",
    "launch_legacy": "CASE WHEN event_type = 'purchase' THEN cast(floor(event_id / 3) AS bigint) % 2 = 0 END",
    "launch_item_path": "CASE WHEN event_type = 'purchase' THEN "
    + _cycle(4, [_HOME + "/Library/LaunchAgents/a.plist')", "'/Library/LaunchDaemons/d.plist'"])
    + " END",
    "launch_executable_path": "CASE WHEN event_type = 'purchase' THEN "
    + _cycle(5, [_HOME + "/bin/x')", "'/Volumes/D/x'", "'/usr/local/bin/x'", "NULL"])
    + " END",
    "detected": "event_type = 'error' AND event_id % 3 <> 0",
    "pid": "CASE WHEN event_type = 'click' THEN cast(cast(floor(event_id / 3) AS bigint) % 8 + 1 AS int) END",
    "parent_pid": "CASE WHEN event_type = 'click' THEN CASE "
    "WHEN cast(floor(event_id / 3) AS bigint) % 8 > 0 "
    "THEN cast(floor((cast(floor(event_id / 3) AS bigint) % 8 + 1) / 2) AS int) "
    "WHEN event_id % 3 = 0 THEN 5 END END",
}

SIGNAL_ROW = {
    "signal_id": "concat('s', o_orderkey)",
    "ts": "o_orderdate",
    "host_id": "concat('host-', o_custkey % 10)",
    "rule_id": "concat('SM-', lpad(cast(o_orderkey % 14 + 1 AS varchar(9)), 3, '0'))",
    "severity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
    "WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE '' END",
    "title": "concat('Detection ', o_orderpriority, ' on ', o_custkey)",
}

HEARTBEAT_ROW = {
    "agent_id": "concat('host-', user_id % 10)",
    "hb_time": "date_trunc('hour', ts)",
    "version": "concat('0.', event_id % 3)",
    "os_version": "concat('15.', event_id % 5)",
    "uptime_seconds": "value",
    "received_at": "ts",
}

_EXECUTION = """
named_struct(
  'decision', decision, 'reason', cast(NULL AS string), 'mode', cast(NULL AS string),
  'args', split(args_text, ' ', 2), 'envs', cast(NULL AS array<string>),
  'instigator', named_struct(
    'id', cast(NULL AS struct<pid:int,pidversion:int>),
    'executable', named_struct('path', actor_path),
    'code_signature', cast(NULL AS struct<team_id:string,signing_id:string>),
    'effective_user', named_struct('name', user_name)),
  'target', named_struct(
    'id', named_struct('pid', pid, 'pidversion', 1),
    'parent_id', CASE WHEN parent_pid IS NOT NULL THEN named_struct('pid', parent_pid, 'pidversion', 1) END,
    'responsible_id', cast(NULL AS struct<pid:int,pidversion:int>),
    'executable', named_struct('path', target_path,
        'hash', CASE WHEN target_sha256 IS NOT NULL THEN named_struct('hash', target_sha256) END,
        'cdhash', cdhash),
    'code_signature', CASE WHEN target_team IS NOT NULL
        THEN named_struct('team_id', target_team, 'signing_id', cast(NULL AS string)) END,
    'effective_user', named_struct('name', user_name, 'uid', cast(NULL AS int)),
    'effective_group', cast(NULL AS struct<name:string,gid:int>),
    'session_id', cast(NULL AS int), 'start_time', cast(NULL AS string)))
"""
_FILE_ACCESS = """
named_struct(
  'policy_name', policy_name, 'policy_decision', decision, 'target', named_struct('path', target_path),
  'instigator', named_struct(
    'executable', named_struct('path', actor_path),
    'code_signature', CASE WHEN actor_signing_id IS NOT NULL
        THEN named_struct('team_id', cast(NULL AS string), 'signing_id', actor_signing_id) END,
    'is_platform_binary', cast(NULL AS boolean),
    'effective_user', named_struct('name', user_name)))
"""
_TCC = """
named_struct('service', tcc_service, 'identity', tcc_identity, 'authorization_right', tcc_right,
  'authorization_reason', tcc_reason)
"""
_LAUNCH = """
named_struct('action', launch_action, 'item_type', launch_item_type, 'legacy', launch_legacy,
  'item_path', launch_item_path, 'executable_path', launch_executable_path)
"""
_XPROTECT = "named_struct('detected', CASE WHEN detected THEN named_struct('detected_path', target_path) END)"
_BLOCKS = {
    "execution": _EXECUTION,
    "file_access": _FILE_ACCESS,
    "tcc_modification": _TCC,
    "launch_item": _LAUNCH,
    "xprotect": _XPROTECT,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "events"), FLAT_EVENT)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested telemetry records: an envelope and one set block per row."""
    flat = flat_events(spark, sf_dir)
    blocks = []
    for kind in KINDS:
        body = _BLOCKS.get(kind)
        if body is None:
            blocks.append(f"cast(NULL AS variant) AS `{kind}`")
        else:
            blocks.append(f"CASE WHEN kind = '{kind}' THEN {body} END AS `{kind}`")
    return flat.selectExpr(
        "event_id AS event_seq",
        "machine_id",
        "boot_session_uuid",
        "cast(ts AS timestamp) AS event_time",
        "cast(NULL AS timestamp) AS processed_time",
        "kind",
        *blocks,
    )


#: Records of the kinds without typed fields, as JSON lines; every test row is one.
OPEN_LINE = {
    "event_seq": "event_id",
    "kind": _cycle(1, _quoted(*OPEN_KINDS)),
    "user_name": "concat('u', user_id % 7)",
    "success": "CASE WHEN event_id % 3 = 0 THEN 'false' ELSE 'true' END",
    "tries": "cast(event_id % 5 AS varchar(9))",
    "machine_id": "concat('host-', user_id % 10)",
    "event_time": "ts",
}
OPEN_BODY = (
    """concat('{"success":', success, ',"tries":', tries, ',"user":{"name":"', user_name, '","tags":["a",', tries, """
    """',1.50]},"note":null', CASE WHEN tries = '0' THEN '' ELSE ',"source":"s' || tries || '"' END, '}')"""
)
OPEN_STAMP = "2024-01-01T00:00:00Z"


def open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` (a JSON line) and ``event_seq``; all at one time, which windows then count by group."""
    rows = _project(table(spark, sf_dir, "events"), OPEN_LINE)
    line = F.concat(
        F.lit('{"machine_id":"'), "machine_id", F.lit(f'","event_time":"{OPEN_STAMP}","'), "kind", F.lit('":'), F.expr(OPEN_BODY), F.lit("}")
    )
    return rows.select("event_seq", line.alias("value"))


def signal_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), SIGNAL_ROW)


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _project(table(spark, sf_dir, "events"), HEARTBEAT_ROW)
    return rows.withColumn("hb_time", F.col("hb_time").cast("timestamp_ntz"))


def ntz(ns: Column) -> Column:
    """Zone-free timestamp of nanoseconds."""
    return ns_timestamp(ns).cast("timestamp_ntz")

"""Telemetry, rule and store schemas, plus the fixed vocabularies they use."""

from __future__ import annotations

from pyspark.sql import types as T

# The event kinds a telemetry record can carry.
KINDS = (
    "execution",
    "fork",
    "exit",
    "close",
    "rename",
    "unlink",
    "link",
    "exchangedata",
    "disk",
    "bundle",
    "allowlist",
    "file_access",
    "codesigning_invalidated",
    "login_window_session",
    "login_logout",
    "screen_sharing",
    "open_ssh",
    "authentication",
    "clone",
    "copyfile",
    "gatekeeper_override",
    "launch_item",
    "tcc_modification",
    "xprotect",
)
UNKNOWN_KIND = "unknown"

# Enum names by group; the position in the tuple is the wire number.
ENUMS = {
    "decision": (
        "DECISION_UNKNOWN",
        "DECISION_ALLOW",
        "DECISION_DENY",
        "DECISION_ALLOW_COMPILER",
    ),
    "policy_decision": (
        "POLICY_DECISION_UNKNOWN",
        "POLICY_DECISION_DENIED",
        "POLICY_DECISION_DENIED_INVALID_SIGNATURE",
        "POLICY_DECISION_ALLOWED_AUDIT_ONLY",
    ),
    "launch_action": (
        "ACTION_UNKNOWN",
        "ACTION_ADD",
        "ACTION_REMOVE",
    ),
    "launch_item_type": (
        "ITEM_TYPE_UNKNOWN",
        "ITEM_TYPE_USER_ITEM",
        "ITEM_TYPE_APP",
        "ITEM_TYPE_LOGIN_ITEM",
        "ITEM_TYPE_AGENT",
        "ITEM_TYPE_DAEMON",
    ),
    "authorization_right": (
        "AUTHORIZATION_RIGHT_UNKNOWN",
        "AUTHORIZATION_RIGHT_DENIED",
        "AUTHORIZATION_RIGHT_ALLOWED",
        "AUTHORIZATION_RIGHT_LIMITED",
        "AUTHORIZATION_RIGHT_ADD_MODIFY_ADDED",
        "AUTHORIZATION_RIGHT_SESSION_PID",
        "AUTHORIZATION_RIGHT_LEARN_MORE",
    ),
    "authorization_reason": (
        "AUTHORIZATION_REASON_UNKNOWN",
        "AUTHORIZATION_REASON_NONE",
        "AUTHORIZATION_REASON_ERROR",
        "AUTHORIZATION_REASON_USER_CONSENT",
        "AUTHORIZATION_REASON_USER_SET",
        "AUTHORIZATION_REASON_SYSTEM_SET",
        "AUTHORIZATION_REASON_SERVICE_POLICY",
        "AUTHORIZATION_REASON_MDM_POLICY",
        "AUTHORIZATION_REASON_SERVICE_OVERRIDE_POLICY",
        "AUTHORIZATION_REASON_MISSING_USAGE_STRING",
        "AUTHORIZATION_REASON_PROMPT_TIMEOUT",
        "AUTHORIZATION_REASON_PREFLIGHT_UNKNOWN",
        "AUTHORIZATION_REASON_ENTITLED",
        "AUTHORIZATION_REASON_APP_TYPE_POLICY",
        "AUTHORIZATION_REASON_PROMPT_CANCEL",
    ),
}

# Rule severities, signal states and store limits.
SEVERITIES = ("low", "medium", "high", "critical")
STATUSES = ("open", "acknowledged", "resolved")
SIGNAL_LIMITS = {
    "signal_id": 256,
    "ts": 64,
    "host_id": 255,
    "rule_id": 64,
    "rule_description": 2000,
    "status": 32,
    "severity": 32,
    "title": 512,
}
HEARTBEAT_LIMITS = {"agent_id": 255, "timestamp": 64, "version": 32, "os_version": 32}
MAX_TAGS = 50
MAX_TAG_LENGTH = 64
MAX_CONTEXT_LENGTH = 100_000

DEFAULT_MAX_EVENTS = 1000
DEFAULT_TREE_DEPTH = 8
DEFAULT_TREE_TTL = "1h"

_PROCESS_ID = "struct<pid:int,pidversion:int>"
_SIGNATURE = "struct<team_id:string,signing_id:string>"

# The blocks whose fields are read by shipped rules or accessors. Blocks of other kinds are VARIANT values, so every
# field that a record has is kept and can be named by a dotted path.
_BLOCKS = {
    "execution": (
        "struct<decision:string,reason:string,mode:string,"
        "args:array<string>,envs:array<string>,"
        f"instigator:struct<id:{_PROCESS_ID},executable:struct<path:string>,"
        f"code_signature:{_SIGNATURE},effective_user:struct<name:string>>,"
        f"target:struct<id:{_PROCESS_ID},parent_id:{_PROCESS_ID},responsible_id:{_PROCESS_ID},"
        "executable:struct<path:string,hash:struct<hash:string>,cdhash:string>,"
        f"code_signature:{_SIGNATURE},"
        "effective_user:struct<name:string,uid:int>,effective_group:struct<name:string,gid:int>,"
        "session_id:int,start_time:string>>"
    ),
    "file_access": (
        "struct<policy_name:string,policy_decision:string,target:struct<path:string>,"
        "instigator:struct<executable:struct<path:string>,"
        f"code_signature:{_SIGNATURE},is_platform_binary:boolean,"
        "effective_user:struct<name:string>>>"
    ),
    "tcc_modification": (
        "struct<service:string,identity:string,authorization_right:string,"
        "authorization_reason:string>"
    ),
    "launch_item": (
        "struct<action:string,item_type:string,legacy:boolean,item_path:string,"
        "executable_path:string>"
    ),
    "xprotect": "struct<detected:struct<detected_path:string>>",
}

OPEN_KINDS = tuple(k for k in KINDS if k not in _BLOCKS)

_ENVELOPE = (
    "machine_id string, boot_session_uuid string, event_time string, processed_time string"
)


def telemetry_ddl() -> str:
    """DDL of the raw record: an envelope and one nullable block per kind."""
    blocks = ", ".join(f"`{k}` {_BLOCKS.get(k, 'variant')}" for k in KINDS)
    return f"{_ENVELOPE}, {blocks}"


def telemetry_schema() -> T.StructType:
    return T.StructType.fromDDL(telemetry_ddl())


RULES_DDL = (
    "id string, title string, description string, expr string, severity string, "
    "tags array<string>, enabled boolean, extra_context array<string>, "
    "include_event boolean, include_process_tree boolean"
)
CORRELATIONS_DDL = (
    "id string, title string, description string, expr string, window string, "
    "group_by array<string>, count_distinct string, threshold int, severity string, "
    "tags array<string>, enabled boolean"
)
BASELINES_DDL = (
    "id string, title string, description string, expr string, track array<string>, "
    "severity string, tags array<string>, enabled boolean, learning_period string"
)


def catalogue_ddl() -> str:
    def array_of(ddl: str) -> str:
        fields = T.StructType.fromDDL(ddl)
        return f"array<{fields.simpleString()}>"

    return (
        f"rules {array_of(RULES_DDL)}, correlations {array_of(CORRELATIONS_DDL)}, "
        f"baselines {array_of(BASELINES_DDL)}"
    )

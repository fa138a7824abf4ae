"""The workload's queries restated as plain SQL, for checking on another engine."""

from __future__ import annotations

from fleetsight.plans.views import FLAT_EVENT, HEARTBEAT_ROW, OPEN_LINE, SIGNAL_ROW


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


T = "t AS (" + _select(FLAT_EVENT, "events") + ")"
SIG = "sig AS (" + _select(SIGNAL_ROW, "orders") + ")"
HB = "hb AS (" + _select(HEARTBEAT_ROW, "events") + ")"

# Flat columns with the defaults that rules and signals read.
N = (
    "n AS (SELECT event_id, ts, machine_id, boot_session_uuid, kind, coalesce(decision, '') AS decision, "
    "CASE WHEN kind = 'execution' THEN 'MODE_UNKNOWN' ELSE '' END AS mode, "
    "CASE WHEN kind = 'execution' THEN 'REASON_UNKNOWN' ELSE '' END AS reason, "
    "coalesce(target_sha256, '') AS target_sha256, coalesce(target_path, '') AS target_path, "
    "coalesce(actor_path, '') AS actor_path, coalesce(actor_signing_id, '') AS actor_signing_id, "
    "coalesce(target_team, '') AS target_team, coalesce(policy_name, '') AS policy_name, "
    "coalesce(cdhash, '') AS cdhash, coalesce(user_name, '') AS user_name, "
    "CASE WHEN args_text LIKE 'x %' THEN ['x', substr(args_text, 3)] WHEN args_text IS NULL THEN [] "
    "ELSE [args_text] END AS args, "
    "coalesce(tcc_service, '') AS tcc_service, coalesce(tcc_right, 'AUTHORIZATION_RIGHT_UNKNOWN') AS tcc_right, "
    "coalesce(tcc_reason, 'AUTHORIZATION_REASON_UNKNOWN') AS tcc_reason, coalesce(tcc_identity, '') AS tcc_identity, "
    "coalesce(launch_action, 'ACTION_UNKNOWN') AS launch_action, "
    "coalesce(launch_item_type, 'ITEM_TYPE_UNKNOWN') AS launch_item_type, "
    "coalesce(launch_legacy, false) AS launch_legacy, coalesce(launch_item_path, '') AS launch_item_path, "
    "launch_executable_path, detected, pid, parent_pid FROM t)"
)
BASE = f"{T}, {N}"
OPEN = "o AS (" + _select(OPEN_LINE, "events") + ")"
_TAGS = "concat('[a ', tries, ' 1.5]')"

_UNSIGNED = "kind = 'execution' AND decision = 'DECISION_ALLOW' AND target_team = ''"
_TCC = (
    "kind = 'tcc_modification' AND tcc_right = 'AUTHORIZATION_RIGHT_ALLOWED' "
    "AND tcc_reason <> 'AUTHORIZATION_REASON_USER_CONSENT' AND tcc_identity NOT LIKE 'com.apple.%'"
)
_ADDED = "kind = 'launch_item' AND launch_action = 'ACTION_ADD' AND launch_legacy"
RULES = [
    ("SM-001", "Cookie store read refused", "critical", "T1539,credential-access",
     "kind = 'file_access' AND policy_name IN ('ChromeCookies', 'CometCookies') AND decision = 'POLICY_DECISION_DENIED'"),
    ("SM-002", "SSH key file opened by a foreign program", "critical", "T1552.004,credential-access",
     "kind = 'file_access' AND policy_name IN ('SSHKeys', 'SSHPrivateKeys') AND actor_path NOT LIKE '/usr/bin/ssh%' "
     "AND actor_signing_id <> 'com.apple.ssh'"),
    ("SM-003", "Full disk access granted without the user", "critical", "T1548.006,defense-evasion,privilege-escalation",
     f"{_TCC} AND tcc_service = 'kTCCServiceSystemPolicyAllFiles'"),
    ("SM-004", "Capture permission granted without the user", "high", "T1548.006,collection,defense-evasion",
     f"{_TCC} AND tcc_service IN ('kTCCServiceCamera', 'kTCCServiceMicrophone', 'kTCCServiceScreenCapture', "
     "'kTCCServiceListenEvent')"),
    ("SM-005", "Built-in scanner found malware", "critical", "T1204.002,malware", "kind = 'xprotect' AND detected"),
    ("SM-006", "Agent added that starts a program in a home folder", "high", "T1543.001,persistence",
     f"{_ADDED} AND launch_item_type = 'ITEM_TYPE_AGENT' AND launch_item_path LIKE '/Users/%' "
     "AND launch_executable_path LIKE '/Users/%'"),
    ("SM-007", "Daemon added that starts a program off the system disk", "high", "T1543.004,persistence",
     f"{_ADDED} AND launch_item_type = 'ITEM_TYPE_DAEMON' AND (launch_executable_path LIKE '/Users/%' "
     "OR launch_executable_path LIKE '/Volumes/%')"),
    ("SM-008", "Unsigned program started where downloads land", "high", "T1204.002,execution",
     f"{_UNSIGNED} AND regexp_matches(target_path, '^/Users/.*/(Downloads|Desktop|Documents)/.*')"),
    ("SM-009", "Browser started an interpreter", "high", "T1059,T1204,initial-access",
     "kind = 'execution' AND target_path IN ('/usr/bin/osascript', '/bin/bash', '/bin/sh', '/usr/bin/python3', "
     "'/usr/bin/python', '/usr/bin/perl', '/usr/bin/ruby') AND (contains(actor_path, 'Google Chrome') "
     "OR contains(actor_path, 'Chromium'))"),
    ("SM-010", "Service control tool started by a third party", "high", "persistence",
     "kind = 'execution' AND target_path IN ('/bin/launchctl', '/usr/bin/launchctl') "
     "AND NOT regexp_matches(actor_path, '^(/System/Library/|/usr/libexec/|/usr/sbin/|/opt/homebrew/)') "
     "AND NOT regexp_matches(actor_path, '/(Terminal|iTerm|Visual Studio Code)\\.app/')"),
    ("SM-011", "Password checked against the local directory", "critical", "T1056.002,credential-access",
     "kind = 'execution' AND target_path = '/usr/bin/dscl' AND list_contains(args, '-authonly') "
     "AND NOT regexp_matches(actor_path, '^(/System/Library/|/usr/sbin/)')"),
    ("SM-012", "Script dialog asks for hidden input", "high", "T1056.002,credential-access,social-engineering",
     "kind = 'execution' AND target_path = '/usr/bin/osascript' "
     "AND len(list_filter(args, lambda a: contains(a, 'display dialog'))) > 0 "
     "AND len(list_filter(args, lambda a: contains(a, 'hidden answer'))) > 0 AND actor_path NOT LIKE '/System/Library/%'"),
    ("SM-013", "Unsigned program started from a mounted image", "high", "T1204.002,initial-access",
     f"{_UNSIGNED} AND target_path LIKE '/Volumes/%'"),
    ("SM-014", "Download tool started without a shell", "high", "T1105,command-and-control",
     "kind = 'execution' AND target_path IN ('/usr/bin/curl', '/usr/bin/wget') "
     "AND NOT regexp_matches(actor_path, '^(/bin/bash|/bin/zsh|/bin/sh|/opt/homebrew/)') "
     "AND NOT contains(actor_path, '/Homebrew/')"),
]


def _signal_id(rule: str, ts: str, host: str, identifier: str) -> str:
    return f"left(sha256(concat_ws('|', {rule}, cast(epoch_ns({ts}) AS varchar), {host}, {identifier})), 32)"


_TARGET = "coalesce(nullif(target_sha256, ''), nullif(target_path, ''))"
_IDENT = (
    f"coalesce(nullif(concat_ws('|', 't=' || {_TARGET}, 'a=' || nullif(actor_path, ''), "
    "'asid=' || nullif(actor_signing_id, ''), 'dec=' || nullif(decision, '')), ''), 'unknown')"
)
HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT n.*, {i} AS rule_idx, '{rid}' AS rule_id, '{title}' AS title, '{sev}' AS severity, '{tags}' AS tags, "
    f"{_signal_id(chr(39) + rid + chr(39), 'ts', 'machine_id', _IDENT)} AS signal_id FROM n WHERE {pred}"
    for i, (rid, title, sev, tags, pred) in enumerate(RULES)
) + ")"

SENSITIVE = (
    "kind = 'file_access' AND policy_name IN "
    "('ChromeCookies', 'CometCookies', 'SSHPrivateKeys', 'BrowserPasswords', 'KeychainDB')"
)
_ACTOR_KEY = "'file_access.instigator.executable.path=' || actor_path"


def _fold(name: str, where: str, scope: str, key: str, value: str, hours: int, threshold: int, cap: int, distinct: bool) -> str:
    """CTEs that step through each group one event at a time; fires are in ``<name>``."""
    count = "len(list_distinct(list_filter(list_transform(live, lambda e: e.v), lambda v: v <> '')))" if distinct else "len(live)"
    step = (
        f"list_filter(list_append(CASE WHEN f.fired THEN [] ELSE f.live END, {{'ts': e.ts, 'v': e.v}}), "
        f"lambda x: e.ts - x.ts <= INTERVAL {hours} HOUR)"
    )
    return f"""
{name}_e AS (
  SELECT *, row_number() OVER (PARTITION BY scope, group_key ORDER BY ts, event_id) AS i
  FROM (SELECT event_id, ts, {scope} AS scope, {key} AS group_key, {value} AS v FROM n WHERE {where}) x),
{name}_f AS (
  SELECT scope, group_key, i, event_id, ts, live, {count} >= {threshold} AS fired
  FROM (SELECT scope, group_key, i, event_id, ts, [{{'ts': ts, 'v': v}}] AS live FROM {name}_e WHERE i = 1) s
  UNION ALL
  SELECT scope, group_key, i, event_id, ts, live, {count} >= {threshold} AS fired
  FROM (SELECT e.scope, e.group_key, e.i, e.event_id, e.ts, list_slice({step}, -{cap}, -1) AS live
        FROM {name}_f f JOIN {name}_e e ON e.scope = f.scope AND e.group_key = f.group_key AND e.i = f.i + 1) s),
{name} AS (SELECT * FROM {name}_f WHERE fired)"""


def _first_values(live: str) -> str:
    """Distinct values in order of first appearance."""
    values = f"list_transform({live}, lambda e: e.v)"
    return (
        f"list_filter({values}, lambda v, i: v <> '' AND list_position({values}, v) = i)"
    )


def _fires(name: str, threshold: int, distinct: bool) -> str:
    values = f"array_to_string({_first_values('live')}, ',')" if distinct else "''"
    return (
        "SELECT scope, group_key, event_id, ts AS fired_at, live[1].ts AS live_from, "
        f"cast({threshold} AS int) AS event_count, {values} AS \"values\" FROM {name}"
    )


_DISTINCT = _fold("d", SENSITIVE, "machine_id", _ACTOR_KEY, "policy_name", 72, 3, 1000, True)
_COUNT = _fold("c", SENSITIVE, "machine_id", _ACTOR_KEY, "''", 72, 3, 1000, False)
_BURST = _fold(
    "b", "kind = 'execution' AND decision = 'DECISION_DENY'", "machine_id",
    "'execution.target.executable.path=' || target_path || '|machine_id=' || machine_id", "''", 36, 2, 1000, False,
)

_HASH_WHERE = "kind = 'execution' AND target_path <> '' AND target_sha256 <> ''"
_HASH_PATTERN = "'execution.target.executable.path=' || target_path || '|execution.target.executable.hash.hash=' || target_sha256"
_UNS_WHERE = "kind = 'execution' AND target_path LIKE '/Users/%' AND target_team = ''"
_UNS_PATTERN = "'execution.target.executable.cdhash=' || cdhash"
PATTERNS = (
    f"pat AS (SELECT n.*, 'B-UNSIGNED' AS rule_id, {_UNS_PATTERN} AS pattern FROM n WHERE {_UNS_WHERE} "
    f"UNION ALL SELECT n.*, 'B-HASH' AS rule_id, {_HASH_PATTERN} AS pattern FROM n WHERE {_HASH_WHERE})"
)
FIRST = (
    "fs AS (SELECT * FROM pat QUALIFY row_number() OVER "
    "(PARTITION BY rule_id, machine_id, pattern ORDER BY ts, event_id) = 1)"
)

NODES = (
    "nodes AS (SELECT event_id, ts, machine_id, boot_session_uuid AS boot, pid, 1 AS pidversion, parent_pid, "
    "CASE WHEN parent_pid IS NOT NULL THEN 1 END AS parent_pidversion, target_path AS path, user_name AS \"user\", args, "
    "lead(ts) OVER (PARTITION BY machine_id, boot_session_uuid, pid ORDER BY ts, event_id) AS until "
    "FROM n WHERE kind = 'execution')"
)


def _chain(starts: str, depth: int, hours: int | None) -> str:
    fresh = f"AND p.ts >= c.match_ts - INTERVAL {hours} HOUR" if hours else ""
    return f"""
chain AS (
  SELECT event_id AS match_id, ts AS match_ts, 0 AS depth, machine_id, boot, pid, parent_pid, path, "user", [pid] AS seen
  FROM nodes WHERE {starts}
  UNION ALL
  SELECT c.match_id, c.match_ts, c.depth + 1, c.machine_id, c.boot, p.pid, p.parent_pid, p.path, p."user",
    list_append(c.seen, p.pid)
  FROM chain c JOIN nodes p ON p.machine_id = c.machine_id AND p.boot = c.boot AND p.pid = c.parent_pid
    AND p.ts <= c.match_ts AND (p.until IS NULL OR p.until > c.match_ts) {fresh}
  WHERE c.depth + 1 < {depth} AND NOT list_contains(c.seen, p.pid))"""


_CURL = "path = '/usr/bin/curl'"
_CHAIN_ROWS = "SELECT match_id AS event_id, cast(depth AS int) AS depth, pid, path FROM chain"

_DERIVED_RULES = """
r AS (SELECT o_orderkey % 3 AS fam, o_orderkey,
    CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('R-', o_orderkey % 9000) END AS id,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'title' END AS title,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'true' END AS expr,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
      WHEN '5-LOW' THEN '' ELSE 'info' END AS severity,
    o_orderkey % 13 = 0 AS no_window, o_custkey % 5 - 1 AS threshold, o_orderkey % 17 = 0 AS empty_field,
    concat('file-', o_orderkey % 40) AS file
  FROM orders),
f AS (SELECT *, CASE fam WHEN 0 THEN 'rules' WHEN 1 THEN 'correlations' ELSE 'baselines' END AS family FROM r)
"""
_SEVERITY_OK = "('low', 'medium', 'high', 'critical')"
_VIOLATIONS = f"""
SELECT id AS rule_id, 'all' AS family, 'duplicate' AS "check",
  'found in both ' || min(file) || ' and ' || max(file) AS detail FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, family, 'required', 'id is required' FROM f WHERE id = ''
UNION ALL SELECT id, family, 'required', 'title is required' FROM f WHERE title = ''
UNION ALL SELECT id, family, 'required', 'expr is required' FROM f WHERE expr IS NULL
UNION ALL SELECT id, family, 'required', 'severity is required' FROM f WHERE severity = ''
UNION ALL SELECT id, family, 'severity', 'invalid severity: ' || severity FROM f
  WHERE severity <> '' AND severity NOT IN {_SEVERITY_OK}
UNION ALL SELECT id, family, 'required', 'window is required' FROM f WHERE fam = 1 AND no_window
UNION ALL SELECT id, family, 'threshold', 'threshold must be greater than 0' FROM f WHERE fam = 1 AND threshold <= 0
UNION ALL SELECT id, family, 'group_by', 'group_by has an empty field' FROM f WHERE fam = 1 AND empty_field
UNION ALL SELECT id, family, 'required', 'track is required' FROM f WHERE fam = 2 AND threshold = 0
UNION ALL SELECT id, family, 'track', 'track has an empty field' FROM f WHERE fam = 2 AND threshold <> 0 AND empty_field
"""

_FIXED6 = "regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '')"


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


_NF = lambda c: f"nullif({c}, '')"
_QUEUE = (
    f"{SIG}, q AS (SELECT signal_id, host_id, CASE WHEN signal_id LIKE '%00' THEN '' ELSE rule_id END AS rule_id, "
    "ts AS enqueued_at FROM sig)"
)
_SHIPPED = "sh AS (SELECT concat('s', event_id) AS signal_id FROM events WHERE event_type = 'click')"
_QUEUED = (
    "qd AS (SELECT * FROM q WHERE rule_id <> '' AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.signal_id = q.signal_id))"
)
_UPDATES = (
    "u AS (SELECT concat('s', event_id * 3) AS signal_id, ts AS updated_at, event_id, CASE event_type "
    "WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'resolved' WHEN 'error' THEN 'closed' ELSE 'open' END AS status "
    "FROM events)"
)
_ARRIVALS = (
    "a AS (SELECT concat('s', cast(substr(signal_id, 2) AS bigint) % 5000) AS signal_id, "
    "cast(substr(signal_id, 2) AS bigint) AS arrival, host_id, title FROM sig), "
    "st AS (SELECT DISTINCT signal_id FROM sig WHERE rule_id = 'SM-003')"
)
_FILES = "files AS (SELECT concat('spool-', event_id // 40) AS path, max(ts) AS mtime FROM events GROUP BY 1)"
_STATUS = "coalesce(nullif(status, ''), 'open')"
_SHORT = (
    "CASE WHEN strlen({x}) > 60 AND len(string_split({x}, '/')) > 3 THEN "
    "CASE WHEN string_split({x}, '/')[1] = '' THEN '/' || string_split({x}, '/')[2] ELSE string_split({x}, '/')[1] END "
    "|| '/.../' || array_to_string(list_slice(string_split({x}, '/'), -2, -1), '/') ELSE {x} END"
)


def _short(x: str) -> str:
    return _SHORT.replace("{x}", x)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["normalize_fields"] = _with(
        BASE,
        "SELECT event_id, ts AS event_time, machine_id, kind, decision, mode, reason, target_sha256, target_path, "
        "actor_path, '' AS actor_team, actor_signing_id, false AS actor_is_platform_binary, target_team, "
        "'' AS target_signing_id, array_to_string(args, ',') AS args FROM n",
    )
    sql["extract_path_values"] = _with(
        BASE,
        "SELECT event_id, CASE WHEN kind = 'execution' THEN target_path ELSE '' END AS exe_path, policy_name AS policy, "
        "machine_id AS machine, CASE WHEN kind = 'launch_item' THEN cast(launch_legacy AS varchar) ELSE '' END AS legacy, "
        "coalesce(cast(pid AS varchar), '') AS pid, "
        "CASE WHEN kind = 'execution' THEN '[' || array_to_string(args, ' ') || ']' ELSE '' END AS args, '' AS missing FROM n",
    )
    sql["value_text"] = (
        f"SELECT event_id, {_FIXED6.format(x='value')} AS value_text, "
        f"{_FIXED6.format(x='cast(event_id AS double)')} AS id_text, cast(value > 50 AS varchar) AS flag_text FROM events"
    )
    sql["json_field_extract"] = _with(
        BASE,
        "SELECT n.event_id, kind, CASE WHEN kind = 'execution' THEN target_path END AS exe_path, "
        "CASE WHEN kind = 'file_access' THEN policy_name END AS policy, machine_id AS machine, "
        "json_extract_string(e.props, '$.k') AS k FROM n JOIN events e ON e.event_id = n.event_id",
    )
    sql["json_lines_scan"] = _with(
        BASE,
        "SELECT concat('spool-', event_id // 100) AS source_file, kind, count(*) AS events, count(DISTINCT ts) AS times, "
        "max(ts) AS last_time, min(target_path) AS first_target, max(array_to_string(args, ',')) AS last_args "
        "FROM n GROUP BY 1, 2",
    )
    sql["frame_extract"] = (
        "SELECT concat('spool-', event_id // 50) AS source_file, cast(row_number() OVER (PARTITION BY event_id // 50 "
        "ORDER BY event_id) - 1 AS int) AS frame_no, concat(event_id, ',', event_type) AS payload, "
        "cast(NULL AS varchar) AS error FROM events"
    )
    sql["enum_lookup"] = _with(
        T,
        "SELECT event_id, cast(CASE decision WHEN 'DECISION_UNKNOWN' THEN 0 WHEN 'DECISION_ALLOW' THEN 1 "
        "WHEN 'DECISION_DENY' THEN 2 WHEN 'DECISION_ALLOW_COMPILER' THEN 3 WHEN 'POLICY_DECISION_UNKNOWN' THEN 0 "
        "WHEN 'POLICY_DECISION_DENIED' THEN 1 WHEN 'POLICY_DECISION_DENIED_INVALID_SIGNATURE' THEN 2 "
        "WHEN 'POLICY_DECISION_ALLOWED_AUDIT_ONLY' THEN 3 ELSE CASE tcc_right WHEN 'AUTHORIZATION_RIGHT_DENIED' THEN 1 "
        "WHEN 'AUTHORIZATION_RIGHT_ALLOWED' THEN 2 WHEN 'AUTHORIZATION_RIGHT_LIMITED' THEN 3 ELSE CASE launch_item_type "
        "WHEN 'ITEM_TYPE_APP' THEN 2 WHEN 'ITEM_TYPE_AGENT' THEN 4 WHEN 'ITEM_TYPE_DAEMON' THEN 5 END END END AS int) AS number, "
        "cast(CASE tcc_reason WHEN 'AUTHORIZATION_REASON_USER_CONSENT' THEN 3 WHEN 'AUTHORIZATION_REASON_MDM_POLICY' THEN 7 "
        "END AS int) AS reason_number, CASE event_id % 5 WHEN 0 THEN 'DECISION_UNKNOWN' WHEN 1 THEN 'DECISION_ALLOW' "
        "WHEN 2 THEN 'DECISION_DENY' WHEN 3 THEN 'DECISION_ALLOW_COMPILER' ELSE '4' END AS name_of_number FROM t",
    )
    sql["rule_violations"] = _with(_DERIVED_RULES, _VIOLATIONS)
    sql["predicate_matrix"] = _with(
        BASE,
        """SELECT event_id, kind = 'execution' AS p_eq, decision <> 'DECISION_ALLOW' AS p_ne,
        policy_name IN ('ChromeCookies', 'KeychainDB') AS p_in, kind = 'execution' AND target_team = '' AS p_and,
        target_path LIKE '/Users/%' OR target_path LIKE '/Volumes/%' AS p_or, actor_path NOT LIKE '/System/%' AS p_not,
        target_path LIKE '/usr/bin/%' AS p_starts, target_path LIKE '%curl' AS p_ends, actor_path LIKE '%Chrome%' AS p_contains,
        regexp_matches(target_path, '^/Users/.*/(Downloads|Desktop)/a[0-9]+$') AS p_matches,
        kind = 'xprotect' AND detected AS p_has,
        len(list_filter(args, lambda a: contains(a, 'dialog'))) > 0 AS p_exists,
        len(list_filter(args, lambda a: length(a) >= 10)) = 0 AS p_all,
        len(list_filter(args, lambda a: a = 'x')) = 1 AS p_exists_one, list_contains(args, 'x') AS p_map,
        event_id % 7 = 3 AND event_id + 1 > 5 AS p_arith,
        CASE WHEN kind = 'execution' THEN decision ELSE policy_name END = 'DECISION_DENY' AS p_ternary,
        len(args) >= 2 AS p_size, coalesce(try_cast(substr(target_sha256, 2) AS int) > 50, false) AS p_cast,
        month(ts) = 1 AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) < 5 AS p_time, coalesce(args[1] = 'x', false) AS p_index,
        decision IN ('DECISION_DENY', 'DECISION_ALLOW_COMPILER') AS p_enum_order, true AS p_literal, false AS p_bad_cast
        FROM n""",
    )
    sql["arg_exists"] = _with(
        BASE,
        "SELECT event_id, cast(len(args) AS int) AS n_args, array_to_string(args, '|') AS args FROM n "
        "WHERE list_contains(args, '-authonly')",
    )
    sql["simple_signals"] = _with(
        f"{BASE}, {HITS}",
        "SELECT signal_id, ts, machine_id AS host_id, rule_id, 'open' AS status, severity, title, tags, "
        f"{_NF('actor_path')} AS c_actor_path, {_NF('actor_signing_id')} AS c_actor_signing_id, "
        f"{_NF('target_path')} AS c_target_path, {_NF('target_team')} AS c_target_team, "
        f"{_NF('target_sha256')} AS c_target_sha256, {_NF('decision')} AS c_decision, kind AS c_kind, "
        "CASE WHEN rule_id = 'SM-014' THEN args[2] END AS c_arg FROM hits",
    )
    all_rules = ", ".join(f"('{rid}', '{sev}')" for rid, _, sev, _, _ in RULES)
    sql["rule_match_counts"] = _with(
        f"{BASE}, {HITS}",
        f"SELECT r.rule_id, r.severity, count(h.rule_id) AS matches FROM (VALUES {all_rules}) r(rule_id, severity) "
        "LEFT JOIN hits h ON h.rule_id = r.rule_id GROUP BY 1, 2",
    )
    sql["rule_isolation"] = _with(
        BASE,
        "SELECT event_id, rule_id, family FROM n, (VALUES ('GOOD'), ('PARTLY')) r(rule_id), "
        "(VALUES ('rules'), ('correlations'), ('baselines')) f(family) "
        "WHERE kind = 'file_access' AND (rule_id = 'GOOD' OR event_id % 2 = 1)",
    )
    sql["context_merge"] = _with(
        BASE,
        "SELECT event_id, rule_id, 'a' AS tag, CASE WHEN rule_id = 'ALL' THEN cast(event_id AS varchar) "
        "WHEN event_id % 2 = 0 THEN 'changed' ELSE kind END AS c_kind, "
        "CASE WHEN rule_id = 'FILES' THEN machine_id END AS c_machine_id, "
        "CASE WHEN rule_id = 'FILES' THEN nullif(policy_name, '') END AS c_policy_name, "
        "nullif(target_path, '') AS c_target_path, nullif(decision, '') AS c_decision, "
        "CASE WHEN event_id % 6 = 0 THEN 'again' WHEN event_id % 3 = 0 THEN 'true' END AS c_first_seen, "
        "CASE WHEN rule_id = 'RUNS' THEN kind END AS c_event_kind, "
        "CASE WHEN rule_id = 'FILES' THEN nullif(policy_name, '') END AS c_file_policy, "
        "CASE WHEN rule_id = 'RUNS' THEN args[1] END AS c_arg, "
        "CASE WHEN rule_id = 'RUNS' THEN target_path END AS c_event_path "
        "FROM n, (VALUES ('FILES', 'file_access'), ('RUNS', 'execution'), ('ALL', NULL)) r(rule_id, only_kind) "
        "WHERE only_kind IS NULL OR only_kind = kind",
    )
    sql["open_kind_fields"] = _with(
        OPEN,
        f"SELECT event_seq AS event_id, kind, success, user_name, {_TAGS} AS tags, "
        f"concat('map[name:', user_name, ' tags:', {_TAGS}, ']') AS user_text, '' AS note, '' AS missing, "
        "CASE WHEN kind = 'authentication' THEN user_name END AS event_user FROM o",
    )
    sql["open_kind_signals"] = _with(
        OPEN,
        "SELECT event_seq AS event_id, 'AUTH' AS rule_id, user_name AS c_user, CASE WHEN tries <> '0' THEN 's' || tries END AS c_source, "
        "NULL AS c_tags, tries AS c_event_tries, 'a' AS c_event_tag, kind AS c_kind FROM o "
        "WHERE kind = 'authentication' AND success = 'false' UNION ALL "
        f"SELECT event_seq, 'LOGIN', NULL, NULL, {_TAGS}, NULL, NULL, kind FROM o "
        "WHERE kind = 'login_logout' AND cast(tries AS int) > 2",
    )
    failed = "kind = 'authentication' AND success = 'false'"
    sql["open_kind_keys"] = _with(
        OPEN,
        f"SELECT event_seq AS event_id, 'FAILED' AS rule_id, concat('authentication.user.name=', user_name) AS key, '' AS value FROM o WHERE {failed} "
        "UNION ALL SELECT event_seq, 'SOURCES', '_global', CASE WHEN tries = '0' THEN '' ELSE 's' || tries END FROM o WHERE kind = 'open_ssh' "
        "UNION ALL SELECT NULL, 'FAILED-FIRES', concat('authentication.user.name=', user_name), '2' FROM "
        f"(SELECT user_name, unnest(range(count(*) // 2)) FROM o WHERE {failed} GROUP BY machine_id, user_name) "
        "UNION ALL SELECT event_seq, 'USERS', concat('screen_sharing.user.name=', user_name, '|screen_sharing.tries=', tries), '' "
        "FROM o WHERE kind = 'screen_sharing'",
    )
    sql["artifact_first_seen"] = _with(
        f"{BASE}, {HITS}",
        "SELECT signal_id, rule_id, target_sha256, CASE WHEN target_sha256 <> '' AND row_number() OVER "
        "(PARTITION BY machine_id, target_sha256 ORDER BY ts, event_id, rule_idx) = 1 THEN 'true' ELSE '' END AS first_seen "
        "FROM hits",
    )
    first = f"{BASE}, {PATTERNS}, {FIRST}"
    sql["baseline_first_seen"] = _with(
        first,
        f"SELECT {_signal_id('rule_id', 'ts', 'machine_id', 'pattern')} AS signal_id, ts, machine_id AS host_id, rule_id, "
        "pattern, 't,baseline' AS tags, 'new' AS rule_description, pattern AS c_pattern, 'false' AS c_in_learning, "
        "target_path AS c_target_path FROM fs",
    )
    sql["baseline_learning"] = _with(
        first,
        "SELECT rule_id, machine_id, pattern, ts AS first_time, rule_id = 'B-HASH' AND "
        "ts < TIMESTAMP '2024-01-01' + INTERVAL 168 HOUR AS in_learning FROM fs",
    )
    sql["baseline_fleet"] = _with(
        f"{BASE}, {PATTERNS}",
        "SELECT rule_id, 'fleet' AS scope, pattern, event_id, machine_id FROM pat WHERE rule_id = 'B-HASH' "
        "QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY ts, event_id) = 1",
    )
    sql["first_seen_stats"] = _with(
        f"{BASE}, {PATTERNS}",
        "SELECT machine_id AS scope, pattern, min(ts) AS first_time, max(ts) AS last_time, count(*) AS sightings "
        "FROM pat WHERE rule_id = 'B-HASH' GROUP BY 1, 2",
    )
    sql["first_seen_incremental"] = _with(
        f"{BASE}, {PATTERNS}",
        "SELECT machine_id, pattern, min(ts) AS first_time FROM pat WHERE rule_id = 'B-HASH' GROUP BY 1, 2 "
        "HAVING min(ts) >= TIMESTAMP '2024-01-11'",
    )
    sql["first_seen_merge"] = _with(
        f"{BASE}, {PATTERNS}",
        "SELECT machine_id AS scope, pattern, min(ts) AS first_time, count(*) AS sightings FROM pat "
        "WHERE rule_id = 'B-HASH' GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR",
    )
    sql["group_keys"] = _with(
        BASE,
        f"SELECT {_ACTOR_KEY} || '|file_access.policy_name=' || policy_name || '|nonexistent.field=' AS group_key, "
        f"count(*) AS events FROM n WHERE {SENSITIVE} GROUP BY 1",
    )
    sql["correlation_count"] = _with(f"{BASE}, {_COUNT}", _fires("c", 3, False), True)
    sql["correlation_distinct"] = _with(f"{BASE}, {_DISTINCT}", _fires("d", 3, True), True)
    fleet = _fold("g", SENSITIVE, "'fleet'", "'_global'", "policy_name", 72, 4, 5, True)
    sql["correlation_global"] = _with(f"{BASE}, {fleet}", _fires("g", 4, True), True)
    fleet_count = _fold("h", SENSITIVE, "'fleet'", "'_global'", "''", 72, 4, 1000, False)
    sql["correlation_fleet_count"] = _with(f"{BASE}, {fleet_count}", _fires("h", 4, False), True)
    many = " UNION ALL ".join(
        f"SELECT cast({i} AS int) AS rule_idx, count(*) AS fires, count(DISTINCT (scope, group_key)) AS groups, "
        f"max(ts) AS last_fire FROM {name}"
        for i, name in enumerate(("d", "b", "c"))
    )
    sql["correlation_many"] = _with(f"{BASE}, {_DISTINCT}, {_BURST}, {_COUNT}", many, True)
    frame = "OVER (PARTITION BY machine_id, actor_path ORDER BY ts RANGE BETWEEN INTERVAL 72 HOUR PRECEDING AND CURRENT ROW)"
    sql["correlation_prefilter"] = _with(
        BASE,
        f"SELECT machine_id AS scope, {_ACTOR_KEY} AS group_key, event_id, count(*) {frame} AS live_count, "
        f"count(DISTINCT policy_name) {frame} AS live_distinct FROM n WHERE {SENSITIVE}",
    )
    sql["correlation_signals"] = _with(
        f"{BASE}, {_DISTINCT}",
        f"SELECT {_signal_id(chr(39) + 'C-DISTINCT' + chr(39), 'd.ts', 'd.scope', 'd.group_key')} AS signal_id, d.ts, "
        "d.scope AS host_id, 'C-DISTINCT' AS rule_id, 'correlation' AS tags, '3' AS c_count, 'correlation' AS c_type, "
        f"'event.file_access.policy_name' AS c_field, ({_first_values('d.live')})[1] AS c_first_value, "
        "n.actor_path AS c_actor, n.target_path AS c_sample_path, n.target_path AS c_target_path, "
        "n.decision AS c_decision, n.kind AS c_kind FROM d JOIN n ON n.event_id = d.event_id",
        True,
    )
    sql["process_nodes"] = _with(
        f"{BASE}, {NODES}",
        "SELECT event_id, machine_id, boot, pid, pidversion, parent_pid, parent_pidversion, path, \"user\", "
        "array_to_string(args, ',') AS args FROM nodes",
    )
    sql["process_chain"] = _with(f"{BASE}, {NODES}, {_chain(_CURL, 8, None)}", _CHAIN_ROWS, True)
    sql["process_chain_ttl"] = _with(f"{BASE}, {NODES}, {_chain(_CURL, 3, 24)}", _CHAIN_ROWS, True)
    hits14 = "event_id IN (SELECT event_id FROM hits WHERE rule_id = 'SM-014')"
    sql["process_tree"] = _with(
        f"{BASE}, {HITS}, {NODES}, {_chain(hits14, 8, None)}",
        "SELECT h.signal_id, h.rule_id, string_agg(concat_ws(':', c.depth, CASE c.depth WHEN 0 THEN 'target' "
        "WHEN 1 THEN 'parent' ELSE 'ancestor' END, c.pid, c.path, c.\"user\"), '>' ORDER BY c.depth) AS tree "
        "FROM hits h JOIN chain c ON c.match_id = h.event_id WHERE h.rule_id = 'SM-014' GROUP BY 1, 2",
        True,
    )
    sql["latest_processes"] = _with(
        f"{BASE}, {NODES}",
        "SELECT machine_id, boot, pid, pidversion, event_id, path FROM nodes WHERE until IS NULL",
    )
    sql["ingest_validation"] = _with(
        SIG + """, v AS (SELECT signal_id, rule_id, severity, status, ts,
          CASE WHEN signal_id LIKE '%77' THEN length(title) * 40 ELSE length(title) END AS title_len,
          CASE WHEN signal_id LIKE '%55' THEN NULL ELSE host_id END AS host_id,
          CASE WHEN signal_id LIKE '%991' THEN 100001 ELSE 2 END AS context_len FROM sig),
        w AS (SELECT signal_id, concat_ws(',',
          CASE WHEN host_id IS NULL THEN 'host_id missing' END,
          CASE WHEN title_len > 512 THEN 'title too long' END,
          CASE WHEN severity NOT IN ('low', 'medium', 'high', 'critical') THEN 'severity invalid' END,
          CASE WHEN status NOT IN ('open', 'acknowledged', 'resolved') THEN 'status invalid' END,
          CASE WHEN signal_id LIKE '%33' THEN 'too many tags' END,
          CASE WHEN signal_id LIKE '%34' THEN 'tag too long' END,
          CASE WHEN context_len > 100000 THEN 'context too large' END) AS reasons FROM v)""",
        "SELECT signal_id, reasons = '' AS accepted, reasons FROM w",
    )
    sql["ingest_dedupe"] = _with(
        f"{SIG}, {_ARRIVALS}",
        "SELECT arrival, a.signal_id, row_number() OVER (PARTITION BY a.signal_id ORDER BY arrival) > 1 "
        "OR st.signal_id IS NOT NULL AS duplicate FROM a LEFT JOIN st ON st.signal_id = a.signal_id",
    )
    sql["ingest_new"] = _with(
        f"{SIG}, {_ARRIVALS}",
        "SELECT signal_id, arrival, host_id, title FROM a WHERE signal_id NOT IN (SELECT signal_id FROM st) "
        "QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY arrival) = 1",
    )
    sql["status_update"] = _with(
        f"{SIG}, {_UPDATES}, lu AS (SELECT * FROM u WHERE status IN ('open', 'acknowledged', 'resolved') "
        "QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY updated_at DESC, event_id DESC) = 1)",
        "SELECT s.signal_id, coalesce(lu.status, nullif(s.status, ''), 'open') AS status, s.severity FROM sig s "
        "LEFT JOIN lu ON lu.signal_id = s.signal_id",
    )
    sql["status_unknown"] = _with(
        f"{SIG}, {_UPDATES}",
        "SELECT u.signal_id, u.event_id FROM u WHERE NOT EXISTS (SELECT 1 FROM sig WHERE sig.signal_id = u.signal_id)",
    )
    sql["signal_search"] = _with(
        SIG,
        f"SELECT signal_id, ts, host_id, rule_id, severity, {_STATUS} AS status, title FROM sig "
        "WHERE ts > TIMESTAMP '1996-01-01' AND (contains(lower(title), 'urgent on 1') OR contains(lower(rule_id), 'urgent on 1')) "
        "ORDER BY ts DESC, signal_id LIMIT 200",
    )
    sql["signal_list"] = _with(
        SIG,
        f"SELECT signal_id, ts, host_id, severity, {_STATUS} AS status FROM sig WHERE severity = 'high' "
        f"AND host_id = 'host-3' AND {_STATUS} = 'open' ORDER BY ts DESC, signal_id LIMIT 100",
    )
    sql["signal_search_wildcards"] = _with(
        SIG,
        "SELECT signal_id, rule_id, ts FROM sig WHERE status = 'resolved' AND (lower(title) LIKE '%sm-0%3%' "
        "OR lower(rule_id) LIKE '%sm-0%3%') ORDER BY ts DESC, signal_id LIMIT 1000",
    )
    sql["signal_stats"] = _with(
        SIG,
        "SELECT 'total' AS section, '' AS name, count(*) AS signals FROM sig "
        "UNION ALL SELECT 'last_24h', '', count(*) FROM sig WHERE ts > TIMESTAMP '1998-07-01 12:00:00' - INTERVAL 24 HOUR "
        "UNION ALL SELECT 'severity', severity, count(*) FROM sig GROUP BY severity "
        "UNION ALL SELECT 'host', host_id, count(*) FROM sig GROUP BY host_id "
        "UNION ALL SELECT 'rule', rule_id, count(*) FROM sig GROUP BY rule_id",
    )
    sql["top_rules"] = _with(
        SIG, "SELECT rule_id, count(*) AS signals FROM sig GROUP BY rule_id ORDER BY signals DESC, rule_id LIMIT 10"
    )
    sql["parsed_signals"] = (
        "SELECT concat('s', o_orderkey) AS signal_id, cast(CASE WHEN o_orderkey % 4 > 0 THEN 2 ELSE 0 END AS int) AS n_tags, "
        "CASE WHEN o_orderkey % 4 > 0 THEN concat('a', o_orderkey % 3, ',b') ELSE '' END AS tags, "
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'open' END AS status, "
        "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS n FROM orders"
    )
    latest = "QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY received_at DESC, hb_time DESC) = 1"
    sql["latest_heartbeat"] = _with(
        HB,
        "SELECT agent_id, hb_time, version, os_version, uptime_seconds, received_at FROM hb "
        f"WHERE received_at > TIMESTAMP '2024-01-10' {latest} ORDER BY received_at DESC LIMIT 200",
    )
    sql["latest_heartbeat_parity"] = _with(
        f"{HB}, l AS (SELECT * FROM hb WHERE received_at > TIMESTAMP '2024-01-10' ORDER BY received_at DESC, hb_time DESC LIMIT 12)",
        f"SELECT agent_id, hb_time, version, received_at FROM l {latest}",
    )
    sql["heartbeat_upsert"] = _with(
        HB, "SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY agent_id, hb_time ORDER BY received_at DESC) = 1"
    )
    sql["heartbeat_validation"] = _with(
        HB,
        "SELECT agent_id, count(*) AS heartbeats, CASE WHEN version = '0.1' THEN 'rejected' ELSE 'accepted' END AS verdict "
        "FROM hb GROUP BY 1, 3",
    )
    sql["silent_agents"] = _with(
        HB,
        "SELECT agent_id, max(received_at) AS last_seen FROM hb GROUP BY agent_id "
        "HAVING max(received_at) < TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 30 MINUTE",
    )
    sql["outbox_pending"] = _with(
        f"{_QUEUE}, {_SHIPPED}, {_QUEUED}",
        "SELECT signal_id, enqueued_at, (row_number() OVER (ORDER BY enqueued_at, signal_id) - 1) // 100 AS batch_no FROM qd",
    )
    sql["outbox_refused"] = _with(_QUEUE, "SELECT signal_id, host_id FROM q WHERE rule_id = ''")
    sql["outbox_next"] = _with(
        f"{_QUEUE}, {_SHIPPED}, {_QUEUED}",
        "SELECT signal_id, rule_id, enqueued_at FROM qd ORDER BY enqueued_at, signal_id LIMIT 100",
    )
    sql["outbox_outcomes"] = _with(
        f"{_QUEUE}, o AS (SELECT concat('s', event_id) AS signal_id, value < 60 AS delivered FROM events)",
        "SELECT q.signal_id, CASE WHEN o.delivered THEN 'shipped' ELSE 'pending' END AS state, "
        "CASE WHEN o.delivered THEN NULL WHEN o.signal_id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE q.enqueued_at END "
        "AS enqueued_at FROM q LEFT JOIN o ON o.signal_id = q.signal_id",
    )
    sql["delivery_counts"] = (
        "SELECT count(*) FILTER (value < 60) AS sent, count(*) FILTER (NOT value < 60) AS failed, "
        "count(*) FILTER (NOT value < 60) AS requeued FROM events"
    )
    sql["state_stats"] = _with(
        f"{BASE}, {PATTERNS}, {_QUEUE}, {_SHIPPED}, {_QUEUED}, {_FILES}",
        "SELECT 'signals' AS name, count(*) AS entries FROM qd UNION ALL SELECT 'shipped', count(*) FROM sh "
        "UNION ALL SELECT 'first_seen', count(DISTINCT (machine_id, pattern)) FROM pat WHERE rule_id = 'B-HASH' "
        "UNION ALL SELECT 'journal', count(*) FROM files "
        f"UNION ALL SELECT 'windows', count(DISTINCT (machine_id, actor_path)) FROM n WHERE {SENSITIVE}",
    )
    sql["file_pending"] = _with(
        f"{_FILES}, done AS (SELECT concat('spool-', event_id // 80) AS path, max(ts + INTERVAL 2 DAY) AS processed_ts "
        "FROM events WHERE event_type = 'click' GROUP BY 1)",
        "SELECT f.path, f.mtime FROM files f LEFT JOIN done d ON d.path = f.path "
        "WHERE d.processed_ts IS NULL OR f.mtime > d.processed_ts",
    )
    sql["file_disposition"] = _with(
        f"{BASE}, {HITS}, {_FILES}",
        "SELECT path, CASE WHEN path IN (SELECT concat('spool-', event_id // 40) FROM hits) THEN 'archive' "
        "ELSE 'delete' END AS action FROM files",
    )
    sql["summary_lines"] = _with(
        BASE,
        "SELECT event_id, concat_ws(' ', 'kind=' || kind, 'actor_path=' || nullif("
        + _short("actor_path")
        + ", ''), 'target_path=' || nullif(target_path, ''), 'decision=' || nullif(decision, ''), "
        "'target_sha256=' || CASE WHEN target_sha256 = '' THEN NULL WHEN length(repeat(target_sha256, 6)) > 12 "
        "THEN left(repeat(target_sha256, 6), 12) || '…' ELSE repeat(target_sha256, 6) END, 'hash=' || machine_id) AS line FROM n",
    )
    long_path = "('/Library/Frameworks/' || url || '/Contents/MacOS/tool')"
    sql["short_paths"] = f"SELECT page_id, {_short('url')} AS url, {_short(long_path)} AS long_path FROM pages"
    sql["pattern_lines"] = _with(
        f"{BASE}, {PATTERNS}",
        "SELECT rule_id, event_id, CASE rule_id WHEN 'B-HASH' THEN 'path=' || target_path || ' hash=' || target_sha256 "
        "ELSE 'hash=' || cdhash END AS line FROM pat",
    )
    corr = _fold("k", SENSITIVE, "machine_id", _ACTOR_KEY, "policy_name", 0, 3, 1000, True).replace(
        "INTERVAL 0 HOUR", "INTERVAL 5 MINUTE"
    )
    base_where = f"{_UNSIGNED} AND target_path LIKE '/Users/%'"
    sql["detect_all"] = _with(
        f"""{BASE}, {HITS}, {corr},
        h1 AS (SELECT rule_id, severity, signal_id, machine_id AS host, target_sha256 <> '' AND row_number() OVER
          (PARTITION BY machine_id, target_sha256 ORDER BY ts, event_id, rule_idx) = 1 AS first_seen FROM hits),
        b1 AS (SELECT ts, machine_id, {_UNS_PATTERN} AS pattern FROM n WHERE {base_where}
          QUALIFY row_number() OVER (PARTITION BY machine_id, cdhash ORDER BY ts, event_id) = 1),
        s AS (SELECT * FROM h1 UNION ALL
          SELECT 'SM-COR-001', 'critical', {_signal_id("'SM-COR-001'", 'ts', 'scope', 'group_key')}, scope, false FROM k
          UNION ALL SELECT 'SM-BASE-001', 'high', {_signal_id("'SM-BASE-001'", 'ts', 'machine_id', 'pattern')},
            machine_id, false FROM b1)""",
        "SELECT rule_id, severity, count(*) AS signals, count(DISTINCT signal_id) AS ids, count(DISTINCT host) AS hosts, "
        "min(signal_id) AS first_id, count(*) FILTER (first_seen) AS first_seen FROM s GROUP BY 1, 2",
        True,
    )
    return sql

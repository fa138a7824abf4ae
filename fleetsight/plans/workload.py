"""Named queries over the test tables, one or more for every operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.base64_lists import text_list
from fleetsight.functions.display import pattern_line, short_path, summary_line
from fleetsight.functions.enums import enum_name, enum_number
from fleetsight.functions.paths import as_text, keyed_text, path_text
from fleetsight.operators import first_seen, lineage, store
from fleetsight.operators.correlate import correlation_events, correlate, windowed_counts, window_specs
from fleetsight.operators.match import match, rule_table
from fleetsight.operators.normalize import event_json, normalize
from fleetsight.operators.signals import as_signals, enrich, signals_from_baselines, signals_from_matches
from fleetsight.plans import detect as plan
from fleetsight.plans.views import flat_events, heartbeats, ntz, open_lines, signal_store, table, telemetry
from fleetsight.schema import OPEN_KINDS
from fleetsight.sources import ledger
from fleetsight.sources.catalogue import (
    Catalogue,
    EnabledRules,
    catalogue_violations,
    default_catalogue,
    load_rules,
)
from fleetsight.sources.frames import extract_frames
from fleetsight.sources.telemetry import SOURCE, parse_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEARNING_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
_RULES: dict[str, EnabledRules] = {}
_EVENTS: dict[tuple[str, str], DataFrame] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events. The plan, not its data, is kept for the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EVENTS:
        _EVENTS[key] = normalize(telemetry(spark, sf_dir), args_encoding="text")
    return _EVENTS[key]


def _rules(spark: SparkSession, events: DataFrame) -> EnabledRules:
    """The shipped rules, loaded and checked once per application."""
    app = spark.sparkContext.applicationId
    if app not in _RULES:
        _RULES[app] = load_rules(default_catalogue(spark), events)
    return _RULES[app]


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _ns(text: str) -> int:
    moment = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    return int(moment.timestamp()) * 1_000_000_000


def _correlation(rule_id: str, **fields) -> Row:
    base = {
        "id": rule_id, "title": rule_id, "description": "", "severity": "high", "tags": [],
        "group_by": [], "count_distinct": "", "enabled": True,
    }
    return Row(**{**base, **fields})


def _baseline(rule_id: str, **fields) -> Row:
    base = {"id": rule_id, "title": rule_id, "description": " new ", "severity": "high", "tags": ["t"], "enabled": True}
    return Row(**{**base, **fields})


SENSITIVE = (
    "kind = 'file_access' AND policy_name IN "
    "('ChromeCookies', 'CometCookies', 'SSHPrivateKeys', 'BrowserPasswords', 'KeychainDB')"
)
ACTOR = "event.file_access.instigator.executable.path"
POLICY = "event.file_access.policy_name"
DISTINCT_RULE = _correlation(
    "C-DISTINCT", expr=SENSITIVE, window="72h", group_by=[ACTOR], count_distinct=POLICY, threshold=3
)
COUNT_RULE = _correlation("C-COUNT", expr=SENSITIVE, window="72h", group_by=[ACTOR], threshold=3)
GLOBAL_RULE = _correlation("C-GLOBAL", expr=SENSITIVE, window="72h", count_distinct=POLICY, threshold=4)
BURST_RULE = _correlation(
    "C-BURST", expr="kind = 'execution' AND decision = 'DECISION_DENY'", window="36h",
    group_by=["event.execution.target.executable.path", "machine_id"], threshold=2,
)
UNSIGNED = _baseline(
    "B-UNSIGNED", expr="kind = 'execution' AND startswith(target_path, '/Users/') AND target_team = ''",
    track=["event.execution.target.executable.cdhash"], learning_period="",
)
HASHES = _baseline(
    "B-HASH", expr="kind = 'execution' AND target_path <> '' AND target_sha256 <> ''",
    track=["event.execution.target.executable.path", "event.execution.target.executable.hash.hash"],
    learning_period="168h",
)


# --- normalisation --------------------------------------------------------------------------


@query
def normalize_fields(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("event_seq").alias("event_id"),
        ntz(F.col("event_time_ns")).alias("event_time"),
        "machine_id", "kind", "decision", "mode", "reason", "target_sha256", "target_path", "actor_path",
        "actor_team", "actor_signing_id", "actor_is_platform_binary", "target_team", "target_signing_id",
        F.array_join("decoded_args", ",").alias("args"),
    )


@query
def extract_path_values(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.select(
        F.col("event_seq").alias("event_id"),
        path_text(ev, "event.execution.target.executable.path").alias("exe_path"),
        path_text(ev, "file_access.policy_name").alias("policy"),
        path_text(ev, "machine_id").alias("machine"),
        path_text(ev, "event.launch_item.legacy").alias("legacy"),
        path_text(ev, "execution.target.id.pid").alias("pid"),
        path_text(ev, "execution.args").alias("args"),
        path_text(ev, "nonexistent.field", strict=False).alias("missing"),
    )


@query
def value_text(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    dtype = ev.schema["value"].dataType
    return ev.select(
        "event_id",
        as_text(F.col("value"), dtype).alias("value_text"),
        as_text(F.col("event_id") * F.lit(1.0), dtype).alias("id_text"),
        as_text(F.col("value") > 50, ev.select(F.lit(True).alias("b")).schema["b"].dataType).alias("flag_text"),
    )


@query
def json_field_extract(spark, sf_dir):
    ev = _events(spark, sf_dir)
    text = event_json(ev)
    props = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    shown = ev.select(
        F.col("event_seq").alias("event_id"),
        F.get_json_object(text, "$.kind").alias("kind"),
        F.get_json_object(text, "$.execution.target.executable.path").alias("exe_path"),
        F.get_json_object(text, "$.file_access.policy_name").alias("policy"),
        F.get_json_object(text, "$.machine_id").alias("machine"),
    )
    return shown.join(props, "event_id")


@query
def json_lines_scan(spark, sf_dir):
    """JSON lines made from the events, with base64 arguments, read back and normalised."""
    raw = telemetry(spark, sf_dir)
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    coded = F.transform("execution.args", lambda a: F.base64(F.encode(a, "utf-8")))
    body = raw.select(
        "event_seq",
        F.explode(F.array(F.to_json(F.struct(
            "machine_id", "boot_session_uuid", stamp.alias("event_time"), F.lit(1).alias("not_in_schema"),
            F.when(F.col("execution").isNotNull(), F.col("execution").withField("args", coded)).alias("execution"),
            "file_access", "tcc_modification", "launch_item", "xprotect",
        )))).alias("value"),
        F.concat(F.lit("spool-"), F.expr("event_seq DIV 100")).alias("source_file"),
    )
    parsed = parse_lines(body.select("value", "source_file"))
    ev = normalize(parsed.where(F.col("_corrupt").isNull()).drop("_corrupt"))
    return ev.groupBy("source_file", "kind").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("event_time_ns").alias("times"),
        F.max(ntz(F.col("event_time_ns"))).alias("last_time"),
        F.min("target_path").alias("first_target"),
        F.max(F.array_join("decoded_args", ",")).alias("last_args"),
    )


@query
def frame_extract(spark, sf_dir):
    """Framed binary files made from the events, 50 records each, unpacked again."""
    ev = table(spark, sf_dir, "events").select(
        F.expr("event_id DIV 50").alias("file_no"), "event_id",
        F.concat_ws(",", "event_id", "event_type").alias("payload"),
    )
    magic, unchecked = F.lit("534E5421"), F.lit("0" * 16)
    frame = F.concat(
        magic, unchecked, F.lpad(F.hex(F.length("payload")), 2, "0"), F.hex(F.encode("payload", "utf-8"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f"))))
    files = ev.groupBy("file_no").agg(in_order.alias("fs")).select(
        F.concat(F.lit("spool-"), "file_no").alias("path"),
        F.unhex(F.array_join(F.transform("fs", lambda s: s["f"]), "")).alias("content"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))
    return extract_frames(files).select(
        "source_file", "frame_no", F.col("payload").cast("string").alias("payload"), "error"
    )


@query
def enum_lookup(spark, sf_dir):
    flat = flat_events(spark, sf_dir)
    number = F.coalesce(
        F.when(F.col("kind") == "execution", enum_number(F.col("decision"), "decision")),
        F.when(F.col("kind") == "file_access", enum_number(F.col("decision"), "policy_decision")),
        enum_number(F.col("tcc_right"), "authorization_right"),
        enum_number(F.col("launch_item_type"), "launch_item_type"),
    )
    reason = enum_number(F.col("tcc_reason"), "authorization_reason")
    return flat.select(
        "event_id",
        number.cast("int").alias("number"),
        reason.cast("int").alias("reason_number"),
        enum_name(F.pmod(F.col("event_id"), F.lit(5)).cast("string"), "decision").alias("name_of_number"),
    )


# --- catalogue ------------------------------------------------------------------------------


def _derived_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """Rule rows with many kinds of defects, one per order."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 3 AS fam",
        "CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE concat('R-', o_orderkey % 9000) END AS id",
        "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'title' END AS title",
        "'' AS description",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'true' END AS expr",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
        "WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN '' ELSE 'info' END AS severity",
        "cast(array() AS array<string>) AS tags",
        "o_orderkey % 2 = 0 AS enabled",
        "CASE WHEN o_orderkey % 13 = 0 THEN '0s' ELSE '5m' END AS window",
        "cast(o_custkey % 5 - 1 AS int) AS threshold",
        "CASE WHEN o_orderkey % 17 = 0 THEN array('') ELSE array('machine_id') END AS fields",
        "concat('file-', o_orderkey % 40) AS source_file",
    )
    common = ["id", "title", "description", "expr", "severity", "tags", "enabled", "source_file"]
    track = "CASE WHEN size(fields) = 1 AND threshold = 0 THEN cast(array() AS array<string>) ELSE fields END AS track"
    return Catalogue(
        rules=o.where("fam = 0").select(*common),
        correlations=o.where("fam = 1").select(*common, "window", "threshold", F.col("fields").alias("group_by")),
        baselines=o.where("fam = 2").selectExpr(*common, track, "'1h' AS learning_period"),
    )


@query
def rule_violations(spark, sf_dir):
    return catalogue_violations(_derived_catalogue(spark, sf_dir))


# --- predicates and simple rules ------------------------------------------------------------


PREDICATES = {
    "p_eq": "kind = 'execution'",
    "p_ne": "decision <> 'DECISION_ALLOW'",
    "p_in": "policy_name IN ('ChromeCookies', 'KeychainDB')",
    "p_and": "kind = 'execution' AND target_team = ''",
    "p_or": "startswith(target_path, '/Users/') OR startswith(target_path, '/Volumes/')",
    "p_not": "NOT startswith(actor_path, '/System/')",
    "p_starts": "startswith(target_path, '/usr/bin/')",
    "p_ends": "endswith(target_path, 'curl')",
    "p_contains": "contains(actor_path, 'Chrome')",
    "p_matches": "target_path RLIKE r'^/Users/.*/(Downloads|Desktop)/a\\d+$'",
    "p_has": "xprotect.detected IS NOT NULL",
    "p_exists": "exists(decoded_args, a -> contains(a, 'dialog'))",
    "p_all": "forall(decoded_args, a -> char_length(a) < 10)",
    "p_exists_one": "size(filter(decoded_args, a -> a = 'x')) = 1",
    "p_map": "array_contains(transform(decoded_args, a -> upper(a)), 'X')",
    "p_arith": "try_mod(event_seq, 7) = 3 AND try_add(event_seq, 1) > 5",
    "p_ternary": "CASE WHEN kind = 'execution' THEN decision ELSE policy_name END = 'DECISION_DENY'",
    "p_size": "size(decoded_args) >= 2",
    "p_cast": "try_cast(substr(target_sha256, 2) AS int) > 50",
    "p_time": "month(event_time) - 1 = 0 AND hour(event_time) BETWEEN 8 AND 17 AND dayofweek(event_time) - 1 < 5",
    "p_index": "try_element_at(decoded_args, 1) = 'x'",
    "p_enum_order": "array_position(array('DECISION_UNKNOWN', 'DECISION_ALLOW', 'DECISION_DENY', "
    "'DECISION_ALLOW_COMPILER'), decision) - 1 >= 2",
    "p_literal": "true",
    "p_bad_cast": "try_cast(target_path AS int) = 1",
}


@query
def predicate_matrix(spark, sf_dir):
    columns = [f"coalesce({sql}, false) AS {name}" for name, sql in PREDICATES.items()]
    return _events(spark, sf_dir).selectExpr("event_seq AS event_id", *columns)


@query
def arg_exists(spark, sf_dir):
    ev = _events(spark, sf_dir)
    args = text_list(F.col("decoded_args"), "text")
    return ev.where(F.exists(args, lambda a: a == "-authonly")).select(
        F.col("event_seq").alias("event_id"), F.size(args).alias("n_args"), F.array_join(args, "|").alias("args")
    )


@query
def simple_signals(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = _rules(spark, ev)
    signals = signals_from_matches(match(ev, rules.rules), rules.rules)
    fields = ["actor_path", "actor_signing_id", "target_path", "target_team", "target_sha256", "decision", "kind"]
    return signals.select(
        "signal_id", ntz(F.col("ts_ns")).alias("ts"), "host_id", "rule_id", "status", "severity", "title",
        F.array_join("tags", ",").alias("tags"),
        *[F.get_json_object("context", f"$.{f}").alias("c_" + f) for f in fields],
        F.get_json_object("context", "$['execution.args'][1]").alias("c_arg"),
    )


@query
def rule_match_counts(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = _rules(spark, ev)
    hits = match(ev, rules.rules).groupBy("rule_idx").agg(F.count(F.lit(1)).alias("matches"))
    meta = rule_table(spark, rules.rules)
    return meta.join(hits, "rule_idx", "left").select(
        "rule_id", "severity", F.coalesce("matches", F.lit(0)).alias("matches")
    )


@query
def rule_isolation(spark, sf_dir):
    """Predicates that fail on some or all events, beside those that hold on some, in all three families."""
    ev = _events(spark, sf_dir)
    predicates = {
        "OVERFLOW": "event_seq + 9223372036854775807 < 0", "NARROW": "cast(event_seq * 10000000000 AS int) < 0",
        "ZERO": "element_at(decoded_args, cast(event_seq - event_seq AS int)) = 'x'", "PATTERN": "kind rlike concat('(', kind)",
        "RAISED": "raise_error(kind) = 'x'", "MODULO": "event_seq % (event_seq - event_seq) = 0",
        "PARTLY": "CASE WHEN event_seq % 2 = 0 THEN raise_error('odd') ELSE kind END = 'file_access'",
        "CAST": "cast(concat('x', kind) AS int) = 1", "INDEX": "decoded_args[500] = 'x'",
        "DIVIDE": "1 / (event_seq - event_seq) > 0", "GOOD": "kind = 'file_access'",
    }
    rules = [Row(id=name, expr=expr) for name, expr in predicates.items()]
    names = F.array(*[F.lit(r["id"]) for r in rules])
    simple = match(ev, rules).select(F.col("event_seq").alias("event_id"), names[F.col("rule_idx")].alias("rule_id"), F.lit("rules").alias("family"))
    windows = [_correlation(name, expr=expr, window="5m", threshold=1) for name, expr in predicates.items()]
    counted = correlation_events(ev, windows).select(
        F.col("seq").alias("event_id"), names[F.col("rule_idx")].alias("rule_id"), F.lit("correlations").alias("family")
    )
    tracked = [_baseline(name, expr=expr, track=["kind"], learning_period="") for name, expr in predicates.items()]
    patterns = first_seen.baseline_events(ev, tracked).select(F.col("event_seq").alias("event_id"), "rule_id", F.lit("baselines").alias("family"))
    return simple.unionByName(counted).unionByName(patterns)


@query
def context_merge(spark, sf_dir):
    """Contexts with members of one name from several sides, read back as values."""
    ev = _events(spark, sf_dir)
    base = {"title": "t", "description": "", "severity": "low", "tags": ["a"], "enabled": True, "include_process_tree": False}
    rules = [
        Row(**base, id="FILES", expr="kind = 'file_access'", include_event=False,
            extra_context=["kind", "event.kind", "machine_id", "event.file_access.policy_name", "policy_name"]),
        Row(**base, id="RUNS", expr="kind = 'execution'", include_event=True, extra_context=["execution.args", "event.execution.args", "kind"]),
        Row(**base, id="ALL", expr="true", include_event=False, extra_context=[]),
    ]
    signals = enrich(signals_from_matches(match(ev, rules), rules), {
        "kind": F.when(F.col("event_seq") % 2 == 0, F.lit("changed")),
        "first_seen": F.when(F.col("event_seq") % 3 == 0, F.lit(True)),
    })
    signals = enrich(signals, {"first_seen": F.when(F.col("event_seq") % 6 == 0, F.lit("again"))})
    # What another agent stored may have a name twice.
    text = F.when(F.col("rule_id") != "ALL", F.col("context")).otherwise(
        F.concat(F.substr("context", F.lit(1), F.length("context") - 1), F.lit(',"kind":"last","kind":'), F.col("event_seq").cast("string"), F.lit("}"))
    )
    stored = signals.select("signal_id", "rule_id", "event_seq", "status", F.to_json("tags").alias("tags"), text.alias("context"))
    names = ["kind", "machine_id", "policy_name", "target_path", "decision", "first_seen", "event.kind"]
    paths = {n: f"$['{n}']" for n in names} | {
        "file_policy": "$['file_access.policy_name']", "arg": "$['execution.args'][0]", "event.kind": "$.event.kind",
        "event_path": "$.event.execution.target.executable.path",
    }
    return store.parsed_signals(stored).select(
        F.col("event_seq").alias("event_id"), "rule_id", F.col("tags")[0].alias("tag"),
        *[F.try_variant_get("context", path, "string").alias("c_" + n.replace(".", "_")) for n, path in paths.items()],
    )


def _open_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = parse_lines(open_lines(spark, sf_dir).withColumn(SOURCE, F.lit("f")))
    return normalize(records, args_encoding="text")


@query
def open_kind_fields(spark, sf_dir):
    """Dotted paths into the blocks of every kind without typed fields."""
    ev = _open_events(spark, sf_dir)

    ev = ev.withColumn("block", F.coalesce(*OPEN_KINDS))

    def at(path: str) -> Column:
        return path_text(ev, f"event.block.{path}")

    named = ("authentication", "login_logout", "open_ssh")  # by their own names, the others as the block that is set
    own = F.concat(*[path_text(ev, f"event.{kind}.user.name") for kind in named])
    by_kind = F.when(F.col("kind").isin(*named), own).otherwise(at("user.name"))
    return ev.select(
        F.col("event_seq").alias("event_id"), "kind", at("success").alias("success"), by_kind.alias("user_name"),
        at("user.tags").alias("tags"), at("user").alias("user_text"), at("note").alias("note"), at("none.such").alias("missing"),
        F.get_json_object(event_json(ev), "$.authentication.user.name").alias("event_user"),
    )


@query
def open_kind_signals(spark, sf_dir):
    """Simple rules over logins and authentications, with extra paths and whole events."""
    ev = _open_events(spark, sf_dir)
    base = {"title": "t", "description": "", "severity": "low", "tags": [], "enabled": True, "include_process_tree": False}
    rules = [
        Row(**base, id="AUTH", expr="NOT try_variant_get(authentication, '$.success', 'boolean')", include_event=True,
            extra_context=["event.authentication.user.name", "event.authentication.source"]),
        Row(**base, id="LOGIN", expr="kind = 'login_logout' AND try_variant_get(login_logout, '$.tries', 'int') > 2", include_event=False,
            extra_context=["login_logout.user.tags"]),
    ]
    signals = as_signals(signals_from_matches(match(ev, rules), rules))
    paths = {
        "user": "$['authentication.user.name']", "source": "$['authentication.source']", "tags": "$['login_logout.user.tags']",
        "event_tries": "$.event.authentication.tries", "event_tag": "$.event.authentication.user.tags[0]", "kind": "$.kind",
    }
    return signals.select(
        F.col("source_seq").alias("event_id"), "rule_id",
        *[F.get_json_object("context", path).alias("c_" + n) for n, path in paths.items()],
    )


@query
def open_kind_keys(spark, sf_dir):
    """Groups, counted values and patterns read from such blocks, and the fires of their windows."""
    ev = _open_events(spark, sf_dir)
    windows = [
        _correlation("FAILED", expr="NOT try_variant_get(authentication, '$.success', 'boolean')", window="5m", threshold=2,
                     group_by=["event.authentication.user.name"]),
        _correlation("SOURCES", expr="kind = 'open_ssh'", window="5m", threshold=3, count_distinct="open_ssh.source"),
    ]
    names = F.array(*[F.lit(r["id"]) for r in windows])
    counted = correlation_events(ev, windows).select(
        F.col("seq").alias("event_id"), names[F.col("rule_idx")].alias("rule_id"), F.col("group_key").alias("key"), "value"
    )
    fired = correlate(ev, windows).select(
        F.lit(None).cast("bigint").alias("event_id"), F.concat(names[F.col("rule_idx")], F.lit("-FIRES")).alias("rule_id"),
        F.col("group_key").alias("key"), F.col("event_count").cast("string").alias("value"),
    ).where("rule_id = 'FAILED-FIRES'")
    tracked = [_baseline("USERS", expr="kind = 'screen_sharing'", track=["screen_sharing.user.name", "screen_sharing.tries"], learning_period="")]
    patterns = first_seen.baseline_events(ev, tracked).select(
        F.col("event_seq").alias("event_id"), "rule_id", F.col("pattern").alias("key"), F.lit("").alias("value")
    )
    return counted.unionByName(fired).unionByName(patterns)


@query
def artifact_first_seen(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = _rules(spark, ev)
    signals = plan.simple_signals(ev, EnabledRules([_no_tree(r) for r in rules.rules], [], []), plan.Settings())
    sha = F.coalesce(F.get_json_object("context", "$.target_sha256"), F.lit(""))
    return signals.select(
        "signal_id", "rule_id", sha.alias("target_sha256"),
        F.coalesce(F.get_json_object("context", "$.first_seen"), F.lit("")).alias("first_seen"),
    )


def _no_tree(rule: Row) -> Row:
    return Row(**{**rule.asDict(), "include_process_tree": False})


# --- baselines ------------------------------------------------------------------------------


@query
def baseline_first_seen(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = [UNSIGNED, HASHES]
    found = first_seen.baseline_matches(ev, rules, learning_start_ns=-(2**60))
    signals = signals_from_baselines(first_seen.alerts(found), rules)
    return signals.select(
        "signal_id", ntz(F.col("ts_ns")).alias("ts"), "host_id", "rule_id", "pattern",
        F.array_join("tags", ",").alias("tags"), "rule_description",
        F.get_json_object("context", "$.pattern").alias("c_pattern"),
        F.get_json_object("context", "$.in_learning").alias("c_in_learning"),
        F.get_json_object("context", "$.target_path").alias("c_target_path"),
    )


@query
def baseline_learning(spark, sf_dir):
    ev = _events(spark, sf_dir)
    start = int(LEARNING_START.timestamp()) * 1_000_000_000
    found = first_seen.baseline_matches(ev, [UNSIGNED, HASHES], start)
    return found.select(
        "rule_id", "machine_id", "pattern", ntz(F.col("order_ns")).alias("first_time"), "in_learning"
    )


@query
def baseline_fleet(spark, sf_dir):
    ev = _events(spark, sf_dir)
    found = first_seen.baseline_matches(ev, [HASHES], -(2**60), scope="fleet")
    return found.select("rule_id", "scope", "pattern", F.col("event_seq").alias("event_id"), "machine_id")


@query
def first_seen_stats(spark, sf_dir):
    found = first_seen.baseline_events(_events(spark, sf_dir), [HASHES])
    return first_seen.first_seen_stats(found).select(
        "scope", "pattern", ntz(F.col("first_ns")).alias("first_time"), ntz(F.col("last_ns")).alias("last_time"),
        "sightings",
    )


@query
def first_seen_incremental(spark, sf_dir):
    """History up to a day is the seen table; later events are the new batch."""
    ev = _events(spark, sf_dir)
    cut = _ns("2024-01-11T00:00:00")
    seen = first_seen.first_seen_stats(first_seen.baseline_events(ev.where(F.col("order_ns") < cut), [HASHES]))
    found = first_seen.baseline_matches(ev.where(F.col("order_ns") >= cut), [HASHES], -(2**60), seen=seen)
    return found.select("machine_id", "pattern", ntz(F.col("order_ns")).alias("first_time"))


@query
def first_seen_merge(spark, sf_dir):
    """The seen table after a second batch, without entries that went quiet."""
    ev = _events(spark, sf_dir)
    cut = _ns("2024-01-11T00:00:00")
    batches = [ev.where(F.col("order_ns") < cut), ev.where(F.col("order_ns") >= cut)]
    old, new = [first_seen.first_seen_stats(first_seen.baseline_events(b, [HASHES])) for b in batches]
    merged = first_seen.merge_seen(old, new)
    kept = first_seen.expire_seen(merged, F.lit(_ns("2024-01-31T00:00:00")), "240h")
    return kept.select("scope", "pattern", ntz(F.col("first_ns")).alias("first_time"), "sightings")


# --- correlations ---------------------------------------------------------------------------


def _fires(fires: DataFrame) -> DataFrame:
    return fires.select(
        "scope", "group_key", F.col("seq").alias("event_id"), ntz(F.col("ts_ns")).alias("fired_at"),
        ntz(F.col("first_ns")).alias("live_from"), "event_count",
        F.array_join(F.coalesce("distinct_values", F.array().cast("array<string>")), ",").alias("values"),
    )


@query
def group_keys(spark, sf_dir):
    ev = _events(spark, sf_dir)
    key = keyed_text(ev, [ACTOR, POLICY, "nonexistent.field"], strict=False)
    return ev.where(SENSITIVE).groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("events"))


@query
def correlation_count(spark, sf_dir):
    return _fires(correlate(_events(spark, sf_dir), [COUNT_RULE]))


@query
def correlation_distinct(spark, sf_dir):
    return _fires(correlate(_events(spark, sf_dir), [DISTINCT_RULE]))


@query
def correlation_global(spark, sf_dir):
    return _fires(correlate(_events(spark, sf_dir), [GLOBAL_RULE], scope="fleet", max_events=5))


@query
def correlation_fleet_count(spark, sf_dir):
    """One group for the whole fleet that fires all the time: every slice depends on the last."""
    rule = _correlation("C-FLEET", expr=SENSITIVE, window="72h", threshold=4)
    return _fires(correlate(_events(spark, sf_dir), [rule], scope="fleet"))


@query
def correlation_many(spark, sf_dir):
    """Several rules with different windows in one pass."""
    rules = [DISTINCT_RULE, BURST_RULE, COUNT_RULE]
    fires = correlate(_events(spark, sf_dir), rules)
    return fires.groupBy("rule_idx").agg(
        F.count(F.lit(1)).alias("fires"), F.countDistinct("scope", "group_key").alias("groups"),
        F.max(ntz(F.col("ts_ns"))).alias("last_fire"),
    )


@query
def correlation_prefilter(spark, sf_dir):
    rules = [DISTINCT_RULE]
    events = correlation_events(_events(spark, sf_dir), rules)
    return windowed_counts(events, window_specs(rules)).select(
        "scope", "group_key", F.col("seq").alias("event_id"), "live_count", "live_distinct"
    )


@query
def correlation_signals(spark, sf_dir):
    ev = _events(spark, sf_dir)
    signals = plan.correlation_signals(ev, EnabledRules([], [DISTINCT_RULE], []), plan.Settings())
    return signals.select(
        "signal_id", ntz(F.col("ts_ns")).alias("ts"), "host_id", "rule_id", F.array_join("tags", ",").alias("tags"),
        F.get_json_object("context", "$.event_count").alias("c_count"),
        F.get_json_object("context", "$.window_type").alias("c_type"),
        F.get_json_object("context", "$.distinct_field").alias("c_field"),
        F.get_json_object("context", "$.distinct_values[0]").alias("c_first_value"),
        F.get_json_object("context", "$.grouped_by['file_access.instigator.executable.path']").alias("c_actor"),
        F.get_json_object("context", "$.sample_event.file_access.target.path").alias("c_sample_path"),
        F.get_json_object("context", "$.target_path").alias("c_target_path"),
        F.get_json_object("context", "$.decision").alias("c_decision"),
        F.get_json_object("context", "$.kind").alias("c_kind"),
    )


# --- lineage --------------------------------------------------------------------------------


@query
def process_nodes(spark, sf_dir):
    nodes = lineage.process_nodes(_events(spark, sf_dir))
    return nodes.select(
        F.col("node_seq").alias("event_id"), "machine_id", "boot", "pid", "pidversion", "parent_pid",
        "parent_pidversion", "path", "user", F.array_join("args", ",").alias("args"),
    )


def _curl_starts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("path") == "/usr/bin/curl").select(
        "machine_id", "boot", "pid", "pidversion", F.col("node_ns").alias("match_ns"),
        F.col("node_seq").alias("match_seq"),
    )


def _chain_rows(chains: DataFrame) -> DataFrame:
    return chains.select(
        F.col("match_seq").alias("event_id"), F.posexplode("chain").alias("depth", "n")
    ).select("event_id", "depth", F.col("n.pid").alias("pid"), F.col("n.path").alias("path"))


@query
def process_chain(spark, sf_dir):
    nodes = lineage.process_nodes(_events(spark, sf_dir))
    return _chain_rows(lineage.process_chains(_curl_starts(nodes), nodes, ttl=None))


@query
def process_chain_ttl(spark, sf_dir):
    nodes = lineage.process_nodes(_events(spark, sf_dir))
    return _chain_rows(lineage.process_chains(_curl_starts(nodes), nodes, max_depth=3, ttl="24h"))


@query
def process_tree(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = _rules(spark, ev)
    wanted = EnabledRules([r for r in rules.rules if r["include_process_tree"]], [], [])
    signals = signals_from_matches(match(ev, wanted.rules), wanted.rules)
    tree = plan.with_process_tree(signals, ev, wanted, plan.Settings(tree_ttl=None))
    entries = F.from_json(
        F.get_json_object("context", "$.process_tree"),
        "array<struct<relation:string,depth:int,pid:int,path:string,user:string>>",
    )
    text = F.transform(
        entries, lambda e: F.concat_ws(":", e["depth"].cast("string"), e["relation"], e["pid"].cast("string"), e["path"], e["user"])
    )
    return tree.select("signal_id", "rule_id", F.array_join(text, ">").alias("tree"))


@query
def latest_processes(spark, sf_dir):
    nodes = lineage.process_nodes(_events(spark, sf_dir))
    return lineage.latest_nodes(nodes).select(
        "machine_id", "boot", "pid", "pidversion", F.col("node_seq").alias("event_id"), "path"
    )


# --- store ----------------------------------------------------------------------------------


@query
def ingest_validation(spark, sf_dir):
    signals = signal_store(spark, sf_dir).withColumns({
        "title": F.expr("CASE WHEN signal_id LIKE '%77' THEN repeat(title, 40) ELSE title END"),
        "host_id": F.expr("CASE WHEN signal_id LIKE '%55' THEN NULL ELSE host_id END"),
        "tags": F.expr("CASE WHEN signal_id LIKE '%33' THEN array_repeat('t', 51) "
                       "WHEN signal_id LIKE '%34' THEN array(repeat('t', 65)) ELSE array('t') END"),
        "context": F.expr("CASE WHEN signal_id LIKE '%991' THEN repeat('c', 100001) ELSE '{}' END"),
    })
    reasons = store.signal_reasons(signals)
    return signals.select(
        "signal_id", (F.size(reasons) == 0).alias("accepted"), F.array_join(reasons, ",").alias("reasons")
    )


def _arrivals(spark, sf_dir) -> DataFrame:
    """Signals that come in twice or more, and the day they came."""
    return signal_store(spark, sf_dir).withColumns({
        "signal_id": F.expr("concat('s', cast(substr(signal_id, 2) AS bigint) % 5000)"),
        "arrival": F.expr("cast(substr(signal_id, 2) AS bigint)"),
    })


@query
def ingest_dedupe(spark, sf_dir):
    arrivals = _arrivals(spark, sf_dir)
    stored = signal_store(spark, sf_dir).where(F.col("rule_id") == "SM-003")
    return store.ingest_flags(arrivals, stored, ["arrival"]).select("arrival", "signal_id", "duplicate")


@query
def ingest_new(spark, sf_dir):
    arrivals = _arrivals(spark, sf_dir)
    stored = signal_store(spark, sf_dir).where(F.col("rule_id") == "SM-003")
    return store.new_signals(arrivals, stored, ["arrival"]).select("signal_id", "arrival", "host_id", "title")


def _updates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s', event_id * 3) AS signal_id", "ts AS updated_at", "event_id",
        "CASE event_type WHEN 'click' THEN 'acknowledged' WHEN 'view' THEN 'resolved' "
        "WHEN 'error' THEN 'closed' ELSE 'open' END AS status",
    )


@query
def status_update(spark, sf_dir):
    changed = store.update_status(signal_store(spark, sf_dir), _updates(spark, sf_dir), ["updated_at", "event_id"])
    return changed.select("signal_id", "status", "severity")


@query
def status_unknown(spark, sf_dir):
    return store.unknown_updates(signal_store(spark, sf_dir), _updates(spark, sf_dir)).select("signal_id", "event_id")


@query
def signal_search(spark, sf_dir):
    found = store.list_signals(
        signal_store(spark, sf_dir), since=_at("1996-01-01"), status="all", search=" URGENT ON 1", limit=200
    )
    return found.select("signal_id", "ts", "host_id", "rule_id", "severity", "status", "title")


@query
def signal_list(spark, sf_dir):
    found = store.list_signals(signal_store(spark, sf_dir), severity="high", host_id="host-3")
    return found.select("signal_id", "ts", "host_id", "severity", "status")


@query
def signal_search_wildcards(spark, sf_dir):
    found = store.list_signals(
        signal_store(spark, sf_dir), status="resolved", search="sm-0%3", limit=1000, wildcards=True
    )
    return found.select("signal_id", "rule_id", "ts")


@query
def signal_stats(spark, sf_dir):
    return store.signal_stats(signal_store(spark, sf_dir), _at("1998-07-01 12:00:00"))


@query
def top_rules(spark, sf_dir):
    return store.top_rules(signal_store(spark, sf_dir))


@query
def parsed_signals(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr(
        "concat('s', o_orderkey) AS signal_id",
        "CASE WHEN o_orderkey % 4 > 0 THEN concat('[\"a', o_orderkey % 3, '\", \"b\"]') END AS tags",
        "CASE WHEN o_orderkey % 5 > 0 THEN concat('{\"n\": ', o_custkey, '}') END AS context",
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE '' END AS status",
    )
    return store.parsed_signals(raw).select(
        "signal_id", F.size("tags").alias("n_tags"), F.array_join("tags", ",").alias("tags"), "status",
        F.try_variant_get("context", "$.n", "bigint").alias("n"),
    )


@query
def latest_heartbeat(spark, sf_dir):
    hb = heartbeats(spark, sf_dir)
    return store.latest_heartbeats(
        hb, _at("2024-01-10"), ["hb_time", "version", "os_version", "uptime_seconds", "received_at"], ["hb_time"]
    )


@query
def latest_heartbeat_parity(spark, sf_dir):
    hb = heartbeats(spark, sf_dir)
    return store.latest_heartbeats(
        hb, _at("2024-01-10"), ["hb_time", "version", "received_at"], ["hb_time"], limit=12, parity=True
    )


@query
def heartbeat_upsert(spark, sf_dir):
    hb = heartbeats(spark, sf_dir)
    cut = _at("2024-01-15")
    old, new = hb.where(F.col("received_at") < cut), hb.where(F.col("received_at") >= cut)
    return store.upsert_heartbeats(old, new, ["agent_id", "hb_time"], ["received_at"])


@query
def heartbeat_validation(spark, sf_dir):
    hb = heartbeats(spark, sf_dir).withColumn(
        "version", F.expr("CASE WHEN version = '0.1' THEN repeat(version, 12) ELSE version END")
    )
    ok, bad = store.split_valid(hb, store.heartbeat_reasons(hb, "hb_time"))
    counted = [
        part.groupBy("agent_id").agg(F.count(F.lit(1)).alias("heartbeats")).withColumn("verdict", F.lit(name))
        for name, part in (("accepted", ok), ("rejected", bad))
    ]
    return counted[0].unionByName(counted[1])


@query
def silent_agents(spark, sf_dir):
    hb = heartbeats(spark, sf_dir)
    return store.silent_agents(hb, _at("2024-01-30 23:30:00"), missed=3, interval="10m")


# --- outbox ---------------------------------------------------------------------------------


def _queue(spark, sf_dir) -> DataFrame:
    return signal_store(spark, sf_dir).withColumns({
        "rule_id": F.expr("CASE WHEN signal_id LIKE '%00' THEN '' ELSE rule_id END"),
        "enqueued_at": F.col("ts"),
    })


def _shipped(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("concat('s', event_id) AS signal_id")


@query
def outbox_pending(spark, sf_dir):
    queued, _ = store.enqueue(_queue(spark, sf_dir), _shipped(spark, sf_dir))
    return store.numbered_batches(queued, ["enqueued_at", "signal_id"]).select("signal_id", "enqueued_at", "batch_no")


@query
def outbox_refused(spark, sf_dir):
    return store.enqueue(_queue(spark, sf_dir), _shipped(spark, sf_dir))[1].select("signal_id", "host_id")


@query
def outbox_next(spark, sf_dir):
    queued, _ = store.enqueue(_queue(spark, sf_dir), _shipped(spark, sf_dir))
    return store.next_batch(queued, ["enqueued_at", "signal_id"]).select("signal_id", "rule_id", "enqueued_at")


def _outcomes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('s', event_id) AS signal_id", "value < 60 AS delivered")


@query
def outbox_outcomes(spark, sf_dir):
    shipped, pending = store.delivery_outcomes(
        _queue(spark, sf_dir), _outcomes(spark, sf_dir), _at("2030-01-01")
    )
    sent = shipped.select("signal_id", F.lit("shipped").alias("state"), F.lit(None).cast("timestamp_ntz").alias("enqueued_at"))
    return sent.unionByName(pending.select("signal_id", F.lit("pending").alias("state"), "enqueued_at"))


@query
def delivery_counts(spark, sf_dir):
    return store.delivery_counts(_outcomes(spark, sf_dir))


@query
def state_stats(spark, sf_dir):
    ev = _events(spark, sf_dir)
    queued, _ = store.enqueue(_queue(spark, sf_dir), _shipped(spark, sf_dir))
    groups = correlation_events(ev, [DISTINCT_RULE]).select("scope", "group_key").distinct()
    return store.state_stats({
        "signals": queued,
        "shipped": _shipped(spark, sf_dir),
        "first_seen": first_seen.first_seen_stats(first_seen.baseline_events(ev, [HASHES])),
        "journal": _files(spark, sf_dir),
        "windows": groups,
    })


# --- spool files ----------------------------------------------------------------------------


def _files(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.expr("concat('spool-', event_id DIV 40)").alias("path")).agg(F.max("ts").alias("mtime"))


@query
def file_pending(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr(
        "concat('spool-', event_id DIV 80) AS path", "ts + INTERVAL 2 DAYS AS processed_ts"
    )
    known = ledger.ledger_update(done.where(F.lit(False)), done)
    return ledger.pending_files(_files(spark, sf_dir), known)


@query
def file_disposition(spark, sf_dir):
    ev = _events(spark, sf_dir)
    rules = _rules(spark, ev)
    hits = match(ev, rules.rules).select(F.expr("concat('spool-', event_seq DIV 40)").alias("path"))
    return ledger.file_disposition(_files(spark, sf_dir), hits)


# --- reports --------------------------------------------------------------------------------


@query
def summary_lines(spark, sf_dir):
    ev = _events(spark, sf_dir)
    names = ["kind", "actor_path", "target_path", "decision", "target_sha256"]
    values = {n: F.col(n) for n in names}
    values["target_sha256"] = F.when(F.col("target_sha256") != "", F.repeat("target_sha256", 6))
    values["hash"] = F.col("machine_id")
    return ev.select(F.col("event_seq").alias("event_id"), summary_line(values).alias("line"))


@query
def short_paths(spark, sf_dir):
    """Page addresses are long paths of many shapes."""
    pages = table(spark, sf_dir, "pages")
    long = F.concat(F.lit("/Library/Frameworks/"), "url", F.lit("/Contents/MacOS/tool"))
    return pages.select("page_id", short_path(F.col("url")).alias("url"), short_path(long).alias("long_path"))


@query
def pattern_lines(spark, sf_dir):
    found = first_seen.baseline_events(_events(spark, sf_dir), [HASHES, UNSIGNED])
    return found.select("rule_id", F.col("event_seq").alias("event_id"), pattern_line(F.col("pattern")).alias("line"))


@query
def detect_all(spark, sf_dir):
    """The whole run with the shipped rules: signals per rule and severity."""
    ev = _events(spark, sf_dir)
    signals = plan.detect(ev, _rules(spark, ev), plan.Settings())
    return signals.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("signals"),
        F.countDistinct("signal_id").alias("ids"),
        F.countDistinct("host_id").alias("hosts"),
        F.min("signal_id").alias("first_id"),
        F.count_if(F.get_json_object("context", "$.first_seen") == "true").alias("first_seen"),
    )

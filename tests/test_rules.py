"""Catalogue loading, checks, matching, baselines and signals."""

import json
import tempfile

import pytest
from conftest import SMALL, execution, file_access
from pyspark.errors import AnalysisException

from fleetsight.functions.predicates import implied_kinds
from fleetsight.operators import first_seen
from fleetsight.operators.correlate import window_specs
from fleetsight.operators.match import match
from fleetsight.operators.signals import as_signals, signals_from_matches
from fleetsight.plans import detect as plan
from fleetsight.plans import workload
from fleetsight.sources.catalogue import (
    EnabledRules,
    InvalidCatalogue,
    catalogue_of,
    catalogue_violations,
    default_catalogue,
    load_rules,
    plan_violations,
    predicate_problem,
    read_catalogue,
)
from fleetsight.sources.telemetry import read_normalized, write_normalized


def rule(id, expr="kind = 'execution'", **fields):
    return {"id": id, "title": "t", "expr": expr, "severity": "high", "enabled": True, **fields}


def write(path, name, body):
    with open(f"{path}/{name}", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


@pytest.fixture(scope="module")
def one_event(events_of):
    return events_of([execution(seq=1, path="/x", sha="h")])


def test_shipped_catalogue_is_valid(spark, one_event):
    rules = load_rules(default_catalogue(spark), one_event)
    assert (len(rules.rules), len(rules.correlations), len(rules.baselines)) == (14, 1, 1)
    assert rules.wants_tree


def test_directory_tree(spark):
    import os

    path = tempfile.mkdtemp(prefix="fleetsight-test-")
    os.makedirs(path + "/deep")
    write(path, "a.json", {"rules": [rule("A"), rule("B")]})
    write(path, "deep/b.json", {"rules": [rule("C")]})
    write(path, "notes.txt", "not a rule file")
    assert sorted(r.id for r in read_catalogue(spark, path).rules.collect()) == ["A", "B", "C"]
    write(path, "deep/c.json", {"correlations": [{**rule("A"), "window": "5m", "threshold": 1}]})
    found = catalogue_violations(read_catalogue(spark, path)).collect()
    assert [(v.rule_id, v.check) for v in found] == [("A", "duplicate")]
    assert "a.json" in found[0].detail and "c.json" in found[0].detail
    write(path, "bad.json", '{"rules": [')
    assert "unreadable" in [v.check for v in catalogue_violations(read_catalogue(spark, path)).collect()]


def test_empty_and_missing_directory(spark):
    path = tempfile.mkdtemp(prefix="fleetsight-test-")
    assert read_catalogue(spark, path).rules.count() == 0
    with pytest.raises(AnalysisException):
        read_catalogue(spark, path + "/missing").rules.count()


def test_violations_are_reported_together(spark, one_event):
    families = {
        "rules": [rule("", title=""), rule("S", severity="urgent"), rule("S"), rule("P", "no_such_column = 1"),
                  rule("T", "target_path"), rule("L", "true"), rule("X", "kind = = 'a'"), rule("N", "42")],
        "correlations": [{**rule("C"), "window": "0s", "threshold": 0, "group_by": [""]},
                         {**rule("D"), "window": "5m", "threshold": 1, "group_by": ["event.no.such"]},
                         {**rule("W"), "window": "5 parsecs", "threshold": 1}],
        "baselines": [{**rule("B"), "track": []}],
    }
    with pytest.raises(InvalidCatalogue) as err:
        load_rules(catalogue_of(spark, families), one_event)
    found = {(v.rule_id, v.check) for v in err.value.violations}
    assert found == {
        ("", "required"), ("S", "severity"), ("S", "duplicate"), ("P", "predicate"), ("T", "predicate"),
        ("X", "predicate"), ("N", "predicate"), ("C", "required"), ("C", "threshold"), ("C", "group_by"),
        ("D", "path"), ("W", "duration"), ("B", "required"),
    }


def test_durations_are_checked_once(spark, one_event):
    texts = {"Z": "0h0m", "N": "-5m", "M": "abc", "P": "5m x", "OK": "1h30.5m", "SPACE": " 5m ", "NONE": None, "U": "5"}
    families = {
        "correlations": [{**rule(k), "window": v, "threshold": 1} for k, v in texts.items()],
        "baselines": [{**rule("L"), "track": ["machine_id"], "learning_period": "-1h"},
                      {**rule("L0"), "track": ["machine_id"], "learning_period": "0s"},
                      {**rule("LX"), "track": ["machine_id"], "learning_period": "soon"}],
    }
    with pytest.raises(InvalidCatalogue) as err:
        load_rules(catalogue_of(spark, families), one_event)
    assert sorted((v.rule_id, v.check) for v in err.value.violations) == [
        ("L", "duration"), ("LX", "duration"), ("M", "duration"), ("N", "duration"), ("NONE", "required"),
        ("P", "duration"), ("U", "duration"), ("Z", "required"),
    ]


def test_thresholds_that_no_window_reaches(spark, one_event):
    catalogue = catalogue_of(spark, {"correlations": [{**rule("C"), "window": "5m", "threshold": 1500}]})
    with pytest.raises(InvalidCatalogue) as err:
        load_rules(catalogue, one_event)
    assert [(v.rule_id, v.check) for v in err.value.violations] == [("C", "threshold")]
    found = load_rules(catalogue, one_event, max_events=2000).correlations
    assert window_specs(found, 2000)[0].threshold == 1500
    assert len(load_rules(catalogue, one_event, max_events=None).correlations) == 1


def test_rules_come_in_the_order_of_files_and_places(spark, one_event):
    import os

    path = tempfile.mkdtemp(prefix="fleetsight-test-")
    os.makedirs(path + "/b")
    write(path, "c.json", {"rules": [rule("Z"), rule("A")]})
    write(path, "b/x.json", {"rules": [rule("M"), rule("B"), rule("K")]})
    write(path, "a.json", {"rules": [rule("Y")]})
    rules = load_rules(read_catalogue(spark, path), one_event).rules
    assert [r.id for r in rules] == ["Y", "M", "B", "K", "Z", "A"]
    both = read_catalogue(spark, path).merge(catalogue_of(spark, {"rules": [rule("Q"), rule("P")]}))
    assert [r.id for r in load_rules(both, one_event).rules] == ["Y", "M", "B", "K", "Z", "A", "Q", "P"]


@pytest.mark.parametrize("expr, kinds", [
    ("kind = 'execution'", {"execution"}),
    ("'fork' = KIND AND event_seq / 0 = 1", {"fork"}),
    ("kind IN ('a', 'b') AND kind = 'a'", {"a"}),
    ("kind = 'a' AND kind = 'b'", set()),
    ("(kind = 'a' AND decision = 'x') OR kind IN ('b', 'c')", {"a", "b", "c"}),
    ("kind = 'a' OR decision = 'x'", None),
    ("NOT kind = 'a'", None),
    ("kind <> 'a'", None),
    ("kind = target_path", None),
    ("kind IN ('a', target_path)", None),
    ("kind = 1", None),
    ("kind <=> 'a'", None),
    ("upper(kind) = 'A'", None),
    ("execution.kind = 'a'", None),
    ("exists(decoded_args, kind -> kind = 'a')", None),
    ("exists(decoded_args, a -> a = 'x') AND kind = 'a'", {"a"}),
    ("kind = = 'a'", None),
])
def test_kinds_that_a_predicate_implies(spark, expr, kinds):
    assert implied_kinds(spark, expr) == kinds


def test_only_the_kinds_of_rules_are_read(spark, events_of):
    path = tempfile.mkdtemp(prefix="fleetsight-test-") + "/store"
    pairs = [execution(seq=1, path="/x"), file_access(seq=2), execution(seq=3, path="/y")]
    write_normalized(events_of(pairs), path)
    stored = read_normalized(spark, path)
    bad = "kind = 'execution' AND cast(target_path AS int) = 1"
    families = {"rules": [rule("E", "kind = 'execution' AND target_path = '/x'"), rule("BAD", bad),
                          rule("BAD2", bad + " AND cast(target_path AS int) = 1"),
                          rule("OVER", "kind = 'execution' AND event_seq + 9223372036854775807 < 0"),
                          rule("OVER2", "kind = 'execution' AND event_seq + 9223372036854775807 < 5")]}
    rules = load_rules(catalogue_of(spark, families), stored).rules
    hits = match(stored, rules)
    shown = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [kind" in shown and "execution" in shown.split("PartitionFilters: ")[1].split("]")[0]
    assert [(r.rule_idx, r.event_seq) for r in hits.collect()] == [(0, 1)]
    assert [(r.rule_idx, r.event_seq) for r in match(events_of(pairs), rules).collect()] == [(0, 1)]
    windows = [{**rule("C", "kind = 'execution' AND octet_length(target_path) > 0"), "window": "5m", "threshold": 2}]
    window = load_rules(catalogue_of(spark, {"correlations": windows}), stored)
    fired = plan.correlation_signals(stored, window, plan.Settings())
    shown = fired._jdf.queryExecution().executedPlan().toString()
    assert 0 < shown.count("PartitionFilters: [kind") == shown.count("PartitionFilters: ")
    assert fired.count() == 1
    none = load_rules(catalogue_of(spark, {"rules": [rule("NEVER", "kind = 'a' AND kind = 'b'")]}), stored).rules
    assert match(stored, none).count() == 0


def test_many_rules_are_planned(spark, events_of):
    import time

    events = events_of([execution(seq=1, path="/x1")])
    many = [rule(f"R{i}", f"kind = 'execution' AND target_path = '/x{i}'") for i in range(2000)]
    rules = catalogue_of(spark, {"rules": many}).rules.orderBy("place").collect()
    start = time.time()
    assert [r.rule_idx for r in match(events, rules).select("rule_idx").collect()] == [1]
    assert time.time() - start < 60


def test_lenient_paths_are_allowed(spark, one_event):
    families = {"correlations": [{**rule("D"), "window": "5m", "threshold": 1, "group_by": ["event.no.such"]}]}
    assert len(load_rules(catalogue_of(spark, families), one_event, strict=False).correlations) == 1
    assert plan_violations(one_event, {"correlations": [workload.DISTINCT_RULE]}).count() == 0


def test_predicate_problem(one_event):
    assert predicate_problem(one_event, "true") is None
    assert predicate_problem(one_event, "exists(decoded_args, a -> a = 'x')") is None
    assert "NOT_BOOLEAN" in predicate_problem(one_event, "'text'")
    assert predicate_problem(one_event, "missing_column") is not None


def test_disabled_rules_and_failing_predicates_do_not_stop_others(spark, events_of):
    families = {"rules": [
        rule("OFF", enabled=False), rule("CAST", "cast(target_path AS int) = 1"),
        rule("INDEX", "decoded_args[500] = 'x'"), rule("DIVIDE", "1 / (event_seq - event_seq) > 0"),
        rule("ALL", "true"), rule("EXEC"),
    ]}
    events = events_of([execution(seq=1, path="/x"), file_access(seq=2)])
    rules = load_rules(catalogue_of(spark, families), events).rules
    hits = match(events, rules).select("event_seq", "rule_idx").collect()
    names = sorted((r.event_seq, rules[r.rule_idx]["id"]) for r in hits)
    assert names == [(1, "ALL"), (1, "EXEC"), (2, "ALL")]


def test_many_rules_match_in_order(spark, events_of):
    from pyspark.sql import Row

    rules = [Row(**rule(f"R{n}", f"target_path = '/p{n % 7}'")) for n in range(450)]
    hits = match(events_of([execution(seq=1, path="/p3")]), rules).select("rule_idx").collect()
    assert [r.rule_idx for r in hits] == [n for n in range(450) if n % 7 == 3]


def signals(spark, events, families):
    rules = load_rules(catalogue_of(spark, families), events)
    return signals_from_matches(match(events, rules.rules), rules.rules)


def test_ids_change_with_every_part_and_only_then(spark, events_of):
    base = dict(path="/t", sha="h", actor="/a")
    pairs = [
        execution(seq=1, **base), execution(seq=2, **base), execution(seq=3, **{**base, "actor": "/b"}),
        execution(seq=4, machine="m2", **base), execution(seq=5, at="2024-01-01T00:00:00.000000001Z", **base),
        execution(seq=6, **{**base, "sha": "g"}), execution(seq=7, decision="DECISION_DENY", **base),
    ]
    rows = signals(spark, events_of(pairs), {"rules": [rule("R")]}).select("event_seq", "signal_id").collect()
    ids = {r.event_seq: r.signal_id for r in rows}
    assert all(len(i) == 32 for i in ids.values())
    assert ids[1] == ids[2] and len(set(ids.values())) == 6


def test_context_holds_only_set_fields_and_what_the_rule_asks(spark, events_of):
    events = events_of([execution(seq=1, path="/t", args=["-a", "b"], user="ann"), file_access(seq=2, signing_id="s")])
    families = {"rules": [
        rule("R", description="  padded \n", extra_context=["event.execution.args", "event.execution.target.effective_user.name",
                                                            "event.execution.target.executable.cdhash", ""]),
        rule("E", "kind = 'file_access'", include_event=True),
    ]}
    rows = {r.rule_id: r for r in signals(spark, events, families).collect()}
    assert json.loads(rows["R"].context) == {
        "target_path": "/t", "decision": "DECISION_ALLOW", "kind": "execution", "execution.args": ["-a", "b"],
        "execution.target.effective_user.name": "ann",
    }
    assert rows["R"].rule_description == "padded" and rows["R"].status == "open"
    event = json.loads(rows["E"].context)["event"]
    assert event["file_access"]["policy_name"] == "P" and event["file_access"]["instigator"]["is_platform_binary"] is None
    assert "execution" not in event


def test_artifact_first_seen_is_set_once_per_host(spark, events_of):
    pairs = [execution(seq=n, machine=m, at=f"2024-01-01T00:00:0{n}Z", sha=h)
             for n, (m, h) in enumerate([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("a", "")])]
    events = events_of(pairs)
    rules = load_rules(catalogue_of(spark, {"rules": [rule("R1"), rule("R2", "true")]}), events)
    out = plan.simple_signals(events, rules, plan.Settings()).select("source_seq", "rule_id", "context").collect()
    marked = {(r.source_seq, r.rule_id) for r in out if json.loads(r.context).get("first_seen")}
    assert len(out) == 10 and marked == {(0, "R1"), (2, "R1"), (3, "R1")}


def test_flag_first_on_a_hot_key(spark):
    df = spark.range(5000).selectExpr("'hot' AS k", "(id * 7919) % 5000 AS t")
    flagged = first_seen.flag_first(df, ["k"], ["t"], "is_first")
    assert flagged.count() == 5000
    assert [r.t for r in flagged.where("is_first").collect()] == [0]


def test_baseline_first_then_known_then_new(events_of):
    pairs = [execution(seq=n, at=f"2024-01-01T00:00:0{n}Z", path="/p", sha=h) for n, h in enumerate(["a", "a", "b"])]
    found = first_seen.baseline_matches(events_of(pairs), [workload.HASHES], -(2**60))
    assert sorted(r.event_seq for r in found.collect()) == [0, 2]


def test_pattern_learnt_in_the_learning_period_never_alerts(events_of):
    days = ["2024-01-01", "2024-01-20", "2024-01-21"]
    pairs = [execution(seq=n, at=f"{d}T00:00:00Z", path="/p", sha=h) for n, (d, h) in enumerate(zip(days, "aab"))]
    found = first_seen.baseline_matches(events_of(pairs), [workload.HASHES], 1_704_067_200 * 10**9)
    assert {(r.event_seq, r.in_learning) for r in found.collect()} == {(0, True), (2, False)}
    assert [r.event_seq for r in first_seen.alerts(found).collect()] == [2]


def test_detect_has_all_families_and_reproducible_ids(spark):
    ev = workload._events(spark, SMALL)
    rules = load_rules(default_catalogue(spark), ev)
    rules = EnabledRules(rules.rules, [workload.DISTINCT_RULE], rules.baselines)
    found = plan.detect(ev, rules, plan.Settings())
    again = plan.detect(ev.repartition(5), rules, plan.Settings())
    ids = sorted(r.signal_id for r in found.select("signal_id").collect())
    assert ids == sorted(r.signal_id for r in again.select("signal_id").collect())
    kinds = {r.rule_id for r in found.select("rule_id").distinct().collect()}
    assert {"SM-001", "C-DISTINCT", "SM-BASE-001"} <= kinds
    assert as_signals(found).columns == found.columns


def test_signals_name_the_archived_file(spark, events_of):
    from pyspark.sql import functions as F

    pairs = [execution(seq=n, at=f"2024-01-01T00:00:0{n}Z", path="/p", sha="a") for n in range(3)]
    events = events_of(pairs).withColumn("source_file", F.concat(F.lit("file:/spool/new/f"), "event_seq"))
    window = {**rule("C"), "window": "5m", "threshold": 3}
    families = {"rules": [rule("R", "event_seq = 1")], "correlations": [window],
                "baselines": [{**rule("B"), "track": ["event.execution.target.executable.path"]}]}
    rules = load_rules(catalogue_of(spark, families), events)
    found = plan.detect(events, rules, plan.Settings(archive_dir="/kept/")).select("rule_id", "context").collect()
    paths = {r.rule_id: json.loads(r.context)["spool_archive_path"] for r in found}
    assert paths == {"R": "/kept/f1", "C": "/kept/f2", "B": "/kept/f0"}


def test_first_seen_prunes_before_the_shuffle(spark):
    ev = workload._events(spark, SMALL)
    text = first_seen.baseline_matches(ev, [workload.HASHES], 0)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_simple_rules_are_one_scan_without_python(spark):
    ev = workload._events(spark, SMALL)
    rules = load_rules(default_catalogue(spark), ev).rules
    text = match(ev, rules)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "Exchange" not in text and "Python" not in text


def test_predicates_are_compiled(spark, events_of):
    events = events_of([execution()])
    hits = match(events, load_rules(default_catalogue(spark), events).rules)
    plan_text = hits._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan_text.splitlines() if "Generate explode" in x)
    assert "*(" in line, line
    assert "octet_length" not in line  # the predicates are a projection below

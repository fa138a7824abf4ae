"""Threshold windows: literal sequences, random sequences against a plain fold, hot groups."""

import random

import pytest
from conftest import execution, file_access

from fleetsight.functions.paths import UnknownPath
from fleetsight.operators.correlate import correlate, correlation_events, fold_windows, windowed_counts
from fleetsight.operators.window_fold import LiveWindow, SliceFold, WindowSpec, entry_applies
from fleetsight.plans.workload import _correlation

SECOND = 1_000_000_000
HASH = "event.execution.target.executable.hash.hash"
USER = "event.execution.target.effective_user.name"


def plain_fold(rows, spec):
    """Event by event, as a single process would."""
    live, out = [], []
    for ns, seq, value in rows:
        live.append((ns, seq, value))
        if spec.window_ns:
            live = [e for e in live if ns - e[0] <= spec.window_ns]
        if spec.max_events:
            live = live[-spec.max_events:]
        count = len({e[2] for e in live if e[2]}) if spec.distinct else len(live)
        if count >= spec.threshold:
            values = list(dict.fromkeys(e[2] for e in live if e[2])) if spec.distinct else None
            out.append((ns, seq, count, live[0][0], live[0][1], values))
            live = []
    return out


def at(seconds):
    return f"2024-01-01T00:{int(seconds) // 60:02d}:{seconds % 60:06.3f}Z"


def deny(seq, seconds=None, **fields):
    return execution(seq=seq, at=at(seq if seconds is None else seconds), decision="DECISION_DENY", **fields)


DENIED = "kind = 'execution' AND decision = 'DECISION_DENY'"


def fired(events, rule, **options):
    rows = correlate(events, [rule], **options).select("seq", "event_count", "first_seq", "group_key").collect()
    return sorted(tuple(r) for r in rows)


def test_third_fires_and_fourth_does_not(events_of):
    rule = _correlation("C", expr=DENIED, window="5m", threshold=3)
    assert fired(events_of([deny(n) for n in range(1, 5)]), rule) == [(3, 3, 1, "_global")]


def test_groups_do_not_mix(events_of):
    seen = [("h1", "u1"), ("h1", "u1"), ("h1", "u2"), ("h2", "u1"), ("h1", "u1"), ("h1", "u2"), ("h2", "u1")]
    events = events_of([deny(n + 1, sha=h, user=u) for n, (h, u) in enumerate(seen)])
    rule = _correlation("C", expr=DENIED, window="5m", threshold=3, group_by=[HASH, USER])
    key = f"{HASH[6:]}=h1|{USER[6:]}=u1"
    assert fired(events, rule) == [(5, 3, 1, key)]


def test_distinct_ignores_repeats_and_empty_values(events_of):
    seen = ["h1", "h1", "h2", "", "h1", "h3"]
    events = events_of([deny(n + 1, sha=h) for n, h in enumerate(seen)])
    rule = _correlation("C", expr=DENIED, window="5m", threshold=3, count_distinct=HASH)
    row = correlate(events, [rule]).first()
    assert (row["seq"], row["event_count"], row["distinct_values"]) == (6, 3, ["h1", "h2", "h3"])


def test_old_events_expire_and_the_edge_is_inside(events_of):
    rule = _correlation("C", expr=DENIED, window="100ms", threshold=3)
    assert fired(events_of([deny(1, 0), deny(2, 0), deny(3, 0.15)]), rule) == []
    edge = _correlation("C", expr=DENIED, window="5m", threshold=2)
    assert fired(events_of([deny(1, 0), deny(2, 300)]), edge) == [(2, 2, 1, "_global")]


def test_filter_keeps_other_events_out(events_of):
    rule = _correlation("C", expr=DENIED + " AND startswith(target_path, '/tmp/')", window="5m", threshold=2)
    events = events_of([
        deny(1, path="/tmp/a"), deny(2, path="/usr/a"), execution(seq=3, at=at(3), path="/tmp/a"), deny(4, path="/tmp/a"),
    ])
    assert fired(events, rule) == [(4, 2, 1, "_global")]


def test_event_without_time_is_never_live(events_of):
    rule = _correlation("C", expr=DENIED, window="5m", threshold=2)
    events = events_of([deny(1), execution(seq=2, at=None, decision="DECISION_DENY")])
    assert fired(events, rule) == []


def test_cap_below_threshold_never_fires(events_of):
    rule = _correlation("C", expr=DENIED, window="5m", threshold=3)
    assert fired(events_of([deny(n) for n in range(1, 9)]), rule, max_events=2) == []


def test_hosts_apart_or_together(events_of):
    pairs = [file_access(machine=f"m{n % 2}", seq=n, at=at(n)) for n in range(1, 5)]
    rule = _correlation("C", expr="kind = 'file_access'", window="5m", threshold=4)
    events = events_of(pairs)
    assert fired(events, rule) == []
    assert fired(events, rule, scope="fleet") == [(4, 4, 1, "_global")]


def test_several_rules_on_one_event(events_of):
    rules = [_correlation(f"C{t}", expr=DENIED, window="5m", threshold=t) for t in (2, 3)]
    rows = correlate(events_of([deny(n) for n in range(1, 5)]), rules).select("rule_idx", "seq").collect()
    assert sorted(tuple(r) for r in rows) == [(0, 2), (0, 4), (1, 3)]


def test_unknown_path_is_an_error_or_empty(events_of):
    events = events_of([deny(1), deny(2)])
    rule = _correlation("C", expr=DENIED, window="5m", threshold=2, group_by=["nonexistent.field"])
    with pytest.raises(UnknownPath):
        correlate(events, [rule])
    assert fired(events, rule, strict=False) == [(2, 2, 1, "nonexistent.field=")]


def random_rows(rng, groups, n):
    rows, clock = [], dict.fromkeys(groups, 0)
    for seq in range(n):
        group = groups[0] if rng.random() < 0.5 else rng.choice(groups)
        clock[group] += rng.choice([0, 0, 1, 2, 3, 10, 40]) * SECOND
        rows.append((group, clock[group], seq, rng.choice(["a", "b", "c", "d", "e", ""])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_sequences_equal_a_plain_fold(spark, seed):
    """Slices as narrow as they may be, one group holding half of all rows."""
    rng = random.Random(seed)
    specs = [
        WindowSpec(30 * SECOND, 3, 1000, True),
        WindowSpec(20 * SECOND, 4, 1000, False),
        WindowSpec(60 * SECOND, 4, 6, True),
    ]
    groups = [f"g{n}" for n in range(6)]
    rows = [(idx, *r) for idx in range(3) for r in random_rows(rng, groups, 400)]
    df = spark.createDataFrame(
        [(i, "m", g, v, ns, s, None) for i, g, ns, s, v in rows],
        "rule_idx int, scope string, group_key string, value string, ts_ns bigint, seq bigint, payload string",
    )
    got = sorted(
        (r.rule_idx, r.group_key, r.ts_ns, r.seq, r.event_count, r.first_ns, r.first_seq, r.distinct_values)
        for r in fold_windows(df, specs, min_slice_ns=SECOND).collect()
    )
    want = []
    for idx, spec in enumerate(specs):
        for g in groups:
            mine = sorted((ns, s, v) for i, gg, ns, s, v in rows if (i, gg) == (idx, g))
            want += [(idx, g, *f) for f in plain_fold(mine, spec)]
    assert got == sorted(want)
    assert len(got) > 50


@pytest.mark.parametrize("rows_per_piece", [7, 40, 150])
def test_busy_slices_are_cut_and_still_exact(spark, monkeypatch, rows_per_piece):
    from fleetsight.operators import correlate as module

    monkeypatch.setattr(module, "NARROW_SLICE_NS", 0)
    rng = random.Random(rows_per_piece)
    specs = [
        WindowSpec(400 * SECOND, 4, 12, True),
        WindowSpec(300 * SECOND, 5, 1000, False),
        WindowSpec(0, 6, 1000, False),
    ]
    groups = ["hot", "b", "c", "d"]
    rows = [(idx, *r) for idx in range(3) for r in random_rows(rng, groups, 500)]
    df = spark.createDataFrame(
        [(i, "m", g, v, ns, s, None) for i, g, ns, s, v in rows],
        "rule_idx int, scope string, group_key string, value string, ts_ns bigint, seq bigint, payload string",
    )
    fires = fold_windows(df, specs, min_slice_ns=SECOND, rows_per_piece=rows_per_piece)
    got = sorted((r.rule_idx, r.group_key, r.ts_ns, r.seq, r.event_count, r.first_ns, r.first_seq) for r in fires.collect())
    want = []
    for idx, spec in enumerate(specs):
        for g in groups:
            mine = sorted((ns, s, v) for i, gg, ns, s, v in rows if (i, gg) == (idx, g))
            want += [(idx, g, *f[:5]) for f in plain_fold(mine, spec)]
    assert got == sorted(want)
    assert len(got) > 50


def test_narrow_slices_settle_by_entry():
    """The fold alone: any slicing gives what one pass gives."""
    rng = random.Random(7)
    for _ in range(300):
        spec = WindowSpec(rng.choice([3, 10]), rng.choice([1, 2, 4]), rng.choice([3, 1000]), rng.random() < 0.5)
        clock, rows = 0, []
        for seq in range(40):
            clock += rng.choice([0, 1, 1, 2, 9])
            rows.append((clock, seq, rng.choice("abcd")))
        width = spec.window_ns * rng.choice([1, 2])
        slices = {}
        for row in rows:
            own = row[0] // width
            slices.setdefault(own, []).append((row, False))
            if row[0] + spec.window_ns >= (own + 1) * width:
                slices.setdefault(own + 1, []).append((row, True))
        got, entry = [], None
        for number in sorted(slices):
            fold = SliceFold(spec)
            fires = [f for row, carried in sorted(slices[number]) for f in fold.push(*row, carried)]
            got += [f.position[:2] for f in fires if entry_applies(entry, f.entry_from, f.entry_to, f.wraps)]
            last = [f.position for f in fold.exits() if entry_applies(entry, f.entry_from, f.entry_to, f.wraps)]
            assert len(last) <= 1
            entry = last[0] if last else entry
        assert got == [f[:2] for f in plain_fold(rows, spec)]


def test_live_window_keeps_only_what_can_count():
    window = LiveWindow(WindowSpec(150, 5, 2, False))
    for ns, seq in ((0, 1), (200, 2), (210, 3), (220, 4)):
        assert window.push(ns, seq, "") is None
    assert [e[1] for e in window.events] == [3, 4]
    assert window.push(10, 5, "") is None
    assert [e[1] for e in window.events] == [3, 4]


def test_windowed_counts_equal_brute_force(spark):
    rng = random.Random(3)
    spec = WindowSpec(30 * SECOND, 3, 1000, True)
    rows = random_rows(rng, ["a", "b", "c"], 300)
    df = spark.createDataFrame(
        [(0, "m", g, v, ns, s, None) for g, ns, s, v in rows],
        "rule_idx int, scope string, group_key string, value string, ts_ns bigint, seq bigint, payload string",
    )
    got = {r.seq: (r.live_count, r.live_distinct) for r in windowed_counts(df, [spec]).collect()}
    for group, ns, seq, _ in rows:
        live = [v for g, t, s, v in rows if g == group and (t, s) <= (ns, seq) and ns - t <= spec.window_ns]
        assert got[seq] == (len(live), len({v for v in live if v}))


def test_fold_plan_has_one_wide_shuffle_and_no_group_udf(events_of):
    events = events_of([deny(1)])
    rule = _correlation("C", expr=DENIED, window="5m", threshold=2)
    found = correlation_events(events, [rule])
    plan = fold_windows(found, [WindowSpec(300 * SECOND, 2, 1000, False)])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_windows_are_folded_once(events_of):
    found = correlation_events(events_of([deny(1), deny(2)]), [_correlation("C", expr=DENIED, window="5m", threshold=2)])
    fires = fold_windows(found, [WindowSpec(300 * SECOND, 2, 1000, False)])
    # What is left to run is the pass over the slices that fired; the fold itself is stored.
    assert fires._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert fires.count() == 1

"""Scalar helpers: durations, times, paths, text, JSON, base64, enums, display."""

import base64

import pytest
from conftest import execution, file_access
from pyspark.sql import functions as F

from fleetsight.functions.base64_lists import decode_list, text_list
from fleetsight.functions.display import pattern_line, short_hash, short_path, summary_line
from fleetsight.functions.durations import duration_ns
from fleetsight.functions.enums import enum_name, enum_number
from fleetsight.functions.json_text import json_object, merge_json, raw_member
from fleetsight.functions.paths import UnknownPath, as_text, keyed_text, path_text
from fleetsight.functions.times import ns_timestamp, parse_rfc3339, rfc3339_ns
from fleetsight.operators.normalize import event_json
from fleetsight.schema import ENUMS, KINDS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in values))
    return row.select(column.alias("x")).first()["x"]


TYPES = {"s": "string", "d": "double", "b": "bigint", "a": "array<string>", "n": "bigint"}


@pytest.mark.parametrize("text,ns", [
    ("5m", 300 * 10**9), ("720h", 720 * 3600 * 10**9), ("100ms", 10**8), ("1h30m", 5400 * 10**9), ("1.5s", 15 * 10**8),
    ("0", 0), ("", 0), (None, 0), ("-2s", -2 * 10**9), (7, 7),
])
def test_durations(text, ns):
    assert duration_ns(text) == ns


@pytest.mark.parametrize("text", ["5", "m", "5 m", "5d", "1h-3m"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_ns(text)


def test_times_keep_nanoseconds(spark):
    text = "2024-01-01T00:00:00.123456789Z"
    assert one(spark, rfc3339_ns(F.col("s")), s=text) == 1_704_067_200_123_456_789
    assert one(spark, rfc3339_ns(F.col("s")), s="2024-01-01T02:00:00+02:00") == 1_704_067_200 * 10**9
    assert one(spark, parse_rfc3339(F.col("s")), s="2024-13-01T00:00:00Z") is None
    assert one(spark, parse_rfc3339(F.col("s")), s="yesterday") is None
    near = 1_704_067_200_123_456_999
    assert one(spark, F.unix_micros(ns_timestamp(F.col("n"))), n=near) == 1_704_067_200_123_456
    assert one(spark, F.unix_micros(ns_timestamp(F.col("n"))), n=-1) == -1


def test_value_text(spark):
    shown = spark.sql(
        "SELECT 42.0D AS a, 0.0D AS b, 1.5D AS c, 100.0D AS d, true AS e, array('a', 'b') AS f, 7 AS g, "
        "named_struct('z', 1, 'a', 'x') AS h"
    )
    row = shown.select(*[as_text(F.col(f.name), f.dataType).alias(f.name) for f in shown.schema]).first()
    assert tuple(row) == ("42", "0", "1.5", "100", "true", "[a b]", "7", "map[a:x z:1]")


def test_paths(events_of):
    ev = events_of([execution(seq=1, path="/x", pid=7, args=["a", "b"])])
    paths = ["event.execution.target.executable.path", "execution.target.id.pid", "execution.args", "file_access.policy_name"]
    assert tuple(ev.select(*[path_text(ev, p).alias(f"c{i}") for i, p in enumerate(paths)]).first()) == (
        "/x", "7", "[a b]", "",
    )
    with pytest.raises(UnknownPath):
        path_text(ev, "event.execution.targets")
    with pytest.raises(UnknownPath):
        path_text(ev, "machine_id.deeper")
    key = keyed_text(ev, ["event.machine_id", "no.such"], strict=False)
    assert ev.select(key.alias("k")).first()["k"] == "machine_id=m1|no.such="


def test_json_assembly(spark):
    obj = json_object([("a", F.col("s")), ("b", F.lit(None).cast("string"))])
    assert one(spark, obj, s='x"y') == '{"a":"x\\"y"}'
    assert one(spark, merge_json(F.lit('{"a":1}'), raw_member("b", F.col("s"))), s="[2]") == '{"a":1,"b":[2]}'
    assert one(spark, merge_json(F.col("s"), F.lit("{}")), s='{"a":1}') == '{"a":1}'
    assert one(spark, merge_json(F.lit("{}"), F.col("s")), s='{"a":1}') == '{"a":1}'
    assert one(spark, merge_json(F.lit('{"a":1}'), raw_member("b", F.col("s"))), s=None) == '{"a":1}'


def test_base64_lists(spark):
    coded = [base64.b64encode(t.encode()).decode() for t in ("curl", "", "-é")]
    assert one(spark, decode_list(F.col("a")), a=[*coded, "not base64!", "abc"]) == ["curl", "", "-é", "not base64!", "abc"]
    assert one(spark, text_list(F.col("a"), "base64"), a=None) == []


def test_enums(spark):
    assert len(KINDS) == 24 and sum(len(v) for v in ENUMS.values()) == 39
    assert one(spark, enum_name(F.col("s"), "decision"), s="2") == "DECISION_DENY"
    assert one(spark, enum_name(F.col("s"), "decision"), s="99") == "99"
    assert one(spark, enum_name(F.col("s"), "decision"), s="DECISION_ALLOW") == "DECISION_ALLOW"
    assert one(spark, enum_number(F.col("s"), "launch_item_type"), s="ITEM_TYPE_DAEMON") == 5
    assert one(spark, enum_number(F.col("s"), "launch_item_type"), s="other") is None


def test_display(spark):
    long = "/Library/Frameworks/Python.framework/Versions/3.9/Resources/Python.app/Contents/MacOS/Python"
    assert one(spark, short_path(F.col("s")), s=long) == "/Library/.../MacOS/Python"
    assert one(spark, short_path(F.col("s")), s="/usr/bin/curl") == "/usr/bin/curl"
    assert one(spark, short_path(F.col("s")), s="/a/" + "b" * 70) == "/a/" + "b" * 70
    assert one(spark, short_hash(F.col("s")), s="0123456789abcdef") == "0123456789ab…"
    line = summary_line({"decision": F.lit("D"), "kind": F.col("s"), "actor_path": F.lit("")})
    assert one(spark, line, s="execution") == "kind=execution decision=D"
    both = "execution.target.executable.path=/a=b|execution.target.executable.hash.hash=0123456789abcdef"
    assert one(spark, pattern_line(F.col("s")), s=both) == "path=/a=b hash=0123456789ab…"
    assert one(spark, pattern_line(F.col("s")), s="execution.target.executable.cdhash=c") == "hash=c"
    assert one(spark, pattern_line(F.col("s")), s="user=ann") == "user=ann"


def test_normalised_defaults(events_of):
    ev = events_of([execution(seq=1), file_access(seq=2, signing_id="s"), ({"machine_id": "m", "fork": {}}, 3)])
    rows = {r.event_seq: r for r in ev.collect()}
    assert (rows[1].kind, rows[1].mode, rows[1].reason, rows[1].decoded_args) == ("execution", "MODE_UNKNOWN", "REASON_UNKNOWN", [])
    assert (rows[2].actor_team, rows[2].actor_signing_id, rows[2].decision) == ("TT", "s", "POLICY_DECISION_DENIED")
    assert (rows[3].kind, rows[3].decision, rows[3].actor_is_platform_binary, rows[3].order_ns) == ("fork", "", False, 0)
    text = {r.event_seq: r.j for r in ev.select("event_seq", event_json(ev).alias("j")).collect()}
    assert '"fork":{' in text[3] and "execution" not in text[3].replace('"kind":"fork"', "")


def test_sequence_is_made_from_content_when_missing(spark):
    from fleetsight.operators.normalize import normalize
    from fleetsight.schema import telemetry_ddl

    lines = spark.createDataFrame([('{"machine_id":"a","fork":{}}',), ('{"machine_id":"b","fork":{}}',)], "value string")
    raw = lines.select(F.inline(F.array(F.from_json("value", telemetry_ddl()))))
    first = [r.event_seq for r in normalize(raw).orderBy("machine_id").collect()]
    again = [r.event_seq for r in normalize(raw.repartition(3)).orderBy("machine_id").collect()]
    assert first == again and len(set(first)) == 2

"""Blocks without typed fields, contexts as values, predicates that fail."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetsight.functions.json_text import Members, last_members, merge_json, overwrite_json
from fleetsight.functions.paths import path_text, path_type
from fleetsight.operators.match import holds, match
from fleetsight.operators.normalize import event_json, normalize
from fleetsight.schema import KINDS, telemetry_schema
from fleetsight.sources.telemetry import CORRUPT, parse_lines, read_normalized, write_normalized


def parsed(spark, *values):
    rows = [(json.dumps(v) if isinstance(v, dict) else v, "f") for v in values]
    return parse_lines(spark.createDataFrame(rows, "value string, source_file string"))


def shown(spark, value):
    events = parsed(spark, {"machine_id": "m", "authentication": {"v": value}})
    return events.select(path_text(events, "event.authentication.v")).first()[0]


@pytest.mark.parametrize("value, text", [
    ("x", "x"), (True, "true"), (7, "7"), (1.5, "1.5"), (2.0, "2"), (None, ""), ([], "[]"), ([1, "a", None, [2.25]], "[1 a <nil> [2.25]]"),
    ({"b": 1, "a": {"c": False}}, "map[a:map[c:false] b:1]"),
])
def test_text_of_what_a_block_holds(spark, value, text):
    assert shown(spark, value) == text


def test_every_kind_keeps_its_fields(spark):
    kinds = [k for k in KINDS if path_type(telemetry_schema(), k).typeName() == "variant"]
    assert len(kinds) == 19
    events = normalize(parsed(spark, *[{"machine_id": "m", k: {"deep": {"n": i}}} for i, k in enumerate(kinds)]))
    rows = events.select("kind", event_json(events).alias("e"), "event_seq").collect()
    assert {r.kind: json.loads(r.e)[r.kind]["deep"]["n"] for r in rows} == {k: i for i, k in enumerate(kinds)}
    assert len({r.event_seq for r in rows}) == 19  # records without a sequence are told apart by their blocks


def test_null_and_wrong_blocks(spark):
    events = parsed(spark, {"machine_id": "a", "disk": None}, {"machine_id": "b", "disk": "text"}, {"machine_id": "c", "disk": {}})
    rows = {r.machine_id: r for r in events.select("machine_id", F.col("disk").isNull().alias("unset"), CORRUPT).collect()}
    assert rows["a"].unset and rows["a"][CORRUPT] is None
    assert rows["b"][CORRUPT] is not None
    assert not rows["c"].unset and rows["c"][CORRUPT] is None


def test_open_blocks_in_the_store(spark, tmp_path):
    records = parsed(spark, {"machine_id": "m", "event_time": "2024-01-01T00:00:00Z", "open_ssh": {"user": {"name": "u"}}})
    write_normalized(normalize(records).drop(CORRUPT), str(tmp_path / "s"))
    back = read_normalized(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in back.select("kind", path_text(back, "open_ssh.user.name")).collect()] == [("open_ssh", "u")]


def test_paths_below_open_blocks_are_known(spark):
    assert path_type(telemetry_schema(), "event.authentication.any.thing") is not None
    assert path_type(telemetry_schema(), "event.execution.no_such") is None
    assert path_type(telemetry_schema(), "event.authentication.it's") is None


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column).first()[0]


def test_later_members_win(spark):
    members = Members([("a", F.lit(1)), ("b", F.col("s"))])
    members.put("a", F.lit(None).cast("int"))
    members.put("b", F.lit('{"c":1}'), is_json=True)
    members.put("d", F.lit("x"))
    assert json.loads(one(spark, members.json(), s="q")) == {"a": 1, "b": {"c": 1}, "d": "x"}
    members.put("b", F.lit("plain"))
    assert json.loads(one(spark, members.json(), s="q"))["b"] == "plain"


@pytest.mark.parametrize("base, fields, expected", [
    ('{"a":1,"b":{"a":2}}', {"a": "x"}, {"a": "x", "b": {"a": 2}}),
    ('{"b":{"a":2}}', {"a": "x"}, {"a": "x", "b": {"a": 2}}),
    ('{"a":1}', {"a": None, "c": "y"}, {"a": 1, "c": "y"}),
    ("{}", {"a": "x"}, {"a": "x"}),
    ('{"a\\"b":1}', {'a"b': "x"}, {'a"b': "x"}),
])
def test_overwriting_members(spark, base, fields, expected):
    text = one(spark, overwrite_json(F.col("t"), [(n, F.lit(v).cast("string")) for n, v in fields.items()]), t=base)
    assert json.loads(text) == expected
    assert json.loads(text, object_pairs_hook=lambda pairs: len(pairs) == len(dict(pairs)))


def test_last_members(spark):
    assert json.loads(one(spark, last_members(F.col("t")), t='{"a":1,"b":2,"a":{"c":3}}')) == {"a": {"c": 3}, "b": 2}
    assert one(spark, last_members(F.col("t")), t="[1]") is None


def test_parts_of_a_context_are_named_once(spark):
    events = parsed(spark, {"machine_id": "m", "authentication": {"v": 1}})
    whole = Members([("a", F.lit(1))])
    whole.put("event", event_json(normalize(events)), is_json=True)
    stored = [(n, F.col(n).cast("string")) for n in ("a", "b")]
    for column, costly in [
        (whole.json(), "date_format(event_time"), (last_members(F.col("t")), "from_json"), (overwrite_json(F.col("t"), stored), "from_json"),
    ]:
        assert str(column).count(costly) == 1


def test_values_in_blocks_are_named_once(spark):
    events = parsed(spark, {"machine_id": "m", "authentication": {"v": 1}})
    text = str(path_text(events, "authentication.v"))
    # Of each level its kind and its members: the value itself, and what lists and objects in it hold.
    assert text.count("schema_of_variant") == text.count("map<string,variant>") == 3


@pytest.mark.parametrize("base, extra, expected", [
    ('{"a":"}{"}', '{"b":"\\n{\U0001f600"}', '{"a":"}{","b":"\\n{\U0001f600"}'), ("{}", "{}", "{}"), (None, None, "{}"),
    ('{"a":"x\ny"}', None, '{"a":"x\ny"}'), (None, '{"b":{}}', '{"b":{}}'),
])
def test_members_of_two_objects(spark, base, extra, expected):
    df = spark.createDataFrame([(base, extra)], "a string, b string")
    assert df.select(merge_json(F.col("a"), F.col("b"))).first()[0] == expected


def test_nothing_to_overwrite_leaves_the_text(spark):
    nothing = [("a", F.lit(None).cast("string"))]
    assert one(spark, overwrite_json(F.col("t"), nothing), t='{ "a" : 1 }') == '{ "a" : 1 }'
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(overwrite_json(F.col("t"), nothing)).first()[0] == "{}"
    assert df.select(overwrite_json(F.col("t"), [("a", F.lit("x"))])).first()[0] == '{"a":"x"}'


FAILING = [
    "event_seq + 9223372036854775807 < 0", "cast(event_seq * 10000000000 AS int) < 0", "element_at(array(1), cast(event_seq - event_seq AS int)) = 1",
    "kind rlike concat('(', kind)", "raise_error('x') = 'y'", "1 / (event_seq - event_seq) > 0", "cast(kind AS int) = 1", "CAST(NULL AS boolean)",
]


@pytest.mark.parametrize("whole_stage, factory", [("true", "FALLBACK"), ("false", "FALLBACK"), ("false", "NO_CODEGEN")])
def test_failing_predicates_stop_nothing(spark, whole_stage, factory):
    settings = {"spark.sql.codegen.wholeStage": whole_stage, "spark.sql.codegen.factoryMode": factory}
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(1, 101).select(F.col("id").alias("event_seq"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind")).repartition(2)
    rules = [Row(id=str(i), expr=e) for i, e in enumerate([*FAILING, "kind = 'k1' -- with a remark", *FAILING])]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hits = [tuple(r) for r in match(df, rules).groupBy("rule_idx").count().collect()]
        assert hits == [(len(FAILING), 34)]
        assert df.select(*[holds(e) for e in FAILING]).distinct().collect() == [Row(*[False] * len(FAILING))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rules_need_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            match(spark.range(1).withColumn("kind", F.lit("k")), [Row(id="a", expr="true")])
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")

"""Streams give the signals that batch gives."""

import tempfile

from conftest import SMALL
from pyspark.sql import functions as F

from fleetsight.operators import first_seen
from fleetsight.operators.correlate import correlate
from fleetsight.operators.normalize import normalize
from fleetsight.operators.signals import as_signals, signals_from_baselines
from fleetsight.plans import detect as plan
from fleetsight.plans import workload
from fleetsight.plans.views import telemetry
from fleetsight.sources.catalogue import EnabledRules, default_catalogue, load_rules
from fleetsight.sources.telemetry import stream_json_lines
from fleetsight.streaming import detect as streaming


def folder():
    return tempfile.mkdtemp(prefix="fleetsight-test-")


def slices(spark, parts=3):
    """The small events as normalised Parquet, one file per time range, streamed file by file."""
    path = folder()
    ev = normalize(telemetry(spark, SMALL), args_encoding="text")
    bounds = ev.agg(F.min("event_seq"), F.max("event_seq")).first()
    step = (bounds[1] - bounds[0]) // parts + 1
    for n in range(parts):
        low = bounds[0] + n * step
        ev.where((F.col("event_seq") >= low) & (F.col("event_seq") < low + step)).coalesce(1).write.mode(
            "append"
        ).parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stored, stream


def drain(df, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", folder()).trigger(
        availableNow=True
    ).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_window_stream_equals_batch(spark):
    stored, stream = slices(spark)
    rules = [workload.COUNT_RULE, workload.GLOBAL_RULE]
    columns = ["rule_idx", "scope", "group_key", "ts_ns", "seq", "event_count", "first_ns"]
    batch = rows(correlate(stored, rules), *columns)
    fires = streaming.window_fires(stream, rules, plan.Settings(), with_payload=False)
    assert rows(drain(fires, "fires"), *columns) == batch
    assert batch


def test_window_signals_and_idle_cleanup(spark):
    stored, stream = slices(spark)
    rules = [workload.GLOBAL_RULE]
    settings = plan.Settings()
    expected = rows(plan.correlation_signals(stored, EnabledRules([], rules, []), settings), "signal_id", "context")
    found = streaming.window_signals(stream, rules, settings, forget_idle_after="240h")
    assert rows(drain(found, "window_signals"), "signal_id", "context") == expected
    assert expected


def test_baseline_stream_equals_batch(spark):
    stored, stream = slices(spark)
    rules = [workload.HASHES]
    settings = plan.Settings(learning_start_ns=int(workload.LEARNING_START.timestamp()) * 10**9)
    matches = first_seen.baseline_matches(stored, rules, settings.learning_start_ns)
    expected = rows(as_signals(signals_from_baselines(first_seen.alerts(matches), rules)), "signal_id", "ts")
    assert rows(drain(streaming.baseline_signals(stream, rules, settings), "base"), "signal_id", "ts") == expected
    assert expected


def test_simple_stream_into_store_keeps_first_copy(spark):
    stored, stream = slices(spark, 2)
    rules = load_rules(default_catalogue(spark), stored)
    rules = EnabledRules(rules.rules, [], [])
    settings = plan.Settings(tree_ttl=None)
    store = folder() + "/store"
    for _ in range(2):
        streaming.start_simple(stream, rules, settings, store, folder(), executions=stored).awaitTermination(120)
    found = spark.read.parquet(store)
    signals = plan.with_process_tree(
        plan.signals_from_matches(plan.match(stored, rules.rules), rules.rules), stored, rules, settings
    )
    assert rows(found, "signal_id", "context") == rows(signals, "signal_id", "context")


def test_json_directory_stream(spark):
    path = folder()
    lines = ['{"machine_id":"m","event_time":"2024-01-01T00:00:00Z","xprotect":{"detected":{"detected_path":"/x"}}}', "junk"]
    for n, line in enumerate(lines):
        with open(f"{path}/{n}.json", "w") as f:
            f.write(line + "\n")
    got = drain(stream_json_lines(spark, path), "json_dir").select("kind", "_corrupt").collect()
    assert sorted((r[0], r[1]) for r in got) == [("unknown", "junk"), ("xprotect", None)]

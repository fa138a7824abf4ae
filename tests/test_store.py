"""Store and outbox: first copy kept, status, listing, outcomes, positions."""

import tempfile

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import store
from fleetsight.operators.positions import global_position
from fleetsight.schema import MAX_CONTEXT_LENGTH


def signals(spark, *ids, **fields):
    base = {"ts": "2024-01-01 00:00:00", "host_id": "h", "rule_id": "R", "severity": "high", "status": "open",
            "title": "T", "context": "{}", **fields}
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "signal_id string, arrival bigint")
    df = df.withColumns({k: F.lit(v) for k, v in base.items() if k != "ts"})
    return df.withColumns({"ts": F.lit(base["ts"]).cast("timestamp"), "tags": F.array(F.lit("t"))})


def test_ingest_twice(spark):
    first = signals(spark, "a", "b", "a")
    flags = store.ingest_flags(first, signals(spark, "b").select("signal_id"), ["arrival"]).collect()
    assert {(r.arrival, r.duplicate) for r in flags} == {(0, False), (1, True), (2, True)}


@pytest.mark.parametrize("fixed", [False, True])
def test_append_keeps_the_first_copy(spark, fixed):
    path = tempfile.mkdtemp(prefix="fleetsight-test-") + "/signals"
    store.append_signals(signals(spark, "a", "b", "a"), path, ["arrival"], ids_fix_time=fixed)
    store.append_signals(signals(spark, "b", "c", title="second"), path, ["arrival"], ids_fix_time=fixed)
    store.append_signals(signals(spark, "d", severity="urgent"), path, ["arrival"], ids_fix_time=fixed)
    rows = spark.read.parquet(path).select("signal_id", "title").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "T"), ("b", "T"), ("c", "second")]


def test_validation_reasons(spark):
    bad = signals(spark, "x" * 257, status="closed", severity="info", context="c" * (MAX_CONTEXT_LENGTH + 1))
    reasons = bad.select(store.signal_reasons(bad).alias("r")).first()["r"]
    assert reasons == ["signal_id too long", "severity invalid", "status invalid", "context too large"]
    good = signals(spark, "a")
    accepted, rejected = store.split_valid(good, store.signal_reasons(good))
    assert (accepted.count(), rejected.count()) == (1, 0)


def test_status_updates(spark):
    kept = signals(spark, "a", "b", "c").withColumn("status", F.when(F.col("signal_id") == "c", "").otherwise(F.col("status")))
    updates = spark.sql("SELECT * FROM VALUES ('a', 1, 'acknowledged'), ('a', 2, 'resolved'), ('a', 3, 'nonsense'), "
                        "('z', 1, 'open') t(signal_id, n, status)")
    rows = store.update_status(kept, updates, ["n"]).select("signal_id", "status").collect()
    assert {tuple(r) for r in rows} == {("a", "resolved"), ("b", "open"), ("c", "open")}
    assert [r.signal_id for r in store.unknown_updates(kept, updates).collect()] == ["z"]


def test_listing_limits_and_literal_search(spark):
    kept = signals(spark, "a", title="50% done").unionByName(signals(spark, "b", title="501 done"))
    assert [r.signal_id for r in store.list_signals(kept, search="50%").collect()] == ["a"]
    assert store.list_signals(kept, search="50%", wildcards=True).count() == 2
    for wrong in ({"limit": 0}, {"limit": 1001}, {"status": "closed"}):
        with pytest.raises(ValueError):
            store.list_signals(kept, **wrong)
    plan = store.list_signals(kept)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_outbox(spark):
    queue = signals(spark, "a", "b", "").withColumn("enqueued_at", F.col("ts"))
    queued, refused = store.enqueue(queue, spark.sql("SELECT 'b' AS signal_id"))
    assert [r.signal_id for r in queued.collect()] == ["a"] and refused.count() == 1
    outcomes = spark.sql("SELECT * FROM VALUES ('a', false) t(signal_id, delivered)")
    later = F.lit("2030-01-01").cast("timestamp")
    shipped, pending = store.delivery_outcomes(queued, outcomes, later)
    assert shipped.count() == 0
    assert [str(r.enqueued_at) for r in pending.collect()] == ["2030-01-01 00:00:00"]
    assert tuple(store.delivery_counts(outcomes).first()) == (0, 1, 1)


def test_positions_are_dense_whatever_the_spread(spark):
    df = spark.range(4000).selectExpr("(id * 7919) % 4000 AS u", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS hot")
    rows = global_position(df, ["hot", "u"], "p").collect()
    want = sorted((r.hot, r.u) for r in rows)
    assert [want[r.p] for r in rows] == [(r.hot, r.u) for r in rows]


def test_numbered_batches_and_next_batch(spark):
    queue = spark.range(250).selectExpr("concat('s', lpad(cast(249 - id AS string), 3, '0')) AS signal_id", "id DIV 10 AS at")
    sizes = store.numbered_batches(queue, ["at", "signal_id"]).groupBy("batch_no").count().collect()
    assert {(r.batch_no, r["count"]) for r in sizes} == {(0, 100), (1, 100), (2, 50)}
    assert store.next_batch(queue, ["at", "signal_id"], 3).collect()[0].signal_id == "s240"

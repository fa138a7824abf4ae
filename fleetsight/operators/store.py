"""The signal store, the outbox before it, and the reports over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetsight.functions.durations import duration_ns
from fleetsight.functions.json_text import last_members
from fleetsight.operators.positions import global_position
from fleetsight.schema import (
    HEARTBEAT_LIMITS,
    MAX_CONTEXT_LENGTH,
    MAX_TAG_LENGTH,
    MAX_TAGS,
    SEVERITIES,
    SIGNAL_LIMITS,
    STATUSES,
)

DEFAULT_LIST_LIMIT = 100
MAX_LIST_LIMIT = 1000
DEFAULT_BATCH = 100
TOP_RULES = 10
AGENT_WINDOW = "10m"
HEARTBEAT_INTERVAL = "30s"


def _interval(text: str) -> Column:
    return F.make_dt_interval(secs=F.lit(duration_ns(text) / 1e9))


def _reason(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))


# --- validation -----------------------------------------------------------------------------


def signal_reasons(signals: DataFrame) -> Column:
    """Names of the broken ingest rules of a signal, an empty array for a valid one."""
    optional = {"rule_description", "status"}
    checks = []
    for name, limit in SIGNAL_LIMITS.items():
        if name not in signals.columns:
            continue
        value = F.col(name).cast("string")
        if name not in optional:
            checks.append(_reason(f"{name} missing", value.isNull()))
        checks.append(_reason(f"{name} too long", F.char_length(value) > limit))
    checks.append(_reason("severity invalid", ~F.col("severity").isin(*SEVERITIES)))
    checks.append(_reason("status invalid", ~F.col("status").isin(*STATUSES)))
    if "tags" in signals.columns:
        checks.append(_reason("too many tags", F.size("tags") > MAX_TAGS))
        checks.append(_reason("tag too long", F.exists("tags", lambda t: F.char_length(t) > MAX_TAG_LENGTH)))
    if "context" in signals.columns:
        checks.append(_reason("context missing", F.col("context").isNull()))
        checks.append(_reason("context too large", F.char_length("context") > MAX_CONTEXT_LENGTH))
    return F.array_compact(F.array(*checks))


def heartbeat_reasons(heartbeats: DataFrame, time_column: str = "timestamp") -> Column:
    checks = []
    for name, limit in HEARTBEAT_LIMITS.items():
        column = time_column if name == "timestamp" else name
        value = F.col(column).cast("string")
        checks.append(_reason(f"{name} missing", value.isNull()))
        checks.append(_reason(f"{name} too long", F.char_length(value) > limit))
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reasons``)."""
    marked = df.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    return marked.where(ok).drop("reasons"), marked.where(~ok)


# --- signal sink ----------------------------------------------------------------------------


def new_signals(batch: DataFrame, store: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """First arrival of every id that the store does not hold."""
    w = W.partitionBy("signal_id").orderBy(*order)
    first = batch.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if store is None:
        return first
    return first.join(store.select("signal_id"), "signal_id", "left_anti")


def ingest_flags(batch: DataFrame, store: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every arrival with ``duplicate``: its id came earlier in the batch or is stored.

    Earliest arrivals come from a map-side minimum, so an id sent very often costs one row per
    task in the shuffle; the batch is then joined with them.
    """
    rank = F.struct(*order)
    first = batch.groupBy("signal_id").agg(F.min(rank).alias("_first"))
    known = store.select("signal_id").distinct().withColumn("_known", F.lit(True))
    verdict = first.join(known, "signal_id", "left")
    return (
        batch.join(verdict, "signal_id", "left")  # an arrival without an id is no duplicate
        .withColumn("duplicate", F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(rank > F.col("_first"), F.lit(False)))
        .drop("_first", "_known")
    )


def append_signals(
    batch: DataFrame,
    path: str,
    order: Sequence[str],
    received_at: Column | None = None,
    ids_fix_time: bool = False,
    rejected_path: str | None = None,
) -> None:
    """Validated, first-wins append to a Parquet store, partitioned by signal date.

    Signals that break an ingest rule are appended, with their ``reasons``, to a second store at
    ``rejected_path`` (by default ``path`` with ``_rejected``); none is lost.

    ``ids_fix_time`` says that equal ids have equal times, as ids made by this package do; then
    only the store's partitions for the dates the batch has are read to find known ids.
    """
    spark = batch.sparkSession
    accepted, rejected = split_valid(batch, signal_reasons(batch))
    rejected.write.mode("append").parquet(rejected_path or f"{path.rstrip('/')}_rejected")
    dated = accepted.withColumn("ts_date", F.to_date("ts"))
    fresh = new_signals(dated, None, order)
    if _has_store(spark, path):
        keys = ["signal_id", "ts_date"] if ids_fix_time else ["signal_id"]
        known = spark.read.parquet(path).select(*keys)
        if ids_fix_time:
            # A semi join on the partition column prunes; the anti join alone would read the whole store.
            known = known.join(dated.select("ts_date").distinct(), "ts_date", "left_semi")
        fresh = fresh.join(known, keys, "left_anti")
    received = F.current_timestamp() if received_at is None else received_at
    (
        fresh.withColumn("received_at", received)
        .hint("rebalance", "ts_date")
        .write.mode("append")
        .partitionBy("ts_date")
        .parquet(path)
    )


def _has_store(spark: SparkSession, path: str) -> bool:
    try:
        return "signal_id" in spark.read.parquet(path).columns
    except AnalysisException:
        return False


def upsert_heartbeats(store: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key over store and batch."""
    both = store.unionByName(batch)
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# --- status ---------------------------------------------------------------------------------


def backfilled_status() -> Column:
    return F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("open"))


def update_status(store: DataFrame, updates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Store with the latest valid update of each id applied and empty states back-filled."""
    valid = updates.where(F.col("status").isin(*STATUSES))
    latest = valid.groupBy("signal_id").agg(F.max_by("status", F.struct(*order)).alias("_status"))
    return (
        store.join(latest, "signal_id", "left")
        .withColumn("status", F.coalesce(F.col("_status"), backfilled_status()))
        .drop("_status")
    )


def unknown_updates(store: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.join(store.select("signal_id"), "signal_id", "left_anti")


# --- queries --------------------------------------------------------------------------------


def list_signals(
    store: DataFrame,
    since: Column | None = None,
    severity: str | None = None,
    host_id: str | None = None,
    status: str | None = "open",
    search: str | None = None,
    limit: int = DEFAULT_LIST_LIMIT,
    wildcards: bool = False,
) -> DataFrame:
    """Newest signals first; ties by id. ``search`` is a literal unless ``wildcards``."""
    if not 1 <= limit <= MAX_LIST_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIST_LIMIT}")
    if status and status != "all" and status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES} or 'all'")
    df = store.withColumn("status", backfilled_status())
    if since is not None:
        df = df.where(F.col("ts") > since)
    if severity:
        df = df.where(F.col("severity") == severity)
    if host_id:
        df = df.where(F.col("host_id") == host_id)
    if status and status != "all":
        df = df.where(F.col("status") == status)
    term = (search or "").strip().lower()
    if term:
        def hit(name: str) -> Column:
            value = F.lower(F.col(name))
            return value.like(f"%{term}%") if wildcards else F.contains(value, F.lit(term))

        df = df.where(hit("title") | hit("rule_id"))
    return df.orderBy(F.desc("ts"), "signal_id").limit(limit)


def parsed_signals(store: DataFrame) -> DataFrame:
    """Tags as an array and context as a VARIANT, with defaults for missing text."""
    return store.withColumns({
        "tags": F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")),
        # A text with a name twice is not a value; its last members are.
        "context": F.coalesce(
            F.try_parse_json("context"), F.try_parse_json(last_members(F.col("context"))), F.parse_json(F.lit("{}"))
        ),
        "status": backfilled_status(),
    })


def signal_stats(store: DataFrame, as_of: Column) -> DataFrame:
    """(section, name, signals): total, last 24 hours, by severity, by host, by rule.

    One pass: the grouping sets are partially aggregated before the shuffle.
    """
    recent = F.when(F.col("ts") > as_of - _interval("24h"), F.lit(1))
    sets = store.select("severity", "host_id", "rule_id", recent.alias("recent")).groupingSets(
        [[], ["severity"], ["host_id"], ["rule_id"]], "severity", "host_id", "rule_id"
    ).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count("recent").alias("n24")
    )
    by = {3: ("severity", "severity"), 5: ("host", "host_id"), 6: ("rule", "rule_id")}
    section, name = F.lit("total"), F.lit("")
    for bits, (label, column) in by.items():
        section = F.when(F.col("g") == bits, F.lit(label)).otherwise(section)
        name = F.when(F.col("g") == bits, F.col(column)).otherwise(name)
    row = F.struct(section.alias("section"), name.alias("name"), F.col("n").alias("signals"))
    last_day = F.struct(F.lit("last_24h").alias("section"), F.lit("").alias("name"), F.col("n24").alias("signals"))
    rows = F.when(F.col("g") == 7, F.array(row, last_day)).otherwise(F.array(row))
    return sets.select(F.inline(rows))


def top_rules(store: DataFrame, k: int = TOP_RULES) -> DataFrame:
    counts = store.groupBy("rule_id").agg(F.count(F.lit(1)).alias("signals"))
    return counts.orderBy(F.desc("signals"), "rule_id").limit(k)


def latest_heartbeats(
    heartbeats: DataFrame,
    since: Column,
    columns: Sequence[str],
    tie: Sequence[str],
    limit: int = 200,
    parity: bool = False,
) -> DataFrame:
    """Newest heartbeat of each agent received after ``since``, newest first.

    The limit counts agents; with ``parity`` it is applied to heartbeats before agents are told
    apart, so a chatty agent can hide others.
    """
    recent = heartbeats.where(F.col("received_at") > since)
    newest = [F.desc("received_at"), *[F.desc(c) for c in tie]]
    if parity:
        recent = recent.orderBy(*newest).limit(limit)
    rank = F.struct("received_at", *tie)
    latest = recent.groupBy("agent_id").agg(F.max_by(F.struct(*columns), rank).alias("h"), F.max(rank).alias("r"))
    rows = latest.select("agent_id", "h.*", F.col("r").alias("_r"))
    return rows.orderBy(F.desc("_r"), "agent_id").limit(limit).drop("_r")


def silent_agents(heartbeats: DataFrame, as_of: Column, missed: int = 3, interval: str = HEARTBEAT_INTERVAL) -> DataFrame:
    """Agents whose last heartbeat is more than ``missed`` intervals old."""
    allowed = F.make_dt_interval(secs=F.lit(missed * duration_ns(interval) / 1e9))
    last = heartbeats.groupBy("agent_id").agg(F.max("received_at").alias("last_seen"))
    return last.where(F.col("last_seen") < as_of - allowed)


# --- outbox ---------------------------------------------------------------------------------


def enqueue(signals: DataFrame, shipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queued, refused): refused have no id or rule id; shipped ids are not queued again."""
    broken = (F.coalesce(F.col("signal_id"), F.lit("")) == "") | (F.coalesce(F.col("rule_id"), F.lit("")) == "")
    queued = signals.where(~broken).join(shipped.select("signal_id"), "signal_id", "left_anti")
    return queued, signals.where(broken)


def next_batch(queue: DataFrame, order: Sequence[str], limit: int = DEFAULT_BATCH) -> DataFrame:
    """The earliest ``limit`` entries."""
    return queue.orderBy(*order).limit(limit)


def numbered_batches(queue: DataFrame, order: Sequence[str], size: int = DEFAULT_BATCH) -> DataFrame:
    """Every entry with the number of the delivery batch it falls into."""
    placed = global_position(queue, order, "_pos")
    return placed.withColumn("batch_no", F.expr(f"_pos DIV {int(size)}")).drop("_pos")


def delivery_outcomes(queue: DataFrame, outcomes: DataFrame, retry_at: Column) -> tuple[DataFrame, DataFrame]:
    """(shipped, pending): a delivered id is shipped, anything else waits again at the back."""
    joined = queue.join(outcomes.select("signal_id", "delivered"), "signal_id", "left")
    shipped = joined.where(F.coalesce(F.col("delivered"), F.lit(False))).select("signal_id")
    tried = F.col("delivered").isNotNull()
    pending = joined.where(~F.coalesce(F.col("delivered"), F.lit(False))).withColumn(
        "enqueued_at", F.when(tried, retry_at).otherwise(F.col("enqueued_at"))
    ).drop("delivered")
    return shipped, pending


def delivery_counts(outcomes: DataFrame) -> DataFrame:
    """(sent, failed, requeued); every failure is queued again."""
    ok = F.coalesce(F.col("delivered"), F.lit(False))
    return outcomes.agg(
        F.count_if(ok).alias("sent"), F.count_if(~ok).alias("failed"), F.count_if(~ok).alias("requeued")
    )


def state_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, entries) for every state table."""
    out = None
    for name, table in tables.items():
        part = table.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("name"), "entries")
        out = part if out is None else out.unionByName(part)
    return out

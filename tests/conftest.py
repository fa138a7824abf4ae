import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fleetsight-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def execution(machine="m1", boot="b1", seq=1, at="2024-01-01T00:00:00Z", **fields):
    """A JSON-shaped execution record."""
    target = {"executable": {}}
    if "path" in fields:
        target["executable"]["path"] = fields["path"]
    if "sha" in fields:
        target["executable"]["hash"] = {"hash": fields["sha"]}
    if "cdhash" in fields:
        target["executable"]["cdhash"] = fields["cdhash"]
    if "pid" in fields:
        target["id"] = {"pid": fields["pid"], "pidversion": fields.get("ver", 1)}
    if "parent" in fields:
        target["parent_id"] = {"pid": fields["parent"], "pidversion": fields.get("parent_ver", 1)}
    if "team" in fields:
        target["code_signature"] = {"team_id": fields["team"]}
    if "user" in fields:
        target["effective_user"] = {"name": fields["user"]}
    block = {"target": target, "decision": fields.get("decision", "DECISION_ALLOW")}
    if "args" in fields:
        block["args"] = fields["args"]
    if "actor" in fields:
        block["instigator"] = {"executable": {"path": fields["actor"]}}
        if "actor_pid" in fields:
            block["instigator"]["id"] = {"pid": fields["actor_pid"], "pidversion": 1}
    record = {"machine_id": machine, "boot_session_uuid": boot, "execution": block}
    if at is not None:
        record["event_time"] = at
    return record, seq


def file_access(machine="m1", seq=1, at="2024-01-01T00:00:00Z", policy="P", actor="/a", **fields):
    block = {
        "policy_name": policy,
        "policy_decision": fields.get("decision", "POLICY_DECISION_DENIED"),
        "target": {"path": fields.get("path", "/t")},
        "instigator": {"executable": {"path": actor}},
    }
    if "signing_id" in fields:
        block["instigator"]["code_signature"] = {"signing_id": fields["signing_id"], "team_id": "TT"}
    return {"machine_id": machine, "boot_session_uuid": "b1", "event_time": at, "file_access": block}, seq


@pytest.fixture(scope="session")
def events_of(spark):
    """Normalised events of (record, seq) pairs."""
    import json

    from pyspark.sql import functions as F

    from fleetsight.operators.normalize import normalize
    from fleetsight.schema import telemetry_ddl

    def build(pairs, args_encoding="text"):
        rows = [(json.dumps(record), seq) for record, seq in pairs]
        lines = spark.createDataFrame(rows, "value string, event_seq bigint")
        raw = lines.select("event_seq", F.inline(F.array(F.from_json("value", telemetry_ddl()))))
        return normalize(raw, args_encoding)

    return build

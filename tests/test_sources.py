"""Files: JSON lines and their limits, framed binaries, ledger, normalised store."""

import base64
import gzip
import json
import struct
import tempfile

import pytest
from conftest import SMALL, execution, file_access
from pyspark.sql import functions as F

from fleetsight.operators.normalize import normalize
from fleetsight.plans import workload
from fleetsight.sources import ledger
from fleetsight.sources.frames import BadSpool, frames, read_frames, unpack
from fleetsight.sources.telemetry import read_json_lines, read_normalized, write_normalized

xxhash = pytest.importorskip("xxhash")
zstandard = pytest.importorskip("zstandard")


def folder(**files):
    path = tempfile.mkdtemp(prefix="fleetsight-test-")
    for name, body in files.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())
    return path


def lines(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n"


def names(df):
    return {r[0].rsplit("/", 1)[1]: r[1] for r in df.collect()}


def test_json_lines(spark):
    one, two = execution(seq=1, path="/x")[0], file_access(seq=2)[0]
    one["execution"]["args"] = [base64.b64encode(b"-a").decode()]
    path = folder(
        good=lines(one, "", "  ", {"machine_id": "no block"}, {**two, "unknown_field": {"a": 1}}) + "\r\n",
        bad=lines(one, "{not json"),
        array=lines(one, "[1, 2]"),
        none=lines({"machine_id": "no block"}),
        empty="",
    )
    events, rejected = read_json_lines(spark, path)
    assert names(rejected) == {"bad": "bad line", "array": "bad line", "none": "no records", "empty": "empty file"}
    ev = normalize(events)
    rows = ev.orderBy("kind").collect()
    assert [(r.kind, r.target_path, r.decoded_args) for r in rows] == [("execution", "/x", ["-a"]), ("file_access", "/t", [])]
    assert {r.source_file.rsplit("/", 1)[1] for r in rows} == {"good"}


def test_empty_files_wait_like_others(spark):
    import os

    path = folder(**{"old one": "", "new": "", "good": lines(execution(seq=1)[0])})
    for name, at in (("old one", 1_000), ("new", 5_000), ("good", 1_000)):
        os.utime(f"{path}/{name}", (at, at))
    as_of = F.timestamp_seconds(F.lit(5_002))
    events, rejected = read_json_lines(spark, path, stability_wait="1h", as_of=as_of)
    assert events.count() == 1 and names(rejected) == {"old%20one": "empty file"}
    assert set(names(read_json_lines(spark, path)[1])) == {"old%20one", "new"}
    only = folder(nothing="")
    events, rejected = read_json_lines(spark, only)
    assert events.count() == 0 and names(rejected) == {"nothing": "empty file"}


def test_records_without_a_time_have_that_of_their_file(spark):
    import os

    untimed = {k: v for k, v in execution(seq=1)[0].items() if k != "event_time"}
    timed = execution(seq=2, at="2024-01-01T00:00:00Z")[0]
    path = folder(spool=lines(untimed, {**untimed, "processed_time": "2024-01-02T00:00:00Z"}, timed))
    os.utime(f"{path}/spool", (7_000, 7_000))
    ev = normalize(read_json_lines(spark, path)[0])
    assert "ingest_time" not in ev.columns
    days = [1_704_067_200, 1_704_153_600]
    assert sorted(r.order_ns for r in ev.collect()) == [n * 10**9 for n in (7_000, *days)]


def test_json_limits(spark):
    record = execution(seq=1)[0]
    path = folder(many=lines(*[record] * 5), long=lines({**record, "machine_id": "m" * 5000}), ok=lines(record))
    _, rejected = read_json_lines(spark, path, max_lines=4, max_line_chars=2000)
    assert names(rejected) == {"many": "too many lines", "long": "line too large"}
    _, rejected = read_json_lines(spark, path, max_file_bytes=1500)
    assert set(names(rejected)) == {"long"}


def test_camel_case_names_and_numeric_enums(spark):
    path = folder(a=lines({"machineId": "m", "eventTime": "2024-01-01T00:00:00Z", "fileAccess": {
        "policyName": "P", "policyDecision": 1, "instigator": {"codeSignature": {"signingId": "s"}}}}))
    events, _ = read_json_lines(spark, path, name_style="camel")
    row = normalize(events).first()
    assert (row.kind, row.policy_name, row.decision, row.actor_signing_id) == ("file_access", "P", "POLICY_DECISION_DENIED", "s")


def test_unstable_files_wait(spark):
    path = folder(a=lines(execution(seq=1)[0]))
    events, _ = read_json_lines(spark, path, stability_wait="2s", as_of=F.lit("2020-01-01").cast("timestamp"))
    assert events.count() == 0
    events, _ = read_json_lines(spark, path, stability_wait="2s", as_of=F.lit("2100-01-01").cast("timestamp"))
    assert events.count() == 1


def uvarint(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def frame(payload, checksum=None):
    digest = xxhash.xxh64_intdigest(payload) if checksum is None else checksum
    return struct.pack("<IQ", 0x21544E53, digest) + uvarint(len(payload)) + payload


def test_frames(spark):
    body = frame(b"one") + frame(b"x" * 300) + frame(b"unchecked", 0)
    path = folder(
        plain=body, gz=gzip.compress(body), zst=zstandard.compress(gzip.compress(body)),
        three=gzip.compress(gzip.compress(gzip.compress(body))), bomb=gzip.compress(b"\0" * 5_000_000),
        corrupt=frame(b"one", 7), cut=body[:-2], zero=struct.pack("<IQ", 0x21544E53, 0) + b"\0", junk=b"hello", empty=b"",
    )
    good, bad = read_frames(spark, path)
    rows = good.groupBy("source_file").agg(F.count("payload"), F.count_if("checksum_ok")).collect()
    assert {r[0].rsplit("/", 1)[1]: (r[1], r[2]) for r in rows} == {"plain": (3, 2), "gz": (3, 2), "zst": (3, 2)}
    reasons = names(bad)
    assert set(reasons) == {"three", "bomb", "corrupt", "cut", "zero", "junk"}
    assert "layers" in reasons["three"] and "factor" in reasons["bomb"] and "checksum" in reasons["corrupt"]
    first = good.where(F.col("source_file").endswith("plain")).orderBy("frame_no").first()
    assert (first.frame_no, bytes(first.payload)) == (0, b"one")


def test_unpack_size_limit():
    with pytest.raises(BadSpool, match="size"):
        unpack(gzip.compress(b"ab" * 1000), max_unpacked=100)
    with pytest.raises(BadSpool, match="size"):
        unpack(zstandard.compress(b"ab" * 1000), max_unpacked=100)
    with pytest.raises(BadSpool):
        list(frames(b""))


def test_ledger(spark):
    files = spark.sql("SELECT * FROM VALUES ('new', TIMESTAMP '2024-01-02'), ('done', TIMESTAMP '2024-01-01'), "
                      "('changed', TIMESTAMP '2024-01-05') t(path, mtime)")
    done = spark.sql("SELECT * FROM VALUES ('done', TIMESTAMP '2024-01-01'), ('changed', TIMESTAMP '2024-01-03'), "
                     "('changed', TIMESTAMP '2024-01-02') t(path, processed_ts)")
    known = ledger.ledger_update(done.limit(0), done)
    assert {r.path for r in ledger.pending_files(files, known).collect()} == {"new", "changed"}
    hits = spark.sql("SELECT 'new' AS path FROM range(3)")
    fates = ledger.file_disposition(files, hits, spark.sql("SELECT 'done' AS path")).collect()
    assert {r.path: r.action for r in fates} == {"new": "archive", "done": "archive", "changed": "delete"}


def test_normalised_store_prunes_by_kind(spark):
    path = tempfile.mkdtemp(prefix="fleetsight-test-") + "/events"
    ev = workload._events(spark, SMALL)
    write_normalized(ev, path)
    back = read_normalized(spark, path)
    assert back.count() == ev.count()
    only = back.where("kind = 'xprotect'").select("target_path")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "execution" not in plan.split("ReadSchema")[1]
    assert only.count() == ev.where("kind = 'xprotect'").count()

"""Ancestry: order, cycles, depth, upserts, lifetime, isolation, labels."""

from conftest import execution
from pyspark.sql import functions as F

from fleetsight.operators import lineage


def chain(events, seq, **options):
    """Paths of the chain of the execution with ``seq``, and the raw row."""
    nodes = lineage.process_nodes(events)
    starts = nodes.where(F.col("node_seq") == seq).select(
        "machine_id", "boot", "pid", "pidversion", F.col("node_ns").alias("match_ns"), F.col("node_seq").alias("match_seq")
    )
    row = lineage.process_chains(starts, nodes, **{"ttl": None, **options}).first()
    return [n["path"] for n in row["chain"]]


def at(minute, second=0):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


def test_leaf_to_root(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="bash", pid=1),
        execution(seq=2, at=at(2), path="python", pid=2, parent=1),
        execution(seq=3, at=at(3), path="curl", pid=3, parent=2),
    ])
    assert chain(events, 3) == ["curl", "python", "bash"]
    assert chain(events, 1) == ["bash"]


def test_instigator_stands_in_for_a_missing_parent(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="bash", pid=1),
        execution(seq=2, at=at(2), path="curl", pid=2, actor="bash", actor_pid=1),
    ])
    assert chain(events, 2) == ["curl", "bash"]


def test_cycle_stops(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="A", pid=1, parent=3),
        execution(seq=2, at=at(2), path="B", pid=2, parent=1),
        execution(seq=3, at=at(3), path="C", pid=3, parent=2),
    ])
    assert chain(events, 3) == ["C", "B", "A"]


def test_depth_counts_the_process_itself(events_of):
    events = events_of([execution(seq=n, at=at(n), path=f"p{n}", pid=n, parent=n - 1) for n in range(1, 11)])
    assert chain(events, 10, max_depth=5) == ["p10", "p9", "p8", "p7", "p6"]


def test_latest_version_known_at_the_match(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="old", pid=1),
        execution(seq=2, at=at(2), path="new", pid=1),
        execution(seq=3, at=at(3), path="curl", pid=3, parent=1),
        execution(seq=4, at=at(4), path="later", pid=1),
        execution(seq=5, at=at(3), path="same time, earlier", pid=5, parent=3),
    ])
    assert chain(events, 3) == ["curl", "new"]
    assert chain(events, 5) == ["same time, earlier", "curl", "new"]


def test_lifetime(events_of):
    events = events_of([
        execution(seq=1, at=at(0), path="bash", pid=1),
        execution(seq=2, at=at(60), path="inside", pid=2, parent=1),
        execution(seq=3, at=at(60, 1), path="outside", pid=3, parent=1),
    ])
    assert chain(events, 2, ttl="1h") == ["inside", "bash"]
    assert chain(events, 3, ttl="1h") == ["outside"]


def test_boots_and_machines_are_apart(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="other boot", boot="b0", pid=1),
        execution(seq=2, at=at(1), path="other machine", machine="m2", pid=1),
        execution(seq=3, at=at(2), path="curl", pid=3, parent=1),
    ])
    assert chain(events, 3) == ["curl"]


def test_zero_parent_ends_only_without_boot(events_of):
    known = [
        execution(seq=1, at=at(1), path="zero", pid=0, ver=0),
        execution(seq=2, at=at(2), path="curl", pid=2, parent=0, parent_ver=0),
    ]
    assert chain(events_of(known), 2) == ["curl", "zero"]
    bare = [
        execution(seq=1, at=at(1), path="zero", boot="", pid=0, ver=0),
        execution(seq=2, at=at(2), path="curl", boot="", pid=2, parent=0, parent_ver=0),
    ]
    assert chain(events_of(bare), 2) == ["curl"]


def test_serialised_labels(events_of):
    events = events_of([
        execution(seq=1, at=at(1), path="bash", pid=1, args=["-c"]),
        execution(seq=2, at=at(2), path="python", pid=2, parent=1),
        execution(seq=3, at=at(3), path="curl", pid=3, parent=2, user="ann"),
    ])
    nodes = lineage.process_nodes(events)
    starts = nodes.where("node_seq = 3").selectExpr(
        "machine_id", "boot", "pid", "pidversion", "node_ns AS match_ns", "node_seq AS match_seq"
    )
    chains = lineage.process_chains(starts, nodes, ttl=None)
    tree = chains.select(lineage.serialize_chain(F.col("chain")).alias("t")).first()["t"]
    assert [(e["relation"], e["depth"], e["path"], e["args"]) for e in tree] == [
        ("target", 0, "curl", None), ("parent", 1, "python", None), ("ancestor", 2, "bash", ["-c"]),
    ]
    assert tree[0]["user"] == "ann"


def test_latest_nodes_and_cap(events_of):
    events = events_of([execution(seq=n, at=at(n), path=f"p{n}", pid=n % 3 + 1) for n in range(1, 8)])
    nodes = lineage.process_nodes(events)
    assert {r.node_seq for r in lineage.latest_nodes(nodes).collect()} == {5, 6, 7}
    assert {r.node_seq for r in lineage.latest_nodes(nodes, 2).collect()} == {6, 7}

"""Process ancestry of signals, as known at the time of the signal.

Starts from the few signals whose rule asks for a tree. Executions are versions of a process key,
each valid until the next one of the same key; a level of ancestry is one equi join on the key
that keeps the version valid at the signal's time. The tree is an array column of the signal row,
so no grouping is needed to assemble it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetsight.functions.durations import duration_ns
from fleetsight.operators.slices import SLICE_FACTOR, with_slices
from fleetsight.schema import DEFAULT_TREE_DEPTH, DEFAULT_TREE_TTL

KEY = ["machine_id", "boot", "pid", "pidversion"]
_DETAILS = [
    "path", "user", "uid", "group", "gid", "session_id", "start_time", "args",
]
NODE_FIELDS = ["boot", "pid", "pidversion", "parent_pid", "parent_pidversion", *_DETAILS]
# Labels by depth.
RELATIONS = ("target", "parent", "ancestor")


def _own_columns() -> dict[str, str]:
    """A node's columns out of a normalised execution event."""
    target = "execution.target"
    parent = f"coalesce({target}.parent_id, execution.instigator.id)"

    def part(block: str, field: str) -> str:
        return f"CASE WHEN {block} IS NOT NULL THEN coalesce({block}.{field}, 0) END"

    return {
        "boot": "boot_session_uuid",
        "pid": f"coalesce({target}.id.pid, 0)",
        "pidversion": f"coalesce({target}.id.pidversion, 0)",
        "parent_pid": part(parent, "pid"),
        "parent_pidversion": part(parent, "pidversion"),
        "responsible_pid": part(f"{target}.responsible_id", "pid"),
        "responsible_pidversion": part(f"{target}.responsible_id", "pidversion"),
        "path": f"coalesce({target}.executable.path, '')",
        "user": f"coalesce({target}.effective_user.name, '')",
        "uid": f"coalesce({target}.effective_user.uid, 0)",
        "group": f"coalesce({target}.effective_group.name, '')",
        "gid": f"coalesce({target}.effective_group.gid, 0)",
        "session_id": f"coalesce({target}.session_id, 0)",
        "start_time": f"cast({target}.start_time AS string)",
        "args": "decoded_args",
    }


def process_nodes(events: DataFrame) -> DataFrame:
    """One node per execution with a target id, from normalised events."""
    return events.where("kind = 'execution' AND execution.target.id IS NOT NULL").selectExpr(
        "machine_id",
        *[f"{sql} AS `{name}`" for name, sql in _own_columns().items()],
        "order_ns AS node_ns",
        "cast(event_seq AS bigint) AS node_seq",
    )


def own_node() -> Column:
    """The node of an execution event as one value, shaped as ``node_struct``."""
    columns = _own_columns()
    return F.struct(*[F.expr(columns[n]).alias(n) for n in NODE_FIELDS])


def node_struct() -> Column:
    """A node's columns as one value."""
    return F.struct(*[F.col(f"`{n}`").alias(n) for n in NODE_FIELDS])


def process_chains(
    starts: DataFrame,
    nodes: DataFrame,
    max_depth: int = DEFAULT_TREE_DEPTH,
    ttl: str | None = DEFAULT_TREE_TTL,
) -> DataFrame:
    """Adds ``chain``, the nodes from the process itself up to its oldest known ancestor.

    ``starts`` holds machine_id, boot, pid, pidversion, match_ns, match_seq and any other
    columns. When the matched event is itself the execution of that process, give its node as
    ``own_node`` and the first level needs no join. The chain ends at a missing parent, an unknown one, a cycle or ``max_depth`` nodes.
    A node is known at a match when it ran no later than it and at most ``ttl`` before.
    """
    ttl_ns = duration_ns(ttl) if ttl else 0
    width = F.lit(SLICE_FACTOR * ttl_ns).cast("bigint")
    part = [*KEY, "slice"]
    later = W.partitionBy(*part).orderBy("node_ns", "node_seq")
    versions = (
        with_slices(nodes, "node_ns", F.lit(ttl_ns).cast("bigint"), width)
        .withColumn("until", F.lead(F.struct("node_ns", "node_seq")).over(later))
        .select(*part, "until", F.struct("node_ns", "node_seq").alias("since"), node_struct().alias("node"))
    )
    frame = with_slices(starts, "match_ns", F.lit(0).cast("bigint"), width).drop("carried")
    keep = [c for c in frame.columns if c != "own_node"]
    found = ["_n0"] if "own_node" in starts.columns else []
    frame = frame.withColumnRenamed("own_node", "_n0")
    while len(found) < max_depth:
        condition = F.expr(_valid_at_match(found[-1] if found else None, ttl_ns))
        name = f"_n{len(found)}"
        passed = [f"f.`{c}`" for c in [*keep, *found]]
        frame = (
            frame.alias("f")
            .join(versions.alias("v"), condition, "left")
            .selectExpr(*passed, f"CASE WHEN NOT ({_in_chain(found)}) THEN v.node END AS {name}")
        )
        found.append(name)
    chain = f"filter(array({', '.join(found)}), n -> n IS NOT NULL) AS chain"
    return frame.selectExpr(*[f"`{c}`" for c in keep if c != "slice"], chain)


def _valid_at_match(child: str | None, ttl_ns: int) -> str:
    """Join condition: the version, valid at the match, of the child's parent or of the start.

    The zero key, no boot id and both numbers 0, ends a chain. Rows whose chain has ended look
    for a boot that cannot exist, spread over many values, so they neither match nor meet in one
    partition.
    """
    boot, pid, version = "f.boot", "f.pid", "f.pidversion"
    if child:
        up, up_version = f"f.{child}.parent_pid", f"f.{child}.parent_pidversion"
        idle = "concat('\\0', cast(pmod(xxhash64(f.match_ns, f.match_seq), 4096) AS string))"
        ended = f"{up} IS NULL OR (f.boot = '' AND {up} = 0 AND {up_version} = 0)"
        boot = f"CASE WHEN {ended} THEN {idle} ELSE f.boot END"
        pid, version = f"coalesce({up}, 0)", f"coalesce({up_version}, 0)"
    fresh = f"AND v.since.node_ns >= f.match_ns - {ttl_ns}L" if ttl_ns else ""
    at = "struct(f.match_ns AS node_ns, f.match_seq AS node_seq)"
    return f"""
        f.machine_id = v.machine_id AND {boot} = v.boot AND {pid} = v.pid AND {version} = v.pidversion
        AND f.slice = v.slice AND v.since <= {at} AND (v.until IS NULL OR v.until > {at}) {fresh}"""


def _in_chain(found: list[str]) -> str:
    """Whether the version found is a node the chain has already."""
    same = [f"coalesce(f.{n}.pid = v.node.pid AND f.{n}.pidversion = v.node.pidversion, false)" for n in found]
    return " OR ".join(same) if same else "false"


def serialize_chain(chain: Column) -> Column:
    """Tree entries with depth and relation; NULL for an empty chain."""

    def entry(node: Column, depth: Column) -> Column:
        relation = F.when(depth == 0, F.lit(RELATIONS[0])).when(depth == 1, F.lit(RELATIONS[1])).otherwise(
            F.lit(RELATIONS[2])
        )
        args = node.getField("args")
        details = [node.getField(n).alias(n) for n in ["pid", "pidversion", *_DETAILS[:-1]]]
        return F.struct(
            relation.alias("relation"),
            depth.alias("depth"),
            *details,
            F.when(F.size(args) > 0, args).alias("args"),
        )

    return F.when(F.size(chain) > 0, F.transform(chain, entry))


def latest_nodes(nodes: DataFrame, cap_per_machine: int | None = None) -> DataFrame:
    """Last version of each process; optionally only the newest ``cap_per_machine`` of a machine."""
    w = W.partitionBy(*KEY).orderBy(F.desc("node_ns"), F.desc("node_seq"))
    last = nodes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if cap_per_machine is None:
        return last
    newest = W.partitionBy("machine_id").orderBy(F.desc("node_ns"), F.desc("node_seq"))
    return last.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= cap_per_machine).drop("_rn")

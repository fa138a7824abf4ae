"""Rule catalogue: JSON files of rules, correlations and baselines, and their checks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.paths import clean_path, path_type
from fleetsight.schema import (
    BASELINES_DDL,
    CORRELATIONS_DDL,
    DEFAULT_MAX_EVENTS,
    RULES_DDL,
    SEVERITIES,
    catalogue_ddl,
)

FAMILIES = {"rules": RULES_DDL, "correlations": CORRELATIONS_DDL, "baselines": BASELINES_DDL}
MAX_RULES = 20_000
VIOLATIONS_DDL = "rule_id string, family string, check string, detail string"


class InvalidCatalogue(ValueError):
    """A catalogue with violations, listed in ``violations``."""

    def __init__(self, violations: list[Row]):
        self.violations = violations
        super().__init__("; ".join(f"{v.rule_id}: {v.check} {v.detail}".strip() for v in violations[:20]))


@dataclass
class Catalogue:
    """The three rule families as DataFrames with a ``source_file`` column and, of files, each rule's ``place`` in it."""

    rules: DataFrame
    correlations: DataFrame
    baselines: DataFrame
    unreadable: DataFrame | None = None

    def families(self) -> dict[str, DataFrame]:
        return {
            "rules": self.rules,
            "correlations": self.correlations,
            "baselines": self.baselines,
        }

    def merge(self, other: Catalogue) -> Catalogue:
        bad = [b for b in (self.unreadable, other.unreadable) if b is not None]
        return Catalogue(
            *[
                mine.unionByName(other.families()[name], allowMissingColumns=True)
                for name, mine in self.families().items()
            ],
            unreadable=bad[0].unionByName(bad[1]) if len(bad) == 2 else (bad[0] if bad else None),
        )


def read_catalogue(spark: SparkSession, path: str) -> Catalogue:
    """One JSON file or a directory tree of them; files with another suffix are ignored."""
    schema = T.StructType.fromDDL(catalogue_ddl() + ", _corrupt string")
    read = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    files = (
        spark.read
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(F.from_json("value", schema, read).alias("r"), F.col("_metadata.file_path").alias("source_file"))
    )
    families = [
        files.select(F.posexplode(f"r.{name}").alias("place", "rule"), "source_file")
        .where(F.col("rule").isNotNull()).select("rule.*", "source_file", "place")
        for name in FAMILIES
    ]
    unreadable = files.where(F.col("r._corrupt").isNotNull()).select("source_file")
    return Catalogue(*families, unreadable=unreadable)


def catalogue_of(spark: SparkSession, families: dict[str, list[dict]], source_file: str = "inline") -> Catalogue:
    """A catalogue given as Python records."""
    frames = []
    for name, ddl in FAMILIES.items():
        schema = T.StructType.fromDDL(ddl + ", source_file string, place int")
        rows = [
            tuple({"source_file": source_file, "place": place, **r}.get(f.name) for f in schema)
            for place, r in enumerate(families.get(name, []))
        ]
        frames.append(spark.createDataFrame(rows, schema))
    return Catalogue(*frames)


def default_catalogue(spark: SparkSession) -> Catalogue:
    """The rules shipped with the package."""
    return read_catalogue(spark, str(Path(__file__).parent.parent / "rulesets" / "default.json"))


def _required(name: str) -> tuple[Column, Column]:
    missing = F.coalesce(F.col(name), F.lit("")) == ""
    return missing, F.lit(f"{name} is required")


def _check(check: str, broken: Column, detail: Column) -> Column:
    return F.when(
        F.coalesce(broken, F.lit(True)),
        F.struct(F.lit(check).alias("check"), F.coalesce(detail, F.lit("")).alias("detail")),
    )


def _empty_items(name: str) -> Column:
    return F.exists(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) == "")


# How durations are written.
_PARTS = r"(\d+(\.\d+)?(ns|us|µs|ms|s|m|h))+"
_ZERO_PARTS = r"(0+(\.0+)?(ns|us|µs|ms|s|m|h))+"


def _duration_checks(name: str) -> tuple[Column, list[Column]]:
    """(whether a duration is missing or zero, checks that it is well-formed and not negative)."""
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    nothing = text.rlike(f"^([+-]?(0|{_ZERO_PARTS}))?$")
    malformed = ~nothing & ~text.rlike(f"^[+-]?{_PARTS}$")
    return nothing, [
        _check("duration", malformed, F.concat(F.lit(f"{name} is not a duration: "), text)),
        _check("duration", ~nothing & ~malformed & text.startswith("-"), F.lit(f"{name} must not be negative")),
    ]


def _family_checks(family: str) -> list[Column]:
    checks = []
    for name in ("id", "title", "expr", "severity"):
        missing, detail = _required(name)
        checks.append(_check("required", missing, detail))
    severity = F.coalesce(F.col("severity"), F.lit(""))
    checks.append(
        _check("severity", (severity != "") & ~severity.isin(*SEVERITIES), F.concat(F.lit("invalid severity: "), severity))
    )
    if family == "correlations":
        no_window, well_formed = _duration_checks("window")
        checks += [_check("required", no_window, F.lit("window is required")), *well_formed]
        checks.append(_check("threshold", F.coalesce(F.col("threshold"), F.lit(0)) <= 0, F.lit("threshold must be greater than 0")))
        checks.append(_check("group_by", _empty_items("group_by"), F.lit("group_by has an empty field")))
    if family == "baselines":
        size = F.size(F.coalesce(F.col("track"), F.array().cast("array<string>")))
        checks.append(_check("required", size == 0, F.lit("track is required")))
        checks.append(_check("track", _empty_items("track"), F.lit("track has an empty field")))
        checks += _duration_checks("learning_period")[1]
    return checks


def field_violations(family: str, rules: DataFrame) -> DataFrame:
    """Broken field checks, one row each."""
    broken = F.explode(F.array_compact(F.array(*_family_checks(family))))
    return rules.select(F.col("id").alias("rule_id"), F.lit(family).alias("family"), broken.alias("v")).select(
        "rule_id", "family", "v.check", "v.detail"
    )


def duplicate_violations(catalogue: Catalogue) -> DataFrame:
    """Ids used more than once over all families and files."""
    ids = None
    for frame in catalogue.families().values():
        part = frame.select(F.col("id").alias("rule_id"), "source_file")
        ids = part if ids is None else ids.unionByName(part)
    # Two file names are enough to act on, and keep the group state small however often an id is used.
    return (
        ids.groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("a"), F.max("source_file").alias("b"))
        .where(F.col("n") > 1)
        .select(
            "rule_id",
            F.lit("all").alias("family"),
            F.lit("duplicate").alias("check"),
            F.concat(F.lit("found in both "), "a", F.lit(" and "), "b").alias("detail"),
        )
    )


def catalogue_violations(catalogue: Catalogue) -> DataFrame:
    """Field checks of every family, duplicate ids and unreadable files."""
    found = duplicate_violations(catalogue)
    for family, frame in catalogue.families().items():
        found = found.unionByName(field_violations(family, frame))
    if catalogue.unreadable is not None:
        found = found.unionByName(
            catalogue.unreadable.select(
                F.lit("").alias("rule_id"), F.lit("all").alias("family"),
                F.lit("unreadable").alias("check"), F.col("source_file").alias("detail"),
            )
        )
    return found


def predicate_problem(events: DataFrame, expr: str) -> str | None:
    """Why a predicate cannot run over the events; None when it can."""
    try:
        dtype = events.select(F.expr(expr).alias("p")).schema["p"].dataType
    except PySparkException as err:
        return str(err.getCondition() or type(err).__name__)
    return None if isinstance(dtype, T.BooleanType) else f"NOT_BOOLEAN: {dtype.simpleString()}"


def _path_problems(events: DataFrame, paths) -> list[str]:
    return [f"unknown path {clean_path(p)}" for p in paths if p and path_type(events.schema, p) is None]


def plan_violations(events: DataFrame, families: dict[str, list[Row]]) -> DataFrame:
    """Predicates and paths that do not resolve against the events' schema.

    Spark's analyser is asked about each rule of the (bounded) catalogue; no data is read.
    """
    rows = []
    # An empty table of the same shape, so that only the predicates are analysed, not the whole plan.
    events = events.sparkSession.createDataFrame([], events.schema)
    for family, rules in families.items():
        for rule in rules:
            problem = predicate_problem(events, rule["expr"]) if rule["expr"] else None
            if problem:
                rows.append((rule["id"], family, "predicate", problem))
            paths = list(rule["group_by"] or []) + [rule["count_distinct"]] if family == "correlations" else []
            if family == "baselines":
                paths = list(rule["track"] or [])
            if family == "rules":
                paths = list(rule["extra_context"] or [])
            rows += [(rule["id"], family, "path", p) for p in _path_problems(events, paths)]
    names = [f.name for f in T.StructType.fromDDL(VIOLATIONS_DDL)]
    table = pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})
    return events.sparkSession.createDataFrame(table, VIOLATIONS_DDL)


def collect_rules(frame: DataFrame, enabled_only: bool = True) -> list[Row]:
    """Rules to compile, in the order of files and of places in them. The catalogue is small by nature; its size is checked."""
    if enabled_only:
        frame = frame.where(F.coalesce(F.col("enabled"), F.lit(False)))
    order = [c for c in ("source_file", "place") if c in frame.columns]
    rows = frame.orderBy(*order, "id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules in one family")
    return rows


@dataclass
class EnabledRules:
    rules: list[Row]
    correlations: list[Row]
    baselines: list[Row]

    @property
    def wants_tree(self) -> bool:
        return any(r["include_process_tree"] for r in self.rules)


def _beyond_cap(correlations: list[Row], max_events: int | None) -> list[Row]:
    """Thresholds that a window of at most ``max_events`` events never reaches."""
    violation = Row("rule_id", "family", "check", "detail")
    return [
        violation(r["id"], "correlations", "threshold", f"threshold {r['threshold']} is above the cap of {max_events} events")
        for r in correlations if max_events and (r["threshold"] or 0) > max_events
    ]


def load_rules(
    catalogue: Catalogue, events: DataFrame, strict: bool = True, max_events: int | None = DEFAULT_MAX_EVENTS
) -> EnabledRules:
    """Checked and enabled rules; raises ``InvalidCatalogue`` on any violation.

    With ``strict=False`` unknown paths are allowed and read as empty text. ``max_events`` is the cap
    that the rules will run with (``Settings.max_events``).
    """
    broken = catalogue_violations(catalogue).collect()  # a few for each rule at most
    families = {name: collect_rules(frame, False) for name, frame in catalogue.families().items()}
    planned = plan_violations(events, families)
    if not strict:
        planned = planned.where(F.col("check") != "path")
    broken += planned.collect() + _beyond_cap(families["correlations"], max_events)
    if broken:
        raise InvalidCatalogue(broken)
    return EnabledRules(**{n: [r for r in rows if r["enabled"]] for n, rows in families.items()})

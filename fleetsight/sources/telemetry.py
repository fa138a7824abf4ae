"""Telemetry files: JSON lines and the normalised Parquet store, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.functions.durations import duration_ns
from fleetsight.operators.normalize import INGEST_TIME, kind_of
from fleetsight.schema import KINDS, OPEN_KINDS, UNKNOWN_KIND, telemetry_schema

CORRUPT = "_corrupt"
SOURCE = "source_file"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _camel_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(_camel(f.name), _camel_type(f.dataType), f.nullable) for f in dtype]
        )
    return dtype


def _record_schema(name_style: str) -> T.StructType:
    if name_style not in ("proto", "camel"):
        raise ValueError(f"name_style must be proto or camel, not {name_style!r}")
    schema = telemetry_schema()
    return schema if name_style == "proto" else _camel_type(schema)


def parse_lines(lines: DataFrame, name_style: str = "proto") -> DataFrame:
    """Records of a DataFrame with ``value`` (one JSON text) and ``source_file``.

    Adds ``_corrupt``, the text of a line that is not a JSON object. Blank lines are dropped and
    fields outside the schema are ignored. Blocks of kinds without typed fields are kept whole, with
    their members' names as they come. Other columns of ``lines`` are kept.
    """
    parsed = _parsed(lines, name_style)
    return parsed.where(F.col("_value") != "").drop("_value")


def _parsed(lines: DataFrame, name_style: str) -> DataFrame:
    """All lines, parsed, with the trimmed text as ``_value``; blank ones have no field set."""
    schema = _record_schema(name_style)
    read = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    kept = [c for c in lines.columns if c != "value"]
    text = lines.select(*kept, F.regexp_replace("value", r"^\s+|\s+$", "").alias("_value"))
    # Inlined from a one-element array: a plain field access would let the optimiser parse the
    # text anew for every column.
    rows = text.select("_value", *kept, F.inline(F.array(F.from_json("_value", read, options))))
    wanted = telemetry_schema()

    def read_as(given: T.StructField, want: T.StructField) -> Column:
        value = F.col(f"`{given.name}`")
        if isinstance(want.dataType, T.VariantType):
            return F.when(~F.is_variant_null(value), value).alias(want.name)
        return value.cast(want.dataType).alias(want.name)

    columns = [read_as(given, want) for given, want in zip(schema.fields, wanted.fields)]
    # A block that is no object makes a line corrupt, as it does where its fields are typed.
    wrong_block = F.lit(False)
    for given, want in zip(schema.fields, wanted.fields):
        if want.name in OPEN_KINDS:
            kind = F.schema_of_variant(F.col(f"`{given.name}`"))
            wrong_block = wrong_block | F.coalesce(~kind.startswith("OBJECT") & (kind != "VOID"), F.lit(False))
    blank = F.col("_value") == ""
    not_object = ~F.startswith(F.col("_value"), F.lit("{"))
    corrupt = F.when(~blank, F.coalesce(F.col(CORRUPT), F.when(not_object | wrong_block, F.col("_value"))))
    return rows.select(*columns, corrupt.alias(CORRUPT), *kept, "_value")


def _with_records(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", kind_of(df)).where(F.col("kind") != UNKNOWN_KIND)


def _text_lines(spark: SparkSession, path, stability_wait: str | None, as_of: Column | None) -> DataFrame:
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias(SOURCE),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_modification_time").alias("_mtime"),
    )
    if stability_wait:
        now = F.current_timestamp() if as_of is None else as_of
        wait = F.make_dt_interval(secs=F.lit(duration_ns(stability_wait) / 1e9))
        lines = lines.where(F.col("_mtime") <= now - wait)
    return lines


def _empty_files(spark: SparkSession, path, stability_wait: str | None, as_of: Column | None) -> DataFrame:
    """Files without a byte. Spark plans no task for them; its listing has them, and no scan by name does."""
    def same(column: str) -> Column:
        return F.regexp_replace(column, "^file:/+", "file:/")

    names = spark.read.text(path).inputFiles()  # as many as the listing that a scan holds
    listed = spark.createDataFrame([(n,) for n in names], f"{SOURCE} string").select(same(SOURCE).alias(SOURCE))
    # The content is not selected, so no file is opened.
    held = spark.read.format("binaryFile").load(path).select(same("_metadata.file_path").alias(SOURCE))
    empty = listed.join(held, SOURCE, "left_anti")
    if not stability_wait:
        return empty
    clock = F.current_timestamp() if as_of is None else as_of
    latest = spark.range(1).select(F.unix_millis(clock) - duration_ns(stability_wait) // 1_000_000).first()[0]
    stable = []
    for name in [r[0] for r in empty.collect()]:  # some of the listed names
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        if status.getModificationTime() <= latest:
            stable.append((name,))
    return spark.createDataFrame(stable, f"{SOURCE} string")


def read_json_lines(
    spark: SparkSession,
    path,
    name_style: str = "proto",
    stability_wait: str | None = None,
    as_of: Column | None = None,
    max_lines: int | None = None,
    max_line_chars: int | None = None,
    max_file_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, rejected files) of JSON-lines spool files.

    Limits hold only where they are given. One bad line or one broken limit rejects the whole file, as does a file without a single
    telemetry record and an empty one. ``rejected`` has ``source_file`` and ``reason``. Events have their
    file's modification time as ``ingest_time``.
    """
    lines = _text_lines(spark, path, stability_wait, as_of)
    parsed = _parsed(lines, name_style)
    has_event = kind_of(parsed) != UNKNOWN_KIND
    # One pass decides on the files, a second one reads the records of the good ones.
    verdict = parsed.groupBy(SOURCE).agg(
        F.count(F.lit(1)).alias("line_rows"),
        F.max(F.octet_length("_value")).alias("longest"),
        F.max("_size").alias("file_bytes"),
        F.count(CORRUPT).alias("bad_lines"),
        F.count_if(has_event).alias("event_rows"),
    ).withColumn(
        "reason",
        F.when(F.col("file_bytes") > F.lit(max_file_bytes), F.lit("file too large"))
        .when(F.col("line_rows") > F.lit(max_lines), F.lit("too many lines"))
        .when(F.col("longest") > F.lit(max_line_chars), F.lit("line too large"))
        .when(F.col("bad_lines") > 0, F.lit("bad line"))
        .when(F.col("event_rows") == 0, F.lit("no records")),
    )
    rejected = verdict.where(F.col("reason").isNotNull()).select(SOURCE, "reason")
    records = parse_lines(lines.drop("_size").withColumnRenamed("_mtime", INGEST_TIME), name_style)
    events = _with_records(records.join(rejected, SOURCE, "left_anti")).drop(CORRUPT)
    empty = _empty_files(spark, path, stability_wait, as_of).withColumn("reason", F.lit("empty file"))
    return events, rejected.unionByName(empty)


def stream_json_lines(
    spark: SparkSession,
    path: str,
    name_style: str = "proto",
    max_files_per_trigger: int = 1000,
    archive_dir: str | None = None,
) -> DataFrame:
    """Unbounded events of a spool directory; files already there are read first.

    Producers write elsewhere and rename into the directory, so a file is complete when seen.
    Lines that do not parse are kept with ``_corrupt`` set, for a side sink.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias(SOURCE))
    records = parse_lines(lines, name_style)
    return records.withColumn("kind", kind_of(records)).where(
        (F.col("kind") != UNKNOWN_KIND) | F.col(CORRUPT).isNotNull()
    )


def write_normalized(events: DataFrame, path: str, mode: str = "append") -> None:
    """Normalised events as Parquet by kind and date.

    The rebalance hint lets adaptive execution split a kind that holds most rows and merge the
    small ones, so the folders get files of an even size.
    """
    keep = [c for c in events.columns if c not in KINDS]
    blocks = [c for c in events.columns if c in KINDS]
    (
        events.select(*keep, *[F.col(f"`{b}`") for b in blocks])
        .withColumn("event_date", F.to_date("event_time"))
        .hint("rebalance", "kind", "event_date")
        .write.mode(mode)
        .partitionBy("kind", "event_date")
        .parquet(path)
    )


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("event_date")

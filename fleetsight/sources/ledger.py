"""Which spool files still need work, and what becomes of the finished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files never processed, or changed since. ``files``: path, mtime; ``ledger``: path, processed_ts."""
    last = ledger.groupBy("path").agg(F.max("processed_ts").alias("processed_ts"))
    return (
        files.join(last, "path", "left")
        .where(F.col("processed_ts").isNull() | (F.col("mtime") > F.col("processed_ts")))
        .drop("processed_ts")
    )


def ledger_update(ledger: DataFrame, processed: DataFrame) -> DataFrame:
    """Ledger after a run; failed files are entered too, so they are not tried again."""
    return (
        ledger.select("path", "processed_ts")
        .unionByName(processed.select("path", "processed_ts"))
        .groupBy("path")
        .agg(F.max("processed_ts").alias("processed_ts"))
    )


def file_disposition(files: DataFrame, signals: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``archive`` for files that gave a signal or could not be read, ``delete`` for the rest."""
    keep = signals.select("path").distinct()
    if failed is not None:
        keep = keep.union(failed.select("path")).distinct()
    flagged = files.select("path").join(keep.withColumn("_hit", F.lit(True)), "path", "left")
    action = F.when(F.col("_hit"), F.lit("archive")).otherwise(F.lit("delete"))
    return flagged.select("path", action.alias("action"))

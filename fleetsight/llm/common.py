"""What several text operators share: reading, lasting tables, words, hot-proof salts."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.session import ensure_checkpoint_dir

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Folders of stored tables, for ``clear_stored``.
_STORED: list[str] = []
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    Cuts the lineage, survives lost executors, and keeps what is used twice from being computed
    twice. Compressed, unlike a checkpoint.
    """
    path = shared_folder(df.sparkSession)
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STORED.remove(path)


def _read_by(table: DataFrame) -> list[str]:
    """Folders of stored tables that ``table`` reads."""
    needed = table.inputFiles()
    return [p for p in _STORED if any(f"/{p.rsplit('/', 1)[-1]}/" in file for file in needed)]


def clear_stored(docs: DataFrame) -> None:
    """Removes the tables that this session stored so far, but for those that ``docs`` reads.

    For a chain of steps: what one step stored for itself is of no use once its result is written.
    """
    needed = _read_by(docs)
    _remove(docs.sparkSession, [p for p in _STORED if p not in needed])


def drop_stored(*tables: DataFrame) -> None:
    """Removes stored tables, as they came from ``stored``, that no later step reads."""
    for table in tables:
        _remove(table.sparkSession, _read_by(table))


def numbered(docs: DataFrame, bits: int = 63) -> DataFrame:
    """``row`` (a long of at most ``bits`` bits) and ``whole`` (all columns of ``docs``), one row for each row.

    The number is the file's and the row's place in that file, so it does not depend on how a scan is
    split, and every pass over the result has the same. What is no scan of files is written once first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"])
    except PySparkException:
        docs = stored(docs.select(whole))
        place, whole = docs.metadataColumn("_metadata"), F.col("whole")
    path = place["file_path"]
    files = sorted(r[0] for r in docs.select(path).distinct().collect())  # as many as the scan's plan holds
    shift = bits - max(1, (len(files) - 1).bit_length())
    placed = docs.select(whole, path.alias("path"), place["row_index"].alias("place"))
    table = docs.sparkSession.createDataFrame(list(enumerate(files)), "number long, file string")
    return placed.join(F.broadcast(table), F.col("path") == F.col("file"), "left").select(
        F.when(F.col("place") < (1 << shift), F.shiftleft("number", shift) + F.col("place"))
        .otherwise(F.raise_error(F.lit("too many rows in a file")).cast("long")).alias("row"), "whole",
    )


def texts_of(base: DataFrame) -> DataFrame:
    """row, doc_id and text of numbered documents."""
    return base.select("row", F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"))


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def session_broadcast_bytes(spark: SparkSession) -> int:
    """What the session lets a join broadcast."""
    found = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower())
    return int(found[1]) * _UNITS[found[2]]


def broadcast_within(df: DataFrame, row_bytes: int, most: int | None = None) -> DataFrame:
    """A stored table, with a broadcast hint if it is small; beyond, joins shuffle it.

    Small is what ``most`` bytes hold, or what the session lets joins broadcast.
    """
    limit = session_broadcast_bytes(df.sparkSession) if most is None else most
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def trimmed(text: Column) -> Column:
    """Without the white space at both ends."""
    return F.call_function("btrim", text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    bare = trimmed(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; for text that is all ASCII that is lower()."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the part that no label may be learnt from; null ids do."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))

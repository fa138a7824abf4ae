"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations alone.

A run is a table bucketed and sorted by line key: one row per key with the number of documents and
the largest document id that hold it. A new batch is reduced to one row per key, merge-anti-joined
with every run (bucket by bucket, without a shuffle of the runs), and what is left is added as a run
of level 0. Once a level has ``fan_in`` runs they are compacted into one run of the level above.

The anti-join takes out what the runs have settled already: keys that a single run shows in enough
documents, under a document id at least as large. Such rows can change nothing, so a frequent line
stops costing anything soon after it became frequent. Everything else is added, so the counts of
keys that are not settled stay exact and the order of the batches does not matter.

Keys are 128-bit hashes of the normalised line. Aggregates combine before their shuffle, and the join
that marks lines keeps the occurrences on the side that Spark splits, so one line in a third of
all documents is dealt out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.common import ascii_lower, numbered, shared_folder, stored, texts_of, trimmed

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_IN = 2


class LineRuns:
    """Levels of runs for one corpus. ``close`` forgets the run tables; their files stay in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int | None = None):
        if fan_in < 2:
            raise ValueError("compaction takes at least two runs")
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folders: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = shared_folder(self.spark)
        (
            rows.repartition(self.buckets, "key").sortWithinPartitions("key")
            .write.option("compression", "zstd").option("path", self.folders[name])
            .bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        """Adds rows (key, doc_id), one for each document that holds the key."""
        fresh = batch.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
        for name in self.names():
            run = self.spark.table(name).where(F.col("docs") >= self.min_docs).select(
                F.col("key").alias("run_key"), F.col("top").alias("run_top")
            )
            fresh = fresh.join(
                run.hint("merge"), (F.col("key") == F.col("run_key")) & (F.col("run_top") >= F.col("top")), "left_anti"
            )
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._summed(merged), level + 1)
            self._forget(merged)
            level += 1

    def _summed(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed scans does not keep equal keys of its runs together.
        rows = self.spark.read.schema("key binary, docs long, top long").parquet(*[self.folders[n] for n in names])
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def frequent(self) -> DataFrame:
        """Keys (key, top) that at least ``min_docs`` documents hold."""
        return stored(self._summed(self.names()).where(F.col("docs") >= self.min_docs).select("key", "top"))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._forget(self.names())
        self.levels = []


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(lines: Column, min_chars: int) -> Column:
    """(key, place, first) of each long line; ``first`` where no earlier line of the document has the key."""
    long_ones = F.filter(
        F.transform(lines, lambda x, i: F.struct(trimmed(x).alias("bare"), i.alias("place"))),
        lambda x: F.char_length(x["bare"]) >= min_chars,
    )
    keys = F.array_sort(
        F.transform(long_ones, lambda x: F.struct(F.unhex(F.md5(ascii_lower(x["bare"]).cast("binary"))).alias("key"), x["place"].alias("place")))
    )
    return F.transform(
        F.array(keys),
        lambda k: F.transform(
            k,
            lambda x, i: F.struct(
                x["key"].alias("key"), x["place"].alias("place"),
                ((i == 0) | (k[F.greatest(i - 1, F.lit(0))]["key"] != x["key"])).alias("first"),
            ),
        ),
    )[0]


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
    buckets: int | None = None,
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, text without the lines that go.

    Lines whose key has at least ``min_chars`` code points and is held by at least ``min_docs``
    documents go everywhere but in the largest doc_id that holds them. Null and empty texts are one
    empty line. A null doc_id counts as smaller than all others, and rows with equal ids as
    documents of their own that keep the same lines. An empty table gives no rows. Only doc_id
    and text are read.
    """
    spark = docs.sparkSession
    texts = texts_of(numbered(docs))
    lowest = F.lit(-(1 << 63))
    by_line = texts.select(
        "row", F.coalesce("doc_id", lowest).alias("doc_id"), F.explode(_keyed(_lines(F.col("text")), min_chars)).alias("line")
    ).select("row", "doc_id", "line.*")
    shares = [k / batches for k in range(1, batches)]
    cuts = texts.approxQuantile("doc_id", shares, 0.01) if shares else []
    # Larger ids first: what is settled by them needs no more of the smaller ones.
    batch = sum((F.col("doc_id") <= c).cast("int") for c in cuts) if cuts else F.lit(0)
    path = shared_folder(spark)
    (
        by_line.withColumn("batch", F.lit(0) + batch)
        .write.partitionBy("batch").option("compression", "zstd").parquet(path)
    )
    occurrences = spark.read.schema("row long, doc_id long, key binary, place int, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fan_in, buckets)
    for number in range(len(cuts) + 1):
        runs.add(occurrences.where((F.col("batch") == number) & F.col("first")).select("key", "doc_id"))
    frequent = runs.frequent()
    runs.close()
    gone = (
        occurrences.join(frequent, "key").where("doc_id <> top")
        .groupBy("row").agg(F.collect_list("place").alias("gone"))  # at most the lines of one document
    )
    lines = _lines(F.col("text"))
    kept_places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return (
        texts.join(gone, "row", "left")
        .withColumn("lines", lines)
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(F.transform(kept_places, lambda i: F.col("lines")[i]), "\n")).alias("text"),
        )
    )


ORACLE_SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT r, doc_id, i, l[i] AS line,
    translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts)
), often AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5
), marked AS (
  SELECT lines.*, coalesce(doc_id <> top, false) AS gone FROM lines LEFT JOIN often USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

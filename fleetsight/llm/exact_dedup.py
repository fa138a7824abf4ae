"""Exact duplicates by deterministic block naming, in DataFrame operations alone.

Every normalised text is cut into blocks of a fixed size. Equal blocks get one integer name, then
adjacent names are paired and pairs are named, until each document has a single name. Two documents
have the same name on the same level exactly if their texts are equal: nothing rests on a hash.

A name is the number of the first occurrence among equal blocks, once these are sorted together:
document and place, packed into a long. Finding it is an aggregate that combines before the shuffle,
and giving it back to the occurrences is a sort-merge join whose occurrence side can be split; so a
block that a third of all rows hold costs a few rows per task in the first and is dealt out in the
second. The text travels twice at most; the levels above carry a few numbers per pair of names. Each
level is written to the shared folder, because both halves of the next one read it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import SPACE_CLASS, drop_stored, numbered, stored, texts_of

#: Code points in a block. A parameter.
BLOCK = 1024
# A name has the number of a row and the place of a block in its text.
_ROW_BITS, _PLACE_BITS = 44, 19
#: Stands for the missing right half of an odd end; no name is negative.
_NONE = -1


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def _blocks(text: Column, block: int) -> Column:
    """The text in blocks, in one pass; an empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _named(parts_of: DataFrame, parts: list[str]) -> DataFrame:
    """Adds ``name``, one integer for each combination of ``parts``, and drops these."""
    occurrence = F.shiftleft("row", _PLACE_BITS) + F.col("place")
    names = (
        parts_of.groupBy(*parts).agg(F.min(occurrence).alias("name")).withColumnsRenamed({p: f"n_{p}" for p in parts})
    )
    same = reduce(lambda a, b: a & b, [F.col(p) == F.col(f"n_{p}") for p in parts])
    return parts_of.join(names, same).drop(*parts, *[f"n_{p}" for p in parts])


def _paired(level: DataFrame) -> DataFrame:
    """Adjacent names side by side; what the first of a document carries goes on."""
    half = F.shiftright("place", 1)
    left = level.where("place % 2 = 0").withColumns({"place": half}).withColumnRenamed("name", "left")
    right = level.where("place % 2 = 1").select("row", half.alias("place"), F.col("name").alias("right"))
    return left.join(right, ["row", "place"], "left").withColumns({
        "right": F.coalesce("right", F.lit(_NONE)),
        "n": F.shiftright(F.col("n") + 1, 1),
    })


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): row, doc_id, text_sha256, and its text's identity (level, name).

    ``row`` numbers the rows, because ids may repeat or be null.
    """
    return _identities(numbered(docs, _ROW_BITS), block)


def _identities(base: DataFrame, block: int) -> DataFrame:
    texts = texts_of(base).withColumn("text", normalised(F.col("text")))
    blocks = texts.select(
        "row", "doc_id", F.sha2("text", 256).alias("sha"), _blocks(F.col("text"), block).alias("cut"),
    ).select("row", "doc_id", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("place", "block"))
    if block < 1:
        raise ValueError("a block has at least one code point")
    numbered = blocks.select(
        "row", "n", "block",
        F.when(F.col("place") < (1 << _PLACE_BITS), F.col("place"))
        .otherwise(F.raise_error(F.lit("too many blocks in a text; choose longer blocks")).cast("int")).alias("place"),
        # What is known of a document travels with its first block only.
        F.when(F.col("place") == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("place") == 0, F.col("sha")).alias("sha"),
    )
    level, depth, done = stored(_named(numbered, ["block"])), 0, []
    most = level.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(
            level.where("n = 1").select("row", "doc_id", F.col("sha").alias("text_sha256"), F.lit(depth).alias("level"), "name")
        )
        if most <= 1:
            return reduce(DataFrame.unionByName, done)
        # Halves with each level, so there are at most as many levels as the place has bits.
        pairs = stored(_paired(level.where("n > 1")))
        level = stored(_named(pairs, ["left", "right"]))
        drop_stored(pairs)
        most, depth = (most + 1) // 2, depth + 1


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after white space is normalised) the row with the smallest doc_id stays; of
    several such rows, the first of the scan; rows without an id only where no other has one, and
    keep_id is null then. Null texts equal empty ones. An empty table gives no rows. Only doc_id and
    text are read, so other columns may have any names.
    """
    return _duplicates(numbered(docs, _ROW_BITS), block)


def _duplicates(base: DataFrame, block: int) -> DataFrame:
    found = _identities(base, block)
    last = F.lit((1 << 63) - 1)
    groups = (
        found.groupBy("level", "name")
        .agg(
            F.min(F.struct(F.coalesce("doc_id", last).alias("id"), F.col("row").alias("first"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("doc_id").alias("keep_id"),
        )
        .select("level", "name", F.col("best.first").alias("first"), "group_size", "keep_id")
    )
    return found.join(groups, ["level", "name"]).select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    base = numbered(docs, _ROW_BITS)
    dropped = _duplicates(base, block).where("NOT kept").select("row")
    return base.join(dropped, "row", "left_anti").select("whole.*")


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""

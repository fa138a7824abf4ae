"""Winnowed fingerprints of documents, and how alike two of them are.

Every run of ``GRAM`` code points has a hash, rolled up by doubling (the hash of 2m points is made of the
hashes of both halves), so that it costs a few vector operations over a whole batch of texts. Of every
``WINDOW`` consecutive hashes the least is kept, the rightmost of equal ones, with its position. Any
passage of ``GRAM + WINDOW - 1`` code points that two texts share therefore gives both a common entry.

A fingerprint is the text of its entries hash and position, 8 hexadecimal digits each, by position. The
likeness of two is the Dice coefficient of their distinct hashes; two without hashes are alike (1).

Comparing a document with the next one needs neighbours in a total order of all documents. Ids are
cut into ranges by approximate quantiles, at most a few thousand; rows go to their range, and the
first document of a range also to the range before it. A task sorts its ranges with Spark's spilling
sort and passes through them with two texts in memory, so a text moves once and nothing is joined.

Defined results: a null text is empty and has no entries; a text shorter than ``GRAM`` is hashed whole;
one with fewer than ``WINDOW`` hashes has one window. Order is by falling doc_id, nulls last, equal ids by
text; of equal rows one is followed by the other. After the last comes the first, and a single row is
its own next. Repeated rows get a row each, an empty table none. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM_DOUBLINGS = 4
#: Code points of a hashed run, a power of two.
GRAM = 1 << GRAM_DOUBLINGS
WINDOW = 32
#: Ranges of ids for each shuffle partition, and in all.
RANGES_EACH, MOST_RANGES = 8, 4096
_LEAST_ID = -(1 << 63)
_BASE = 0x9E3779B1
# A published 32-bit finaliser that mixes all bits.
_MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
#: Code points that are fingerprinted at once.
_AT_ONCE = 1 << 20

_ROWS = 256

_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` code points that begin at each place with so many left."""
    rolled, factor, width = points.astype(np.uint32), _BASE, 1
    for _ in range(GRAM_DOUBLINGS):
        if len(rolled) <= width:
            return np.zeros(0, np.uint32)
        rolled = rolled[:-width] * np.uint32(factor) + rolled[width:]
        factor, width = factor * factor % (1 << 32), 2 * width
    return mixed(rolled)


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in _MIX:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(times)
    return x


def whole_hash(points: np.ndarray) -> np.ndarray:
    """The one hash of a text shorter than a gram."""
    value = np.zeros(1, np.uint32)
    for point in points.astype(np.uint32):
        value = value * np.uint32(_BASE) + point
    return mixed(value)


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of every ``window`` consecutive ones, by doubling."""
    width, least = 1, keys
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def winnow(texts: list[str]) -> list[np.ndarray]:
    """Entries of each text as rows (hash, position), by position."""
    counts = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate(([0], counts.cumsum()))
    hashes = gram_hashes(points)
    # Of equal hashes the rightmost is least: places count down in the lower half of the key.
    places = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    minima = window_minima(keys, WINDOW) if len(keys) >= WINDOW else keys[:0]
    found = []
    for begin, n in zip(begins.tolist(), counts.tolist()):
        grams = n - GRAM + 1
        if n == 0:
            found.append(np.zeros((0, 2), np.uint32))
        elif grams < 1:
            found.append(np.array([[whole_hash(points[begin:begin + n])[0], 0]], np.uint32))
        else:
            own = minima[begin:begin + grams - WINDOW + 1] if grams >= WINDOW else keys[begin:begin + grams].min(keepdims=True)
            kept = own[np.concatenate(([True], own[1:] != own[:-1]))]
            at = np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF)) - np.uint64(begin)
            found.append(np.stack(((kept >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)), axis=1))
    return found


def winnow_all(texts: list[str]) -> list[np.ndarray]:
    """``winnow``, in portions of bounded size."""
    found, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _AT_ONCE:
            found += winnow(texts[begin:i])
            begin, size = i, 0
        size += len(text)
    return found + winnow(texts[begin:])


def as_text(entries: np.ndarray) -> str:
    """Hash and position of every entry as 16 hexadecimal digits, joined by commas."""
    return entries.astype(">u4").tobytes().hex(",", 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sets of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the one that follows."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range; in it the own ones in order, then those that begin the next range."""
    last = None  # range, ahead, doc_id, text, entries, distinct hashes
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            rows = [column.to_pylist() for column in batch.slice(at, _ROWS).columns]
            entries = winnow_all(rows[3])
            pairs = []
            for row in zip(*rows, entries, (np.unique(e[:, 0]) for e in entries)):
                if last is not None and not last[1] and last[0] == row[0]:
                    pairs.append((last, row))
                last = row
            changed = [edited(own[3], following[3]) for own, following in pairs]
            made = winnow_all(changed)
            columns = (
                [own[2] for own, _ in pairs],
                [len(own[3]) for own, _ in pairs],
                [hashlib.sha256(text.encode()).hexdigest() for text in changed],
                [as_text(own[4]) for own, _ in pairs],
                [as_text(e) for e in made],
                [likeness(own[5], np.unique(e[:, 0])) for (own, _), e in zip(pairs, made)],
                [likeness(own[5], following[5]) for own, following in pairs],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above a key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(b) for b in bounds])

    def step(found: Column, size: Column) -> Column:
        further = found + size
        return F.when((further <= len(bounds)) & (F.get(table, further - 1) <= key), further).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def in_ranges(docs: DataFrame) -> DataFrame:
    """range, ahead, doc_id, text: every document in its range, and first ones also in the range before.

    The number of ranges bounds what the driver holds: their bounds and their first ids.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID))
    ranges = min(MOST_RANGES, RANGES_EACH * parts)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, 10 * ranges)).first()[0] or [])) if shares else []
    firsts = [r.first for r in docs.groupBy(_range_of(key, bounds).alias("range")).agg(F.max(key).alias("first")).orderBy("range").collect()]
    # What begins a range is sent to the range above it, the very first document to the lowest range.
    to = spark.createDataFrame([(first, firsts[(i + 1) % len(firsts)]) for i, first in enumerate(firsts)], "key long, above long")
    keyed = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key")
    )
    own = F.struct(_range_of(F.col("key"), bounds).alias("range"), F.lit(False).alias("ahead"))
    more = F.struct(_range_of(F.col("above"), bounds).alias("range"), F.lit(True).alias("ahead"))
    places = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, more))
    return (
        keyed.join(F.broadcast(to), "key", "left")
        .select(F.inline(places), "doc_id", "text", "key")
        .repartition(parts, "range")
        .sortWithinPartitions("range", "ahead", F.desc("key"), "text")
        .select("range", "ahead", "doc_id", "text")
    )


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            found = winnow_all([text or "" for text in part.column(1).to_pylist()])
            entries = [[{"hash": h, "position": p} for h, p in own.tolist()] for own in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(entries, kind)], names=["doc_id", "entries"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and entries (array of hash and position) of every row, without any shuffle."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_entries, "doc_id long, entries array<struct<hash:long,position:long>>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    return in_ranges(docs).mapInArrow(_compared, _RESULT)


def _doublings_sql() -> str:
    steps, factor = [], _BASE
    for n in range(GRAM_DOUBLINGS):
        steps.append(f"""
roll{n + 1} AS (
  SELECT id, pos, cnt, (h * {factor} + lead(h, {1 << n}) OVER (PARTITION BY id ORDER BY pos)) % 4294967296 AS h FROM roll{n}
)""")
        factor = factor * factor % (1 << 32)
    return ",".join(steps)


def _mix_sql(x: str) -> str:
    for shift, times in _MIX:
        x = f"list_transform([{x}], lambda y: (xor(y, y >> {shift}) * {times}::UBIGINT) % 4294967296)[1]"
    return x


ORACLE_SQL = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (
  SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM own WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t)
),
cases AS (SELECT *, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) AS et FROM pairs),
texts AS (SELECT x, row_number() OVER () AS id FROM (SELECT t AS x FROM cases UNION SELECT et FROM cases)),
points AS (SELECT id, list_transform(regexp_extract_all(x, '(?s).'), lambda c: CAST(unicode(c) AS UBIGINT)) AS p FROM texts),
roll0 AS (SELECT id, generate_subscripts(p, 1) - 1 AS pos, len(p) - {GRAM - 1} AS cnt, unnest(p) AS h FROM points WHERE len(p) >= {GRAM}),
{_doublings_sql()},
keys AS (
  SELECT id, pos, cnt, {_mix_sql("h")} * 4294967296 + (4294967295 - pos)::UBIGINT AS k FROM roll{GRAM_DOUBLINGS} WHERE pos < cnt
),
kept AS (
  SELECT DISTINCT id, k FROM (
    SELECT id, pos, cnt, min(k) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM keys
  ) WHERE pos = 0 OR pos + {WINDOW} <= cnt
  UNION ALL
  SELECT id, {_mix_sql(f"list_reduce(p, lambda a, c: (a * {_BASE} + c) % 4294967296)")} * 4294967296 + 4294967295
  FROM points WHERE len(p) BETWEEN 1 AND {GRAM - 1}
),
prints AS (
  SELECT id, list(DISTINCT k >> 32) AS hashes,
    string_agg(printf('%08x%08x', k >> 32, 4294967295 - k % 4294967296), ',' ORDER BY 4294967295 - k % 4294967296) AS f
  FROM kept GROUP BY id
),
done AS (SELECT x, coalesce(hashes, []) AS hashes, coalesce(f, '') AS f FROM texts LEFT JOIN prints USING (id))
SELECT c.doc_id, length(c.t) AS n_chars, sha256(c.et) AS edited_sha256, a.f AS fingerprint, e.f AS edited_fingerprint,
  CASE WHEN len(a.hashes) + len(e.hashes) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(a.hashes, e.hashes)) / (len(a.hashes) + len(e.hashes)) END AS near_edited,
  CASE WHEN len(a.hashes) + len(n.hashes) = 0 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(a.hashes, n.hashes)) / (len(a.hashes) + len(n.hashes)) END AS near_next
FROM cases c JOIN done a ON a.x = c.t JOIN done e ON e.x = c.et JOIN done n ON n.x = c.nt
"""

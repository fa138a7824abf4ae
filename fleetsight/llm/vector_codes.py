"""Compact codes of vectors: one codebook of integer vectors for each of 16 parts.

Every task cuts its rows into groups. In a group the vectors of each part are sorted along a Hilbert
curve and cut into flat blocks, and a block has its box (componentwise least and greatest value) and
its sum. The groups are written once; every round reads them and compares boxes with the codebook
first. An entry whose least distance to the box exceeds the greatest distance of some other entry
can be nearest to nothing in the block, so only a shortlist is left. A shortlist of one takes the
whole block by its sum; otherwise a small kernel computes the integer distances of the block to its
shortlist. Nothing is approximated.

Only counts and sums by part and entry are shuffled or reach the driver, 16 * 64 * part length at most.

Defined results: rows whose vector is null or has a null or non-finite component are dropped. Vectors
shorter than the longest, or of a length that 16 does not divide, count as followed by zeros. Integer
components beyond 2^24 either way are set to that. Repeated rows and ids are rows like others; null
ids come last. With fewer than 64 rows the codebooks are as short. An empty table gives no rows. Only
``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of one group, and of one block in it.
GROUP, BLOCK = 16_384, 32
LIMIT = 1 << 24
#: Labels up to this many (16 bytes each) are broadcast with their sums.
BROADCAST_LABELS = 500_000
_SALTS = 32
_KEY_BITS = 62

_GROUP_ROW = "vec_ids array<long>, labels array<long>, places binary, parts binary, low binary, high binary, sums binary"
_CODED = "vec_id long, label long, code string, error long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (one row each, components below 2^bits) on a Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        q, below = 1 << bit, (1 << bit) - 1
        for i in range(axes):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inverted, below, swapped)
            if i:
                x[i] ^= swapped
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= flips
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = (keys << 1) | ((x[i] >> bit) & 1)
    return keys


def hilbert_order(vectors: np.ndarray) -> np.ndarray:
    """Order of integer vectors along a curve through their box; it matters for speed alone."""
    vectors = vectors[:, :_KEY_BITS]
    bits = max(1, min(10, _KEY_BITS // vectors.shape[1]))
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    cells = (vectors - low) * ((1 << bits) - 1) // np.maximum(high - low, 1)
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each block and entry, whether the entry can be nearest to a vector in the block's box."""
    under, over = low[:, None, :] - entries, entries - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each vector, ties to the lower, and its squared distance."""
    distances = ((block[:, None, :] - entries) ** 2).sum(axis=2)
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(block)), found]


def _integers(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 * x), followed by zeros up to ``width``."""
    whole = np.zeros((len(lists), width), np.int64)
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    rows = np.repeat(np.arange(len(lists)), sizes)
    columns = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)
    whole[rows, columns] = np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)
    return whole


def _group(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    """One group as a row: places and vectors of each part in curve order, boxes and sums of its blocks."""
    begins = np.arange(0, len(vectors), BLOCK)
    kept = {name: [] for name in ("places", "parts", "low", "high", "sums")}
    for part in np.split(vectors, PARTS, axis=1):
        order = hilbert_order(part)
        part = part[order]
        kept["places"].append(order.astype(np.int32))
        kept["parts"].append(part.astype(np.int32))
        kept["low"].append(np.minimum.reduceat(part, begins).astype(np.int32))
        kept["high"].append(np.maximum.reduceat(part, begins).astype(np.int32))
        kept["sums"].append(np.add.reduceat(part, begins))
    binary = [pa.array([np.stack(v).tobytes()], pa.binary()) for v in kept.values()]
    lists = [pa.array([column.to_pylist()], pa.list_(pa.int64())) for column in (ids, labels)]
    return pa.RecordBatch.from_arrays([*lists, *binary], names=["vec_ids", "labels", *kept])


def _groups(width: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, n = [], 0

    def group() -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        return _group(rows.column(0), rows.column(2), _integers(rows.column(1), width))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, GROUP - n)
            waiting.append(part)
            n += part.num_rows
            at += part.num_rows
            if n == GROUP:
                yield group()
                waiting, n = [], 0
    if n:
        yield group()


class Group:
    """A stored group, as arrays by part."""

    def __init__(self, row: dict, width: int):
        self.ids, self.labels = row["vec_ids"], row["labels"]
        self.n, size = len(self.ids), width // PARTS
        blocks = -(-self.n // BLOCK)
        self.places = np.frombuffer(row["places"], np.int32).reshape(PARTS, self.n)
        self.parts = np.frombuffer(row["parts"], np.int32).reshape(PARTS, self.n, size)
        self.low, self.high = (np.frombuffer(row[k], np.int32).reshape(PARTS, blocks, size) for k in ("low", "high"))
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(PARTS, blocks, size)

    def blocks(self, part: int, entries: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Number, rows and shortlist of each block of a part."""
        near = shortlists(self.low[part].astype(np.int64), self.high[part].astype(np.int64), entries)
        for number in range(len(near)):
            yield number, slice(number * BLOCK, min((number + 1) * BLOCK, self.n)), np.flatnonzero(near[number])


def _groups_of(width: int, batches: Iterable[pa.RecordBatch]) -> Iterator[Group]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Group(batch.slice(i, 1).to_pylist()[0], width)


def _round(codebooks: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts by part and entry, of all rows of a task; place is an index into that table."""
    parts, entries, size = codebooks.shape
    totals = np.zeros((parts, entries, size + 1), np.int64)
    for group in _groups_of(parts * size, batches):
        for part in range(parts):
            book, own = codebooks[part], totals[part]
            for number, rows, short in group.blocks(part, book):
                if len(short) == 1:
                    own[short[0], :size] += group.sums[part, number]
                    own[short[0], size] += rows.stop - rows.start
                    continue
                block = group.parts[part, rows].astype(np.int64)
                found = short[nearest(block, book[short])[0]]
                np.add.at(own, (found, slice(0, size)), block)
                own[:, size] += np.bincount(found, minlength=entries)
    flat = totals.ravel()
    places = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(flat[places])], names=["place", "total"])


def _codes(codebooks: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, _, size = codebooks.shape
    for group in _groups_of(parts * size, batches):
        codes, errors = np.zeros((group.n, parts), np.uint8), np.zeros(group.n, np.int64)
        for part in range(parts):
            for _, rows, short in group.blocks(part, codebooks[part]):
                found, error = nearest(group.parts[part, rows].astype(np.int64), codebooks[part][short])
                at = group.places[part, rows]
                codes[at, part] = short[found]
                errors[at] += error
        text = codes.tobytes().hex()
        texts = [text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.ids, pa.int64()), pa.array(group.labels, pa.int64()), pa.array(texts), pa.array(errors)],
            names=["vec_id", "label", "code", "error"],
        )


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    narrow = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long")
    )
    return narrow.where(F.col("embedding").isNotNull() & finite)


def first_codebooks(kept: DataFrame, entries: int) -> np.ndarray:
    """The parts of the smallest ids' vectors, by part, entry and component; at most ``entries`` rows are fetched."""
    length = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    size = max(1, -(-length // PARTS))
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    vectors = _integers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), PARTS * size) if rows else np.zeros((0, PARTS * size), np.int64)
    return np.stack(np.split(vectors, PARTS, axis=1))


def next_codebooks(groups: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts nearest to them; unused entries stay."""
    sums = groups.mapInArrow(functools.partial(_round, codebooks), "place long, total long")
    parts, entries, size = codebooks.shape
    totals = np.zeros(parts * entries * (size + 1), dtype=np.int64)
    # Bounded by the size of the codebooks.
    for row in sums.groupBy("place").agg(F.sum("total").alias("total")).collect():
        totals[row.place] = row.total
    totals = totals.reshape(parts, entries, size + 1)
    counts = totals[:, :, size:]
    return np.where(counts > 0, totals[:, :, :size] // np.maximum(counts, 1), codebooks)


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over rows of equal label; nulls are one label.

    A label may hold most rows: its sum is made before the shuffle, and where labels are too many to
    broadcast the join deals every label's rows over salts.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    known = stored(sums.select(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("known"), "label_error"))
    keyed = coded.withColumns({"none": F.col("label").isNull(), "known": F.coalesce("label", F.lit(0))})
    if known.count() <= BROADCAST_LABELS:
        joined = keyed.join(F.broadcast(known), ["none", "known"])
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int")).join(salted, ["none", "known", "salt"])
    return joined.select("vec_id", "label", "code", "error", "label_error")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of the usable rows, and the final codebooks."""
    kept = usable(vectors)
    codebooks = first_codebooks(kept, entries)
    width = PARTS * codebooks.shape[2]
    groups = stored(kept.mapInArrow(functools.partial(_groups, width), _GROUP_ROW))
    if codebooks.shape[1]:
        for _ in range(rounds):
            codebooks = next_codebooks(groups, codebooks)
    coded = stored(groups.mapInArrow(functools.partial(_codes, codebooks), _CODED))
    return with_label_error(coded), codebooks


def vector_codes(vectors: DataFrame) -> DataFrame:
    coded, codebooks = compress(vectors)
    digest = F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


def _rounds_sql() -> str:
    """Assignments and means of each round, one after the other."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
near{n} AS (
  SELECT vec_id, label, part, v, unnest(min_by({{'e': entry, 'd': distance}}, (distance, entry), 1)) AS found FROM (
    SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
    FROM parts p JOIN book{n} b USING (part)
  ) GROUP BY vec_id, label, part, v
)""")
        if n < ROUNDS:
            steps.append(f"""
mean{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS v FROM (
    SELECT part, found.e AS entry, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT part, found, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{n}) GROUP BY ALL
  ) GROUP BY part, entry
),
book{n + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry))""")
    return ",".join(steps)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v
  FROM kept, range({PARTS}) AS r(part)
),
book0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  QUALIFY entry < {ENTRIES}
),{_rounds_sql()},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', found.e), '' ORDER BY part) AS code, CAST(sum(found.d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id, label
),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS d FROM (
  SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{ROUNDS}
))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM coded, digest
"""

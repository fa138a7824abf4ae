"""Exact Jaccard join of word shingles: rare-first prefixes, length, positional and suffix filters.

1. One pass over the texts gives each document's distinct shingles as 64-bit hashes, the identity of
   the set, a bit for each residue of its hashes, and, per task, counts of all shingles in a sketch
   of fixed size. The sketch only orders shingles from rare to frequent; any order gives the same
   links, so its collisions cost time at worst.
2. A second pass emits the prefix of each set in that order. Two sets that link share a prefix
   shingle. Equal sets are one vertex from here on, so copies cost nothing; a task emits a set once.
3. Candidates. All pairs below a shingle would be quadratic in a group of near copies. So stars come
   first: the member whose prefix is shared the most is paired with the others, the pairs are
   verified, and components are formed. After that only pairs across components can matter for the
   result; star rounds go on while a good part of their pairs link and all pairs that are left would be
   many for each row, and then all pairs across components that are left are formed. No cap is set, and no link between components is missed.
4. Two sets are paired at their first shared shingle, or not: by their sizes, by what follows it in
   both, and by how many of its prefix the set shares with any other. A pair is a candidate once,
   however many shingles it shares; the suffix filter compares bits, as many as a set has shingles, so
   it works on long texts too, and what remains is verified by the full sets.
5. Where each document's number of links is asked for, all pairs within a component count. Its sets are
   dealt into blocks by hash, and every two blocks meet in one task, which counts common shingles by
   products of incidence matrices; so a set is sent once per block of its component, not once per pair.

Shuffles carry prefix rows, pairs, and the sets of candidates; texts only of documents in candidates. A table
that no later step reads is removed at once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.common import broadcast_within, drop_stored, numbered, stored, texts_of
from fleetsight.llm.components import components

WORDS = 5
#: Share of the union that two sets must have in common, in hundredths.
PERCENT = 80
#: log2 of the cells in the frequency sketch: its size, and that of its broadcast (2 MB), is fixed.
SKETCH_BITS = 18
#: Stars go on while at least one in so many of their pairs links, and while all pairs that are left would be
#: more than so many for each row.
STAR_YIELD = 10
PAIRS_PER_ROW = 16
#: Bytes up to which the numbers of wanted sets are broadcast, so that whole texts need no shuffle. Tables of
#: tokens are broadcast as far as the session lets joins do so.
BROADCAST_SETS = 16 << 20
_TOKEN_BYTES, _CLASS_BYTES, _SET_BYTES = 16, 24, 48
_ROWS = 256
#: Sets in a block, about; two blocks are in memory at once.
BLOCK = 128
#: Shingles that an incidence matrix of two blocks covers at a time.
_COLUMNS = 4096

# Multipliers of the hash, from the golden ratio and its finalizer.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle has are one shingle."""
    # Bytes know ASCII alone: lower() folds A-Z, and split() parts at the six white space characters.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = _mixed(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _STEP + hashes[k:len(found) - width + 1 + k]
    return np.unique(_mixed(total))


def _identity(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _odds(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them has it. As many bits as shingles, up to twice."""
    width = 1 << max(6, (shingles.size - 1).bit_length())
    found = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(found.astype(np.uint8) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least: each changes one bit. The longer bits are folded."""
    left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(left), len(right))
    left, right = (np.bitwise_xor.reduce(side.reshape(-1, size), axis=0) for side in (left, right))
    return int(np.bitwise_count(left ^ right).sum())


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the batches, a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield list(zip(*[c.to_pylist() for c in part.columns]))


_PROFILE = "row long, doc_id long, n int, sig binary, odds binary, cell int, seen long"


def _profiles(words: int, bits: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end a row per cell of the task's sketch."""
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()),
        ("odds", pa.binary()), ("cell", pa.int32()), ("seen", pa.int64()),
    ])
    seen = np.zeros(1 << bits, np.int64)
    for rows in _texts(batches):
        sets = [shingle_set(text, words) for _, _, text in rows]
        if any(s.size for s in sets):
            seen += np.bincount((np.concatenate(sets) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([s.size for s in sets], pa.int32()),
            pa.array([_identity(s) if s.size else None for s in sets], pa.binary()),
            pa.array([_odds(s) if s.size else None for s in sets], pa.binary()),
            pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()),
        ], schema=schema)
    cells = np.flatnonzero(seen)
    for at in range(0, len(cells), 10_000):
        some = cells[at:at + 10_000]
        k = len(some)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
            pa.nulls(k, pa.binary()), pa.array(some, pa.int32()), pa.array(seen[some], pa.int64()),
        ], schema=schema)


_PREFIX = "token long, row long, place int"


def _prefixes(words: int, percent: int, sketch, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set: so many that sets which link must share one."""
    seen = sketch.value
    mask = np.uint64(len(seen) - 1)
    sent: set[bytes] = set()  # no more than the documents of one input split
    for rows in _texts(batches):
        tokens, holders, places = [], [], []
        for row, text in rows:
            shingles = shingle_set(text, words)
            sig = _identity(shingles)
            if not shingles.size or sig in sent:
                continue
            sent.add(sig)
            n = shingles.size
            length = n - -(-percent * n // 100) + 1
            counts = seen[(shingles & mask).astype(np.int64)]
            rarest = np.argpartition(counts, length - 1)[:length] if length < n else np.arange(n)
            # Of equally frequent shingles at the edge, the smallest hashes: a total order for all sets.
            edge = counts[rarest].max()
            pick = np.flatnonzero(counts <= edge)
            order = pick[np.lexsort((shingles[pick], counts[pick]))][:length]
            tokens.append(shingles[order].view(np.int64))
            holders.append(np.full(length, row, np.int64))
            places.append(np.arange(length, dtype=np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(holders)), pa.array(np.concatenate(places))],
                names=["token", "row", "place"],
            )


def _sets(words: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _texts(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([sig for sig, _ in rows], pa.binary()),
             pa.array([shingle_set(text, words).tobytes() for _, text in rows], pa.binary())],
            names=["sig", "shingles"],
        )


def _alike(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix filter: sets that link differ in at most (100 - p) / (100 + p) of both sizes."""
    for rows in _texts(batches):
        near = [(a, b) for a, b, n, m, x, y in rows if (100 + percent) * _apart(x, y) <= (100 - percent) * (n + m)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in near], pa.binary()), pa.array([b for _, b in near], pa.binary())], names=["a", "b"]
        )


def _verified(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _texts(batches):
        linked = []
        for a, b, x, y in rows:
            left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((left, right))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (both.size - common):
                linked.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in linked], pa.binary()), pa.array([b for _, b in linked], pa.binary())], names=["a", "b"]
        )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common members of every set of ``left`` with every one of ``right``."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), _COLUMNS):
        part = shared[at:at + _COLUMNS]

        def incidence(sets: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                some = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                places = np.searchsorted(part, some)
                out[i, places[part[places] == some]] = 1
            return out

        total += np.rint(incidence(left) @ incidence(right).T).astype(np.int64)
    return total


def _block_links(percent: int, key: tuple, members: list[tuple]) -> Iterator[tuple[bytes, int]]:
    """(sig, documents that it links with) for the members (sig, block, copies, shingles) of two blocks, or of one with itself."""
    _, low, high = key
    left, right = [m for m in members if m[1] == low], [m for m in members if m[1] == high]
    if not left or not right:
        return
    x, y = ([np.frombuffer(m[3], np.uint64) for m in side] for side in (left, right))
    common = _common(x, y)
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
    linked = 100 * common >= percent * union
    if low == high:
        np.fill_diagonal(linked, False)
    yield from zip((m[0] for m in left), (linked @ np.array([m[2] for m in right])).tolist())
    if low != high:
        yield from zip((m[0] for m in right), (np.array([m[2] for m in left]) @ linked).tolist())


def _links_of_blocks(percent: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by comp, low and high."""
    key, members, sigs, counts = None, [], [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(counts, pa.int64())], names=["sig", "links"])

    def settle() -> None:
        for sig, n in _block_links(percent, key, members) if members else ():
            if n:
                sigs.append(sig)
                counts.append(n)

    for rows in _texts(batches):
        for comp, low, high, *member in rows:
            if (comp, low, high) != key:
                settle()
                key, members = (comp, low, high), []
            members.append(tuple(member))
        if len(sigs) >= _ROWS:
            yield made()
            sigs, counts = [], []
    settle()
    yield made()


def _beyond(percent: int, n: Column) -> Column:
    """Shingles of a set after its prefix."""
    return F.ceil(percent * n / 100) - 1


def _may_link(percent: int, n: Column, place: Column, rest: Column, m: Column, other: Column, other_rest: Column) -> Column:
    """Length and positional filter for the first shared shingle of two sets, at ``place`` of n and ``other`` of m.

    What they share follows it in both. All shingles of the prefix that ends first would be in the other prefix if
    they were in that set, so of this prefix only those from here on that several sets hold (``rest``) can be shared.
    """
    most = F.least(
        F.least(n - place, m - other), F.greatest(rest + _beyond(percent, n), other_rest + _beyond(percent, m))
    )
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (vertex, root) of ``roots`` with further links between their sets."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(links))


class _Join:
    """One run of the join, with the tables that its steps share."""

    def __init__(self, base: DataFrame, words: int, percent: int, sketch_bits: int):
        if not 0 < percent <= 100 or words < 1:
            raise ValueError("percent is over 0 and at most 100, and a shingle has a word at least")
        self.words, self.percent = words, percent
        self.texts = texts_of(base)
        both = stored(self.texts.mapInArrow(functools.partial(_profiles, words, sketch_bits), _PROFILE))
        self.documents = both.where("cell IS NULL").select("row", "doc_id", "n", "sig", "odds")
        self.vertices = stored(
            self.documents.where("n > 0").groupBy("sig").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best"),
                F.first("odds").alias("odds"), F.first("n").alias("n"),
            ).select("sig", F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"), "odds", "n")
        )
        sketch = np.zeros(1 << sketch_bits, np.int64)
        cells = both.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen"))
        for cell, seen in cells.collect():  # a fixed number of cells, whatever the input
            sketch[cell] = seen
        shared = base.sparkSession.sparkContext.broadcast(sketch)
        prefixes = stored(
            self.texts.select("row", "text").mapInArrow(functools.partial(_prefixes, words, percent, shared), _PREFIX)
        )
        # Most shingles are in one row, and a shingle and a count are all that travels of these. Those that only
        # copies of one set share go with the first merging, which knows the different sets of each.
        common = stored(
            prefixes.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("t")
        )
        held = prefixes.join(broadcast_within(common, _TOKEN_BYTES), F.col("token") == F.col("t")).drop("t")
        # A row's number is shorter than the identity of its set, and is all that prefixes carry of it.
        named = held.join(self.documents.select("row", "sig", "n"), "row").select("token", "sig", "n", "place")
        shared_rows = stored(named.dropDuplicates(["token", "sig"]))
        drop_stored(prefixes, common)
        rows = self.merged(shared_rows, "place")
        drop_stored(shared_rows)
        own, onward = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy(F.desc("place"))
        slots = F.col("n") - _beyond(percent, F.col("n"))
        # A set whose whole prefix is shared is likely in the middle of its group.
        self.rows = stored(
            rows.select(
                "token", "sig", "n", "place", (F.sum("alike").over(own) / slots).alias("weight"),
                F.sum("alike").over(onward).alias("rest"),
            )
        )
        drop_stored(rows)

    @staticmethod
    def merged(rows: DataFrame, first: str = "token") -> DataFrame:
        """One shingle, the ``first``, for all that the same sets hold (``alike``): each of them gives the same pairs.

        One set alone has none. Places grow in one order in all sets, so the first by place is that in each of them.
        Members are told by their number and two 64-bit sums over hashes of their 128-bit identities.
        """
        sums = rows.groupBy("token").agg(
            F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("x"),
            F.sum(F.xxhash64(F.lit(1), "sig").cast("decimal(38,0)")).alias("y"), F.min(first).alias("from"),
        )
        kept = stored(
            sums.where("members > 1").groupBy("members", "x", "y")
            .agg(F.min(F.struct("from", "token")).alias("least"), F.count(F.lit(1)).alias("alike"))
            .select(F.col("least.token").alias("t"), "alike")
        )
        out = stored(rows.join(broadcast_within(kept, _CLASS_BYTES), F.col("token") == F.col("t")).drop("t"))
        drop_stored(kept)
        return out

    def stars(self, rows: DataFrame, number: int) -> DataFrame:
        """Pairs of each shingle's leader with its other members; another leader in each round."""
        rank = F.col("weight") if number == 0 else F.xxhash64(F.lit(number), "comp").cast("double")
        leaders = rows.groupBy(F.col("token").alias("t")).agg(
            F.max(F.struct(rank.alias("rank"), F.col("sig"), F.col("n"), F.col("place"), F.col("rest"), F.col("comp"))).alias("l")
        )
        return (
            rows.join(leaders, F.col("token") == F.col("t"))
            .where((F.col("comp") != F.col("l.comp"))
                   & _may_link(self.percent, *[F.col(side + c) for side in ("", "l.") for c in ("n", "place", "rest")]))
            .select(F.least("sig", "l.sig").alias("a"), F.greatest("sig", "l.sig").alias("b"))
        )

    def pairs(self, rows: DataFrame) -> DataFrame:
        """All pairs across components that share a prefix shingle and may link."""
        names = ("sig", "n", "place", "rest", "comp")
        left = rows.select("token", *[F.col(c).alias(f"a_{c}") for c in names])
        right = rows.select(F.col("token").alias("t"), *[F.col(c).alias(f"b_{c}") for c in names])
        fits = _may_link(self.percent, *[F.col(side + c) for side in ("a_", "b_") for c in ("n", "place", "rest")])
        return left.join(
            right, (F.col("token") == F.col("t")) & (F.col("a_sig") < F.col("b_sig")) & (F.col("a_comp") != F.col("b_comp")) & fits
        ).select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Suffix filter by bits, then the full sets of what it leaves, once per pair."""
        left = self.vertices.select(F.col("sig").alias("a"), F.col("n").alias("an"), F.col("odds").alias("x"))
        right = self.vertices.select(F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("odds").alias("y"))
        pairs = stored(
            pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "x", "y")
            .mapInArrow(functools.partial(_alike, self.percent), "a binary, b binary")
        )
        wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        wanted = stored(wanted.join(self.vertices.select("sig", "row"), "sig"))
        sets = stored(
            self.texts.select("row", "text").join(broadcast_within(wanted, _SET_BYTES, BROADCAST_SETS), "row").select("sig", "text")
            .mapInArrow(functools.partial(_sets, self.words), "sig binary, shingles binary")
        )
        both = (
            pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        found = stored(both.mapInArrow(functools.partial(_verified, self.percent), "a binary, b binary"))
        drop_stored(pairs, wanted, sets)
        return found

    def with_components(self, rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
        """Rows of shingles whose members lie in several components, with each member's; pairs that these make at most."""
        named = rows.join(roots, F.col("sig") == F.col("vertex"), "left").withColumn("comp", F.coalesce("root", "sig")).drop("vertex", "root")
        several = stored(
            named.groupBy(F.col("token").alias("t"))
            .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("held"))
            .where("low <> high").select("t", "held")
        )
        most = several.agg(F.sum(F.col("held") * (F.col("held") - 1) / 2)).first()[0] or 0
        out = stored(named.join(several.select("t"), F.col("token") == F.col("t")).drop("t"))
        drop_stored(several)
        return out, most

    def roots(self) -> DataFrame:
        """The components (vertex, root) of all links; sets without a link may be left out."""
        rows, roots, number = self.rows.withColumn("comp", F.col("sig")), None, 0
        while True:
            pairs = stored(self.stars(rows, number).distinct())
            found = self.verified(pairs)
            roots = _joined(roots, found)
            if number:
                drop_stored(rows)
            (rows, most), number = self.with_components(self.rows, roots), number + 1
            # Also where no star has a pair left that may link: later rounds would have the same.
            done = most <= PAIRS_PER_ROW * rows.count() or found.count() * STAR_YIELD <= pairs.count()
            drop_stored(pairs)
            if done:
                break
        return _joined(roots, self.verified(self.pairs(rows).distinct()))

    def n_links(self, roots: DataFrame) -> DataFrame:
        """(sig, links): documents of another set that each set links with; sets without any are left out."""
        copies = self.documents.where("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
        blocks = F.ceil(F.col("k") / BLOCK).cast("int")
        placed = (
            roots.join(sizes.withColumnRenamed("root", "r"), F.col("root") == F.col("r"))
            .select(F.col("vertex").alias("v"), "root", blocks.alias("blocks"), F.pmod(F.xxhash64("vertex"), blocks).cast("int").alias("block"))
        )
        wanted = stored(
            placed.join(self.vertices.select("sig", "row"), F.col("v") == F.col("sig")).drop("v").join(copies, "sig")
        )
        numbers = wanted.select("sig", "row")
        sets = stored(
            self.texts.select("row", "text").join(broadcast_within(numbers, _SET_BYTES, BROADCAST_SETS), "row").select("sig", "text")
            .mapInArrow(functools.partial(_sets, self.words), "sig binary, shingles binary")
        )
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        meeting = (
            wanted.join(sets, "sig").select("root", "sig", "block", "copies", "shingles", other)
            .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sig", "block", "copies", "shingles")
        )
        found = meeting.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(
            functools.partial(_links_of_blocks, self.percent), "sig binary, links long"
        )
        counted = stored(found.groupBy("sig").agg(F.sum("links").alias("links")))
        drop_stored(wanted, sets)
        return counted


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, count_links: bool = False
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): row, doc_id, n_shingles, component_id, first, and n_links if asked for.

    Documents link when their shingle sets have at least ``percent`` hundredths of the union in common.
    component_id is the smallest doc_id that links reach; ``first`` marks one row per component, with
    that id. n_links is the number of other rows that link with this one, copies included. Null, empty and blank texts have no shingles and link with nothing: their component is
    their own id. Very long texts are sets like others, of as many shingles as they have. Rows with equal ids
    count each for itself; null ids are larger than all others. An empty table gives no rows. Only doc_id
    and text are read.
    """
    return _components(numbered(docs), words, percent, sketch_bits, count_links)


def _components(base: DataFrame, words: int, percent: int, sketch_bits: int, count_links: bool) -> DataFrame:
    join = _Join(base, words, percent, sketch_bits)
    roots = join.roots()
    placed = join.vertices.join(roots, F.col("sig") == F.col("vertex"), "left").select(
        "sig", "doc_id", "row", F.coalesce("root", "sig").alias("root")
    )
    best = placed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best")
    )
    by_set = placed.select("sig", "root").join(best, "root").select(
        F.col("sig").alias("s"), F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row")
    )
    counts = []
    if count_links:
        copies = join.documents.where("n > 0").groupBy(F.col("sig").alias("s")).agg((F.count(F.lit(1)) - 1).alias("copies"))
        by_set = by_set.join(copies, "s").join(join.n_links(roots).withColumnRenamed("sig", "o"), F.col("s") == F.col("o"), "left").drop("o")
        counts = [(F.coalesce("copies", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links")]
    return join.documents.join(by_set, F.col("sig") == F.col("s"), "left").select(
        "row", "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("s").isNull() | (F.col("row") == F.col("best_row"))).alias("first"), *counts,
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns."""
    base = numbered(docs)
    gone = _components(base, words, percent, SKETCH_BITS, False).where("NOT first").select("row")
    return base.join(gone, "row", "left_anti").select("whole.*")

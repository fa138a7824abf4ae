"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bounded-space online best fit. Items arrive one by one; a fixed number of bins is open, in lists
by free space, and a bitset has the free spaces that occur. An item goes to the open bin it fills
best: the lowest set bit at or above its length. Where none can take it a new bin opens, and if
too many are open the fullest closes first.

Every task packs the documents of its own input split: the work of a task is bounded by the split,
and a lost task is simply run again with the same result. Items arrive in falling order of length,
from Spark's spilling sort inside the task, because the long ones are then placed while everything
small is still to come.

Bins that stay too empty, at the end of a split or because the bound closed them, are taken apart
and their pieces packed once more by the same method, over all splits together. These are a few bins
a split, so only their narrow rows are shuffled, into as many tasks as their number asks for.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import broadcast_within, stored
from fleetsight.llm.vocab import Memory, byte_letters, tokenizer, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Open bins of a task, the bound of its memory. A split of some 100 MB can reach it.
OPEN_BINS = 8_192
#: A sequence that leaves more than this share of its capacity free is packed once more.
LOOSE = 1 / 64
#: Pieces that one task packs in the second round.
PIECES_PER_TASK = 1 << 18
#: Id that ends every document.
END_ID = 0
_ROWS = 512
_TASK_BITS = 40

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


class OpenBins:
    """The bins that may still take something."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.begun = 0

    def _take(self, free: int) -> int:
        row = self.by_free[free]
        found = row.pop()
        if not row:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it for an item of 1 to ``capacity``."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.begun
            self.begun += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


# The white space that always ends a run, and this vocabulary's pieces among plain letters.
_RUNS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


@functools.cache
def _run_ids(path: str) -> Memory:
    """Ids of one run of non-space characters, as little-endian 32-bit numbers.

    This vocabulary drops white space, and white space ends every piece that it merges over, so a
    text's ids are those of its runs in a row. A run of plain letters, digits and signs is
    remembered by its pieces, of which there are far fewer; the rest is encoded whole.
    """
    encode = tokenizer(path).encode

    def whole(run: str) -> bytes:
        return array("I", encode(run, add_special_tokens=False).ids).tobytes()

    merge = tokenizer(path).model.tokenize

    letters = byte_letters()

    def one(piece: str) -> bytes:
        lettered = piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in merge(lettered)]).tobytes()

    piece_ids = Memory(one)

    def ids(run: str) -> bytes:
        if "<|" in run or not _PLAIN.fullmatch(run):
            return whole(run)
        return b"".join(map(piece_ids.__getitem__, _PLAIN_PIECES.findall(run.lower())))

    return Memory(ids)


def _pieces(path: str, capacity: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids_of = _run_ids(path)
    end = array("I", [END_ID]).tobytes()
    step = 4 * capacity
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            rows = ([], [], [], [], [])
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = b"".join(map(ids_of.__getitem__, _RUNS.findall(text or ""))) + end
                for piece, start in enumerate(range(0, len(ids), step)):
                    cut = ids[start:start + step]
                    for column, value in zip(rows, (doc_id, piece, start // 4, len(cut) // 4, zlib.crc32(cut))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def _packed(capacity: int, open_bins: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(capacity, open_bins)
    first = TaskContext.get().partitionId() << _TASK_BITS
    for batch in batches:
        placed = [bins.place(n) for n in batch.column("length").to_pylist()]
        numbers = pa.array([first + n for n, _ in placed], pa.int64())
        offsets = pa.array([at for _, at in placed], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers, offsets], names=[*batch.schema.names, "sequence_id", "offset"])


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only longer documents are cut."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(functools.partial(_pieces, path, capacity), _PIECES)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces, task by task."""
    falling = pieces.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    return falling.mapInArrow(functools.partial(_packed, capacity, open_bins), _PLACED)


def pack_loose_again(
    placed: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """``placed`` (a stored table of ``best_fit``) with the pieces of its loose sequences packed anew.

    New sequences have negative numbers. Full sequences keep their numbers and places.
    """
    free = capacity - F.sum("length")
    loose = stored(
        placed.groupBy("sequence_id").agg(free.alias("free"), F.count(F.lit(1)).alias("pieces"))
        .where(F.col("free") > capacity * LOOSE).select("sequence_id", "pieces")
    )
    pieces = loose.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0]
    chosen = broadcast_within(loose.select("sequence_id"), 16)
    # Dealt by number, not in turn, so that a task run again gets the same pieces.
    apart = placed.join(chosen, "sequence_id", "left_semi").repartition(-(-pieces // pieces_per_task) or 1, "sequence_id")
    anew = best_fit(apart.drop("sequence_id", "offset"), capacity, open_bins)
    return placed.join(chosen, "sequence_id", "left_anti").unionByName(
        anew.withColumn("sequence_id", -1 - F.col("sequence_id"))
    ).select(*placed.columns)


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str | None = None
) -> DataFrame:
    """Packs all documents (doc_id, text; other columns are ignored).

    Null and empty texts are the end id alone; texts longer than ``capacity`` are cut into pieces of
    that length, however long they are. A null doc_id stays null; repeated rows and repeated ids are
    packed each for itself. Pieces of equal length come by doc_id and piece. An empty table gives no
    rows. Sequence numbers are unique, not dense.
    """
    return pack_loose_again(stored(best_fit(document_pieces(docs, capacity, vocabulary), capacity, open_bins)), capacity, open_bins)

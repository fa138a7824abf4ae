"""Byte-level BPE of whole texts, with tree concatenation for long ones.

Short texts are encoded run by run: a run is white space with the word after it, and the vocabulary's
splitting never joins what such a boundary parts. Runs repeat, so most come from memory.

Long texts are cut into leaves of a fixed size, wherever that falls, and leaves are encoded in
parallel as rows of their own. Then neighbours are joined, pairwise, until one row is left. A join
re-encodes a window around the cut and grows it until both sides agree with it exactly:

* Splitting runs from left to right and looks only a few characters ahead. From a piece of the left side
  well before its end, the window is split and encoded anew; where one of its pieces begins at a
  place at which the right side has a beginning too, well before the window's end, everything from there
  on is as the right side has it.
* A piece can be long, text without any split. Where the cut lies inside one, the window is made of
  tokens on both sides of it: if encoding it gives its first and its last token unchanged, every adjacent
  pair in the joined row is one that the merges produce, and a row with that property is the encoding.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.vocab import Memory, byte_letters, tokenizer, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Code points of a leaf; longer texts are cut. A parameter.
LEAF = 16_384
_ROWS = 256
#: What splitting may look ahead, in pieces and bytes, with room for a special token.
_PIECES_BACK, _BYTES_BACK = 4, 48
_FIRST_WINDOW = 8
#: Pieces of more tokens are joined by windows of tokens.
_LONG_PIECE = 64
_RUN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# A run that splitting leaves whole, so that merges alone encode it.
_ONE_PIECE = re.compile(r" ?[A-Za-z]+")
# White space other than space and line feed, and what some count as such.
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


class Encoded:
    """Ids of a text, and which of them begin a piece."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray):
        self.ids, self.begins = ids, begins

    def cut(self, begin: int, end: int) -> Encoded:
        return Encoded(self.ids[begin:end], self.begins[begin:end])

    @staticmethod
    def row(*parts: Encoded) -> Encoded:
        return Encoded(np.concatenate([p.ids for p in parts]), np.concatenate([p.begins for p in parts]))


class Codec:
    """Encoding, joining and decoding with one vocabulary; one for each worker process."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        back = {letter: byte for byte, letter in letters.items()}
        self.letters = letters
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = special[i].encode() if i in special else bytes(back[ord(c)] for c in token)
        self.special = set(special)
        self.is_special = np.zeros(len(self.bytes_of), bool)
        self.is_special[list(special)] = True
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.decimals = [b"%d," % i for i in range(self.tokenizer.get_vocab_size())]
        self.runs = Memory(self._run)

    def _run(self, run: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as decimals with a comma after each, and the decoded bytes."""
        if _ONE_PIECE.fullmatch(run):
            ids = [t.id for t in self.model.tokenize(run.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        # What whole runs decode to are the bytes of their tokens.
        return len(ids), b"".join(map(self.decimals.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, ids_sha256 and decoded_sha256 of a short text."""
        runs = [text] if _OTHER_SPACE.search(text) else _RUN.findall(text)
        found = [self.runs[r] for r in runs]
        ids = b"".join([f[1] for f in found])[:-1]
        return (
            sum([f[0] for f in found]), hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(b"".join([f[2] for f in found])).hexdigest(),
        )

    def encode(self, text: str) -> Encoded:
        done = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(done.ids, dtype=np.uint32)
        if not len(ids):
            return Encoded(ids, np.zeros(0, bool))
        try:
            words = np.array(done.word_ids, dtype=np.int64)
        except TypeError:  # a special token has none
            words = np.array([-1 if w is None else w for w in done.word_ids])
        begins = np.ones(len(ids), bool)
        begins[1:] = words[1:] != words[:-1]
        # Special tokens are pieces of their own, and piece numbers begin anew after them.
        alone = self.is_special[ids]
        begins |= alone
        begins[1:] |= alone[:-1]
        return Encoded(ids, begins)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """ids_sha256 and decoded_sha256. What whole texts decode to are the bytes of their tokens."""
        numbers = ids.tolist()
        listed = b"".join(map(self.decimals.__getitem__, numbers))[:-1]
        return hashlib.sha256(listed).hexdigest(), hashlib.sha256(b"".join(map(self.bytes_of.__getitem__, numbers))).hexdigest()

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def _merge(self, data: bytes) -> np.ndarray:
        """Merges alone, of bytes that are one piece."""
        lettered = data.decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(lettered)], dtype=np.uint32)

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of the text of ``left`` followed by that of ``right``."""
        if not len(left.ids) or not len(right.ids):
            return left if len(left.ids) else right
        return self._join_inside(left, right) or self._join_pieces(left, right)

    def _join_inside(self, left: Encoded, right: Encoded) -> Encoded | None:
        """Joins within one long piece; None where the cut does not lie in one."""
        last = int(np.flatnonzero(left.begins)[-1])
        following = np.flatnonzero(right.begins[1:])
        first_end = int(following[0]) + 1 if len(following) else len(right.ids)
        if len(left.ids) - last + first_end < _LONG_PIECE or left.ids[-1] in self.special or right.ids[0] in self.special:
            return None
        # Is it one piece? The classes of a piece are uniform, so some characters on both sides tell.
        near = (self._bytes(left.ids[max(last, len(left.ids) - 24):])[-48:], self._bytes(right.ids[:min(first_end, 24)])[:48])
        around = near[0].decode(errors="ignore") + near[1].decode(errors="ignore")
        if "'" in around or "<|" in around or "|>" in around or any(c.isspace() for c in around):
            return None
        if int(self.encode(around).begins.sum()) != 1:
            return None
        k = m = _FIRST_WINDOW
        most_left, most_right = len(left.ids) - last, first_end
        while True:
            k, m = min(k, most_left), min(m, most_right)
            window = self._merge(self._bytes(left.ids[len(left.ids) - k:]) + self._bytes(right.ids[:m]))
            left_agrees = k == most_left or window[0] == left.ids[len(left.ids) - k]
            right_agrees = m == most_right or window[-1] == right.ids[m - 1]
            if left_agrees and right_agrees:
                begins = np.zeros(len(window), bool)
                begins[0] = k == most_left
                return Encoded.row(left.cut(0, len(left.ids) - k), Encoded(window, begins), right.cut(m, len(right.ids)))
            k, m = (k if left_agrees else 2 * k), (m if right_agrees else 2 * m)

    def _safe_back(self, side: Encoded) -> int:
        """Index of a piece so far before the end that nothing added there can change what stands before it."""
        begins = np.flatnonzero(side.begins)
        behind = self.sizes[side.ids[::-1]].cumsum()[::-1]
        for at in begins[::-1][_PIECES_BACK - 1:]:
            if behind[at] >= _BYTES_BACK:
                return int(at)
        return 0

    def _join_pieces(self, left: Encoded, right: Encoded) -> Encoded:
        start = self._safe_back(left)
        tail = self._bytes(left.ids[start:])
        begins = np.append(np.flatnonzero(right.begins), len(right.ids))
        places = np.append(0, self.sizes[right.ids].cumsum())  # byte offsets in the right side
        pieces = _FIRST_WINDOW
        while True:
            end = int(begins[min(pieces, len(begins) - 1)])
            data = tail + self._bytes(right.ids[:end])
            window = self.encode(data.decode())
            if end == len(right.ids):
                return Encoded.row(left.cut(0, start), window)
            # Places in the right side where the window has a piece that nothing behind it can change.
            sure = self._safe_back(window)
            offsets = np.append(0, self.sizes[window.ids].cumsum())[:-1] - len(tail)
            own = [i for i in np.flatnonzero(window.begins) if i < sure and offsets[i] >= 0]
            theirs = {int(places[b]): int(b) for b in begins[:-1] if b <= end}
            for i in own:
                if int(offsets[i]) in theirs:
                    return Encoded.row(left.cut(0, start), window.cut(0, int(i)), right.cut(theirs[int(offsets[i])], len(right.ids)))
            pieces *= 2

    def concatenate(self, parts: list[Encoded]) -> Encoded:
        """Joins neighbours, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else Encoded(np.zeros(0, np.uint32), np.zeros(0, bool))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    )


def _short(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = codec(path).digest
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield _batch([(d, *digest(t or "")) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])


def _leaves(path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            done = own.encode(texts[i].as_py())
            head = [c.slice(i, 1) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array([done.ids.tobytes()], pa.binary()), pa.array([np.packbits(done.begins).tobytes()], pa.binary())],
                names=[*batch.schema.names[:-1], "ids", "begins"],
            )


def _concatenated(path: str, table: pa.Table) -> pa.Table:
    """One document from its leaves."""
    own = codec(path)
    table = table.sort_by("leaf")
    parts = []
    for ids, begins in zip(table.column("ids").to_pylist(), table.column("begins").to_pylist()):
        numbers = np.frombuffer(ids, np.uint32)
        parts.append(Encoded(numbers, np.unpackbits(np.frombuffer(begins, np.uint8), count=len(numbers)).astype(bool)))
    whole = own.concatenate(parts).ids
    return pa.Table.from_batches([_batch([(table.column("doc_id")[0].as_py(), len(whole), *own.digests(whole))])])


def encode_documents(docs: DataFrame, leaf: int = LEAF, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``docs`` (doc_id, text).

    A null text counts as empty, which has no ids. Null and repeated ids get a row for each row; an
    empty table gives none. Only doc_id and text are read.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_text = F.char_length("text") > leaf
    short = narrow.where(~long_text).mapInArrow(functools.partial(_short, path), _DIGESTS)
    cut = (
        narrow.where(long_text)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .select(
            "row", "doc_id",
            F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))).alias("leaf", "text"),
        )
        .repartition("row", "leaf")  # the leaves of one document go to many tasks
        .mapInArrow(functools.partial(_leaves, path), "row long, doc_id long, leaf int, ids binary, begins binary")
    )

    def concatenated(table: pa.Table) -> pa.Table:
        return _concatenated(path, table)

    joined = cut.groupBy("row").applyInArrow(concatenated, _DIGESTS)
    return short.unionByName(joined)

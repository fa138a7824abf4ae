"""Framed binary spool files to payload rows.

A file is a run of frames, or such a run inside gzip or zstd layers. The reader tasks unpack the
files Spark hands them, one file at a time, and yield payload bytes; a broken file yields one row
with ``error`` and no payload, so it can be set aside without failing the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the frame format and its safety limits.
FRAME_MAGIC = 0x21544E53
ZSTD_MAGIC = 0xFD2FB528
GZIP_MAGIC = 0x8B1F
MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_DEPTH = 2
MAX_UNPACKED = 500 * 1024 * 1024
MAX_RATIO = 100
MAX_FRAMES = 100_000
MAX_FRAME_BYTES = 10 * 1024 * 1024

FRAMES_DDL = "source_file string, frame_no int, payload binary, checksum_ok boolean, error string"


class BadSpool(ValueError):
    """A spool file that breaks the format or a limit."""


def _inflate(data: bytes, limit: int) -> bytes:
    out, rest = [], data
    room = limit
    while rest:
        unpacker = zlib.decompressobj(wbits=31)
        try:
            out.append(unpacker.decompress(rest, room))
        except zlib.error as err:
            raise BadSpool(f"gzip: {err}") from err
        room -= len(out[-1])
        if room <= 0:
            raise BadSpool("content grows beyond the allowed size")
        if not unpacker.eof:
            raise BadSpool("gzip layer ends early")
        rest = unpacker.unused_data
    return b"".join(out)


def _unzstd(data: bytes, limit: int) -> bytes:
    try:
        import zstandard
    except ImportError as err:
        raise BadSpool("zstd support is not installed") from err
    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            plain = reader.read(limit)
    except zstandard.ZstdError as err:
        raise BadSpool(f"zstd: {err}") from err
    if len(plain) >= limit:
        raise BadSpool("content grows beyond the allowed size")
    return plain


def unpack(data: bytes, max_unpacked: int = MAX_UNPACKED, max_ratio: int = MAX_RATIO) -> bytes:
    """Content under the compression layers."""
    for depth in range(MAX_DEPTH + 2):
        if depth > MAX_DEPTH:
            raise BadSpool("too many compression layers")
        if not data:
            raise BadSpool("nothing to read")
        magic = struct.unpack("<I", data[:4])[0] if len(data) >= 4 else 0
        if magic == ZSTD_MAGIC:
            plain = _unzstd(data, max_unpacked)
        elif magic & 0xFFFF == GZIP_MAGIC:
            plain = _inflate(data, max_unpacked)
        else:
            return data
        if len(plain) // len(data) > max_ratio:
            raise BadSpool("content grows by too large a factor")
        data = plain
    raise BadSpool("too many compression layers")


def _uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadSpool("unreadable frame size")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _checksum(payload: bytes) -> int | None:
    try:
        import xxhash
    except ImportError:
        return None
    return xxhash.xxh64_intdigest(payload)


def frames(data: bytes) -> Iterator[tuple[bytes, bool | None]]:
    """(payload, checksum holds) per frame; the flag is None when the frame carries no checksum."""
    at = count = 0
    while at < len(data):
        if at + 12 > len(data):
            raise BadSpool("truncated frame header")
        magic, expected = struct.unpack_from("<IQ", data, at)
        if magic != FRAME_MAGIC:
            raise BadSpool(f"invalid frame magic 0x{magic:x}")
        length, at = _uvarint(data, at + 12)
        if length == 0:
            raise BadSpool("zero-length frame")
        if length > MAX_FRAME_BYTES:
            raise BadSpool("frame too large")
        payload = data[at : at + length]
        if len(payload) < length:
            raise BadSpool("truncated frame")
        at += length
        held = None
        if expected:
            actual = _checksum(payload)
            if actual is not None and actual != expected:
                raise BadSpool("frame checksum mismatch")
            held = None if actual is None else True
        count += 1
        if count > MAX_FRAMES:
            raise BadSpool("too many frames")
        yield payload, held
    if not count:
        raise BadSpool("no frames")


def _extract(max_file: int, max_unpacked: int, max_ratio: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source_file", "frame_no", "payload", "checksum_ok", "error"]
        for batch in batches:
            for path, length, content in zip(batch["path"], batch["length"], batch["content"]):
                try:
                    if length == 0:
                        raise BadSpool("file is empty")
                    if length > max_file:
                        raise BadSpool("file too large")
                    plain = unpack(bytes(content), max_unpacked, max_ratio)
                    rows = [(path, n, p, ok, None) for n, (p, ok) in enumerate(frames(plain))]
                except BadSpool as err:
                    rows = [(path, None, None, None, str(err))]
                out = pd.DataFrame(rows, columns=columns)
                out["frame_no"] = out["frame_no"].astype("Int32")
                out["checksum_ok"] = out["checksum_ok"].astype("boolean")
                yield out

    return run


def extract_frames(
    files: DataFrame,
    max_file_bytes: int = MAX_FILE_BYTES,
    max_unpacked: int = MAX_UNPACKED,
    max_ratio: int = MAX_RATIO,
) -> DataFrame:
    """Payload rows of files given as (path, length, content); broken files give one error row."""
    # An oversized file is refused by its length, without handing its bytes to the task.
    content = F.when(F.col("length") <= max_file_bytes, F.col("content"))
    return files.select("path", "length", content.alias("content")).mapInPandas(
        _extract(max_file_bytes, max_unpacked, max_ratio), FRAMES_DDL
    )


def read_frames(spark: SparkSession, path, **limits) -> tuple[DataFrame, DataFrame]:
    """(payload rows, rejected files) of framed spool files."""
    rows = extract_frames(spark.read.format("binaryFile").load(path), **limits)
    good = rows.where(F.col("error").isNull()).drop("error")
    bad = rows.where(F.col("error").isNotNull()).select("source_file", F.col("error").alias("reason"))
    return good, bad

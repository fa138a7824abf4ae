"""WARC archives of pages, and the capture index merged from their locally sorted runs.

Writing. A record is text as long as its payload is, so Spark's own text writer makes the archives on
any file system: one row per record, with the blank line that ends a record as line separator.
Equal payloads are stored once; the others are revisit records that name the response.

Reading. Archives hold a bounded number of records and bytes each and are read whole, one per row, and cut
by Content-Length; no payload can be taken for a record's end.

Index. Each archive gives a run of captures sorted by URL key and timestamp. The runs are dealt out by
ranges of (URL key, timestamp, number), so that a URL with a third of all captures is split by time,
and every task merges the sorted slices that it got with a loser tree: one comparison per level of
the tree for each capture. Tasks in order of their ranges are the global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import bind, broadcast_within, numbered, shared_folder, stored

#: Records in an archive of short pages. A parameter.
RECORDS_PER_FILE = 2000
#: Payloads up to so many bytes go to archives of 2000 or 32 records, longer ones to archives of their own, so that
#: an archive, which a reading task holds, has 256 MB, or one record.
SHORT_BYTES, MIDDLE_BYTES, MIDDLE_PER_FILE = 128 << 10, 8 << 20, 32
#: Bytes up to which shared digests are broadcast, so that payloads need no shuffle; and those of one.
BROADCAST_DIGESTS, _DIGEST_BYTES = 16 << 20, 96
_END = "\r\n\r\n"
# The alphabet of base-32 digests and names of the archive format.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST_CAPTURE = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp())

_RECORD = "page_id long, url string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()),
])


def payload_digest(payload: Column) -> Column:
    """Bare base-32 SHA-1 of a text's bytes: 32 digits of five bits, eight from each five bytes."""
    bits = F.sha1(payload.cast("binary"))
    digits = []
    for group in range(4):
        number = F.conv(F.substring(bits, 10 * group + 1, 10), 16, 10).cast("long")
        for place in range(8):
            digit = F.shiftright(number, 35 - 5 * place).bitwiseAND(31).cast("int")
            digits.append(F.substring(F.lit(_BASE32), digit + 1, F.lit(1)))
    return F.concat(*digits)


def _with_types(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds digest, size and, for revisits, the page whose record has the payload."""
    bare = numbered(pages).select(
        "row", F.col("whole.page_id").cast("long").alias("page_id"), F.col("whole.url").cast("string").alias("url"),
        F.coalesce(F.col("whole.html").cast("string"), F.lit("")).alias("html"), "whole.captured",
    ).withColumns({"payload_digest": payload_digest(F.col("html")), "payload_bytes": F.octet_length("html").cast("long")})
    # Of several rows with the largest id the first of the scan is the response; a null id is smaller than all.
    shared = stored(
        bare.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
        .agg(F.max(F.struct(F.col("page_id"), (-F.col("row")).alias("r"))).alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    same = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    is_revisit = F.col("best").isNotNull() & (F.col("row") != -F.col("best.r"))
    return bare.join(broadcast_within(shared, _DIGEST_BYTES, BROADCAST_DIGESTS), same, "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", "captured",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("best.page_id")).alias("refers_to"),
    )


def _header_value(value: Column) -> Column:
    """Percent-encodes what would end a header line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(captured: Column) -> Column:
    """The text of a record without the blank line at its end."""
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.format_string("<urn:page:%d>", "page_id")),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Date", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        line("WARC-Refers-To", F.when(revisit & F.col("refers_to").isNotNull(), F.format_string("<urn:page:%d>", "refers_to"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body,
    )


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, captured: Column | None = None, per_file: int = RECORDS_PER_FILE
) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Payloads of at least ``least_bytes`` are stored once, in the record of the largest page_id. A
    null html is an empty payload; a null page_id or url leaves its header out. Without ``captured``
    (a timestamp) the date counts seconds by page_id from a fixed day. Other columns are not read.
    """
    seconds = F.lit(_FIRST_CAPTURE) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 31))
    when = F.timestamp_seconds(seconds) if captured is None else captured
    typed = _with_types(pages.select("page_id", "url", "html", when.alias("captured")), least_bytes)
    size = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))
    longest = pages.agg(F.max(size)).first()[0] or 0
    classes = [(-1, SHORT_BYTES, per_file), (SHORT_BYTES, MIDDLE_BYTES, min(per_file, MIDDLE_PER_FILE)), (MIDDLE_BYTES, longest, 1)]
    for over, most, records in classes:
        if over < longest:
            some = typed.where((F.col("payload_bytes") > over) & (F.col("payload_bytes") <= most))
            rows = some.select(_record(F.col("captured")).alias("value"))
            rows.write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", records).text(folder)


_NUMBER = re.compile(r"<urn:page:(-?\d+)>")


def _number(value: str | None) -> int | None:
    found = _NUMBER.fullmatch(value or "")
    return int(found[1]) if found else None


def _records(archive: str, data: memoryview) -> Iterator[dict]:
    """The records of an archive; fails where one is cut short or malformed."""
    at, end = 0, len(data)
    whole = bytes(data)
    while at < end:
        stop = whole.find(b"\r\n\r\n", at)
        if not whole.startswith(b"WARC/", at) or stop < 0:
            raise ValueError(f"{archive}: no record at {at}")
        head = {}
        for line in whole[at:stop].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            head[name] = value
        body = stop + 4
        size = int(head["Content-Length"])
        if whole[body + size:body + size + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: record at {at} is cut short")
        payload = data[body:body + size]
        stored_digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response":
            length, digest = size, base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != stored_digest:
                raise ValueError(f"{archive}: the payload at {body} does not have its digest")
        else:
            length, digest = int(head["X-Payload-Length"]), stored_digest
        url = head.get("WARC-Target-URI")
        yield {
            "page_id": _number(head.get("WARC-Record-ID")),
            "url": None if url is None else url.replace("%0D", "\r").replace("%0A", "\n"),
            "captured": head["WARC-Date"], "record_type": head["WARC-Type"],
            "refers_to": _number(head.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest,
            "archive": archive, "offset": at, "length": body + size - at,
        }
        at = body + size + 4


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = memoryview(batch.column("content")[i].as_buffer())
            rows = list(_records(batch.column("path")[i].as_py(), data))
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record, with its place; the payloads of responses are checked against their digests."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read, _RECORD)


def url_key(url: Column) -> Column:
    """Host labels reversed, then the path, lower-cased: ``com,example,www)/a?b``. Null stays null."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), r":\d+$", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


class LoserTree:
    """Merges sorted sources: each inner node keeps the loser of its match, node 0 the winner."""

    def __init__(self, sources: Sequence[Iterator[tuple]]):
        self.sources = list(sources)
        self.width = max(1, len(self.sources))
        self.heads = [next(s, None) for s in self.sources] or [None]
        self.losers = [0] * self.width
        self.losers[0] = self._settle(1) if self.width > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _settle(self, node: int) -> int:
        """Plays the matches below a node; leaves are the nodes from ``width`` on."""
        if node >= self.width:
            return node - self.width
        left, right = self._settle(2 * node), self._settle(2 * node + 1)
        won = self._beats(left, right)
        self.losers[node] = right if won else left
        return left if won else right

    def __iter__(self) -> Iterator[tuple]:
        while True:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            node = (winner + self.width) // 2
            while node >= 1:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


_SORT = ("url_key", "captured", "page_id", "archive", "offset")


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sorted slices in a task's rows. Holds one range of the index, which the ranges bound."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table).combine_chunks()
    keys = list(zip(*[rows.column(c).to_pylist() for c in _SORT]))
    # Nulls come first, as in Spark's order.
    keys = [tuple((v is not None, v) if v is not None else (False,) for v in k) for k in keys]
    starts = [0] + [i for i in range(1, len(keys)) if keys[i] < keys[i - 1]] + [len(keys)]

    def run(begin: int, end: int) -> Iterator[tuple]:
        return ((keys[i], i) for i in range(begin, end))

    order = [i for _, i in LoserTree([run(a, b) for a, b in zip(starts, starts[1:])])]
    yield from rows.take(pa.array(order)).to_batches(max_chunksize=10_000)


def merged_index(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Captures in global order of URL key and timestamp, with each capture's place in its URL's range.

    Archives are the runs: each is sorted by itself, then slices of the runs meet by range.
    """
    runs = records.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*_SORT)
    columns = ["url_key", *_ARROW.names]
    dealt = (runs.repartitionByRange(ranges, *_SORT) if ranges else runs.repartitionByRange(*_SORT)).select(*columns)
    return dealt.mapInArrow(_merge, f"url_key string, {_RECORD}")


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and merges their index.

    One row per row of ``pages``, in global order of URL key and timestamp; equal rows are records of their
    own. A null html is an empty payload. A page of up to 2 GB is one archive. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    write_archives(pages, folder, least_bytes)
    return merged_index(stored(read_archives(spark, folder)))


_BITS = "list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0'))"
ORACLE_SQL = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, payload_bytes, h, array_to_string({_BITS}, '') AS bits FROM hashed
), coded AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(0, 32), lambda i:
    substr('{_BASE32}', 1 + list_sum(list_transform(range(1, 6), lambda j:
      (ascii(substr(bits, 5 * i + j, 1)) - 48) * (1 << (5 - j))))::INTEGER, 1)), '') AS payload_digest
  FROM digests
), best AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM coded
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM best
"""

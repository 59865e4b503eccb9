"""WARC archives with a two-level capture index.

Writing: every page is a record; Spark's text sink writes them, with CR LF CR LF between, into archive files under its
commit protocol, so lost tasks leave no broken archive. Of equal payloads one is a response, the others are
revisits of it without the payload.

Index: each archive is scanned once, record by record. Captures are ordered by reversed-host key and page over the
whole cluster; a range of the order is a shard, and each shard holds compressed blocks of ``BLOCK_LINES`` lines and
a sparse directory of their first keys. A lookup binary-searches the shards' first keys (a row for each shard), then
the shard's directory, then the block, and reads one byte range of one archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch
from .url_filter import host_of

BLOCK_LINES, SHARD_FILES = 1000, 50
#: Byte ranges of an archive that one task reads side by side.
READ_SPAN = 8 << 20
CRLF, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a payload."""
    digest = F.sha1(payload)
    chars = []
    for i in range(8):  # 20 bits are four letters
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substr(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def record_id(page: Column, url: Column) -> Column:
    """A URN that holds the page's id; for a null id one made of the url's hash."""
    h = F.lpad(F.lower(F.hex(F.coalesce(page, F.xxhash64(url)))), 16, "0")
    at = lambda a, n: F.substring(h, a, n)
    tail = F.when(page.isNull(), F.lit("00-ffffffffffff")).otherwise(F.lit("00-000000000000"))
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-4"), at(13, 3), F.lit("-8"), at(16, 1), tail, F.lit(">"))


def page_of(record: str) -> int | None:
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-4(\w{3})-8(\w)00-(\w{12})>", record)
    if not m or m[5] != "0" * 12:
        return None
    n = int(m[1] + m[2] + m[3] + m[4], 16)
    return n - (1 << 64) if n >> 63 else n


def surt(url: Column) -> Column:
    """Reversed-host key of a url, such as ``org,example,www)/a?b``; empty for a null url."""
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(host, F.lit(")"), rest), F.lit(""))


def target(url: Column) -> Column:
    """A url as a header can hold it and as the index keys it: each run of ASCII control characters and spaces is ``%20``."""
    return F.regexp_replace(url.cast("string"), r"[\x00-\x20\x7F]+", "%20")


def page_key(page: Column) -> Column:
    """Page ids as text in their order; empty for null."""
    return F.coalesce(F.lpad(F.hex(page.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"), F.lit(""))


def write_archives(pages: DataFrame, scratch: Scratch, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, records: int = 20_000) -> str:
    """Writes (page_id, url, html) as archives of at most ``records`` records and returns their folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digests = scratch.table(rows.select("page_id", F.octet_length("html").cast("long").alias("n"), base32_sha1(F.col("html")).alias("digest")))
    again = digests.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = scratch.table(again.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    revisits = scratch.table(again.join(first, "digest").where("page_id <> first").select("page_id", "first").distinct())
    # the page's own id joins, not its digest: no key is frequent; few revisits are broadcast by their files' size
    rows = rows.join(revisits, "page_id", "left").withColumn("digest", base32_sha1(F.col("html")))
    revisit = F.col("first").isNotNull()
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = target(F.col("url"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first"), F.lit(""))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    path = scratch.path()
    rows.select(F.concat(header, F.lit(CRLF), block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)
    return path


def _open(uri: str, stream: bool):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.open_input_stream(path, buffer_size=1 << 20) if stream else fs.open_input_file(path)


def _headers(raw: bytes) -> dict[str, str]:
    """Values by lower-case names. Only spaces and tabs around a value are no part of it; a url may begin or end with other white space."""
    return {k.lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split(CRLF)[1:])}


def scan(files: DataFrame) -> DataFrame:
    """(uri, page_id, file, offset, length) of every record in archives (path); reads each once, a buffer at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("path").to_pylist():
                rows, offset, held = [], 0, b""
                with _open(file, True) as f:
                    while True:
                        while END.encode() not in held and (more := f.read(1 << 16)):
                            held += more
                        head, found, rest = held.partition(END.encode())
                        if not found:
                            break
                        h = _headers(head)
                        size = int(h["content-length"]) + 4
                        length = len(head) + 4 + size
                        if len(rest) >= size:
                            held = rest[size:]
                        else:
                            left = size - len(rest)
                            while left and (more := f.read(min(left, 1 << 20))):  # the block itself is not kept
                                left -= len(more)
                            held = b""
                        rows.append((h.get("warc-target-uri"), page_of(h["warc-record-id"]), file, offset, length))
                        offset += length
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["uri", "page_id", "file", "offset", "length"])

    return files.mapInArrow(run, "uri string, page_id long, file string, offset long, length long")


class CaptureIndex:
    """Blocks of captures in key order, by shard, and the first key of each shard."""

    def __init__(self, blocks: DataFrame, first: list[tuple[bytes, bytes, int]]):
        self.blocks, self.first = blocks, first

    @classmethod
    def build(cls, archives: str, spark: SparkSession, scratch: Scratch) -> CaptureIndex:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).select("path")
        # shards follow the captures: those of ``SHARD_FILES`` archives make one
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // SHARD_FILES))
        files = files.repartition(parts)
        lines = scan(files).select(surt(F.col("uri")).alias("key"), page_key(F.col("page_id")).alias("page"), "file", "offset", "length")
        order = ["key", "page", "file", "offset"]
        lines = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def block(rows: list[tuple]) -> tuple:
                data = "\n".join("\t".join(map(str, r[:5])) for r in rows)
                return rows[0][5], rows[0][0], rows[0][1], zlib.compress(data.encode())

            for b in batches:
                held += zip(*(c.to_pylist() for c in b.columns), strict=True)
                out = []
                while len(held) >= BLOCK_LINES:
                    out.append(block(held[:BLOCK_LINES]))
                    held = held[BLOCK_LINES:]
                yield made(out)
            yield made([block(held)] if held else [])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["shard", "key", "page", "lines"])

        blocks = scratch.table(lines.select(*order, "length", "shard").mapInArrow(compress, "shard int, key string, page string, lines binary"))
        first = blocks.groupBy("shard").agg(F.min(F.struct("key", "page")).alias("f")).select("f.key", "f.page", "shard").collect()  # a row for each shard
        # Spark orders text by its UTF-8 bytes
        return cls(blocks, sorted(((r["key"].encode(), r["page"].encode(), r["shard"]) for r in first)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """(file, offset, length) of every capture of the distinct (key, page) of ``wanted``."""
        first = [x[:2] for x in self.first]
        shards = [x[2] for x in self.first]

        def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                # equal (key, page) may lie on both sides of a shard's edge
                rows = []
                for k, p in keys:
                    at = (k.encode(), p.encode())
                    i = bisect_right(first, at) - 1
                    while i >= 0:
                        rows.append((k, p, shards[i]))
                        if first[i] != at:
                            break
                        i -= 1
                cols = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["key", "page", "shard"])

        def find(blocks: pa.Table, want: pa.Table) -> pa.Table:
            out: list[tuple[str, int, int]] = []
            if len(blocks) and len(want):
                rows = sorted(zip([k.encode() for k in blocks["key"].to_pylist()], [p.encode() for p in blocks["page"].to_pylist()], blocks["lines"].to_pylist(), strict=True), key=lambda r: r[:2])
                directory = [r[:2] for r in rows]
                opened, lines, keys = -1, [], []
                for at in sorted(zip((k.encode() for k in want["key"].to_pylist()), (p.encode() for p in want["page"].to_pylist()), strict=True)):
                    n = max(0, bisect_right(directory, at) - 1)
                    while n > 0 and directory[n] == at:
                        n -= 1
                    while n < len(rows) and directory[n] <= at:
                        if n != opened:
                            opened = n
                            lines = [x.split(b"\t") for x in zlib.decompress(rows[n][2]).split(b"\n")]
                            keys = [(x[0], x[1]) for x in lines]
                        i = bisect_right(keys, at) - 1
                        while i >= 0 and keys[i] == at:
                            out.append((lines[i][2].decode(), int(lines[i][3]), int(lines[i][4])))
                            i -= 1
                        n += 1
            cols = list(zip(*out, strict=True)) or [[]] * 3
            return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

        dealt = wanted.select("key", "page").distinct().mapInArrow(to_shard, "key string, page string, shard int")
        return self.blocks.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(find, "file string, offset long, length long")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(places: DataFrame, payload: bool = True) -> DataFrame:
    """Records at (file, offset, length) by range reads; a response's digest is that of the payload read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    if file != name:
                        name, f = file, _open(file, False)
                    f.seek(offset)
                    head, _, rest = f.read(length).partition(END.encode())
                    h = _headers(head)
                    http, _, body = rest[: int(h["content-length"])].partition(END.encode())
                    revisit = h["warc-type"] == "revisit"
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (made := base64.b32encode(hashlib.sha1(body).digest()).decode()) != digest:
                        raise ValueError(f"{file} at {offset}: the payload's digest is {made}, its header has {digest}")
                    size = int(_headers(http)["content-length"]) if revisit else len(body)
                    rows.append((page_of(h["warc-record-id"]), size, digest, h["warc-type"], page_of(h["warc-refers-to"]) if revisit else None, body if payload and not revisit else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.floor(F.col("offset") / READ_SPAN)
    near = places.select("file", "offset", "length").repartition(parts, "file", span).sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, RECORD)


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written and read back by the index.

    Null html is an empty payload; a null url has no target and an empty key; a null page_id is always a response. Rows
    that share page_id and payload are responses each. An empty table gives an empty result. Other columns are not read.
    Payloads are equal if their SHA-1 digests are. A page that the index does not find is an error, never a missing row.
    """
    scratch = Scratch(spark, "warc")
    archives = write_archives(pages, scratch, min_bytes=min_bytes)
    index = CaptureIndex.build(archives, spark, scratch)
    wanted = pages.select(surt(target(F.col("url"))).alias("key"), page_key(F.col("page_id").cast("long")).alias("page"))
    places = scratch.table(index.lookup(wanted))
    found, want = places.count(), pages.count()
    if found != want:
        raise ValueError(f"{want} pages were written and the index finds {found}")
    return read_records(places, payload=False).drop("payload")

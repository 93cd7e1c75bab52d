"""WARC (operator 10): capture archives with a two-level index.

Archives are ``.warc.gz`` files of one gzip member per record, written by the tasks
into the folder that all executors share (any store that pyarrow.fs opens by URI).
A task names its files at random and lists them in its result, so files of lost or
repeated attempts are never read. Of records with equal payloads the one with the
largest page_id is a response; the others are revisits, of headers only.

Payloads are digested where they are scanned; groups are found by digests, ids and URLs
alone. What a task needs to tell a record's kind is broadcast: all groups of two or more
where they are few, else the largest ones and a bitmap of the others' digests. Only
records whose digest is in that bitmap meet their group in a shuffle; all others are
written by the task that scanned them, so empty and boilerplate payloads, and single
ones, never move.

The index is sorted by reversed-host URL key (``com,example)/path``) and cut into
ranges of keys, one file each (as many as shuffle partitions), and these into compressed
blocks. Beside each file lies its directory: a line for each block, with its first and
last key and where it lies, and the places of the lines. A lookup binary-searches the
ranges, then the directory's lines by reads of a few bytes, reads the byte ranges of the
blocks that can hold the key, binary-searches these, and reads the records' ranges.
Reading everything back goes the same way: blocks, then the records they point to.

An archive begins with a warcinfo record. Record ids come from the archive's name and
the record's place, so repeated rows have different ones; a revisit names the response
by WARC-Refers-To-Target-URI and -Date (its record id is not known yet).

Defined results: a null payload counts as empty; empty payloads are equal to each
other; a null URL has the empty key; a null page_id stays null, never beats another one,
and in a group with only null ids all are responses; repeated rows with the largest
page_id are all responses; payloads of any length are written whole; an empty table gives no
archives and an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder, own, partitions, read, store, temporary

#: Uncompressed bytes after which a task begins another archive; entries of an index block.
ARCHIVE_BYTES, BLOCK_ENTRIES, GZIP_LEVEL = 64 << 20, 1000, 1
DIRECTORY_SUFFIX = ".directory"
#: Bytes of groups that are broadcast as they are. Beyond, groups of more than this part of the grouped rows are, if their URL has not more bytes.
FEW_BYTES, LARGE_PART, URL_BYTES = 32 << 20, 4096, 8192
#: Bits of the bitmap of the other groups' digests (4 MB), in rows of 32,768.
BITMAP_BITS = 25
ID, URL, BODY, KEY, KEEP, KEEP_URL, BIT, BUCKET, BITS, ROWS, FOUND = (own(c) for c in ("id", "url", "body", "key", "keep", "keep_url", "bit", "bucket", "bits", "rows", "found"))
DATE = "1970-01-01T00:00:00Z"
WRITTEN = "surt string, page_id string, archive string, offset long, length long"
DIRECTORY = "first string, last string, file string, offset long, length long, entries long"


def surt(url: str | None) -> str:
    """Reversed host, port, path and query: http://m.example.com:80/a?b gives com,example,m)/a?b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip() if "//" in url else "//" + url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    shown = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + shown + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(headers: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *headers, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(archive: str, offset: int) -> str:
    return f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{offset}')}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def warcinfo(archive: str) -> bytes:
    """The first record of an archive."""
    return _record(["WARC-Type: warcinfo", _record_id(archive, 0), f"WARC-Date: {DATE}", f"WARC-Filename: {archive}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record(page_id: str | None, url: str, payload: bytes, refers_to: str | None, refers_to_url: str = "", archive: str = "", offset: int = 0) -> bytes:
    """A WARC/1.1 response record, or a revisit of identical payload with its HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [f"WARC-Type: {'revisit' if revisit else 'response'}", _record_id(archive, offset), f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_line(refers_to_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    if page_id is not None:
        headers.append(f"X-Page-ID: {page_id}")
    return _record(headers, http if revisit else http + payload)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:]), payload


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """records: ID (string), URL, BODY (binary), KEEP and KEEP_URL (the id and URL that a revisit refers to). The entries written, as WRITTEN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        out, name, at, full = None, "", 0, 0
        for batch in batches:
            entries = []
            for page_id, url, body, refers_to, refers_to_url in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None or full >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, full = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    head = _gzip(warcinfo(name))
                    out.write(head)
                    at = len(head)
                made = record(page_id.as_py(), url.as_py() or "", body.as_py() or b"", refers_to.as_py(), refers_to_url.as_py() or "", name, at)
                packed = _gzip(made)
                out.write(packed)
                entries.append((surt(url.as_py()), page_id.as_py(), name, at, len(packed)))
                at, full = at + len(packed), full + len(made)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], kind) for i, kind in enumerate(kinds)], names=["surt", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return records.select(ID, URL, BODY, KEEP, KEEP_URL).mapInArrow(run, WRITTEN)


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Sort entries by key into compressed blocks, a file and its directory for each range of keys; the blocks, as DIRECTORY."""
    spark = entries.sparkSession
    ordered = entries.repartitionByRange(partitions(spark), "surt", "archive", "offset").sortWithinPartitions("surt", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        name, at, held, rows = f"{uuid.uuid4().hex}.idx.gz", 0, [], []
        out = None

        def flush() -> None:
            nonlocal at, out
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            packed = _gzip("".join("\t".join(line) + "\n" for line in held).encode())
            out.write(packed)
            rows.append((held[0][0], held[-1][0], name, at, len(packed), len(held)))
            at += len(packed)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(["" if x is None else re.sub(r"[\t\n]", " ", str(x)) for x in (x.as_py() for x in row)])
                if len(held) >= BLOCK_ENTRIES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{path}/{name}{DIRECTORY_SUFFIX}", compression=None) as directory:
                directory.write(packed_directory(rows))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["first", "last", "file", "offset", "length", "entries"])

    return ordered.mapInArrow(run, DIRECTORY)


def packed_directory(rows: list[tuple]) -> bytes:
    """Lines of first and last key, offset and length of blocks, in order; then where each line starts and where the last one ends, and how many there are, 8 bytes each."""
    lines = ["\t".join((first, last, str(offset), str(length))).encode() for first, last, _, offset, length, _ in rows]
    starts = [0, *accumulate(len(line) for line in lines)]
    return b"".join(lines) + b"".join(n.to_bytes(8, "little") for n in [*starts, len(lines)])


class PackedDirectory:
    """The blocks of a directory file, each found by reading its own line only."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        self.count = int.from_bytes(file.read_at(8, size - 8), "little")
        self.places = size - 8 * (self.count + 2)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> tuple[str, str, int, int]:
        """First and last key, offset and length of block i."""
        at = self.file.read_at(16, self.places + 8 * i)
        start, end = int.from_bytes(at[:8], "little"), int.from_bytes(at[8:], "little")
        first, last, offset, length = self.file.read_at(end - start, start).decode().split("\t")
        return first, last, int(offset), int(length)


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    fs, path = store(folder)
    with fs.open_input_file(f"{path}/{name}") as file:
        file.seek(offset)
        return file.read(length)


def read_blocks(directory: DataFrame, folder: str) -> DataFrame:
    """The entries of all blocks, by range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = zlib.decompress(read_range(folder, row["file"], row["offset"], row["length"]), 31).decode().split("\n")[:-1]
                cut = [line.split("\t") for line in lines]
                columns = [pa.array([c[i] if i < 3 else int(c[i]) for c in cut], pa.string() if i < 3 else pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["surt", "page_id", "archive", "offset", "length"])

    return directory.mapInArrow(run, WRITTEN)


def read_records(entries: DataFrame, folder: str) -> DataFrame:
    """Records by range reads, an archive's in the order they lie in."""
    spark = entries.sparkSession
    placed = entries.select("archive", "offset", "length").repartition(partitions(spark), "archive", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("archive", "offset")
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        name, file = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(start, 256).to_pylist():
                    if row["archive"] != name:
                        if file is not None:
                            file.close()
                        name, file = row["archive"], fs.open_input_file(f"{path}/{row['archive']}")
                    file.seek(row["offset"])
                    warc, http, payload = parse(zlib.decompress(file.read(row["length"]), 31))
                    kind, told = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http["Content-Length"])
                    if kind == "response" and (digest(payload) != told or len(payload) != size):
                        raise ValueError(f"record at {name}:{row['offset']} does not match its digest")
                    rows.append((warc.get("X-Page-ID"), warc["WARC-Target-URI"], kind, size, told, warc.get("X-Refers-To-Page-ID"), payload))
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])
        if file is not None:
            file.close()

    return placed.mapInArrow(run, schema)


class Captures:
    """Archives and their index in one folder."""

    def __init__(self, folder: str, directory: DataFrame):
        self.folder, self.directory = folder, directory
        self.ranges: list[tuple[str, str, str]] | None = None

    def records(self) -> DataFrame:
        return read_records(read_blocks(self.directory, self.folder), self.folder)

    def _blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that can hold the key."""
        if self.ranges is None:  # one row for each shuffle partition at most
            self.ranges = sorted(map(tuple, self.directory.groupBy("file").agg(F.min("first"), F.max("last")).select("max(last)", "min(first)", "file").collect()))
        fs, path = store(self.folder)
        for last, first, name in self.ranges[bisect.bisect_left(self.ranges, key, key=lambda r: r[0]) :]:
            if first > key:
                return
            with fs.open_input_file(f"{path}/{name}{DIRECTORY_SUFFIX}") as file:
                packed = PackedDirectory(file)
                for i in range(bisect.bisect_left(packed, key, key=lambda block: block[1]), len(packed)):
                    first, _, offset, length = packed[i]
                    if first > key:
                        return
                    yield name, offset, length

    def lookup(self, url: str) -> Iterator[dict]:
        """The captures of one URL one by one, from one block at a time; a revisit has no payload of its own."""
        key, of = surt(url), lambda line: line.split("\t", 1)[0]
        for name, offset, length in self._blocks(key):
            lines = zlib.decompress(read_range(self.folder, name, offset, length), 31).decode().split("\n")[:-1]
            for line in lines[bisect.bisect_left(lines, key, key=of) : bisect.bisect_right(lines, key, key=of)]:
                _, _, archive, start, size = line.split("\t")
                warc, http, payload = parse(zlib.decompress(read_range(self.folder, archive, int(start), int(size)), 31))
                yield {"page_id": warc.get("X-Page-ID"), "url": warc["WARC-Target-URI"], "record_type": warc["WARC-Type"], "payload": payload, "refers_to": warc.get("X-Refers-To-Page-ID")}


def _cell(key: str) -> Column:
    """The bit of a digest, from 1."""
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)) + 1


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (with KEY) and the KEEP and KEEP_URL of their group; groups is a written table with a row and its ROWS for each digest of two rows or more.

    Only rows whose digest may be that of a group that is not broadcast move.
    """
    size = groups.agg(F.sum(F.octet_length(KEY) + F.coalesce(F.octet_length(KEEP_URL), F.lit(0)) + 32)).first()[0] or 0
    if size <= FEW_BYTES:
        return rows.join(F.broadcast(groups.drop(ROWS)), KEY, "left")
    placed = groups.join(F.broadcast(groups.agg(F.sum(ROWS).alias("grouped"))))
    # Fewer than LARGE_PART rows, of URL_BYTES at most.
    is_large = (F.col(ROWS) * LARGE_PART > F.col("grouped")) & (F.coalesce(F.octet_length(KEEP_URL), F.lit(0)) <= URL_BYTES)
    large = placed.where(is_large).select(KEY, KEEP, KEEP_URL, F.lit(True).alias(FOUND))
    others = placed.where(~is_large).select(KEY, KEEP, KEEP_URL)
    cell = {BUCKET: F.bitmap_bucket_number(_cell(KEY)), BIT: F.bitmap_bit_position(_cell(KEY))}
    bitmap = others.withColumns(cell).groupBy(BUCKET).agg(F.bitmap_construct_agg(BIT).alias(BITS))
    looked = rows.join(F.broadcast(large), KEY, "left").withColumns(cell).join(F.broadcast(bitmap), BUCKET, "left")
    byte = F.conv(F.hex(F.substring(BITS, F.floor(F.col(BIT) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.pmod(BIT, F.lit(8)))) % 2 == 1
    meets = F.col(FOUND).isNull() & F.coalesce(is_set, F.lit(False))
    moved = looked.where(meets).select(*rows.columns).join(others, KEY, "left")
    return looked.where(~meets).select(*rows.columns, KEEP, KEEP_URL).unionByName(moved)


def capture(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", folder: str | None = None) -> Captures:
    """Write pages' records and their index."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias(ID), F.col(url_col).alias(URL), body.alias(BODY))
    rows = rows.withColumn(KEY, F.concat_ws(":", F.sha2(BODY, 256), F.octet_length(BODY)))
    counted = rows.groupBy(KEY).agg(F.max(F.struct(ID, URL)).alias(KEEP), F.count(F.lit(1)).alias(ROWS))
    refers = F.when(F.col(KEEP).isNotNull() & ~F.col(ID).eqNullSafe(F.col(KEEP)), F.col(KEEP)).cast("string")
    with temporary():
        groups = materialise(counted.where(F.col(ROWS) > 1).select(KEY, F.col(f"{KEEP}.{URL}").alias(KEEP_URL), F.col(f"{KEEP}.{ID}").alias(KEEP), ROWS), "payloads")
        records = with_groups(rows, groups).select(F.col(ID).cast("string").alias(ID), URL, BODY, refers.alias(KEEP), KEEP_URL)
        entries = materialise(write_archives(records, folder), "entries")
        directory = materialise(write_index(entries, folder + "/index"), "directory", keep=True)
    return Captures(folder, directory.withColumn("file", F.concat(F.lit("index/"), F.col("file"))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = capture(pages).records()
    as_id: Column = F.when(F.col("page_id") != "", F.col("page_id")).cast("long")
    return found.select(as_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op10_warc": op10_warc}
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLES = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, body, sha1(body) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, body,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}',
           CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM d
), k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keep FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k
""",
}

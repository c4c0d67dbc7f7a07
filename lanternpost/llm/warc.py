"""WARC archives: monolithic gzip files, a normaliser to one gzip member a record, random reads by index.

``write_archives`` turns rows into records and writes each task's records as one gzip stream through
Spark's text writer, so that its commit protocol holds.  A payload that occurs again is a ``revisit``
of the row with the largest id.  ``normalise`` inflates every such file once, front to back, writes
each record as its own gzip member and beside the archive a sidecar with the offset of every record.
``read_records`` reads members by offset, so one large archive is many tasks.

A task that runs again writes files of another name; only those in the manifest count.  A task holds
one record and one block of lines or members at a time.

Null payloads are empty, a null url is empty, control characters in urls become blanks, a null id is
written as none.  Rows that share the largest id of a payload are all responses, as are rows without
any id.  Equal payloads are those of equal SHA-1, length and a second hash.  An empty table gives
empty archives, no members and no records.  A file that ends inside a record, or a record whose
length does not fit, is an error.  Other columns are not read.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from .helpers import BLOCK_BYTES

# Fixed values of the formats.
END = "\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"

DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
READ_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"
MANIFEST = "source string, archive string, n_records long, n_bytes long"
RECORDS = (
    "archive string, offset long, length long, record_id string, record_type string, target string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each character is five bits out of two neighbouring digits."""

    def character(i: int) -> Column:
        at, skip = divmod(5 * i, 4)
        pair = F.conv(F.substring(digest, at + 1, 2), 16, 10).cast("int")
        five = F.shiftright(pair, 8 - 5 - skip).bitwiseAND(F.lit(31))
        return F.substr(F.lit(BASE32), five + 1, F.lit(1))

    return F.concat(*[character(i) for i in range(32)])


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _record(id_: Column, target: Column, digest: Column, size: Column, payload: Column, refers: Column, revisit: Column) -> Column:
    """Header and block of a record; the writer's line end closes it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(RECORD_END))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    length = F.octet_length(http) + F.octet_length(body)
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.url_encode(F.coalesce(c.cast("string"), F.lit(""))), F.lit(">"))
    refer = F.concat(F.lit(f"{END}WARC-Profile: {IDENTICAL}{END}WARC-Refers-To: "), urn(refers))
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "),
        urn(id_),
        F.lit(f"{END}WARC-Date: {DATE}{END}WARC-Target-URI: "),
        F.regexp_replace(F.coalesce(target, F.lit("")), r"[\x00-\x1F\x7F]", " "),
        F.when(revisit, refer).otherwise(""),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"),
        digest,
        F.lit(f"{END}Content-Type: application/http;msgtype=response{END}Content-Length: "),
        length.cast("string"),
        F.lit(RECORD_END),
        http,
        body,
    )


def write_archives(rows: DataFrame, id_: str, url: str, payload: str, folder: str, *, min_bytes: int = 0) -> None:
    """One monolithic gzip file of records a task.

    Payloads of ``min_bytes`` or more that occur again are revisits.  Only keys of repeated payloads
    are stored and joined; Spark broadcasts them if their files are small, and else splits a hot key.
    """
    said = rows.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    keyed = said.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("second"))
    key = ["sha", "size", "second"]
    repeated = keyed.where(F.col("size") >= min_bytes).groupBy(*key).agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 AND kept IS NOT NULL")
    repeated = storage.stored(repeated.select(*key, "kept"), "repeated")
    marked = keyed.join(repeated, key, "left")
    revisit = F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    value = _record(F.col("id"), F.col("url"), base32_of_hex(F.col("sha")), F.col("size"), F.col("payload"), F.col("kept"), revisit)
    marked.select(value.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; the first line is left out."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, mark, value = line.partition(b":")
        if mark:
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields


class RecordFold:
    """Records out of the lines of one inflated file, given in blocks; holds one record at most."""

    def __init__(self) -> None:
        self.head: list[bytes] = []
        self.body: list[bytes] | None = None
        self.need = 0

    def records(self, lines: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(header, whole record) of each record that ends in these lines."""
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        at = 0
        while at < len(lines):
            if self.body is None:
                line = lines[at]
                at += 1
                if not self.head and line in (b"\r", b""):
                    continue
                self.head.append(line)
                if line not in (b"\r", b""):
                    continue
                if not self.head[0].startswith(b"WARC/"):
                    raise ValueError(f"not a record: {self.head[0][:80]!r}")
                self.need = int(header_fields(b"\n".join(self.head)).get("content-length", 0)) + len(RECORD_END)
                self.body = []
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + self.need)) + 1
            part = lines[at:stop]
            self.body.extend(part)
            self.need -= sum(map(len, part)) + len(part)
            at += len(part)
            if self.need <= 0:
                yield self._closed()

    def _closed(self) -> tuple[bytes, bytes]:
        if self.need < 0:
            raise ValueError(f"a record is longer than it says: {self.head[0][:80]!r}")
        head = b"\n".join(self.head) + b"\n"
        body = b"\n".join(self.body)
        self.head, self.body = [], None
        return head, head + body + b"\n"

    def last(self) -> Iterator[tuple[bytes, bytes]]:
        """The record that the file's end closes, if its block is whole."""
        if self.body is None:
            if self.head:
                raise ValueError("the file ends inside a header")
            return
        if self.need > len(RECORD_END):
            raise ValueError("the file ends inside a record")
        self.need = 0
        head, whole = self._closed()
        length = int(header_fields(head).get("content-length", 0))
        yield head, whole[: len(head) + length] + RECORD_END.encode()


class MemberWriter:
    """An archive of one gzip member a record, and its sidecar index."""

    def __init__(self, folder: str, source: str) -> None:
        self.files, base = _open(folder)
        self.files.create_dir(base, recursive=True)
        stem = source.rsplit("/", 1)[-1].split(".")[0]
        self.source, self.name = source, f"{stem}-{uuid.uuid4().hex[:12]}.warc.gz"
        self.path = f"{base}/{self.name}"
        self.archive = self.files.open_output_stream(self.path, compression=None)
        self.index = self.files.open_output_stream(f"{self.path}.idx", compression=None)
        self.offset = self.count = 0

    def add(self, head: bytes, record: bytes) -> None:
        member = gzip.compress(record, LEVEL, mtime=0)
        self.archive.write(member)
        fields = header_fields(head)
        row = {
            "archive": self.name, "offset": self.offset, "length": len(member),
            "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
        }
        self.index.write(json.dumps(row).encode() + b"\n")
        self.offset += len(member)
        self.count += 1

    def close(self) -> pa.RecordBatch:
        self.archive.close()
        self.index.close()
        row = [self.source, self.name, self.count, self.offset]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["source", "archive", "n_records", "n_bytes"])


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite the gzip or plain archives in ``source`` into ``folder``; returns the manifest.

    Spark's reader inflates each file as one stream, wherever it lies; a file is one task.
    """
    lines = spark.read.option("lineSep", "\n").text(source)
    first = F.when(F.startswith("value", F.lit("WARC/")), F.col("_metadata.file_path"))
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), first.alias("source"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, fold = None, None, RecordFold()

        def finished() -> Iterator[pa.RecordBatch]:
            if writer is not None:
                for record in fold.last():
                    writer.add(*record)
                yield writer.close()

        for batch in batches:
            files = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if files[a] != now:
                    yield from finished()
                    named = batch.column("source").slice(a, b - a).drop_null()
                    now, fold = files[a], RecordFold()
                    writer = MemberWriter(folder, named[0].as_py() if len(named) else "unnamed")
                for record in fold.records(batch.column("line").slice(a, b - a).to_pylist()):
                    writer.add(*record)
        yield from finished()

    lines.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar rows of all archives that the manifest lists."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("archive")
    rows = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)
    return rows.join(manifest, "archive", "left_semi")


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(RECORD_END.encode())
    fields = header_fields(head)
    block = block[: int(fields.get("content-length", 0))]
    named = lambda name: fields[name].strip("<>").removeprefix(URN) if name in fields else None
    kind, size, payload = fields.get("warc-type"), len(block), block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(RECORD_END.encode())
        size = int(header_fields(http).get("content-length", len(payload)))
    return (
        named("warc-record-id"), kind, fields.get("warc-target-uri"), named("warc-refers-to"),
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, size, None if kind == "revisit" else payload,
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the normalised archives, read by offset in ranges of an archive."""
    index = offsets(spark, folder).select("archive", "offset", "length")
    part = F.floor(F.col("offset") / RANGE_BYTES)
    # The rows to shuffle are tiny and what they make a task read is not, so the number of tasks follows the bytes.
    held = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    ranges = index.repartition(2 * (held // RANGE_BYTES) + 1, F.col("archive"), part).sortWithinPartitions("archive", "offset")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name, handle, rows, held = None, None, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            archive, start, length = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            at = 0
            while at < len(start):
                stop = at + 1
                while stop < len(start) and archive[stop] == archive[at] and start[stop] == start[stop - 1] + length[stop - 1] and start[stop] + length[stop] - start[at] <= READ_BYTES:
                    stop += 1
                if archive[at] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = archive[at], files.open_input_file(f"{base}/{archive[at]}")
                data = handle.read_at(start[stop - 1] + length[stop - 1] - start[at], start[at])
                for k in range(at, stop):
                    shift = start[k] - start[at]
                    rows.append((archive[k], start[k], length[k], *_parsed(zlib.decompress(data[shift : shift + length[k]], 31))))
                    held += len(rows[-1][-1] or b"")
                    if held >= BLOCK_BYTES:
                        yield block()
                        rows, held = [], 0
                at = stop
        if rows:
            yield block()
        if handle is not None:
            handle.close()

    return ranges.mapInArrow(run, RECORDS)

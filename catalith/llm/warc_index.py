"""WARC archives with a two-level capture index.

Archives hold a gzip member for each record, written by tasks in place.  The
index has a line for each capture, sorted by one text of reversed-host URL key
and page, in compressed blocks; an index file ends with its sparse directory,
the first text of each block.  A reader binary-searches the index files, then a
file's directory, reads one block by range, then one record by range.  Files,
directories, blocks and searches all use that one text and its order by bytes.

Only the first keys of index files, as many as there are tasks, are broadcast.
Files are named by attempt, and only names that a finished task returned are
used, so that a lost executor leaves nothing half-written in use.

Defined results: a null payload is empty; a null URL has the empty key; payloads
of fewer than LEAST bytes never revisit; rows with equal page and URL each have
a record of their own; a null page never is what others refer to; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import scratch_path, stored

#: Bytes of a payload that others may refer to; bytes of an archive; index lines of a block.
LEAST, ARCHIVE_BYTES, LINES = 1000, 512 << 20, 256


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the rest; lower case, without scheme."""
    rest = (url or "").partition("://")[2] or (url or "")
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, _, port = rest[:end].lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest[end:].partition("#")[0].lower() if host else ""


def sort_key(url: str | None, page: int | None) -> str:
    """What index lines are ordered and searched by: the URL key and the page."""
    return f"{url_key(url)}\t{'' if page is None else format(page + 2**63, '020d')}"


@F.arrow_udf(StringType())
def _sort_keys(url: pa.Array, page: pa.Array) -> pa.Array:
    return pa.array([sort_key(u, p) for u, p in zip(url.to_pylist(), page.to_pylist(), strict=True)], pa.string())


def record(url: str | None, page: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, a response or a revisit."""
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%s" % (len(payload), payload)
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    """A file in the shared folder that counts its bytes."""

    def __init__(self, folder: str, kind: str):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{kind}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
        self.out, self.size = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)


_CAPTURES = "sort_key string, archive string, at long, size long"


def _archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for b in batches:
            rows = []
            for url, page, payload, digest, refers_to in zip(*b.columns, strict=True):
                url, page, payload, digest, refers_to = url.as_py(), page.as_py(), payload.as_py() or b"", digest.as_py(), refers_to.as_py()
                file = file or _File(folder, "archive")
                rows.append((sort_key(url, page), file.name, *file.add(_gzip(record(url, page, payload, digest, refers_to)))))
                if file.size >= ARCHIVE_BYTES:
                    file.out.close()
                    file = None
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["sort_key", "archive", "at", "size"])
        if file:
            file.out.close()

    return run


_FILES = "first string, file string, at long, size long"


def _index(folder: str):
    """Sorted captures as one index file; gives its first key and where its directory is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, directory, lines = None, [], []

        def flush() -> None:
            at, size = file.add(zlib.compress("\n".join(json.dumps(x) for x in lines).encode()))
            directory.append([lines[0][0], at, size])

        for b in batches:
            for key, archive, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file = file or _File(folder, "index")
                lines.append([key, archive, at, size])
                if len(lines) == LINES:
                    flush()
                    lines = []
        if file:
            if lines:
                flush()
            at, size = file.add(zlib.compress(json.dumps(directory).encode()))
            file.out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([file.name]), pa.array([at]), pa.array([size])], ["first", "file", "at", "size"])

    return run


class Reader:
    """Looks captures up and reads their records."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.files, self.firsts = files, [f[0] for f in files]
        self.directory: tuple[int, list] = (-1, [])
        self.block: tuple[tuple, list] = ((), [])
        self.open: dict[str, object] = {}

    def range(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return self.open[name].read_at(size, at)

    def captures(self, wanted: str) -> Iterator[list]:
        """The index lines of a sort key."""
        k = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while k < len(self.files) and self.firsts[k] <= wanted:
            if self.directory[0] != k:
                _, name, at, size = self.files[k]
                self.directory = (k, json.loads(zlib.decompress(self.range(name, at, size))))
            blocks = self.directory[1]
            n = max(0, bisect.bisect_left(blocks, [wanted]) - 1)
            while n < len(blocks) and blocks[n][0] <= wanted:
                if self.block[0] != (k, n):
                    data = zlib.decompress(self.range(self.files[k][1], *blocks[n][1:]))
                    self.block = ((k, n), [json.loads(x) for x in data.decode().split("\n")])
                lines = self.block[1]
                i = bisect.bisect_left(lines, [wanted])
                while i < len(lines) and lines[i][0] == wanted:
                    yield lines[i]
                    i += 1
                n += 1
            k += 1

    def record(self, line: list) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.range(*line[1:]), 31))


_READ = "page_id long, url_key string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def _read(reader_of, required: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of()
        page_of = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for b in batches:
            rows = []
            for wanted in b.column(0).to_pylist():
                found = 0
                for line in reader.captures(wanted):
                    found += 1
                    h, payload = reader.record(line)
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n):
                        raise ValueError(f"record {h['WARC-Record-ID']} does not have the payload that it names")
                    rows.append((page_of(h["WARC-Record-ID"]), wanted.rpartition("\t")[0], n, digest, h["WARC-Type"], page_of(h.get("WARC-Refers-To")), line[1], line[2]))
                if required and not found:
                    raise ValueError(f"the index has no capture of {wanted!r}")
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url_key", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "at"])

    return run


class Captures:
    """A capture index in a folder: ``write`` makes it, ``read`` looks rows up in it."""

    def __init__(self, folder: str, files: list[tuple[str, str, int, int]]):
        self.folder, self.files = folder, sorted(files)

    @classmethod
    def write(cls, pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html") -> Captures:
        rows = pages.select(F.col(url).alias("url"), F.col(id_column).cast("long").alias("page_id"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
        rows = rows.withColumn("digest", F.sha1("payload"))
        heads = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        refers = F.when(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id")), F.col("head"))
        typed = rows.join(heads, "digest", "left").select("url", "page_id", "payload", "digest", refers.alias("refers_to"))
        captures = stored(typed.mapInArrow(_archives(folder), _CAPTURES), "captures")
        n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = captures.repartitionByRange(n, "sort_key", "archive", "at").sortWithinPartitions("sort_key", "archive", "at")
        files = ordered.mapInArrow(_index(folder), _FILES).collect()  # one row a task
        return cls(folder, [tuple(f) for f in files])

    def read(self, wanted: DataFrame, id_column: str = "page_id", url: str = "url", required: bool = False) -> DataFrame:
        """The records of the rows' pages and URLs, each capture once; with ``required`` a row without a capture is an error."""
        rows = wanted.select(_sort_keys(F.col(url), F.col(id_column).cast("long")).alias("sort_key")).distinct()
        n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = wanted.sparkSession.sparkContext.broadcast((self.folder, self.files))
        ordered = rows.repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key")
        return ordered.mapInArrow(_read(lambda: Reader(*held.value), required), _READ)


def round_trip(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all rows to archives in the shared folder and read them back through the index; a row that is not found is an error."""
    folder = scratch_path(pages.sparkSession, "warc")
    return Captures.write(pages, folder, id_column, url, payload).read(pages, id_column, url, required=True)

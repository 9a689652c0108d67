"""WARC archives: a writer, and a reader that splits files of gzip members at any byte."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, open_fs, saved, shared_dir

#: Bytes of a split, of a read, and of a record's header at most.
SPLIT_BYTES, READ_BYTES, HEADER_BYTES = 64 << 20, 1 << 20, 64 << 10
#: Tasks that read an archive at most; with more ranges than that, each reads several.
MAX_TASKS = 100_000
#: Records of these types are pages; a response is taken without its HTTP header.
TYPES = ("resource", "response")
MAGIC = b"\x1f\x8b\x08"
_SAFE = "".join(chr(i) for i in range(33, 127) if chr(i) != "%")


def record(page_id: int | None, url: str | None, body: str | None) -> bytes:
    """One gzip member with one WARC record. Null fields have no header; a null body is marked."""
    data = (body or "").encode("utf-8", "surrogatepass")
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    lines += [f"WARC-Target-URI: {quote(url, safe=_SAFE)}"] if url is not None else []
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    lines += ["X-Body: none"] if body is None else []
    lines += [f"Content-Length: {len(data)}"]
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + data + b"\r\n\r\n") + press.flush()


def write_warc(pages: DataFrame, where: str) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as one ``.warc.gz`` file for each partition, in the shared folder ``where``.

    A file is written under another name and moved, so a task that runs again replaces it. Gives ``path`` and ``records``.
    """
    need(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = open_fs(where)
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{context.partitionId():06d}.warc.gz"
        partial = f"{path}/_part-{context.partitionId():06d}-{context.taskAttemptId()}"
        n = 0
        with system.open_output_stream(partial, compression=None) as out:
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    out.write(record(page_id, url, html))
                    n += 1
        system.move(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "path string, records long")


def head_of(data: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The headers, by name in small letters, of the record that begins at ``at``, and where its body begins; None if none does."""
    if not re.match(rb"WARC/\d+\.\d+\r?\n", data[at : at + 20]):
        return None
    end = re.compile(rb"\r?\n\r?\n").search(data, at, at + HEADER_BYTES)
    if not end:
        return None
    headers = {}
    for line in data[at : end.start()].decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    return (headers, end.end()) if re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")) else None


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each whole record of a member, one after the other."""
    at = 0
    while found := head_of(data, at):
        headers, start = found
        stop = start + int(headers["content-length"])
        if stop > len(data):
            return
        yield headers, data[start:stop]
        at = stop
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


class Reader:
    """A file read in blocks, of which the last is kept: members that follow each other aren't read again."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size, self.base, self.block = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """The ``n`` bytes from ``at``, or as many as there are."""
        n = min(n, self.size - at)
        if at < self.base or at + n > self.base + len(self.block):
            self.base, self.block = at, self.file.read_at(min(max(n, READ_BYTES), self.size - at), at)
        return self.block[at - self.base : at - self.base + n]

    def find(self, what: bytes, at: int, stop: int) -> int:
        """Where ``what`` begins first in [at, stop), or -1."""
        while at < stop and at + len(what) <= self.size:
            self.get(at, len(what))
            found = self.block.find(what, at - self.base, stop - self.base + len(what) - 1)
            if found >= 0:
                return self.base + found
            at = self.base + len(self.block) - len(what) + 1
        return -1


def scan(file: pa.NativeFile, size: int, start: int, stop: int, keep: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content (nothing unless ``keep``) of each member that starts in [start, stop); the last may end beyond.

    Bytes are searched for the gzip magic. A candidate counts if it decodes to its end, checksum included, and its content
    begins with the headers of a record; if not, the search goes on one byte later. A member that is cut off or damaged
    is passed over.
    """
    reader, at = Reader(file, size), start
    while (at := reader.find(MAGIC, at, stop)) >= 0:
        member = _member(reader, at, keep)
        if member is None:
            at += 1
        else:
            yield at, member[1], member[0]
            at += member[1]


def _member(reader: Reader, at: int, keep: bool) -> tuple[bytes, int] | None:
    decode, parts, held, fed, checked = zlib.decompressobj(31), [], 0, 0, False
    try:
        while not decode.eof:
            piece = reader.get(at + fed, 1 << 16 if checked else 1 << 13)
            if not piece:
                return None
            got = decode.decompress(piece)
            fed += len(piece)
            if keep or not checked:
                parts.append(got)
                held += len(got)
            if not checked and held >= 5:
                start = b"".join(parts)
                if not start.startswith(b"WARC/"):
                    return None
                if head_of(start):
                    checked = True
                elif held > HEADER_BYTES or decode.eof:
                    return None
    except zlib.error:
        return None
    return (b"".join(parts) if keep else b"", fed - len(decode.unused_data)) if checked else None


def page_of(headers: dict[str, str], body: bytes) -> tuple[int | None, str | None, str | None]:
    """``page_id``, ``url`` and ``html`` of a record. An id that isn't a number of 64 bits is null."""
    page, url, kind = headers.get("x-page-id", ""), headers.get("warc-target-uri"), headers.get("warc-type")
    number = int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) else None
    if number is not None and not -(1 << 63) <= number < 1 << 63:
        number = None
    if kind == "response" and re.match(rb"HTTP/\d", body):
        end = re.search(rb"\r?\n\r?\n", body)
        body = body[end.end() :] if end else b""
    return number, None if url is None else unquote(url.strip("<>")), None if headers.get("x-body") == "none" else body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, where: str, split_bytes: int = SPLIT_BYTES, types: tuple[str, ...] = TYPES) -> DataFrame:
    """The records of all ``.warc.gz`` files in ``where``: ``page_id, url, html, offset, length`` (of their member).

    Files are cut into ranges of ``split_bytes``; each task scans one range and owns the members that start in it, as
    :func:`scan` says. A first pass, which only decodes, finds how far each range's last member reaches into the next
    ranges, and nothing in there is taken for a member; so the result is that of one scan from the file's first byte,
    however it is cut, even if an archive is stored within a record.

    A member may hold several records; they have its offset. Names of headers may have any case. Records of other types
    than ``types`` (information, requests, ...), and what is cut off, damaged or not WARC, are passed over. A member is held
    in memory whole, however long. Null and empty fields, see :func:`page_of`. Repeated records and ties are given each. An
    empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(where).select("path", "length")
    ranges = files.where("length > 0").select("path", F.col("length").alias("size"), F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    tasks = max(1, min(MAX_TASKS, ranges.count()))

    def opened(path: str) -> pa.NativeFile:
        system, name = open_fs(unquote(path) if path.startswith("file:") else path)
        return system.open_input_file(name)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stops = []
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with opened(path) as file:
                    stops.append(max((at + length for at, length, _ in scan(file, size, start, min(size, start + split_bytes), keep=False)), default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, pa.int64())], names=["path", "size", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows, held = [], 0
                with opened(path) as file:
                    for offset, length, data in scan(file, size, first, min(size, start + split_bytes)):
                        rows += [(*page_of(headers, body), offset, length) for headers, body in records_in(data) if headers.get("warc-type") in types]
                        held += len(data)
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    reached = saved(ranges.repartition(tasks).mapInArrow(reach, "path string, size long, start long, stop long"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = reached.select("path", "size", "start", F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))).alias("first"))
    return first.where(F.col("first") < F.col("start") + split_bytes).repartition(tasks).mapInArrow(run, "page_id long, url string, html string, offset long, length long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "html", "offset", "length"])


def warc_round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``pages`` written as an archive in the shared folder and read back: ``page_id, url, html``.

    Nulls in any column, empty and very long pages and repeated rows come back as they were. An empty table gives no rows.
    Other columns, whatever their names, are not archived.
    """
    spark = pages.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    system, path = open_fs(where)
    system.create_dir(path, recursive=True)  # a table without partitions writes no file
    write_warc(pages, where).agg(F.sum("records")).first()
    return read_warc(spark, where, split_bytes).select("page_id", "url", "html")


#: DuckDB SQL for the round trip of the pages.
SQL = "SELECT page_id, url, html FROM pages"

"""WARC archives as a Spark data source, ``format("warc")``, for reading and writing.

Reading plans one partition for each run of records of about ``split_bytes``
(through the ``.idx`` offsets beside a file; a file without them is one
partition).  Predicates on the record type and on other header columns are
pushed down: a record's header is inflated and parsed first, and unless the
record is wanted, with its payload, the rest of it is never decoded.

A file without offsets is read once from front to back, a piece at a time.

Writing makes one file for each task, a gzip member for each record.  A task
writes under a name of its own that begins with the job's.  The commit on the
driver renames the files of the tasks that count, many at a time, and commit and
abort delete the job's other files, those of failed and repeated attempts too.
If the driver itself dies, ``.part`` files stay, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from spanlens.llm.storage import materialize, open_store

HEADER_COLUMNS = "page_id long, record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to long"
SCHEMA = HEADER_COLUMNS + ", payload binary"
INPUT = "page_id long, url string, payload binary, payload_digest string, record_type string, refers_to long"
BATCH_BYTES = 8 << 20
_END = b"\r\n\r\n"
_PIECE, _FLOW = 4096, 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value without line breaks, which would start another header."""
    return "".join(f"%{b:02X}" if b < 0x20 or b == 0x7F else chr(b) for b in value.encode("utf-8", "surrogatepass")).encode("latin-1").decode("utf-8", "replace")


def write_record(page_id, url, payload: bytes | None, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One record as a gzip member.  A revisit has the HTTP header only."""
    payload = payload or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_urn(refers_to)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block + _END) + squeeze.flush()


def _number(value: str | None) -> int | None:
    return int(value) if value and value.strip().lstrip("-").isdigit() else None


def parse_header(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank continues the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields


def _row(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest")
    length = fields.get("x-payload-length")
    return {
        "page_id": _number(fields.get("x-page-id")),
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload_digest": digest.split(":", 1)[-1] if digest else None,
        "payload_bytes": _number(length) if length else _number(fields.get("content-length")),
        "refers_to": _number(fields.get("x-refers-to-page-id")),
    }


class _Member:
    """A gzip member that inflates no further than asked."""

    def __init__(self, data: bytes | memoryview):
        self.inflate = zlib.decompressobj(31)
        self.rest: bytes | memoryview = data
        self.out = b""

    def header(self) -> bytes:
        while _END not in self.out:
            if self.inflate.eof or not len(self.rest):
                raise ValueError("a record ends within its header")
            self.out += self.inflate.decompress(self.rest, _PIECE)
            self.rest = self.inflate.unconsumed_tail
        at = self.out.index(_END)
        head, self.out = self.out[:at], self.out[at + 4 :]
        return head

    def block(self, length: int) -> bytes:
        data = self.out + self.inflate.decompress(self.rest)
        if len(data) < length:
            raise ValueError("a record ends within its block")
        return data[:length]


class _Flow:
    """The bytes of a file from front to back, inflated if it is gzip, of which little is held."""

    def __init__(self, source, packed: bool):
        self.source = source
        self.inflate = zlib.decompressobj(31) if packed else None
        self.raw = b""
        self.out = bytearray()

    def _more(self) -> bool:
        """Add up to ``_FLOW`` bytes to ``out``; whether there were any."""
        if self.inflate is None:
            piece = self.source.read(_FLOW)
            self.out += piece
            return bool(piece)
        while True:
            self.raw = self.raw or self.source.read(_FLOW)
            if not self.raw:
                return False
            if self.inflate.eof:  # the next member
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.decompress(self.raw, _FLOW)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.out += piece
                return True

    def header(self) -> bytes | None:
        """What stands before the next blank line; None at the end of the file."""
        looked = 0
        while True:
            if not looked:
                blank = len(self.out) - len(self.out.lstrip(b"\r\n"))
                del self.out[:blank]  # the end of the record before
            at = self.out.find(_END, max(0, looked - 3))
            if at >= 0:
                head = bytes(self.out[:at])
                del self.out[: at + 4]
                return head
            looked = len(self.out)
            if not self._more():
                if self.out:
                    raise ValueError("a record ends within its header")
                return None

    def block(self, length: int) -> bytes:
        parts, left = [], length
        while left:
            if not self.out and not self._more():
                raise ValueError("a record ends within its block")
            parts.append(bytes(self.out[:left]))
            del self.out[:left]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, length: int) -> None:
        while length:
            if not self.out and not self._more():
                raise ValueError("a record ends within its block")
            n = min(length, len(self.out))
            del self.out[:n]
            length -= n


def _payload(fields: dict[str, str], block: bytes) -> bytes | None:
    if fields.get("warc-type") == "revisit":
        return None
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(_END)[2]
    return block


def _keeps(test: Filter) -> Callable[[dict], bool] | None:
    """A predicate as a function of a row's header columns; None where it cannot be pushed."""
    one = getattr(test, "attribute", None)
    known = {c.split()[0] for c in HEADER_COLUMNS.split(", ")}
    if one is None or len(one) != 1 or one[0] not in known:
        return None
    name, value = one[0], getattr(test, "value", None)
    compare = {
        EqualTo: lambda v: v == value,
        In: lambda v: v in value,
        GreaterThan: lambda v: v > value,
        GreaterThanOrEqual: lambda v: v >= value,
        LessThan: lambda v: v < value,
        LessThanOrEqual: lambda v: v <= value,
        StringStartsWith: lambda v: v.startswith(value),
        StringEndsWith: lambda v: v.endswith(value),
        StringContains: lambda v: value in v,
        IsNotNull: lambda v: True,
    }.get(type(test))
    return compare and (lambda row: row[name] is not None and compare(row[name]))


@dataclass
class Span(InputPartition):
    """Records of one file: offsets of the records and where the last ends; all of it without offsets."""

    def __init__(self, path: str, offsets: list[int] | None, end: int):
        super().__init__(None)
        self.path, self.offsets, self.end = path, offsets, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.columns = columns
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if _keeps(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Span]:
        store, inner = open_store(self.path)
        found = store.get_file_info(pafs.FileSelector(inner, recursive=True)) if store.get_file_info(inner).type == pafs.FileType.Directory else [store.get_file_info(inner)]
        files = {f.path: f.size for f in found if f.type == pafs.FileType.File}
        spans = []
        for path in sorted(f for f in files if f.endswith((".warc", ".warc.gz"))):
            if path + ".idx" not in files:
                spans.append(Span(path, None, files[path]))
                continue
            with store.open_input_stream(path + ".idx") as source:
                offsets = np.frombuffer(source.read(), "<u8").tolist()
            at = 0
            while at < len(offsets):
                to = int(np.searchsorted(offsets, offsets[at] + self.split))
                to = max(at + 1, to)
                spans.append(Span(path, offsets[at:to], offsets[to] if to < len(offsets) else files[path]))
                at = to
        return spans or [Span("", [], 0)]

    def _records(self, span: Span) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
        """Each record's header fields, and a function that decodes its block."""
        if not span.path:
            return
        store, _ = open_store(self.path)
        with store.open_input_file(span.path) as source:
            if span.offsets is not None:
                for at, end in zip(span.offsets, [*span.offsets[1:], span.end]):
                    member = _Member(source.read_at(end - at, at))
                    fields = parse_header(member.header())
                    yield fields, lambda m=member, f=fields: m.block(int(f.get("content-length", 0)))
                return
        with store.open_input_stream(span.path, compression=None) as source:
            flow = _Flow(source, span.path.endswith(".gz"))
            while (head := flow.header()) is not None:
                fields = parse_header(head)
                length = int(fields.get("content-length", 0))
                held: list[bytes] = []
                yield fields, lambda n=length, h=held: h.append(flow.block(n)) or h[0]
                if not held:
                    flow.skip(length)

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        tests = [_keeps(t) for t in self.tests]
        with_payload = "payload" in self.columns
        schema = _arrow_schema(self.columns)
        rows: list[dict] = []
        size = 0
        for fields, decode in self._records(span):
            row = _row(fields)
            if not all(t(row) for t in tests):
                continue
            if with_payload or self.verify:
                payload = _payload(fields, decode())
                if payload is not None:
                    row["payload_bytes"] = len(payload)
                    if self.verify and row["payload_digest"] != base32_sha1(payload):
                        raise ValueError(f"payload of {row['record_id']} does not match its digest")
                    size += len(payload) if with_payload else 0
                row["payload"] = payload
            rows.append(row)
            size += 300
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.columns} for r in rows], schema)


def _arrow_schema(columns: list[str]) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = dict(c.split() for c in SCHEMA.split(", "))
    return pa.schema([(c, kinds[types[c]]) for c in columns])


@dataclass
class Written(WriterCommitMessage):
    part: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex  # one writer is made for a job, and sent to its tasks

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, inner = open_store(self.path)
        store.create_dir(inner, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex}"
        part, final = f"{inner}/{name}.part", f"{inner}/{name}.warc.gz"
        offsets, at = [], 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                names = batch.schema.names
                for row in zip(*[batch.column(names.index(c.split()[0])).to_pylist() for c in INPUT.split(", ")]):
                    page_id, url, payload, digest, kind, refers_to = row
                    offsets.append(at)
                    at += out.write(write_record(page_id, url, payload, digest, kind, refers_to, self.date))
        with store.open_output_stream(part + ".idx") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        return Written(part, final)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = open_store(self.path)

        def publish(m: Written) -> None:
            store.move(m.part + ".idx", m.final + ".idx")
            store.move(m.part, m.final)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(publish, [m for m in messages if m is not None]))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what attempts of this job left that do not count."""
        store, inner = open_store(self.path)
        for found in store.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if found.base_name.startswith(self.job) and found.base_name.endswith((".part", ".part.idx")):
                store.delete_file(found.path)


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (true: with the payload column); ``verify``; ``split_bytes``; ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA if self.options.get("payload", "true").lower() == "true" else HEADER_COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, split_bytes: int = 32 << 20) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
    return reader.option("verify", str(verify).lower()).option("split_bytes", split_bytes).load()


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32_of_hex(digest):
    """Upper-case base32 of a SHA-1 in hex, JVM side: four letters for each five hex digits."""
    quads = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        quads += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*quads)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for the writer: which records are responses and which revisit an equal payload.

    Of rows whose payloads are equal and have ``least_bytes`` or more, those with
    the smallest id are responses and the others revisit it; a row without an
    id revisits too unless no row of its payload has one.  A null payload is empty.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    slim = rows.select("page_id", "sha1", F.length("payload").alias("bytes"))
    shared = slim.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # only payloads that repeat are joined, so most archives need no shuffle of payloads
    shared = materialize(shared.where("n > 1 AND first_id IS NOT NULL").select(F.col("sha1").alias("again"), "first_id"), "revisits")
    joined = rows.join(shared, rows.sha1 == shared.again, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        _base32_of_hex(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", **columns) -> DataFrame:
    """Write ``pages`` as WARC files in ``path`` and return the records read back.

    A record for each row, repeated rows too.  Payload digests of responses are
    verified while reading; a revisit's digest and size are in its header.
    """
    spark = pages.sparkSession
    register(spark)
    with_revisits(pages, least_bytes=least_bytes, **columns).write.format("warc").option("path", path).option("date", date).mode("append").save()
    return read_warc(spark, path, payload=False, verify=True)

"""WARC archives as a PySpark Python data source, and pages archived with revisits in place of equal payloads.

``spark.read.format("warc").load(folder)`` reads .warc and .warc.gz files. Each column of the schema asked
for is a field of the record's header (``warc_target_uri`` is WARC-Target-URI, ``page_id`` is Page-Id), or
one of ``payload``, ``payload_sha1``, ``headers``, ``http_headers``, ``file`` and ``offset``. Files are
planned into partitions by size. Predicates on header columns are pushed down: a record's header is parsed
first, and the block of an unwanted record is neither inflated nor parsed, nor is any block where the schema
has neither ``payload`` nor ``http_headers``. Plain files are skipped by Content-Length; compressed ones have
one gzip member a record, whose extra field ``sl`` (skip lengths, as the format's annex has it) tells where
the next begins. Members of other writers without it are inflated and thrown away.

Paths are anything that pyarrow's file systems open; on a cluster a folder that all executors share.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from lagweave.llm._memory import modest_batches
from lagweave.llm._shared import salted_join, shared_folder, written

SCHEMA = (
    "warc_type string, warc_record_id string, warc_date string, warc_target_uri string, warc_refers_to string, content_type string, content_length long, "
    "payload_sha1 string, headers map<string,string>, http_headers map<string,string>, payload binary, file string, offset long"
)
#: Columns that are no field of the header by their name.
SPECIAL = {"payload", "payload_sha1", "headers", "http_headers", "file", "offset"}
#: Bytes of files that one partition reads (one file at least), and at which a writer begins its next file.
PARTITION_BYTES, FILE_BYTES = 64 << 20, 128 << 20
#: Rows of an Arrow batch that a reader hands on, and payload bytes after which it is handed on sooner.
ROWS, BYTES = 500, 8 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def field(column: str) -> str:
    """The header field of a column: page_id is page-id; fields are compared without case."""
    return column.lower().replace("_", "-")


# Reading


@dataclass
class Record:
    """A header, where it stands, and how to get the block of it."""

    headers: dict[str, str]
    file: str
    offset: int
    block: Callable[[], bytes]


def parsed(head: bytes, where: str) -> dict[str, str]:
    """Fields of a header, names in lower case; of a repeated field the last value, folded lines joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {where}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def skip_lengths(head: bytes) -> int | None:
    """Compressed length of a gzip member by the ``sl`` part of its extra field, if it has one."""
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"sl" and n == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0] or None
        at += 4 + n
    return None


def records(path: str, wanted: Callable[[dict[str, str]], bool], blocks: bool = True) -> Iterator[Record]:
    """Records of a file whose header is ``wanted``; with ``blocks`` a record's block must be taken, or not, before the next record."""
    system, inner = opened(path)
    with system.open_input_file(inner) as raw, io.BufferedReader(raw, 1 << 18) as f:
        packed = f.peek(2)[:2] == b"\x1f\x8b"
        yield from (_packed if packed else _plain)(f, path, wanted, blocks)


def _plain(f: io.BufferedReader, path: str, wanted: Callable, blocks: bool) -> Iterator[Record]:
    while True:
        at = f.tell()
        head = bytearray()
        while not head.endswith(b"\r\n\r\n"):
            line = f.readline()
            if not line:
                break
            if head or line.strip():  # blank lines between records
                head += line
            else:
                at += len(line)
        if not head:
            return
        fields = parsed(bytes(head), f"{path}:{at}")
        size, begin = int(fields.get("content-length", 0)), f.tell()
        if wanted(fields):
            yield Record(fields, path, at, lambda: _exactly(f.read(size) if blocks else b"", size if blocks else 0, f"{path}:{at}"))  # noqa: B023
        f.seek(begin + size)


def _packed(f: io.BufferedReader, path: str, wanted: Callable, blocks: bool) -> Iterator[Record]:
    while True:
        at = f.tell()
        head = f.peek(64)
        if not head:
            return
        length = skip_lengths(head[:4096])
        inflate, out, fed = zlib.decompressobj(31), bytearray(), 0
        while b"\r\n\r\n" not in out and not inflate.eof:
            piece = f.read(min(1024, length - fed) if length else 1024)
            if not piece:
                raise ValueError(f"a record is cut short at {path}:{at}")
            fed += len(piece)
            out += inflate.decompress(piece)
        cut = out.find(b"\r\n\r\n") + 4
        fields = parsed(bytes(out[:cut]), f"{path}:{at}")
        size = int(fields.get("content-length", 0))

        def rest(keep: bool, inflate=inflate, fed=fed, length=length, out=out) -> int:  # noqa: ANN001
            """Inflates the rest of the member; where the next one begins."""
            while not inflate.eof:
                piece = f.read(min(1 << 16, length - fed) if length else 1 << 16)
                if not piece:
                    raise ValueError(f"a record is cut short at {path}:{at}")  # noqa: B023
                fed += len(piece)
                more = inflate.decompress(piece)
                if keep:
                    out += more
            return at + fed - len(inflate.unused_data)  # noqa: B023

        end: list[int] = [at + length] if length else []
        if wanted(fields):

            def block() -> bytes:
                if not blocks:
                    return b""
                end[:] = [rest(True)]  # noqa: B023
                return _exactly(bytes(out[cut : cut + size]), size, f"{path}:{at}")  # noqa: B023

            yield Record(fields, path, at, block)
        if not end:
            end[:] = [rest(False)]
        f.seek(end[0])


def _exactly(block: bytes, size: int, where: str) -> bytes:
    if len(block) < size:
        raise ValueError(f"a record is cut short at {where}")
    return block


def split_http(fields: dict[str, str], block: bytes) -> tuple[dict[str, str] | None, bytes]:
    """(HTTP fields, payload) of a block; only blocks of HTTP messages have fields before their payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return None, block
    cut = block.find(b"\r\n\r\n")
    head, body = (block, b"") if cut < 0 else (block[:cut], block[cut + 4 :])
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}, body


def hex_digest(fields: dict[str, str]) -> str | None:
    """The payload's SHA-1 in lower-case hex, from base 32 or hex."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema, self.size = options["path"], schema, int(options.get("partition_bytes", PARTITION_BYTES))
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        odd = [c for c, k in kinds.items() if c not in SPECIAL and k not in ("string", "bigint", "int")]
        if odd:
            raise ValueError(f"header columns are string, long or int: {odd}")
        self.kinds, self.tests = kinds, []

    def pushFilters(self, filters: list[Filter]):  # noqa: ANN201, N802
        """Takes comparisons of header columns, ``payload_sha1`` and ``file``; returns all others."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            simple = name in self.kinds and name not in ("payload", "headers", "http_headers", "offset")
            if simple and type(f) in _TESTS:
                self.tests.append((name, _TESTS[type(f)], f.value, False))
            elif simple and isinstance(f, (IsNull, IsNotNull, EqualNullSafe)):
                null = isinstance(f, IsNull) or isinstance(f, EqualNullSafe) and f.value is None
                self.tests.append((name, (lambda x, v: x == v) if isinstance(f, EqualNullSafe) and not null else (lambda x, v: True), getattr(f, "value", None), null))
            else:
                yield f

    def passes(self, get: Callable[[str], object], names: Callable[[str], bool]) -> bool:
        for name, test, value, null in self.tests:
            if names(name):
                x = get(name)
                if null != (x is None) or x is not None and not test(x, value):
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Files that the writers' manifests name, or all archives of a folder without any, packed by size."""
        every = [(p, n) for p, n in listed(self.path) if self.passes(lambda _, p=p: p, lambda name: name == "file")]
        parts, room = [], 0
        for path, size in sorted(every):
            if not parts or room + size > self.size:
                parts.append([])
                room = 0
            parts[-1].append(path)
            room += size
        return [InputPartition(p) for p in parts] or [InputPartition([])]

    def value(self, column: str, fields: dict[str, str]):  # noqa: ANN201
        if column == "payload_sha1":
            return hex_digest(fields)
        x = fields.get(field(column))
        if x is None or self.kinds[column] == "string":
            return x
        return int(x) if x.lstrip("-").isdigit() else None

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        names, blocks = self.schema.names, bool({"payload", "http_headers"} & set(self.schema.names))
        wanted = lambda fields: self.passes(lambda c: self.value(c, fields), lambda name: name != "file")
        rows: list[tuple] = []
        held = 0
        for path in partition.value:
            for r in records(path, wanted, blocks):
                http, payload = split_http(r.headers, r.block()) if blocks else (None, None)
                special = {"payload": payload, "headers": r.headers, "http_headers": http, "file": r.file, "offset": r.offset}
                rows.append(tuple(special[c] if c in special else self.value(c, r.headers) for c in names))
                held += len(payload or b"")
                if len(rows) >= ROWS or held >= BYTES:
                    yield batch(rows, kind)
                    rows, held = [], 0
        if rows:
            yield batch(rows, kind)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], f.type) for c, f in zip(columns, schema)], schema=schema)


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the archives of a folder, or the file itself, as paths that ``opened`` takes."""
    from pyarrow import fs

    system, inner = opened(path)
    start = path[: len(path) - len(inner)] if path.endswith(inner) else path[: path.find(inner.lstrip("/"))]
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=False))
    manifests = [x for x in found if x.base_name.startswith("_manifest-")]
    named = {n for m in manifests for n in json.loads(system.open_input_file(m.path).read())}
    return [(start + x.path, x.size) for x in found if x.type == fs.FileType.File and (x.base_name in named if manifests else x.base_name.endswith((".warc", ".warc.gz")))]


# Writing


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


def gzip_member(data: bytes) -> bytes:
    """One gzip member with its skip lengths in the extra field (0 where they don't fit 32 bits)."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 24 + len(body) + 8
    fits = total < 1 << 32 and len(data) < 1 << 32
    extra = struct.pack("<2sHII", b"sl", 8, total if fits else 0, len(data) if fits else 0)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {clean(v)}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value on one line: line ends are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def titled(column: str) -> str:
    """page_id as Page-Id, warc_target_uri as WARC-Target-URI."""
    words = {"warc": "WARC", "uri": "URI", "id": "ID"} if column.startswith("warc_") else {}
    return "-".join(words.get(w, w.capitalize()) for w in column.lower().split("_"))


class WarcWriter(DataSourceArrowWriter):
    """One or more files a task; only files of committed tasks get into the manifest, so a lost or repeated task leaves nothing to be read."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.size, self.packed = int(options.get("file_bytes", FILE_BYTES)), options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        names: list[str] = []
        out, done = None, 0
        put = gzip_member if self.packed else bytes
        try:
            for rows in iterator:
                for n in range(rows.num_rows):  # row by row, so that one payload at a time is copied
                    if out is None or done >= self.size:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.packed}")
                        out, done = system.open_output_stream(f"{inner}/{names[-1]}", compression=None), 0
                        out.write(put(self.first(names[-1])))
                    data = put(self.one({c: rows.column(i)[n].as_py() for i, c in enumerate(rows.schema.names)}))
                    out.write(data)
                    done += len(data)
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def first(self, name: str) -> bytes:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", now), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return record(fields, b"software: lagweave\r\nformat: WARC File Format 1.1\r\n")

    def one(self, row: dict) -> bytes:
        fields = [(titled(c), str(v)) for c, v in row.items() if c not in SPECIAL and c != "content_length" and v is not None]
        if row.get("payload_sha1"):
            fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()))
        payload, http = row.get("payload") or b"", row.get("http_headers")
        if http is None:
            return record(fields, payload)
        head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in http) + "\r\n"
        return record(fields, head.encode() + payload)

    def commit(self, messages: list[Files | None]) -> None:
        from pyarrow import fs

        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        before = system.get_file_info(fs.FileSelector(inner)) if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{inner}/_manifest-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(names).encode())
        for x in before:
            if x.base_name not in names and x.base_name.startswith(("_manifest-", "part-")):
                system.delete_file(x.path)

    def abort(self, messages: list[Files | None]) -> None:
        system, inner = opened(self.path)
        for n in [n for m in messages if m is not None for n in m.names]:
            system.delete_file(f"{inner}/{n}")


class Warc(DataSource):
    """The data source; ``read_warc`` and ``archive`` register it."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records of a file or folder; where the session has filter pushdown of Python sources off, it is set on."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(path)


# Pages

#: Groups of equal payloads up to this many (48 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_GROUPS = 500_000


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """WARC records of ``pages`` (a long id): a response, or a revisit where another page has the same payload of ``least`` bytes or more.

    Payloads are equal by SHA-256. Of a group the rows with the largest id are responses (all of them where
    rows repeat; null ids are the smallest). Null pages are empty payloads, always responses.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    key = F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))
    groups = rows.select("page_id", key.alias("key")).where("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and response is not null").drop("n"))
    keyed = rows.withColumn("key", key)
    if groups.count() <= MAX_BROADCAST_GROUPS:
        rows = keyed.join(F.broadcast(groups), "key", "left")
    else:
        rows = salted_join(keyed, groups, "key", "page_id", "left")
    again = F.col("response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("warc_record_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.coalesce(F.col("url"), urn(F.col("page_id"))).alias("warc_target_uri"),
        F.when(again, urn(F.col("response"))).alias("warc_refers_to"),
        F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).alias("warc_profile"),
        F.lit("application/http; msgtype=response").alias("content_type"), "page_id", F.sha1("payload").alias("payload_sha1"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length("payload").cast("string")).alias("http_headers"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(records_: DataFrame, path: str, **options: object) -> None:
    """Writes records (columns as for reading) as archives of a folder, beside those that it has."""
    spark = records_.sparkSession
    spark.dataSource.register(Warc)
    modest_batches(spark)
    records_.write.format("warc").mode("append").options(**options).save(path)


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of the pages of an archive.

    Responses are measured by their payloads, and ``intact`` says whether their header tells the same
    digest; revisits have no payload, theirs is what their headers tell, so their blocks' payloads are never read.
    """
    responses = read_warc(spark, path, "warc_type string, page_id long, payload_sha1 string, payload binary").where("warc_type = 'response'")
    revisits = read_warc(spark, path, "warc_type string, page_id long, payload_sha1 string, warc_refers_to string, http_headers map<string,string>").where("warc_type = 'revisit'")
    one = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.sha1("payload") == F.col("payload_sha1")).alias("intact"))
    other = F.regexp_extract("warc_refers_to", "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    two = revisits.select("page_id", F.element_at("http_headers", "content-length").cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"), F.col("warc_type").alias("record_type"), other.alias("refers_to"), F.lit(True).alias("intact"))
    return one.union(two)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    path = f"{shared_folder(spark)}/lagweave-warc-{uuid.uuid4().hex}"
    archive(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return page_digests(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, CASE WHEN octet_length(body) >= 1000 THEN sha256(body) END AS key FROM p),
g AS (SELECT *, CASE WHEN key IS NOT NULL THEN max(page_id) OVER (PARTITION BY key) END AS top FROM k),
r AS (SELECT *, top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to, true AS intact FROM r
"""

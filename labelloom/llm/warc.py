"""WARC archives as a Spark data source (operator 9).

``write_archives`` decides with one aggregate which records revisit another, and writes one
record per page. Each record is a gzip member of its own whose header says how long it is
(the ``sl`` field of the WARC standard), so the reader plans one partition per file, unpacks
only the first bytes of a record to see its headers, drops records by the pushed-down type
and header predicates, and steps over payloads that nobody asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

#: Payloads of fewer bytes are always written.
MIN_REVISIT_BYTES = 1000
#: A new file is begun after this many compressed bytes.
FILE_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
_HEAD = 4096

#: Columns of the reader and the WARC header each comes from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "Payload-Length",
}
READ_SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", payload binary, error string"
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_length", "payload")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and full length in an ``sl`` field."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 12 + 12 + len(body) + 8
    if max(total, len(data)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(data))
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], payload: bytes | None) -> bytes:
    """One WARC record; a revisit has no payload. Field values hold no line breaks."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if payload is None else http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    head += [f"{HEADERS[name]}: {value}" for name, value in fields.items() if value is not None]
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcSource(DataSource):
    """``format("warc")``; reader option ``payload`` = ``false`` leaves payloads packed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Every attempt of a task writes files of its own; only a finished job moves them in."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in zip(*(batch.column(name).to_pylist() for name in WRITE_COLUMNS)):
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_attempts/{names[-1]}", compression=None), 0
                data = member(record(dict(zip(WRITE_COLUMNS[:-1], row)), row[-1]))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{root}/_attempts/{name}", f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for message in messages:
            for name in message.names if message else ():
                fs.delete_file(f"{root}/_attempts/{name}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((HEADERS[name], "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[name], "in", tuple(x for x in f.value if x is not None)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[name], "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [_File(f"{self.path.rstrip('/')}/{x.base_name}") for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith(".warc.gz")]

    def _wanted(self, head: dict[str, str]) -> bool:
        head = {name.lower(): value for name, value in head.items()}
        for header, kind, value in self.tests:
            own = head.get(header.lower())
            if kind == "in" and own not in value or kind == "starts" and not (own or "").startswith(value):
                return False
        return True

    def read(self, partition: _File | None):
        import pyarrow as pa

        if partition is None:  # what Spark hands on where there is no partition
            return
        fs, path = _filesystem(partition.path)
        rows: list[tuple] = []
        size = 0

        def batch():
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(HEADERS))]
            columns += [pa.array([r[-2] for r in rows], pa.binary()), pa.array([r[-1] for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*HEADERS, "payload", "error"])

        with fs.open_input_file(path) as file:
            for head, payload, error in records(file, self._wanted, self.payload):
                rows.append((*(head.get(header.lower()) for header in HEADERS.values()), payload, error))
                size += len(payload or b"") + 200
                if size >= _BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name: blanks around values do not count, a line that
    begins with a blank goes on with the one before, and lines without a colon are left out."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            if name is not None:
                found[name] = f"{found[name]} {line.strip()}".strip()
            continue
        key, colon, value = line.partition(":")
        name = key.strip().lower() if colon else None
        if name is not None:
            found[name] = value.strip()
    return found


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """Payload of a record's block: what follows the HTTP header in a block of that type,
    else the whole block. A header that never ends leaves nothing after it."""
    if head.get("content-type", "").lower().startswith("application/http"):
        for end in (b"\r\n\r\n", b"\n\n"):
            if end in block:
                return block.split(end, 1)[1]
        return b""
    return block


def records(file, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(header fields by lower-case name, payload, error) of the wanted records of one open
    archive. A record that is cut off or damaged comes with what is wrong with it; what
    follows it in the file cannot be found and ends the reading."""
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        piece = file.read(_HEAD)
        if piece[:3] != b"\x1f\x8b\x08":
            yield {}, None, f"no gzip member at byte {at}"
            return
        length = 0
        if len(piece) >= 20 and piece[3] & 4 and piece[12:14] == b"sl":
            length = struct.unpack("<I", piece[16:20])[0]
        unpack = zlib.decompressobj(31)
        head: dict[str, str] = {}
        try:
            data = unpack.decompress(piece)
            while b"\r\n\r\n" not in data and not unpack.eof:
                more = file.read(_HEAD)
                if not more:
                    raise ValueError("the record is cut off")
                data += unpack.decompress(more)
            top, blank, rest = data.partition(b"\r\n\r\n")
            if not blank or not top.startswith(b"WARC/"):
                raise ValueError("no header of a record")
            head = fields(top)
            keep = wanted(head)
            if (keep and payload) or not length:
                parts = [rest]
                while not unpack.eof:
                    more = file.read(1 << 16)
                    if not more:
                        raise ValueError("the record is cut off")
                    parts.append(unpack.decompress(more))
                length = file.tell() - len(unpack.unused_data) - at
                rest = b"".join(parts)
            body = None
            if keep and payload and head.get("warc-type") != "revisit":
                size = head.get("content-length", "")
                if not size.isdigit() or int(size) > len(rest):
                    raise ValueError("the block is shorter than its header says")
                body = payload_of(head, rest[: int(size)])
        except (ValueError, zlib.error) as wrong:
            yield head, None, f"{wrong}, at byte {at}"
            if not length:
                return
        else:
            if keep:
                yield head, body, None
        at += length


def _page_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _page_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1).try_cast("long")


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row of ``pages`` to a new folder.

    Of equal payloads of at least ``min_bytes`` the row of the largest id is the response
    and the others revisit it. Null payloads are written as empty ones. Rows repeated with
    the same largest id are all responses; null ids count as smallest, have no record id,
    and if all copies have one, all are responses. Line breaks and tabs in addresses are
    written as %0A, %0D and %09. Other columns are not read; an empty table makes no file.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload")}
    )
    # The digests are grouped apart from the payloads, and only those met twice come back.
    slim = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = slim.where("n > 1").select("digest", "first")
    joined = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    address = F.col("url")
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        address = F.replace(address, F.lit(mark), F.lit(code))
    joined.select(
        _page_uri(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        address.alias("target_uri"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.when(revisit, _page_uri(F.col("first"))).alias("refers_to"),
        F.col("size").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives in a folder; filters on header columns reach the reader.

    Header names are told apart whatever their case. Records of any type come back, those
    that are damaged with a text in ``error``, whatever the filters on headers.
    """
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(records: DataFrame) -> DataFrame:
    """Page ids, sizes, digests and links of records; what was read of a payload is measured
    anew, and a revisit is described by its headers."""
    read = F.col("payload").isNotNull()
    return records.select(
        _page_of(F.col("record_id")).alias("page_id"),
        F.when(read, F.octet_length("payload")).otherwise(F.col("payload_length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        _page_of(F.col("refers_to")).alias("refers_to"),
    )

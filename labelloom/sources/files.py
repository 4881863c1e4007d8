"""Files with names of their own, one document from many writers, and reads by range.

Spark's writers name their files themselves, one or more a task. Trainers want a file per
image under a given name, and one COCO document. Both are written in two steps that survive
lost executors: tasks write to folders of their attempt, and only attempts of a finished job
are listed as committed; then each committed attempt is moved, or copied to its place, by a
task that may run again.

A small file takes a whole block of the disk, so millions of them take many times their
bytes. Named files can be packed into zip archives instead, one after the other, each under
its own name: unpacked into one folder, the archives give the same tree of files.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from labelloom.session import discard, shuffles_removed, stored

STAGED = "_staged"
COMMITTED = "committed.json"
#: Bytes copied or hashed at a time.
COPY_BYTES = 8 << 20
#: Compression of the parts of a document.
PART_CODEC = "zstd"
#: An archive is closed after so many bytes, or so many files.
PACK_BYTES, PACK_FILES = 32 << 20, 50_000
#: Rows, and bytes of text, of one batch read from archives.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: Bytes read at once from an image, from its beginning and from each segment further on.
HEADER_BYTES = 4096


def filesystem(path: str):
    """(file system, path on it) for a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    host, _, tail = rest.partition("/")
    found, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return found, f"{root.rstrip('/')}/{tail}"


def put_text(path: str, text: str) -> None:
    """Write a small file."""
    fs, place = filesystem(path)
    with fs.open_output_stream(place) as out:
        out.write(text.encode())


def describe(root: str, name: str) -> tuple[str, int, str]:
    """Manifest row of one small file below ``root``."""
    fs, place = filesystem(f"{root}/{name}")
    with fs.open_input_stream(place) as file:
        data = file.read()
    return name, len(data), hashlib.sha256(data).hexdigest()


def _need_empty(path: str) -> None:
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    if fs.get_file_info(root).type == pafs.FileType.File or fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{path} is not empty")


class _Attempt(WriterCommitMessage):
    def __init__(self, name: str, parts: list):
        self.name, self.parts = name, parts


class _Staging(DataSourceArrowWriter):
    """Tasks write below a folder of their attempt; ``commit`` lists the attempts that count."""

    def __init__(self, path: str):
        self.path = path

    def commit(self, messages) -> None:
        listed = [[m.name, m.parts] for m in messages if m is not None and m.parts]
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/{STAGED}", recursive=True)
        put_text(f"{self.path}/{STAGED}/{COMMITTED}", json.dumps(listed))

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for message in messages:
            if message is not None:
                fs.delete_dir(f"{root}/{STAGED}/{message.name}")


def committed(path: str) -> list:
    """(attempt, parts) of every committed attempt below ``path``."""
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/{STAGED}/{COMMITTED}") as file:
        return json.loads(file.read())


# Named files -----------------------------------------------------------------------


class NamedFiles(DataSource):
    """``format("named_files")``: rows (path, content) in which equal paths follow each other.

    A file is the content of its rows in their order, so a file of any length streams
    through its task. Null content adds nothing; it makes an empty file of a path.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _NamedWriter(self.options["path"])


class _NamedWriter(_Staging):
    def write(self, iterator) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        attempt = uuid.uuid4().hex
        base = f"{root}/{STAGED}/{attempt}"
        fs.create_dir(base, recursive=True)
        made, files = set(), 0
        name = out = None
        with fs.open_output_stream(f"{base}/manifest") as manifest:

            def finish() -> None:
                out.close()
                manifest.write(json.dumps([name, size, digest.hexdigest()]).encode() + b"\n")

            for batch in iterator:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if path != name:
                        if out is not None:
                            finish()
                        folder = path.rpartition("/")[0]
                        if folder not in made:
                            fs.create_dir(f"{base}/files/{folder}", recursive=True)
                            made.add(folder)
                        out, name, size, digest = fs.open_output_stream(f"{base}/files/{path}"), path, 0, hashlib.sha256()
                        files += 1
                    if content:
                        out.write(content)
                        digest.update(content)
                        size += len(content)
            if out is not None:
                finish()
        return _Attempt(attempt, [files] if files else [])


MANIFEST = "path string, size long, sha256 string"


def _publish(batches) -> Iterator[pa.RecordBatch]:
    """Move the files of attempts into place; runs again without harm."""
    from pyarrow import fs as pafs

    for batch in batches:
        for path, attempt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, root = filesystem(path)
            base = f"{root}/{STAGED}/{attempt}"
            made, rows = set(), []
            with fs.open_input_stream(f"{base}/manifest") as file:
                listed = [json.loads(line) for line in file.read().splitlines()]
            for name, size, digest in listed:
                folder = name.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                if fs.get_file_info(f"{base}/files/{name}").type == pafs.FileType.File:
                    fs.move(f"{base}/files/{name}", f"{root}/{name}")
                rows.append((name, size, digest))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "size", "sha256"])


def write_named(rows: DataFrame, path: str, name: str, content: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """Write one file below ``path`` for each value of the column ``name``, and give the
    manifest: ``path, size, sha256`` of each file.

    The rows of a file are sorted by ``order`` and come from one task, through which they
    stream. ``path`` must not hold anything yet.
    """
    _need_empty(path)
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    placed = rows.repartition(name).sortWithinPartitions(name, *order)
    placed.select(F.col(name).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).write.format("named_files").mode("append").save(path)
    attempts = [(path, attempt) for attempt, _ in committed(path)]
    table = spark.createDataFrame(attempts, "path string, attempt string").repartition(max(1, len(attempts)), "attempt")
    manifest = stored(table.mapInArrow(_publish, MANIFEST), "file-manifest")
    fs, root = filesystem(path)
    fs.delete_dir(f"{root}/{STAGED}")
    return manifest


# Packed files ----------------------------------------------------------------------


class PackedFiles(DataSource):
    """``format("packed_files")``: rows (path, content) as in ``named_files``, into archives.

    Option ``compress`` = ``false`` stores contents as they are, so that reads by range stay
    reads by range.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PackWriter(self.options["path"], self.options.get("compress", "true") == "true")


class _PackWriter(DataSourceArrowWriter):
    """Attempts write archives of their own; a finished job moves them in."""

    def __init__(self, path: str, compress: bool):
        self.path, self.method = path, zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED

    def write(self, iterator) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        attempt = uuid.uuid4().hex
        base = f"{root}/{STAGED}/{attempt}"
        fs.create_dir(base, recursive=True)
        names: list[str] = []
        buffer = pack = None
        held: list[bytes] = []
        name, size = None, 0

        def info() -> zipfile.ZipInfo:
            found = zipfile.ZipInfo(name)
            found.compress_type = self.method
            return found

        def close() -> None:
            nonlocal buffer, pack
            if pack is not None:
                pack.close()
                names.append(f"{attempt}-{len(names):05d}.zip")
                with fs.open_output_stream(f"{base}/{names[-1]}") as out:
                    out.write(buffer.getbuffer())
                buffer = pack = None

        def finish() -> None:
            nonlocal buffer, pack
            if pack is None:
                buffer = io.BytesIO()
                pack = zipfile.ZipFile(buffer, "w", allowZip64=True)
            pack.writestr(info(), b"".join(held))
            if buffer.tell() >= PACK_BYTES or len(pack.filelist) >= PACK_FILES:
                close()

        def rows():
            for batch in iterator:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)

        for name, run in groupby(rows(), key=lambda row: row[0]):
            held, size = [], 0
            for _, content in run:
                held.append(content or b"")
                size += len(held[-1])
                if size >= PACK_BYTES:
                    break
            else:
                finish()
                continue
            # A file that would fill an archive streams into one of its own.
            close()
            names.append(f"{attempt}-{len(names):05d}.zip")
            with fs.open_output_stream(f"{base}/{names[-1]}") as out, zipfile.ZipFile(_Stream(out), "w") as alone:
                with alone.open(info(), "w", force_zip64=True) as member:
                    for content in held:
                        member.write(content)
                    held = []
                    for _, content in run:
                        member.write(content or b"")
        close()
        return _Attempt(attempt, names)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.parts if message is not None else []:
                fs.move(f"{root}/{STAGED}/{message.name}/{name}", f"{root}/{name}")
        fs.create_dir(f"{root}/{STAGED}")
        fs.delete_dir(f"{root}/{STAGED}")

    def abort(self, messages) -> None:
        fs, root = filesystem(self.path)
        for message in messages:
            if message is not None:
                fs.delete_dir(f"{root}/{STAGED}/{message.name}")


class _Stream(io.RawIOBase):
    """A stream that is written from front to back, for archives."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)


def write_packed(rows: DataFrame, path: str, name: str, content: str, order: Sequence[Column | str] = (), compress: bool = True) -> None:
    """Write what ``write_named`` writes, with the files in zip archives below ``path``.

    An archive holds whole files under their own names, up to ``PACK_FILES`` of them or about
    ``PACK_BYTES``; a longer file has one to itself, into which its rows stream.
    """
    _need_empty(path)
    spark = rows.sparkSession
    spark.dataSource.register(PackedFiles)
    placed = rows.repartition(name).sortWithinPartitions(name, *order)
    placed.select(F.col(name).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).write.format("packed_files").option(
        "compress", str(compress).lower()
    ).mode("append").save(path)


def _packed(spark: SparkSession, path: str, read: Callable, schema: str) -> DataFrame:
    """Rows that ``read(archive, member)`` gives for the files in the archives below ``path``."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    packs = [(path, i.base_name) for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.endswith(".zip")]
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for folder, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    store, place = filesystem(f"{folder}/{pack}")
                    with store.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                        for member in archive.infolist():
                            yield from read(archive, member)

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    table = spark.createDataFrame(packs, "folder string, pack string")
    return table.repartition(max(1, len(packs))).mapInArrow(work, schema)


def packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line`` of the text files in the archives below ``path``."""

    def lines(archive, member):
        with archive.open(member) as file:
            for line in io.TextIOWrapper(file, "utf-8"):
                yield member.filename, line.removesuffix("\n")

    return _packed(spark, path, lines, "path string, line string")


def packed_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256, lines`` of the files in the archives below ``path``."""

    def described(archive, member):
        digest, lines = hashlib.sha256(), 0
        with archive.open(member) as file:
            while data := file.read(COPY_BYTES):
                digest.update(data)
                lines += data.count(b"\n")
        yield member.filename, member.file_size, digest.hexdigest(), lines

    return _packed(spark, path, described, MANIFEST + ", lines long")


# One document ----------------------------------------------------------------------


class DocumentParts(DataSource):
    """``format("document_parts")``: rows (section number, line), sorted within tasks.

    Parts are compressed, since they and the document are on disk at the same time.
    """

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PartWriter(self.options["path"])


class _PartWriter(_Staging):
    def write(self, iterator) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        attempt, task = uuid.uuid4().hex, TaskContext.get().partitionId()
        base = f"{root}/{STAGED}/{attempt}"
        fs.create_dir(base, recursive=True)
        parts: list[list] = []
        out = None
        for batch in iterator:
            lines = batch.column(1).cast(pa.large_binary()).to_pylist()
            at = 0
            # Lines of one section follow each other and are written together.
            for section, run in groupby(batch.column(0).to_pylist()):
                end = at + len(list(run))
                if not parts or parts[-1][0] != section:
                    if out is not None:
                        out.close()
                    parts.append([section, task, 0])
                    out = fs.open_output_stream(f"{base}/{section}", compression=PART_CODEC)
                data = (b",\n" if parts[-1][2] else b"") + b",\n".join(lines[at:end])
                out.write(data)
                parts[-1][2] += len(data)
                at = end
        if out is not None:
            out.close()
        return _Attempt(attempt, parts)


def _copy_parts(batches) -> Iterator[pa.RecordBatch]:
    """Copy parts to their places in a local file; writing the same bytes again is harmless."""
    done = 0
    for batch in batches:
        for source, target, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with filesystem(source)[0].open_input_stream(source, compression=PART_CODEC) as part, open(target, "r+b") as out:
                out.seek(at)
                while data := part.read(COPY_BYTES):
                    out.write(data)
            done += 1
    yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["parts"])


def write_document(lines: DataFrame, path: str, sections: Sequence[str], order: Sequence[str], head: dict | None = None, spent: DataFrame | None = None) -> int:
    """Write one JSON document of lists and give its size in bytes.

    ``lines`` has ``section``, one of ``sections``, and ``line``, an element as JSON text;
    elements stand in ``order``. ``head`` are single values that come first. Tasks write
    parts in the global order; the sums of their lengths give each part its place in the
    document, to which tasks copy it where files can be written at any place. On other
    stores one writer streams the parts in order. ``spent``, a stored table that is needed
    only for ``lines``, is discarded before the document takes its place on the disk.
    """
    _need_empty(path)
    spark = lines.sparkSession
    spark.dataSource.register(DocumentParts)
    rows = lines.withColumn("_section", F.coalesce(*[F.when(F.col("section") == s, i) for i, s in enumerate(sections)])).where("_section IS NOT NULL")
    placed = rows.repartitionByRange("_section", *order).sortWithinPartitions("_section", *order)
    staging = f"{path}.parts"
    with shuffles_removed(spark):
        placed.select("_section", "line").write.format("document_parts").mode("append").save(staging)
    if spent is not None:
        discard(spent)
    parts = sorted((section, task, attempt, size) for attempt, found in committed(staging) for section, task, size in found)

    fs, stage = filesystem(staging)
    pieces: list[tuple[int, bytes | str]] = []  # place, and text between parts or a part's file
    at = 0

    def put(piece: bytes | str, size: int) -> None:
        nonlocal at
        pieces.append((at, piece))
        at += size

    start = b"{" + b"".join(json.dumps(k).encode() + b":" + json.dumps(v).encode() + b",\n" for k, v in (head or {}).items())
    for i, name in enumerate(sections):
        start += json.dumps(name).encode() + b":[\n"
        for number, _, attempt, size in parts:
            if number == i:
                put(start, len(start))
                put(f"{stage}/{STAGED}/{attempt}/{i}", size)
                start = b",\n"
        start = b"\n],\n" if start == b",\n" else start + b"],\n"
    start = start.removesuffix(b",\n") + b"}\n"
    put(start, len(start))

    temporary = f"{stage}/document"
    if fs.type_name == "local":
        with open(temporary, "wb") as out:
            out.truncate(at)
            for place, piece in pieces:
                if isinstance(piece, bytes):
                    out.seek(place)
                    out.write(piece)
        copies = [(piece, temporary, place) for place, piece in pieces if isinstance(piece, str)]
        if copies:
            table = spark.createDataFrame(copies, "source string, target string, at long").repartition(len(copies), "source")
            table.mapInArrow(_copy_parts, "parts long").agg(F.sum("parts")).collect()
    else:
        with fs.open_output_stream(temporary) as out:
            for _, piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                with fs.open_input_stream(piece, compression=PART_CODEC) as part:
                    while chunk := part.read(COPY_BYTES):
                        out.write(chunk)
    fs.move(temporary, filesystem(path)[1])
    fs.delete_dir(stage)
    return at


# Ranges ----------------------------------------------------------------------------


class _Ranges:
    """Reads of a file by place, through a window of ``HEADER_BYTES``."""

    def __init__(self, file):
        self.file, self.start, self.window, self.read_bytes = file, 0, b"", 0

    def get(self, at: int, size: int) -> bytes:
        if at < self.start or at + size > self.start + len(self.window):
            self.file.seek(at)
            self.start, self.window = at, self.file.read(max(size, HEADER_BYTES))
            self.read_bytes += len(self.window)
        return self.window[at - self.start : at - self.start + size]


def image_size(get) -> tuple[int, int] | None:
    """Width and height of a PNG, BMP or JPEG file; ``get(at, size)`` gives its bytes.

    A JPEG file is a row of segments, by its standard: a marker (FF, any number of fill
    bytes FF, a code) and a two-byte length unless the code stands alone. Codes C0 to CF are
    frame headers but for C4, C8 and CC. Segments are stepped over, not read.
    """
    head = get(0, 26)
    if head[:4] == b"\x89PNG":
        return (int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")) if len(head) == 26 else None
    if head[:2] == b"BM":
        return (int.from_bytes(head[18:22], "little"), abs(int.from_bytes(head[22:26], "little", signed=True))) if len(head) == 26 else None
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:
        marker = get(at, 9)
        if len(marker) < 2 or marker[0] != 0xFF or marker[1] in (0xD9, 0xDA):
            return None
        code = marker[1]
        if code == 0xFF:
            at += 1
        elif code == 0x01 or 0xD0 <= code <= 0xD8:
            at += 2
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            return (int.from_bytes(marker[7:9], "big"), int.from_bytes(marker[5:7], "big")) if len(marker) == 9 else None
        elif len(marker) < 4:
            return None
        else:
            at += 2 + int.from_bytes(marker[2:4], "big")


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("width", "height", "bytes_read")]))
def header_of(path: pa.Array) -> pa.Array:
    """Size of the image at each path and the bytes read to find it."""
    rows = []
    for name in path.to_pylist():
        fs, place = filesystem(name)
        with fs.open_input_file(place) as file:
            ranges = _Ranges(file)
            size = image_size(ranges.get) or (None, None)
            rows.append({"width": size[0], "height": size[1], "bytes_read": ranges.read_bytes})
    return pa.array(rows, pa.struct([("width", pa.int64()), ("height", pa.int64()), ("bytes_read", pa.int64())]))


@F.arrow_udf(T.StringType())
def sha256_of(path: pa.Array) -> pa.Array:
    """SHA-256 of the file at each path, read in pieces."""
    found = []
    for name in path.to_pylist():
        fs, place = filesystem(name)
        digest = hashlib.sha256()
        with fs.open_input_stream(place) as file:
            while data := file.read(COPY_BYTES):
                digest.update(data)
        found.append(digest.hexdigest())
    return pa.array(found, pa.string())


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, width, height, bytes_read, sha256`` of the files below ``path``.

    Spark lists the files without contents. Sizes come from ranged reads of a few thousand
    bytes; whole files are read only where ``sha256`` is asked for.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed.withColumn("_h", header_of("path")).select("path", "length", "_h.*", sha256_of("path").alias("sha256"))


def packed_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, width, height, bytes_read`` of the images in the archives below
    ``path``, read by range."""

    def probed(archive, member):
        with archive.open(member) as file:
            ranges = _Ranges(file)
            size = image_size(ranges.get) or (None, None)
            yield member.filename, member.file_size, *size, ranges.read_bytes

    return _packed(spark, path, probed, "path string, length long, width long, height long, bytes_read long")

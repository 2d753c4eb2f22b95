"""Listing, opening and writing files inside tasks, on local or shared folders and on object stores.

Nothing here passes through the driver: folders and paths are rows of stored tables, and the task that holds a row
opens what it names. Local paths are opened as they are, others by the Arrow file system of their scheme.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import stat
import sys
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.functions import patterns as P
from lakeprofile.functions import scalar as S
from lakeprofile.session import ensure_checkpoint_dir

# The functions below run in Python workers, where this package need not be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDERS_PER_TASK = 64
PATHS_PER_TASK = 10_000
BYTES_PER_TASK = 128 << 20
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4_096
HEAD_BYTES = 4 * P.DIGIT_SAMPLE_CHARS  # hold as many characters of any encoding
NON_TEXT = re.compile(P.NON_TEXT.encode("latin-1"))

LISTING = "path string, length bigint, modificationTime timestamp, error_kind string, error string"


class Failure(NamedTuple):
    """Why a file cannot be used: vanished or unreadable, and the message."""

    kind: str
    message: str

    @classmethod
    def of(cls, error: Exception) -> Failure:
        return cls("vanished" if isinstance(error, FileNotFoundError) else "unreadable", f"{type(error).__name__}: {error}")


class Entry(NamedTuple):
    path: str
    folder: bool
    length: int | None
    modified: int | None  # microseconds; whole milliseconds, as records keep them
    failure: Failure | None = None


# ---- file systems


def local_name(path: str) -> str | None:
    """The path of a local file, None for other stores."""
    if re.match(r"^file:/", path):
        return "/" + path[len("file:") :].lstrip("/")
    return None if re.match(r"^[a-zA-Z][\w+.-]*://", path) else path


def canonical(path: str) -> str:
    """One name for one file: local ones absolute, with their scheme."""
    name = local_name(path)
    return path if name is None else "file:" + os.path.abspath(name)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its name there."""
    name = local_name(path)
    if name is not None:
        return fs.LocalFileSystem(), name
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}")
    return system, f"{base.rstrip('/')}/{inner}"


def _time(nanoseconds: int | None) -> int | None:
    return None if nanoseconds is None else nanoseconds // 1_000_000 * 1_000


def _entry(path: str) -> Entry:
    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        return Entry(path, False, None, None, Failure("vanished", "no such file"))
    if info.type == fs.FileType.Directory:
        return Entry(path, True, None, None)
    return Entry(path, False, info.size, _time(info.mtime_ns))


def entries(folder: str) -> Iterator[Entry]:
    """What lies in a folder itself. Links to folders are not followed; of other links the target counts."""
    name = local_name(folder)
    if name is None:
        system, inner = opened(folder)
        for info in system.get_file_info(fs.FileSelector(inner)):
            is_folder = info.type == fs.FileType.Directory
            yield Entry(f"{folder.rstrip('/')}/{info.base_name}", is_folder, None if is_folder else info.size, _time(info.mtime_ns))
        return
    with os.scandir(name) as found:  # one entry at a time, however many there are
        for item in found:
            path = f"{folder.rstrip('/')}/{item.name}".encode("utf-8", "replace").decode()
            try:
                if item.is_dir(follow_symlinks=False):
                    yield Entry(path, True, None, None)
                elif not item.is_dir():
                    facts = item.stat()
                    regular = stat.S_ISREG(facts.st_mode)
                    failure = None if regular else Failure("unreadable", "not a regular file")
                    yield Entry(path, False, facts.st_size, _time(facts.st_mtime_ns), failure)
            except OSError as error:
                yield Entry(path, False, None, None, Failure.of(error))


# ---- listing


def _batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded rows and bytes."""
    held, weight = [], 0
    for row in rows:
        if held and (len(held) >= BATCH_ROWS or weight + size(row) > BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
        held.append(row)
        weight += size(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_TIME = pa.timestamp("us", "UTC")
_FOUND = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("modificationTime", _TIME), ("error_kind", pa.string()), ("error", pa.string()), ("folder", pa.bool_())]
)


def _row(entry: Entry) -> tuple:
    kind, message = entry.failure or (None, None)
    return entry.path, entry.length, entry.modified, kind, message, entry.folder


def _list_folders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    yield from map(_row, entries(folder))
                except OSError as error:
                    yield _row(Entry(folder, False, None, None, Failure.of(error)))

    return _batches(rows(), _FOUND)


def _look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path in map(canonical, batch.column(0).to_pylist()):
                try:
                    found = _entry(path)
                    yield _row(found._replace(folder=False, failure=Failure("unreadable", "a folder")) if found.folder else found)
                except OSError as error:
                    yield _row(Entry(path, False, None, None, Failure.of(error)))

    return _batches(rows(), _FOUND)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder of this session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: every use sees the same rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, error_kind, error) of all files below a folder, breadth first.

    A round lists the folders that the round before it found, in tasks, and stores what it finds; the driver sees
    counts only. Files without bytes, names that begin with ``_`` and files in hidden folders are listed; names that
    begin with a dot are not. A folder that cannot be listed gives one row with its error.
    """
    base, schema = new_folder(spark, "listing"), f"{LISTING}, folder boolean"
    level, rounds = spark.createDataFrame([(canonical(root),)], "path string"), []
    folders = 1
    while folders:
        tasks = -(-folders // FOLDERS_PER_TASK)
        rounds.append(f"{base}/round-{len(rounds)}")
        level.repartition(tasks, "path").mapInArrow(_list_folders, schema).write.parquet(rounds[-1])
        level = spark.read.schema(schema).parquet(rounds[-1]).where("folder").select("path")
        folders = level.count()
    found = spark.read.schema(schema).parquet(*rounds).where("not folder").drop("folder")
    return found.where(~S.is_hidden(S.file_name(F.col("path"))) | F.col("error").isNotNull())


def list_paths(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """`list_tree` for the files that the rows of (path) name; repeated names count once. Looked up in tasks, stored."""
    named = paths.select(F.col("path").cast("string")).where("path is not null").distinct()
    found = named.mapInArrow(_look_up, f"{LISTING}, folder boolean").drop("folder")
    return stored(found.dropDuplicates(["path"]), "listing")


# ---- reading


def spread(listing: DataFrame, *by: str, most: int = BYTES_PER_TASK) -> DataFrame:
    """The listing dealt to tasks of bounded bytes (``most`` on average) and rows."""
    facts = listing.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(-(-(facts["bytes"] or 0) // most), -(-facts["n"] // PATHS_PER_TASK), 1)
    cores = listing.sparkSession.sparkContext.defaultParallelism
    return listing.repartition(int(max(tasks, min(cores, facts["n"], 64))), *(by or ("path",)))


def _read(path: str) -> tuple[bytes | None, str | None, str | None]:
    try:
        system, name = opened(path)
        with system.open_input_stream(name, compression=None) as stream:
            return stream.read(), None, None
    except OSError as error:
        return None, *Failure.of(error)


def read_listed(listing: DataFrame, *carried: str) -> DataFrame:
    """(path, modificationTime, length, content, error_kind, error) of the files of a listing, read by their paths.

    Meant for files that fit one row. A file that is gone or cannot be read has no content but its error, and the job
    goes on. ``carried`` names further columns of the listing to keep.
    """
    kept = ["path", "modificationTime", "length", *carried]
    rows = spread(listing).select(*kept)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def joined(batch: pa.RecordBatch, start: int, found: list[tuple]) -> pa.RecordBatch:
        columns = [c.slice(start, len(found)) for c in batch.columns]
        more = [pa.array(x, t) for x, t in zip(zip(*found), (pa.large_binary(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *more], names=[*kept, "content", "error_kind", "error"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found, held = 0, [], 0
            for path in batch.column(0).to_pylist():
                found.append(_read(path))
                held += len(found[-1][0] or b"")
                if held >= CHUNK_BYTES:  # a batch has less than this before its last file
                    yield joined(batch, start, found)
                    start, found, held = start + len(found), [], 0
            if found:
                yield joined(batch, start, found)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return rows.mapInArrow(read, f"{schema}, content binary, error_kind string, error string")


_PROBED = pa.schema(
    [("path", pa.string()), ("head", pa.binary()), ("checksum", pa.string()), ("bytes", pa.int64()), ("valid", pa.bool_()), ("binary", pa.bool_()), ("error_kind", pa.string()), ("error", pa.string())]
)


def _probe(path: str) -> tuple:
    digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
    head, total, valid, binary = b"", 0, True, False
    try:
        system, name = opened(path)
        with system.open_input_stream(name, compression=None) as stream:
            while chunk := stream.read(CHUNK_BYTES):
                digest.update(chunk)
                head = head if total else chunk[:HEAD_BYTES]
                total += len(chunk)
                binary = binary or NON_TEXT.search(chunk) is not None
                if valid:
                    try:
                        decoder.decode(chunk)
                    except UnicodeDecodeError:
                        valid = False
        if valid:
            try:
                decoder.decode(b"", final=True)
            except UnicodeDecodeError:
                valid = False
        return path, head, digest.hexdigest(), total, valid, binary, None, None
    except OSError as error:
        return path, None, None, None, None, None, *Failure.of(error)


def probe_listed(listing: DataFrame) -> DataFrame:
    """(path, head, checksum, bytes, valid, binary, error_kind, error) of files of any size, each read once in chunks.

    ``head`` are the leading bytes, ``valid`` says whether all bytes are UTF-8, ``binary`` whether some byte is one
    that texts do not have. One task reads a file from end to end, because its digest needs the bytes in order.
    """

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_probe(p) for b in batches for p in b.column(0).to_pylist()), _PROBED, lambda r: len(r[1] or b""))

    schema = "path string, head binary, checksum string, bytes bigint, valid boolean, binary boolean, error_kind string, error string"
    return spread(listing).select("path").mapInArrow(probe, schema)


# ---- lines


def lines_between(stream, start: int, stop: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line without its end) of the lines that begin in start..stop of an open file.

    Lines end with a line feed, a carriage return, or both; what follows the last end is a line unless it is empty.
    """
    at = start
    if start:
        # A line begins at ``start`` if the byte before it ends one: look for the first end from there on.
        stream.seek(start - 1)
        at = start - 1
        while at < stop:
            data = stream.read(chunk)
            if not data:
                return
            ends = [x for x in (data.find(b"\n"), data.find(b"\r")) if x >= 0]
            if ends:
                first = min(ends)
                at += first + 1
                if data[first : first + 1] == b"\r":
                    stream.seek(at)
                    at += stream.read(1) == b"\n"
                break
            at += len(data)
        else:
            return
    stream.seek(at)
    before: list[bytes] = []  # parts of a line that is not finished
    held, ahead = 0, b""
    while at < stop or held:
        data = ahead + stream.read(chunk)
        ahead = b""
        if data.endswith(b"\r"):  # the end of this line may be two bytes
            ahead = stream.read(1)
            if ahead == b"\n":
                data, ahead = data + ahead, b""
        if not data:
            if held:
                yield at, b"".join(before)
            return
        for piece in data.splitlines(keepends=True):
            if not held and at >= stop:
                return
            if piece[-1] not in b"\r\n":
                before.append(piece)
                held += len(piece)
                continue
            line = b"".join([*before, piece])
            yield at, line.rstrip(b"\r\n") if line.endswith(b"\r\n") else line[:-1]
            at += len(line)
            before, held = [], 0


_LINES = pa.schema([("path", pa.string()), ("valid", pa.bool_()), ("position", pa.int64()), ("line", pa.large_binary()), ("error_kind", pa.string()), ("error", pa.string())])


def read_lines(files: DataFrame, range_bytes: int = BYTES_PER_TASK) -> DataFrame:
    """(path, position, line, error_kind, error) of (path, length, valid), stored; ``position`` is the byte offset of a line.

    Files are read in ranges of bytes, in parallel, and a position belongs to the file: it does not depend on how the
    work was cut. Lines of files that are not UTF-8 throughout (``valid`` false) are read one character per byte. A file
    that fails meanwhile gives one row with its error and no line. The text is read once; later passes read what is
    stored here.
    """
    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)).cast("bigint")
    ranges = files.select("path", "valid", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range"))
    start = (F.col("range") * range_bytes).alias("start")
    # What is left of the file counts, so that small files share a task and a full range has one of its own.
    ranges = ranges.select("path", "valid", start, F.least(F.col("length") - start, F.lit(range_bytes)).alias("length"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.select(["path", "valid", "start"]).to_pylist():
                path, valid, start = row["path"], row["valid"], row["start"]
                try:
                    system, name = opened(path)
                    with system.open_input_file(name) as stream:
                        for position, line in lines_between(stream, start, start + range_bytes):
                            yield path, valid, position, line, None, None
                except OSError as error:
                    yield path, valid, None, None, *Failure.of(error)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _LINES, lambda r: len(r[3] or b"") + 64)

    schema = "path string, valid boolean, position bigint, line binary, error_kind string, error string"
    found = spread(ranges, "path", "start", most=range_bytes).mapInArrow(read, schema)
    text = F.when(F.col("valid"), F.col("line").cast("string")).otherwise(F.decode("line", "ISO-8859-1"))
    return stored(found.select("path", "position", text.alias("line"), "error_kind", "error"), "lines")


# ---- writing


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write the content of (path, content) to files of these relative paths below a folder, in tasks; returns (path).

    A file appears under its name when it is complete, so a task that is run again does no harm.
    """
    base = canonical(folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, made = [], set()
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = opened(f"{base}/{path}")
                draft = f"{name}.{uuid.uuid4().hex}"
                if (inside := os.path.dirname(name)) not in made:
                    system.create_dir(inside, recursive=True)
                    made.add(inside)
                with system.open_output_stream(draft, compression=None) as stream:
                    stream.write(content or b"")
                system.move(draft, name)
                names.append(f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return stored(files.select("path", "content").mapInArrow(write, "path string"), "written")

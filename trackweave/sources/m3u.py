"""m3u playlists as a sink and a source: ordered files written and read by many tasks.

Layout ``single``: every playlist is one ``<name>.m3u``, written by one task as a stream. Layout
``parts``: the lines are in ``<name>.00000.m3u``, ``<name>.00001.m3u`` ... in order, with a fixed number of
lines each, and ``<name>.m3u`` is an index that names them after a comment with that number; no task has more than
a part. Tasks write aside; when all are done, tasks move the files into place. No file is read by several tasks: the index
tells where the lines of a part stand. Where there are many small files, a task reads several.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from trackweave.session import store

# Lines of a numbered part in the layout "parts".
LINES_PER_PART = 1_000_000
LAYOUTS = ("single", "parts")
# First line of an index: a comment to players.
INDEX_MARK = "#PARTS:"
# Bytes read from a file at once.
CHUNK = 1 << 20
# Up to this many files are read by a task each; beyond it tasks take several files, up to so many bytes together.
READ_TASKS, READ_BYTES = 64, 1 << 24


@cache
def _filesystem(root: str):
    """(file system, prefix of its paths) for the scheme and authority of a URI; opened once per process."""
    return pafs.FileSystem.from_uri(root)


def _cut(path: str) -> tuple[str, str]:
    """(scheme and authority, the rest unparsed); the first is empty for local paths."""
    if path.startswith("file:"):
        return "", "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return "", path
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    return f"{scheme}://{authority}", inner


def open_filesystem(path: str):
    """(file system, path) for a plain path or a URI.

    Only scheme and authority are parsed: names may hold spaces, ``#``, ``?`` and ``%``.
    """
    root, inner = _cut(path)
    if not root:
        return pafs.LocalFileSystem(), inner
    fs, prefix = _filesystem(root.replace("s3a://", "s3://", 1))
    return fs, f"{prefix.rstrip('/')}/{inner}"


def outer_path(like: str, inner: str) -> str:
    """The full form of a file system's own path, in the form of the path ``like`` it was found under."""
    root, _ = _cut(like)
    if not root:
        return inner
    _, prefix = _filesystem(root.replace("s3a://", "s3://", 1))
    return f"{root}/{inner.removeprefix(prefix).lstrip('/')}"


@dataclass
class Written(WriterCommitMessage):
    """The folder aside one task has written its files to."""

    folder: str


class M3uWriter(DataSourceArrowWriter):
    def __init__(self, aside: str):
        self.aside = aside

    def write(self, iterator):
        fs, base = open_filesystem(self.aside)
        name_of_task = uuid.uuid4().hex
        folder = f"{base}/{name_of_task}"
        fs.create_dir(folder, recursive=True)
        stream, current, lines = None, None, 0
        for batch in iterator:
            names = batch.column("file")
            start = 0
            while start < len(names):
                name = names[start].as_py()
                # Rows come file by file: the run ends where the name changes.
                other = pc.index(pc.not_equal(names.slice(start), name), True).as_py()
                length = other if other >= 0 else len(names) - start
                if name != current:
                    if stream is not None:
                        stream.close()
                    stream, current, lines = fs.open_output_stream(f"{folder}/{name}"), name, 0
                text = "\n".join(batch.column("line").slice(start, length).to_pylist())
                stream.write((("\n" if lines else "") + text).encode("utf-8"))
                lines += length
                start += length
        if stream is not None:
            stream.close()
        return Written(name_of_task)

    def commit(self, messages):
        """Name the folders of the tasks that count: others may be left by failed attempts."""
        fs, base = open_filesystem(self.aside)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/committed") as out:
            out.write("\n".join(m.folder for m in messages if m is not None).encode("utf-8"))

    def abort(self, messages):
        _drop(self.aside)


def _drop(folder: str) -> None:
    fs, inner = open_filesystem(folder)
    if fs.get_file_info(inner).type == pafs.FileType.Directory:
        fs.delete_dir(inner)


def playlist_of(file_name: str) -> str:
    """Playlist a file belongs to: the name without ``.m3u`` and part number."""
    stem = file_name.removesuffix(".m3u")
    name, dot, number = stem.rpartition(".")
    return name if dot and len(number) == 5 and number.isdigit() else stem


@dataclass
class PlaylistFile:
    """A file whose lines belong to ``playlist`` from line ``first`` on."""

    path: str
    playlist: str
    first: int


@dataclass
class PlaylistFiles(InputPartition):
    """Files that one task reads."""

    files: list[PlaylistFile]


def share_files(files: list[tuple[PlaylistFile, int]]) -> list[PlaylistFiles]:
    """Files with their bytes, dealt to tasks: one each, or as many as hold ``READ_BYTES`` or an even share, if that is less."""
    if len(files) <= READ_TASKS:
        return [PlaylistFiles([file]) for file, _ in files]
    limit = min(READ_BYTES, sum(size for _, size in files) // READ_TASKS)
    tasks: list[PlaylistFiles] = []
    room = -1
    for file, size in files:
        if size > room:
            tasks.append(PlaylistFiles([]))
            room = limit
        tasks[-1].files.append(file)
        room -= size
    return tasks


def _lines(path: str) -> Iterator[list[str]]:
    """The lines of a file, in lists of bounded size; a line end at the end of the file begins no further line."""
    fs, inner = open_filesystem(path)
    with fs.open_input_stream(inner) as source:
        rest = b""
        while chunk := source.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            if whole:
                yield [w.removesuffix(b"\r").decode("utf-8") for w in whole]
        if rest:
            yield [rest.removesuffix(b"\r").decode("utf-8")]


def index_of(path: str) -> tuple[int, list[str]] | None:
    """(lines in a part, file names) if the file is an index."""
    found: list[str] = []
    for lines in _lines(path):
        if not found and not lines[0].startswith(INDEX_MARK):
            return None
        found += lines
    return (int(found[0].removeprefix(INDEX_MARK)), found[1:]) if found else None


class M3uReader(DataSourceReader):
    """A folder's playlists by the file; only indexes are read beforehand."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self):
        fs, base = open_filesystem(self.folder)
        infos = fs.get_file_info(pafs.FileSelector(base))
        sizes = {i.base_name: i.size for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(".m3u")}
        names = sorted(sizes)
        indexes = {n: found for n in names if playlist_of(n) == n.removesuffix(".m3u") and (found := index_of(f"{self.folder}/{n}"))}
        out, named = [], set()
        for name, (lines, parts) in indexes.items():
            named.update(parts)
            for number, part in enumerate(parts):
                out.append((PlaylistFile(f"{self.folder}/{part}", name.removesuffix(".m3u"), number * lines), sizes.get(part, 0)))
        for name in names:
            if name not in indexes and name not in named:
                out.append((PlaylistFile(f"{self.folder}/{name}", name.removesuffix(".m3u"), 0), sizes[name]))
        return share_files(out) or [None]

    def read(self, partition):
        if partition is None:
            return
        for file in partition.files:
            first = file.first
            for lines in _lines(file.path):
                numbers = pa.array(range(first, first + len(lines)), pa.int64())
                yield pa.record_batch([pa.array([file.playlist] * len(lines)), numbers, pa.array(lines)], ["playlist", "line_number", "line"])
                first += len(lines)


class M3uSink(DataSource):
    """``df.write.format("m3u")`` for rows (file, line), in each partition file by file; ``path`` is aside.

    ``spark.read.format("m3u").load(folder)``: (playlist, line_number, line), comments included.
    """

    @classmethod
    def name(cls):
        return "m3u"

    def schema(self):
        return "playlist string, line_number bigint, line string"

    def reader(self, schema):
        return M3uReader(self.options["path"])

    def writer(self, schema, overwrite):
        return M3uWriter(self.options["path"])


def _moved(aside: str, target: str):
    """Move every file of the folders into place; a repeated task finds some of them moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_filesystem(target)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                inner = f"{open_filesystem(aside)[1]}/{folder}"
                done = f"{inner}.moved"
                names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(inner))]
                kept = fs.get_file_info(done)
                if kept.type == pafs.FileType.File:
                    with fs.open_input_file(done) as source:
                        listed = source.read().decode("utf-8").split("\n")
                else:
                    listed = names
                    with fs.open_output_stream(done) as out:
                        out.write("\n".join(names).encode("utf-8"))
                for name in names:
                    fs.move(f"{inner}/{name}", f"{base}/{name}")
                yield pa.record_batch([pa.array([n for n in listed if n], pa.string())], ["file"])

    return run


def _deleted(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_filesystem(target)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                if fs.get_file_info(f"{base}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{base}/{name}")
            yield batch

    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The playlist files in a folder."""
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            fs, base = open_filesystem(folder)
            infos = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
            found = [i.base_name for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(".m3u")]
            yield pa.record_batch([pa.array(found, pa.string())], ["file"])


def _playlist(file: Column) -> Column:
    return F.regexp_replace(file, r"(\.\d{5})?\.m3u$", "")


def file_name(playlist: Column, pos: Column, layout: str, lines_per_part: int) -> Column:
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, not {layout!r}")
    if layout == "single":
        return F.concat(playlist, F.lit(".m3u"))
    part = F.lpad(F.floor((pos - 1) / lines_per_part).cast("string"), 5, "0")
    return F.concat(playlist, F.lit("."), part, F.lit(".m3u"))


def read_m3u(spark: SparkSession, folder: str) -> DataFrame:
    """(playlist, line_number, line) of every playlist in a folder, in either layout; no file is read by several tasks."""
    spark.dataSource.register(M3uSink)
    return spark.read.format("m3u").load(folder)


def write_m3u(
    rows: DataFrame, target: str, layout: str = "single", lines_per_part: int = LINES_PER_PART
) -> None:
    """Write rows (playlist, pos, line), ``pos`` from 1 without gaps: one shuffle by file, sorted by position.

    Files that a playlist had from an earlier run and does not have any more are deleted.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(M3uSink)
    target = target.rstrip("/")
    fs, base = open_filesystem(target)
    fs.create_dir(base, recursive=True)
    aside = f"{target}/_writing-{uuid.uuid4().hex}"
    file = file_name(F.col("playlist"), F.col("pos"), layout, lines_per_part)
    own = F.struct(file.alias("file"), F.col("pos").cast("bigint").alias("pos"), "line")
    if layout == "parts":
        # The first line of a part also enters the part's name into the index.
        index = F.concat("playlist", F.lit(".m3u")).alias("file")
        entry = F.struct(index, (F.floor((F.col("pos") - 1) / lines_per_part) + 1).alias("pos"), file.alias("line"))
        head = F.struct(index, F.lit(0).cast("bigint").alias("pos"), F.lit(f"{INDEX_MARK}{lines_per_part}").alias("line"))
        lines = F.when(F.col("pos") == 1, F.array(own, entry, head))
        lines = lines.when((F.col("pos") - 1) % lines_per_part == 0, F.array(own, entry)).otherwise(F.array(own))
        named = rows.select(F.inline(lines))
    else:
        named = rows.select(F.inline(F.array(own)))
    (
        named.repartition("file")
        # Names of parts begin alike: their hash decides sooner.
        .sortWithinPartitions(F.xxhash64("file"), "file", "pos", "line")
        .select("file", "line")
        .write.format("m3u")
        .mode("append")
        .save(aside)
    )
    former = store(spark.createDataFrame([(target,)], "folder string").mapInArrow(_names, "file string"))
    with fs.open_input_file(f"{open_filesystem(aside)[1]}/committed") as source:
        folders = [(f,) for f in source.read().decode("utf-8").split("\n") if f]
    count = max(1, min(len(folders), spark.sparkContext.defaultParallelism * 4))
    tasks = spark.createDataFrame(folders, "folder string").repartition(count, "folder")
    written = store(tasks.mapInArrow(_moved(aside, target), "file string"))
    playlists = written.select(_playlist(F.col("file")).alias("playlist")).distinct()
    stale = former.join(written, "file", "left_anti").withColumn("playlist", _playlist(F.col("file")))
    stale.join(playlists, "playlist", "left_semi").select("file").mapInArrow(_deleted(target), "file string").count()
    _drop(aside)

"""A stream over a watched folder in which a changed file is read again.

Spark's own file stream takes a file once, under its name. This reader's offset is the stamp (size and
time of change) of every file it has seen, so a file that has grown or was replaced comes again, whole;
rows of it that were handled before are dropped by their keys. Files are read in byte ranges, so a
huge file is many tasks, and never beyond the size they were listed with.

The offset, and so each batch's entry of the checkpoint, grows with the number of files in the folder:
move old files away. Paths are opened by pyarrow: local and mounted folders, and the schemes it knows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LAYOUT = "line string, value string, file_path string, file_name string, block bigint"
ENDINGS = (".csv", ".txt")
BLOCK_BYTES = 64 << 20
READ_BYTES = 1 << 20
# Lines and characters of a batch a task passes on.
BATCH_LINES = 8192
BATCH_CHARS = 16 << 20


def is_report(name: str) -> bool:
    """CSV and TXT files; documentation and hidden files are no incidents."""
    low = name.lower()
    return low.endswith(ENDINGS) and not low.startswith(("readme", ".", "_"))


def opened(path: str):
    """(file system, path on it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Block(InputPartition):
    """A byte range of a file; a line belongs to the block it starts in."""

    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        super().__init__((path, start, end, size))


def lines_of(stream, start: int, end: int, size: int) -> Iterator[str]:
    """Lines that start in [start, end) of a file of `size` bytes; line ends are \\n, \\r\\n or \\r, as Spark's are."""
    at = max(start - 1, 0)
    stream.seek(at)
    rest = b""
    skipping = start > 0
    while at < size:
        data = stream.read(min(READ_BYTES, size - at))
        if not data:
            break
        rest += data
        at += len(data)
        # a \r at the very end may be half of a line end
        whole = rest[:-1] if rest.endswith(b"\r") and at < size else rest
        parts = whole.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        tail = parts.pop() + rest[len(whole) :]
        begins, cut = at - len(rest), 0
        for part in parts:
            ended = cut + len(part)
            length = len(part) + (2 if rest[ended : ended + 2] == b"\r\n" else 1)
            cut += length
            if skipping:
                skipping = False
            elif begins >= end:
                return
            else:
                yield part.decode("utf-8", "replace")
            begins += length
        rest = tail
        if begins >= end and not skipping:
            return
    if rest and not skipping and at - len(rest) < end:
        yield rest.rstrip(b"\r").decode("utf-8", "replace")


def portions(lines: Iterator[str]) -> Iterator[list[str]]:
    """Lines in lists of bounded length; the last one may be empty, so there is one in any case."""
    held, chars = [], 0
    for line in lines:
        held.append(line)
        chars += len(line)
        if len(held) >= BATCH_LINES or chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    yield held


def _batch(lines: list, values: list, path: str | None, name: str, block: int | None) -> pa.RecordBatch:
    """Rows of LAYOUT from one block of one file."""
    rows = len(lines)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lines, pa.string()),
            pa.array(values, pa.string()),
            pa.array([path] * rows, pa.string()),
            pa.array([name] * rows, pa.string()),
            pa.array([block] * rows, pa.int64()),
        ],
        names=["line", "value", "file_path", "file_name", "block"],
    )


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.block_bytes = int(options.get("blockBytes", BLOCK_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, path = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.path: [f.size, f.mtime_ns] for f in found if f.is_file and is_report(f.base_name)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        blocks: list[InputPartition] = []
        for path, (size, changed) in sorted(end.items()):
            if start.get(path) == [size, changed]:
                continue
            step = self.block_bytes if path.lower().endswith(".csv") else max(size, 1)
            blocks += [Block(path, at, min(at + step, size), size) for at in range(0, size, step)]
        return blocks

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        path, start, end, size = partition.value
        system, _ = opened(self.folder)
        name = path.rsplit("/", 1)[-1]
        with system.open_input_file(path) as stream:
            if name.lower().endswith(".txt"):
                yield _batch([None], [stream.read(size).decode("utf-8", "replace")], None, name, None)
                return
            for lines in portions(lines_of(stream, start, end, size)):
                yield _batch(lines, [None] * len(lines), path, name, start)


class WatchedFolder(DataSource):
    """`readStream.format("watched_folder").load(folder)`; the option `blockBytes` sets the size of a task."""

    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return LAYOUT

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def watched_stream(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """New and changed files of a folder, in the columns of `dropfiles.mixed_stream`."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WatchedFolder)
    return spark.readStream.format("watched_folder").option("blockBytes", block_bytes).load(folder)

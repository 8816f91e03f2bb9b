"""Lines of index files as a data source, in batches and as a stream.

    spark.dataSource.register(IndexLines)
    spark.read.format("index_lines").load(folder)         # or readStream
    path string, line int, value string

A line keeps the path and the number that it has in its file, so that what is refused later says where it stands. Files are
read line by line by the tasks: small ones together, a large one alone; no file is held whole. Paths are
folders (searched to any depth) or files of any store that Arrow can open. A stream takes files in the order of their
times, so a file must be put in place under its name when it is complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LINES = "path string, line int, value string"
_ARROW = pa.schema([("path", pa.string()), ("line", pa.int32()), ("value", pa.string())])
#: Bytes of small files that one task reads, and lines of a batch.
TASK_BYTES, BATCH_LINES = 8 << 20, 4096


@dataclass
class Files(InputPartition):
    """Whole files for one task."""

    paths: tuple[str, ...]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def listed(path: str, suffix: str = "") -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, bytes) of the files below a path, in this order. Names that begin with _ or . are not data."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"index_lines: got no file or folder at {path}")
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    within = lambda x: x.path[len(root) :].split("/")
    data = [x for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not any(p[:1] in ("_", ".") for p in within(x))]
    return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in data)


def dealt(files: list[tuple[int, str, int]]) -> list[Files]:
    """Files by task, TASK_BYTES or one file each."""
    out, held, size = [], [], 0
    for _, path, n in files:
        if held and size + n > TASK_BYTES:
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(path)
        size += n
    return out + [Files(tuple(held))] if held else out


def lines_of(root: str, paths: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Lines, numbered from 1 in each file. A line ends with a newline, which is no part of it; bytes that are no UTF-8 become U+FFFD."""
    store, _ = _store(root)
    for path in paths:
        rows: list[tuple[int, str]] = []
        with store.open_input_stream(path) as raw:
            rest, number = b"", 0
            while chunk := raw.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for value in whole:
                    number += 1
                    rows.append((number, value.decode(errors="replace")))
                    if len(rows) >= BATCH_LINES:
                        yield _batch(path, rows)
                        rows = []
            if rest:
                rows.append((number + 1, rest.decode(errors="replace")))
        if rows:
            yield _batch(path, rows)


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    numbers, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(numbers, pa.int32()), pa.array(values, pa.string())], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.suffix)) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition.paths)


class _Stream(DataSourceStreamReader):
    """Offsets are (time, path) of the last file that was taken."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path, self.suffix)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        place = lambda x: (x["time"], x["path"])
        return dealt([x for x in listed(self.path, self.suffix) if place(start) < (x[0], x[1]) <= place(end)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition.paths)


class IndexLines(DataSource):
    """Options: path, suffix (of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "index_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> _Stream:  # noqa: N802
        return _Stream(self.options)

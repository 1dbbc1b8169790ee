"""A streaming source for files that grow: each trigger reads the bytes that were added since the one before.

An offset names, for each file, the end of its last complete line and a checksum of its first line. Files are listed and their last blocks looked at
on the driver; what was added is read by executors, in stretches of at most ``split`` bytes; short ones share a partition, up to that size and ``_FILES`` of them. A last line without its end waits for a later trigger. A
file that is shorter than before, or begins with another line, was written anew and is read from its start; one that was written anew and both begins with the same line
and is longer counts as grown. Paths are those of pyarrow's file systems: local ones, and URIs of stores that it knows.

An offset holds an entry for each file that is watched, so a folder may have as many files as a person's agents write, and no more than the driver lists.
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from engramite.plans.ship import ship_package

SCHEMA = "file string, position bigint, line string"
_BLOCK, _HEAD, _ROWS = 1 << 16, 4096, 1000
_FILES = 1000  # stretches of a partition at most


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def watched(system: fs.FileSystem, top: str, suffix: str, depth: int, within: str = "") -> list[fs.FileInfo]:
    """Files of a folder down to so many folders below it, whose names end in suffix and whose paths hold ``within``."""
    level, found = [top], []
    for _ in range(depth + 1):
        infos = [i for folder in level for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        found += [i for i in infos if i.type == fs.FileType.File and i.base_name.endswith(suffix) and within in i.path]
        level = [i.path for i in infos if i.type == fs.FileType.Directory]
    return sorted(found, key=lambda i: i.path)


def end_of_lines(file, size: int) -> int:
    """Where the last complete line ends, found from the end of the file."""
    at = size
    while at > 0:
        first = max(0, at - _BLOCK)
        file.seek(first)
        if (k := file.read(at - first).rfind(b"\n")) >= 0:
            return first + k + 1
        at = first
    return 0


class Stretches(InputPartition):
    """(path, where its new part starts, first, last) of each."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.top, self.suffix = options["path"], options.get("suffix", "transcript.jsonl")
        self.depth, self.split = int(options.get("depth", 3)), int(options.get("split", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, top = opened(self.top)
        out = {}
        for info in watched(system, top, self.suffix, self.depth):
            try:
                with system.open_input_file(info.path) as file:
                    if end := end_of_lines(file, file.size()):
                        file.seek(0)
                        out[info.path] = [end, zlib.crc32(file.read(min(end, _HEAD)).split(b"\n", 1)[0])]
            except FileNotFoundError:  # it went after it was listed
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        out, held, room = [], [], self.split
        for path, (last, head) in end.items():
            before, known = start.get(path, (0, head))
            first = before if known == head and before <= last else 0
            for at in range(first, last, self.split):
                upto = min(last, at + self.split)
                if held and (upto - at > room or len(held) == _FILES):
                    out.append(Stretches(held))
                    held, room = [], self.split
                held.append((path, first, at, upto))
                room -= upto - at
        return [*out, Stretches(held)] if held else out

    def read(self, part: Stretches) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the stretches."""
        system, _ = opened(self.top)
        rows: list[tuple[str, int, str]] = []
        for path, start, first, last in part.parts:
            with system.open_input_file(path) as file:
                at = first
                if at > start:  # a line that began before belongs to the stretch before
                    at -= 1
                    file.seek(at)
                    at += len(_line(file))
                file.seek(at)
                while at < last and (line := _line(file)):
                    if text := line.decode("utf-8", "replace").rstrip("\r\n"):
                        rows.append((path, at, text))
                    at += len(line)
                    file.seek(at)
                    if len(rows) == _ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _line(file) -> bytes:
    """One line from where the file stands, with its end."""
    parts = []
    while block := file.read(_BLOCK):
        k = block.find(b"\n")
        parts.append(block if k < 0 else block[: k + 1])
        if k >= 0:
            break
    return b"".join(parts)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])]
    return pa.RecordBatch.from_arrays(columns, names=["file", "position", "line"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def lines(spark: SparkSession, folder: str, suffix: str = "transcript.jsonl", depth: int = 3, split: int = 32 << 20) -> DataFrame:
    """A stream of (file, position of the line's first byte, line) over the files of a folder."""
    ship_package(spark)
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("suffix", suffix).option("depth", depth).option("split", split).load(folder)


def positions(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """How far each file was read, from the newest offset of a query's checkpoint."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return {}
    newest = max((int(name) for s in system.listStatus(folder) if (name := posixpath.basename(s.getPath().toString())).isdigit()), default=None)
    if newest is None:
        return {}
    text = spark.read.text(f"{checkpoint}/offsets/{newest}", wholetext=True).first()[0]
    return {path: at for path, (at, _) in json.loads(text.strip().split("\n")[-1]).items()}

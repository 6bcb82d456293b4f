"""``fasta`` as a data source: ``spark.read.format("fasta")`` and ``spark.readStream.format("fasta")``.

Files are cut into splits of bytes; a split holds the records whose header line begins in it, read on to the
record's end. Records are numbered inside the tasks by file and place, in the order of reading, so no text
moves and no file is read twice. Paths are those of pyarrow's file systems (local, file://, s3://, gs://,
hdfs://); of stores that only Spark reaches, ``files.read_fasta`` reads the same records.

Options: ``path`` (a file or a folder), ``glob`` (of names in a folder; *.fasta), ``splitBytes`` (64 MB)."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: record_ord is the file's number in the order of names, and the place of the header's line in it.
SCHEMA = "record_ord bigint, header string, sequence string, file string"
PLACE_BITS = 44  # 16 TB a file, half a million files


@dataclass
class Split(InputPartition):
    path: str
    number: int
    start: int
    end: int


def _listed(path: str, glob: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files, by name."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, glob)]
    else:
        found = []
    root = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://"
    return sorted((f"{root}{x.path}" if "://" in path else x.path, x.size, x.mtime_ns or 0) for x in found)


def splits(files: list[tuple[str, int, int]], size: int, first: int = 0) -> list[Split]:
    return [Split(path, first + i, at, min(at + size, total)) for i, (path, total, _) in enumerate(files) for at in range(0, total, size)]


def records(split: Split) -> Iterator[tuple[int, str, str, str]]:
    """The records whose header's line begins in the split. Lines are stripped, blank ones skipped; what comes
    before a file's first header is no record."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(split.path) if "://" in split.path else (fs.LocalFileSystem(), split.path)
    with io.BufferedReader(store.open_input_file(at), 1 << 20) as lines:
        place = max(0, split.start - 1)
        lines.seek(place)
        if split.start:
            place += len(lines.readline())  # the rest of a line that begins before
        header, body, begun = None, [], 0
        for line in lines:
            for part in re.split(rb"[\r\n]+", line):
                text = part.strip()
                if text.startswith(b">"):
                    if header is not None:
                        yield _record(split, begun, header, body)
                    if place >= split.end:
                        return
                    header, body, begun = text[1:], [], begun + 1 if header is not None and begun >= place else place
                elif header is not None and text:
                    body.append(text)
            place += len(line)
            if header is None and place >= split.end:
                return
        if header is not None:
            yield _record(split, begun, header, body)


def _record(split: Split, begun: int, header: bytes, body: list[bytes]) -> tuple[int, str, str, str]:
    return (split.number << PLACE_BITS) + begun, header.decode("utf-8", "replace"), b"".join(body).decode("utf-8", "replace").upper(), split.path


class FastaReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int, int]], size: int):
        self.files, self.size = files, size

    def partitions(self) -> list[Split]:
        return splits(self.files, self.size)

    def read(self, partition: Split) -> Iterator[tuple]:
        return records(partition)


class FastaStreamReader(DataSourceStreamReader):
    """New files, each once: those changed after the last offset, by time of change and name. record_ord's first
    part is the file's place in its micro-batch's folder listing, so it is unique within a batch."""

    def __init__(self, path: str, glob: str, size: int):
        self.path, self.glob, self.size = path, glob, size

    def _by_time(self) -> list[tuple[str, int, int]]:
        return sorted(_listed(self.path, self.glob), key=lambda f: (f[2], f[0]))

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = self._by_time()
        return {"time": files[-1][2], "name": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        lo, hi = (start["time"], start["name"]), (end["time"], end["name"])
        return splits([f for f in self._by_time() if lo < (f[2], f[0]) <= hi], self.size)

    def read(self, partition: Split) -> Iterator[tuple]:
        return records(partition)

    def commit(self, end: dict) -> None:
        pass


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, str, int]:
        if not self.options.get("path"):
            raise ValueError("a fasta source needs a path")
        return self.options["path"], self.options.get("glob", "*.fasta"), int(self.options.get("splitBytes", 64 << 20))

    def reader(self, schema) -> FastaReader:
        path, glob, size = self._settings()
        files = _listed(path, glob)
        if not files:
            raise FileNotFoundError(f"no FASTA files at {posixpath.join(path, glob)}")
        return FastaReader(files, size)

    def streamReader(self, schema) -> FastaStreamReader:
        return FastaStreamReader(*self._settings())


def register(spark: SparkSession) -> None:
    """Makes the ``fasta`` format known to a session."""
    spark.dataSource.register(FastaDataSource)

"""Long files as rows of chunks, so that no task holds a text.

A chunk's row has its bytes, the byte before them and as many after them as a first key looks
at; so chunks are read, keyed and numbered on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from suffloom.functions.kernel import FIRST_SYMBOLS
from suffloom.shipping import ship

SCHEMA = "text_id bigint, begin bigint, n bigint, bytes binary, before int, after binary"


@dataclass
class _Chunk(InputPartition):
    text_id: int
    path: str
    begin: int
    end: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _system(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File]
        out: list[InputPartition] = []
        for i, f in enumerate(sorted(files, key=lambda x: x.path)):
            out += [_Chunk(i, f.path, a, min(f.size, a + self.size), f.size) for a in range(0, f.size, self.size)]
        return out or [_Chunk(0, "", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.begin == p.end:
            return
        system, _ = self._system()
        with system.open_input_file(p.path) as f:
            f.seek(max(0, p.begin - 1))
            before = f.read(1)[0] if p.begin else 0
            body = f.read(p.end - p.begin)
            after = f.read(FIRST_SYMBOLS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p.text_id], pa.int64()), pa.array([p.begin], pa.int64()), pa.array([p.n], pa.int64()), pa.array([body], pa.binary()), pa.array([before], pa.int32()), pa.array([after], pa.binary())],
            names=["text_id", "begin", "n", "bytes", "before", "after"],
        )


class TextChunks(DataSource):
    """Format `text_chunks`: a file, or the files of a folder in the order of their paths. Option `size`: bytes of a chunk."""

    @classmethod
    def name(cls) -> str:
        return "text_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("size", 8 << 20)))


def read_chunks(spark: SparkSession, path: str, size: int = 8 << 20) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TextChunks)
    return spark.read.format("text_chunks").option("size", str(size)).load(path)

"""Suffix arrays as files of five-byte records, and texts as files, by Spark's Python data sources.

A `.sa5` result is a folder: record number r of a text is its r-th position, five bytes, least
byte first. Files are cut by rank, so that their order by name is the order of records, and
joined they are the array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from suffloom.functions.codecs import uint40_decode, uint40_encode
from suffloom.operators.ranking import competition_ranks
from suffloom.shipping import ship

_RECORD, _READ = 5, 5 * (1 << 18)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Piece(InputPartition):
    path: str
    first: int
    begin: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _system(self.path)
        files = system.get_file_info(fs.FileSelector(root))
        first, out = 0, []
        for f in sorted((x for x in files if x.base_name.startswith("part-")), key=lambda x: x.base_name):
            n = f.size // _RECORD
            out += [_Piece(f.path, first, a, min(n, a + self.records)) for a in range(0, n, self.records)]
            first += n
        return out or [_Piece("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.begin == p.end:
            return
        system, _ = _system(self.path)
        with system.open_input_file(p.path) as f:
            f.seek(p.begin * _RECORD)
            at = p.begin
            while at < p.end:
                values = uint40_decode(f.read(min(_READ, (p.end - at) * _RECORD)))
                rank = np.arange(p.first + at, p.first + at + len(values))
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(values)], names=["rank", "pos"])
                at += len(values)


class _Writer(DataSourceArrowWriter):
    """Rows of a partition are consecutive ranks in order; the file's name tells the first one."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, root = _system(path)
        from pyarrow import fs

        if system.get_file_info(root).type != fs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{path} is there already")
            system.delete_dir(root)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        system, root = _system(self.path)
        first, count, out, part = 0, 0, None, f"{root}/.{uuid.uuid4().hex}"
        try:
            for b in iterator:
                rank, pos = b.column("rank").to_numpy(), b.column("pos").to_numpy()
                if not len(rank):
                    continue
                if out is None:
                    first, out = int(rank[0]), system.open_output_stream(part)
                if rank[0] != first + count or (np.diff(rank) != 1).any():
                    raise ValueError("a partition's ranks aren't consecutive")
                out.write(uint40_encode(pos))
                count += len(rank)
        finally:
            if out is not None:
                out.close()
        if out is None:
            return _Written(None, 0, 0)
        name = f"part-{first:020d}"
        system.move(part, f"{root}/{name}")
        return _Written(name, first, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted((m for m in messages if m and m.name), key=lambda m: m.first)
        at = 0
        for m in done:
            if m.first != at:
                raise ValueError(f"ranks from {at} to {m.first} are missing or twice there")
            at += m.count

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _system(self.path)
        system.delete_dir_contents(root)


class Sa5(DataSource):
    """Format `sa5`: rank and pos of one text's suffix array. Option `records`: how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "sa5"

    def schema(self) -> str:
        return "rank bigint, pos bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", 1 << 24)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Sa5)


def write_sa5(array: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> None:
    """array: (rank, pos) of one text. Mode `append` asks for a new folder."""
    register(array.sparkSession)
    n = partitions or int(array.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    array.select("rank", "pos").repartitionByRange(n, "rank").sortWithinPartitions("rank").write.format("sa5").mode(mode).save(path)


def read_sa5(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("sa5").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, path, bytes): each file at path is a text; ids follow the order of paths."""
    files = spark.read.format("binaryFile").load(path)
    ids = competition_ranks(files.select("path"), ["path"], "text_id").select("path", "text_id")
    return files.join(ids, "path").select("text_id", "path", F.col("content").alias("bytes"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.operators.shared import fresh_path
from suffloom.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, and executors may be lost afterwards."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The path that open() takes, where the shared folder is mounted as a file system."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


_LOWER = bytes(range(256)).lower()


def lower_words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case; bytes.split() cuts at exactly the space and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def release_memory() -> None:
    """Hands freed memory back to the system; allocators keep it otherwise, and workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task. One thing at a time: the next operator's takes the last one's place."""
    if key not in _KEPT:
        _KEPT.clear()
        release_memory()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    """Frees what another operator has left in this worker; for tasks that need memory of their own and keep nothing."""
    if _KEPT:
        _KEPT.clear()
        release_memory()


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `limit` bytes of text; a longer text stays alone.
    After the last one, freed memory is handed back."""
    for b in batches:
        if b.num_rows <= 1 or b.nbytes <= limit:
            yield b
            continue
        sizes = np.zeros(b.num_rows, np.int64)
        for i, f in enumerate(b.schema):
            if pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
                sizes += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and size + n > limit:
                yield b.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        yield b.slice(begin)
    release_memory()


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; on executors too, as the tokenizer package is installed there."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))

"""The folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, if all of Spark runs on it, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="suffloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are made meanwhile, so that they can be removed before the process ends."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/suffloom-{name}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session ended before
            pass

    atexit.register(drop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it's there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, never by broadcast. Spark takes a table of suffixes for as small as the texts it's made from, and
    packed files for as small as they are: by its own choice it collects tables that grow with the input in the driver."""
    return left.join(right.hint("merge"), on, how)


def once(df: DataFrame, name: str) -> DataFrame:
    """df for several uses: as it is if it only reads files, else written first, so that it's computed once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    if all(line.lstrip(" :+-").startswith(("Project", "Filter", "Relation", "LocalRelation")) for line in plan):
        return df
    return written(df, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither compute it again nor need its executors."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)

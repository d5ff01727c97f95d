"""Random texts for tests and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_texts(spark: SparkSession, count: int, length: int, alphabet: bytes = bytes(range(256)), seed: int = 0) -> DataFrame:
    """(text_id, bytes): texts of `length` bytes drawn from the alphabet, the same ones for the same seed."""
    signs = F.array(*(F.lit(f"{b:02X}") for b in alphabet))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.element_at(signs, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(len(alphabet))) + 1).cast("int")))
    text = F.unhex(F.concat_ws("", drawn)) if length else F.lit(b"")
    return spark.range(count).select(F.col("id").alias("text_id"), text.alias("bytes"))

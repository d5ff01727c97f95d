"""python -m suffloom.cli FILE [-o OUT]: the suffix array of a file, or with --delete-byte the file without a byte."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from suffloom.functions.codecs import parse_size
from suffloom.functions.strings import delete_byte
from suffloom.operators.suffix_array import KERNEL_LIMIT, of_chunks, suffix_array
from suffloom.sources.chunks import read_chunks
from suffloom.sources.sa5 import write_sa5


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="suffloom", description="Writes the suffix array of a file as five-byte positions.")
    parser.add_argument("file")
    parser.add_argument("-o", "--output", help="default: FILE.sa5")
    parser.add_argument("-m", "--memory", type=parse_size, default=parse_size("3584Mi"), help="a hint: Spark's own settings decide; units k, M, G, T and Ki, Mi, Gi, Ti")
    parser.add_argument("-f", "--force", action="store_true", help="overwrite the output")
    parser.add_argument("-g", "--gap", metavar="FOLDER", help="where intermediate tables go, if spark.checkpoint.dir is unset; a folder that driver and executors share")
    parser.add_argument("-v", "--verbose", action="store_true", help="show the plan")
    parser.add_argument("--strategy", choices=["auto", "kernel", "windows", "doubling"], default="auto")
    parser.add_argument("--delete-byte", type=int, metavar="BYTE", help="write the file without this byte to standard output instead")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("suffloom").getOrCreate()
    if options.gap:
        spark.sparkContext.setCheckpointDir(options.gap)
    files = spark.read.format("binaryFile").load(options.file)
    texts = files.select(F.lit(0).cast("long").alias("text_id"), F.col("content").alias("bytes"))
    if options.delete_byte is not None:
        sys.stdout.buffer.write(texts.select(delete_byte(F.col("bytes"), options.delete_byte).alias("b")).first()["b"])
        return 0
    if options.strategy == "auto" and (files.agg(F.max("length")).first()[0] or 0) > KERNEL_LIMIT:
        array = of_chunks(read_chunks(spark, options.file)).select("rank", "pos")
    else:
        array = suffix_array(texts, options.strategy)
    if options.verbose:
        array.explain("formatted")
    write_sa5(array, options.output or f"{options.file}.sa5", "overwrite" if options.force else "append")
    return 0


if __name__ == "__main__":
    sys.exit(main())

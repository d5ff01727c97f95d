"""Blocks of a text: partial suffix arrays, greater-than bits, gaps and their bit vectors.

Each follows from the rank of a suffix in the whole text: suffixes are never compared again.
Zones are boolean columns over pos and n, so that any split can be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suffloom.operators.bwt import running
from suffloom.operators.shared import joined


def cut(parts: int, k: int) -> Column:
    """Where part k of so many equal parts of a text begins."""
    return F.floor(F.col("n") * k / parts).cast("long")


def zone(parts: int, k: int, end: int | None = None) -> Column:
    """Positions of part k, or of the parts from k to before `end`."""
    return (F.col("pos") >= cut(parts, k)) & (F.col("pos") < cut(parts, k + 1 if end is None else end))


def block_ranges(sizes: DataFrame, block_size: int) -> DataFrame:
    """(text_id, block_id, beg, end) of (text_id, n): half-open, the last one as short as it must be."""
    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block_size) - 1)
    each = sizes.where("n > 0").select("text_id", "n", F.explode(blocks).alias("b"))
    return each.select("text_id", F.col("b").cast("int").alias("block_id"), (F.col("b") * block_size).alias("beg"), F.least((F.col("b") + 1) * block_size, "n").alias("end"))


def half_ranges(blocks: DataFrame, memory: int) -> DataFrame:
    """blocks (text_id, block_id, beg, end, n) with `mid`, where the right half begins. A block is halved, but the text's
    last one has a left part of a tenth of `memory`; the left part has a byte at least, the right one may be empty."""
    size = F.col("end") - F.col("beg")
    left = F.when(F.col("end") == F.col("n"), F.least(size, F.lit(max(1, memory // 10)))).otherwise(F.greatest(F.lit(1), F.floor(size / 2)))
    return blocks.withColumn("mid", (F.col("beg") + left).cast("long"))


def aligned_ranges(sizes: DataFrame, most: int, unit: int) -> DataFrame:
    """(text_id, block_id, beg, end) of (text_id, n): at most `most` blocks of one size, a multiple of `unit` (but no
    longer than the text), counted from the text's end, so that the first one is the short one."""
    size = F.least("n", F.ceil(F.ceil(F.col("n") / most) / unit) * unit)
    each = sizes.where("n > 0").withColumn("size", size).withColumn("count", F.ceil(F.col("n") / F.col("size")))
    each = each.select("text_id", "n", "size", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("b"))
    end = F.col("n") - (F.col("count") - 1 - F.col("b")) * F.col("size")
    return each.select("text_id", F.col("b").cast("int").alias("block_id"), F.greatest(F.lit(0).cast("long"), end - F.col("size")).alias("beg"), end.cast("long").alias("end"))


def partial_arrays(suf: DataFrame, block_size: int) -> DataFrame:
    """(text_id, block_id, rank, off): each block's suffixes in order of the whole text's; off is from the block's begin."""
    block = F.floor(F.col("pos") / block_size)
    rows = suf.withColumn("block_id", block.cast("int"))
    rank = F.row_number().over(Window.partitionBy("text_id", "block_id").orderBy("rank")) - 1
    return rows.select("text_id", "block_id", rank.cast("long").alias("rank"), (F.col("pos") % block_size).alias("off"))


def zone_array(suf: DataFrame, where: Column, large: bool = False) -> DataFrame:
    """(text_id, k, pos, sym, prev): a zone's suffixes; k is the place among them."""
    rows = suf.where(where).select("text_id", "rank", "pos", "sym", "prev")
    return running(rows, ["text_id"], "rank", F.lit(1), "k", large).select("text_id", "k", "pos", "sym", "prev")


def greater_than(suf: DataFrame, where: Column, at: Column) -> DataFrame:
    """(text_id, pos, gt): whether the suffix is greater than the one at `at`. The suffix at n is empty, and less than all."""
    mark = suf.where(F.col("pos") == at).select("text_id", F.col("rank").alias("mark"))
    rows = joined(suf.where(where).select("text_id", "pos", "rank"), mark, "text_id", "left")
    return rows.select("text_id", "pos", F.coalesce(F.col("rank") > F.col("mark"), F.lit(True)).alias("gt"))


def gt_begin(suf: DataFrame, begin: Column | None = None) -> DataFrame:
    """Against the suffix at the block's begin (by default the text's), for all later positions."""
    begin = F.lit(0) if begin is None else begin
    return greater_than(suf, F.col("pos") > begin, begin)


def gt_end(suf: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Against the suffix at the block's end, for the block's positions."""
    return greater_than(suf, (F.col("pos") >= begin) & (F.col("pos") < end), end)


def slots(suf: DataFrame, block: Column, tail: Column, large: bool = False) -> DataFrame:
    """(text_id, pos, slot) of tail suffixes: how many of the block's are less."""
    rows = suf.where(block | tail).select("text_id", "pos", "rank", block.alias("in_block"), tail.alias("in_tail"))
    rows = running(rows, ["text_id"], "rank", F.col("in_block").cast("int"), "slot", large)
    return rows.where("in_tail").select("text_id", "pos", "slot")


def initial_ranks(suf: DataFrame, block: Column, tail: Column, every: int, large: bool = False) -> DataFrame:
    """(text_id, pos, slot) at each `every`-th position of the tail: where a scan of the tail can set in, with the
    number of the block's suffixes that are less."""
    return slots(suf, block, tail, large).where(F.col("pos") % every == 0)


def gap(suf: DataFrame, block: Column, tail: Column, large: bool = False) -> DataFrame:
    """(text_id, slot, cnt): how many tail suffixes fall in front of the block's suffix number `slot`. Slots without any have no row."""
    return slots(suf, block, tail, large).groupBy("text_id", "slot").agg(F.count("*").alias("cnt"))


def dense_gap(gaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """gaps with rows of 0, for the slots 0 to size of (text_id, size)."""
    every = sizes.select("text_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size"))).alias("slot"))
    return joined(every, gaps, ["text_id", "slot"], "left").select("text_id", "slot", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def gap_chunks(dense: DataFrame, size: int, large: bool = False) -> DataFrame:
    """(text_id, chunk, total, before): a dense gap's sums over runs of `size` slots, and over all runs before."""
    sums = dense.groupBy("text_id", F.floor(F.col("slot") / size).alias("chunk")).agg(F.sum("cnt").alias("total"))
    return running(sums, ["text_id"], "chunk", F.col("total"), "before", large)


def zone_sizes(suf: DataFrame, where: Column) -> DataFrame:
    """(text_id, size), with 0 for texts that have nothing there."""
    return suf.groupBy("text_id").agg(F.sum(where.cast("long")).alias("size"))


def gap_bits(suf: DataFrame, block: Column, tail: Column, large: bool = False) -> DataFrame:
    """(text_id, i, bit): both zones' suffixes in order; 1 for the tail's."""
    rows = suf.where(block | tail).select("text_id", "rank", tail.alias("bit"))
    return running(rows, ["text_id"], "rank", F.lit(1), "i", large).select("text_id", "i", "bit")


def edited_bits(bits: DataFrame, changes: DataFrame) -> DataFrame:
    """bits (text_id, i, bit) after changes (text_id, i, change): set, reset or flip. At most one change for a bit; others stay."""
    now = F.when(F.col("change") == "set", True).when(F.col("change") == "reset", False).when(F.col("change") == "flip", ~F.col("bit")).otherwise(F.col("bit"))
    return joined(bits, changes, ["text_id", "i"], "left").select("text_id", "i", now.alias("bit"))


def packed_bits(bits: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(text_id, chunk, n, packed): runs of `size` bits (a multiple of 8), eight to a byte, the first one lowest; to be saved."""
    chunk = F.floor(F.col("i") / size).alias("chunk")
    octets = bits.groupBy("text_id", chunk, F.floor(F.col("i") % size / 8).alias("k")).agg(F.sum(F.expr("shiftleft(cast(bit as int), cast(i % 8 as int))")).alias("octet"), F.count("*").alias("n"))
    each = F.sort_array(F.collect_list(F.struct("k", F.lpad(F.hex("octet"), 2, "0").alias("x"))))
    return octets.groupBy("text_id", "chunk").agg(F.sum("n").alias("n"), F.unhex(F.concat_ws("", F.transform(each, lambda x: x["x"]))).alias("packed"))


def unpacked_bits(packed: DataFrame, size: int = 1 << 20) -> DataFrame:
    """packed_bits() back as (text_id, i, bit)."""
    at = packed.select("text_id", "chunk", "packed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    octet = F.conv(F.hex(F.substring("packed", (F.floor(F.col("j") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(octet, cast(j % 8 as int)) & 1") == 1
    return at.withColumn("octet", octet).select("text_id", (F.col("chunk") * size + F.col("j")).alias("i"), bit.alias("bit"))


def bit_ranks(bits: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, i, bit, rank1, rank0, nth): ones and noughts before i, and which of its kind the bit is (from 0): select(bit, nth) = i."""
    rows = running(bits, ["text_id"], "i", F.col("bit").cast("int"), "rank1", large)
    rows = rows.withColumn("rank0", F.col("i") - F.col("rank1"))
    return rows.select("text_id", "i", "bit", "rank1", "rank0", F.when(F.col("bit"), F.col("rank1")).otherwise(F.col("rank0")).alias("nth"))


def chunk_counts(bits: DataFrame, size: int) -> DataFrame:
    """(text_id, chunk, ones, before): ones in each run of `size` bits, and in all runs before."""
    sums = bits.groupBy("text_id", F.floor(F.col("i") / size).alias("chunk")).agg(F.sum(F.col("bit").cast("long")).alias("ones"))
    return running(sums, ["text_id"], "chunk", F.col("ones"), "before")


def prefix_search(dense: DataFrame, queries: DataFrame, large: bool = False) -> DataFrame:
    """(text_id, a, j, total): for queries (text_id, a), the least slot j with j + gap[0..j] >= a, and gap[0..j].

    j + gap[0..j] ascends with j, so each slot answers a run of values: these are joined by value, not by range.
    """
    rows = running(dense, ["text_id"], "slot", F.col("cnt"), "total", large, inclusive=True)
    reach = F.col("slot") + F.col("total")
    low = F.when(F.col("slot") == 0, F.lit(0).cast("long")).otherwise(reach - F.col("cnt"))
    answers = rows.select("text_id", F.col("slot").alias("j"), "total", F.explode(F.sequence(low, reach)).alias("a"))
    return joined(queries, answers, ["text_id", "a"]).select("text_id", "a", "j", "total")


def block_rank_matrix(suf: DataFrame, parts: int) -> DataFrame:
    """(text_id, row, col, cnt) for row < col: how many suffixes of part `row` are less than the one at part
    `col`'s end. One sort for a text: a running count for each part, read at the ends."""
    window = Window.partitionBy("text_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counted = suf.select("text_id", "pos", "n", *(F.coalesce(F.sum(zone(parts, r).cast("long")).over(window), F.lit(0)).cast("long").alias(f"c{r}") for r in range(parts)))
    cells = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.when(F.col("pos") == cut(parts, c + 1), F.col(f"c{r}")).alias("cnt")) for c in range(parts) for r in range(c)]
    read = counted.select("text_id", F.explode(F.array(*cells)).alias("cell")).select("text_id", "cell.*")
    return read.groupBy("text_id", "row", "col").agg(F.coalesce(F.max("cnt"), F.lit(0).cast("long")).alias("cnt"))

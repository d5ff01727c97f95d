"""The engine's queries over the given tables, with the SQL that has the same result.

Each runs over its whole table. Where SQL would compare all suffixes of long texts, which takes
quadratic time, a query has no SQL and is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.functions import codecs, strings
from suffloom.operators import blocks, bwt, index, merging, search
from suffloom.operators import suffix_array as sa
from suffloom.operators.shared import fresh_path, joined, once, written
from suffloom.sources import sa5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_SUFFIXES = """
each AS (SELECT text_id, h, n, unnest(range(CAST(n AS BIGINT))) AS pos FROM texts),
suf AS (SELECT text_id, h, n, pos, substr(h, 2 * pos + 1) AS suffix, CAST('0x' || substr(h, 2 * pos + 1, 2) AS INT) AS sym,
        CASE WHEN pos = 0 THEN 0 ELSE CAST('0x' || substr(h, 2 * pos - 1, 2) AS INT) END AS prev FROM each),
isa AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY suffix) - 1 AS rank FROM suf)"""


def _texts(table: str, key: str, column: str) -> str:
    return f"texts AS (SELECT CAST({key} AS BIGINT) AS text_id, hex(encode({column})) AS h, CAST(strlen({column}) AS BIGINT) AS n FROM {table} WHERE {column} IS NOT NULL),"


_PART = "WITH " + _texts("part", "p_partkey", "p_name") + _SUFFIXES
_NATION = "WITH " + _texts("nation", "n_nationkey", "n_name") + _SUFFIXES
_CORPUS = "WITH joined AS (SELECT 0 AS id, string_agg(text, chr(10) ORDER BY item_id) AS t FROM benchmark WHERE text IS NOT NULL)," + _texts("joined", "id", "t") + _SUFFIXES


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.texts_of(_table(spark, sf_dir, "part"), "p_partkey", "p_name")


def part_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffixes(part_texts(spark, sf_dir))


def nation_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffixes(sa.texts_of(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.texts_of(_table(spark, sf_dir, "documents"), "doc_id", "text")


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.corpus_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")


# Suffix arrays


@_query(_PART + "SELECT text_id, rank, pos FROM isa")
def sa_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(part_texts(spark, sf_dir))


@_query(_PART + "SELECT text_id, rank, pos FROM isa")
def sa_part_name_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(part_texts(spark, sf_dir), "windows")


@_query(_PART + "SELECT text_id, rank, pos FROM isa")
def sa_part_name_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(part_texts(spark, sf_dir), "doubling")


@_query(_CORPUS + "SELECT rank, pos FROM isa")
def sa_corpus_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(benchmark_corpus(spark, sf_dir), "doubling").select("rank", "pos")


@_query()
def sa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(document_texts(spark, sf_dir))


@_query()
def sa_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffix_array(sa.texts_of(_table(spark, sf_dir, "pages"), "page_id", "html"))


def _order(spark: SparkSession, sf_dir: str, name: str, key: str, column: str) -> DataFrame:
    return sa.order_faults_of_texts(sa.texts_of(_table(spark, sf_dir, name), key, column))


def _order_sql(name: str, key: str, column: str) -> str:
    return f"SELECT CAST({key} AS BIGINT) AS text_id, CAST(strlen({column}) AS BIGINT) AS n, CAST(strlen({column}) AS BIGINT) * (strlen({column}) - 1) // 2 AS positions, CAST(0 AS BIGINT) AS faults FROM {name} WHERE {column} <> ''"


@_query(_order_sql("documents", "doc_id", "text"))
def sa_documents_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That all suffixes of all documents are in order: SQL can't sort them, but knows what a right order must give."""
    return _order(spark, sf_dir, "documents", "doc_id", "text")


@_query(_order_sql("pages", "page_id", "html"))
def sa_pages_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir, "pages", "page_id", "html")


@_query(_PART + "SELECT text_id, pos, rank FROM isa")
def isa_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.inverse_suffix_array(part_texts(spark, sf_dir))


@_query(_PART + "SELECT text_id, pos, rank FROM isa WHERE pos % 4 = 0 OR pos = n - 1")
def isa_sampled_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.sampled(part_suffixes(spark, sf_dir), 4)


@_query(_CORPUS + "SELECT rank, pos FROM isa")
def sa5_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "sa5")
    sa5.write_sa5(sa.suffix_array(benchmark_corpus(spark, sf_dir)), path)
    return sa5.read_sa5(spark, path)


# Transform, counts, rank


@_query(_PART + "SELECT text_id, rank, prev AS sym FROM isa")
def bwt_part_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.bwt(part_suffixes(spark, sf_dir))


@_query(_PART + "SELECT text_id, rank AS i0 FROM isa WHERE pos = 0")
def bwt_i0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.primary_index(part_suffixes(spark, sf_dir))


@_query("SELECT CAST(p_partkey AS BIGINT) AS text_id, p_name AS text FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def inverse_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    suf = once(part_suffixes(spark, sf_dir), "suffixes")
    last = suf.where(F.col("pos") == F.col("n") - 1).select("text_id", F.col("sym").alias("last"))
    return bwt.inverse_bwt(bwt.bwt(suf), bwt.primary_index(suf), last).select("text_id", F.col("bytes").cast("string").alias("text"))


@_query(_PART + "SELECT text_id, sym, count(*) AS cnt FROM isa GROUP BY ALL")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.symbol_counts(part_suffixes(spark, sf_dir))


@_query("SELECT CAST('0x' || b AS INT) AS sym, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY ALL")
def byte_histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.byte_histogram(document_texts(spark, sf_dir))


@_query(_PART + "SELECT text_id, sym, cnt, CAST(coalesce(sum(cnt) OVER (PARTITION BY text_id ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM (SELECT text_id, sym, count(*) AS cnt FROM isa GROUP BY ALL)")
def c_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.c_array(part_suffixes(spark, sf_dir))


@_query(_PART + "SELECT text_id, rank, prev AS sym, row_number() OVER (PARTITION BY text_id, prev ORDER BY rank) - 1 AS occ FROM isa")
def rank_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.occurrences(part_suffixes(spark, sf_dir))


@_query(_PART + "SELECT text_id, rank, prev AS sym, row_number() OVER (PARTITION BY text_id, prev ORDER BY rank) - 1 AS occ FROM isa")
def rank_bwt_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.occurrences(part_suffixes(spark, sf_dir), large=True)


@_query(_PART + "SELECT q.text_id, q.rank AS i, q.sym, count(b.rank) AS occ FROM isa q LEFT JOIN isa b ON b.text_id = q.text_id AND b.prev = q.sym AND b.rank < q.rank GROUP BY ALL")
def rank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    suf = part_suffixes(spark, sf_dir)
    return bwt.rank_queries(suf, suf.select("text_id", F.col("rank").alias("i"), "sym"))


@_query(_PART + "SELECT text_id, rank, prev AS sym, ((row_number() OVER (PARTITION BY text_id, prev ORDER BY rank) - 1) // 2) * 2 AS occ FROM isa")
def rank_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.approximate_occurrences(part_suffixes(spark, sf_dir), 1)


@_query(_PART + "SELECT q.text_id, q.rank AS i, q.sym, count(b.rank) // 2 * 2 AS occ FROM isa q LEFT JOIN isa b ON b.text_id = q.text_id AND b.prev = q.sym AND b.rank < q.rank GROUP BY ALL")
def rank_approx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    suf = part_suffixes(spark, sf_dir)
    return bwt.approximate_rank(bwt.rank_samples(suf, 1), suf.select("text_id", F.col("rank").alias("i"), "sym"), 1)


@_query(_PART + "SELECT a.text_id, a.rank, b.rank AS lf FROM isa a JOIN isa b ON b.text_id = a.text_id AND b.pos = a.pos - 1")
def lf_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.lf_mapping(part_suffixes(spark, sf_dir))


# Search

_PATTERNS = ("e", "re", "bolt", " g", "old", "zz", "small anvil", "l")
_PATTERN_SQL = ", pats AS (SELECT unnest(range(%d))::INT AS pat_id, unnest([%s]) AS p)" % (len(_PATTERNS), ", ".join(f"'{p}'" for p in _PATTERNS))


def _patterns(spark: SparkSession, words: tuple[str, ...] = _PATTERNS) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(p.encode())) for i, p in enumerate(words)], "pat_id int, pat binary")


@_query(_PART + _PATTERN_SQL + "SELECT pat_id, count(isa.pos) AS cnt FROM pats LEFT JOIN isa ON starts_with(suffix, hex(encode(p))) GROUP BY pat_id")
def pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_counts(part_texts(spark, sf_dir), _patterns(spark))


@_query(
    _PART
    + _PATTERN_SQL
    + "SELECT text_id, pat_id, count(*) FILTER (WHERE substr(suffix, 1, 2 * strlen(p)) < hex(encode(p))) AS lo, count(*) FILTER (WHERE substr(suffix, 1, 2 * strlen(p)) <= hex(encode(p))) AS hi FROM isa, pats GROUP BY ALL"
)
def pattern_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_ranges(part_texts(spark, sf_dir), _patterns(spark))


@_query(_PART + "SELECT text_id, CAST(sum((substr(suffix, 1, 4) < hex(encode('re')))::INT) AS BIGINT) AS lo, CAST(sum((substr(suffix, 1, 4) <= hex(encode('re')))::INT) AS BIGINT) AS hi FROM isa GROUP BY ALL")
def pattern_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_range_of_rows(part_suffixes(spark, sf_dir), part_texts(spark, sf_dir), b"re")


@_query(_PART + _PATTERN_SQL + "SELECT text_id, pat_id, pos FROM isa JOIN pats ON starts_with(suffix, hex(encode(p)))")
def pattern_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_positions(part_texts(spark, sf_dir), _patterns(spark))


@_query(_PART + _PATTERN_SQL + "SELECT text_id, pat_id, pos, rank FROM isa JOIN pats ON starts_with(suffix, hex(encode(p)))")
def pattern_locate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a stored index: a scan of runs of keys."""
    stored = index.write_index(index.index_of(part_texts(spark, sf_dir)), fresh_path(spark, "index"))
    return index.occurrences(stored, _patterns(spark))


@_query(_PART + _PATTERN_SQL + "SELECT text_id, pat_id, min(rank) AS lo, max(rank) + 1 AS hi FROM isa JOIN pats ON starts_with(suffix, hex(encode(p))) GROUP BY ALL")
def pattern_range_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = index.write_index(index.index_of(part_texts(spark, sf_dir)), fresh_path(spark, "index"))
    return index.runs(stored, _patterns(spark))


_LONG = ("the", "e of the", "benchmark", "question and the answer", "th", "zz")


@_query(
    "WITH joined AS (SELECT 0 AS id, string_agg(text, chr(10) ORDER BY item_id) AS t FROM benchmark WHERE text IS NOT NULL), pats AS (SELECT unnest(range(%d))::INT AS pat_id, unnest([%s]) AS p) " % (len(_LONG), ", ".join(f"'{p}'" for p in _LONG))
    + "SELECT pat_id, count(*) FILTER (WHERE substr(t, i, strlen(p)) = p) AS cnt FROM pats, (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM joined) GROUP BY pat_id"
)
def pattern_count_corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one text by distributed doubling and a stored index; patterns of several pieces."""
    stored = index.write_index(index.index_of(benchmark_corpus(spark, sf_dir), "doubling"), fresh_path(spark, "index"))
    return index.counts(stored, _patterns(spark, _LONG))


_WORDS = ("e", "re", "tion", "the ", " of", "qu", "ción", "ß", "the and")


@_query(
    "WITH pats AS (SELECT unnest(range(%d))::INT AS pat_id, unnest([%s]) AS p) " % (len(_WORDS), ", ".join(f"'{p}'" for p in _WORDS))
    + "SELECT pat_id, CAST(sum((strlen(text) - strlen(replace(text, p, ''))) // strlen(p)) AS BIGINT) AS cnt FROM documents, pats GROUP BY pat_id"
)
def pattern_count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of the patterns overlaps itself, so that SQL can count by replacing."""
    return search.pattern_counts(document_texts(spark, sf_dir), _patterns(spark, _WORDS))


# Blocks: halves are [0, n // 2) and the rest, thirds likewise


@_query("SELECT CAST(p_partkey AS BIGINT) AS text_id, b::INT AS block_id, CAST(4 * b AS BIGINT) AS beg, CAST(least(4 * b + 4, n) AS BIGINT) AS \"end\" FROM (SELECT p_partkey, strlen(p_name) AS n, unnest(range((CAST(strlen(p_name) AS BIGINT) + 3) // 4)) AS b FROM part WHERE p_name IS NOT NULL)")
def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_ranges(part_texts(spark, sf_dir).select("text_id", F.octet_length("bytes").cast("long").alias("n")), 4)


@_query(_PART + "SELECT text_id, (pos // 4)::INT AS block_id, row_number() OVER (PARTITION BY text_id, pos // 4 ORDER BY suffix) - 1 AS rank, pos % 4 AS off FROM isa")
def partial_sa_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.partial_arrays(part_suffixes(spark, sf_dir), 4)


@_query(_PART + "SELECT text_id, pos, suffix > h AS gt FROM isa WHERE pos > 0")
def gt_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gt_begin(part_suffixes(spark, sf_dir))


@_query(_PART + "SELECT text_id, pos, suffix > substr(h, 2 * (n // 2) + 1) AS gt FROM isa WHERE pos < n // 2")
def gt_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gt_end(part_suffixes(spark, sf_dir), F.lit(0), blocks.cut(2, 1))


_SLOTS = """SELECT text_id, slot, count(*) AS cnt FROM (SELECT t.text_id, t.pos, count(b.pos) AS slot FROM isa t
    LEFT JOIN isa b ON b.text_id = t.text_id AND (%s) AND b.suffix < t.suffix WHERE %s GROUP BY t.text_id, t.pos) GROUP BY ALL"""


@_query(_PART + _SLOTS % ("b.pos < b.n // 2", "t.pos >= t.n // 2"))
def gap_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap(part_suffixes(spark, sf_dir), blocks.zone(2, 0), blocks.zone(2, 1))


@_query(_PART + _SLOTS % ("b.pos < b.n // 2", "t.pos >= t.n // 2"))
def gap_array_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap(part_suffixes(spark, sf_dir), blocks.zone(2, 0), blocks.zone(2, 1), large=True)


@_query(_PART + _SLOTS % ("b.pos < b.n // 3", "t.pos >= t.n // 3"))
def gap_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap(part_suffixes(spark, sf_dir), blocks.zone(3, 0), blocks.zone(3, 1, 3))


@_query(_PART + _SLOTS % ("b.pos >= b.n // 3 AND b.pos < b.n * 2 // 3", "t.pos >= t.n * 2 // 3"))
def gap_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap(part_suffixes(spark, sf_dir), blocks.zone(3, 1), blocks.zone(3, 2))


@_query(_PART + "SELECT t.text_id, t.pos, count(b.pos) AS slot FROM isa t LEFT JOIN isa b ON b.text_id = t.text_id AND b.pos < b.n // 2 AND b.suffix < t.suffix WHERE t.pos >= t.n // 2 AND t.pos % 3 = 0 GROUP BY ALL")
def initial_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.initial_ranks(part_suffixes(spark, sf_dir), blocks.zone(2, 0), blocks.zone(2, 1), 3)


_BITS = ", bits AS (SELECT text_id, rank AS i, pos >= n // 2 AS bit FROM isa)"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap_bits(part_suffixes(spark, sf_dir), blocks.zone(2, 0), blocks.zone(2, 1))


@_query(_PART + _BITS + "SELECT * FROM bits")
def gap_bitvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir)


@_query(
    _PART
    + _BITS
    + """SELECT text_id, i, bit, i - r0 AS rank1, r0 AS rank0, CASE WHEN bit THEN i - r0 ELSE r0 END AS nth
    FROM (SELECT *, count(*) FILTER (WHERE NOT bit) OVER (PARTITION BY text_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r0 FROM bits)"""
)
def bit_rank_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.bit_ranks(_bits(spark, sf_dir))


@_query(
    _PART
    + _BITS
    + """SELECT text_id, chunk, ones, CAST(coalesce(sum(ones) OVER (PARTITION BY text_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM (SELECT text_id, i // 4 AS chunk, CAST(sum(bit::INT) AS BIGINT) AS ones FROM bits GROUP BY ALL)"""
)
def bit_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chunk_counts(_bits(spark, sf_dir), 4)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    suf = once(part_suffixes(spark, sf_dir), "suffixes")
    gaps = blocks.gap(suf, blocks.zone(2, 0), blocks.zone(2, 1))
    return blocks.dense_gap(gaps, blocks.zone_sizes(suf, blocks.zone(2, 0)))


_DENSE_SQL = (
    ", gaps AS ("
    + _SLOTS % ("b.pos < b.n // 2", "t.pos >= t.n // 2")
    + "), every AS (SELECT text_id, unnest(range(n // 2 + 1)) AS slot FROM texts WHERE n > 0), dense AS (SELECT text_id, slot, coalesce(cnt, 0) AS cnt FROM every LEFT JOIN gaps USING (text_id, slot))"
)


@_query(
    _PART
    + _DENSE_SQL
    + """SELECT text_id, chunk, total, CAST(coalesce(sum(total) OVER (PARTITION BY text_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM (SELECT text_id, slot // 2 AS chunk, CAST(sum(cnt) AS BIGINT) AS total FROM dense GROUP BY ALL)"""
)
def gap_chunk_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap_chunks(_dense(spark, sf_dir), 2)


@_query(_PART + _DENSE_SQL + ", cum AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY text_id ORDER BY slot) AS BIGINT) AS total FROM dense) SELECT isa.text_id, isa.pos AS a, min(slot) AS j, min(total) AS total FROM isa JOIN cum ON cum.text_id = isa.text_id AND cum.slot + cum.total >= isa.pos GROUP BY ALL")
def gap_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = part_suffixes(spark, sf_dir).select("text_id", F.col("pos").alias("a"))
    return blocks.prefix_search(_dense(spark, sf_dir), queries)


@_query(
    _PART
    + """, cells AS (SELECT r::INT AS "row", c::INT AS col FROM range(3) a(r), range(3) b(c) WHERE r < c)
    SELECT t.text_id, "row", col, count(isa.pos) AS cnt FROM texts t CROSS JOIN cells LEFT JOIN isa ON isa.text_id = t.text_id
        AND isa.pos >= t.n * "row" // 3 AND isa.pos < t.n * ("row" + 1) // 3 AND isa.suffix < substr(t.h, 2 * (t.n * (col + 1) // 3) + 1)
    WHERE t.n > 0 GROUP BY ALL"""
)
def block_rank_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_rank_matrix(part_suffixes(spark, sf_dir), 3)


@_query(
    """SELECT *, CAST(CASE WHEN "end" = n THEN beg + least("end" - beg, 2) ELSE beg + greatest(1, ("end" - beg) // 2) END AS BIGINT) AS mid FROM
    (SELECT CAST(p_partkey AS BIGINT) AS text_id, b::INT AS block_id, CAST(4 * b AS BIGINT) AS beg, CAST(least(4 * b + 4, n) AS BIGINT) AS "end", CAST(n AS BIGINT) AS n
    FROM (SELECT p_partkey, strlen(p_name) AS n, unnest(range((CAST(strlen(p_name) AS BIGINT) + 3) // 4)) AS b FROM part WHERE p_name IS NOT NULL))"""
)
def half_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = part_texts(spark, sf_dir).select("text_id", F.octet_length("bytes").cast("long").alias("n"))
    return blocks.half_ranges(joined(blocks.block_ranges(sizes, 4), sizes, "text_id"), 20)


@_query(
    """SELECT text_id, b::INT AS block_id, CAST(greatest(0, n - (k - b) * size) AS BIGINT) AS beg, CAST(n - (k - 1 - b) * size AS BIGINT) AS "end" FROM
    (SELECT *, (n + size - 1) // size AS k, unnest(range((n + size - 1) // size)) AS b FROM
    (SELECT CAST(item_id AS BIGINT) AS text_id, CAST(strlen(text) AS BIGINT) AS n, least(CAST(strlen(text) AS BIGINT), ((CAST(strlen(text) AS BIGINT) + 4) // 5 + 15) // 16 * 16) AS size FROM benchmark WHERE text <> ''))"""
)
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sa.texts_of(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    return blocks.aligned_ranges(texts.select("text_id", F.octet_length("bytes").cast("long").alias("n")), 5, 16)


@_query(_PART + _BITS + "SELECT text_id, i, CASE i % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NOT bit ELSE bit END AS bit FROM bits")
def bit_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits set, reset, flipped and left, then saved eight to a byte and loaded again."""
    bits = _bits(spark, sf_dir)
    changes = bits.where("i % 4 < 3").select("text_id", "i", F.element_at(F.array(F.lit("set"), F.lit("reset"), F.lit("flip")), (F.col("i") % 4 + 1).cast("int")).alias("change"))
    return blocks.unpacked_bits(written(blocks.packed_bits(blocks.edited_bits(bits, changes), 8), "bits"), 8)


# The same on longer texts: benchmark items have some 240 bytes


_ITEMS = "WITH " + _texts("benchmark", "item_id", "text") + _SUFFIXES


def item_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.suffixes(sa.texts_of(_table(spark, sf_dir, "benchmark"), "item_id", "text"))


@_query(_ITEMS + "SELECT text_id, rank, prev AS sym FROM isa")
def bwt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.bwt(item_suffixes(spark, sf_dir))


@_query(_ITEMS + "SELECT a.text_id, a.rank, b.rank AS lf FROM isa a JOIN isa b ON b.text_id = a.text_id AND b.pos = a.pos - 1")
def lf_mapping_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.lf_mapping(item_suffixes(spark, sf_dir))


@_query(_ITEMS + _SLOTS % ("b.pos < b.n // 2", "t.pos >= t.n // 2"))
def gap_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gap(item_suffixes(spark, sf_dir), blocks.zone(2, 0), blocks.zone(2, 1))


@_query(_ITEMS + "SELECT text_id, rank, pos FROM isa")
def merge_k_way_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_parts(item_suffixes(spark, sf_dir), 4)


@_query(_ITEMS + "SELECT text_id, pos, suffix > h AS gt FROM isa WHERE pos > 0")
def gt_begin_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gt_begin(item_suffixes(spark, sf_dir))


# Merges


@_query(_PART + "SELECT text_id, rank, pos FROM isa")
def merge_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_halves(part_suffixes(spark, sf_dir))


@_query(_PART + "SELECT text_id, rank, pos FROM isa")
def merge_k_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_parts(part_suffixes(spark, sf_dir), 4)


@_query(_PART + "SELECT text_id, rank, prev AS sym FROM isa")
def merge_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_transforms(part_suffixes(spark, sf_dir))


@_query()
def merge_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(strings.merge_schedule(24), "blocks int, left_blocks int, cost double")


# Bytes and codecs


@_query("SELECT doc_id, replace(text, 'e', '') AS text FROM documents")
def delete_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", strings.delete_sign(F.col("text"), "e").alias("text"))


@_query("SELECT doc_id, replace(text, 'e', '') AS text FROM documents")
def delete_byte_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = strings.delete_byte(F.col("text").cast("binary"), ord("e"))
    return _table(spark, sf_dir, "documents").select("doc_id", kept.cast("string").alias("text"))


@_query(
    _PART
    + """SELECT text_id, pos, sym, CASE WHEN sym > last OR (sym = last AND (pos = n // 2 - 1 OR substr(h, 2 * pos + 3) > substr(h, 2 * (n // 2) + 1))) THEN sym + 1 ELSE sym END AS renamed, sym AS restored
    FROM (SELECT *, CAST('0x' || substr(h, 2 * (n // 2) - 1, 2) AS INT) AS last FROM isa WHERE pos < n // 2)"""
)
def rename_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    suf = once(part_suffixes(spark, sf_dir), "suffixes")
    half = blocks.cut(2, 1)
    last = suf.where(F.col("pos") == half - 1).select("text_id", F.col("sym").alias("last"))
    after = blocks.greater_than(suf, F.col("pos") <= half, half).select("text_id", (F.col("pos") - 1).alias("pos"), F.col("gt").alias("after"))
    rows = joined(joined(suf.where(F.col("pos") < half), last, "text_id"), after, ["text_id", "pos"], "left")
    rows = rows.withColumn("renamed", strings.renamed(F.col("sym"), F.col("last"), F.coalesce("after", F.lit(False)), F.col("pos") == half - 1))
    return rows.select("text_id", "pos", "sym", "renamed", strings.restored(F.col("renamed"), F.col("last")).alias("restored"))


@_query(_PART + "SELECT text_id, rank, concat(substr(x, 9, 2), substr(x, 7, 2), substr(x, 5, 2), substr(x, 3, 2), substr(x, 1, 2)) AS record, pos FROM (SELECT *, lpad(hex(pos), 10, '0') AS x FROM isa)")
def uint40_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_suffixes(spark, sf_dir).select("text_id", "rank", codecs.uint40_hex(F.col("pos")).alias("record"))
    return rows.withColumn("pos", codecs.uint40_unhex(F.col("record")))


@_query(
    _PART
    + _DENSE_SQL
    + """SELECT text_id, string_agg(CASE WHEN cnt < 128 THEN lpad(hex(cnt), 2, '0') ELSE lpad(hex(cnt % 128 + 128), 2, '0') || lpad(hex(cnt // 128), 2, '0') END, '' ORDER BY slot) AS code,
    list(cnt ORDER BY slot)::VARCHAR AS counts FROM dense GROUP BY ALL"""
)
def vbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("code string, counts string")
    def run(s: pd.Series) -> pd.DataFrame:
        codes = [codecs.vbyte_encode(np.array([x["cnt"] for x in sorted(v, key=lambda x: x["slot"])])) for v in s]
        return pd.DataFrame({"code": [c.hex().upper() for c in codes], "counts": [str(codecs.vbyte_decode(c).tolist()) for c in codes]})

    gaps = _dense(spark, sf_dir).groupBy("text_id").agg(F.collect_list(F.struct("slot", "cnt")).alias("gap"))
    return gaps.withColumn("x", run("gap")).select("text_id", "x.code", "x.counts")


@_query(_PART + _BITS + "SELECT text_id, string_agg(lpad(hex(byte), 2, '0'), '' ORDER BY k) AS packed, CAST(sum(ones) AS BIGINT) AS ones FROM (SELECT text_id, i // 8 AS k, CAST(sum(bit::INT << (i % 8)::INT) AS BIGINT) AS byte, sum(bit::INT) AS ones FROM bits GROUP BY ALL) GROUP BY ALL")
def bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.sum(F.expr("shiftleft(cast(bit as int), cast(i % 8 as int))"))
    packed = _bits(spark, sf_dir).groupBy("text_id", F.floor(F.col("i") / 8).alias("k")).agg(byte.alias("byte"), F.sum(F.col("bit").cast("long")).alias("ones"))
    each = F.sort_array(F.collect_list(F.struct("k", F.lpad(F.hex("byte"), 2, "0").alias("x"))))
    return packed.groupBy("text_id").agg(F.concat_ws("", F.transform(each, lambda x: x["x"])).alias("packed"), F.sum("ones").alias("ones"))


@_query(
    _NATION
    + """, top AS (SELECT text_id, max(suffix) AS m, any_value(n) AS n FROM isa GROUP BY text_id),
    periods AS (SELECT text_id, m, n, unnest(range(1, strlen(m)::BIGINT // 2 + 1)) AS p FROM top)
    SELECT text_id, n - strlen(m)::BIGINT // 2 AS start, min(p) AS period FROM periods WHERE substr(m, 2 * p + 1) = substr(m, 1, strlen(m)::BIGINT - 2 * p) GROUP BY ALL"""
)
def ms_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sa.texts_of(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    return texts.withColumn("m", strings.maximal_suffix_column(F.col("bytes"))).select("text_id", "m.start", "m.period")


@_query("SELECT CAST(o_orderkey AS BIGINT) AS x, CAST(floor(log2(o_orderkey)) AS INT) AS low, CAST(ceil(log2(o_orderkey)) AS INT) AS high FROM orders WHERE o_orderkey > 0")
def integer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").where(x > 0).select(x.alias("x"), codecs.log2_floor(x).cast("int").alias("low"), codecs.log2_ceil(x).cast("int").alias("high"))

"""Near-duplicates by SimHash fingerprints that differ in a few bits.

Fingerprints are indexed by their positional bytes. Two that differ in at most two bits share
at least six of eight bytes at the same positions, and so at least two of four byte pairs: each
distinct fingerprint is posted under the six couples of its byte pairs. Fingerprints in one
posting list are paired, their shared positional bytes tallied, pairs under the guaranteed
minimum dropped, and the others verified. Members of lists that are too long for pairs, as all
become when there are very many fingerprints, are posted again under longer keys: the 28 choices of
six bytes of eight, of which two that are close share one. At most 2**16 fingerprints can share such a
key; should its list still be too long, its members meet at the fingerprints one bit away,
which is exact, too, and takes 65 rows for each member instead of a square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suffloom.llm.common import fresh_path, lower_words_of, table, text_batches, written
from suffloom.llm.components import attach_components, connected_components
from suffloom.llm.store import ArrayStore

_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit by bit the majority of the shingles' XXH64; 0 for no words. Shingles count as often as they occur."""
    words = lower_words_of(text)
    n = len(words)
    if not n:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    joined = b" ".join(words)
    if n <= width:
        return _majority([digest(joined)])
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(x + 1 for x in ends[: n - width])]
    ends = ends[width - 1 :]
    if len(starts) <= _CHUNK:
        return _majority([digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)])
    bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        bits += _bits([digest(joined[a:b]) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK], strict=True)])
    return _packed(bits, len(starts))


def _bits(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)


def _packed(bits: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _majority(hashes: list[int]) -> int:
    return _packed(_bits(hashes), len(hashes))


def fingerprints(documents: DataFrame, key: str = "doc_id", width: int = 3) -> DataFrame:
    """Key and fingerprint (a signed long with the fingerprint's bits) of every row; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            out = np.array([fingerprint(x, width) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out)], names=[key, "fp"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, documents["text"].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _masks(bytes_: list[tuple[int, ...]]) -> list[int]:
    """Masks of the bytes at the given places, as signed longs."""
    out = [sum(0xFF << (8 * i) for i in places) for places in bytes_]
    return [x - (1 << 64) if x >> 63 else x for x in out]


#: Two of four byte pairs; six of eight bytes.
_SHORT = _masks([(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)])
_LONG = _masks(list(combinations(range(8), 6)))


def shared_bytes(a: str, b: str) -> Column:
    """How many of the eight bytes are the same at the same position."""
    xor = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.shiftrightunsigned(xor, 8 * i).bitwiseAND(0xFF) == 0).cast("int") for i in range(8))


def _paired(distinct: DataFrame, masks: list[int], bits: int, longest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) of verified pairs in posting lists of up to `longest` fingerprints, each pair once for all its
    lists; and the distinct members of longer lists. A posting's key is the fingerprint's bytes under a mask."""
    posting = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("p")) for k, m in enumerate(masks)))
    posted = distinct.select("fp", F.explode(posting).alias("at")).select("fp", "at.*")
    sizes = posted.groupBy("k", "p").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    posted = written(posted.join(sizes, ["k", "p"]), name)
    lists = posted.where(F.col("n") <= longest).groupBy("k", "p").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    x = lists.select("k", "l", F.posexplode("l").alias("i", "x")).select("k", "x", F.explode(F.slice("l", F.col("i") + 2, longest)).alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, k) for k, m in enumerate(masks)))  # a pair counts in the first list that holds it
    pairs = x.where((first == F.col("k")) & (shared_bytes("x", "y") >= 8 - bits) & (F.bit_count(differ) <= bits)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs, posted.where(F.col("n") > longest).select("fp").distinct()


def links(distinct: DataFrame, bits: int = 2, longest: int = 32) -> DataFrame:
    """(a, b): links between the column `fp` of distinct fingerprints, enough to join all that
    differ in at most `bits` bits (0 to 2), directly or over others at such a distance.

    Posting lists of up to `longest` fingerprints give their verified pairs. Members of longer
    lists are posted under longer keys. If a pair's first list is long, both are members of a long list
    and meet in the next step, where it counts once more at most. In the last step two that
    meet differ in at most two bits, and two that differ in at most two bits meet.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees shared bytes for up to 2 bits")
    pairs, hot = _paired(distinct, _SHORT, bits, longest, "postings")
    if bits == 0 or hot.isEmpty():
        return pairs
    more, hot = _paired(written(hot, "members"), _LONG, bits, longest, "long-postings")
    pairs = pairs.unionByName(more)
    if hot.isEmpty():
        return pairs
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("flip").bitwiseXOR(F.col("fp")).alias("at"))
    if bits == 1:
        near = near.withColumn("self", F.col("at") == F.col("fp"))
        own = near.where("self").select(F.col("at"), F.col("fp").alias("a"))
        more = own.join(near.where("NOT self").select("at", F.col("fp").alias("b")), "at").select("a", "b")
    else:
        low = near.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a")
        more = near.join(low, "at").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(more)


def near_duplicates(documents: DataFrame, key: str = "doc_id", width: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: key, fp (the fingerprint as a signed long) and component_id.

    component_id is the smallest key among all documents that can be reached over fingerprints
    that differ in at most `bits` bits. Equal fingerprints are one node, however many documents
    have them: copies never make pairs. Null, empty and wordless texts have fingerprint zero and
    link like any other. Repeated rows give a row each. A null key stays null and never names a
    component, unless all keys in it are null. An empty table gives an empty result. Other
    columns are ignored. Keys and fingerprints, not texts, are written to the shared folder.
    """
    rows = written(fingerprints(documents, key, width), "fingerprints")
    return component_rows(rows, key, lambda nodes: links(nodes, bits))


def component_rows(rows: DataFrame, key: str, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, fp and component_id for rows of key and fp. edges gives the links (a, b) between the distinct fp."""
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n")), "nodes")
    groups = connected_components(edges(nodes.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = groups.join(nodes, "fp")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = rooted.join(low, "root").select("fp", "component_id", "n")
    alone = nodes.where("n > 1").join(groups.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), "n")
    classes = written(linked.unionByName(alone), "classes")
    out = attach_components(rows, classes, "fp", "component_id")
    return out.select(key, "fp", F.coalesce("component_id", key).alias("component_id"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_keys(documents: DataFrame, keys: DataFrame, key: str, per_bucket: int = 1_000_000) -> DataFrame:
    """documents without the rows whose key (an integer) is among keys. Rows without a key stay.

    An anti-join would shuffle the texts. Instead the keys are written as sorted arrays to the
    shared folder, in buckets whose number grows with theirs, and each task looks its rows up in
    the mapped files.
    """
    spark = documents.sparkSession
    store = ArrayStore(fresh_path(spark, "keys"))
    n, buckets = keys.count(), 1
    while buckets * per_bucket < n:
        buckets *= 2

    def put(group: tuple, rows: pa.Table) -> pa.Table:
        store.put(f"{group[0].as_py()}.keys", np.unique(rows.column("k").to_numpy()).astype("<i8"))
        return pa.table({"bucket": pa.array([group[0].as_py()], pa.int64())})

    bucket = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets))
    there = keys.select(bucket.alias("bucket"), F.col(key).cast("long").alias("k")).groupBy("bucket").applyInArrow(put, "bucket bigint").collect()
    full = frozenset(r["bucket"] for r in there)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = b.column("__bucket").to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column("__key"), 0).to_numpy(zero_copy_only=False)
            drop = np.zeros(len(ids), bool)
            for k in np.unique(where):
                if k in full:
                    at = np.flatnonzero(where == k)
                    listed = store.get(f"{k}.keys", "<i8")
                    i = np.minimum(np.searchsorted(listed, ids[at]), len(listed) - 1)
                    drop[at] = listed[i] == ids[at]
            keep = pc.or_(pa.array(~drop), pc.is_null(b.column("__key")))
            yield b.select(kept).filter(keep)

    kept = documents.columns
    return documents.withColumns({"__bucket": bucket, "__key": F.col(key).cast("long")}).mapInArrow(run, documents.schema)


def keep_one_each(documents: DataFrame, key: str = "doc_id", width: int = 3, bits: int = 2) -> DataFrame:
    """documents without near-duplicates: of each group the row with the smallest key stays.

    Of rows that repeat a key one stays, if it is the smallest of its group. Rows without a key
    can't be named in a group, and stay. Columns are those of documents. Texts aren't shuffled,
    but for those whose key is repeated.
    """
    return keep_smallest(documents, near_duplicates(documents, key, width, bits), key)


def keep_smallest(documents: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Of each group (key, component_id) the row of documents with the smallest key; see keep_one_each."""
    found = written(groups.where(F.col(key).isNotNull()).select(key, "component_id"), "groups")
    stay = without_keys(documents, found.where(F.col("component_id") != F.col(key)).select(key).distinct(), key)
    repeated = found.where(F.col("component_id") == F.col(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if repeated.isEmpty():
        return stay
    again = written(repeated, "repeated")
    return without_keys(stay, again, key).unionByName(stay.join(again, key, "left_semi").select(*documents.columns).dropDuplicates([key]))

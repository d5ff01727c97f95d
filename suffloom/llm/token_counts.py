"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level BPE's pre-tokenizer starts a new piece at each white-space sign that follows
another sign, so a text may be cut there without changing its tokens. Batches are cut to
about equal bytes, long texts at such safe boundaries. Arrow splits a batch into units and
numbers the distinct ones; units seen before are answered from a bounded table, and the
library encodes the others, many to a string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from suffloom.llm.common import kept_in_worker, table, text_batches, vocabulary_path

#: Before one of these a text may be cut if the sign in front is no white space.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\r\t])")
#: White space in front of a space or newline: cutting there isn't safe, so the fast way is barred.
_UNSAFE = re.compile(r"  |\n\n|\n | \n|[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
#: The same for Arrow, where texts that begin with white space are barred, too.
_BARRED = r"^[ \n]|  |\n\n|\n | \n|[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks behind a letter, up to a space or the end, are a piece of their own to the pre-tokenizer. Latin letters are letters in all versions of Unicode.
_MARKS = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~]+)( |$)"
LONG_TEXT = 1 << 20
LONG_UNIT = 200


def units(text: str) -> list[str]:
    """Names of the units between safe boundaries, in order. NUL in front stands for a newline,
    SOH for nothing, and without either a space is to be put in front: so plain splitting does."""
    if _UNSAFE.search(text):
        return ["\x01" + x for x in _SAFE.split(text)]
    out = text.replace("\n", " \0").split(" ")
    if out[0] or len(out) == 1:
        out[0] = "\x01" + out[0]
        return out
    return out[1:]


def unit(name: str) -> str:
    """The text of a unit."""
    first = name[:1]
    return name[1:] if first == "\x01" else "\n" + name[1:] if first == "\0" else " " + name


def safe_pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """Pieces of at least `limit` signs, but for the last, cut at safe boundaries; they join to the text."""
    begin = 0
    while len(text) - begin > limit:
        m = _SAFE.search(text, begin + limit)
        if m is None:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def _longer(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class UnitTable:
    """Units by number, their tokens in one flat array (or only how many they are), up to `most` of them."""

    def __init__(self, path: str, lengths: bool, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths, self.most = lengths, most
        self.known: dict[str, int] = {}
        self.count = self.used = 0
        self.lens, self.begin, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        #: Strings of special tokens count as such, so that a text may not be cut within them.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.barred = "|".join([_BARRED, *map(re.escape, self.special)])
        self.odd = re.compile("|".join([r"[\s\x00\x01]", *map(re.escape, self.special)]))
        self.long: list[str] = []
        # A space begins a piece, and a newline between others is one.
        self.opens = {" ": np.zeros(size, bool), "\n": np.zeros(size, bool)}
        self.opens[" "][[i for x, i in vocabulary.items() if x[:1] == "Ġ"]] = True
        self.opens["\n"][[i for x, i in vocabulary.items() if x == "Ċ"]] = True
        self._encode(["\0", "", "\x01"])

    def _add(self, names: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        n = len(names)
        self.known.update(zip(names, range(self.count, self.count + n), strict=True))
        self.lens, self.begin = _longer(self.lens, self.count + n), _longer(self.begin, self.count + n)
        self.lens[self.count : self.count + n] = lens
        if not self.lengths:
            self.begin[self.count : self.count + n] = self.used + np.cumsum(lens) - lens
            self.flat = _longer(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.count += n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many tokens each unit has, all their ids)"""
        n = self.lens[numbers]
        if self.lengths or not len(n):
            return n, np.zeros(0, np.uint32)
        ends = np.cumsum(n)
        return n, self.flat[np.arange(ends[-1]) + np.repeat(self.begin[numbers] - (ends - n), n)]

    def _encode(self, names: list[str]) -> None:
        """One by one."""
        for k in range(0, len(names), 4096):
            some = names[k : k + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(list(map(unit, some)), add_special_tokens=False)]
            self._add(some, np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def _encode_joined(self, names: list[str], glue: str) -> None:
        """Many to a string; the tokens tell where a unit begins. Short strings, as the library's work on one grows faster than its length."""
        own = glue == " "
        for k in range(0, len(names), 4000):
            chunks = [names[j : j + 200] for j in range(k, min(k + 4000, len(names)), 200)]
            texts = [glue + glue.join(c if own else [x[1:] for x in c]) for c in chunks]
            for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                opens = self.opens[glue][ids]
                at = np.flatnonzero(opens)
                if len(at) != len(chunk):
                    self._encode(chunk)
                    continue
                lens = np.diff(at, append=len(ids))
                self._add(chunk, lens if own else lens - 1, ids if own else ids[~opens])

    def numbers(self, names: list[str], clean: bool) -> np.ndarray:
        """Units' numbers; they hold until trim(). clean: the units are distinct and hold no white space and no special token."""
        found = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        if not clean:
            new = list(dict.fromkeys(names[i] for i in missing))
            odd = [x for x in new if len(x) < 2 or x[:1] == "\0" or self.odd.search(x, x[:1] == "\x01")]
            self._encode(odd)
            new = set(new).difference(odd)
            self._encode_joined([x for x in new if x[:1] != "\x01"], " ")
            self._encode_joined([x for x in new if x[:1] == "\x01"], "\n")
            found[missing] = [self.known[names[i]] for i in missing]
        else:
            begun = np.array([names[i][:1] == "\x01" for i in missing])
            for at, glue in ((missing[~begun], " "), (missing[begun], "\n")):
                found[at] = self.count + np.arange(len(at))
                self._encode_joined([names[i] for i in at], glue)
        self.long += [names[i] for i in missing if len(names[i]) > LONG_UNIT]
        return found

    def trim(self) -> None:
        """After a batch: long units go; of too many, the half that was met first stays, as it holds the frequent ones."""
        for x in self.long:
            self.known.pop(x, None)
        self.long.clear()
        if self.count > self.most or self.used > 16 * self.most:
            self._cut(self.count // 2, 8 * self.most)

    def _cut(self, keep: int, most_ids: int) -> None:
        """Of the units met first `keep` stay, or as many halves fewer as have `most_ids` ids."""
        while keep > 3 and not self.lengths and self.begin[keep] > most_ids:
            keep //= 2
        keep = max(keep, 3)
        self.known = {x: k for x, k in self.known.items() if k < keep}
        self.count, self.used = keep, int(self.begin[keep]) if not self.lengths else 0

    def shrink(self, most: int = 50_000) -> None:
        """After a task: `most` units stay at most, in arrays of their size, as the worker outlives it."""
        if self.count > most:
            self._cut(most, 16 * most)
        self.lens, self.begin, self.flat = self.lens[: self.count].copy(), self.begin[: self.count].copy(), self.flat[: self.used].copy()

    def _slow(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for piece in safe_pieces(text, LONG_TEXT):
            yield self.gather(self.numbers(units(piece), False))
            self.trim()

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """For each text (null: empty) how many tokens it has, and their ids unless only lengths are kept."""
        column = pc.fill_null(column.cast(pa.string()), "")
        slow = pc.or_(pc.match_substring_regex(column, self.barred), pc.greater(pc.utf8_length(column), LONG_TEXT)).to_numpy(zero_copy_only=False)
        fast = column.filter(pa.array(~slow))
        total, end, ids = np.zeros(len(fast), np.int64), np.zeros(len(fast), np.int64), np.zeros(0, np.uint32)
        if len(fast):
            fast = pc.replace_substring(pc.binary_join_element_wise("\x01", fast, ""), "\n", " \0 \x01")
            split = pc.split_pattern(pc.replace_substring_regex(fast, _MARKS, "\\1 \x01\\2\\3"), " ")
            coded = split.flatten().dictionary_encode()
            distinct = coded.dictionary
            names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().split(" ")
            n, ids = self.gather(self.numbers(names, True)[coded.indices.to_numpy()])
            total = np.add.reduceat(n, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py())
            end = np.cumsum(total)
            self.trim()
        at = 0
        for i, is_slow in enumerate(slow.tolist()):
            if not is_slow:
                yield int(total[at]), ids[end[at] - total[at] : end[at]]
                at += 1
            else:
                found = [(int(n.sum()), x) for n, x in self._slow(column[i].as_py())]
                yield sum(n for n, _ in found), np.concatenate([x for _, x in found])


def unit_table(path: str, kind: str, **bounds: int) -> UnitTable:
    """One for each worker process: a later task finds it filled."""
    return kept_in_worker((path, kind), lambda: UnitTable(path, kind == "lengths", **bounds))


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    path: a byte-level BPE file of the tokenizers library, present at that path on all workers.
    No special tokens are added; strings of special tokens in a text are handled as the library
    does by default. Null and empty texts have 0 bytes and 0 tokens. Rows may repeat; each gives
    one row. Other columns are ignored. No shuffle: a text's counts come from its own row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unit_table(path, "lengths")
        for b in text_batches(batches, 2 << 20):
            texts = b.column("text")
            n = np.fromiter((x for x, _ in known.texts(texts)), np.int64, b.num_rows)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key), size, pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, documents["text"].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))

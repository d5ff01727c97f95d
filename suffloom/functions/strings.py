"""Functions of single texts: byte deletion, order-preserving renaming, maximal suffixes, merge schedules."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delete_byte(value: Column, byte: int = 255) -> Column:
    """A binary column without one of the 256 bytes. Null stays null."""
    drop = bytes([byte])

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else bytes(x).replace(drop, b""))

    return run(value)


def delete_sign(value: Column, sign: str) -> Column:
    """A string column without an ASCII sign, by a built-in function: in UTF-8 an ASCII byte is always a sign of its own."""
    if len(sign) != 1 or ord(sign) > 127:
        raise ValueError("one ASCII sign is asked for")
    return F.translate(value, sign, "")


def renamed(sym: Column, last: Column, greater_after: Column, is_last: Column) -> Column:
    """A block's symbol under the renaming that lets the block be sorted by itself: symbols over the
    block's last one, ones equal to it whose following suffix is greater than the block's end, and
    the last one itself go up by one."""
    return F.when((sym > last) | ((sym == last) & (greater_after | is_last)), sym + 1).otherwise(sym)


def restored(sym: Column, last: Column) -> Column:
    """The symbol before renamed()."""
    return F.when(sym > last, sym - 1).otherwise(sym)


def maximal_suffix(text: bytes) -> tuple[int, int]:
    """Where the greatest suffix begins, and its smallest period; (0, 0) for an empty text."""
    n = len(text)
    if not n:
        return 0, 0
    best, other, same, period = 0, 1, 0, 1
    while other + same < n:
        a, b = text[best + same], text[other + same]
        if a == b:
            same += 1
            if same == period:
                other += period
                same = 0
        elif a > b:
            other += same + 1
            same, period = 0, other - best
        else:
            best = other
            other, same, period = best + 1, 0, 1
    return best, period


def maximal_suffix_column(value: Column) -> Column:
    """maximal_suffix() of a binary column, as a struct of start and period."""

    @F.pandas_udf("start bigint, period bigint")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else maximal_suffix(bytes(x)) for x in s], columns=["start", "period"], dtype="Int64")

    return run(value)


def merge_schedule(blocks: int, ratio: float = 10.0, most_left: int = 0) -> list[tuple[int, int, float]]:
    """(n, left, cost) for each n up to `blocks`: into how many left blocks n are best split, when a merge
    costs its left blocks plus `ratio` times its right ones; the fewest left blocks of ties. most_left:
    how many left blocks a merge may have, 0 for any."""

    @lru_cache(maxsize=None)
    def best(n: int) -> tuple[float, int]:
        if n <= 1:
            return 0.0, 0
        most = min(n - 1, most_left or n - 1)
        return min((left + ratio * (n - left) + best(left)[0] + best(n - left)[0], left) for left in range(1, most + 1))

    return [(n, best(n)[1], best(n)[0]) for n in range(1, blocks + 1)]

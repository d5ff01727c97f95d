"""Compact encodings of integers and bits, and sizes with suffixes."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UINT40_MAX = (1 << 40) - 1


def uint40_encode(values: np.ndarray) -> bytes:
    """Five bytes a value, the least significant first."""
    v = np.asarray(values, np.int64)
    if len(v) and (v.min() < 0 or v.max() > UINT40_MAX):
        raise ValueError("value outside of 40 bits")
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def uint40_decode(raw: bytes) -> np.ndarray:
    if len(raw) % 5:
        raise ValueError("length is no multiple of five")
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1).astype(np.int64)


def vbyte_encode(values: np.ndarray) -> bytes:
    """Seven bits a byte, the low ones first; the high bit says that more follow."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k)) if 7 * k < 64 else 0
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max())):
        has = size > k
        out[starts[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def vbyte_decode(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    if b[-1] & 128:
        raise ValueError("the last value isn't complete")
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    index = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * index).astype(np.uint64), starts)


def bits_encode(bits: np.ndarray) -> bytes:
    """Eight bits a byte, the first one lowest."""
    return np.packbits(np.asarray(bits, bool), bitorder="little").tobytes()


def bits_decode(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


def parse_size(text: str) -> int:
    """A number of bytes: digits and, in either case, k, M, G, T (powers of 1000) or Ki, Mi, Gi, Ti (of 1024)."""
    m = re.fullmatch(r"(\d+)(?:([kmgt])(i?))?", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    power = " kmgt".index(m[2].lower()) if m[2] else 0
    return int(m[1]) * (1024 if m[3] else 1000) ** power


def uint40_hex(value: Column) -> Column:
    """The five bytes of a value as hex digits, by built-in functions."""
    digits = F.lpad(F.hex(value), 10, "0")
    return F.concat(*(F.substring(digits, 9 - 2 * k, 2) for k in range(5)))


def uint40_unhex(digits: Column) -> Column:
    return F.conv(F.concat(*(F.substring(digits, 9 - 2 * k, 2) for k in range(5))), 16, 10).cast("long")


def log2_floor(value: Column) -> Column:
    """Exact for all positive longs."""
    return F.length(F.bin(value)) - 1


def log2_ceil(value: Column) -> Column:
    return F.when(value <= 1, 0).otherwise(F.length(F.bin(value - 1)))

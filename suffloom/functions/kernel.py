"""Suffix sorting of whole texts in one process, with numpy.

Many texts are sorted at once: they are laid end to end, and a suffix ends where its own text
does. End of text is less than every byte, bytes compare as unsigned numbers.
"""

from __future__ import annotations

import numpy as np

#: So many symbols fit a 63-bit key in base 257 (a byte plus one; nought past the end).
FIRST_SYMBOLS = 7


def first_keys(symbols: np.ndarray, left: np.ndarray, count: int = FIRST_SYMBOLS) -> np.ndarray:
    """The first `count` symbols of each suffix as one number. left: bytes from there to its text's end."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    shifted = symbols.astype(np.int64) + 1
    for k in range(count):
        key *= 257
        if k < n:
            part = key[: n - k]
            part += np.where(left[: n - k] > k, shifted[k:], 0)
    return key


#: Texts that one sort takes: their number and a first key share 63 bits.
MOST_TEXTS = 1 << 14
_KERNEL_SYMBOLS = 6


def sort_suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, order): for text i, order[starts[i]:starts[i+1]] are its suffixes' positions, least first.

    Prefix doubling. A group of suffixes that share their first h symbols is sorted by the
    groups of the suffixes h further on; groups of one are done and not touched again. Each sort
    is over single numbers: text and first symbols, or group and following group.
    """
    if len(texts) > MOST_TEXTS:
        parts = [sort_suffixes(texts[k : k + MOST_TEXTS]) for k in range(0, len(texts), MOST_TEXTS)]
        ends = np.cumsum([s[-1] for s, _ in parts])
        starts = [parts[0][0], *(s[1:] + e for (s, _), e in zip(parts[1:], ends[:-1], strict=True))]
        return np.concatenate(starts), np.concatenate([o for _, o in parts])
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    if not n:
        return starts, np.zeros(0, np.int64)
    if n >= 1 << 31:
        raise ValueError("a batch of texts must be shorter than 2 GiB")
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = starts[1:][owner]
    place = np.arange(n, dtype=np.int64)
    key = first_keys(symbols, ends - place, _KERNEL_SYMBOLS)
    key += owner * np.int64(257**_KERNEL_SYMBOLS)
    order = np.argsort(key)
    k = key[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    size_of = np.diff(np.append(np.flatnonzero(first), n))
    open_slots = np.flatnonzero(np.repeat(size_of > 1, size_of))
    h = _KERNEL_SYMBOLS
    while len(open_slots):
        at = order[open_slots]
        after = at + h
        inside = after < ends[at]
        key = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key |= rank[at] << 32
        sub = np.argsort(key)
        at, key = at[sub], key[sub]
        order[open_slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        # A group's slots are consecutive, so a member's slot is its new rank if it begins a run.
        rank[at] = np.maximum.accumulate(np.where(new, open_slots, 0))
        size_of = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_slots = open_slots[np.repeat(size_of > 1, size_of)]
        h *= 2
    return starts, order - starts[owner]


def suffix_array(text: bytes) -> np.ndarray:
    return sort_suffixes([text])[1]


def interval(text: bytes, order: np.ndarray, pattern: bytes) -> tuple[int, int]:
    """The half-open run of slots whose suffixes begin with the pattern; if there is none, both ends
    are the slot of the first greater suffix."""
    return refine(text, order, 0, len(order), 0, pattern)


def refine(text: bytes, order: np.ndarray, lo: int, hi: int, known: int, pattern: bytes) -> tuple[int, int]:
    """The run of a pattern within the run [lo, hi) of its first `known` bytes; those aren't compared again."""
    rest = pattern[known:]

    def first_slot(after: bool) -> int:
        low, high = lo, hi
        while low < high:
            mid = (low + high) // 2
            head = text[order[mid] + known : order[mid] + len(pattern)]
            if head < rest or (after and head == rest):
                low = mid + 1
            else:
                high = mid
        return low

    return first_slot(False), first_slot(True)


def invert_bwt(symbols: np.ndarray, i0: int, last: int) -> bytes:
    """The text of a BWT. symbols: in slot order; i0: the slot of position 0, whose symbol doesn't
    count; last: the text's last byte, which precedes no suffix and so isn't among the symbols."""
    n = len(symbols)
    if not n:
        return b""
    real = np.flatnonzero(np.arange(n) != i0)
    counts = np.bincount(symbols[real], minlength=256)
    counts[last] += 1
    begin = np.cumsum(counts) - counts
    # The least suffix that begins with `last` is `last` alone; all others of it come after.
    start = int(begin[last])
    begin[last] += 1
    order = real[np.argsort(symbols[real], kind="stable")]
    grouped = symbols[order]
    first = np.searchsorted(grouped, np.arange(256))
    lf = np.full(n, -1, np.int64)
    lf[order] = begin[grouped] + np.arange(len(order)) - first[grouped]
    out, slot, steps = bytearray([last]), start, lf.tolist()
    for _ in range(n - 1):
        out.append(int(symbols[slot]))
        slot = steps[slot]
    out.reverse()
    return bytes(out)


#: Texts are rebuilt side by side while there are so many of them; the others one by one.
_SIDE_BY_SIDE = 32


def invert_bwts(symbols: np.ndarray, sizes: np.ndarray, i0: np.ndarray, last: np.ndarray) -> np.ndarray:
    """invert_bwt() of many texts, none of them empty, end to end: all of them take a step at once."""
    n, texts = int(sizes.sum()), np.arange(len(sizes))
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(texts, sizes)
    real = np.delete(np.arange(n), starts + i0)
    by = owner[real] * 256 + symbols[real]
    order = np.argsort(by, kind="stable")
    slots, by = real[order], by[order]
    # A slot's place among its text's symbols; the text's last byte goes before those that aren't less.
    lf = np.full(n, -1, np.int64)
    lf[slots] = np.arange(len(slots)) + owner[slots] + (symbols[slots] >= last[owner[slots]])
    slot = np.searchsorted(by, texts * 256 + last) + texts
    out = np.zeros(n, np.uint8)
    out[starts + sizes - 1] = last
    rank = np.argsort(-sizes, kind="stable")
    falling = -sizes[rank]
    starts, sizes, slot = starts[rank], sizes[rank], slot[rank]
    step = 1
    while (left := int(np.searchsorted(falling, -step))) >= _SIDE_BY_SIDE:  # texts of over `step` bytes
        at = slot[:left]
        out[starts[:left] + sizes[:left] - 1 - step] = symbols[at]
        slot[:left] = lf[at]
        step += 1
    for k in range(left):
        begin, size, at = int(starts[k]), int(sizes[k]), int(slot[k] - starts[k])
        steps = (lf[begin : begin + size] - begin).tolist()
        path = np.empty(size - step, np.int64)
        for j in range(size - step - 1, -1, -1):
            path[j] = at
            at = steps[at]
        out[begin : begin + size - step] = symbols[begin : begin + size][path]
    return out

"""Word features of many texts at once, as arrays: hashes of words and of their shapes."""

from __future__ import annotations

import numpy as np

from .common import Rolling

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Class of a byte in a word's shape: capitals A, small letters and bytes beyond ASCII a, digits 0, the rest itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:256], _CLASS[48:58] = 65, 97, 97, 48


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words: what ASCII white space leaves; no word reaches over two texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    after = np.r_[inside[1:], False] & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """Per word: row, word (hash of its letters and digits in lower case, without marks around; 0 if there are none), shape (hash of
    its classes with repeats taken together), again (whether it equals the word before it in its text)."""
    row, start, end = words(data, offsets)
    if not len(row):
        none = np.zeros(0, np.uint64)
        return {"row": row, "word": none, "shape": none, "again": np.zeros(0, bool), **{f"first{k}": none for k in prefixes}}
    n = len(data)
    core = _CORE[data]
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(core, place, -1))[end - 1]
    first = np.minimum.accumulate(np.where(core, place, n)[::-1])[::-1][start]
    some = last >= start
    word = np.zeros(len(row), np.uint64)
    lower = Rolling(_LOWER[data])
    word[some] = lower.of(first[some], last[some] + 1)
    kind = _CLASS[data]
    head = np.r_[True, kind[1:] != kind[:-1]]
    head[start] = True
    count = np.r_[0, np.cumsum(head)]
    shape = Rolling(kind[head]).of(count[start], count[end])
    again = np.r_[False, (word[1:] == word[:-1]) & (row[1:] == row[:-1]) & some[1:]]
    out = {"row": row, "word": word, "shape": shape, "again": again}
    for k in prefixes:  # of words that are longer; 0 for the rest
        out[f"first{k}"] = np.zeros(len(row), np.uint64)
        long = some & (last + 1 - first > k)
        out[f"first{k}"][long] = lower.of(first[long], first[long] + k)
    return out

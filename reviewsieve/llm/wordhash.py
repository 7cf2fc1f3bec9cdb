"""Hashes of words, word shingles and characters for whole batches of texts, in numpy.

A batch of texts becomes one array of code points; words, their 64-bit hashes and the
hashes of runs of words or characters are then found with array operations only. All
hashes depend on the characters alone, never on the batch or the process.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Characters per batch that are hashed together; a longer single text is its own batch.
BATCH_CHARS = 500_000


class Words(NamedTuple):
    """The words of a batch: ``hash`` of each, ``first`` word of each text, spans in code points."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def _power(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Powers 1..n of the base; those of a usual batch are kept, a longer text's are not."""
    usual = BATCH_CHARS + 1000
    kept = _POWERS.get(int(base))
    if kept is None or n > usual:
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(max(n, usual), base, np.uint64))
        if kept is None:
            kept = _POWERS[int(base)] = powers[:usual].copy()
        if n > usual:
            return powers[:n]
    return kept[:n]


def classify(points: np.ndarray, kind: Callable[[str], int]) -> np.ndarray:
    """``kind`` of each code point, worked out once for each different character."""
    seen = np.zeros(sys.maxunicode + 1, np.bool_)
    seen[points] = True
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in np.flatnonzero(seen):
        table[point] = kind(chr(point))
    return table[points]


def word_char(c: str) -> bool:
    """Letters, digits and marks belong to words."""
    return c.isalnum() or (c > "\x7f" and unicodedata.category(c)[0] == "M")


def not_space(c: str) -> bool:
    """Anything but blank and the controls tab to carriage return."""
    return c not in " \t\n\x0b\x0c\r"


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each ended by one blank; and where each text starts (n + 1)."""
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=first[1:])
    return points, first


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the characters of each span: a difference of running sums of powers."""
    with np.errstate(over="ignore"):
        terms = (points.astype(np.uint64) + np.uint64(1)) * _power(len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        raw = (total[end] - total[start]) * _power(len(points), _INVERSE)[start]
        return mix(raw + (end - start).astype(np.uint64))


def words(texts: list[str], kind: Callable[[str], bool] = word_char) -> Words:
    """Words of each text: longest runs of characters of that kind (never a blank)."""
    points, first = code_points(texts)
    inside = classify(points, kind) > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    hashed = span_hashes(points, start, end)
    return Words(hashed, np.searchsorted(start, first), start, end)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values that start at each place (len - n + 1 of them), order included."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= _BASE
            out += hashes[i : i + count]
    return mix(out)


def batches(texts: list[str], limit: int = BATCH_CHARS):
    """Slices of the list of at most ``limit`` characters, or one longer text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles, letters in lower case.

    A text of 1 to n - 1 words is one shingle of all its words; one without words has none.
    """
    out: list[np.ndarray] = []
    for begin, end in batches(texts):
        part = [t.lower() for t in texts[begin:end]]
        found = words(part)
        shingles = runs(found.hash, n)
        for a, b in zip(found.first[:-1], found.first[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(shingles[a : b - n + 1]))
            else:
                out.append(runs(found.hash[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def letter_stream(texts: list[str], pad: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts in lower case, each run of other signs one blank; and text bounds.

    Every text begins with ``pad`` blanks and ends with one. A text without letters is its
    blanks alone. Values are code points as unsigned 64-bit numbers.
    """
    points, first = code_points([t.lower() for t in texts])
    letter = classify(points, str.isalpha) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    # The blank that ends a text stays if a letter stands before it.
    kept = np.concatenate(([0], np.cumsum(keep)))
    size = kept[first[1:]] - kept[first[:-1]]
    bare = size == 0
    bounds = np.concatenate(([0], np.cumsum(size + pad + bare)))
    out = np.full(bounds[-1], 0x20, np.uint64)
    place = np.flatnonzero(keep)
    text = np.searchsorted(first, place, "right") - 1
    shift = bounds[text] + pad - kept[first[text]]
    out[shift + kept[place]] = np.where(letter[place], points[place], 0x20)
    return out, bounds


class HashArray:
    """Sorted 64-bit hashes with a table of where each leading bit pattern begins."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, int(len(hashes)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        heads = (hashes >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange((1 << bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.begin).max()) if len(hashes) else 0
        self.padded = np.append(hashes, np.zeros(self.depth + 1, np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not held."""
        out = np.full(len(keys), -1, np.int32)
        left, at = None, self.begin[keys >> self.shift]
        for _ in range(self.depth):
            wanted = keys if left is None else keys[left]
            held = self.padded[at]
            same = held == wanted
            if left is None:
                out[same] = at[same]
                left = np.flatnonzero(~same)
            else:
                out[left[same]] = at[same]
                left = left[~same]
            at = at[~same] + np.int32(1)
            if not len(left):
                break
        out[out >= len(self.hashes)] = -1
        return out

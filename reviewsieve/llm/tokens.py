"""Token ids of many texts at once, equal to those of the tokenizer they are taken from.

The vocabulary splits a text into words before it merges, so a word's ids do not depend on
its surroundings. Words of a whole batch are found and hashed in numpy, only words not met
before go through the tokenizer, and ids are gathered by word.
"""

from __future__ import annotations

import functools
import unicodedata
from hashlib import blake2b

import numpy as np
from tokenizers import Tokenizer

from reviewsieve.llm import wordhash

SPACE, LETTER, NUMBER, OTHER = range(4)
# The endings that the tokenizer's splitting rule keeps whole after a quote.
ENDINGS_1 = "stmd"
ENDINGS_2 = ("re", "ve", "ll")
# Words of more characters are told apart by a digest of their spelling: two of them with one sum of
# powers can be written down on purpose.
LONG = 500
# Different words that are remembered; then memory starts afresh.
MEMORY = 400_000


def kind(c: str) -> int:
    group = unicodedata.category(c)
    if group[0] == "L":
        return LETTER
    if group[0] == "N":
        return NUMBER
    return SPACE if group[0] == "Z" or c in "\t\n\x0b\x0c\r\x85" else OTHER


@functools.cache
def assigned(c: str) -> bool:
    """Whether Python's tables know the character. The tokenizer's may know more of them."""
    return unicodedata.category(c) != "Cn"


def known(text: str) -> bool:
    return text.isascii() or all(map(assigned, set(text)))


def normal(text: str) -> str:
    """NFC, then each character in lower case (a sigma has one lower form here)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: letters together, numbers one by one, other signs together."""
    kinds = wordhash.classify(points, kind)
    begin = np.ones(len(points) + 4, np.bool_)
    padded = np.concatenate((points, np.full(4, 0x20, points.dtype)))
    types = np.concatenate((kinds, np.zeros(4, kinds.dtype)))
    begin[1:] = (types[1:] != types[:-1]) | (types[1:] == NUMBER)
    quote = np.flatnonzero((padded[:-4] == 0x27) & begin[:-4] & (types[1:-3] == LETTER))
    if len(quote):
        one = np.isin(padded[quote + 1], [ord(c) for c in ENDINGS_1])
        two = np.zeros(len(quote), np.bool_)
        for a, b in ENDINGS_2:
            two |= (padded[quote + 1] == ord(a)) & (padded[quote + 2] == ord(b))
        for at, size in ((quote[one], 1), (quote[two], 2)):
            begin[at + 1] = False
            begin[at + 1 + size] = True
    edges = np.flatnonzero(begin)
    starts = edges[:-1]
    keep = types[starts] != SPACE
    return starts[keep], edges[1:][keep]


def byte_letters() -> list[str]:
    """The sign that stands for each byte in the vocabulary: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [signs[b] for b in range(256)]


class _Memory:
    """Ids of words by hash, in arrays: an open hash table over flat ids."""

    slots = 1 << 21
    probes = 8

    def __init__(self):
        self.slot = np.full(self.slots, -1, np.int32)
        self.hash = np.empty(0, np.uint64)
        self.size = np.empty(0, np.int64)
        self.origin = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 where it is not known."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hash):
            return out
        left = np.arange(len(hashes))
        at = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        for _ in range(self.probes):
            held = self.slot[at]
            same = (held >= 0) & (self.hash[held] == hashes[left])
            out[left[same]] = held[same]
            on = ~same & (held >= 0)
            left, at = left[on], (at[on] + 1) & (self.slots - 1)
            if not len(left):
                break
        return out

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """New words, all different. One whose slots are all taken is not found again."""
        known = len(self.hash)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.origin = np.concatenate((self.origin, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, *ids))
        self.hash = np.concatenate((self.hash, hashes))
        left = np.arange(len(hashes))
        at = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        for _ in range(self.probes):
            free = self.slot[at] < 0
            self.slot[at[free]] = known + left[free]
            on = self.slot[at] != known + left
            left, at = left[on], (at[on] + 1) & (self.slots - 1)
            if not len(left):
                break


class BatchTokenizer:
    """Ids of texts by a tokenizer whose words are merged one by one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = _Memory()

    def _word_ids(self, word: str) -> np.ndarray:
        signs = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.merge(signs)], np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the ids of ``tokenizer.encode(text, add_special_tokens=False)``."""
        out: list[np.ndarray] = []
        for begin, end in wordhash.batches(texts):
            part = texts[begin:end]
            whole = {
                i for i, t in enumerate(part) if any(s in t for s in self.special) or not known(t)
            }
            found = self._batch(["" if i in whole else normal(t) for i, t in enumerate(part)])
            for i in whole:
                coded = self.tokenizer.encode(part[i], add_special_tokens=False)
                found[i] = np.array(coded.ids, np.uint32)
            out += found
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        points, first = wordhash.code_points(texts)
        start, end = pieces(points)
        hashes = wordhash.span_hashes(points, start, end)
        for i in np.flatnonzero(end - start > LONG):
            spelling = blake2b(points[start[i] : end[i]].tobytes(), digest_size=8)
            hashes[i] = int.from_bytes(spelling.digest(), "little")
        word = self.memory.find(hashes)
        new = np.flatnonzero(word < 0)
        if len(new):
            unique, example, same = np.unique(
                hashes[new], return_index=True, return_inverse=True
            )
            if len(self.memory.hash) > MEMORY:
                self.memory = _Memory()
                return self._batch(texts)
            known = len(self.memory.hash)
            spans = zip(start[new[example]].tolist(), end[new[example]].tolist(), strict=True)
            spelt = [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in spans]
            self.memory.add(unique, [self._word_ids(w) for w in spelt])
            word[new] = known + same
        memory = self.memory
        counts = memory.size[word]
        stop = np.cumsum(counts)
        total = int(stop[-1]) if len(stop) else 0
        ids = memory.flat[np.repeat(memory.origin[word] - stop + counts, counts) + np.arange(total)]
        bounds = np.concatenate(([0], stop))[np.searchsorted(start, first)]
        return np.split(ids, bounds[1:-1])

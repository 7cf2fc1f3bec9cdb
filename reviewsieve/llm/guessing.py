"""How many guesses a value takes: the cheapest way to put it together from guessable spans.

A dynamic programme over the value's characters. Spans are words (with capitals and look-alike
signs), dates, repeats of a unit, walks over neighbouring keys, and stretches of brute force.
Guesses multiply along a value, so costs are bits that add up, and each span costs the choice of its
kind. Time is linear in the value's length.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache
from math import comb, log2
from typing import NamedTuple

import numpy as np

# Words that every guesser tries first, in that order.
COMMON = (
    "password passwd admin welcome letmein login master secret token default changeme root user "
    "test guest hello dragon monkey shadow sunshine princess football baseball superman iloveyou "
    "trustno access system server manager example sample dummy placeholder none null true false "
    "your here redacted hidden required string value"
).split()
# Signs that stand for letters, keys by row (plain, with shift), years of dates.
LOOKS = str.maketrans("@43!10$57+", "aaeiiosstt")
ROWS = (
    ("`1234567890-=", "~!@#$%^&*()_+"),
    ("qwertyuiop[]\\", "QWERTYUIOP{}|"),
    ("asdfghjkl;'", 'ASDFGHJKL:"'),
    ("zxcvbnm,./", "ZXCVBNM<>?"),
)
FIRST_YEAR, LAST_YEAR = 1900, 2099

WORD_LETTERS = (3, 20)
# Longest unit of a repeat; longer ones cost what their characters cost.
REPEAT_UNIT = 64
KINDS = 5
LINK = log2(KINDS)
WALK_KEYS = 3

# Each key's place on a grid on which neighbours are one step in six directions apart.
_KEYS = {
    key: (row, column + (row > 0), shifted)
    for row, pair in enumerate(ROWS)
    for shifted, keys in enumerate(pair)
    for column, key in enumerate(keys)
}
_STEPS = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)}
_PLACES = len(_KEYS) // 2
_DATE = re.compile(
    r"(?P<a>\d{1,2})(?P<s>[-/._])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4}|\d\d)"
    r"|(?P<y2>\d{4})(?P<s2>[-/._])(?P<a2>\d{1,2})(?P=s2)(?P<b2>\d{1,2})"
)


class Guess(NamedTuple):
    """Bits (log2 of the guesses) and the spans ``(kind, start, end)`` of the cheapest way."""

    bits: float
    spans: list[tuple[str, int, int]]


def candidate_words(value: str) -> set[str]:
    """All words that a span of the value might be."""
    low, high = WORD_LETTERS
    out = set()
    for run in re.finditer(r"[a-z]+", looks_like(value)):
        letters = run.group()
        for i in range(len(letters) - low + 1):
            out.update(letters[i : i + n] for n in range(low, min(high, len(letters) - i) + 1))
    return out


def looks_like(value: str) -> str:
    """ASCII letters in lower case and signs as the letters they stand for; same length."""
    return re.sub(r"[A-Z]", lambda m: m.group().lower(), value).translate(LOOKS)


def brute_bits(char: str) -> float:
    """Bits of one character that is tried out."""
    if char.isascii():
        if char.isdigit():
            return log2(10)
        return log2(26) if char.isalpha() else log2(33)
    return log2(1000)


def word_bits(span: str, bits: float) -> float:
    """A word's bits with the choices of its capitals and look-alike signs."""
    upper = sum(c.isupper() for c in span)
    letters = sum(c.isalpha() for c in span)
    if upper:
        plain = upper == letters or (upper == 1 and span[0].isupper())
        ways = 2 if plain else sum(comb(letters, i) for i in range(1, min(upper, letters - upper) + 1))
        bits += log2(max(2, ways))
    return bits + (len(span) - letters)


def date_bits(span: str) -> float | None:
    """Bits of a date or a year, None for anything else."""
    years = LAST_YEAR - FIRST_YEAR + 1
    if len(span) == 4 and span.isdigit():
        return log2(years) if FIRST_YEAR <= int(span) <= LAST_YEAR else None
    found = _DATE.fullmatch(span)
    if found:
        day, month = (int(found[g] or found[g + "2"]) for g in "ab")
        year = found["y"] or found["y2"]
        parts = [(day, month, year)]
    elif span.isdigit() and len(span) == 6:
        parts = [(int(span[:2]), int(span[2:4]), span[4:]), (int(span[2:4]), int(span[4:]), span[:2])]
    elif span.isdigit() and len(span) == 8:
        parts = [(int(span[:2]), int(span[2:4]), span[4:]), (int(span[4:6]), int(span[6:]), span[:4])]
    else:
        return None
    for a, b, year in parts:
        in_order = 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31
        if in_order and (len(year) == 2 or FIRST_YEAR <= int(year) <= LAST_YEAR):
            return log2(years * 366) + (2 if found else 0)
    return None


def _walks(value: str) -> tuple[list[int], list[float]]:
    """For each end: where the walk over keys that reaches it began, and its bits."""
    starts, bits = [0] * (len(value) + 1), [0.0] * (len(value) + 1)
    start, turns, shifts, heading, before = 0, 0, 0, None, None
    for i, char in enumerate(value):
        key = _KEYS.get(char)
        step = (key[0] - before[0], key[1] - before[1]) if key and before else None
        if step in _STEPS:
            turns += step != heading
            shifts += key[2] != before[2]
            heading = step
        else:
            start, turns, heading = i, 0, None
            shifts = key[2] if key else 0
        before = key
        length = i + 1 - start
        starts[i + 1] = start
        bits[i + 1] = log2(_PLACES) + turns * (log2(len(_STEPS)) + log2(length)) + shifts
    return starts, bits


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """For each end: ``(unit, times)`` of the repeats that end there, as far back as they go."""
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    out: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, min(REPEAT_UNIT, len(value) // 2) + 1):
        same = points[unit:] == points[:-unit]
        last = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        times = (np.arange(len(same)) - last) // unit + 1
        for i in np.flatnonzero(times >= (3 if unit == 1 else 2)):
            out.setdefault(int(i) + unit + 1, []).append((unit, int(times[i])))
    return out


@lru_cache(maxsize=1)
def _common_bits() -> dict[str, float]:
    return {word: log2(rank + 1) for rank, word in enumerate(COMMON, 1)}


def guess(value: str, words: Mapping[str, float], repeats: bool = True) -> Guess:
    """The cheapest segmentation of a value. ``words`` gives the bits of known words.

    A repeat or a walk is taken as far back as it goes; the unit of a repeat is guessed like a
    value of its own, without repeats. The empty value takes no guesses.
    """
    n = len(value)
    best, came = [0.0] + [float("inf")] * n, [("", 0)] * (n + 1)
    common = _common_bits()
    plain = looks_like(value)
    starts, walked = _walks(value)
    again = _repeats(value) if repeats else {}
    units: dict[str, float] = {}
    brute, begun = float("inf"), 0
    low, high = WORD_LETTERS
    for j in range(1, n + 1):
        if best[j - 1] + LINK < brute:
            brute, begun = best[j - 1] + LINK, j - 1
        brute += brute_bits(value[j - 1])
        best[j], came[j] = brute, ("brute", begun)

        def offer(kind: str, i: int, bits: float, j: int = j) -> None:
            if best[i] + LINK + bits < best[j]:
                best[j], came[j] = best[i] + LINK + bits, (kind, i)

        for i in range(j - 1, max(-1, j - high - 1), -1):
            if not "a" <= plain[i] <= "z":
                break
            if j - i >= low:
                word = plain[i:j]
                known = min(words.get(word, float("inf")), common.get(word, float("inf")))
                if known < float("inf"):
                    offer("word", i, word_bits(value[i:j], known))
        if value[j - 1].isascii() and value[j - 1].isdigit():
            for length in (4, 6, 7, 8, 9, 10):
                if length <= j and (bits := date_bits(value[j - length : j])) is not None:
                    offer("date", j - length, bits)
        if j - starts[j] >= WALK_KEYS:
            offer("walk", starts[j], walked[j])
        for unit, times in again.get(j, ()):
            said = value[j - unit : j]
            if said not in units:
                units[said] = guess(said, words, False).bits
            offer("repeat", j - unit * times, units[said] + log2(times))
    spans, j = [], n
    while j:
        kind, i = came[j]
        spans.append((kind, i, j))
        j = i
    return Guess(best[n], spans[::-1])

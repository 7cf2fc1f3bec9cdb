"""Secrets in texts: strings of known shapes, and credential values that take many guesses.

Texts are scanned where they are. What stands in the place of a credential's value (behind a name
like ``password`` and a sign, behind ``bearer``, before the ``@`` of an address) is weighed by
the guesses it would take (see ``guessing``): values put together from words, dates, repeats and
walks over the keyboard are placeholders, others are secrets. Words weigh by how common they
are in all texts together, apart from their use as values. Words and values meet by joins, each
different value is weighed once, and only rows with values are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.llm.frames import bounded_batches, texts_of, written
from reviewsieve.llm.guessing import WORD_LETTERS, candidate_words, guess

# The shapes of base spans, and how long they have to be.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

# Where a credential's value stands: behind a name and a sign, quoted or up to a blank.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|secret|token|credentials?
        |(?<![a-z])(?:pass|pwd|pw|auth|authorization)
        |(?:api|access|auth|private|secret|signing|encryption|master)[_-]?key)
        ["']?\x20*(?::=|=>|[:=])\x20*
        (?:bearer\x20+|basic\x20+)?
        (?:"(?P<a>[^"\r\n]+)"|'(?P<b>[^'\r\n]+)'|(?P<c>[^\s"'<>]+))
      |(?<![a-z])bearer\x20+(?P<d>[^\s"'<>]+)
      |://[^\s/:@]+:(?P<e>[^\s/@]+)@""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
# Every name of the two patterns holds one of these.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
CONTEXT_HINTS = ("pass", "pwd", "pw", "auth", "secret", "token", "credential", "key", "bearer", "://")
# Guesses from which on a value is a secret.
MIN_GUESSES = 1e8

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("bits", T.DoubleType()),
    ]
)


def base_spans(text: str, hex_runs: bool = True) -> list[tuple[str, int, int]]:
    """The base spans ``(kind, start, end)`` of a text, by start, then kind.

    Leftmost matches that do not overlap, per kind; a match of ``ASSIGN`` whose value is too
    short is dropped after it has taken its place. ``hex_runs`` False skips a search that finds
    nothing.
    """
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if hex_runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def credential_values(text: str) -> list[tuple[int, int]]:
    """Where the text has a credential's value: ``(start, end)`` in order."""
    lower = text.lower()
    if not any(hint in lower for hint in CONTEXT_HINTS):
        return []
    return [m.span(m.lastgroup) for m in CONTEXT.finditer(text)]


def may_have_hex(texts: list[str]) -> np.ndarray:
    """Texts with two whole groups of eight hex digits in a row, as any run of 24 has."""
    parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    size = np.cumsum([0, *map(len, parts)])
    inside = _HEX_BYTE[np.frombuffer(b"".join(parts), np.uint8)]
    whole = inside[: len(inside) // 8 * 8].reshape(-1, 8).all(1)
    at = np.flatnonzero(whole[1:] & whole[:-1]) * 8
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(size, at, "right") - 1] = True
    return out


def _scan(keep: list[str]):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("value", pa.string()), ("bits", pa.float64())]))
    values = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("_text"))
            if not texts:
                continue
            based = [
                [(kind, a, b, text[a:b], None) for kind, a, b in base_spans(text, bool(maybe))]
                for text, maybe in zip(texts, may_have_hex(texts), strict=True)
            ]
            valued = [[(a, b, text[a:b]) for a, b in credential_values(text)] for text in texts]
            dicts = lambda rows, names: [[dict(zip(names, r, strict=True)) for r in row] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in [*keep, "_row"]],
                    pa.array(dicts(based, ("kind", "start", "end", "value", "bits")), spans),
                    pa.array(dicts(valued, ("start", "end", "value")), values),
                ],
                [*keep, "_row", "_spans", "_values"],
            )

    return run


def _words_of(text: Column) -> Column:
    """Words of letters that a value might hold, as an array with repeats."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    low, high = WORD_LETTERS
    return F.filter(words, lambda w: F.length(w).between(low, high))


def word_weights(texts: DataFrame, values: DataFrame) -> DataFrame:
    """``word, bits`` of all words of the texts: how many words are as common, or more.

    Words are put in classes by powers of two of their counts. ``texts``: ``_text``; ``values``:
    ``value``, whose own words are taken off the counts.
    """
    said = texts.select(F.explode(_words_of(F.col("_text"))).alias("word"), F.lit(1).alias("n"))
    used = values.select(F.explode(_words_of(F.col("value"))).alias("word"), F.lit(-1).alias("n"))
    counts = said.unionByName(used).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    counts = written(counts.select("word", F.floor(F.log2("n")).cast("int").alias("rarity")), "words")
    classes = counts.groupBy("rarity").agg(F.count(F.lit(1)).alias("n"))
    # One row a power of two: at most 63.
    above = Window.orderBy(F.desc("rarity"))
    ranks = classes.select("rarity", F.log2(F.sum("n").over(above)).alias("bits"))
    return counts.join(F.broadcast(ranks), "rarity").select("word", "bits")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("value").to_pylist():
            words = sorted(candidate_words(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array([value] * len(words), pa.string()), pa.array(words, pa.string())],
                ["value", "word"],
            )


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("value").to_pylist()
        words = batch.column("words").to_pylist()
        found = [
            guess(v, {w["word"]: w["bits"] for w in ws or ()}) for v, ws in zip(values, words, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(values, pa.string()),
                pa.array([g.bits for g in found], pa.float64()),
                pa.array([[f"{k}:{a}:{b}" for k, a, b in g.spans] for g in found], pa.list_(pa.string())),
            ],
            ["value", "bits", "parts"],
        )


def value_guesses(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Each different value with ``bits`` and ``parts``, the spans ``kind:start:end`` it is put
    together from. ``values``: ``value``; ``weights``: ``word, bits``."""
    each = written(values.select("value").distinct(), "values")
    held = each.mapInArrow(_candidates, "value string, word string")
    # Most substrings of values are no words, so what is grouped by value is short.
    known = held.join(weights, "word").groupBy("value").agg(
        F.collect_list(F.struct("word", "bits")).alias("words")
    )
    both = each.join(known, "value", "left")
    return both.mapInArrow(_weigh, "value string, bits double, parts array<string>")


def find_secrets(docs: DataFrame, keep: list[str], min_guesses: float = MIN_GUESSES) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ``spans``, its secrets.

    A span has ``kind, start, end`` (code points, end exclusive), ``value`` and ``bits``. Kinds:
    ``assign``, ``access`` and ``hex`` by shape (no ``bits``), and ``guess`` for a credential's
    value of ``min_guesses`` guesses or more; these may overlap. Spans come by start, then by
    kind in this order. Null and empty texts have none; rows are kept one by one, so null ids,
    ties and repeated rows do not matter, nor do columns that are not in ``keep``, whose names must
    not begin with ``_``. A text is scanned whole, however long it is.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        *keep, F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row")
    )
    kept = [rows.schema[c] for c in [*keep, "_row"]]
    value = T.StructType([SPAN["start"], SPAN["end"], SPAN["value"]])
    schema = T.StructType(
        [*kept, T.StructField("_spans", T.ArrayType(SPAN)), T.StructField("_values", T.ArrayType(value))]
    )
    scanned = written(rows.mapInArrow(_scan(keep), schema), "scanned")
    hits = scanned.select("_row", F.inline("_values"))
    weights = word_weights(docs.select(F.col("text").alias("_text")), hits)
    weighed = written(value_guesses(hits, weights), "weighed")
    secrets = weighed.where(F.col("bits") >= float(np.log2(min_guesses))).select("value", "bits")
    span = F.struct(F.lit("guess").alias("kind"), "start", "end", "value", "bits")
    found = hits.join(secrets, "value").groupBy("_row").agg(F.collect_list(span).alias("_found"))
    kinds = F.array(*map(F.lit, KINDS))
    place = lambda s: F.struct(
        s["start"].alias("at"), F.array_position(kinds, s["kind"]).alias("of"), s.alias("span")
    )
    joined = scanned.join(found, "_row", "left")
    spans = F.concat("_spans", F.coalesce("_found", F.array()))
    ordered = F.transform(F.array_sort(F.transform(spans, place)), lambda s: s["span"])
    return joined.select(*keep, ordered.alias("spans"))

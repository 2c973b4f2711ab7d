"""Quality rules: line-first cleaning.

Each line is judged by itself (punctuation, navigation, boilerplate, symbols, capitals, repetition), failing lines are
removed, and a document that loses too much of its text is rejected.

Defined results: a null or empty text has no words and fails the base rule (fewer than 50 words); its clean text is empty.
Repeated rows are judged one by one and alike. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Texts, map_texts, mix64, table

# Symbols that count as such, line ends, navigation marks, stock phrases (lower case).
SYMBOLS = b"#*$%&|<>"
LINE_ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "”", "’", "»")
NAVIGATION = b"|>/<"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "sign in", "log in",
    "sign up", "click here", "read more", "share this", "powered by", "enable javascript", "licensed under",
    "released under", "subscribe to our", "skip to content",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat: float = 0.5
    short_line: int = 4
    navigation_share: float = 0.25
    symbol_share: float = 0.1
    capital_share: float = 0.7
    max_loss: float = 0.5


def _table_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_IS_SYMBOL = _table_of(SYMBOLS)
_IS_NAVIGATION = _table_of(NAVIGATION)
_IS_UPPER = _table_of(bytes(range(65, 91)))
_IS_LETTER = _table_of(bytes([*range(65, 91), *range(97, 123)]))
_ENDS_1 = _table_of(bytes(ord(c) for c in LINE_ENDS if ord(c) < 128))
_ENDS_WIDE = [c.encode() for c in LINE_ENDS if ord(c) > 127]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, key): is it there twice or more, and is it one after the first."""
    both = mix64(key ^ mix64(owner.astype(np.uint64) + np.uint64(0x51ED27)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = np.zeros(len(both) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    many, later = np.empty(len(both), bool), np.empty(len(both), bool)
    many[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return many, later


def judge(texts: Texts, rules: Rules) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The figures and verdict of each document; and of each line the start, the end and whether it stays."""
    data, offsets, n = texts.data, texts.offsets, texts.n
    starts, ends, first_word = texts.words()
    n_words = np.diff(first_word)
    doc_of_word = np.repeat(np.arange(n), n_words)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=inside[1:])  # code points so far
    points = _sums(inside[ends] - inside[starts])

    hashes = texts.span_hash(starts, ends)
    repeat = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        whole = doc_of_word[2:] == doc_of_word[:-2]
        at = np.flatnonzero(whole)
        window = mix64(hashes[at] * np.uint64(3) + mix64(hashes[at + 1]) * np.uint64(5) + mix64(mix64(hashes[at + 2])) * np.uint64(7))
        many, _ = _repeated(doc_of_word[at], window)
        for k in range(3):
            repeat[at[many] + k] = True

    # Lines: cut after each \n inside a document, and at each document's end.
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    doc_of_line = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.empty(len(line_start), np.int64)
    line_end[:-1] = line_start[1:]
    line_end[-1:] = len(data)
    cut = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_stop = line_end - cut
    w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    words = w1 - w0
    has = words > 0
    again = np.zeros(len(line_start), bool)
    at = np.flatnonzero(has)
    again[at] = _repeated(doc_of_line[at], texts.span_hash(line_start[at], line_stop[at]))[1]

    def inside_lines(flags: np.ndarray) -> np.ndarray:
        s = _sums(flags)
        return s[line_stop] - s[line_start]

    symbol = _IS_SYMBOL[data]
    characters = np.maximum(points[w1] - points[w0], 1)
    last = np.zeros(len(line_start), np.int64)
    last[at] = ends[w1[at] - 1]
    closed = np.zeros(len(line_start), bool)
    closed[at] = _ENDS_1[data[last[at] - 1]]
    for mark in _ENDS_WIDE:
        k, fits = len(mark), np.zeros(len(line_start), bool)
        ok = at[last[at] - k >= line_start[at]]
        fits[ok] = True
        for i, b in enumerate(mark):
            fits[ok] &= data[last[ok] - k + i] == b
        closed |= fits
    alone = (ends - starts == 1) & _IS_NAVIGATION[data[starts]] if len(starts) else np.zeros(0, bool)
    alone = _sums(alone)
    letters = inside_lines(_IS_LETTER[data])
    fails = again.copy()
    fails |= ~closed & (words < rules.short_line)
    fails |= alone[w1] - alone[w0] >= np.maximum(1, rules.navigation_share * words)
    fails |= inside_lines(symbol) > rules.symbol_share * characters
    fails |= (letters >= 12) & (inside_lines(_IS_UPPER[data]) > rules.capital_share * letters)
    lowered = data.tobytes().lower()
    for phrase in BOILERPLATE:
        found = lowered.find(phrase.encode())
        while found >= 0:
            line = int(np.searchsorted(line_start, found, side="right")) - 1
            if found + len(phrase) <= line_stop[line]:
                fails[line] = True
            found = lowered.find(phrase.encode(), found + 1)
    stays = has & ~fails

    per_doc = lambda value, owner: np.bincount(owner, value, n).astype(np.int64)
    repeats = per_doc(repeat, doc_of_word)
    kept_words = per_doc(words * stays, doc_of_line)
    base_failed = (n_words < rules.min_words) | (repeats > rules.max_repeat * n_words)
    out = {
        "n_words": n_words,
        "word_chars": points[first_word[1:]] - points[first_word[:-1]],
        "n_symbols": np.diff(_sums(symbol)[offsets]),
        "n_dup_lines": per_doc(again, doc_of_line),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": ~base_failed & (n_words - kept_words <= rules.max_loss * n_words),
        "kept_words": kept_words,
        "lines_removed": per_doc(has & fails, doc_of_line),
    }
    return out, (line_start, line_stop, stays)


_FIELDS = [
    *[T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("kept_words", T.LongType()),
    T.StructField("lines_removed", T.LongType()),
    T.StructField("clean_text", T.StringType()),
]


def clean_lines(df: DataFrame, text: str = "text", carry: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """The columns in `carry` (all, by default) in the struct `row`, the figures, the verdict and the cleaned text.

    No shuffle: each document is judged where it is read."""

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column("text"))
        figures, (start, stop, stays) = judge(texts, rules)
        raw = texts.data.tobytes()
        left = np.flatnonzero(stays)
        bounds = np.searchsorted(start[left], texts.offsets)
        pieces = [raw[a:b] for a, b in zip(start[left].tolist(), stop[left].tolist(), strict=True)]
        clean = [b"\n".join(pieces[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return {k: pa.array(v) for k, v in figures.items()} | {"clean_text": pa.array(clean, pa.binary()).cast(pa.string())}

    return map_texts(df, kernel, _FIELDS, df.columns if carry is None else carry, text=text)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", *[f.name for f in _FIELDS[:-1]], F.length("clean_text").alias("clean_chars"))

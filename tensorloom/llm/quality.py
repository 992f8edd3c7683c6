"""Repetition coverage: how many characters of a text lie in repeated n-grams and repeated lines.

Words and lines are numbered by their bytes, and rolling hashes of several n-gram lengths run over these numbers in numpy,
so the work grows with the bytes alone, and a text is judged on all of its words.  Equal hashes are confirmed on the words'
numbers, so counts are exact: no two unequal words, n-grams or lines count as equal.  No rows meet: there is no shuffle.

Defined results: a null or empty text has no words and fails the base rules (fewer words than the minimum); a null
``doc_id`` is carried through; equal rows are judged alike, each on its own; an empty table gives an empty table.
Columns of the input other than the two named ones are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tensorloom.llm import _tables
from tensorloom.llm._blocks import U64, byte_blocks, numbered, splitmix64, tally, text_column, words_of

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes that one pass covers: its arrays stay within a core's cache.
_BLOCK = 1 << 18


@dataclass(frozen=True)
class QualityRules:
    """Limits.  A coverage is a part of the characters in words, in percent."""

    min_words: int = 10
    max_repeat_words_percent: int = 20
    ngram_lengths: tuple[int, ...] = (5, 6, 8, 10)
    #: Of each n-gram length: above this coverage a text is rejected.  A longer n-gram's cover lies within the 5-gram's, so
    #: limits at or above ``max_repeat_words_percent`` would hardly decide anything; these are the widely published ones.
    max_ngram_percent: tuple[int, ...] = (15, 14, 12, 10)
    max_line_percent: int = 20


def _hashed(values: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of some columns."""
    key = np.zeros(len(values[0]), U64)
    for v in values:
        key = splitmix64(key ^ v.astype(U64))
    return key


def _repeated(keys: np.ndarray, same_row) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs twice or more, and whether an equal one stands before it.

    ``same_row(a, b)`` tells whether the rows at two lists of places are equal.  Rows of one hash that are unequal, which is
    all but impossible, are told apart by sorting the few rows concerned.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    at = np.flatnonzero(same)
    if len(at):
        wrong = ~same_row(order[at - 1], order[at])
        if wrong.any():
            for key in np.unique(ranked[at[wrong]]):
                lo, hi = np.searchsorted(ranked, key, "left"), np.searchsorted(ranked, key, "right")
                groups: list[list[int]] = []
                for place in order[lo:hi].tolist():
                    own = next((g for g in groups if same_row(np.array([g[0]]), np.array([place]))[0]), None)
                    own.append(place) if own else groups.append([place])
                order[lo:hi] = [x for g in groups for x in g]
                same[lo + 1 : hi] = [x for g in groups for x in (False, *[True] * (len(g) - 1))][1:]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def _block(data: np.ndarray, offsets: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    n_rows = len(offsets) - 1
    start, end, first = words_of(data, offsets)
    n_words = np.diff(first)
    point = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    chars = points[end] - points[start]
    row = np.repeat(np.arange(n_rows), n_words)
    word, _ = numbered(data, start, end)
    in_words = np.bincount(row, chars, n_rows).astype(np.int64)

    out = {"n_words": n_words, "word_chars": in_words, "n_symbols": tally(_IS_SYMBOL[data], offsets)}
    limit = first[1:][row] if len(row) else np.zeros(0, np.int64)
    at: np.ndarray | None = None
    for n in sorted({5, *rules.ngram_lengths}):
        # A repeated longer n-gram begins with a repeated 5-gram, so only those places are looked at again.
        at = np.flatnonzero(np.arange(len(word)) + n <= limit) if at is None or n <= 5 else at[at + n <= limit[at]]
        grams = [row[at], *(word[at + j] for j in range(n))]
        twice, _ = _repeated(_hashed(grams), lambda a, b, grams=grams: np.logical_and.reduce([g[a] == g[b] for g in grams]))
        hit = at[twice]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out[f"covered_{n}"] = np.bincount(row[covered], chars[covered], n_rows).astype(np.int64)
        if n == 5:
            out["n_repeat_words"] = np.bincount(row[covered], minlength=n_rows)
        at = hit if n >= 5 else None

    breaks = np.flatnonzero(data == 0x0A)
    lines_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    lines_row = np.searchsorted(offsets, lines_start, "right") - 1
    # A line that would start where the next row starts is the empty rest after a final line break; so is an empty row.
    lines_end = np.concatenate([lines_start[1:], [len(data)]])
    lines_end = np.where((lines_end > lines_start) & (data[np.maximum(lines_end - 1, 0)] == 0x0A) if len(data) else False, lines_end - 1, lines_end)
    first_word = np.searchsorted(start, lines_start)
    has_word = (first_word < len(start)) & (start[np.minimum(first_word, max(len(start) - 1, 0))] < lines_end) if len(start) else np.zeros(len(lines_start), bool)
    lines_start, lines_end, lines_row = lines_start[has_word], lines_end[has_word], lines_row[has_word]
    line, _ = numbered(data, lines_start, lines_end)
    _, later = _repeated(_hashed([lines_row, line]), lambda a, b: (line[a] == line[b]) & (lines_row[a] == lines_row[b]))
    out["n_dup_lines"] = np.bincount(lines_row[later], minlength=n_rows)
    word_points = np.zeros(len(word) + 1, np.int64)
    np.cumsum(chars, out=word_points[1:])
    line_chars = word_points[np.searchsorted(start, lines_end)] - word_points[np.searchsorted(start, lines_start)]
    out["covered_lines"] = np.bincount(lines_row[later], line_chars[later], n_rows).astype(np.int64)

    failed = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_percent * n_words)
    rejected = 100 * out["covered_lines"] > rules.max_line_percent * in_words
    for n, most in zip(rules.ngram_lengths, rules.max_ngram_percent, strict=True):
        rejected |= 100 * out[f"covered_{n}"] > most * in_words
    out["base_failed"], out["kept"] = failed, ~failed & ~rejected
    return out


def measure(texts: pa.Array, rules: QualityRules) -> dict[str, np.ndarray]:
    """Every measure of each text of an Arrow string column without nulls."""
    parts = [_block(data, offsets, rules) for _, _, data, offsets in byte_blocks(texts, _BLOCK)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def quality_measures(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its base counts, the characters covered by repetition, and the verdict ``kept``."""
    covered = [f"covered_{n}" for n in rules.ngram_lengths] + ["covered_lines"]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *covered]
    schema = ", ".join([f"doc_id {docs.schema[doc_id].dataType.simpleString()}", *(f"{c} long" for c in longs), "base_failed boolean", "kept boolean"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("quality")
        for batch in batches:
            if batch.num_rows:
                found = measure(text_column(batch, "text"), rules)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in longs), pa.array(found["base_failed"]), pa.array(found["kept"])], names=["doc_id", *longs, "base_failed", "kept"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tables.enter("quality")
        for batch in batches:
            if batch.num_rows:
                column = batch.column(at).cast(pa.large_string()).fill_null("")
                yield batch.filter(pa.array(measure(column, rules)["kept"]))

    return docs.mapInArrow(keep, docs.schema)

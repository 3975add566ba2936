"""Statistics of whole texts, per document, for the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernel import BYTES, NEWLINE, SPACES, grouped, hashes, mix, slices, spans, windows

# The symbols that count.
SYMBOLS = np.isin(BYTES, list(b"[#*$%&|<>]"[1:-1]))
CONTINUES = (BYTES & 0xC0) == 0x80
UPPERS = (BYTES >= 65) & (BYTES <= 90)
DIGITS = (BYTES >= 48) & (BYTES <= 57)
PUNCTUATION = ((BYTES > 0x20) & (BYTES < 0x30)) | ((BYTES > 0x39) & (BYTES < 0x41)) | ((BYTES > 0x5A) & (BYTES < 0x61)) | ((BYTES > 0x7A) & (BYTES < 0x7F))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REST = ["n_chars", "n_lines", "n_upper", "n_digits", "n_punctuation", "n_distinct"]
RUN = 8


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, is an equal one before it, and is there an equal one at all."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, first = grouped(keys)
    same = np.ones(len(keys) - 1, bool)
    same[first[1:] - 1] = False
    before, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return before, any_


def stats(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: first row, end row, counts (COUNTS and REST), word hashes and where each text's words begin."""
    for i, j, data, offsets in slices(column):
        n = j - i
        starts, ends, begin = spans(data, offsets, SPACES)
        h = hashes(data, starts, ends)
        salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        text_of = np.repeat(np.arange(n), np.diff(begin))
        chars = _per_text(~CONTINUES[data], offsets)
        word_chars = chars - _per_text(SPACES[data], offsets)
        # lines with a word that equal one before
        ls, le, lb = spans(data, offsets, NEWLINE)
        line_of = np.repeat(np.arange(n), np.diff(lb))
        worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        before, _ = _seen_before((hashes(data, ls, le) ^ salt[line_of])[worded])
        dup_lines = np.bincount(line_of[worded][before], minlength=n)
        # words in windows of RUN that the text has twice
        w, at, first = windows(h, begin, RUN)
        _, twice = _seen_before(w ^ salt[np.repeat(np.arange(n), np.diff(first))])
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + RUN, -1)
        repeated = np.bincount(text_of[np.cumsum(step)[:-1] > 0], minlength=n)
        before, _ = _seen_before(h ^ salt[text_of])
        distinct = np.bincount(text_of[~before], minlength=n)
        rest = [_per_text(x[data], offsets) for x in (UPPERS, DIGITS, PUNCTUATION)]
        counts = [np.diff(begin), word_chars, _per_text(SYMBOLS[data], offsets), dup_lines, repeated, chars, _per_text(NEWLINE[data], offsets) + 1, *rest, distinct]
        yield i, j, np.stack(counts, 1).astype(np.int64), h, begin


def shape(counts: np.ndarray) -> np.ndarray:
    """Ratios that describe a text whatever its length, from its counts."""
    c = counts.astype(float)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 5], 1)
    return np.stack([
        np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, c[:, 3] / np.maximum(c[:, 6], 1), c[:, 4] / words,
        c[:, 7] / chars, c[:, 8] / chars, c[:, 9] / words, c[:, 10] / words, np.log1p(c[:, 10]) / np.log1p(words), np.log1p(words / np.maximum(c[:, 6], 1)),
    ], 1)

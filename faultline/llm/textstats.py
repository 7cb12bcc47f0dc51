"""Counts over the words and lines of one whole text; plain functions that run inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# What a word and a symbol are.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task makes of them in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_in_repeats(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` (a power of two) words found twice or more, the first included.

    Windows are numbered by doubling: pairs of words, then pairs of pairs. Equal numbers mean equal
    windows, so nothing rests on a hash.
    """
    n = len(words)
    if n <= window:
        return 0
    first: dict[str, int] = {}
    ids = np.fromiter((first.setdefault(w, i) for i, w in enumerate(words)), dtype=np.int64, count=n)
    step = 1
    while True:
        if step > 1:
            _, ids = np.unique(ids, return_inverse=True)
        pairs = ids[:-step] * n + ids[step:]
        step *= 2
        if step == window:
            break
        ids = pairs
        ordered = np.sort(pairs)
        if not (ordered[1:] == ordered[:-1]).any():
            return 0
    _, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[number] > 1)
    change = np.zeros(n + 1, dtype=np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def line_counts(text: str) -> tuple[int, int]:
    """(lines that hold a word, those of them equal to an earlier line)."""
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines), len(lines) - len(set(lines))

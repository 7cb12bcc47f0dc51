"""Counting terms and building term vectors on Arrow batches of normalised texts; runs inside tasks.

Only numpy and pyarrow are used, and the module travels with the task, so executors need no copy
of this package. Words are numbered within a piece of a batch, so work on text is done once per
distinct word and the rest on numbers. A piece holds a bounded amount of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

PIECE_BYTES = 16 << 20
# Terms are surveyed by hash in so many buckets, whatever the corpus holds.
BUCKETS = 1 << 18


@dataclass
class Words:
    """The words of some texts: text and number of each, and the distinct words the numbers stand for."""

    texts: int
    text: np.ndarray
    word: np.ndarray
    names: list[str]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, second word) of neighbours within a text."""
        near = self.text[:-1] == self.text[1:]
        return self.text[:-1][near], self.word[:-1][near], self.word[1:][near]

    def hashes(self) -> np.ndarray:
        return np.fromiter((zlib.crc32(name.encode()) for name in self.names), np.uint64, len(self.names))


def words_of(texts: pa.Array, ignored: Collection[str]) -> Words:
    """Words of two characters or more that are not ignored, as `vector_words` has them."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    encoded = pc.dictionary_encode(pc.list_flatten(lists))
    names = encoded.dictionary.to_pylist()
    word = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.fromiter((len(name) >= 2 and name not in ignored for name in names), bool, len(names))[word]
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return Words(len(texts), text[kept], word[kept], names)


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of at most so many bytes; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def bucket(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Bucket of a word, or of a pair of words, from the hashes of words."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15)
    if second is not None:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second + np.uint64(1)
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed ^ (mixed >> np.uint64(33))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def survey(batches: Iterable[pa.RecordBatch], ignored: Collection[str], leaders: int) -> Iterator[pa.RecordBatch]:
    """(bucket, null, n): occurrences of a task's terms by bucket; (null, term, n): those of a piece's commonest terms."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for texts in pieces(batch.column(0)):
            words = words_of(texts, ignored)
            if not len(words.word):
                continue
            size, hashed = len(words.names), words.hashes()
            n_words = np.bincount(words.word, minlength=size)
            _, first, second = words.pairs()
            pair, n_pairs = np.unique(first * size + second, return_counts=True)
            total += np.bincount(bucket(hashed), weights=n_words, minlength=BUCKETS).astype(np.int64)
            at = bucket(hashed[pair // size], hashed[pair % size])
            total += np.bincount(at, weights=n_pairs, minlength=BUCKETS).astype(np.int64)
            counts = np.concatenate([n_words, n_pairs])
            top = np.argpartition(-counts, leaders)[:leaders] if len(counts) > leaders else np.arange(len(counts))
            top = top[counts[top] > 0]
            yield _rows(None, [_name(words.names, pair, i) for i in top], counts[top])
    held = np.flatnonzero(total)
    yield _rows(held, None, total[held])


def _name(names: list[str], pair: np.ndarray, at: int) -> str:
    """Name of a term by its place among a piece's words and pairs."""
    if at < len(names):
        return names[at]
    both = int(pair[at - len(names)])
    return f"{names[both // len(names)]} {names[both % len(names)]}"


def _rows(buckets: np.ndarray | None, terms: list[str] | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(n), pa.int32()) if buckets is None else pa.array(buckets, pa.int32()),
            pa.nulls(len(n), pa.string()) if terms is None else pa.array(terms, pa.string()),
            pa.array(n, pa.int64()),
        ],
        names=["bucket", "term", "n"],
    )


def counts(batches: Iterable[pa.RecordBatch], ignored: Collection[str], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """(term, cf, df) within a piece of every term whose bucket is wanted: occurrences and texts it is in."""
    wanted_bucket = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
    for batch in batches:
        for texts in pieces(batch.column(0)):
            words = words_of(texts, ignored)
            hashed, size = words.hashes(), len(words.names)
            hit = wanted_bucket[bucket(hashed)][words.word]
            single, cf, df = _counted(words.text[hit], words.word[hit])
            text, first, second = words.pairs()
            hit = wanted_bucket[bucket(hashed[first], hashed[second])]
            pair, pair_cf, pair_df = _counted(text[hit], first[hit] * size + second[hit])
            terms = [words.names[i] for i in single] + [f"{words.names[i // size]} {words.names[i % size]}" for i in pair]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()),
                    pa.array(np.concatenate([cf, pair_cf]), pa.int64()),
                    pa.array(np.concatenate([df, pair_df]), pa.int64()),
                ],
                names=["term", "cf", "df"],
            )


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms with their occurrences and the number of texts they are in."""
    distinct, place, cf = np.unique(term, return_inverse=True, return_counts=True)
    in_text = np.unique(text * max(1, len(distinct)) + place)
    return distinct, cf, np.bincount(in_text % max(1, len(distinct)), minlength=len(distinct))


class Vocabulary:
    """Terms and weights by which texts become vectors of unit length."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float], ignored: Collection[str]) -> None:
        self.idf, self.ignored = np.asarray(idf, dtype=float), ignored
        self.single = {term: i for i, term in enumerate(terms) if " " not in term}
        split = [(i, *term.split(" ")) for i, term in enumerate(terms) if " " in term]
        self.part = {word: i for i, word in enumerate(dict.fromkeys(w for _, *both in split for w in both))}
        keys = np.array([self.part[a] * len(self.part) + self.part[b] for _, a, b in split], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_terms = keys[order], np.array([i for i, *_ in split], dtype=np.int64)[order]

    def _terms(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, term number) of every occurrence of a known term."""
        size = len(words.names)
        single = np.fromiter((self.single.get(name, -1) for name in words.names), np.int64, size)[words.word]
        part = np.fromiter((self.part.get(name, -1) for name in words.names), np.int64, size)
        text, first, second = words.pairs()
        keys = part[first] * len(self.part) + part[second]
        known = (part[first] >= 0) & (part[second] >= 0)
        text, keys = text[known], keys[known]
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == keys
            text, pair = text[hit], self.pair_terms[at[hit]]
        else:
            text, pair = text[:0], keys[:0]
        hit = single >= 0
        return np.concatenate([words.text[hit], text]), np.concatenate([single[hit], pair])

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, indices, values) of the vectors of some texts."""
        text, term = self._terms(words_of(texts, self.ignored))
        size = max(1, len(self.idf))
        entry, n = np.unique(text * size + term, return_counts=True)
        text, term = entry // size, entry % size
        value = n * self.idf[term]
        norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts)))
        return np.bincount(text, minlength=len(texts)), term, value / np.where(norm == 0, 1.0, norm)[text]

    def column(self, texts: pa.Array) -> pa.Array:
        """The vectors as a column of sparse vectors, in the layout Spark ML gives them."""
        parts = [self.vectors(piece) for piece in pieces(texts)]
        sizes, indices, values = (np.concatenate(part) for part in zip((np.zeros(0),) * 3, *parts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        rows = len(sizes)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(rows), pa.int8()),
                pa.array(np.full(rows, len(self.idf)), pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(indices, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64())),
            ],
            names=["type", "size", "indices", "values"],
        )


def travel_with_tasks() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Scoring of vectors against a group of queries; runs inside tasks.

Only numpy, pandas and pyarrow are used, and the module travels with the task, so executors need no copy
of this package.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

RANK_DIGITS = 9
# Queries and dense vectors scored at a time, and places whose greatest similarity stands for them in a first look.
TILE = 128
PIECE = 4096
RUN = 64
# Queries scored at a time as sparse vectors; a term is common where one in so many documents of a block has it.
SPARSE_TILE = 32
COMMON_SHARE = 10
# Elements of the arrays packed into one row.
MOST_ELEMENTS = 1 << 22


def unit_rows(vectors: Iterable) -> np.ndarray:
    rows = np.stack([np.asarray(vector, dtype=float) for vector in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def packed_dense(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of (id, vector), so many at a time as one row: ids in order, dimensions, vectors of unit length as bytes.

    A null vector and one with a null in it have no direction and are kept as NaN.
    """
    for ids, vectors in _runs(batches, rows):
        order = pc.sort_indices(ids)
        ids, vectors = ids.take(order), vectors.take(order)
        sizes = {size for size in pc.list_value_length(vectors).unique().to_pylist() if size is not None}
        if len(sizes) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
        size = sizes.pop() if sizes else 0
        matrix = np.full((len(ids), size), np.nan)
        values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
        matrix[pc.is_valid(vectors).to_numpy(zero_copy_only=False)] = values.reshape(-1, size)
        yield _row(ids, pa.array([size], pa.int32()), _bytes(unit_rows(matrix)))


def _runs(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[list[pa.Array]]:
    """The columns of so many rows at a time, fewer where the arrays of the second one hold much; batches do not matter."""
    held, size, elements = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)[: rows - size])
            stop = max(int(np.searchsorted(ends, MOST_ELEMENTS - elements, side="right")), 0 if size else 1)
            if stop:
                held.append(batch.slice(0, stop))
                size, elements = size + stop, elements + int(ends[stop - 1])
                batch = batch.slice(stop)
            if batch.num_rows or size == rows:
                yield _joined(held)
                held, size, elements = [], 0, 0
    if size:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays(columns) for columns in zip(*(part.columns for part in parts))]


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _row(ids: pa.Array, *columns: pa.Array) -> pa.RecordBatch:
    """One row: an array of ids and what goes with them."""
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, *columns], names=[f"c{i}" for i in range(1 + len(columns))])


class Best:
    """The best k places of some rows of similarities that come in pieces; ties go to the lower place.

    The k-th best of the maxima of runs bounds the k-th best of a row, so only what reaches it is rounded and sorted.
    NaN goes last and comes out as NaN.
    """

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.bound = k, np.full(rows, -np.inf)
        self.row, self.place, self.sims = [], [], []

    def add(self, sims: np.ndarray, first: int) -> None:
        """Similarities of all rows at the places from the first one on, which no other piece has."""
        starts = np.arange(0, sims.shape[1], RUN)
        runs = np.maximum.reduceat(sims, starts, axis=1)
        if np.isnan(runs).any():
            sims = np.where(np.isnan(sims), -np.inf, sims)
            runs = np.maximum.reduceat(sims, starts, axis=1)
        if len(starts) >= self.k:
            least = np.partition(runs, len(starts) - self.k, axis=1)[:, len(starts) - self.k]
            self.bound = np.maximum(self.bound, least)
        # Twice what rounding moves a value by, so that none that ties once rounded is lost.
        least = self.bound - 2 * 10.0**-RANK_DIGITS
        row, run = np.nonzero(runs >= least[:, None])
        place = starts[run][:, None] + np.arange(RUN)
        inside = place < sims.shape[1]
        found = np.where(inside, sims[row[:, None], np.where(inside, place, 0)], -np.inf)
        at, within = np.nonzero((found >= least[row][:, None]) & inside)
        self.row.append(row[at])
        self.place.append(place[at, within] + first)
        self.sims.append(found[at, within])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, similarity) in order."""
        row, place, found = (np.concatenate(parts) for parts in (self.row, self.place, self.sims))
        found = np.round(found, RANK_DIGITS) + 0.0
        order = np.lexsort((place, -found, row))
        row, place, found = row[order], place[order], found[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[kept], place[kept], np.where(np.isneginf(found[kept]), np.nan, found[kept])


def _winners(query_ids: pa.Array, ids: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    row, place, sims = found
    return pa.RecordBatch.from_arrays(
        [query_ids.take(pa.array(row)), ids.take(pa.array(place)), pa.array(sims, mask=np.isnan(sims))],
        names=["query_id", "incident_id", "similarity"],
    )


def dense_top_k(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, incident_id, similarity) of the best k of every packed block of rows for every query of a packed group."""
    for batch in batches:
        for at in range(batch.num_rows):
            query_ids, size, asked, ids, width, rows = (column[at] for column in batch.columns)
            if (size.as_py() or width.as_py()) != (width.as_py() or size.as_py()):
                raise ValueError(f"vectors of different lengths: {size.as_py()}, {width.as_py()}")
            asked, rows = (_held(m, float).reshape(len(n.values), -1) for m, n in ((asked, query_ids), (rows, ids)))
            if asked.shape[1] != rows.shape[1]:  # one side has no vector at all
                asked, rows = (np.full((len(m), 1), np.nan) for m in (asked, rows))
            for start in range(0, len(asked), TILE):
                best = Best(len(asked[start : start + TILE]), k)
                for first in range(0, len(rows), PIECE):
                    best.add(asked[start : start + TILE] @ rows[first : first + PIECE].T, first)
                yield _winners(query_ids.values.slice(start, TILE), ids.values, best.result())


def flat(vectors: pd.Series, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of a column of arrays."""
    sizes = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    return np.repeat(rows, sizes), np.concatenate([np.asarray(v) for v in vectors]) if len(vectors) else np.zeros(0)


def pair_scores(batches: Iterable[pd.DataFrame], at_once: int = 2048) -> Iterator[pd.DataFrame]:
    """(query_id, incident_id, similarity) of rows that hold a query's and a document's sparse unit vectors."""
    for batch in batches:
        for start in range(0, len(batch), at_once):
            part = batch.iloc[start : start + at_once]
            rows = np.arange(len(part))
            row, term = flat(part["q_indices"], rows)
            _, weight = flat(part["q_values"], rows)
            row_d, term_d = flat(part["d_indices"], rows)
            _, weight_d = flat(part["d_values"], rows)
            width = int(max(term.max(initial=0), term_d.max(initial=0))) + 1
            keys, keys_d = row * width + term.astype(np.int64), row_d * width + term_d.astype(np.int64)
            sims = np.zeros(len(part))
            if len(keys) and len(keys_d):
                at = np.minimum(np.searchsorted(keys, keys_d), len(keys) - 1)
                hit = keys[at] == keys_d
                sims = np.bincount(row_d[hit], weights=weight[at[hit]] * weight_d[hit], minlength=len(part))
            yield pd.DataFrame(
                {
                    "query_id": part["query_id"].to_numpy(),
                    "incident_id": part["incident_id"].to_numpy(),
                    "similarity": np.round(sims, RANK_DIGITS) + 0.0,
                }
            )


def packed_queries(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of (id, indices, values), so many at a time as one row: ids, and sizes, indices and values as bytes."""
    for ids, indices, values in _runs(batches, rows):
        yield _row(ids, *map(_bytes, _elements(indices, values)))


def packed_postings(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same of documents by term: ids in order, where each term's documents start, their places, their weights."""
    for ids, indices, values in _runs(batches, rows):
        order = pc.sort_indices(ids)
        sizes, terms, weights = _elements(indices.take(order), values.take(order))
        width = int(terms.max(initial=-1)) + 1
        by_term = np.argsort(terms.astype(np.uint16) if width <= 1 << 16 else terms, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=width))])
        places = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_term]
        yield _row(ids.take(order), _bytes(starts), _bytes(places), _bytes(weights[by_term]))


def _elements(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, indices, values) of sparse vectors."""
    sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    flat_indices, flat_values = (pc.list_flatten(part).to_numpy(zero_copy_only=False) for part in (indices, values))
    return sizes, flat_indices.astype(np.int32), flat_values.astype(float)


class Block:
    """Documents by term. Those of common terms lie in a matrix, so that only rarer terms are gone through by list."""

    def __init__(self, rows: int, starts: np.ndarray, places: np.ndarray, weights: np.ndarray) -> None:
        self.rows, self.starts, self.places, self.weights = rows, starts, places.astype(np.intp), weights
        self.counts = np.diff(starts)
        common = np.flatnonzero(self.counts * COMMON_SHARE >= max(1, rows))
        self.column = np.full(len(self.counts), -1)
        self.column[common] = np.arange(len(common))
        self.common = np.zeros((len(common), rows))
        for at, term in enumerate(common):
            listed = slice(starts[term], starts[term + 1])
            self.common[at, self.places[listed]] = weights[listed]

    def scores(self, sizes: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Products of sparse queries with all documents; terms that no document has are left out."""
        row, known = np.repeat(np.arange(len(sizes)), sizes), indices < len(self.counts)
        row, indices, values = row[known], indices[known], values[known]
        column = self.column[indices]
        asked = np.zeros((len(sizes), len(self.common)))
        asked[row[column >= 0], column[column >= 0]] = values[column >= 0]
        sims = asked @ self.common
        rare = (column < 0) & (self.counts[indices] > 0)
        row, indices, values = row[rare], indices[rare], values[rare]
        starts, stops, counts = self.starts[indices], self.starts[indices + 1], self.counts[indices]
        ends = np.searchsorted(row, np.arange(len(sizes) + 1))
        for at in np.flatnonzero(np.diff(ends)):
            part = slice(ends[at], ends[at + 1])
            lists = [slice(start, stop) for start, stop in zip(starts[part].tolist(), stops[part].tolist())]
            weights = np.concatenate([self.weights[listed] for listed in lists])
            weights *= np.repeat(values[part], counts[part])
            places = np.concatenate([self.places[listed] for listed in lists])
            sims[at] += np.bincount(places, weights=weights, minlength=self.rows)
        return sims


def grid_top_k(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, incident_id, similarity) of the best k of every block of documents for every query of a group.

    A row holds a packed group of queries and a packed block of documents. Ties go to the lower id.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            query_ids, sizes, indices, values, ids, starts, places, weights = (column[at] for column in batch.columns)
            sizes, indices, values = _held(sizes, np.int32), _held(indices, np.int32), _held(values, float)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            block = Block(len(ids.values), _held(starts, np.int64), _held(places, np.int32), _held(weights, float))
            for start in range(0, len(sizes), SPARSE_TILE):
                stop = min(start + SPARSE_TILE, len(sizes))
                part = slice(ends[start], ends[stop])
                best = Best(stop - start, k)
                best.add(block.scores(sizes[start:stop], indices[part], values[part]), 0)
                yield _winners(query_ids.values.slice(start, SPARSE_TILE), ids.values, best.result())


def _held(column: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), kind)


def travel_with_tasks() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

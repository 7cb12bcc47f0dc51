"""Approximate nearest neighbours by collision counting with query-centred windows.

Vectors are scaled to unit length and projected on random directions; each direction keeps its
values as one sorted array. A query opens a window around its own value in every array and counts
how often each vector falls in. Vectors with enough collisions are verified on the originals. The
windows widen (virtual rehashing, nothing is hashed anew) until enough verified vectors lie within
the radius the windows stand for, or everything has been verified.

The index is cut into blocks of rows and the queries into groups; each (block, group) pair is one
cell with its own sorted arrays, and only the best rows of a cell go on. Rows are replicated per
query group and queries per block; every row is indexed, nothing is sampled.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id; of rows that share an id every different vector counts, and an id
scores what its best vector does; rows with the query's id are the query's own; vectors are compared with
vectors of their own length only, however large or small; ties go to the smaller id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import materialise

NEAREST = 5
DIRECTIONS = 64
# Half a window is this many radii: a vector at the radius collides in 2 of 3 directions on average.
HALF_WIDTH = 1.0
# Collisions that call for verification, as a share of the directions.
THRESHOLD = 0.62
FIRST_RADIUS = 0.5
GROWTH = 1.15
SEED = 7
ROWS_IN_CELL = 16384
QUERIES_IN_CELL = 512

SCHEMA = "query_id long, vec_id long, score double"


@functools.cache
def directions(dimension: int, count: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, count))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: no square over- or underflows."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -exponent[:, None])


def cosine(query: np.ndarray, norm: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision, the same for a row wherever it lies."""
    return (rows * query).sum(axis=1) / (norms * norm)


class SortedArrays:
    """The index of one block: unit vectors projected on each direction, values in order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, count: int = DIRECTIONS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], scaled(rows[order])
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))
        values = ((self.rows / self.norms[:, None]) @ directions(rows.shape[1], count)).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.count = count

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, nearest: int = NEAREST
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the nearest rows found for each query, nearest first."""
        n, least = len(self.ids), int(np.ceil(THRESHOLD * self.count))
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        centres = ((queries / norms[:, None]) @ directions(queries.shape[1], self.count)).T
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.values, centres, strict=True)], axis=1)
        high = low.copy()
        different = len(np.unique(self.ids))
        state = [_Search(self.ids, q, nearest, different) for q in query_ids]
        active = np.array([q for q, s in enumerate(state) if s.wanted], dtype=np.int64)
        radius = FIRST_RADIUS
        while len(active):
            half = HALF_WIDTH * radius
            near = 1.0 - radius * radius / 2.0  # the cosine of unit vectors at this distance
            wider_low = low.copy()
            wider_high = high.copy()
            for j, (v, c) in enumerate(zip(self.values, centres, strict=True)):
                wider_low[active, j] = np.searchsorted(v, c[active] - half)
                wider_high[active, j] = np.searchsorted(v, c[active] + half, side="right")
            going = []
            for q in active.tolist():
                bounds = (x[q].tolist() for x in (wider_low, low, high, wider_high))
                fresh = [part for o, a, b, c, d in zip(self.order, *bounds, strict=True) for part in (o[a:b], o[c:d])]
                s = state[q]
                s.counts += np.bincount(np.concatenate(fresh), minlength=n)
                new = np.flatnonzero((s.counts >= least) & ~s.done)
                if len(new):
                    s.add(new, (self.rows[new] @ queries[q]) / (self.norms[new] * norms[q]))
                if s.done.all() or s.ids_from(near) >= s.wanted:
                    best = s.contenders()
                    exact = cosine(queries[q], norms[q], self.rows[best], self.norms[best])
                    best = best[np.lexsort((best, -exact))]
                    exact = -np.sort(-exact, kind="stable")
                    # an id counts once, with its best vector
                    _, first = np.unique(self.ids[best], return_index=True)
                    first = np.sort(first)[:nearest]
                    yield int(query_ids[q]), self.ids[best[first]], exact[first]
                    state[q] = None
                else:
                    going.append(q)
            low, high = wider_low, wider_high
            active = np.array(going, dtype=np.int64)
            radius *= GROWTH


class _Search:
    """Where one query stands: collisions so far, rows verified and their cosines."""

    def __init__(self, ids: np.ndarray, query_id: int, nearest: int, different: int) -> None:
        self.ids = ids
        self.counts = np.zeros(len(ids), dtype=np.int32)
        self.done = ids == query_id
        self.wanted = min(nearest, different - int(self.done.any()))
        self.found, self.scores = np.empty(0, dtype=np.int64), np.empty(0)

    def add(self, new: np.ndarray, scores: np.ndarray) -> None:
        self.done[new] = True
        self.found = np.concatenate((self.found, new))
        self.scores = np.concatenate((self.scores, scores))

    def ids_from(self, score: float) -> int:
        """Different ids verified with at least this score."""
        return len(np.unique(self.ids[self.found[self.scores >= score]]))

    def contenders(self) -> np.ndarray:
        """Verified rows that are among the nearest ids, with all that rounding could put there."""
        order = np.argsort(-self.scores, kind="stable")
        _, first = np.unique(self.ids[self.found[order]], return_index=True)
        last = self.scores[order[np.sort(first)[self.wanted - 1]]]
        return np.sort(self.found[self.scores >= last - 1e-9])


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def search(
    vectors: DataFrame,
    is_query: Column,
    nearest: int = NEAREST,
    rows_in_cell: int = ROWS_IN_CELL,
    queries_in_cell: int = QUERIES_IN_CELL,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with `is_query` the nearest other rows found."""
    sound = vectors.filter(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")
    )
    sound = sound.filter(usable(F.col("v"))).distinct()
    rows = materialise(
        sound.withColumns({"asked": F.coalesce(is_query, F.lit(False)), "dimension": F.size("v")}), "ann-rows"
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q")).first()
    blocks = max(1, -(-sizes["n"] // rows_in_cell))
    groups = max(1, -(-sizes["q"] // queries_in_cell))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(groups)).cast("int")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    index = rows.select("vec_id", "v", "dimension", block.alias("block"), every_group.alias("group"))
    queries = rows.filter("asked").select("vec_id", "v", "dimension", every_block.alias("block"), group.alias("group"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            index = SortedArrays(left.column("vec_id").to_numpy(), _matrix(left.column("v")))
            asked = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            ids, rows = right.column("vec_id").to_numpy()[asked], _matrix(right.column("v"))[asked]
            out = [(np.full(len(i), q), i, s) for q, i, s in index.search(ids, rows, nearest)]
        parts = [np.concatenate(c) if out else [] for c in (zip(*out, strict=True) if out else ([], [], []))]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(p, type=k) for p, k in zip(parts, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    cell = ["dimension", "block", "group"]
    found = index.groupBy(cell).cogroup(queries.groupBy(cell)).applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # cells share ids only where an id has several vectors; partial aggregation comes first
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

"""Records of CSV lines on Arrow batches; runs inside tasks.

Only numpy and pyarrow are used, and the module travels with the task, so executors need no copy of this
package. A run is a stretch of lines of one file block that follow each other in a task. Whether a run starts
inside a quoted field is not known yet, so every line gets its state for either case.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# What a line does to the state: ends outside whatever came before, leaves it as it is, flips it, ends inside.
OUTSIDE, SAME, FLIP, INSIDE = range(4)
STATES = "run bigint, pos bigint, in0 int, in1 int, out0 int, out1 int, starts0 bigint, starts1 bigint"


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, -1).to_numpy(zero_copy_only=False)


def _begins(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """Whether each row is the first of its run; `last` is the file and block of the row before."""
    files, blocks = batch.column("file_path"), _numbers(batch.column("block"))
    names = _numbers(pc.dictionary_encode(files).indices)
    begins = np.ones(batch.num_rows, bool)
    begins[1:] = (names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])
    begins[0] = last is None or last != (files[0].as_py(), blocks[0])
    return begins


def _states(change: np.ndarray, entry: int) -> np.ndarray:
    """The state before each of some lines and after the last one."""
    fixed, flips = (change == OUTSIDE) | (change == INSIDE), np.concatenate([[0], np.cumsum(change == FLIP)])
    place = np.arange(1, len(change) + 1)
    last = np.concatenate([[0], np.maximum.accumulate(np.where(fixed, place, 0))])
    known = np.concatenate([[entry], (change == INSIDE).astype(np.int64)])
    return (known[last] + flips - flips[last]) & 1


def with_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the columns STATES in place of `_at` and `_change`; 0 and 1 say where their run starts.

    `in` and `out` are the states before and after a line, `starts` the records begun in the run so far.
    """
    last, held = None, None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        at, change = _numbers(batch.column("_at")), _numbers(batch.column("_change"))
        starts = np.flatnonzero(_begins(batch, last))
        cuts = np.concatenate([[0] if not len(starts) or starts[0] else [], starts, [rows]]).astype(np.int64)
        columns = {name: np.empty(rows, np.int64) for name in ("run", "pos", "in0", "in1", "out0", "out1", "starts0", "starts1")}
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if held is None or (len(starts) and start >= starts[0]):
                held = {"run": at[start], "pos": 0, "state": [0, 1], "starts": [0, 0]}
            part = slice(start, stop)
            columns["run"][part] = held["run"]
            columns["pos"][part] = held["pos"] + np.arange(stop - start)
            for entry in (0, 1):
                states = _states(change[part], held["state"][entry])
                columns[f"in{entry}"][part], columns[f"out{entry}"][part] = states[:-1], states[1:]
                columns[f"starts{entry}"][part] = held["starts"][entry] + np.cumsum(1 - states[:-1])
                held["state"][entry], held["starts"][entry] = states[-1], columns[f"starts{entry}"][stop - 1]
            held["pos"] += stop - start
        last = (batch.column("file_path")[rows - 1].as_py(), _numbers(batch.column("block"))[rows - 1])
        kept = [name for name in batch.schema.names if name not in ("_at", "_change")]
        added = [pa.array(v, pa.int32() if name.startswith(("in", "out")) else pa.int64()) for name, v in columns.items()]
        yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + added, names=[*kept, *columns])


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one record that follow each other put together; `whole` says whether that is all of the record.

    A batch has file_path, file_name, run, pos, record, inside, goes_on and line.
    """
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _record_begins(batch, pending[-1] if pending else None)
        if not begins.any():
            pending.append(batch)
            continue
        first, last = np.flatnonzero(begins)[[0, -1]]
        if pending:
            yield _records([*pending, batch.slice(0, first)], np.array([0]))
        if last > first:
            yield _records([batch.slice(first, last - first)], np.flatnonzero(begins[first:last]))
        pending = [batch.slice(last)]
    if pending:
        yield _records(pending, np.array([0]))


def _record_begins(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Whether a line begins a record, or one that does not follows another line than the one before it."""
    run, pos, inside = (_numbers(batch.column(name)) for name in ("run", "pos", "inside"))
    previous = (None, None) if before is None else tuple(before.column(name)[before.num_rows - 1].as_py() for name in ("run", "pos"))
    follows = np.zeros(len(run), bool)
    follows[1:] = (run[1:] == run[:-1]) & (pos[1:] == pos[:-1] + 1)
    follows[0] = previous[0] == run[0] and previous[1] + 1 == pos[0]
    return (inside == 0) | ~follows


def _records(parts: list[pa.RecordBatch], starts: np.ndarray) -> pa.RecordBatch:
    """One row per record that starts at the given rows."""
    table = pa.Table.from_batches(parts).combine_chunks()
    rows = table.num_rows
    offsets = pa.array(np.concatenate([starts, [rows]]), pa.int64())
    lines = pc.cast(table.column("line"), pa.large_string()).combine_chunks()
    lists = pa.LargeListArray.from_arrays(offsets, lines.chunk(0) if isinstance(lines, pa.ChunkedArray) else lines)
    text = pc.cast(pc.binary_join(lists, pa.scalar("\n", pa.large_string())), pa.string())
    firsts, lasts = pa.array(starts), pa.array(np.concatenate([starts[1:], [rows]]) - 1)
    whole = pc.and_(
        pc.equal(pc.take(table.column("inside"), firsts), 0), pc.equal(pc.take(table.column("goes_on"), lasts), 0)
    )
    shown = [pc.take(table.column(name), firsts) for name in ("file_path", "file_name", "run", "pos", "record")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in [*shown, whole, text]]
    return pa.RecordBatch.from_arrays(columns, names=["file_path", "file_name", "run", "pos", "record", "whole", "line"])


def travel_with_tasks() -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

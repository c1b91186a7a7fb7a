"""Running values along an order, by mergeable states.

A window without partitions puts all rows into one task, and one per group puts a long
trajectory into one. Here a state is something that two neighbouring stretches of rows
merge into one, and the scan runs in two passes over rows laid out by range partitions
(``ordering``):

1. each task merges its rows and gives one state for the group that reaches its end;
2. the states (one row a partition) are merged in order, so that every partition knows
   the state before its first row; each task then runs over its rows from there.

Rows move once, for the range partitions; no task holds more than a batch. The work is
linear in the rows, whatever the length of a group."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import _tag_positions


class Affine:
    """x -> a * x + b; two maps merge into one. The running value starts at 0."""

    size, none = 2, (1.0, 0.0)

    @staticmethod
    def merge(first, then):
        return first[0] * then[0], then[0] * first[1] + then[1]

    @staticmethod
    def run(columns, new, start):
        """(running values after each row, state at the end)."""
        a, b = columns
        x = affine(np.where(new, 0.0, a), b, start[1])
        last = np.flatnonzero(new)
        factor = a[last[-1] :].prod() if len(last) else start[0] * a.prod()
        return [x], (float(factor), float(x[-1]))


class Moments:
    """(n, mean, M2): M2 is the sum of squares around the mean, so that large offsets cost
    no digits."""

    size, none = 3, (0.0, 0.0, 0.0)

    @staticmethod
    def merge(first, then):
        n = first[0] + then[0]
        if n == 0:
            return 0.0, 0.0, 0.0
        gap = then[1] - first[1]
        return n, first[1] + gap * then[0] / n, first[2] + then[2] + gap * gap * first[0] * then[0] / n

    @classmethod
    def run(cls, columns, new, start):
        out, state = np.empty((len(new), 3)), start
        for i, (fresh, *row) in enumerate(zip(new.tolist(), *(c.tolist() for c in columns), strict=True)):
            state = tuple(row) if fresh else cls.merge(state, row)
            out[i] = state
        return list(out.T), tuple(float(s) for s in state)


def affine(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """x[i] = a[i] * x[i - 1] + b[i] from x[-1] = ``start``: columns of a square at a time,
    then the square's rows one after the other."""
    n = len(a)
    if n == 0:
        return np.zeros(0)
    width = int(np.sqrt(n)) + 1
    rows = -(-n // width)
    p, x = np.ones(rows * width), np.zeros(rows * width)
    p[:n], x[:n] = a, b
    p, x = p.reshape(rows, width), x.reshape(rows, width)
    for j in range(1, width):
        x[:, j] += p[:, j] * x[:, j - 1]
        p[:, j] *= p[:, j - 1]
    before = np.empty(rows)
    for r in range(rows):
        before[r] = start
        start = x[r, -1] + p[r, -1] * start
    return (x + p * before[:, None]).ravel()[:n]


def _keys(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, tuple, tuple]:
    """(rows whose group differs from the row before, first group, last group)."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        col = batch.column(c)
        a, b = col.slice(1), col.slice(0, batch.num_rows - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~np.asarray(same)
    ends = [tuple(batch.column(c)[i].as_py() for c in by) for i in (0, batch.num_rows - 1)]
    return new, *ends


def _walk(batches: Iterator[pa.RecordBatch], kind, by, elements, start_of):
    """Runs over a partition's batches; yields (batch, running values, new, whether the
    first row starts a group, state, groups)."""
    state, before, single = None, None, True
    first = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new, head, tail = _keys(batch, by)
        if state is None:
            first = head
            state, joined = start_of(batch)
            fresh = not joined
            if fresh:
                state = kind.none
        else:
            fresh = head != before
            single &= not fresh
        single &= not new.any()
        reset = new.copy()
        reset[0] = fresh
        columns = [np.asarray(pc.fill_null(batch.column(c), 0.0), dtype=np.float64) for c in elements]
        start = state
        values, state = kind.run(columns, reset, start)
        before = tail
        yield batch, values, reset, start, state, first, tail, single


def _summary(kind, by, elements):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch, _, _, _, state, first, tail, single in _walk(batches, kind, by, elements, lambda b: (kind.none, True)):
            end = (batch.column("_tf_pid")[0].as_py(), pickle.dumps(first), pickle.dumps(tail), single, list(state))
        if end:
            yield pa.RecordBatch.from_arrays([
                pa.array([end[0]], pa.int64()), pa.array([end[1]], pa.binary()), pa.array([end[2]], pa.binary()), pa.array([end[3]]),
                pa.array([end[4]], pa.list_(pa.float64()))], ["pid", "first", "last", "single", "state"])

    return run


def _apply(kind, by, elements, keep, out, inclusive, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start_of(batch):
            s = starts.get(batch.column("_tf_pid")[0].as_py())
            return (s, True) if s is not None else (kind.none, False)

        for batch, values, reset, start, *_ in _walk(batches, kind, by, elements, start_of):
            if not inclusive:
                before = list(start)[-len(values) :]
                values = [np.where(reset, 0.0, np.concatenate([[s], v[:-1]])) for s, v in zip(before, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v) for v in values)], [*keep, *out])

    return run


def running(df: DataFrame, kind, by: Sequence[str], order: Sequence[Column | str], elements: Sequence[Column], out: Sequence[str], *,
            inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """``df`` with the running values ``out`` of the state ``kind`` (``Affine``: one value;
    ``Moments``: n, mean, M2) over the rows' ``elements`` in ``order`` within ``by``.

    ``inclusive=False`` gives the values before each row (0 at a group's first). ``by`` and
    ``order`` together must be unique for a defined result; a null element counts as 0."""
    names = [f"_tf_e{i}" for i in range(kind.size)]
    keep = df.columns
    # the elements come from their row: they are made where it is read, not moved and written
    tagged = _tag_positions(df, [*by, *order], num_partitions).drop("_tf_mid", "_tf_local")
    tagged = tagged.withColumns({n: e.cast("double") for n, e in zip(names, elements, strict=True)})
    ends = tagged.mapInArrow(_summary(kind, by, names), "pid long, first binary, last binary, single boolean, state array<double>").collect()
    starts, state, last = {}, None, None
    for r in sorted(ends, key=lambda r: r.pid):  # one row a partition
        goes_on = last is not None and pickle.loads(r["first"]) == last
        if goes_on:
            starts[r.pid] = state
        state = kind.merge(state, tuple(r.state)) if goes_on and r.single else tuple(r.state)
        last = pickle.loads(r["last"])
    schema = df.withColumns({c: F.lit(0.0) for c in out}).schema
    return tagged.mapInArrow(_apply(kind, list(by), names, keep, list(out), inclusive, starts), schema)

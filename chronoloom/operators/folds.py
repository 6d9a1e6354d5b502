"""Operators whose state depends on every row before: ordered folds that stream.

Rows of a stream come in order, in Arrow batches, and a fold keeps a few numbers
of state, so memory doesn't grow with a stream's length.  Streams spread over
tasks by key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_import


#: Numbers that may be null.
_PANDAS = {T.LongType: "Int64", T.DoubleType: "Float64"}


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], added: list[tuple[str, T.DataType]], start: Callable[[], object]) -> DataFrame:
    """Add columns computed in order: ``start()`` makes a stream's state, called with the row's ``columns``."""
    workers_import(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for rows in parts:
            out = []
            for own, values in zip(rows[keys].itertuples(index=False, name=None), rows[columns].itertuples(index=False, name=None), strict=True):
                if own != stream:
                    stream, state = own, start()
                out.append(state(*values))
            yield rows.assign(**{n: pd.array([o[i] for o in out], dtype=_PANDAS[type(t)]) if type(t) in _PANDAS else [o[i] for o in out] for i, (n, t) in enumerate(added)})

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class Convergence:
    """A delay that moves to its target by at most ``rate`` of media time, slower when near, at once when far."""

    def __init__(self, rate: float = 0.04, near: int = 50_000_000, snap: int = 200_000_000):
        self.rate, self.near, self.snap, self.size, self.top = rate, near, snap, None, None

    def __call__(self, pts: int, target: int) -> tuple[int, int]:
        if self.size is None:
            self.size = target
        step = max(0, pts - self.top) if self.top is not None else 0
        self.top = pts if self.top is None else max(self.top, pts)
        away = abs(target - self.size)
        if away > self.snap:
            self.size = target
        else:
            most = int(step * self.rate * min(1.0, away / self.near))
            self.size = max(self.size - most, min(self.size + most, target))
        return self.size, pts + self.size


def converged(packets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add size and out_pts: each packet's delay as it follows ``target``."""
    return fold(packets, keys, order, ["pts", "target"], [("size", T.LongType()), ("out_pts", T.LongType())], Convergence)


def paired(left: list[int], right: list[int]) -> list[tuple[int | None, int | None]]:
    """Two rising rows of times walked together, always to the nearest next pair; of equals both move."""
    if not left and not right:
        return []
    i = j = 0
    at = lambda x, k: x[k] if x and k < len(x) else None
    out = [(at(left, 0), at(right, 0))]
    while i + 1 < len(left) or j + 1 < len(right):
        nl, nr = at(left, i + 1), at(right, j + 1)
        if nl is None or nr is None or not left or not right:
            i, j = (i + 1, j) if nr is None else (i, j + 1)
        else:
            moves = ((abs(nl - nr), 0, (1, 1)), (abs(nl - right[j]), 1, (1, 0)), (abs(left[i] - nr), 2, (0, 1)))
            step = min(moves)[2]
            i, j = i + step[0], j + step[1]
        out.append((at(left, i), at(right, j)))
    return out


class Walk:
    """:func:`paired` over both streams as one, in order of time: holds the rows that one stream is ahead of the other."""

    def __init__(self):
        self.rows: tuple[deque[int], deque[int]] = deque(), deque()
        self.ended = [False, False]
        self.begun = False

    def step(self) -> list[tuple[int | None, int | None]]:
        """All pairs that can be told by now."""
        out, (left, right) = [], self.rows
        if not self.begun:
            if (not left and not self.ended[0]) or (not right and not self.ended[1]):
                return out
            self.begun = True
            if left or right:
                out.append((left[0] if left else None, right[0] if right else None))
        while True:
            more = [len(r) > 1 for r in self.rows]
            if not any(more) or any(not m and not e for m, e in zip(more, self.ended, strict=True)):
                return out
            if not all(more) or not left or not right:
                move = (more[0], more[1]) if not all(more) else (True, False)
            else:
                nl, nr = left[1], right[1]
                move = min(((abs(nl - nr), 0, (True, True)), (abs(nl - right[0]), 1, (True, False)), (abs(left[0] - nr), 2, (False, True))))[2]
            for r, go in zip(self.rows, move, strict=True):
                if go:
                    r.popleft()
            out.append((left[0] if left else None, right[0] if right else None))


def pair_streams(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """(key, left_pts, right_pts) by a greedy walk over both streams of each key.

    Both come as one stream in order of time; a key's walk holds only what one
    of them is ahead of the other.
    """
    workers_import(left.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, walk = None, Walk()

        def frame(pairs: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({key: pd.Series([p[0] for p in pairs], dtype=object), "left_pts": pd.array([p[1] for p in pairs], dtype="Int64"), "right_pts": pd.array([p[2] for p in pairs], dtype="Int64")})

        def close() -> list[tuple]:
            walk.ended[:] = [True, True]
            return [(own, *p) for p in walk.step()]

        for rows in parts:
            out: list[tuple] = []
            for k, at, side in zip(rows[key], rows[time], rows["__side"], strict=True):
                if k != own:
                    out += close()
                    own, walk = k, Walk()
                walk.rows[side].append(at)
                out += [(k, *p) for p in walk.step()]
            yield frame(out)
        yield frame(close())

    both = left.select(key, time, F.lit(0).alias("__side")).unionByName(right.select(key, time, F.lit(1).alias("__side")))
    kind = left.schema[key].dataType.simpleString()
    return both.repartition(key).sortWithinPartitions(key, time, "__side").mapInPandas(run, f"{key} {kind}, left_pts long, right_pts long")

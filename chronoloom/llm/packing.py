"""Best-fit decreasing packing of documents into sequences of a fixed length.

``cut`` encodes documents and cuts those longer than a sequence into pieces,
the first of which takes what is left over, so that all others are full.
``pack`` packs all pieces of the table together, whatever its size: best fit
in decreasing order only looks at lengths, so it runs on the histogram of
lengths (``length`` numbers, however many documents there are).  A segment tree
over remaining capacities counts the open sequences of each and finds the
tightest that still fits in logarithmic time; all pieces of one length that go
to open sequences of one capacity are placed in one step.  A document then
finds its sequence by its rank among the pieces of its length.

Ranks come from the rows' place in their input split (a chunk) and from prefix
sums over the chunks; so no task sees more than a split, and a document with
any number of pieces needs none of them together: full pieces are sequences of
their own and are settled at once.  Where documents are cut and packed in one
go, ``cut`` ranks its pieces itself and ``pack_ranked`` takes them: a second
Python function behind it would give each task a second worker process, and
these stay, with what they hold, for as long as the workers are in use.

The driver holds the histogram and the steps, of which there are at most a few
hundred for each length: a sequence takes pieces of at most
``sqrt(2 * length)`` different lengths.

Nulls: a null text is an empty document, which still has its end id; a null id
is kept.  Rows with equal ids or texts are packed each; pieces of equal length
are interchangeable and taken in the order of the table.  Very long texts are
encoded and cut in stretches.  Empty tables give empty results.  Other columns
are ignored by ``cut``; ``pack`` keeps those of its input and refuses its own
names among them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_import
from .common import lean, written
from .shingles import slices
from .tokens import MAX_PIECES, encoder, spread

#: Bytes of text that become ids at a time, and rows sent on at a time.
_BYTES, _ROWS = 4 << 20, 8192


_RANKED = ["chunk", "rank"]


class Ranks:
    """Chunk of a task's pieces, and the rank of each among those of its length and chunk."""

    def __init__(self, length: int):
        self.chunk, self.seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)

    def columns(self, size: np.ndarray) -> list[pa.Array]:
        """Of the next pieces."""
        order = np.argsort(size, kind="stable")
        of, start, many = np.unique(size[order], return_index=True, return_counts=True)
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.repeat(start, many) + self.seen[size[order]]
        self.seen[of] += many
        return [pa.array(np.full(len(size), self.chunk)), pa.array(rank)]


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, width: int = 2, ids: bool = True, max_pieces: int | None = None, ranked: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): ids are little-endian, ``width`` bytes each.

    ``ids_crc32`` is taken over ids of 32 bits, whatever the width.  Without
    ``ids`` that column is left out and only numbers leave the worker.  With
    ``max_pieces`` the encoder's table holds no more and is emptied after each
    task, for jobs whose other stages need the workers' memory.  ``ranked`` adds
    the columns (chunk, rank) of :func:`pack_ranked`.
    """

    def encode(batches):
        coder = encoder(tokenizer, width)
        coder.max_pieces = max_pieces or MAX_PIECES
        end, ranks = np.array(end_id, coder.dtype), Ranks(length)
        for batch in batches:
            for lo, hi in slices(batch.column(1), _BYTES):
                rows = batch.slice(lo, hi - lo)
                flat, at = coder.encode(rows.column(1))
                flat = np.insert(flat, at[1:], end)
                total = np.diff(at) + 1
                each = (total - 1) // length + 1
                piece = spread(np.zeros(len(each), np.int64), each)
                first = np.repeat(total - (each - 1) * length, each)
                size = np.where(piece == 0, first, length)
                ends = np.cumsum(size)
                wide = memoryview(flat.astype("<u4"))
                crc = [zlib.crc32(wide[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                arrays = [
                    rows.column(0).take(pa.array(np.repeat(np.arange(len(each)), each))),
                    pa.array(piece.astype(np.int32)),
                    pa.array(np.where(piece == 0, 0, first + (piece - 1) * length)),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    offsets = pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int64))
                    arrays.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, offsets, pa.py_buffer(flat)]))
                    names.append("ids")
                if ranked:
                    arrays += ranks.columns(size)
                    names += _RANKED
                out = pa.RecordBatch.from_arrays(arrays, names=names)
                for a in range(0, out.num_rows, _ROWS):
                    part = out.slice(a, _ROWS)
                    yield part.set_column(5, "ids", part.column(5).cast(pa.binary())) if ids else part
        if max_pieces:
            coder.forget()

    workers_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(encode), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids + ", chunk long, rank long" * ranked)


class OpenBins:
    """Open sequences by remaining capacity, as runs (first number, how many).

    The leaves of the segment tree count those of each capacity.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, n: int) -> None:
        at = self.leaves + left
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, left: int, first: int, n: int) -> None:
        if n:
            self.runs[left].append((first, n))
            self._add(left, n)

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Take out a run of sequences (capacity, first, how many) with the least capacity of ``size`` or more."""
        count, at = self.count, self.leaves + size
        if not count[at]:
            # up to the first ancestor that has something to the right, then down along its left side
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        left = at - self.leaves
        first, n = self.runs[left].pop()
        self._add(left, -n)
        return left, first, n


@dataclass
class Plan:
    """Steps in order of (length, rank): pieces from ``rank`` on go to sequences from ``first`` on, ``each`` to one, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        begin = np.searchsorted(self.length, length, side="left")
        at = np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            lo, hi = np.searchsorted(self.length, [size, size + 1])
            at[own] = begin[own] + np.searchsorted(self.rank[lo:hi], rank[own], side="right") - 1
        nth = rank - self.rank[at]
        return self.first[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing of ``histogram[length]`` pieces of each length up to ``capacity``."""
    bins, steps, n = OpenBins(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[size]
        while rest:
            # the tightest sequence takes pieces until none fits any more, then the next one of its run does
            found = bins.tightest(size)
            left, first, many = found or (capacity, n, -(-rest // (capacity // size)))
            n += 0 if found else many
            each = left // size
            full = min(many, rest // each)
            if full:
                steps.append((size, rank, first, each, capacity - left))
                bins.put(left - each * size, first, full)
                rank, rest = rank + full * each, rest - full * each
            if full < many:
                if rest:  # fewer than one sequence takes
                    steps.append((size, rank, first + full, each, capacity - left))
                    bins.put(left - rest * size, first + full, 1)
                    full, rest = full + 1, 0
                bins.put(left, first + full, many - full)
    steps.sort()
    columns = np.array(steps, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=n)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For lengths in decreasing order: the sequence and the place there of each."""
    size = np.array(lengths, np.int64)
    of, many = np.unique(size, return_counts=True)
    rank = np.arange(len(size)) - np.searchsorted(-size, -size)
    numbers, places = plan(dict(zip(of.tolist(), many.tolist(), strict=True)), capacity).place(size, rank)
    return numbers.tolist(), places.tolist()


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows whose column ``length`` is from 1 up to ``length``.

    Sequences are numbered from 0; those that one full piece makes have
    negative numbers.
    """
    workers_import(pieces.sparkSession)
    if taken := {c.lower() for c in pieces.columns} & {"sequence_id", "offset", *_RANKED}:
        raise ValueError(f"the input has columns {sorted(taken)}")
    at, names = pieces.columns.index("length"), [*pieces.columns, *_RANKED]

    def number(batches):
        ranks = Ranks(length)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *ranks.columns(batch.column(at).to_numpy())], names=names)

    return pack_ranked(pieces.mapInArrow(number, T.StructType([*pieces.schema.fields, *_longs(*_RANKED)])), length)


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in names]


def pack_ranked(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """:func:`pack` for pieces whose last two columns are (chunk, rank), which the result leaves out."""
    workers_import(pieces.sparkSession)
    names, fields = pieces.columns[:-2], pieces.schema.fields[:-2]
    at = names.index("length")
    numbered = written(pieces, "numbered")
    full, rest = numbered.where(F.col("length") == length), numbered.where(F.col("length") != length)
    many = written(rest.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # the histogram has at most ``length`` rows
    steps = plan({r[0]: r[1] for r in many.groupBy("length").agg(F.sum("n")).collect()}, length)
    upto = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = many.select("chunk", "length", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    ranked = rest.join(before, ["chunk", "length"]).select(*names, (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches):
        for batch in batches:
            numbers, places = steps.place(batch.column(at).to_numpy(), batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers), pa.array(places)], names=[*names, "sequence_id", "offset"])

    placed = ranked.mapInArrow(lean(place), T.StructType([*fields, *_longs("sequence_id", "offset")]))
    alone = -1 - F.shiftleft("chunk", 38) - F.col("rank")
    return placed.unionByName(full.select(*names, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))

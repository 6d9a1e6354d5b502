"""Functions over bytes and sample arrays, in Arrow batches, and a registry for a user's own."""

from __future__ import annotations

import functools
import inspect
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import PandasUDFType


def batched(returns: str):
    """A function over Arrow batches, made into a column function when it is called, as types need a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns, PandasUDFType.SCALAR)(*columns)

        return call

    return wrap


@batched("binary")
def pack_audio(pts: pd.Series, rate: pd.Series, samples: pd.Series) -> pd.Series:
    """Big-endian: start (u64 ns), rate (u32), channels (u8), count (u32), then doubles; one array a channel."""

    def one(p, r, s):
        data = np.stack([np.asarray(c, float) for c in s], axis=1).astype(">f8")
        return struct.pack(">QIBI", int(p), int(r), data.shape[1], data.shape[0]) + data.tobytes()

    return pd.Series([one(*x) for x in zip(pts, rate, samples, strict=True)])


@batched("struct<pts:long,rate:long,samples:array<array<double>>>")
def unpack_audio(data: pd.Series) -> pd.DataFrame:
    rows = []
    for b in data:
        pts, rate, channels, n = struct.unpack(">QIBI", b[:17])
        rows.append((pts, rate, np.frombuffer(b[17:], ">f8").astype(float).reshape(n, channels).T.tolist()))
    return pd.DataFrame(rows, columns=["pts", "rate", "samples"])


@batched("binary")
def pack_frame(width: pd.Series, height: pd.Series, pts: pd.Series, rgba: pd.Series) -> pd.Series:
    """Big-endian: width (u32), height (u32), time (u64 ns), then four bytes a pixel."""
    return pd.Series([struct.pack(">IIQ", int(w), int(h), int(p)) + bytes(d) for w, h, p, d in zip(width, height, pts, rgba, strict=True)])


@batched("struct<width:long,height:long,pts:long,rgba:binary>")
def unpack_frame(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(*struct.unpack(">IIQ", b[:16]), bytes(b[16:])) for b in data], columns=["width", "height", "pts", "rgba"])


@batched("array<double>")
def spectrum(samples: pd.Series) -> pd.Series:
    """Magnitudes of a real Fourier transform, scaled by the number of samples."""
    return pd.Series([(np.abs(np.fft.rfft(s)) / max(1, len(s))).tolist() for s in samples])


@batched("struct<average:double,median:double,level:double,frequency:double>")
def spectrum_levels(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Mean, median and greatest magnitude of a spectrum under a Hann window, and the frequency of the greatest."""
    rows = []
    for s, r in zip(samples, rate, strict=True):
        x = np.asarray(s, float)
        if not len(x):
            rows.append((0.0, 0.0, 0.0, 0.0))
            continue
        bins = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x)))))
        rows.append((bins.mean(), np.median(bins), bins.max(), float(bins.argmax()) * r / len(x)))
    return pd.DataFrame(rows, columns=["average", "median", "level", "frequency"])


def same_levels(actual: Column, expected: Column, average: float, median: float, level: float) -> Column:
    """Whether two structs of spectrum levels agree within tolerances."""
    near = lambda f, t: F.abs(actual[f] - expected[f]) <= t
    return near("average", average) & near("median", median) & near("level", level)


def strongest_bins(samples: Column, rate: Column, n: int = 10, noise: float = 0.0) -> Column:
    """The ``n`` strongest parts of a spectrum, scaled by the number of samples: array of (frequency, level), strongest first.

    Parts at or below ``noise`` count as none; of equal ones the lower frequency comes first.
    """

    @batched("array<struct<frequency:double,level:double>>")
    def find(samples: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for s, r in zip(samples, rate, strict=True):
            x = np.asarray(s, float)
            size = max(1, len(x))
            bins = np.abs(np.fft.rfft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / size)))) / size if len(x) else np.zeros(0)
            best = [i for i in np.argsort(-bins, kind="stable")[:n].tolist() if bins[i] > noise]
            out.append([{"frequency": i * float(r) / size, "level": float(bins[i])} for i in best])
        return pd.Series(out)

    return find(samples, rate)


def same_bins(actual: Column, expected: Column, level: float) -> Column:
    """Whether the strongest parts have the same frequencies and levels within a tolerance, as far as both lists go."""
    both = F.least(F.size(actual), F.size(expected))
    pairs = F.zip_with(F.slice(actual, F.lit(1), both), F.slice(expected, F.lit(1), both), lambda a, e: (a["frequency"] == e["frequency"]) & (F.abs(a["level"] - e["level"]) <= level))
    return F.forall(pairs, lambda ok: ok)


def _swizzle(order: tuple[int, ...]):
    def run(pixels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, np.uint8).reshape(-1, 4)[:, order].tobytes() for b in pixels])

    return batched("binary")(run)


bgra_to_rgba, argb_to_rgba = _swizzle((2, 1, 0, 3)), _swizzle((1, 2, 3, 0))


@batched("struct<y:binary,u:binary,v:binary>")
def nv12_planes(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """A plane of luma and one of alternating chroma as three planes."""
    rows = []
    for b, w, h in zip(data, width, height, strict=True):
        a = np.frombuffer(b, np.uint8)
        rows.append((a[: w * h].tobytes(), a[w * h :: 2].tobytes(), a[w * h + 1 :: 2].tobytes()))
    return pd.DataFrame(rows, columns=["y", "u", "v"])


def _packed_422(y: int, u: int, v: int):
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            a = np.frombuffer(b, np.uint8)
            rows.append((a[y::2].tobytes(), a[u::4].tobytes(), a[v::4].tobytes()))
        return pd.DataFrame(rows, columns=["y", "u", "v"])

    return batched("struct<y:binary,u:binary,v:binary>")(run)


uyvy_planes, yuyv_planes = _packed_422(1, 0, 2), _packed_422(0, 1, 3)


def units(data: bytes) -> list[bytes]:
    """Units of a byte stream between start codes of two or more zeros and a one."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0:
        start = at + 3
        at = data.find(b"\0\0\1", start)
        unit = data[start : at if at >= 0 else len(data)]
        out.append(unit.rstrip(b"\0") if at >= 0 else unit)
    return [u for u in out if u]


#: Kinds of units that can only come before a picture's first slice.
_OPENERS, _SLICES = frozenset({6, 7, 8, 9, 14, 15, 16, 17, 18}), frozenset({1, 5})


def access_units(data: bytes) -> list[bytes]:
    """A stream's pictures, each with the units that belong to it, after start codes of four bytes.

    A picture begins with what opens one, or with a slice that starts at its
    first block, once the one before has a slice.
    """
    out: list[list[bytes]] = []
    has_slice = True
    for unit in units(data):
        kind = unit[0] & 31
        first = kind in _SLICES and len(unit) > 1 and unit[1] >= 128  # block number 0 is a single set bit
        if not out or has_slice and (kind in _OPENERS or first):
            out.append([])
            has_slice = False
        has_slice |= kind in _SLICES
        out[-1].append(unit)
    return [b"".join(b"\0\0\0\1" + u for u in picture) for picture in out]


@batched("array<binary>")
def split_pictures(data: pd.Series) -> pd.Series:
    return pd.Series([access_units(bytes(b)) for b in data])


def messages(data: bytes) -> tuple[list[bytes], bytes]:
    """Whole messages of a side channel, each after its length in four big-endian bytes, and what is left over."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, data[at:]


def message(payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + payload


@batched("array<struct<width:long,height:long,pts:long,rgba:binary>>")
def frames_of(data: pd.Series) -> pd.Series:
    """The frames in a recorded side channel."""
    one = lambda b: dict(zip(("width", "height", "pts"), struct.unpack(">IIQ", b[:16]), strict=True), rgba=b[16:])
    return pd.Series([[one(m) for m in messages(bytes(b))[0]] for b in data])


@batched("binary")
def start_codes_to_lengths(data: pd.Series) -> pd.Series:
    """Each unit after its length in four bytes."""
    return pd.Series([b"".join(struct.pack(">I", len(u)) + u for u in units(bytes(b))) for b in data])


@batched("binary")
def lengths_to_start_codes(data: pd.Series) -> pd.Series:
    def one(b: bytes) -> bytes:
        out, at = [], 0
        while at + 4 <= len(b):
            n = struct.unpack(">I", b[at : at + 4])[0]
            out.append(b"\0\0\0\1" + b[at + 4 : at + 4 + n])
            at += 4 + n
        return b"".join(out)

    return pd.Series([one(bytes(b)) for b in data])


def _fits(value: object, kind: object) -> bool:
    """Whether a parameter has a type; a dict of types is a struct, a list of one type an array."""
    if isinstance(kind, dict):
        return isinstance(value, dict) and value.keys() == kind.keys() and all(_fits(value[k], t) for k, t in kind.items())
    if isinstance(kind, list):
        return isinstance(value, list) and all(_fits(v, kind[0]) for v in value)
    return isinstance(value, kind) and not (kind is not bool and isinstance(value, bool))


class Functions:
    """A user's functions by name, each over batches, with the types of its parameters.

    A function is checked when it is registered: it must take its columns and
    then its parameters by position, and its result type must be one of Spark's.
    """

    def __init__(self):
        self._known: dict[str, tuple[Callable, str, tuple]] = {}

    def register(self, name: str, f: Callable, returns: str, params: tuple = (), columns: int | None = None) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        T.DataType.fromDDL(returns)
        if columns is not None:
            try:
                inspect.signature(f).bind(*range(columns + len(params)))
            except TypeError as wrong:
                raise TypeError(f"{name}: {wrong}") from None
        self._known[name] = f, returns, params

    def unregister(self, name: str) -> None:
        if name not in self._known:
            raise KeyError(name)
        del self._known[name]

    def call(self, name: str, *columns: Column, params: tuple = ()) -> Column:
        """Apply a function; its parameters must have the registered types."""
        f, returns, kinds = self._known[name]
        if len(params) != len(kinds) or not all(map(_fits, params, kinds)):
            raise TypeError(f"{name} takes {kinds}")

        def run(*series: pd.Series) -> pd.Series:
            return f(*series, *params)

        return batched(returns)(run)(*columns)

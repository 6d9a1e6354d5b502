"""Word shingles as 64-bit numbers, whole batches of texts at a time in numpy.

Words are runs of anything but ASCII white space, A-Z in lower case.  A word's
number mixes its bytes, eight at a time, and its length; a shingle's number
mixes those of its words in order.  Texts come as lists or as Arrow columns,
whose bytes are read where they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Which bytes stand between words, and what each byte counts as.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)
#: A word of more bytes is hashed at once.
_LONG = 1024


def text_bytes(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; of a column nothing is copied."""
    if isinstance(texts, list):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets, data = texts.buffers()[1:]
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    return np.frombuffer(data or b"", np.uint8), at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def runs(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows (from, to) of about ``most`` bytes each, or of one row that is longer."""
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = hi
    return out


def slices(column: pa.Array, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows of a column of texts, for work that takes a multiple of their bytes."""
    return runs(text_bytes(column)[1], most)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: shifts and odd multiples."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(texts: pa.Array | list[str | None], between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words in order, and how many words each text has."""
    data, at = text_bytes(texts)
    data, at = LOWER[data[at[0] : at[-1]]], at - at[0]
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(at) - 1, np.int64)
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    cut = at[(at > 0) & (at < n)]
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # words of two texts may touch
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _numbers(data, start, end - start), np.diff(np.searchsorted(start, at))


def _numbers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit numbers of stretches of bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(n, "<u8", padded, strides=(1,))
    own = eight[start] & _MASKS[np.minimum(size, 8)]
    key = mixed(own ^ (size.astype(_U) << _U(56)))
    left, j = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        own = eight[start[left] + j] & _MASKS[np.minimum(size[left] - j, 8)]
        key[left] = mixed(key[left] * _U(_BASE) ^ own)
        j += 8
        left = left[size[left] > j]
    for i in np.flatnonzero(size > _LONG).tolist():
        key[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return key


def shingles(texts: pa.Array | list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all shingles of k words, and how many each text has, repeats included.

    A text with fewer words has one shingle of them all; without words, none.
    """
    numbers, counts = words(texts)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    n = len(numbers)
    rolled = np.zeros(max(0, n - k + 1), _U)
    for j in range(k):
        rolled = rolled * _U(_BASE) + numbers[j : j + len(rolled)]
    rolled = mixed(rolled)
    owner = np.repeat(np.arange(len(texts)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts, each)
    short = (counts < k)[owner] if len(owner) else np.zeros(0, bool)
    out = np.empty(len(owner), _U)
    out[~short] = rolled[place[~short]]
    for i in np.flatnonzero(short):
        doc = owner[i]
        own = numbers[starts[doc] : starts[doc] + counts[doc]]
        total = len(own)
        for x in own:
            total = (total * _BASE + int(x)) % (1 << 64)
        out[i] = mixed(np.array([total], _U))[0]
    return out, each


def sets(texts: pa.Array | list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    numbers, each = shingles(texts, k)
    return [np.unique(x) for x in np.split(numbers, np.cumsum(each)[:-1])] if len(each) else []


def digest(shingle_set: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()

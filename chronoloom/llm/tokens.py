"""Encoding whole texts with a tokenizer file, in Python workers.

Byte-level tokenizers cut a text before their merges in such a way that a cut
always falls between a character that isn't white space and a blank or line
feed after it, and between a letter or digit and a full stop or comma that ends
such a stretch.  So a text can be encoded piece by piece at these places, and
pieces that come again are looked up.  :class:`Encoder` finds the places in the
UTF-8 bytes of about ``CHUNK`` bytes at a time, tells pieces of up to 24 bytes
apart by 64-bit numbers, and asks the tokenizers library for every piece that
its table doesn't have.  A longer text is taken in several chunks.  Beyond
``max_pieces`` the table keeps only pieces that came again, or starts anew.
"""

from __future__ import annotations

import os
from functools import cached_property

import numpy as np
import pyarrow as pa

from .shingles import mixed, runs, text_bytes

MAX_PIECES = 800_000
#: Bytes of text at a time, and the longest piece that is looked up.
CHUNK, LONGEST = 1 << 20, 24
#: New pieces before they are merged into the large table.
SETTLE = 1 << 16
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)

_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One for each worker process, file and width."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


class Table:
    """Pieces by number: sorted keys, and for each where its ids stand in one flat array."""

    def __init__(self, dtype: str):
        self.keys = np.zeros(0, _U)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.flat = np.zeros(0, dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are there."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return place, self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray, again: np.ndarray | bool = False) -> None:
        """Sorted new keys with their ids, one after the other."""
        at = np.searchsorted(self.keys, keys)
        start = np.cumsum(size, dtype=np.int64) - size + len(self.flat)
        self.keys, self.start, self.size = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.start, start), (self.size, size)))
        self.again = np.insert(self.again, at, again)
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[place], self.size[place]

    def thin(self, most: int) -> None:
        """Keep pieces that came again since the last time; nothing if these fill most of the table."""
        keep = self.again if self.again.sum() < most * 3 // 4 else np.zeros(len(self.keys), bool)
        start, size = self.start[keep], self.size[keep]
        self.flat = self.flat[spread(start, size)]
        self.keys, self.size, self.start = self.keys[keep], size, np.cumsum(size, dtype=np.int64) - size
        self.again = np.zeros(len(self.keys), bool)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, ``size`` numbers of them."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Texts to ids of ``width`` bytes each, little-endian, without special tokens."""

    def __init__(self, path: str, width: int = 4):
        self.path, self.width, self.dtype = path, width, f"<u{width}"
        self.max_pieces = MAX_PIECES
        self.forget()
        if (n := self.tokenizer.get_vocab_size(with_added_tokens=True)) > 1 << (8 * width):
            raise ValueError(f"{n} ids don't fit into {width} bytes")

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return tokenizer

    def forget(self) -> None:
        # new pieces go to a small table first, so that the large one is seldom rebuilt
        self.old, self.new = Table(self.dtype), Table(self.dtype)

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in pieces], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for ids in found for i in ids), self.dtype, int(size.sum())), size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last ends.

        The column must hold few enough texts for their ids to fit into memory.
        """
        data, at = text_bytes(column)
        out, total = [], [0]
        for lo, hi in runs(at, CHUNK):
            for a, b in self._chunks(data, int(at[lo]), int(at[hi])):
                begin = at[lo:hi] if hi > lo + 1 else np.array([a])
                ids, upto = self._encode(data[a:b], np.append(begin, b) - a)
                out.append(ids)
                if hi > lo + 1:
                    total += (total[-1] + upto[1:]).tolist()
                elif a == at[lo]:
                    total.append(total[-1] + int(upto[-1]))
                else:
                    total[-1] += int(upto[-1])
        return np.concatenate([np.zeros(0, self.dtype), *out]), np.array(total, np.int64)

    @staticmethod
    def _chunks(data: np.ndarray, a: int, b: int):
        """Cut a long text where two pieces meet; all else is one chunk."""
        while b - a > 2 * CHUNK:
            at = a + CHUNK
            while at < b:
                near = data[at - 1 : min(b, at + 4096)]
                cut = np.flatnonzero(((near[1:] == 0x20) | (near[1:] == 0x0A)) & ~_WHITE[near[:-1]] & (near[:-1] < 0x80))
                if len(cut):
                    break
                at += 4096
            if at >= b:
                break
            yield a, at + int(cut[0])
            a = at + int(cut[0])
        yield a, b

    def _starts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where pieces begin: at each text's begin, at blanks and line feeds after no white space, at stops before these."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        if n > 1:
            blank = (data[1:] == 0x20) | (data[1:] == 0x0A)
            cut = blank & ~_WHITE[data[:-1]]
            # after a character of several bytes that may be white space, nothing is cut
            after = np.flatnonzero(cut & (data[:-1] >= 0x80))
            if len(after):
                z, y, x = data[after], data[after - 1], data[np.maximum(after - 2, 0)]
                white = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
                white |= (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
                white |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8F) | (z >= 0xA8) & (z <= 0xAF))) | ((y == 0x81) & (z >= 0x9F) & (z <= 0xA4)))
                white |= ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xEF) & (y == 0xBB) & (z == 0xBF))
                cut[after[white]] = False
            first[1:n] = cut
        first[begin] = True
        first[n] = True
        if n > 2:
            stop = np.flatnonzero((data[1:] == 0x2E) | (data[1:] == 0x2C)) + 1
            first[stop[first[stop + 1] & _ALNUM[data[stop - 1]] & ~first[stop]]] = True
        first[n] = False
        return np.flatnonzero(first)

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that begin and end at ``at``, all in a row, and where each text's begin and end."""
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        begin = at[:-1]
        starts = self._starts(data, begin[begin < n])
        size = np.diff(starts, append=n)
        padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
        words = np.ndarray(n + LONGEST, "<u8", padded, strides=(1,))
        key = np.zeros(len(starts), _U)
        for j in (16, 8, 0):
            own = words[starts + j] & _MASKS[np.clip(size - j, 0, 8)]
            key = mixed(key ^ own) if j else key ^ own
        # without the length, a piece and one with zero bytes after it would be the same
        key = mixed(key + (size.astype(_U) << _U(58)))
        long = np.flatnonzero(size > LONGEST)
        key[long] = ~_U(0)  # one key for all, which the table never gets
        known, place = np.unique(key, return_inverse=True)
        one = np.zeros(len(known), np.int64)  # a piece with each key
        one[place] = np.arange(len(starts))
        wanted = size[one] <= LONGEST
        in_old, old = self.old.find(known)
        in_new, new = self.new.find(known)
        missing = np.flatnonzero(wanted & ~old & ~new)
        if len(missing):
            raw = data.tobytes()
            a = starts[one[missing]]
            ids, sizes = self._library([raw[x:y] for x, y in zip(a.tolist(), (a + size[one[missing]]).tolist(), strict=True)])
            self.new.add(known[missing], sizes, ids)
            in_new, new = self.new.find(known)
            seen = new.copy()
            seen[missing] = False
        else:
            seen = new
        self.old.again[in_old[old]] = True
        self.new.again[in_new[seen]] = True
        shift = len(self.old.flat)
        start, count = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        start[old], count[old] = self.old.ids(in_old[old])
        start[new], count[new] = self.new.ids(in_new[new])
        start[new] += shift
        start, count = start[place], count[place]
        extra = np.zeros(0, self.dtype)
        if len(long):
            extra, sizes = self._library([data[x : x + y].tobytes() for x, y in zip(starts[long].tolist(), size[long].tolist(), strict=True)])
            start[long], count[long] = shift + len(self.new.flat) + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        # ids of the pieces that occur, from up to three arrays
        where = spread(start, count)
        out = np.empty(len(where), self.dtype)
        low = where < shift
        out[low] = self.old.flat[where[low]]
        rest = np.concatenate([self.new.flat, extra])
        out[~low] = rest[where[~low] - shift]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, at)]
        if len(self.new.keys) > SETTLE:
            self._settle()
        return out, upto

    def _settle(self) -> None:
        """Move what is new into the large table."""
        if len(self.old.keys) + len(self.new.keys) > self.max_pieces:
            self.old.thin(self.max_pieces)
            self.new.thin(self.max_pieces)
        self.old.add(self.new.keys, self.new.size, self.new.flat[spread(self.new.start, self.new.size)], self.new.again)
        self.new = Table(self.dtype)

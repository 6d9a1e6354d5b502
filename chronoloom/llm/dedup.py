"""MinHash near-duplicates by one-permutation hashing with optimal densification.

Every shingle is hashed once; high bits pick one of ``BINS`` bins, and each bin
keeps the least of the low bits.  A bin that got nothing takes the value of
another one, found by a universal hash of (bin, attempt) that is the same for
all documents, so that two sets agree in it as often as in full bins.  Four
bins are a band; :mod:`near` joins bands, forms star-shaped candidates and
verifies them on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import near
from .shingles import mixed, shingles

BINS = 128
_PROBES = 4096


def _donors() -> np.ndarray:
    """For each bin the bins that it asks in turn."""
    x = np.arange(BINS * _PROBES, dtype=np.uint64).reshape(BINS, _PROBES)
    return (mixed(x + np.uint64(0xD1B54A32D192ED03)) % np.uint64(BINS)).astype(np.int64)


_DONORS = _donors()


def signatures(texts: pa.Array | list[str | None], k: int) -> np.ndarray:
    """One row of 16-bit numbers for each text; all ones without shingles."""
    numbers, each = shingles(texts, k)
    h = mixed(numbers ^ np.uint64(0xA0761D6478BD642F))
    place = np.repeat(np.arange(len(texts), dtype=np.uint64), each) * np.uint64(BINS) + (h >> np.uint64(57))
    order = np.sort((place << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    place = order >> np.uint64(32)
    first = np.ones(len(order), bool)
    first[1:] = place[1:] != place[:-1]
    least = np.zeros(len(texts) * BINS, np.uint64)
    filled = np.zeros(len(texts) * BINS, bool)
    least[place[first].astype(np.int64)] = order[first]
    filled[place[first].astype(np.int64)] = True
    value = (mixed(least & np.uint64(0xFFFFFFFF)) >> np.uint64(48)).astype(np.uint16).reshape(len(texts), BINS)
    filled = filled.reshape(len(texts), BINS)
    out = value.copy()
    # all empty bins ask their next bin at once, until each has found a full one
    rows, bins = np.nonzero(~filled & (each > 0)[:, None])
    for donor in _DONORS.T:
        if not len(rows):
            break
        own = donor[bins]
        found = filled[rows, own]
        out[rows[found], bins[found]] = value[rows[found], own[found]]
        rows, bins = rows[~found], bins[~found]
    out[rows, bins] = value[rows, filled[rows].argmax(axis=1)]
    out[each == 0] = 0xFFFF
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``: see :func:`near.link`.

    Nulls, empty and very long texts, equal ids, repeated rows, ties, empty
    tables and other columns are dealt with as :mod:`near` states.
    """
    return near.link(docs, signatures, shingle_words, percent)

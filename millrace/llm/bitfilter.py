"""A bit filter over 64-bit keys, sized by their number, made without a task that holds all of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and bits at most (64 MB): what more keys need is dealt over several filters (see `blocks_for`).
KEY_BITS, MOST_BITS = 32, 1 << 29
#: 64-bit words of a page, the unit in which filters are put together; keys that one task enters, about.
PAGE, KEYS_PER_TASK = 4096, 1_000_000


def blocks_for(keys: int) -> int:
    """Filters that so many keys need, each of MOST_BITS at most."""
    return max(1, -(-KEY_BITS * keys // MOST_BITS))


def size_for(keys: int) -> int:
    """Bits of a filter for so many keys: a power of two between a page and MOST_BITS."""
    return min(MOST_BITS, max(64 * PAGE, 1 << (KEY_BITS * max(1, keys) - 1).bit_length()))


#: The places of a key in a filter, before they are cut to its size.
_SLOTS = (lambda k: k, lambda k: k >> np.uint64(34), lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(35))


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for slot in _SLOTS:
            yield slot(keys) & np.uint64(bits - 1)


def made(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], keys: int) -> tuple[np.ndarray, int]:
    """The filter of all keys that `keys_of` gives for the batches of `rows`; `keys`: about how many there are.

    Each task enters about KEYS_PER_TASK keys into a filter of its own, MOST_BITS at most, and hands the driver the pages
    that it touched, task after task. Nothing is shuffled.
    """
    bits = size_for(keys)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for at in _slots(keys_of(b), bits):
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        for p in np.flatnonzero(own.reshape(-1, PAGE).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([own[p * PAGE : (p + 1) * PAGE].tobytes()], pa.binary())], ["page", "bits"])

    out = np.zeros(bits // 64, np.uint64)
    tasks = 1 + keys // KEYS_PER_TASK
    for r in rows.coalesce(tasks).mapInArrow(filled, "page int, bits binary").toLocalIterator():
        out[r["page"] * PAGE : (r["page"] + 1) * PAGE] |= np.frombuffer(r["bits"], np.uint64)
    return out, bits


def passes(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the filter's; all that are pass."""
    shape, keys = keys.shape, keys.ravel()
    left, some = None, keys
    for slot in _SLOTS:  # each for the keys only that passed those before
        with np.errstate(over="ignore"):
            at = slot(some) & np.uint64(size - 1)
        hit = np.flatnonzero((bits[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
        left, some = hit if left is None else left[hit], some[hit]
    on = np.zeros(keys.size, bool)
    on[left] = True
    return on.reshape(shape)


def of_column(rows: DataFrame, column: str = "key") -> tuple[np.ndarray, int]:
    """The filter of a column of a stored table."""
    return made(rows.select(F.col(column)), lambda b: b.column(0).to_numpy().view(np.uint64), rows.count())

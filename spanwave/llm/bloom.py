"""A pair of Bloom filters over 64-bit hashes: seen once, seen at least twice.

Every task fills its own pair. Pairs are merged by bit segment, on the executors:
``once = a.once | b.once`` and ``twice = a.twice | b.twice | (a.once & b.once)``. A hash that two
tasks hold, or one task holds twice, always has all its bits in ``twice``; other hashes may, by
chance. Only ``twice`` is handed back to the tasks. Its size is bounded by ``MAX_BITS``: past that
the share of chance hits rises and more rows take the exact path, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from spanwave.llm.storage import distinct

PROBES = 3
MIN_BITS = 1 << 16
MAX_BITS = 1 << 30  # 128 MB, the most a task holds
SEGMENTS = 512
FLUSH = 1_000_000  # hashes a task gathers before it hands on a pair

SCHEMA = "segment int, once binary, twice binary"


def bits_for(items: int, per_item: int) -> int:
    """The power of two with at least ``per_item`` bits an item, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, int(items * per_item - 1)).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """One row of bit positions per hash; all in one segment."""
    width = max(1, bits // SEGMENTS)
    h = hashes.astype(np.uint64, copy=False)
    base = (h & np.uint64(bits // width - 1)) * np.uint64(width)
    step = (h >> np.uint64(33)) | np.uint64(1)
    start = h >> np.uint64(12)
    at = np.empty((len(h), PROBES), np.uint64)
    for i in range(PROBES):
        at[:, i] = base | ((start + step * np.uint64(i)) & np.uint64(width - 1))
    return at


def pair_rows(hashes: np.ndarray, bits: int) -> pd.DataFrame:
    """The filter pair of the given hashes as sorted bit offsets by segment."""
    width = max(1, bits // SEGMENTS)
    values, counts = np.unique(hashes, return_counts=True)
    parts = []
    for chosen in (values, values[counts > 1]):
        where = distinct(positions(chosen, bits).astype(np.uint32))
        offset = where & np.uint32(width - 1)
        cut = np.searchsorted(where, np.arange(bits // width + 1) * width)
        parts.append([offset[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])
    rows = [(i, o, t) for i, (o, t) in enumerate(zip(*parts, strict=True)) if o]
    return pd.DataFrame(rows, columns=["segment", "once", "twice"])


def fill(hash_batches: Iterator[np.ndarray], bits: int) -> Iterator[pd.DataFrame]:
    """Filter pairs of one task, handed on after every ``FLUSH`` hashes."""
    kept: list[np.ndarray] = []
    held = 0
    for hashes in hash_batches:
        kept.append(hashes)
        held += len(hashes)
        if held >= FLUSH:
            yield pair_rows(np.concatenate(kept), bits)
            kept, held = [], 0
    if held:
        yield pair_rows(np.concatenate(kept), bits)


def twice_filter(pairs: DataFrame, bits: int, spark: SparkSession) -> Broadcast:
    """Merge the tasks' pairs by segment and broadcast the bits of ``twice``."""
    width = max(1, bits // SEGMENTS)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(width, np.uint8)
        for once, twice in zip(part["once"], part["twice"], strict=True):
            at = np.frombuffer(once, np.uint32)
            seen[at] = np.minimum(seen[at] + 1, 2)
            seen[np.frombuffer(twice, np.uint32)] = 2
        return pd.DataFrame({"segment": [int(part["segment"].iloc[0])], "bits": [np.packbits(seen == 2).tobytes()]})

    merged = pairs.groupBy("segment").applyInPandas(merge, "segment int, bits binary")
    filled = np.zeros((bits // width, width // 8), np.uint8)
    for row in merged.toLocalIterator():
        filled[row.segment] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(filled.reshape(-1))


def may_repeat(hashes: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits in the filter."""
    if not len(hashes):
        return np.zeros(0, bool)
    at = positions(hashes, len(filled) * 8)
    bits = filled[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)
    return (bits & 1).all(axis=1)

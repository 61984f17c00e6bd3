"""Counts of all keys (words, n-grams) of a corpus, kept as a bounded table that every task can have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograde.llm.words import pieces_of as parts_of

#: Most keys whose counts every task gets (16 bytes each); the bitmap of repeated keys has 2**MAP_BITS bits.
FREQUENT, MAP_BITS = 1 << 19, 27
#: Keys that a task holds before it passes them on, and about as many as a range of hashes holds.
HELD, RANGE_KEYS = 500_000, 1_500_000
_U = np.uint64


class Rarity:
    """The counts of the frequent keys, and which keys may be repeated."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, repeated: np.ndarray, shift: int):
        self.keys, self.counts, self.repeated, self.shift = keys, counts, repeated, shift

    def parts(self) -> tuple:
        """What a task needs to build the same again."""
        return self.keys, self.counts, self.repeated, self.shift

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the frequent keys, 0 for the others."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        cut = keys >> _U(self.shift)
        at = np.minimum(np.searchsorted(self.keys, cut), len(self.keys) - 1)
        return np.where(self.keys[at] == cut, self.counts[at], 0)

    def may_repeat(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> _U(64 - MAP_BITS)
        return (self.repeated[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts, in order."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def count_keys(docs: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], volume: int) -> Rarity:
    """Count the keys that ``keys_of`` finds in all texts of ``docs`` (text); ``volume`` is about their number.

    Tasks sum up what they hold and pass on, for each range of hashes, packed keys: those seen once, and those seen
    more often with their counts.  Keys are cut to as many bits as their number asks for; as counts only order the
    keys, two that are cut to the same cost time and never a result.
    """
    bits = next(b for b in (32, 40, 48, 64) if b == 64 or volume * 32 <= 1 << b)
    shift, width = 64 - bits, bits // 8
    ranges = 1
    while ranges * RANGE_KEYS < volume and ranges < 1 << (MAP_BITS - 3):
        ranges *= 2
    range_bits = ranges.bit_length() - 1
    edges = np.arange(1, ranges, dtype=np.uint64) << _U(bits - range_bits) if ranges > 1 else np.zeros(0, np.uint64)

    def packed(keys: np.ndarray) -> bytes:
        """Sorted keys as steps, byte by byte of all steps: the upper bytes are nearly all zero, which compresses well."""
        steps = np.diff(keys, prepend=_U(0))
        return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()

    def unpacked(blobs: pa.ChunkedArray) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for blob in blobs:
            raw = np.frombuffer(blob.as_py(), np.uint8).reshape(width, -1)
            steps = np.zeros((raw.shape[1], 8), np.uint8)
            steps[:, :width] = raw.T
            found.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64))
        return np.concatenate(found)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flush(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
            rows = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    more = counts[a:b] > 1
                    rows.append((i, packed(keys[a:b][~more]), packed(keys[a:b][more]), counts[a:b][more].astype(np.int32).tobytes()))
            return pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3)],
                names=["range", "single", "multiple", "counts"])

        for batch in batches:
            for part in parts_of(batch.column(0)):
                keys = keys_of(part) >> _U(shift)
                held.append(_merged(keys, np.ones(len(keys), np.int64)))
                many += len(held[-1][0])
                if many > HELD:
                    keys, counts = _merged(*(np.concatenate(x) for x in zip(*held)))
                    held, many = [(keys, counts)], len(keys)
                    if many > HELD // 2:
                        yield flush(keys, counts)
                        held, many = [], 0
        if many:
            yield flush(*_merged(*(np.concatenate(x) for x in zip(*held))))

    least = max(3, volume // (4 * FREQUENT))

    def reduced(group: pa.Table) -> pa.Table:
        single, multiple = unpacked(group.column("single")), unpacked(group.column("multiple"))
        counts = np.frombuffer(b"".join(x.as_py() for x in group.column("counts")), np.int32).astype(np.int64)
        keys, counts = _merged(np.concatenate([single, multiple]), np.concatenate([np.ones(len(single), np.int64), counts]))
        span = 1 << (MAP_BITS - range_bits)
        number = group.column("range")[0].as_py()
        flags = np.zeros(span, np.uint8)
        flags[(keys[counts > 1] >> _U(bits - MAP_BITS)).astype(np.int64) - number * span] = 1
        often = counts >= least
        return pa.table({
            "range": pa.array([number], pa.int32()), "bitmap": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()),
            "keys": pa.array([keys[often].tobytes()], pa.binary()), "counts": pa.array([counts[often].tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(mapped, "range int, single binary, multiple binary, counts binary").groupBy("range").applyInArrow(
        reduced, "range int, bitmap binary, keys binary, counts binary").toArrow()  # the bitmap, and at most 4 * FREQUENT counts
    repeated = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in found.to_pylist():
        part = np.frombuffer(row["bitmap"], np.uint8)
        repeated[row["range"] * len(part):(row["range"] + 1) * len(part)] = part
        keys.append(np.frombuffer(row["keys"], np.uint64))
        counts.append(np.frombuffer(row["counts"], np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > FREQUENT:
        top = np.sort(np.lexsort((keys, -counts))[:FREQUENT])
        keys, counts = keys[top], counts[top]
    order = np.argsort(keys)
    return Rarity(keys[order], counts[order], repeated, shift)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

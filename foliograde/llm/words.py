"""Words of many texts at once as 64-bit hashes, with numpy on the UTF-8 bytes.

A batch of texts is one byte buffer; a table says which bytes belong to words and folds A-Z to a-z.  The hash of a
word is a polynomial of its bytes, read off prefix sums and mixed.  Buffers are cut between words, so memory does not
grow with the length of a text.  Two different words share a hash with probability 2**-64 or so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)[_FOLD]

#: Which bytes belong to words: all but white space; or ASCII letters and digits and all of non-ASCII characters.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place where it can be)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a batch in order: their text's row, hash, and place in the bytes of the batch."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    rows: int

    def bounds(self) -> np.ndarray:
        """For each text where its words begin in the arrays; one more entry for the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, kind: np.ndarray = PLAIN) -> Words:
    """All words of a string array; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    rows = len(texts)
    data, offsets = _bytes_of(texts)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + PIECE, side="right")))
        high = end[to - 1]
        up, down = _power_tables(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        hashes[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    hashes = mix(hashes + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(row, hashes, start, end, data, rows)


def split_batch(batch: pa.RecordBatch, text: str, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` text bytes, or a single row each, so that memory stays bounded."""
    at = batch.schema.get_field_index(text)
    column = batch.column(at)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def parts_of(texts: pa.Array, most: int = 4 * PIECE) -> Iterator[pa.Array]:
    """The array in slices of at most ``most`` text bytes, or a single text each."""
    for part in split_batch(pa.record_batch([texts], names=["text"]), "text", most):
        yield part.column(0)


def pieces_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The same in smaller slices, a piece each, for tasks that hold much besides."""
    return parts_of(texts, PIECE)

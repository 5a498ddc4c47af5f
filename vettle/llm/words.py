"""Columnar words: Arrow splits and encodes, numpy counts. Memory is bounded by slices of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batches, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def own(text: pa.Array) -> pa.Array:
    """`text` as an array of its own: Arrow's case functions go wrong on slices of arrays."""
    return text.take(pa.array(np.arange(len(text)))) if text.offset else text


def split(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of each text: offsets (rows + 1), the distinct words, and each word's place among them. Null has none."""
    text = pc.fill_null(own(text).cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    values = parts.values
    some = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    encoded = pc.dictionary_encode(values.filter(pa.array(some)))
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return before[offsets], encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(words: list[str], seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd factors, one for each place in a window of words, made by a rule.
PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(offsets: np.ndarray, word_hash: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k-word window; a row with fewer words has its whole sequence as one, without words none."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    width = np.repeat(np.minimum(n, k), count)
    total = np.zeros(len(row), dtype=np.uint64)
    spread = mixed(word_hash)
    last = max(len(spread) - 1, 0)
    for j in range(k):
        if len(row):
            at = spread[np.minimum(start + j, last)] * PLACES[j]
            total += np.where(j < width, at, np.uint64(0))
    return row, mixed(total + width.astype(np.uint64) * PLACES[63])


def distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and the sorted distinct values of each row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return np.searchsorted(row, np.arange(rows + 1)), value

"""Vectorised word and shingle hashes over batches of whole texts.

A word is a run of bytes that are no blank and none of \\x09-\\x0D; A-Z count as a-z.  Hashes
have 64 bits: a polynomial over the bytes, finished with a mixer.  Two different words or
shingles are taken for one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_MULT = np.random.default_rng(20240229).integers(1 << 32, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of text that are hashed at once; one longer text makes a batch of its own.
BATCH_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BATCH_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * BATCH_BYTES:
            _powers[name] = have
    return have[:n]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at its end the worker, which Spark keeps, gives its free memory back."""

    def tidied(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(found)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library may have no such function
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have ``most`` bytes together, or one longer text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(size[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded lower-case texts) in batches of bounded size."""
    start, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b""
        if out and size + len(b) > BATCH_BYTES:
            yield start, out
            start, size, out = i, 0, []
        out.append(b)
        size += len(b)
    if out:
        yield start, out


def words(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), over the texts one after another."""
    buf = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    lens = np.fromiter((len(b) + 1 for b in encoded), dtype=np.int64, count=len(encoded))
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(encoded), np.int64)
    inside = _IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    n = len(buf)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_P, "p", n), out=acc[1:])
    h = mix((acc[end] - acc[start]) * _power(_P_INV, "inv", n)[start] + (end - start).astype(np.uint64))
    ends = np.cumsum(lens)
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, number of shingles of each text); repeats stay.

    A text of one to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    if not len(h):
        return np.zeros(0, np.uint64), n
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    long = counts >= k
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.zeros(len(at), np.uint64)
    width = np.repeat(np.where(long, k, counts), n)
    for j in range(k):
        out += np.where(width > j, padded[at + j] * _MULT[j], np.uint64(0))
    return mix(out + width.astype(np.uint64) * _MULT[63]), n


def shingle_sets(texts: list[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, encoded in batches(texts):
        h, counts = words(encoded)
        s, n = shingles(h, counts, k)
        end = np.cumsum(n)
        for a, b in zip(end - n, end, strict=True):
            x = np.sort(s[a:b])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if b - a > 1 else x

"""Word shingles of whole texts as sorted 64-bit fingerprints, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
GROUP = 1_000_000

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
_SALT = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + n // 4, b, np.uint64))]) for b in (_BASE, _BACK))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of texts lying end to end in raw (text k is raw[bounds[k]:bounds[k + 1]]), and words per text."""
    if lower:
        raw = _LOWER[raw]
    ink = ~_SPACE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(raw)]
    begins[inner] = ink[inner]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    last = inner[inner > 0] - 1
    ends[last] = ink[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
    value = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
    return mix(value), np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: pa.Array, size: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text; a shorter text is one shingle, one without words has none."""
    for raw, bounds in byte_groups(texts):
        words, count = word_hashes(raw, bounds, lower)
        ends = np.cumsum(count)
        whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            whole += words[k : k + len(whole)] * _SALT[k]
        whole = mix(whole)
        for n, e in zip(count.tolist(), ends.tolist(), strict=True):
            if n >= size:
                yield np.unique(whole[e - n : e - size + 1])
            elif n:
                yield mix((words[e - n : e] * _SALT[32 : 32 + n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def byte_groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' bytes end to end, in groups of whole texts of about GROUP bytes, with the bounds of each; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + GROUP, side="right")) - 1)
        to = min(to, len(texts))
        yield data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k]
        k = to

"""Which of very many fingerprints do several owners have? Packed entries, one shuffle, the answers go back to the owners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: What tasks send to buckets. Kind 0: fingerprints with one owner in the task or, of several, the first; kind 1: fingerprints known to be shared, with all their owners, through any bucket.
SCHEMA = "bucket int, kind int, ids binary, prints binary, counts binary"

Row = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def entries(prints: np.ndarray, owner: np.ndarray, names: np.ndarray, buckets: int, task: int) -> list[Row]:
    """A task's rows: a fingerprint is sent once a task however many owners it has, so one that all share costs a bucket one entry a task."""
    order = np.lexsort((owner, prints))
    prints, owner = prints[order], owner[order]
    if not len(prints):
        return []
    fresh = np.concatenate([[True], (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])])
    prints, owner = prints[fresh], owner[fresh]
    begin = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    n = np.diff([*begin, len(prints)])
    many = np.repeat(n > 1, n)
    rows: list[Row] = [(task % buckets, 1, names[owner[many]], prints[many], np.zeros(0, np.int64))] if many.any() else []
    one, first = prints[begin], names[owner[begin]]
    bucket = (one >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        x = order[cuts[b] : cuts[b + 1]]
        if len(x):
            rows.append((b, 0, first[x], one[x], n[x]))
    return rows


def packed(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([squeeze(r[c], t) for r in rows], pa.binary()) for c, t in ((2, "<i8"), (3, "<u8"), (4, "<u4")))], names=["bucket", "kind", "ids", "prints", "counts"])


def squeeze(x: np.ndarray, dtype: str) -> bytes:
    """Numbers as bytes: the differences of one to the next, all lowest bytes first, then all second ones and so on, compressed. Sorted or repeated numbers take little."""
    x = np.ascontiguousarray(x, dtype)
    if x.itemsize > 1 and len(x):
        x = np.diff(x.view(f"<u{x.itemsize}"), prepend=x.dtype.type(0).view(f"<u{x.itemsize}"))
    return _press(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else b"")


def unsqueeze(packed: bytes, dtype: str) -> np.ndarray:
    raw, width = np.frombuffer(_expand(packed), np.uint8), np.dtype(dtype).itemsize
    if width == 1:
        return raw.view(dtype)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel(), dtype=f"<u{width}").view(dtype)


_coders: list = []


def _press(raw) -> bytes:
    if not _coders:
        _coders.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _coders[0].compress(raw)


def _expand(packed: bytes) -> bytes:
    _press(b"")
    return _coders[1].decompress(packed)


def meet(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owners, fingerprints) of what is shared in a bucket, by owner; and all fingerprints of kind 0 that are shared, with the number of their owners."""
    sent = t.filter(pc.equal(t.column("kind"), 0))
    known = t.filter(pc.equal(t.column("kind"), 1))
    prints, ids, counts = flat(sent, "prints", "<u8"), flat(sent, "ids", "<i8"), flat(sent, "counts", "<u4")
    order = np.argsort(prints, kind="stable")
    prints, ids, counts = prints[order], ids[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    n = np.add.reduceat(counts.astype(np.int64), begin) if len(begin) else begin
    several = np.repeat(n, np.diff([*begin, len(prints)])) > 1 if len(begin) else np.zeros(0, bool)
    ids_, prints_ = np.concatenate([ids[several], flat(known, "ids", "<i8")]), np.concatenate([prints[several], flat(known, "prints", "<u8")])
    order = np.lexsort((prints_, ids_))
    return ids_[order], prints_[order], prints[begin][n > 1], n[n > 1]


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values in sorted columns."""
    if not len(columns[0]):
        return []
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return list(zip(cuts, cuts[1:], strict=False))


def flat(t: pa.Table, name: str, dtype: str) -> np.ndarray:
    """All values of a column of squeezed numbers, end to end."""
    held = [unsqueeze(x.as_py(), dtype) for x in t.column(name)]
    return np.concatenate(held) if held else np.zeros(0, dtype)

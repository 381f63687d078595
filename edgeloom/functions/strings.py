"""Text functions: tokens, substrings, and suffix arrays, their common prefixes and suffix trees, one text a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space between tokens: carriage return, tab, line feed, NUL and blank.
SPACE = "[\\r\\t\\n\\x00 ]+"
#: Bytes that the first sort of suffixes compares; bytes of texts sorted together; rows handed to Spark at once.
HEAD, GROUP, OUT = 7, 500_000, 200_000


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token): maximal runs without white space, in order."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")
    return df.select(key, F.posexplode(words).alias("pos", "token"))


def partition_at(df: DataFrame, flag: str) -> DataFrame:
    """(idx, v, part): parts of a sequence (idx, v, flag) that begin where flag is set."""
    from ..operators.sequence import scan

    s = scan(df.select("idx", F.col(flag).cast("long").alias("v")), "sum", inclusive=True).select(F.col("idx").alias("_i"), F.col("s").alias("part"))
    return df.join(s, F.col("idx") == F.col("_i")).select("idx", "v", "part")


def find(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(id, at): where the pattern first occurs, from 0; null if nowhere."""
    at = F.locate(pattern, F.col(text)) - 1
    return df.select(F.col(key).alias("id"), F.when(at >= 0, at).cast("long").alias("at"))


def sorted_suffixes(texts: list[bytes], lcp: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(text number, start, lcp) of all suffixes of all texts, by text and then by bytes, a proper prefix first; lcp is shared with the suffix before, 0 for a text's first.

    Prefix doubling from HEAD bytes on, for all texts at once; each round sorts only the suffixes that still tie. The
    common prefixes are put together from the rounds' ranks, the longest first, so long repeats cost no more than short ones.
    """
    size = np.array([len(t) for t in texts], np.int64)
    n, owner, end = int(size.sum()), np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    data, at = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1, np.arange(n)
    head = np.zeros(n, np.int64)
    for k in range(HEAD):
        head = head << 9 | np.where(at + k < end, data[np.minimum(at + k, n - 1)], 0)
    order = np.lexsort((head, owner))
    first = np.r_[True, (head[order][1:] != head[order][:-1]) | (owner[order][1:] != owner[order][:-1])][:n]
    kind = np.int32 if n < 1 << 31 else np.int64
    rank, place, width, rounds = np.zeros(n, kind), at, HEAD, []
    while n:
        rank[order[place]] = np.maximum.accumulate(np.where(first, place, 0))
        if lcp:
            rounds.append((width, rank.copy()))
        place = place[~(first & np.r_[first[1:], True])]
        if not len(place):
            break
        i = order[place]
        key = rank[i].astype(np.int64) * (n + 1) + np.where(i + width < end[i], rank[np.minimum(i + width, n - 1)].astype(np.int64) + 1, 0)
        by = np.argsort(key, kind="stable")
        order[place], key, width = i[by], key[by], 2 * width
        first = np.r_[True, key[1:] != key[:-1]]
    start = order - (end - size[owner])[order]
    if not lcp:
        return owner, start, None
    h = np.zeros(n, np.int64)
    pair = np.nonzero(owner[1:] == owner[:-1])[0] + 1
    a, b, same = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
    for width, rank in reversed(rounds):
        x, y = a + same, b + same
        same += width * ((x < end[a]) & (y < end[b]) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    x, y = (np.where(z + same < end[z], head[np.minimum(z + same, n - 1)], 0) for z in (a, b))
    h[pair] = same + sum((x >> 9 * (HEAD - k) == y >> 9 * (HEAD - k)).astype(np.int64) for k in range(1, HEAD))
    return owner, start, h


def ranks(text: bytes) -> list[int]:
    """The suffix array: suffixes by their bytes, a proper prefix first."""
    return sorted_suffixes([text], lcp=False)[1].tolist()


def common_prefixes(text: bytes, order: list[int]) -> list[int]:
    """Length of what each suffix shares with the one before it in order; the first has 0."""
    place = {s: k for k, s in enumerate(order)}
    out, h = [0] * len(text), 0
    for s in range(len(text)):
        k = place[s]
        if k:
            other = order[k - 1]
            while s + h < len(text) and other + h < len(text) and text[s + h] == text[other + h]:
                h += 1
            out[k] = h
        h = max(0, h - 1) if k else 0
    return out


def cartesian_parents(values: list[int]) -> list[int | None]:
    """Parents in the tree whose root is the least value and whose children split the rest; the leftmost of equals is higher."""
    parent: list[int | None] = [None] * len(values)
    stack: list[int] = []
    for k, v in enumerate(values):
        last = None
        while stack and values[stack[-1]] > v:
            last = stack.pop()
        if last is not None:
            parent[last] = k
        if stack:
            parent[k] = stack[-1]
        stack.append(k)
    return parent


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and bytes of texts, about GROUP bytes at a time; no text is divided."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append((s or "").encode())
            size += len(texts[-1])
            if size >= GROUP:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _per_text(df: DataFrame, rows, schema: str) -> DataFrame:
    """rows(texts) gives (text number, column, ...) as arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            owner, *columns = rows(texts)
            keys = pa.array(ids, pa.int64())
            for k in range(0, len(owner), OUT):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[k : k + OUT], pa.int64())), *(pa.array(c[k : k + OUT], pa.int64()) for c in columns)], names=names)

    return df.select("id", "s").mapInArrow(run, schema)


def _places(owner: np.ndarray, texts: list[bytes]) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner]


def _array_rows(texts: list[bytes]) -> tuple:
    owner, start, _ = sorted_suffixes(texts, lcp=False)
    return owner, _places(owner, texts), start


def _lcp_rows(texts: list[bytes]) -> tuple:
    owner, _, lcp = sorted_suffixes(texts)
    place = _places(owner, texts)
    return owner[place > 0], place[place > 0], lcp[place > 0]


def _tree_rows(texts: list[bytes]) -> tuple:
    owner, start, lcp = sorted_suffixes(texts)
    size = [len(t) for t in texts]
    at, out = 0, []
    for k, n in enumerate(size):
        columns = _nodes(n, start[at : at + n].tolist(), lcp[at : at + n].tolist())
        at += n
        out.append([np.full(len(columns[0]), k), np.arange(len(columns[0])), *(np.array(c, np.int64) for c in columns)])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(df: DataFrame) -> DataFrame:
    """(id, rank, start) of every text (id, s), in bytes of its UTF-8."""
    return _per_text(df, _array_rows, "id long, rank long, start long")


def lcp_array(df: DataFrame) -> DataFrame:
    """(id, rank, lcp): shared with the suffix one rank before."""
    return _per_text(df, _lcp_rows, "id long, rank long, lcp long")


def _nodes(size: int, order: list[int], lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Parents, depths and starts of nodes: inner nodes are runs of suffixes that share depth bytes, leaves are suffixes."""
    parents, depths, starts, stack = [-1], [0], [0], [0]
    for start, shared in zip(order, lcp, strict=True):
        last = None
        while depths[stack[-1]] > shared:
            last = stack.pop()
        if depths[stack[-1]] < shared:
            parents[last] = len(parents)
            parents.append(stack[-1])
            depths.append(shared)
            starts.append(start)
            stack.append(parents[last])
        parents.append(stack[-1])
        depths.append(size - start)
        starts.append(start)
        stack.append(len(parents) - 1)
    return parents, depths, starts


def _tree(text: bytes) -> list[tuple[int, int, int, int]]:
    """Nodes as (node, parent, depth, start)."""
    _, start, lcp = sorted_suffixes([text])
    parents, depths, starts = _nodes(len(text), start.tolist(), lcp.tolist())
    return list(zip(range(len(parents)), parents, depths, starts, strict=True))


def suffix_tree(df: DataFrame) -> DataFrame:
    """(id, node, parent, depth, start): the tree of every text's suffixes; an edge's label is the text from start + the parent's depth to start + depth."""
    return _per_text(df, _tree_rows, "id long, node long, parent long, depth long, start long")

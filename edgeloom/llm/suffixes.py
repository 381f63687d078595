"""Suffix-array dedup on bytes: every LENGTH-byte string that also starts in a document with a smaller id is covered and goes.

A suffix array of all suffixes would move LENGTH bytes for each byte of text. This moves the suffixes that start at an
anchor: the least GRAM-byte fingerprint of a window. Every window of LENGTH bytes holds one, equal windows hold it at
the same place, so equal windows meet wherever their anchors' suffixes do. Four passes:

1. fingerprints of all anchors, one of each a task, find the anchors that more than one document has;
2. the suffixes at those anchors, with the bytes before them that their windows reach back to, are range-partitioned by
   their leading bytes with sampled splitters. A bucket orders them by multikey quicksort: first the anchors' suffixes
   by the GRAM bytes that all windows at an anchor share, then, a run of equal ones at a time, the suffixes at all
   places of their windows by LENGTH bytes, eight or five at a time and only where those before tie. Neighbours with
   LENGTH bytes in common form groups, and all but the least document of a group are covered;
3. an anchor of very many documents would fill one bucket. Its windows go one by one, as suffixes of their own, to
   ranges between sampled windows; a window that is itself a splitter, of one range or several, is dealt over all ranges
   it borders on. Such groups are compared across the boundaries: each bucket gives its least document, and the least of
   all covers the others;
4. covered windows merge into spans and are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .common import arrow_rows, drop_staged, staged, text_key
from .shared import squeeze, unsqueeze
from .shingles import _TABLE, byte_groups, mix, powers

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: An anchor of more documents than this is dealt by its windows; if such anchors are more than LISTED, those of the most documents are, by powers of two.
HOT, LISTED = 512, 2_000_000
#: Suffixes sampled from each portion of a task for the splitters, of how many portions they are read, and bytes of output that a task holds before it passes them on.
SAMPLED, SAMPLES, FLUSH = 128, 2048, 12_000_000
#: Rows that Python gets at once, bytes of text to a bucket.
BATCH, BUCKET = 1000, 64_000_000
#: Windows that a bucket orders at once.
WINDOWS = 400_000
#: Where the eight-byte words begin that make up a window's bytes; the last two overlap.
WORDS = (0, 8, 16, 24, 32, 40, 42)


def _prefix(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, first window, last window) of the anchors of texts lying end to end in raw.

    The anchor of a window is the leftmost of its least fingerprints; one anchor serves a run of windows.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    total, down = _prefix(raw), powers(len(raw) + 1)[1]
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    least, at, wide = h, np.arange(len(h), dtype=np.int32), 1
    while wide < WINDOW:
        step = min(wide, WINDOW - wide)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        wide += step
    ok = np.zeros(len(at) + 1, np.int32)
    size = np.diff(bounds)
    long = size >= LENGTH
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, bounds[1:][long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(window):
        return np.zeros(0, np.uint64), none, none, none
    at = at[window].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(window)]]) - 1
    return h[at[new]], at[new], window[new], window[last]


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as numbers in the order of the bytes, as a view."""
    held = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), ">u8", held, 0, (1,))


def suffix_order(raw: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at begin by their first length bytes (eight at least), and which differ in these from the one before.

    Multikey: by the first eight bytes, then five at a time, and always only the suffixes that tie so far. The next
    bytes and the run of ties are one number, so each pass is one sort of numbers.
    """
    word = words_at(raw)
    key = word[begin].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    depth = 8
    while depth < length:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        depth = min(depth, length - 5)
        part = order[at]
        run = np.cumsum(new[at]).astype(np.uint64)
        key = (run << np.uint64(40)) | (word[begin[part] + depth].astype(np.uint64) >> np.uint64(24))
        by = np.argsort(key)
        order[at], key = part[by], key[by]
        new[at[1:]] = key[1:] != key[:-1]
        depth += 5
    return order, new


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows of numbers: by the first column, and only where it ties by the next."""
    order = np.argsort(keys[0], kind="stable")
    tied = keys[0][order]
    same = np.concatenate([[False], tied[1:] == tied[:-1]]) if len(tied) else np.zeros(0, bool)
    for column in keys[1:]:
        if not same.any():
            break
        run = np.cumsum(~same)
        loose = same.copy()
        loose[:-1] |= same[1:]
        at = np.flatnonzero(loose)
        part = order[at]
        order[at] = part[np.lexsort((column[part], run[at]))]
        w = column[order]
        same = same & np.concatenate([[False], w[1:] == w[:-1]])
    return order


def _pack(x: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def _whole(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The LENGTH bytes at each place as numpy strings, which compare like the suffixes."""
    word = words_at(raw)
    return np.stack([word[begin + k] for k in WORDS], 1).astype(">u8").view(f"S{8 * len(WORDS)}").ravel()


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(part, kind, ids, prints): fingerprints that documents share, with their ids (kind 1); those of more than HOT documents, part being the power of two below their number (2); sampled fingerprints, places of their anchors in a window and windows (3)."""
    from pyspark import TaskContext

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[int] = []
        size, samples = 0, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            prints, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            task = int(TaskContext.get().partitionId())
            rows = shared.entries(prints, owner, np.array(ids, np.int64), buckets, task)
            if samples:
                drawn = np.concatenate(samples)
                drawn = drawn[:: 1 + len(drawn) // SAMPLED]
                rows.append((task % buckets, 3, np.zeros(0, np.int64), drawn.ravel(), np.zeros(0, np.int64)))
            yield shared.packed(rows)

        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for raw, bounds in byte_groups(batch.column(1)):
                prints, place, first, _ = anchors(raw, bounds)
                owner = np.searchsorted(bounds, place, side="right") - 1
                held.append((prints, owner + len(ids)))
                ids += names[at : at + len(bounds) - 1]
                at += len(bounds) - 1
                size += 12 * len(prints)
                if len(place):
                    x = np.arange(0, len(place), max(1, len(place) // 32))
                    word = words_at(raw)
                    samples.append(np.stack([prints[x], (place - first)[x].astype(np.uint64), *(word[first[x] + k].astype(np.uint64) for k in WORDS)], 1))
                if size >= FLUSH:
                    yield from out()
                    held, ids, size, samples = [], [], 0, []
        yield from out()

    def meet(t: pa.Table) -> pa.Table:
        ids, prints, many, n = shared.meet(t)
        part = ids % buckets
        order = np.argsort(part, kind="stable")
        ids, prints, part = ids[order], prints[order], part[order]
        rows = [(int(part[a]), 1, squeeze(ids[a:z], "<i8"), squeeze(prints[a:z], "<u8")) for a, z in shared.runs(part)]
        level = np.log2(n).astype(np.int64)
        rows += [(int(k), 2, b"", _pack(many[(level == k) & (n > HOT)], "<u8")) for k in np.unique(level[n > HOT])]
        rows += [(None, 3, b"", _pack(shared.flat(t.filter(pc.equal(t.column("kind"), 3)), "prints", "<u8"), "<u8"))]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "ids": pa.array([r[2] for r in rows], pa.binary()), "prints": pa.array([r[3] for r in rows], pa.binary())})

    sent = docs.select("_doc", "_bytes").mapInArrow(find, shared.SCHEMA)
    return sent.groupBy("bucket").applyInArrow(meet, "part int, kind int, ids binary, prints binary")


def _by_document(found: DataFrame) -> DataFrame:
    """(doc_id, prints): the packed fingerprints that each document shares, one row a document."""

    def gather(t: pa.Table) -> pa.Table:
        ids, prints = shared.flat(t, "ids", "<i8"), shared.flat(t, "prints", "<u8")
        order = np.lexsort((prints, ids))
        ids, prints = ids[order], prints[order]
        cuts = shared.runs(ids)
        return pa.table({"doc_id": pa.array([int(ids[a]) for a, _ in cuts], pa.int64()), "prints": pa.array([squeeze(prints[a:z], "<u8") for a, z in cuts], pa.binary())})

    return found.where("kind = 1").select("part", "ids", "prints").groupBy("part").applyInArrow(gather, "doc_id bigint, prints binary")


def _hot(found: DataFrame) -> np.ndarray:
    """The fingerprints whose windows are dealt one by one, at most LISTED."""
    rows = found.where("kind = 2").groupBy("part").agg(F.sum(F.octet_length("prints") / 8).alias("n")).collect()
    least, total = 0, sum(r["n"] for r in rows)
    for k, n in sorted((r["part"], r["n"]) for r in rows):
        if total <= LISTED:
            break
        least, total = k + 1, total - n
    listed = found.where((F.col("kind") == 2) & (F.col("part") >= least)).select("prints").collect()
    return np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r[0], "<u8") for r in listed)]))


def _splitters(found: DataFrame, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading eight bytes of anchors, whole windows of hot anchors) that part the buckets; the windows with repeats."""
    drawn = found.where("kind = 3 and octet_length(prints) > 0").select("prints").orderBy(F.xxhash64("prints")).limit(SAMPLES).collect()
    drawn = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r[0], "<u8") for r in drawn)]).reshape(-1, 2 + len(WORDS))
    windows = np.ascontiguousarray(drawn[:, 2:].astype(">u8"))
    raw = windows.view(np.uint8).reshape(len(drawn), 8 * len(WORDS))
    lead = np.zeros(len(drawn), np.uint64)
    for k in range(8):  # the words lie end to end, but for the last that begins 42 bytes in; anchors begin 26 bytes in at most
        lead = (lead << np.uint64(8)) | raw[np.arange(len(drawn)), drawn[:, 1].astype(np.int64) + k]
    single = np.isin(drawn[:, 0], hot)
    lead, whole = np.sort(lead[~single]), np.sort(windows[single].view(f"S{8 * len(WORDS)}").ravel())
    cut = lambda x, n: x[np.linspace(0, len(x) - 1, n + 1).astype(int)[1:-1]] if len(x) else x
    return np.unique(cut(lead, 2 * buckets)), cut(whole, buckets)


_FIELDS = (("doc", "<i8"), ("text", "<i8"), ("at", "<i4"), ("n", "<u1"), ("lead", "<u1"))
#: In place of an anchor's place in its first window: the window goes alone.
ALONE = 255


def _covered(docs: DataFrame, splitters: np.ndarray, edges: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, string, least, doc, text, start, end): packed runs of covered bytes and, with a string, runs in the least document of a bucket that a smaller one of another bucket may cover. docs: _doc, _text, _bytes, prints.

    A record is a run of n windows that share an anchor: their document, where the first begins, how far in it the anchor
    is, and the n + LENGTH - 1 bytes they reach over.
    """
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    n_buckets = max(len(splitters), len(edges)) + 1
    sent = StructType([StructField("bucket", IntegerType()), StructField("kind", IntegerType()), *(StructField(c, BinaryType()) for c, _ in _FIELDS), StructField("bytes", BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine = int(TaskContext.get().partitionId()) % n_buckets
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            cols = [np.concatenate([h[k] for h in held]) for k in range(5)]
            bucket, string = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
            raw = np.concatenate([h[8] for h in held])
            base = np.cumsum([0, *(len(h[8]) for h in held[:-1])])
            off = np.concatenate([h[7] + b for h, b in zip(held, base, strict=True)])
            size = cols[3].astype(np.int64) + LENGTH - 1
            # of equal records only those of the least document go on; the others are covered by it
            same = mix(string + mix((cols[3] * 256 + cols[4]).astype(np.uint64)))
            order = np.lexsort((cols[0], same))
            s, d = same[order], cols[0][order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
            later = d != d[head]
            done, by = order[later], order[head[later]]
            if len(done):  # byte for byte
                differs = _gather(raw, off[done], size[done]) != _gather(raw, off[by], size[done])
                done = done[(np.add.reduceat(differs, np.cumsum(size[done]) - size[done]) == 0) & (size[done] == size[by])]
            open_ = np.ones(len(s), bool)
            open_[done] = False
            go = np.flatnonzero(open_)
            rows = []
            order = go[np.argsort(bucket[go], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for k in range(n_buckets):
                x = order[cuts[k] : cuts[k + 1]]
                if len(x):
                    rows.append((k, 0, [squeeze(c[x], t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], squeeze(_gather(raw, off[x], size[x]), "u1")))
            if len(done):
                done = np.sort(done)
                rows.append((mine, 1, [squeeze(c[done], t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], squeeze(raw[:0], "u1")))
            arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[2][k] for r in rows], pa.binary()) for k in range(5)), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in sent.fields])

        for batch in batches:
            names, texts, wanted, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist(), 0
            for raw, bounds in byte_groups(batch.column(2)):
                prints, place, first, last = anchors(raw, bounds)
                owner = np.searchsorted(bounds, place, side="right") - 1
                keep = np.zeros(len(prints), bool)
                cuts = np.searchsorted(owner, np.arange(len(bounds)))
                for k in range(len(bounds) - 1):
                    if cuts[k + 1] > cuts[k] and wanted[at + k]:
                        keep[cuts[k] : cuts[k + 1]] = np.isin(prints[cuts[k] : cuts[k + 1]], unsqueeze(wanted[at + k], "<u8"))
                prints, place, first, last, owner = (x[keep] for x in (prints, place, first, last, owner))
                bucket = np.searchsorted(splitters, words_at(raw)[place].astype(np.uint64), side="right")
                lead = place - first
                common = np.isin(prints, hot)
                if common.any():  # one record a window, each a suffix of its own
                    n = (last - first + 1)[common]
                    each = np.repeat(np.flatnonzero(common), n)
                    start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    window = _whole(raw, start)
                    low, high = np.searchsorted(edges, window, side="left"), np.searchsorted(edges, window, side="right")
                    dealt = low + (mix(names[at + owner[each]].astype(np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)
                    owner, lead, bucket = (np.concatenate([x[~common], y]) for x, y in ((owner, owner[each]), (lead, np.full(len(each), ALONE)), (bucket, dealt)))
                    first, last = np.concatenate([first[~common], start]), np.concatenate([last[~common], start])
                    by = np.argsort(owner, kind="stable")
                    owner, lead, bucket, first, last = (x[by] for x in (owner, lead, bucket, first, last))
                total, down = _prefix(raw), powers(len(raw) + 1)[1]
                n = last - first + 1
                string = mix((total[last + LENGTH] - total[first]) * down[first])
                held.append((names[at + owner].astype(np.int64), texts[at + owner].astype(np.int64), first - bounds[owner], n, lead, bucket, string, *_cut(raw, first, n + LENGTH - 1)))
                size += 33 * len(n) + len(held[-1][8])
                at += len(bounds) - 1
                if size >= FLUSH:
                    yield from out()
                    held, size = [], 0
        yield from out()

    def settle(t: pa.Table) -> pa.Table:
        open_, done = (t.filter(pc.equal(t.column("kind"), k)) for k in (0, 1))
        doc, text, at, n = (shared.flat(done, c, d) for c, d in _FIELDS[:4])
        spans = [(doc, text, at.astype(np.int64), at.astype(np.int64) + n + LENGTH - 1)]
        doc, text, at, n, lead = (shared.flat(open_, c, d) for c, d in _FIELDS)
        raw, n, at = shared.flat(open_, "bytes", "u1"), n.astype(np.int64), at.astype(np.int64)
        off = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        loose = []
        for alone in (False, True):
            x = np.flatnonzero((lead == ALONE) == alone)
            if not len(x):
                continue
            order, new = suffix_order(raw, off[x] + (0 if alone else lead[x].astype(np.int64)), LENGTH if alone else GRAM)
            x = x[order]
            # suffixes with equal leading bytes stay together; so many at once that their windows fit
            upto, ends = np.cumsum(n[x]), np.concatenate([np.flatnonzero(new[1:]) + 1, [len(x)]])
            begin = 0
            while begin < len(x):
                k = int(np.searchsorted(upto[ends - 1], (upto[begin - 1] if begin else 0) + WINDOWS, side="right"))
                end = max(int(ends[max(k - 1, 0)]), int(ends[np.searchsorted(ends, begin, side="right")]))
                y = x[begin:end]
                found, edge = _settle(doc[y], text[y], at[y], n[y], _gather(raw, off[y], n[y] + LENGTH - 1), edges if alone else edges[:0])
                spans.append(found)
                loose += edge
                begin = end
        doc, text, start, end = (np.concatenate([s[c] for s in spans]) for c in range(4))
        rows = []
        for string, least, (doc, text, start, end) in [(None, None, (doc, text, start, end)), *loose]:
            part = doc % parts
            order = multikey_order([part, doc, text, start])
            doc, text, start, end, part = (x[order] for x in (doc, text, start, end, part))
            rows += [(int(part[a]), string, least, *(squeeze(x[a:z], d) for x, d in ((doc, "<i8"), (text, "<i8"), (start, "<i4"), (end - start, "<i4")))) for a, z in shared.runs(part)]
        kinds = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["part", "string", "least", "doc", "text", "start", "size"])

    found = docs.select("_doc", "_text", "_bytes", "prints").mapInArrow(send, sent)
    return found.groupBy("bucket").applyInArrow(settle, "part int, string binary, least bigint, doc binary, text binary, start binary, size binary")


def _settle(doc: np.ndarray, text: np.ndarray, at: np.ndarray, n: np.ndarray, raw: np.ndarray, edges: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[tuple]]:
    """(doc, text, from, to) of the windows of these records that a smaller document has too; and (string, least document, the same of its windows) for every string in edges."""
    size = n + LENGTH - 1
    off = np.cumsum(size) - size
    each = np.repeat(np.arange(len(n)), n)
    begin = off[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    order, new = suffix_order(raw, begin, LENGTH)
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    d = doc[each[order]]
    least = np.minimum.reduceat(d, heads)
    hit = np.zeros(len(each), bool)
    hit[order] = least[group] < d
    x = np.flatnonzero(hit)
    run = np.concatenate([[True], (x[1:] != x[:-1] + 1) | (each[x[1:]] != each[x[:-1]])]) if len(x) else np.zeros(0, bool)
    first, last = x[run], x[np.concatenate([run[1:], [True]])] if len(x) else x
    of = each[first]
    spans = (doc[of], text[of], at[of] + begin[first] - off[of], at[of] + begin[last] - off[of] + LENGTH)
    loose = []
    if len(edges):
        strings = _whole(raw, begin[order[heads]])
        for k in np.flatnonzero(np.isin(strings, edges)):
            y = order[group == k]
            y = y[~hit[y]]
            of = each[y]
            start = at[of] + begin[y] - off[of]
            loose.append((bytes(strings[k]), int(least[k]), (doc[of], text[of], start, start + LENGTH)))
    return spans, loose


def _across(found: DataFrame) -> DataFrame:
    """The runs that are covered once the least documents of a string's buckets are compared."""
    loose = staged(found.where("string is not null"))
    least = loose.groupBy(F.col("string").alias("_s")).agg(F.min("least").alias("_least"))
    return loose.join(least, F.col("string") == F.col("_s")).where("least > _least").select(found.columns)


def _by_text(found: DataFrame) -> DataFrame:
    """(doc_id, text_id, spans): the merged runs of each text, one row a text."""

    def gather(t: pa.Table) -> pa.Table:
        doc, text, start, size = (shared.flat(t, c, d) for c, d in (("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("size", "<i4")))
        order = multikey_order([doc, text, start])
        doc, text, start, end = doc[order], text[order], start[order], (start + size)[order]
        out = [(int(doc[a]), int(text[a]), _pack(np.stack(merge(start[a:z], end[a:z]), 1), "<i4")) for a, z in shared.runs(doc, text)]
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "text_id": pa.array([o[1] for o in out], pa.int64()), "spans": pa.array([o[2] for o in out], pa.binary())})

    return found.select("part", "doc", "text", "start", "size").groupBy("part").applyInArrow(gather, "doc_id bigint, text_id bigint, spans binary")


def _copies(named: DataFrame) -> DataFrame:
    """(copy_id, copy_text) of texts that equal one of a smaller id by a 128-bit fingerprint. All their strings start there too, so they neither need a search nor cover more than it does."""
    keyed = named.select("_doc", "_text", text_key(F.col("_bytes").cast("string")).alias("k")).select("_doc", "_text", "k.a", "k.b")
    least = staged(keyed.groupBy("a", "b").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most")).where("least < most").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "least"))
    again = keyed.join(least, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where("_doc > least")
    return again.select(F.col("_doc").alias("copy_id"), F.col("_text").alias("copy_text"))


def _gather(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    off = np.cumsum(size) - size
    return raw[np.repeat(begin - off, size) + np.arange(int(size.sum()))]


def _cut(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(size) - size, _gather(raw, begin, size)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by start, merged where they overlap or touch."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], np.maximum.reduceat(reach, np.flatnonzero(new))


def drop_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is the bytes that stay.

    Null text is empty. Rows with a null id neither lose nor cover anything; rows that share an id don't cover each
    other, so ties have no order. Strings are judged on the input, byte for byte. Matches never cross documents. Whole
    copies are known by a 128-bit fingerprint. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = rows.select("_doc", F.xxhash64("_t").alias("_text"), F.col("_t").cast("binary").alias("_bytes"))
    named = rows.where(f"_doc is not null and octet_length(_bytes) >= {LENGTH}")
    copies = staged(_copies(named).distinct())
    named = named.join(copies, (F.col("_doc") == F.col("copy_id")) & (F.col("_text") == F.col("copy_text")), "left_anti")
    size = rows.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    with arrow_rows(spark, BATCH):
        found = staged(_shared_anchors(named, buckets))
    hot = _hot(found)
    splitters, edges = _splitters(found, hot, buckets)
    near = named.join(_by_document(found), F.col("_doc") == F.col("doc_id")).select("_doc", "_text", "_bytes", "prints")
    with arrow_rows(spark, BATCH):
        runs = staged(_covered(near, splitters, edges, hot, buckets))
    drop_staged(found)
    sure = runs.where("string is null")
    spans = _by_text(sure.unionByName(_across(runs)) if len(edges) else sure).withColumn("whole", F.lit(False))
    spans = spans.unionByName(copies.select(F.col("copy_id").alias("doc_id"), F.col("copy_text").alias("text_id"), F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole")))
    full = rows.join(spans, (F.col("_doc") == F.col("doc_id")) & (F.col("_text") == F.col("text_id")), "left").select("_doc", "_bytes", "spans", "whole")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, packed, whole in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                if whole:
                    out.append((len(raw), len(raw), 1, b""))
                elif packed:
                    start, end = np.frombuffer(packed, "<i4").reshape(-1, 2).astype(np.int64).T
                    left = b"".join(raw[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                    out.append((len(raw), int((end - start).sum()), len(start), left))
                else:
                    out.append((len(raw), 0, 0, raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[c] for o in out], pa.int64()) for c in range(3)), pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()), pa.array([o[3] for o in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return full.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeated_bytes(docs).drop("kept")

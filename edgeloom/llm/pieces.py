"""Segmentation over a piece lattice: forward Viterbi scores, backward A* search for the N best, and exact decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files are; a parameter of every function that reads one.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: An unknown character costs this much more than the worst piece that has a rank of its own.
UNKNOWN_PENALTY = 10.0
RANKLESS = -1e8
#: Distinct segments a Python worker keeps, and the longest that the vectorised pass takes.
CACHE, SHORT = 300_000, 48
#: Segments learned and characters handled at once.
AT_ONCE, GROUP = 8_192, 1_000_000
NONE = -1e300


class Vocabulary:
    """Pieces as (text, score, id) with a blank for the word mark, and 256 byte ids for all other characters.

    No piece may have a blank after another character, nor a line feed: so texts fall into segments that no piece spans.
    """

    def __init__(self, pieces: Sequence[tuple[str, float, int]], byte_ids: Sequence[int]):
        self.pieces, self.byte_ids = list(pieces), list(byte_ids)
        for text, _, _ in self.pieces:
            if not text or "\n" in text or " " in text.lstrip(" "):
                raise ValueError(f"piece {text!r} would span segments")
        self.scores = {t: (s, i) for t, s, i in self.pieces}
        self.longest = max(map(len, self.scores), default=1)
        ranked = [s for _, s, _ in self.pieces if s > RANKLESS]
        self.unknown = min(ranked, default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = {i: t.encode() for t, _, i in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    @staticmethod
    def load(model_file: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        usable = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return Vocabulary([(p.id_to_piece(i).replace("▁", " "), float(p.get_score(i)), i) for i in usable], byte_ids)

    def edges_into(self, segment: str, end: int) -> Iterator[tuple[int, float]]:
        """(start, score) of every edge of the lattice that ends there, the longest piece first."""
        known = False
        for start in range(max(0, end - self.longest), end):
            hit = self.scores.get(segment[start:end])
            if hit:
                known = known or start == end - 1
                yield start, hit[0]
        if not known:
            yield end - 1, self.unknown

    def ids(self, piece: str) -> list[int]:
        hit = self.scores.get(piece)
        return [hit[1]] if hit else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def n_best(self, segment: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations as (score, ids), best first.

        Forward Viterbi gives the best score up to each place. Partial paths grow from the end backwards; the score so
        far plus the forward score is exactly what the best completion has, so paths leave the heap in final order. Of
        equal ones the nearest to the beginning goes on first, then the earliest made, the longest last piece first. A
        place that n better paths have left needs no more, so a long run of one character costs n times its length.
        """
        size = len(segment)
        into: list[list[tuple[int, float]]] = [[]] + [list(self.edges_into(segment, e)) for e in range(1, size + 1)]
        best = [0.0] * (size + 1)
        for end in range(1, size + 1):
            best[end] = max(best[start] + s for start, s in into[end])
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-best[size], size, 0, 0.0, None)]
        found, made, left = [], 0, [0] * (size + 1)
        while heap and len(found) < n:
            total, at, _, behind, path = heapq.heappop(heap)
            if left[at] == n:
                continue
            left[at] += 1
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += self.ids(segment[path[0] : path[1]])
                    path = path[2]
                found.append((-total, ids))
                continue
            for start, s in into[at]:
                made += 1
                heapq.heappush(heap, (-(best[start] + s + behind), start, made, behind + s, (start, at, path)))
        return found


class Trie:
    """The vocabulary's pieces backwards in an open-addressed table, walked for all places of a text at once."""

    def __init__(self, v: Vocabulary):
        chars = sorted({c for t in v.scores for c in t})
        self.code = np.full(max([ord(c) for c in chars], default=0) + 2, -1, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        code, nodes, edges = {c: k for k, c in enumerate(chars)}, 1, {}
        score, piece = [NONE], [-1]
        for t, (s, i) in v.scores.items():
            node = 0
            for c in reversed(t):
                key = node * 65536 + code[c]
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                    score.append(NONE)
                    piece.append(-1)
                node = edges[key]
            score[node], piece[node] = s, i
        self.score, self.piece = np.array(score), np.array(piece, np.int32)
        self.keys, self.next = np.array(sorted(edges), np.int64), None
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int32)

    def codes(self, cp: np.ndarray) -> np.ndarray:
        """Small numbers for code points, -1 for those in no piece."""
        return self.code[np.minimum(cp, len(self.code) - 1)]

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node, or -1."""
        key = node.astype(np.int64) * 65536 + char
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (char >= 0), self.next[at], -1)


class Encoder:
    """Segments of texts, each worked out once and kept while there is room."""

    def __init__(self, v: Vocabulary):
        self.v, self.trie = v, Trie(v)
        self.split = re.compile(r"[^ \n]+| +[^ \n]*|\n").findall
        top = max(v.bytes_of, default=0) + 1
        raw = [v.bytes_of.get(i, b"") for i in range(top)]
        self.raw_len = np.array([len(b) for b in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.n_best = lru_cache(4_000)(v.n_best)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.len, self.score, self.gap = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, float, float))

    def learn(self, segments: list[str]) -> None:
        """Best segmentation, its score, and how much worse the second best is, of new segments."""
        short = [s for s in segments if len(s) <= SHORT]
        long = [s for s in segments if len(s) > SHORT]
        parts = []
        if short:
            short.sort(key=len, reverse=True)
            parts += [self._viterbi(short[k : k + AT_ONCE]) for k in range(0, len(short), AT_ONCE)]
        if long:
            both = [self._walk(s) for s in long]
            n = np.array([len(b[1]) for b in both], np.int64)
            parts.append((np.array([i for b in both for i in b[1]], np.int32), n, np.array([b[0] for b in both]), np.array([b[2] for b in both])))
        for s in short + long:
            self.known[s] = len(self.known)
        lens = np.concatenate([self.len, *(p[1] for p in parts)])
        self.flat, self.score, self.gap = (np.concatenate([old, *(p[k] for p in parts)]) for old, k in ((self.flat, 0), (self.score, 2), (self.gap, 3)))
        self.len, self.at = lens, np.cumsum(lens) - lens

    def _walk(self, s: str) -> tuple[float, list[int], float]:
        """As _viterbi, for one long segment."""
        one, two, back = [0.0], [NONE], [0]
        for end in range(1, len(s) + 1):
            top, second, via = NONE, NONE, end - 1
            for start, score in self.v.edges_into(s, end):
                a, b = one[start] + score, two[start] + score
                if a > top:
                    top, second, via = a, max(top, b), start
                else:
                    second = max(second, a)
            one.append(top)
            two.append(second)
            back.append(via)
        ids, end = [], len(s)
        while end:
            ids.append(self.v.ids(s[back[end] : end]))
            end = back[end]
        return one[-1], [i for part in reversed(ids) for i in part], one[-1] - two[-1] if two[-1] > NONE / 2 else np.inf

    def _viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward Viterbi with two scores a place, over all segments at once, the longest first."""
        size = np.array([len(s) for s in segments], np.int64)
        cp = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.trie.codes(cp)
        first = np.cumsum(size) - size
        place = np.arange(len(cp)) - np.repeat(first, size)
        longest = self.v.longest
        score = np.full((len(cp), longest), NONE)  # of the piece that ends with a character, by length, the longest in front
        live, node = np.arange(len(cp)), np.zeros(len(cp), np.int32)
        for back in range(longest):
            fits = place[live] >= back
            live, node = live[fits], node[fits]
            node = self.trie.step(node, code[live - back])
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            score[live, longest - 1 - back] = self.trie.score[node]
        single = score[:, longest - 1]
        unknown = single <= NONE / 2
        single[unknown] = self.v.unknown
        n, deep = len(segments), int(size[0])
        one, two = np.full((n, deep + 1 + longest), NONE), np.full((n, deep + 1 + longest), NONE)
        one[:, longest] = 0.0  # columns before are the outside
        took = np.zeros((n, deep + 1), np.int64)
        for j in range(1, deep + 1):
            m = int(np.searchsorted(-size, -j, side="right"))
            lo = max(0, longest - j)  # no piece is longer than what stands before
            s = score[first[:m] + j - 1, lo:]
            a, b = one[:m, j + lo : j + longest] + s, two[:m, j + lo : j + longest] + s
            pick = a.argmax(1)
            row = np.arange(m)
            top = a[row, pick]
            a[row, pick] = NONE
            one[:m, longest + j], two[:m, longest + j] = top, np.maximum(a.max(1), b.max(1))
            took[:m, j] = longest - lo - pick
        rows = np.arange(n)
        total, second = one[rows, longest + size], two[rows, longest + size]
        ends, rest = [], size.copy()
        alive = rows
        while len(alive):
            ends.append((alive, rest[alive].copy(), took[alive, rest[alive]]))
            rest[alive] -= ends[-1][2]
            alive = alive[rest[alive] > 0]
        seg, end, length = (np.concatenate([e[k] for e in ends]) for k in range(3))
        order = np.lexsort((end, seg))
        seg, end, length = seg[order], end[order], length[order]
        flat, count = self._ids(cp, first[seg] + end - length, length, unknown)
        n_ids = np.bincount(seg, count, n).astype(np.int64)
        return flat, n_ids, total, np.where(second > NONE / 2, total - second, np.inf)

    def _ids(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces given by start and length, and how many each has: one, or its bytes for an unknown character."""
        code = self.trie.codes(cp)
        node, live = np.zeros(len(start), np.int32), np.arange(len(start))
        raw = unknown[start] & (length == 1)
        live = live[~raw]
        for back in range(self.v.longest):
            live = live[length[live] > back]
            if not len(live):
                break
            node[live] = self.trie.step(node[live], code[start[live] + length[live] - 1 - back])
        one = self.trie.piece[node]
        count = np.ones(len(start), np.int64)
        spelled = {k: [self.v.byte_ids[b] for b in chr(cp[start[k]]).encode("utf-8", "surrogatepass")] for k in np.flatnonzero(raw).tolist()}
        for k, ids in spelled.items():
            count[k] = len(ids)
        at = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        flat[at[~raw]] = one[~raw]
        for k, ids in spelled.items():
            flat[at[k] : at[k] + len(ids)] = ids
        return flat, count

    def encode(self, texts: list[str], n: int) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """For each text its best ids, and its n best segmentations as (score, changes to the best one); a change is (at, how many, ids).

        Segments are independent, so the n best of a text differ from its best only in the n - 1 segments whose second
        best costs least; A* is run on those, and the sums of their choices are searched in order.
        """
        split = [self.split(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.clear()
        known = self.known
        if new := {s for segments in split for s in segments if s not in known}:
            self.learn(list(new))
        out = []
        for segments in split:
            which = np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))
            lens = self.len[which]
            ends = np.cumsum(lens)
            begin = ends - lens
            ids = self.flat[np.repeat(self.at[which] - begin, lens) + np.arange(int(lens.sum()))]
            total, gap = float(self.score[which].sum()), self.gap[which]
            near = np.flatnonzero(np.isfinite(gap))
            if len(near) > n - 1:
                limit = np.partition(gap[near], n - 2)[n - 2] if n > 1 else -1
                near = near[gap[near] <= limit]
                near = near[np.argsort(gap[near], kind="stable")][: max(0, n - 1)]
            out.append((ids, self._combine(total, [(int(begin[k]), int(lens[k]), self.n_best(segments[k], n)) for k in near.tolist()], n)))
        return out

    @staticmethod
    def _combine(total: float, choices: list[tuple[int, int, list[tuple[float, list[int]]]]], n: int) -> list[tuple[float, list[tuple[int, int, list[int]]]]]:
        found, heap, seen = [], [(0.0, (0,) * len(choices))], set()
        while heap and len(found) < n:
            loss, pick = heapq.heappop(heap)
            changes = sorted((at, size, ways[k][1]) for (at, size, ways), k in zip(choices, pick, strict=True) if k)
            found.append((total - loss, changes))
            for c, (_, _, ways) in enumerate(choices):
                if pick[c] + 1 < len(ways):
                    more = (*pick[:c], pick[c] + 1, *pick[c + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (loss + ways[pick[c]][0] - ways[pick[c] + 1][0], more))
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ids, without the blank that encoding puts in front."""
        lens = self.raw_len[ids]
        raw = self.raw[np.repeat(self.raw_at[ids] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))].tobytes()
        return raw[1:]


def apply_changes(ids: np.ndarray, changes: list[tuple[int, int, list[int]]]) -> np.ndarray:
    parts, at = [], 0
    for start, size, new in changes:
        parts += [ids[at:start], np.array(new, np.int32)]
        at = start + size
    return np.concatenate([*parts, ids[at:]]).astype(np.int32)


_held: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """One a Python worker, so that segments stay known from task to task."""
    key = hash((len(v.pieces), tuple(v.byte_ids), v.pieces[0] if v.pieces else None, v.pieces[-1] if v.pieces else None))
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(v)
    return _held[key]


_CHANGE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
_BEST = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))]))
SCHEMA = "pieces array<int>, n_best array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>, exact boolean"
DIGEST = "n_pieces bigint, score double, n_best int, scores array<double>, ids_sha256 string, n_best_sha256 string, exact boolean"


def _groups(column: pa.ChunkedArray | pa.Array) -> Iterator[list[str]]:
    texts, size = [], 0
    for t in column:
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= GROUP:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode(docs: DataFrame, text: str = "text", model_file: str = MODEL_FILE, n: int = N_BEST, digest: bool = False) -> DataFrame:
    """docs without text plus SCHEMA, or plus DIGEST of the same result; same-named input columns are replaced.

    pieces are the ids of the best segmentation of the whole text, n_best the n best ones (fewer if the lattice has
    fewer) as changes to it, exact whether decoding gives the text's bytes again. Null and empty texts have no pieces
    and one segmentation of score 0. Scores are sums of the model's piece scores; a character without a piece becomes
    its UTF-8 bytes. No shuffle; a task holds a batch of texts and at most CACHE segments.
    """
    v = Vocabulary.load(model_file)
    new = {c.split()[0] for c in re.split(r", (?=\w+ )", DIGEST if digest else SCHEMA)}
    keep = [c for c in docs.columns if c != text and c not in new]
    spark = docs.sparkSession
    kept = docs.select(*(f"`{c}`" for c in keep)).schema
    parsed = spark.createDataFrame([], DIGEST if digest else SCHEMA).schema
    from pyspark.sql.types import StructType

    schema = StructType([*kept.fields, *parsed.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(v)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(batch.num_columns - 1)):
                done = coder.encode(texts, n)
                rest = [batch.column(k).slice(at, len(texts)) for k in range(len(keep))]
                at += len(texts)
                same = [not t or coder.decode(ids) == t.encode("utf-8", "surrogatepass") for t, (ids, _) in zip(texts, done, strict=True)]
                if digest:
                    out = [
                        pa.array([len(ids) for ids, _ in done], pa.int64()), pa.array([b[0][0] for _, b in done], pa.float64()), pa.array([len(b) for _, b in done], pa.int32()), pa.array([[s for s, _ in b] for _, b in done], pa.list_(pa.float64())),
                        pa.array([hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() for ids, _ in done]), pa.array([hashlib.sha256(repr(b).encode()).hexdigest() for _, b in done]), pa.array(same, pa.bool_()),
                    ]
                else:
                    ends = np.cumsum([0, *(len(ids) for ids, _ in done)]).astype(np.int32)
                    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in done)]), pa.int32())
                    best = [[{"score": s, "changes": [{"at": a, "n": k, "ids": i} for a, k, i in c]} for s, c in b] for _, b in done]
                    out = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(best, _BEST), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*rest, *out], names=[f.name for f in schema.fields])

    return docs.select(*(f"`{c}`" for c in keep), f"`{text}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str = MODEL_FILE, pieces: str = "pieces") -> DataFrame:
    """encoded plus text: what pieces spell; null where they are null. Bytes that aren't UTF-8 become replacement characters."""
    v = Vocabulary.load(model_file)
    from pyspark.sql.types import StringType, StructField, StructType

    names = [c for c in encoded.columns if c != "text"]
    schema = StructType([*encoded.select(*(f"`{c}`" for c in names)).schema.fields, StructField("text", StringType())])
    k = names.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(v)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode("utf-8", "replace") if x else "" for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns)), pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return encoded.select(*(f"`{c}`" for c in names)).mapInArrow(run, schema)

"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items; hits are verified word by word."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: BM25's constants; the least score as a share of what an item scores against itself; postings blocks hold this many parts.
K1, B, LEAST, BLOCK = 1.2, 0.75, 0.6, 4
#: An item longer than PART words is indexed as parts of nearly equal length, PART / 2 words or more; a passage is two strides of PART words, so it holds any part whole.
PART, SHINGLE, OVERLAP = 64, 5, 0.8
#: Items with more characters in all are indexed in several parts, one after the other, each broadcast by itself.
CHUNK_CHARS = 32_000_000
#: Words of texts handled at once.
GROUP = 400_000

_words = re.compile(r"\w+").findall


def words(text: str) -> list[str]:
    return _words(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is what follows the last line break, or else the last sentence end, or else the last quarter of the words."""
    for pattern in (r"\n(?=[^\n]*\w)", r"[.!?]\s+(?=.*\w)"):
        cuts = [m.end() for m in re.finditer(pattern, text, re.S)]
        if cuts and words(text[: cuts[-1]]):
            return words(text[: cuts[-1]]), words(text[cuts[-1] :])
    w = words(text)
    cut = len(w) - max(1, len(w) // 4)
    return w[:cut], w[cut:]


def shingles(w: list) -> set[tuple]:
    return {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def cut(w: list) -> list[list]:
    n = -(-len(w) // PART)
    return [w[k * len(w) // n : (k + 1) * len(w) // n] for k in range(n)]


class Index:
    """BM25 postings of the items' parts. Weights are shares of a part's score against itself, so one threshold fits all.

    Parts of like length share blocks of BLOCK; each term has, for every block it occurs in, its largest weight there.
    A part has the words of its whole item's question and answer.
    """

    def __init__(self, items: list[tuple[int, str]], all_items: tuple[int, int, dict[str, int]] | None = None):
        """all_items: parts, words and, for each word of items, parts that hold it, over a benchmark that items are some of; else over items."""
        found: list[tuple[tuple[int, list[int], set, set, set], int, bool]] = []
        vocabulary: dict[str, int] = {}
        number = lambda ws: [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        for row, (item, text) in enumerate(items):
            q, a = ({*number(x)} for x in question_and_answer(text or ""))
            parts = [number(w) for w in cut(words(text or ""))]
            found += [((item, part, shingles(part), q, a), row, len(parts) > 1) for part in parts]
        found.sort(key=lambda x: (len(x[0][1]), str(x[0][0]), x[0][1]))
        self.parts = [p for p, _, _ in found]
        #: The item's row, and whether the item has other parts.
        self.row_of = [(row, several) for _, row, several in found]
        self.vocabulary = vocabulary
        n, size = len(self.parts), max(1, len(vocabulary))
        df = Counter(t for p in self.parts for t in {*p[1]})
        total = sum(len(p[1]) for p in self.parts)
        if all_items:
            n, total, held = all_items
            df = {vocabulary[w]: c for w, c in held.items() if w in vocabulary}
        mean = total / max(1, n)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for k, (_, part, *_) in enumerate(self.parts):
            got = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(part) / mean)) for t, c in Counter(part).items()}
            total = sum(got.values())
            for t, x in got.items():
                postings[t].append((k, x / total))
        self.n_blocks = -(-len(self.parts) // BLOCK)
        self.post = _csr(postings)
        tops = []
        for p in postings:
            top: dict[int, float] = {}
            for k, x in p:
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), x)
            tops.append(list(top.items()))
        self.top = _csr(tops)
        self.most = np.array([max((x for _, x in p), default=0.0) for p in postings])

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(text number, part, score, question overlap, answer overlap) of all passages and parts at LEAST or more and verified.

        Question and answer of an item in one part are verified in the passage, those of an item in several parts in
        all passages of the text that hold one of its parts.
        Block-max WAND for many passages at a time: a passage goes on if the sum of its terms' list maxima reaches the
        threshold, a block of postings is opened if the sum of its block maxima does, and only then are its parts scored.
        """
        numbers = []
        for t in texts:
            w = words(t)
            numbers.append(np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w)))
        size = np.array([len(x) for x in numbers], np.int64)
        count = np.maximum(1, -(-(size - PART) // PART))  # passages; each starts PART words after the one before
        first = np.cumsum(count) - count
        term = np.concatenate([np.zeros(0, np.int64), *numbers])
        text = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        known = term >= 0
        term, text, place = term[known], text[known], place[known] // PART
        keys = [((first[text] + place)[place < count[text]]) * len(self.most) + term[place < count[text]], ((first[text] + place - 1)[place > 0]) * len(self.most) + term[place > 0]]
        pair = np.unique(np.concatenate(keys))
        passage, term = pair // len(self.most), pair % len(self.most)
        n = int(count.sum())
        go = np.bincount(passage, self.most[term], n) >= LEAST
        on = go[passage]
        passage, term = passage[on], term[on]
        # sums are kept for the (passage, block) pairs that occur, so memory follows the postings that are read, not passages times blocks
        p, block, bound = _expand(self.top, passage, term)
        met, where = np.unique(p * self.n_blocks + block, return_inverse=True)
        opened = met[np.bincount(where, bound, len(met)) >= LEAST - 1e-9]
        busy = np.zeros(n, bool)
        busy[opened // max(1, self.n_blocks)] = True
        on = busy[passage]
        p, part, share = _expand(self.post, passage[on], term[on])
        at = np.searchsorted(opened, p * self.n_blocks + part // BLOCK)
        on = np.concatenate([opened, [-1]])[at] == p * self.n_blocks + part // BLOCK
        key, where = np.unique(p[on] * len(self.parts) + part[on], return_inverse=True)
        score = np.bincount(where, share[on], len(key)) if len(key) else np.zeros(0)
        out, joint = [], {}
        owner = np.repeat(np.arange(len(texts)), count)
        for k, s in zip(key[score >= LEAST - 1e-9].tolist(), score[score >= LEAST - 1e-9].tolist(), strict=True):
            at, part_no = divmod(k, len(self.parts))
            t = int(owner[at])
            start = (at - int(first[t])) * PART
            held = numbers[t][start : start + 2 * PART].tolist()
            _, _, own, q, a = self.parts[part_no]
            seen = {*held}
            size_ = min(SHINGLE, len(self.parts[part_no][1]))
            theirs = {tuple(held[j : j + size_]) for j in range(len(held) - size_ + 1)}
            if len(own & theirs) >= OVERLAP * len(own):
                row, several = self.row_of[part_no]
                hits, all_seen = joint.setdefault((t, row) if several else (t, row, at), ([], set()))
                hits.append((part_no, s))
                all_seen |= seen & (q | a)
        for (t, *_), (hits, seen) in joint.items():
            _, _, _, q, a = self.parts[hits[0][0]]
            q_share = len(q & seen) / len(q) if q else 1.0
            a_share = len(a & seen) / len(a) if a else 1.0
            if q_share >= OVERLAP and a_share >= OVERLAP:
                out += [(t, part_no, s, q_share, a_share) for part_no, s in hits]
        return out


def _csr(lists: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return np.cumsum(size) - size, size, np.array([k for x in lists for k, _ in x], np.int64), np.array([w for x in lists for _, w in x])


def _expand(csr: tuple, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, size, what, weight = csr
    n = size[term]
    k = np.repeat(at[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(passage, n), what[k], weight[k]


def _statistics(items: DataFrame) -> DataFrame:
    """(round, word, parts, words) of items (round, text): parts with the word; all parts and words where word is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            size: Counter = Counter()
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in cut(words(text or "")):
                    held.update((r, w) for w in {*part})
                    held[r, None] += 1
                    size[r, None] += len(part)
            cols = ([r for r, _ in held], [w for _, w in held], [*held.values()], [size[k] for k in held])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["round", "word", "parts", "words"])

    return items.mapInArrow(run, "round long, word string, parts long, words long").groupBy("round", "word").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap), one row for each document and test item found in it.

    Words are lower-cased runs of letters, digits and underscores. All passages of the whole text are searched. A hit
    needs LEAST of the part's own BM25 score and OVERLAP of its five-word shingles in one passage, and OVERLAP of the
    whole item's question's and its answer's distinct words in that passage or, where the item is longer than PART
    words, in all such passages together; the best passage's score is reported. Null texts, and items without words, hit nothing;
    repeated documents give equal rows, a null key stays null. An empty benchmark gives no rows.

    The index is broadcast: its size is checked, and more than CHUNK_CHARS of items are taken in several rounds, with
    BM25 statistics of all items, of which a round gets those of its own words. Nothing is shuffled but the hits and,
    where there are several rounds, the statistics.
    """
    from .common import staged
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    spark = docs.sparkSession
    ids = docs.select(f"`{key}`").schema.fields[0]
    schema = StructType([StructField(key, ids.dataType), StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType())])
    chars = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    rounds = max(1, -(-chars // CHUNK_CHARS))
    hits = every = None
    dealt = benchmark.select(F.pmod(F.xxhash64(item, item_text), F.lit(rounds)).alias("round"), F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    if rounds > 1:
        counts = staged(_statistics(dealt.select("round", "text")))
        n, size = counts.where("word is null").agg(F.sum("parts"), F.sum("words")).first()
        counts = counts.where("word is not null")
        held = staged(counts.groupBy("word").agg(F.sum("parts").alias("parts")))
    for r in range(rounds):
        items = dealt.where(F.col("round") == r).select("item", "text").collect()
        if rounds > 1:
            own = held.join(counts.where(F.col("round") == r).select("word"), "word", "left_semi")
            every = (n or 0, size or 0, {x["word"]: x["parts"] for x in own.collect()})
        index = spark.sparkContext.broadcast(Index([(x[0], x[1]) for x in items], every))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            found = index.value
            for batch in batches:
                for at, texts in _groups(batch.column(1)):
                    best: dict[tuple[int, int], tuple] = {}
                    for t, part, *rest in found.search(texts) if found.parts else []:
                        k = (at + t, found.parts[part][0])
                        best[k] = max(best.get(k, ()), tuple(rest))
                    if best:
                        rows = pa.array([k for k, _ in best], pa.int64())
                        cols = [batch.column(0).take(rows), pa.array([i for _, i in best], pa.int64()), *(pa.array([b[c] for b in best.values()], pa.float64()) for c in range(3))]
                        yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

        found = docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, schema)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    at, texts, size = 0, [], 0
    for k, t in enumerate(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1]) // 5
        if size >= GROUP:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents in which find_leaks() finds nothing, all columns unchanged. A row is known by its id and text, so a clean one stays whatever shares its id, null ids included."""
    from .common import staged

    row = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    bad = staged(find_leaks(docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_text")), benchmark, "_text", "_row").select("_row").distinct())
    return docs.join(bad, row == bad["_row"], "left_anti")

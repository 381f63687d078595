"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL with elastic net, then temperature-scaled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed n-grams of 1 to 3 characters. The model has DIM x languages floats, whatever the corpus.
DIM = 1 << 15
#: The classifier learns from at most about this many documents, an equal share a language, chosen by a hash of their id.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.002, 0.01, 40.0
UNDETERMINED = "und"
#: Texts with more characters are profiled in chunks, so that memory doesn't grow with a text's n-grams.
LONG = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Hashed n-grams of a whole text, other characters than letters taken as blanks; and whether it has a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int32), False
    letter = _LETTER[np.minimum(cp, 0xFFFF)]
    high = cp > 0xFFFF
    if high.any():
        letter = letter.copy()
        letter[high] = [chr(c).isalpha() for c in cp[high].tolist()]
    if not letter.any():
        return np.zeros(0, np.int32), False
    c = np.where(letter, cp, 32).astype(np.uint64)
    a, b, d = c * _MIX[0], c * _MIX[1], c * _MIX[2]
    two, three = a[:-1] + b[1:], a[:-2] + b[1:-1] + d[2:]
    blank = ~letter
    keep2 = ~(blank[:-1] & blank[1:])
    keep3 = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
    shift = np.uint64(64 - 15)
    every = np.concatenate([a[letter], two[keep2] ^ _MIX[1], three[keep3] ^ _MIX[2]])
    every ^= every >> np.uint64(29)
    return ((every * _MIX[0]) >> shift).astype(np.int32), True


def profile(text: str) -> tuple[np.ndarray, bool]:
    """How often each n-gram occurs in a whole text (DIM counts), and whether it has a letter; a long text is read LONG characters at a time."""
    text, total, has = text.lower(), np.zeros(DIM, np.int64), False
    for at in range(0, len(text), LONG):
        ids, letters = grams(text[at : at + LONG + 2])
        if letters:
            total += np.bincount(ids, minlength=DIM)
        has |= letters
        if at:  # what lies in the two characters shared with the chunk before was counted there
            shared, letters = grams(text[at : at + 2])
            if letters:
                total -= np.bincount(shared, minlength=DIM)
    return total, has


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # DIM x classes, weights times inverse document frequencies
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        long = len(text or "") > LONG
        found, has = profile(text) if long else grams(text or "")
        if not has or not self.classes:
            return UNDETERMINED, 0.0
        summed, n = (found @ self.table, int(found.sum())) if long else (self.table[found].sum(0, dtype=np.float64), len(found))
        z = (summed * (SCALE / n) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM x classes) and biases by FTRL-proximal; rows: (class, features, values)."""
    z, n = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z_: np.ndarray, n_: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((BETA + np.sqrt(n_)) / ALPHA + L2))

    for _ in range(epochs):
        for k, at, x in rows:
            z0, n0 = z[at], n[at]
            w, wb = weights(z0, n0, L1), weights(zb, nb, 0.0)
            s = x @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1.0
            g = x[:, None] * p
            z[at] = z0 + g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w
            n[at] = n0 + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * wb
            nb += p * p
    return weights(z, n, L1), weights(zb, nb, 0.0)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least loss, by golden section over its logarithm; 1 without data."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), classes]).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _bucket(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            seen = np.zeros(DIM, bool)
            text = t.as_py()
            seen[np.flatnonzero(profile(text)[0]) if len(text) > LONG else grams(text)[0]] = True
            total += seen
            docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs, *total[at].tolist()], pa.int64())], names=["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for t in batch.column(3):
            held = profile(t.as_py())[0]
            f = np.flatnonzero(held)
            c = held[f]
            ids.append(f.astype(np.int32))
            counts.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "bucket", "rank", "ids", "counts"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows whose crc32(key) mod 5 is not 0 and whose text and lang aren't null.

    Document frequencies count all those rows, summed in each task before a shuffle of at most DIM rows a task. The
    weights learn from a sample of about `sample` rows, an equal share a language; a quarter of it (mod 5 = 1) sets the
    temperature only. Without such rows there are no classes, and every text is undetermined.
    """
    learn = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), _bucket(F.col(key)).cast("int").alias("bucket"), F.xxhash64(F.lit(17), F.col(key)).alias("rank")).where("text is not null and lang is not null and coalesce(bucket, 0) <> 0")
    sizes = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}
    classes = sorted(sizes)
    if not classes:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    share = max(1, sample // len(classes))
    found = learn.select("text").mapInArrow(_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1)
    df[found["feature"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    part = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, share / sizes[c])))])[F.col("lang")]
    chosen = learn.where((F.shiftrightunsigned("rank", 11) * 2.0**-53) < part).select("lang", "bucket", "rank", "text")
    rows = chosen.mapInArrow(_features, "lang string, bucket int, rank bigint, ids array<int>, counts array<int>").toArrow().sort_by([("rank", "ascending"), ("lang", "ascending")])
    number = {c: k for k, c in enumerate(classes)}
    fitted, held = [], []
    for lang_, bucket, ids, counts in zip(rows["lang"], rows["bucket"], rows["ids"], rows["counts"], strict=True):
        at, c = ids.values.to_numpy(), counts.values.to_numpy()
        if len(at):
            (held if bucket.as_py() == 1 else fitted).append((number[lang_.as_py()], at, c * (SCALE / c.sum()) * idf[at]))
    w, bias = train(fitted or held, len(classes))
    logits = np.array([x @ w[at] + bias for _, at, x in held]).reshape(len(held), len(classes))
    t = temperature(logits, np.array([k for k, _, _ in held], int))
    return Model(classes, (w * idf[:, None]).astype(np.float32), bias, t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text plus lang_pred and score. Null text, or one without a letter, is undetermined with score 0; of equally likely languages the first by name wins.

    Rows are judged one by one: repeated ones get equal results, null ids stay null, an empty table gives an empty result.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = StructType([*docs.select(*(f"`{c}`" for c in keep)).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = [m.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[f.name for f in schema.fields])

    return docs.select(*(f"`{c}`" for c in keep), f"`{text}`").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """The columns of the op2 contract; only text reaches the prediction."""
    model = fit(docs)
    rows = docs.select("doc_id", F.coalesce(_bucket(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")

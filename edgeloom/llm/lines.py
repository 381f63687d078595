"""Line dedup: windows of three consecutive lines, found again anywhere, lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key

WINDOW = 3


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with text cut down, plus _n_lines and _n_removed (longs).

    A window is WINDOW consecutive lines (split at line feeds, compared exactly by a 128-bit fingerprint). Its first
    occurrence is the one with the least (key, text fingerprint, place); lines in any later occurrence go, overlaps
    merge. Texts with fewer lines have no window. Null text stays null with 0 lines; rows that repeat both key and
    text count as one document and get the same result. A null key sorts first.

    The first occurrence is a minimum, combined before the shuffle; the join back to all windows is a plain equi-join
    on the fingerprint, which adaptive execution splits where a window is very frequent. Texts move once, to meet
    their removed lines.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))  # so that no input column meets one of those below
    text, key = (f"c{names.index(c)}" for c in (text, key))
    w = WINDOW
    id_ = F.struct(F.col(key).alias("k"), text_key(F.col(text)).alias("t")).alias("_id")
    pieces = docs.where(F.col(text).isNotNull()).select(id_, F.split(F.col(text), "\n").alias("_lines")).where(F.size("_lines") >= w)
    parts = ", ".join(f"_lines[i + {j}]" for j in range(w))
    windows = pieces.select("_id", F.explode(F.expr(f"transform(sequence(0, size(_lines) - {w}), i -> struct(i as at, xxhash64(1, {parts}) as a, xxhash64(2, {parts}) as b))")).alias("_w")).select("_id", "_w.at", "_w.a", "_w.b")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    later = windows.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(F.struct("_id", "at") > F.col("first"))
    hits = later.groupBy("_id").agg(F.collect_set("at").alias("_hits")).select(F.col("_id").alias("_hit_id"), "_hits")
    df = docs.withColumn("_id", id_)
    # fields are compared one by one, null keys too
    same = F.col("_id.k").eqNullSafe(F.col("_hit_id.k")) & (F.col("_id.t.a") == F.col("_hit_id.t.a")) & (F.col("_id.t.b") == F.col("_hit_id.t.b"))
    df = df.join(hits, same, "left").withColumn("_split", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    gone = "array_distinct(flatten(transform(_hits, p -> sequence(p, p + %d))))" % (w - 1)
    df = df.withColumn("_kept", F.expr(f"case when _hits is null then null else array_except(sequence(0, size(_split) - 1), {gone}) end"))
    df = df.withColumn("_n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_split")).cast("long"))
    df = df.withColumn("_n_removed", F.expr("case when _hits is null then 0 else size(_split) - size(_kept) end").cast("long"))
    df = df.withColumn(text, F.expr(f"case when _hits is null then `{text}` else array_join(transform(_kept, i -> _split[i]), '\\n') end"))
    return df.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True) if n not in ("_n_lines", "_n_removed")), "_n_lines", "_n_removed")


def digest(docs: DataFrame) -> DataFrame:
    df = drop_repeated_lines(docs.select("doc_id", "text"))
    return df.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))

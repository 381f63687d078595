"""Sequences as DataFrames (idx, v) with a dense index from 0: scans, packs, searches, selection, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Rows of one block of a two-level scan.
BLOCK = 1 << 16


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """df plus idx, its place in the given total order: range-partitioned, numbered within partitions, shifted by the sizes before."""
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    return within.join(F.broadcast(shift), F.col("_part") == F.col("_p")).withColumn("idx", F.col("_n") + F.col("_before")).drop("_part", "_n", "_p", "_before")


def _before(blocks: DataFrame, fold: str, *lead: str) -> DataFrame:
    """(*lead, _b, _ahead): the fold of _t over all blocks before in the order of (*lead, _b). Groups of BLOCK blocks fold
    first, so no task gets more than BLOCK totals, up to BLOCK ** 3 rows of a sequence.
    """
    f, upto = getattr(F, fold), (Window.unboundedPreceding, -1)
    grouped = blocks.withColumn("_g", F.floor(F.col("_b") / BLOCK))
    tops = grouped.groupBy(*lead, "_g").agg(f("_t").alias("_t"))
    tops = tops.select(*[F.col(c).alias(f"_{c}_") for c in [*lead, "_g"]], f("_t").over(Window.orderBy(*lead, "_g").rowsBetween(*upto)).alias("_far"))
    inner = grouped.withColumn("_near", f("_t").over(Window.partitionBy(*lead, "_g").orderBy("_b").rowsBetween(*upto)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*lead, "_g"]]
    return inner.join(tops, same).select(*lead, "_b", _folded(fold, F.col("_far"), F.col("_near")).alias("_ahead"))


def _folded(fold: str, a: Column, b: Column) -> Column:
    """The fold of two values; null is the fold of nothing."""
    if fold == "sum":
        return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)
    return {"min": F.least, "max": F.greatest}[fold](a, b)


def _scan(rows: DataFrame, value: str, fold: str, inclusive: bool) -> DataFrame:
    """rows plus _s, the prefix fold of one column (null for nothing): blocks fold first; a block's rows then meet the fold of all blocks before."""
    rows = rows.withColumn("_b", F.floor(F.col("idx") / BLOCK))
    upto = Window.partitionBy("_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ahead = _before(rows.groupBy("_b").agg(getattr(F, fold)(value).alias("_t")), fold).withColumnRenamed("_b", "_c")
    out = rows.withColumn("_w", getattr(F, fold)(value).over(upto)).join(ahead, F.col("_b") == F.col("_c"))
    return out.withColumn("_s", _folded(fold, F.col("_w"), F.col("_ahead"))).drop("_b", "_c", "_w", "_ahead")


def scan(seq: DataFrame, fold: str = "sum", inclusive: bool = False, identity: int = 0) -> DataFrame:
    """(idx, v, s): prefix fold by sum, min or max."""
    return _scan(seq.select("idx", "v"), "v", fold, inclusive).select("idx", "v", F.coalesce("_s", F.lit(identity)).alias("s"))


def reverse_scan(seq: DataFrame, fold: str = "min") -> DataFrame:
    """(idx, v, s): inclusive suffix fold."""
    n = seq.agg(F.max("idx")).first()[0] or 0
    turned = seq.select((F.lit(n) - F.col("idx")).alias("idx"), "v")
    return scan(turned, fold, inclusive=True).select((F.lit(n) - F.col("idx")).alias("idx"), "v", "s")


def pack(seq: DataFrame, flag: Column) -> DataFrame:
    """(idx, v, at): the flagged elements in order, with their new places. Only they are shuffled."""
    return _scan(seq.where(flag).select("idx", "v", F.lit(1).cast("long").alias("_one")), "_one", "sum", False).select("idx", "v", F.coalesce("_s", F.lit(0)).alias("at"))


def pack_index(seq: DataFrame, flag: Column) -> DataFrame:
    return seq.where(flag).select("idx")


def split_by(seq: DataFrame, side: Column) -> DataFrame:
    """(idx, v, side, at): stable partition by side (0, 1, 2 ...; null first): at is the place after it. One count by (side, block) gives where each begins."""
    rows = seq.select("idx", "v", side.alias("side"), F.floor(F.col("idx") / BLOCK).alias("_b"))
    place = F.row_number().over(Window.partitionBy("side", "_b").orderBy("idx")) - 1
    counts = rows.groupBy("side", "_b").agg(F.count(F.lit(1)).alias("_t"))
    ahead = _before(counts, "sum", "side").select(F.col("side").alias("_side"), F.col("_b").alias("_c"), "_ahead")
    placed = rows.withColumn("_n", place).join(ahead, F.col("side").eqNullSafe(F.col("_side")) & (F.col("_b") == F.col("_c")))
    return placed.select("idx", "v", "side", (F.col("_n") + F.coalesce("_ahead", F.lit(0))).alias("at"))


def neighbours(seq: DataFrame, ahead: int = 1, name: str = "next") -> DataFrame:
    """seq plus the value that stands `ahead` places further on (before, if negative); an equi-join, so no global window."""
    return seq.join(seq.select((F.col("idx") - ahead).alias("_j"), F.col("v").alias(name)), F.col("idx") == F.col("_j"), "left").drop("_j")


def unique_adjacent(seq: DataFrame) -> DataFrame:
    return neighbours(seq, -1, "_prev").where("_prev is null or _prev <> v").select("idx", "v")


def adjacent_find(seq: DataFrame) -> DataFrame:
    """(idx): the first place that equals the next; the last place if there is none."""
    pairs = neighbours(seq)
    return pairs.agg(F.coalesce(F.min(F.when(F.col("v") == F.col("next"), F.col("idx"))), F.max("idx")).alias("idx"))


def find_if(seq: DataFrame, test: Column) -> DataFrame:
    """(idx): the first place where test holds; the length if nowhere."""
    return seq.agg(F.coalesce(F.min(F.when(test, F.col("idx"))), F.count(F.lit(1))).alias("idx"))


def find_first_of(seq: DataFrame, values: DataFrame) -> DataFrame:
    n = seq.count()
    return seq.join(values.select(F.col("v").alias("_v")).distinct(), F.col("v") == F.col("_v"), "left_semi").agg(F.coalesce(F.min("idx"), F.lit(n)).alias("idx"))


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx): the first place where two sequences differ; the shorter length if nowhere."""
    both = a.join(b.select(F.col("idx").alias("_i"), F.col("v").alias("_v")), F.col("idx") == F.col("_i"))
    return both.agg(F.coalesce(F.min(F.when(F.col("v") != F.col("_v"), F.col("idx"))), F.count(F.lit(1))).alias("idx"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select(F.col("idx").alias("_i"), F.col("v").alias("_v")), F.col("idx") == F.col("_i"), "full")
    return both.agg(F.coalesce(F.bool_and(F.col("v").eqNullSafe(F.col("_v")) & F.col("idx").isNotNull() & F.col("_i").isNotNull()), F.lit(True)).alias("equal"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(less): whether a is lexicographically less than b; a proper prefix is less."""
    both = a.join(b.select(F.col("idx").alias("_i"), F.col("v").alias("_v")), F.col("idx") == F.col("_i"), "full").withColumn("_at", F.coalesce("idx", "_i"))
    differ = F.when(F.col("idx").isNull(), True).when(F.col("_i").isNull(), False).when(F.col("v") != F.col("_v"), F.col("v") < F.col("_v"))
    return both.agg(F.coalesce(F.min_by(differ, F.when(differ.isNotNull(), F.col("_at"))), F.lit(False)).alias("less"))


def search(seq: DataFrame, needle: list[int], last: bool = False) -> DataFrame:
    """(idx): where needle begins first (or last); the length if nowhere."""
    rows, test = seq, F.lit(True)
    for k, x in enumerate(needle):
        rows = rows if not k else rows.join(seq.select((F.col("idx") - k).alias(f"_j{k}"), F.col("v").alias(f"_v{k}")), F.col("idx") == F.col(f"_j{k}"), "left")
        test = test & F.coalesce((F.col("v") if not k else F.col(f"_v{k}")) == x, F.lit(False))
    at = F.when(test, F.col("idx"))
    return rows.agg(F.coalesce(F.max(at) if last else F.min(at), F.count(F.lit(1))).alias("idx"))


def extremes(seq: DataFrame) -> DataFrame:
    """(min_idx, max_idx): places of the least and the greatest element, the leftmost of equals."""
    return seq.agg(F.min(F.struct("v", "idx"))["idx"].alias("min_idx"), (-F.max(F.struct("v", (-F.col("idx")).alias("n")))["n"]).alias("max_idx"))


def max_subsequence(seq: DataFrame) -> DataFrame:
    """(best): the greatest sum of a contiguous run, 0 for none: prefix sums less the least prefix before."""
    prefix = scan(seq, "sum", inclusive=True).select("idx", F.col("s").alias("v"))
    low = scan(prefix, "min", inclusive=False, identity=0).select(F.col("v"), F.least("s", F.lit(0)).alias("low"))
    return low.agg(F.coalesce(F.greatest(F.max(F.col("v") - F.col("low")), F.lit(0)), F.lit(0)).alias("best"))


def range_min(seq: DataFrame, queries: DataFrame, width: int = 1024) -> DataFrame:
    """(q, idx): place of the least element in [i, j] of each query (q, i, j), the leftmost of equals.

    Whole blocks between the ends are answered from one row a block; only the ends' blocks are read element by element.
    """
    rows = seq.withColumn("_b", F.floor(F.col("idx") / width))
    blocks = rows.groupBy("_b").agg(F.min(F.struct("v", "idx")).alias("_m"))
    q = queries.withColumn("_bi", F.floor(F.col("i") / width)).withColumn("_bj", F.floor(F.col("j") / width))
    ends = q.select("q", "i", "j", F.explode(F.array_distinct(F.array("_bi", "_bj"))).alias("_e"))
    near = ends.join(rows, F.col("_e") == F.col("_b")).where("idx between i and j").groupBy("q").agg(F.min(F.struct("v", "idx")).alias("_m"))
    between = q.where("_bj - _bi > 1").select("q", F.explode(F.sequence(F.col("_bi") + 1, F.col("_bj") - 1)).alias("_e"))
    far = between.join(blocks, F.col("_e") == F.col("_b")).groupBy("q").agg(F.min("_m").alias("_m"))
    return near.unionByName(far).groupBy("q").agg(F.min("_m")["idx"].alias("idx"))


def kth_smallest(seq: DataFrame, k: int) -> DataFrame:
    """(v): the element at place k of the sorted sequence; no row if it is shorter.

    Approximate percentiles bracket it and one count tells how many lie below; only the bracket's values are counted and
    put in order. Should the bracket miss, everything is.
    """
    n = seq.where("v is not null").count()
    if not 0 <= k < n:
        return seq.select("v").limit(0)
    low, high = seq.agg(F.percentile_approx("v", [max(0.0, k / n - 3e-4), min(1.0, (k + 1) / n + 3e-4)], 10000)).first()[0]
    below, inside = seq.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
    hit = below <= k < below + inside
    k = k - below if hit else k
    counts = seq.where(F.col("v").between(low, high) if hit else F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = indexed(counts, "v").select("idx", "n", F.col("v").alias("_x"))
    upto = scan(placed.select("idx", F.col("n").alias("v")), "sum", inclusive=True).select(F.col("idx").alias("_i"), "s", F.col("v").alias("_n"))
    return placed.join(upto, F.col("idx") == F.col("_i")).where((F.col("s") > k) & (F.col("s") - F.col("_n") <= k)).select(F.col("_x").alias("v"))


def approximate_kth(seq: DataFrame, share: float) -> DataFrame:
    return seq.agg(F.percentile_approx("v", share, 10000).alias("v"))


def merge_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, v, side): both in order, the first's before the second's where equal."""
    both = a.select("v", F.lit(0).alias("side"), F.col("idx").alias("_i")).unionByName(b.select("v", F.lit(1).alias("side"), F.col("idx").alias("_i")))
    return indexed(both, "v", "side", "_i").select("idx", "v", "side")


def rotate(seq: DataFrame, by: int) -> DataFrame:
    """Right rotation: the element at i goes to (i + by) mod n."""
    n = max(1, seq.count())
    return seq.select(((F.col("idx") + by) % n).alias("idx"), "v")


def reverse(seq: DataFrame) -> DataFrame:
    n = seq.count()
    return seq.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "v")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.count()
    return a.select("idx", "v").unionByName(b.select((F.col("idx") + n).alias("idx"), "v"))


def gather(seq: DataFrame, at: DataFrame) -> DataFrame:
    """out[i] = seq[at[i]]; at is (idx, v) of places."""
    return at.select(F.col("idx").alias("_o"), F.col("v").alias("_at")).join(seq, F.col("_at") == F.col("idx")).select(F.col("_o").alias("idx"), "v")


def scatter(seq: DataFrame, at: DataFrame) -> DataFrame:
    """out[at[i]] = seq[i]."""
    return at.select(F.col("idx").alias("_i"), F.col("v").alias("_to")).join(seq, F.col("_i") == F.col("idx")).select(F.col("_to").alias("idx"), "v")


def shuffle(seq: DataFrame, seed: int) -> DataFrame:
    """A permutation fixed by the seed, whatever the partitions."""
    keyed = seq.withColumn("_h", F.xxhash64(F.lit(seed), "idx")).withColumnRenamed("idx", "_old")
    return indexed(keyed, "_h", "_old").select("idx", "v")


def is_sorted(seq: DataFrame) -> DataFrame:
    return neighbours(seq).agg(F.coalesce(F.bool_and(F.col("next").isNull() | (F.col("v") <= F.col("next"))), F.lit(True)).alias("sorted"))


def histogram(values: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, n) for every bucket in [0, buckets), empty ones included."""
    counts = values.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(buckets).join(counts, F.col("id") == F.col("_k"), "left").select(F.col("id").alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def collect_reduce(values: DataFrame, key: str, value: Column, buckets: int | None = None) -> DataFrame:
    """(k, total): sums by key; with buckets, one row for each key in [0, buckets)."""
    sums = values.groupBy(F.col(key).cast("long").alias("k")).agg(F.sum(value).alias("total"))
    if buckets is None:
        return sums
    return values.sparkSession.range(buckets).join(sums, F.col("id") == F.col("k"), "left").select(F.col("id").alias("k"), F.coalesce("total", F.lit(0)).alias("total"))


def lower_bound(seq: DataFrame, probes: DataFrame) -> DataFrame:
    """(q, at): for each probe (q, v) the number of lesser elements, which is its place in the sorted sequence: one order of both and a running count, no probe searches alone."""
    none = F.lit(None).cast(probes.schema["q"].dataType)
    both = probes.select("q", "v", F.lit(0).alias("n")).unionByName(seq.select(none.alias("q"), "v", F.lit(1).alias("n")))
    placed = indexed(both, "v", "n", "q")
    before = scan(placed.select("idx", F.col("n").alias("v")), "sum").select(F.col("idx").alias("_i"), F.col("s").alias("at"))
    return placed.where("n = 0").join(before, F.col("idx") == F.col("_i")).select("q", "at")


def remove_duplicates_ordered(seq: DataFrame) -> DataFrame:
    """(idx, v): the first of equal elements at its place, in the order of values."""
    return seq.groupBy("v").agg(F.min("idx").alias("idx")).select("idx", "v")


def heavy_hitters(values: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n) of the keys that make up share of all rows or more; counts combine before the shuffle, at most 1 / share rows come out."""
    n = values.count()
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n * share)


def upsert(table: DataFrame, rows: DataFrame, combine) -> DataFrame:
    """(key, v): table with every row of rows inserted, combine(old, new) where the key is there; rows have distinct keys."""
    new = rows.select(F.col("key").alias("_k"), F.col("v").alias("_v"))
    both = table.join(new, F.col("key") == F.col("_k"), "full")
    value = F.when(F.col("key").isNull(), F.col("_v")).when(F.col("_k").isNull(), F.col("v")).otherwise(combine(F.col("v"), F.col("_v")))
    return both.select(F.coalesce("key", "_k").alias("key"), value.alias("v"))

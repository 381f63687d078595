"""Exact Jaccard self-join of shingle sets in a metric space: pivots, Voronoi cells, triangle-inequality windows, recursion.

Jaccard distance is a metric, but nearly all pairs of texts are at distance 1, where pivots say nothing. So the space
falls into regions first: both sets of a linked pair agree in some of a fixed number of hash parts, and in how many at
least is known from their sizes, as they can differ in so many elements only. Sets with too few shared parts have no
partner and go. If two sets share k parts at least, they share one even without the k - 1 most frequent parts of each,
so these go too, and with them what many documents quote. The connected components over the parts that are left are
the regions, and no link leaves one.

A region of LEAF sets is joined directly. A larger one draws pivots and measures every set against all of them once,
wherever it is. Sets linked to a pivot are of its component without any pair being made, and pairs within one component
are never tested again. What remains is between the region's main component and other sets, the askers. If these are
few, they meet the region's sets chunk by chunk. If they are many, the region falls into the Voronoi cells of its
pivots. An asker y stays in the cell of its nearest pivot p, and a set x within delta of it is replicated to that cell if
d(x, p) <= d(x, nearest) + 2 delta and d(x, p) is within delta of the askers' distances, as the triangle inequality has
it. Cells are regions again, and so on; a cell that its parent's pivots hardly made smaller is dealt into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .common import arrow_rows, drop_staged, staged
from .components import connected_components
from .shingles import mix, shingle_sets

#: Sizes of one class differ by this factor; parts exceed the differences by SPARE; a region of LEAF sets and LEAF_BYTES is joined directly, over CELLS cells of its incidence matrix at a time.
CLASS, SPARE, LEAF, LEAF_BYTES, CELLS = 1.6, 1.4, 256, 32_000_000, 20_000_000
#: Rows of whole sets or texts that Python gets at once; bytes of parts that a task holds before it sends them on; bytes of sets to a bucket of regions.
BATCH, FLUSH, BUCKET = 400, 48_000_000, 32_000_000
#: Pivots of a region, as expected; a cell with more than STUCK of its parent's sets isn't split further but dealt into blocks.
PIVOTS, STUCK, MAX_LEVELS = 16, 0.5, 12
#: Times that sets without enough shared parts are dropped, which leaves others without.
ROUNDS = 2


@lru_cache(4096)
def size_classes(size: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(class, parts, most differences) under which a set of that size must be found: its own class and, if a partner may be in it, the next."""
    most = lambda top: 2 * top * (den - num) // (den + num)
    top, k = 1, 0
    while most(top + 1) == 0:
        top += 1
    while size > top:
        top, k = int(np.ceil(top * CLASS)), k + 1
    out = []
    for cls, upper in ((k, top), (k + 1, int(np.ceil(top * CLASS)))):
        d = most(upper)
        if d and (cls == k or size * den > top * num):
            out.append((cls, int(np.ceil(SPARE * d)) + 1, d))
    return tuple(out)


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    return shared_parts(h, num, den)[0]


def shared_parts(h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int | None]]:
    """Fingerprints of the non-empty parts of a set, their lowest bit being that of the size class, and for each value of this bit how many of them a linked set has too, at least.

    Differing elements leave all but as many parts alone. A set without more non-empty parts than differences (a small
    one) is listed under each element besides, of which one at least is common.
    """
    out, need = [np.zeros(0, np.uint64)], [None, None]
    for cls, parts, most in size_classes(len(h), num, den):
        salt = mix(np.array([cls + 1], np.uint64))
        part = mix(h ^ salt) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part, member = part[order], mix(h[order] + salt)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        named = [mix(np.add.reduceat(member, begin) + mix(part[begin] * np.uint64(64) + np.uint64(cls)))]
        if len(begin) <= most:
            named.append(mix(h + mix(salt + np.uint64(99))))
        out += [(x >> np.uint64(1) << np.uint64(1)) | np.uint64(cls & 1) for x in named]
        need[cls & 1] = max(1, len(begin) - most)
    return np.concatenate(out).view(np.int64), need


def set_class(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(docs: DataFrame, text: str, key: str, size: int, num: int, den: int) -> DataFrame:
    """(row, id, n, cls, sigs, need0, need1) of every row; row numbers the rows, copies after the first in a task have no sigs."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, cls, sigs, needs = [], [], [], []
            for h in shingle_sets(batch.column(1), size):
                n.append(len(h))
                cls.append(set_class(h) if len(h) else None)
                named, need = shared_parts(h, num, den) if len(h) and cls[-1] not in seen else (np.zeros(0, np.int64), (None, None))
                sigs.append(named)
                needs.append(need)
                seen.add(cls[-1])
            ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sigs]))
            arrays = [pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), *(pa.array([x[k] for x in needs], pa.int32()) for k in (0, 1))]
            row += len(n)
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n", "cls", "sigs", "need0", "need1"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "row bigint, id bigint, n bigint, cls bigint, sigs array<bigint>, need0 int, need1 int")


def _shared_parts(sketch: DataFrame, buckets: int) -> DataFrame:
    """(sig, row) of the parts that several rows have, and no others: most parts are in one set only, and none of those moves as a row."""
    from pyspark import TaskContext

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[int] = []
        size = 0

        def out() -> pa.RecordBatch:
            prints, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            return shared.packed(shared.entries(prints, owner, np.array(names, np.int64), buckets, int(TaskContext.get().partitionId())))

        for batch in batches:
            sigs = batch.column(1)
            n = np.diff(sigs.offsets.to_numpy())
            held.append((sigs.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(n)) + len(names), n)))
            names += batch.column(0).to_pylist()
            size += 20 * len(held[-1][0])
            if size >= FLUSH:
                yield out()
                held, names, size = [], [], 0
        if held:
            yield out()

    def meet(t: pa.Table) -> pa.Table:
        ids, prints, _, _ = shared.meet(t)
        return pa.table({"sig": pa.array(prints.view(np.int64)), "row": pa.array(ids)})

    full = sketch.where("size(sigs) > 0").select("row", "sigs")
    return full.mapInArrow(find, shared.SCHEMA).groupBy("bucket").applyInArrow(meet, "sig bigint, row bigint")


def _candidates(parts: DataFrame, sketch: DataFrame) -> DataFrame:
    """(sig, cls, p) of the classes that share as many parts as a linked one must, with another such class; p is the least class of a part. Of each class the most frequent parts are left out that can't be all it shares with a linked one."""
    need = [sketch.where(f"need{k} is not null").groupBy(F.col("cls").alias("_cls")).agg(F.max(f"need{k}").alias("need")).withColumn("_bit", F.lit(k).cast("long")) for k in (0, 1)]
    need = need[0].unionByName(need[1])  # this and the lists below grow with the documents, so none is ever broadcast
    bit = F.col("sig").bitwiseAND(F.lit(1).cast("long"))

    def several(df: DataFrame) -> DataFrame:
        of = df.groupBy(F.col("sig").alias("_sig")).agg(F.min("cls").alias("p"), F.max("cls").alias("_q"), F.count(F.lit(1)).alias("often")).where("p <> _q").drop("_q")
        return df.join(of, F.col("sig") == F.col("_sig")).drop("_sig")

    named = parts.join(sketch.where("cls is not null").select("row", "cls"), "row").select("sig", "cls").distinct()
    found = staged(several(named))
    drop_staged(parts)
    for _ in range(ROUNDS):
        able = found.groupBy("cls", bit.alias("bit")).agg(F.count(F.lit(1)).alias("held")).join(need.hint("merge"), (F.col("cls") == F.col("_cls")) & (F.col("bit") == F.col("_bit"))).where("held >= need").select(F.col("cls").alias("_c"), "_bit", "need")
        able = staged(able)
        left = staged(several(found.select("sig", "cls").join(able.drop("need").hint("merge"), (F.col("cls") == F.col("_c")) & (bit == F.col("_bit")), "left_semi")))
        drop_staged(found)
        found = left
    order = Window.partitionBy("cls", "_bit").orderBy(F.desc("often"), "sig")
    ranked = found.join(able.hint("merge"), (F.col("cls") == F.col("_c")) & (bit == F.col("_bit"))).withColumn("_rank", F.row_number().over(order))
    left = staged(several(ranked.where("_rank >= need").select("sig", "cls")))
    drop_staged(found)
    return left


def _sets(docs: DataFrame, text: str, key: str, size: int, wanted: DataFrame) -> DataFrame:
    """(cls, members) of the classes in wanted (id, cls): the set's sorted fingerprints as bytes.

    wanted grows with the documents and is never broadcast. Rows that share an id come to one task, which passes a class
    on once; if Spark splits a large task, a class may come once from each part, which adds no pair that matters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, ok = list(shingle_sets(batch.column(1), size)), []
            for k, (h, c) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)):
                if len(h) and c not in seen and set_class(h) == c:  # an id may name several texts
                    ok.append(k)
                    seen.add(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), pa.array([sets[k].tobytes() for k in ok], pa.binary())], names=["cls", "members"])

    found = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("text")).join(wanted.hint("merge"), F.col("_id") == F.col("id")).select("cls", "text")
    return found.mapInArrow(run, "cls bigint, members binary")


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0, len(b)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both, len(a) + len(b) - both


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a bounded group, as a product of its incidence matrix; elements of one set only are left out."""
    size = [len(m) for m in sets]
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = n[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width, out = int(column.max()) + 1 if len(column) else 0, np.zeros((len(sets), len(sets)))
    step = max(1, CELLS // max(1, len(sets)))
    for at in range(0, width, step):
        here = (column >= at) & (column < at + step)
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[row[here], column[here] - at] = 1
        out += m @ m.T
    return out.astype(np.int64) + np.diag(np.array(size) - out.diagonal().astype(np.int64))


def forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie together what the symmetric matrix ok does, one fewer than nodes in each component."""
    links, fresh = [], np.ones(len(ok), bool)
    for root in np.flatnonzero(ok.any(1)):
        if not fresh[root]:
            continue
        fresh[root], front = False, [root]
        while front:
            i = front.pop()
            near = np.flatnonzero(ok[i] & fresh)
            fresh[near] = False
            links += [(int(i), int(j)) for j in near]
            front += near.tolist()
    return links


#: What a set does in a region: asks and is asked, only asks, only is asked.
BOTH, ASKS, ASKED = 0, 1, 2


def _busy(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows (region, x, size, role, was, d) of regions where a pair may still tie two components together, with comp, the region's sets n, bytes, askers and least asker by hash.

    Where all sets ask, those of the main component are only asked: any pair to be tested has a set that isn't of it.
    """
    named = rows.withColumn("comp", F.col("x")) if groups is None else rows.join(groups, F.col("x") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "x")).drop("node", "component")
    both = F.col("role") == BOTH
    parts = named.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(both.cast("int")).alias("ask"))
    of = parts.groupBy(F.col("region").alias("_r")).agg(F.count(F.lit(1)).alias("_comps"), F.sum("n").alias("n"), (F.sum("size") * 8).alias("bytes"), F.sum("ask").alias("_ask"), F.max(F.struct("n", "comp")).alias("_main"))
    of = of.where("_comps > 1 and _ask > 0").select("_r", "n", "bytes", (F.col("n") == F.col("_ask")).alias("_all"), "_main", F.when(F.col("n") == F.col("_ask"), F.col("n") - F.col("_main.n")).otherwise(F.col("_ask")).alias("askers"))
    out = named.join(of, F.col("region") == F.col("_r"))
    return out.withColumn("role", F.when(F.col("_all") & (F.col("comp") == F.col("_main.comp")), ASKED).otherwise(F.col("role"))).drop("_r", "_all", "_main")


def _join_leaves(rows: DataFrame, sets: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Links (a, b) between the components of rows (region, x, role, comp), a spanning forest of each bounded region; a task gets many regions."""

    def run(t: pa.Table) -> pa.Table:
        region, x, role, comp = (t.column(c).to_numpy() for c in ("region", "x", "role", "comp"))
        members, links = pa.concat_arrays(t.column("members").cast(pa.large_binary()).chunks), []
        order = np.argsort(region, kind="stable")
        for a, z in shared.runs(region[order]):
            k = order[a:z]
            sets_ = [np.frombuffer(members[i].as_py(), np.uint64) for i in k.tolist()]
            size = np.array([len(m) for m in sets_])
            both = overlaps(sets_)
            ok = den * both >= num * (size[:, None] + size[None, :] - both)
            ask, asked = role[k] != ASKED, role[k] != ASKS
            ok &= (comp[k][:, None] != comp[k][None, :]) & ((ask[:, None] & asked[None, :]) | (asked[:, None] & ask[None, :]))
            links += [(int(x[k[i]]), int(x[k[j]])) for i, j in forest(ok)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    full = rows.hint("merge").join(sets, F.col("x") == F.col("cls")).select(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket"), "region", "x", "role", "comp", "members")
    return full.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """Askers in blocks of about LEAF sets and LEAF_BYTES, all sets in chunks of as many; each block meets each chunk in a region of its own, so no task holds a whole one."""
    many = lambda n: F.greatest(F.ceil(F.col(n) / LEAF), F.ceil(F.col("bytes") * F.col(n) / F.col("n") / LEAF_BYTES)).cast("int")
    dealt = rows.withColumn("_i", many("askers")).withColumn("_j", many("n"))
    mine = lambda n, salt: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = dealt.where(F.col("role") != ASKED).withColumn("_b", mine("_i", 1)).withColumn("_c", spread("_j")).withColumn("role", F.lit(ASKS))
    asked = dealt.withColumn("_c", mine("_j", 2)).withColumn("_b", spread("_i")).withColumn("role", F.lit(ASKED))
    return asks.unionByName(asked).withColumn("region", F.xxhash64("region", "_b", "_c")).select("region", "x", "role", "comp")


def _measured(rows: DataFrame, sets: DataFrame, num: int, den: int, level: int) -> DataFrame:
    """(region, x, size, d, links): the distances of every set to its region's pivots, in their order, and the pivots it is linked with.

    rows (region, x, size, n, bytes): a set is a pivot by its hash, PIVOTS of a region as expected, and the set of the least
    hash always. Chunks of a region's sets meet a copy of its pivots, so no task holds a whole region.
    """
    draw = F.xxhash64("x", F.lit(level))
    first = rows.groupBy(F.col("region").alias("_r")).agg(F.min(draw).alias("_least"), F.max(F.greatest(F.ceil(F.col("n") / (2 * LEAF)), F.ceil(F.col("bytes") / LEAF_BYTES))).cast("int").alias("chunks"))
    dealt = rows.join(first, F.col("region") == F.col("_r"))
    full = staged(dealt.hint("merge").join(sets, F.col("x") == F.col("cls")).select("region", "x", "size", "chunks", (F.pmod(draw, F.col("n")) < PIVOTS).alias("pivot") | (draw == F.col("_least")), "members").toDF("region", "x", "size", "chunks", "pivot", "members"))
    pivots = full.where("pivot").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("region", "chunk", "x", "members")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("x")
        names = right.column("x").to_numpy()
        held = [np.frombuffer(m.as_py(), np.uint64) for m in right.column("members")]
        known, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
        table = np.zeros((len(known) + 1, len(held)), bool)
        table[column, np.repeat(np.arange(len(held)), [len(h) for h in held])] = True
        sizes = np.array([len(h) for h in held])
        d, links = [], []
        for m in left.column("members"):
            h = np.frombuffer(m.as_py(), np.uint64)
            at = np.searchsorted(known, h)
            at[at < len(known)] = np.where(known[at[at < len(known)]] == h[at < len(known)], at[at < len(known)], len(known))
            both = table[at].sum(0)
            either = len(h) + sizes - both
            d.append(1 - both / either)
            links.append(names[den * both >= num * either])
        return pa.table({"region": left.column("region"), "x": left.column("x"), "size": left.column("size"), "d": pa.array(d, pa.list_(pa.float64())), "links": pa.array(links, pa.list_(pa.int64()))})

    chunked = full.select("region", F.pmod(F.xxhash64("x", F.lit(3)), F.col("chunks")).cast("int").alias("chunk"), "x", "size", "members")
    out = staged(chunked.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInArrow(measure, "region bigint, x bigint, size bigint, d array<double>, links array<bigint>"))
    drop_staged(full)
    return out


def _cells(rows: DataFrame, delta: float) -> DataFrame:
    """Rows (region, x, size, role, d, n) of the Voronoi cells that have askers: these, and every set that may be within delta of one."""
    wide = delta + 1e-9
    placed = rows.withColumn("_near", F.array_min("d")).withColumn("_own", F.expr("array_position(d, array_min(d)) - 1").cast("int"))
    hosts = placed.where(F.col("role") != ASKED).groupBy("region", "_own").agg(F.min("_near").alias("lo"), F.max("_near").alias("hi"))
    hosts = hosts.groupBy(F.col("region").alias("_r")).agg(F.collect_list(F.struct(F.col("_own").alias("p"), "lo", "hi")).alias("hosts"))
    at = F.expr(f"filter(hosts, h -> (h.p = _own and role <> {ASKED}) or (d[h.p] <= _near + 2 * {wide} and d[h.p] >= h.lo - {wide} and d[h.p] <= h.hi + {wide}))")
    each = placed.join(hosts, F.col("region") == F.col("_r")).withColumn("_h", F.explode(at))
    stays = (F.col("_h.p") == F.col("_own")) & (F.col("role") != ASKED)
    return each.select(F.xxhash64("region", "_h.p").alias("region"), "x", "size", F.when(stays, BOTH).otherwise(ASKED).alias("role"), F.col("n").alias("was"), F.lit(None).cast("array<double>").alias("d"))


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n, component): one row per row of docs; n distinct shingles, component the least id that links reach.

    Two texts link when den * |A & B| >= num * |A | B| for their sets A, B of lower-cased (A-Z) word shingles. Null text
    or one without words has no set and is its own component; so is a row with a null id, whose component is null. Equal
    texts are one class; rows that share an id are separate documents; an empty table gives an empty result. Exact:
    regions and windows lose no link, only pairs that would join one component again are left out.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_classes(docs, text, key, size, num, den)


def _near_classes(docs: DataFrame, text: str, key: str, size: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sketch = staged(_sketch(docs, text, key, size, num, den))
    total = sketch.agg(F.sum(F.size("sigs"))).first()[0] or 0
    parts = staged(_shared_parts(sketch, max(buckets, 8 * total // BUCKET)))
    slim = staged(sketch.select("row", "id", "n", "cls", "need0", "need1"))
    drop_staged(sketch)
    sketch = slim
    several = _candidates(parts, sketch)
    regions = connected_components(several.where("cls <> p").select(F.col("cls").alias("a"), F.col("p").alias("b")))
    drop_staged(several)
    wanted = sketch.where("cls is not null and id is not null").join(regions, F.col("cls") == F.col("node")).groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("size"), F.max("component").alias("region"))
    wanted = staged(wanted)
    sets = staged(_sets(docs, text, key, size, wanted.select("id", "cls")))
    groups = _links(wanted, sets, num, den, buckets)
    drop_staged(sets, wanted, regions)

    least = sketch.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    tied = staged(least.join(groups, F.col("cls") == F.col("node"), "left").where("copies > 1 or component is not null").select("cls", "least", F.coalesce("component", "cls").alias("component")))
    top = tied.groupBy(F.col("component").alias("top")).agg(F.min("least").alias("least_of"))
    named = staged(tied.join(top, F.col("component") == F.col("top")).select(F.col("cls").alias("_cls"), F.col("least_of").alias("component")))
    drop_staged(tied, groups)
    out = sketch.select("id", "n", "cls").join(named, F.col("cls") == F.col("_cls"), "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def _links(wanted: DataFrame, sets: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """(node, component) of the classes in wanted (cls, size, region) that links tie together."""
    delta = 1 - num / den
    volume = 8 * (wanted.agg(F.sum("size")).first()[0] or 0)
    buckets = max(buckets, volume // BUCKET)
    none = lambda kind: F.lit(None).cast(kind)
    rows = wanted.select("region", F.col("cls").alias("x"), "size", F.lit(BOTH).alias("role"), none("bigint").alias("was"), none("array<double>").alias("d"))
    groups = None
    fits = lambda n: (F.col(n) <= LEAF) & (F.col("bytes") * F.col(n) <= F.col("n") * LEAF_BYTES)
    for step in range(2 * MAX_LEVELS + 1):
        busy = staged(_busy(rows, groups))
        over = step == 2 * MAX_LEVELS
        leaf = fits("n")
        stuck = (fits("askers") | (F.col("n") > STUCK * F.coalesce("was", F.lit(1 << 62))) | F.lit(over)) & ~leaf
        n_leaf, n_stuck, n_large = (int(v or 0) for v in busy.agg(F.sum(leaf.cast("int")), F.sum(stuck.cast("int")), F.sum((~leaf & ~stuck).cast("int"))).first())
        found = []
        if n_leaf:
            found.append(staged(_join_leaves(busy.where(leaf).select("region", "x", "role", "comp"), sets, num, den, buckets)))
        if n_stuck:
            found.append(staged(_join_leaves(_blocks(busy.where(stuck)), sets, num, den, buckets)))
        large, passed = busy.where(~leaf & ~stuck), None
        if n_large and step % 2 == 0:
            passed = _measured(large.select("region", "x", "size", "n", "bytes"), sets, num, den, step)
            found.append(passed.select(F.col("x").alias("a"), F.explode("links").alias("b")))
            rows = large.select(F.col("region").alias("_r"), F.col("x").alias("_x"), "role", "was").join(passed, (F.col("_r") == F.col("region")) & (F.col("_x") == F.col("x"))).select("region", "x", "size", "role", "was", "d")
        elif n_large:
            rows = _cells(large, delta)
        if found:
            every = found[0].select("a", "b")
            for f in found[1:]:
                every = every.unionByName(f.select("a", "b"))
            if groups is not None:
                every = every.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
            groups = connected_components(every)
        if not n_large:
            break
        rows = staged(rows)
        drop_staged(busy, *([passed] if passed is not None else []))
    if groups is None:
        return wanted.select(F.col("cls").alias("node"), F.col("cls").alias("component")).where("false")
    return groups


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component one row stays: that of the least id, then of the least fingerprint, then of the least other columns. A row is known by its id and text, so one that is in no component of others stays whatever shares its id; rows without an id or without words stay."""
    held_id, held_text = F.col(f"`{key}`"), F.col(f"`{text}`")
    row = F.when(held_id.isNotNull(), F.xxhash64(held_id, held_text))
    classes = near_classes(docs.select(row.alias("_row"), held_text.alias("_text")), "_text", "_row", size, num, den)
    sets = classes.where("id is not null and n > 0").groupBy("id").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("copies"))
    ids = docs.select(row.alias("_row"), held_id.alias("_id")).where("_row is not null").distinct()
    rows = staged(sets.join(ids, F.col("id") == F.col("_row")).select("component", "copies", F.struct("_id", "_row").alias("at")))
    least = rows.groupBy(F.col("component").alias("_c")).agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most")
    gone = staged(rows.join(least, (F.col("component") == F.col("_c")) & (F.col("at") != F.col("least")), "left_semi").select(F.col("at._row").alias("_gone")).distinct())
    twice = staged(rows.where("copies > 1").select(F.col("at._row").alias("_twice")).distinct())
    drop_staged(rows)
    kept = docs.join(gone, row == F.col("_gone"), "left_anti")
    if not twice.limit(1).count():
        return kept
    number = F.row_number().over(Window.partitionBy(row).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    one = kept.join(twice, row == F.col("_twice"), "left_semi").withColumn("_number", number).where("_number = 1").drop("_number")
    return kept.join(twice, row == F.col("_twice"), "left_anti").unionByName(one)

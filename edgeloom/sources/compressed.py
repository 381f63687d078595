"""Byte-coded graphs: three longs (n, m, bytes), n + 1 offsets (long), n degrees (int), then each vertex's coded neighbours.

A directed file goes on with the same of the arcs that come in: bytes (long), offsets, degrees, codes.

Numbers are varints, low bits first, with a more bit (128). The first neighbour of a run is coded as its difference from
the vertex, with 6 bits and a sign bit (64) in the first byte; the others as differences from the one before, 7 bits a
byte. A weight follows its neighbour: a whole number like a first neighbour, or a four-byte float.

* ``byte``: a vertex has one run.
* ``blocks``: a run for each 64 neighbours, after the places (int, from the vertex's first byte) of all but the first.
* ``counted``: as blocks, but the number of neighbours that the places stand for (int) comes first, and each run begins
  with the number of neighbours before it (int); runs may have lost some of their 64, which the places don't show.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.sequence import indexed, scan
from ..staging import staged

CODECS = ("byte", "blocks", "counted")
WEIGHTS = {None: None, "int": "long", "float": "float"}
#: Neighbours in a run of a blocked code (fixed value of the format).
PER_RUN = 64
#: Vertices of one row of the reading plan, and code bytes and runs decoded at once.
RANGE = 1 << 14
SLICE = 1 << 20
RUNS = 1 << 14


def _put(out: bytearray, value: int, signed: bool) -> None:
    size = abs(value)
    bits = 6 if signed else 7
    out.append((size & ((1 << bits) - 1)) | (64 if signed and value < 0 else 0) | (128 if size >> bits else 0))
    size >>= bits
    while size:
        out.append((size & 127) | (128 if size >> 7 else 0))
        size >>= 7


def encode_neighbours(vertex: int, targets: list[int], weights: list | None = None, weight: str | None = None, before: int | None = None) -> bytes:
    """The code of a run; with before, the neighbour that comes before it, of a part of one."""
    out = bytearray()
    for k, t in enumerate(targets):
        if k or before is not None:
            _put(out, t - (targets[k - 1] if k else before), False)
        else:
            _put(out, t - vertex, True)
        if weight == "int":
            _put(out, int(weights[k]), True)
        elif weight == "float":
            out += np.float32(weights[k]).tobytes()
    return bytes(out)


def _take(code: bytes, at: int, signed: bool) -> tuple[int, int]:
    byte = code[at]
    value, shift = (byte & 63, 6) if signed else (byte & 127, 7)
    sign = -1 if signed and byte & 64 else 1
    at += 1
    while byte & 128:
        byte = code[at]
        value |= (byte & 127) << shift
        shift += 7
        at += 1
    return sign * value, at


def decode_neighbours(vertex: int, degree: int, code: bytes, weight: str | None = None):
    """The neighbours of one run; with a weight, (neighbours, weights)."""
    out, weights, at = [], [], 0
    for k in range(degree):
        step, at = _take(code, at, not k)
        out.append((out[-1] if k else vertex) + step)
        if weight == "int":
            w, at = _take(code, at, True)
            weights.append(w)
        elif weight == "float":
            weights.append(float(np.frombuffer(code, "<f4", 1, at)[0]))
            at += 4
    return (out, weights) if weight else out


def _take_all(code: np.ndarray, at: np.ndarray, lanes: np.ndarray, signed: bool) -> np.ndarray:
    """The varint at each lane's place; the places move behind it."""
    byte = code[at[lanes]].astype(np.int64)
    at[lanes] += 1
    value = byte & (63 if signed else 127)
    sign = np.where(byte & 64, -1, 1) if signed else 1
    shift, more = 6 if signed else 7, np.flatnonzero(byte & 128)
    while more.size:
        byte = code[at[lanes[more]]].astype(np.int64)
        at[lanes[more]] += 1
        value[more] |= (byte & 127) << shift
        shift += 7
        more = more[(byte & 128) > 0]
    return value * sign


def decode_runs(code: np.ndarray, at: np.ndarray, vertex: np.ndarray, count: np.ndarray, weight: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Neighbours and weights of many runs, in the order of the runs: the k-th neighbours of all runs are read in one step."""
    at, last, start = at.copy(), vertex.astype(np.int64), np.cumsum(count) - count
    dst = np.empty(int(count.sum()), np.int64)
    w = np.empty(len(dst), np.float32 if weight == "float" else np.int64) if weight else None
    lanes = np.arange(len(at))
    for k in range(int(count.max(initial=0))):
        lanes = lanes[count[lanes] > k]
        last[lanes] += _take_all(code, at, lanes, not k)
        dst[start[lanes] + k] = last[lanes]
        if weight == "int":
            w[start[lanes] + k] = _take_all(code, at, lanes, True)
        elif weight == "float":
            w[start[lanes] + k] = code[at[lanes][:, None] + np.arange(4)].view("<f4")[:, 0]
            at[lanes] += 4
    return dst, w


def _ints(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    return code[at[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)


def find_runs(code: np.ndarray, begin: np.ndarray, degree: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, at, count) of the runs of blocked codes; begin are the first bytes of vertices of that degree, which have neighbours."""
    counted = codec == "counted"
    slots = _ints(code, begin) if counted else degree
    n = 1 + (slots - 1) // PER_RUN
    owner = np.repeat(np.arange(len(begin)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    head = begin + (4 if counted else 0)
    at = head[owner] + 4 * (n[owner] - 1)
    later = k > 0
    at[later] = begin[owner[later]] + _ints(code, head[owner[later]] + 4 * (k[later] - 1))
    if not counted:
        return owner, at, np.minimum(PER_RUN, degree[owner] - PER_RUN * k)
    first = _ints(code, at)
    end = degree[owner]
    inner = k < n[owner] - 1
    end[inner] = first[1:][inner[:-1]]
    return owner, at + 4, np.maximum(end - first, 0)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _files(path: str) -> list[str]:
    f, name = _open(path)
    if f.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    found = [i.base_name for i in f.get_file_info(pafs.FileSelector(name)) if i.is_file and not i.base_name.startswith((".", "_"))]
    return [f"{path.rstrip('/')}/{b}" for b in sorted(found)]


def _batches(f, n: int, base: int, v0: int, size: int, piece: int, codec: str, weight: str | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The edges of size vertices from v0 on, a piece of their codes at a time."""
    offsets = np.frombuffer(f.read_at(8 * (size + 1), base + 8 * v0), "<i8")
    degree = np.frombuffer(f.read_at(4 * size, base + 8 * (n + 1) + 4 * v0), "<u4").astype(np.int64)
    body, lo = base + 8 * (n + 1) + 4 * n, 0
    while lo < size:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, "right")) - 1)
        raw = f.read_at(int(offsets[hi] - offsets[lo]), body + int(offsets[lo]))
        live = np.flatnonzero(degree[lo:hi]) + lo
        begin = offsets[live] - offsets[lo]
        if codec == "byte":
            for v, b, e in zip(live, begin, offsets[live + 1] - offsets[lo]):
                got = decode_neighbours(int(v) + v0, int(degree[v]), raw[b:e], weight)
                dst, w = got if weight else (got, None)
                yield _batch(np.full(len(dst), v + v0), dst, w, weight, names)
        elif live.size:
            code = np.frombuffer(raw, np.uint8)
            owner, at, count = find_runs(code, begin, degree[live], codec)
            vertex = live[owner] + v0
            for r in range(0, len(at), RUNS):
                s = slice(r, r + RUNS)
                dst, w = decode_runs(code, at[s], vertex[s], count[s], weight)
                yield _batch(np.repeat(vertex[s], count[s]), dst, w, weight, names)
        lo = hi


def _batch(src, dst, w, weight: str | None, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(src, pa.int64()), pa.array(dst, pa.int64())] + ([pa.array(w, pa.float32() if weight == "float" else pa.int64())] if weight else [])
    return pa.RecordBatch.from_arrays(columns, names=names)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches together, as vertices of few neighbours would be batches of their own."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_compressed(spark: SparkSession, path: str, codec: str = "byte", weight: str | None = None, incoming: bool = False) -> DataFrame:
    """(src, dst[, w]) of every file under path, a path that pyarrow's file systems open on every executor.

    A task reads the offsets, degrees and codes of ranges of vertices, never the whole file. A vertex's own code is read
    at once, so a hub costs its bytes; its runs are decoded 16,384 at a time, but one list of the plain byte code is a
    chain that is decoded in one go. incoming reads the second half of a directed file and gives the same arcs.
    Vertices without neighbours have no rows; an empty graph has none at all.
    """
    if codec not in CODECS or weight not in WEIGHTS:
        raise ValueError(f"unknown code {codec!r} or weight {weight!r}")
    names = (["dst", "src"] if incoming else ["src", "dst"]) + (["w"] if weight else [])
    ranges, piece = None, SLICE
    for file in _files(path):
        f, name = _open(file)
        with f.open_input_file(name) as h:
            n, _, size = (int(x) for x in np.frombuffer(h.read_at(24, 0), "<i8"))
        base = 24 + 8 * (n + 1) + 4 * n + size + 8 if incoming else 24
        one = spark.range(0, n, RANGE).select(F.lit(file).alias("file"), F.lit(n).cast("long").alias("n"), F.lit(base).cast("long").alias("base"), F.col("id").alias("v0"), F.least(F.lit(RANGE), n - F.col("id")).alias("size"))
        ranges = one if ranges is None else ranges.unionByName(one)
    if ranges is None:
        raise ValueError(f"no file at {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f, name = _open(r["file"])
                with f.open_input_file(name) as h:
                    yield from _merged(_batches(h, r["n"], r["base"], r["v0"], r["size"], piece, codec, weight, names))

    kind = f", w {WEIGHTS[weight]}" if weight else ""
    return ranges.mapInArrow(run, f"{names[0]} long, {names[1]} long{kind}").select("src", "dst", *names[2:])


def _coded(edges: DataFrame, codec: str, weight: str | None) -> DataFrame:
    """(src, run, n, code): runs of at most 64 neighbours, whatever the code, so that no hub is one row."""
    order = indexed(edges, "src", "dst")
    first = order.groupBy("src").agg(F.min("idx").alias("_first")).select(F.col("src").alias("_s"), "_first")
    placed = order.join(first, F.col("src") == F.col("_s")).withColumn("run", F.floor((F.col("idx") - F.col("_first")) / PER_RUN))
    item = F.struct("dst", (F.col("w") if weight else F.lit(0)).alias("w"))
    runs = placed.groupBy("src", "run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    last = F.lag(F.col("items")[F.size("items") - 1]["dst"]).over(Window.partitionBy("src").orderBy("run"))
    runs = runs.withColumn("before", last if codec == "byte" else F.lit(None).cast("long"))
    names = ["src", "run", "n", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head = np.uint32(r["run"] * PER_RUN).tobytes() if codec == "counted" else b""
                code = encode_neighbours(r["src"], [i["dst"] for i in r["items"]], [i["w"] for i in r["items"]], weight, r["before"])
                out.append((r["src"], r["run"], len(r["items"]), head + code))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    return runs.select("src", "run", "items", "before").mapInArrow(run, "src long, run long, n long, code binary")


def _heads(runs: DataFrame, codec: str) -> DataFrame:
    """(src, run = -1, n = 0, code): what comes before a vertex's runs in a blocked code."""
    sizes = F.sort_array(F.collect_list(F.struct("run", F.length("code").alias("size"))))
    rows = runs.groupBy("src").agg(F.sum("n").alias("degree"), sizes.alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, codes = [], []
            for r in batch.to_pylist():
                size = np.array([s["size"] for s in r["sizes"]], np.int64)
                front = 4 if codec == "counted" else 0
                places = front + 4 * (len(size) - 1) + np.cumsum(size)[:-1]
                if len(places) and places[-1] >= 1 << 32:
                    raise ValueError(f"the code of vertex {r['src']} is longer than its places can tell")
                src.append(r["src"])
                codes.append((np.uint32(r["degree"]).tobytes() if front else b"") + places.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array([-1] * len(src), pa.int64()), pa.array([0] * len(src), pa.int64()), pa.array(codes, pa.binary())], names=["src", "run", "n", "code"])

    return rows.mapInArrow(run, "src long, run long, n long, code binary")


def write_compressed(edges: DataFrame, n: int, path: str, codec: str = "byte", weight: str | None = None, directed: bool = False) -> None:
    """One file of the graph on vertices 0 .. n - 1; edges are distinct (src, dst[, w]), and both arcs of an edge unless directed.

    Codes are made in a plan, 64 neighbours a row, and staged. As the format is one file, one writer, the driver,
    appends them in order; it holds one partition at a time. Weights are whole numbers below 2^31 in size, or floats.
    """
    if codec not in CODECS or weight not in WEIGHTS:
        raise ValueError(f"unknown code {codec!r} or weight {weight!r}")
    spark = edges.sparkSession
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["w"] if weight else []))
    f, name = _open(path)
    with f.open_output_stream(name) as out:
        for k, side in enumerate([edges, flipped] if directed else [edges]):
            runs = staged(_coded(side, codec, weight))
            codes = runs if codec == "byte" else staged(runs.unionByName(_heads(runs, codec)))
            total, m = codes.agg(F.coalesce(F.sum(F.length("code")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
            sums = codes.groupBy("src").agg(F.sum(F.length("code")).alias("size"), F.sum("n").alias("degree"))
            every = spark.range(n).join(sums, F.col("id") == F.col("src"), "left")
            offsets = scan(every.select(F.col("id").alias("idx"), F.coalesce("size", F.lit(0)).cast("long").alias("v")))
            out.write(np.array([total] if k else [n, m, total], "<i8").tobytes())
            for rows, kind in ((offsets.select("idx", F.col("s").alias("v")), "<i8"), (None, None), (every.select(F.col("id").alias("idx"), F.coalesce("degree", F.lit(0)).alias("v")), "<u4")):
                if rows is None:
                    out.write(np.array([total], "<i8").tobytes())
                    continue
                for r in rows.orderBy("idx").toLocalIterator():
                    out.write(np.array([r["v"]], kind).tobytes())
            for r in codes.orderBy("src", "run").toLocalIterator():
                out.write(bytes(r["code"]))


def encode_graph(n: int, neighbours: dict[int, list[int]]) -> bytes:
    """The plain byte code of a small graph at hand."""
    codes = [encode_neighbours(v, neighbours.get(v, [])) for v in range(n)]
    degree = [len(neighbours.get(v, [])) for v in range(n)]
    body = b"".join(codes)
    offsets = np.cumsum([0, *map(len, codes)]).astype("<i8")
    return np.array([n, sum(degree), len(body)], "<i8").tobytes() + offsets.tobytes() + np.array(degree, "<i4").tobytes() + body

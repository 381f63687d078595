import json

import numpy as np
import pytest

from edgeloom import cli
from edgeloom.functions import hashes
from edgeloom.sources import adjacency, compressed, edges, vectors
from edgeloom.streaming import degrees


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_list(spark, tmp_path):
    p = tmp_path / "e.tsv"
    p.write_text("# a comment\n5\t9\n9\t9\n5\t9\n9\t7\n")
    e, _ = edges.read_edge_list(spark, str(p))
    assert rows(e) == [(5, 9), (9, 7)]
    e, idmap = edges.read_edge_list(spark, str(p), make_symmetric=True, dense_ids=True)
    assert rows(idmap) == [(5, 0), (7, 1), (9, 2)] and rows(e) == [(0, 2), (1, 2), (2, 0), (2, 1)]
    (tmp_path / "m.json").write_text(json.dumps([7, 5]))
    assert rows(edges.read_json_idmap(spark, str(tmp_path / "m.json"))) == [(5, 1), (7, 0)]
    held, rest = edges.link_prediction_split(e, 0.5, 1)
    assert sorted(rows(held) + rows(rest)) == rows(e) and {(b, a) for a, b in rows(held)} == {*rows(held)}


@pytest.mark.parametrize("weighted", [False, True])
def test_adjacency_round_trip(spark, tmp_path, weighted):
    pairs = [(0, 2), (2, 0), (2, 4), (4, 2)]
    e = spark.createDataFrame([(a, b, a + b) for a, b in pairs], "src long, dst long, w long")
    e = e if weighted else e.drop("w")
    adjacency.write_adjacency(e, 6, str(tmp_path / "g"))
    back, vtx = adjacency.read_adjacency(spark, str(tmp_path / "g"))
    assert rows(back) == rows(e) and vtx.count() == 6


def test_adjacency_rejects_wrong_files(spark, tmp_path):
    (tmp_path / "a").write_text("Nothing\n1\n0\n0\n")
    (tmp_path / "b").write_text("AdjacencyGraph\n2\n1\n0\n")
    for name in "ab":
        with pytest.raises(ValueError):
            adjacency.read_adjacency(spark, str(tmp_path / name))


def test_compressed_graph(spark, tmp_path):
    near = {0: [1, 70, 300_000], 5: [0, 4, 6], 300_000: [0]}
    (tmp_path / "g.bin").write_bytes(compressed.encode_graph(300_001, near))
    assert rows(compressed.read_compressed(spark, str(tmp_path / "g.bin"))) == [(a, b) for a in sorted(near) for b in near[a]]


def arcs(seed, n=900):
    """A hub of more than nine runs, vertices of exactly 64 and 65 neighbours, and some without any."""
    rng = np.random.default_rng(seed)
    out = {(3, int(b)) for b in rng.choice(n, 600, replace=False)} | {(10, b) for b in range(64)} | {(11, b) for b in range(n - 65, n)}
    return sorted(out | {(int(a), int(b)) for a, b in rng.integers(0, n, (300, 2)) if a % 5})


@pytest.mark.parametrize("codec", compressed.CODECS)
@pytest.mark.parametrize("weight", [None, "int", "float"])
def test_codes_round_trip(spark, tmp_path, monkeypatch, codec, weight):
    monkeypatch.setattr(compressed, "RANGE", 100)
    monkeypatch.setattr(compressed, "SLICE", 300)
    w = {None: lambda a, b: None, "int": lambda a, b: (a * 7919 + b) % 300_000 - 150_000, "float": lambda a, b: (a - b) / 8}[weight]
    want = [(a, b, w(a, b)) if weight else (a, b) for a, b in arcs(1)]
    e = spark.createDataFrame(want, "src long, dst long" + (f", w {compressed.WEIGHTS[weight]}" if weight else "")).repartition(5)
    path = str(tmp_path / "g.bin")
    compressed.write_compressed(e, 1000, path, codec, weight, directed=True)
    assert rows(compressed.read_compressed(spark, path, codec, weight)) == want
    assert rows(compressed.read_compressed(spark, path, codec, weight, incoming=True)) == want


def test_plain_codes_are_the_same_bytes(spark, tmp_path):
    near = {}
    for a, b in arcs(2):
        near.setdefault(a, []).append(b)
    compressed.write_compressed(spark.createDataFrame(arcs(2), "src long, dst long"), 900, str(tmp_path / "g"))
    assert (tmp_path / "g").read_bytes() == compressed.encode_graph(900, near)


def test_runs_that_lost_neighbours(spark, tmp_path):
    """130 neighbours are now 3, 0 and 1 in runs at their old places, with dead bytes after each."""
    runs = [(0, [1, 2, 60]), (3, []), (3, [128])]
    body, places = b"", []
    for before, targets in runs:
        places.append(4 + 8 + len(body))
        body += np.uint32(before).tobytes() + compressed.encode_neighbours(7, targets) + b"\xff" * 5
    code = np.uint32(130).tobytes() + np.array(places[1:], "<u4").tobytes() + body
    n, at = 9, np.array([0] * 8 + [len(code)] * 2, "<i8")
    degree = np.array([0] * 7 + [4, 0], "<u4")
    (tmp_path / "g").write_bytes(np.array([n, 4, len(code)], "<i8").tobytes() + at.tobytes() + degree.tobytes() + code)
    assert rows(compressed.read_compressed(spark, str(tmp_path / "g"), "counted")) == [(7, 1), (7, 2), (7, 60), (7, 128)]


def test_codes_of_empty_graphs(spark, tmp_path):
    none = spark.createDataFrame([], "src long, dst long")
    for n in (0, 4):
        compressed.write_compressed(none, n, str(tmp_path / f"g{n}"), "counted", directed=True)
        assert rows(compressed.read_compressed(spark, str(tmp_path / f"g{n}"), "counted", incoming=True)) == []
    with pytest.raises(ValueError):
        compressed.read_compressed(spark, str(tmp_path / "g4"), "other")


def test_vectors(spark, tmp_path):
    x = spark.createDataFrame([(1, [0.5, 2.0]), (0, [1.0, -1.0])], "id long, vec array<double>")
    vectors.write_raw(x, str(tmp_path / "v"))
    assert rows(vectors.read_raw(spark, str(tmp_path / "v"), 2)) == [(0, [1.0, -1.0]), (1, [0.5, 2.0])]
    (tmp_path / "w").write_text("2 2\n0 1 -1\n1 .5 2\n")
    assert rows(vectors.read_word2vec(spark, str(tmp_path / "w"))) == [(0, [1.0, -1.0]), (1, [0.5, 2.0])]


def test_hashes_are_spread(spark):
    got = spark.range(2000).select(hashes.hash64("id").alias("h"), hashes.hash32("id").alias("s")).collect()
    assert len({r["h"] for r in got}) == 2000 and all(0 <= r["s"] < 2**32 for r in got)
    assert np.array_equal(hashes.mix64(np.arange(3)), hashes.mix64(np.arange(3)))


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1L as src union all select timestamp'2024-01-01 00:20:00', 1L union all select timestamp'2024-01-01 03:00:00', 2L").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, src long").parquet(path)
    for name, df, mode in (("win", degrees.windowed_degrees(stream), "complete"), ("run", degrees.running_degrees(stream), "update")):
        s = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        s.processAllAvailable()
        s.stop()
    assert sorted((r["id"], r["degree"]) for r in spark.table("win").collect()) == [(1, 2), (2, 1)]
    assert rows(spark.table("run")) == [(1, 2), (2, 1)]


def test_command_line(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("".join(f"{a}\t{(a * 7 + 3) % 20}\n" for a in range(20)))
    cli.main([str(tmp_path / "e.tsv"), str(tmp_path / "out"), "--walklen", "2", "--rank", "4", "--dim", "2", "--propagate", "--order", "3"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20

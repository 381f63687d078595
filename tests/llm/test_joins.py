import hashlib
import random
import re

import pytest

from edgeloom.llm import decontam, jaccard, suffixes

from .conftest import ODD


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def slow_components(rows, size, num, den):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), len(sets[k]), str(least[top(k)] if i is not None else None)) for k, (i, _) in enumerate(rows))


def edited(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(300)}" for _ in range(110)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(110)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"w{rng.randrange(8)}" for _ in range(rng.randrange(12)))) for i in range(40)]


@pytest.mark.parametrize(("rows", "leaf"), [(ODD, 256), (edited(1, 60), 256), (edited(2, 70), 6)])
def test_near_classes_against_all_pairs(make, monkeypatch, rows, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # small leaves force the recursion and the blocks
    got = jaccard.near_classes(make(rows), size=4, num=85, den=100).collect()
    assert sorted((str(r["id"]), r["n"], str(r["component"])) for r in got) == slow_components([r[:2] for r in rows], 4, 85, 100)


def test_linked_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in [*range(5, 60), 100, 251, 999]:
        x = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for _ in range(20):
            gone = int(rng.integers(0, size * 15 // 100 + 1))
            new = int(rng.integers(0, 1 + max(0, ((size - gone) * 100) // 85 - size)))
            y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**64, new, np.uint64)]))
            both, either = jaccard.overlap(x, y)
            assert (both, either) == (len(np.intersect1d(x, y)), len(np.union1d(x, y)))
            if both < either and 100 * both >= 85 * either:
                assert {*jaccard.signatures(x, 85, 100).tolist()} & {*jaccard.signatures(y, 85, 100).tolist()}


def test_one_of_each_group_stays(make):
    rows = edited(3, 30)
    want = sorted(int(i) for i, _, c in slow_components(rows, 5, 80, 100) if i == c)
    left = jaccard.keep_one(make(rows))
    assert sorted(r["doc_id"] for r in left.collect()) == want and left.columns == make(rows).columns


def test_rows_that_share_an_id_are_kept_apart(make):
    text = " ".join(f"k{k}" for k in range(60))
    near, alone = text + " more", " ".join(f"z{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, near), (2, alone), (3, near), (None, text), (None, text), (5, None), (5, None), (6, alone + " end"), (1, near)]
    left = jaccard.keep_one(make(rows))
    first = min((1, text), (1, near), key=lambda r: [x["h"] for x in make([r]).selectExpr("xxhash64(doc_id, text) as h").collect()])
    want = [first, (2, alone), (None, text), (None, text), (5, None), (5, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, want)) and left.columns == make(rows).columns


def slow_bytes(rows):
    out, seen = [], {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and seen[b[k : k + 50]] < i:
                cover[k : k + 50] = b"\1" * 50
        left = bytes(c for c, m in zip(b, cover, strict=True) if not m)
        out.append((str(i), len(b), sum(cover), sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 14, 30, 60)]
    rows = [(k, " ".join(rng.choice(shared) if rng.random() < 0.4 else word() for _ in range(rng.randrange(0, 12)))) for k in range(120)]
    return rows + [(k + 200, t) for k, t in rows[:10]] + [(300, "ab" * 400), (301, "ab" * 300 + "c" + "ab" * 200)]


@pytest.mark.parametrize(("rows", "hot", "windows"), [(ODD, 512, 400_000), (passages(1), 512, 400_000), (passages(2), 2, 50)])
def test_bytes_against_brute_force(make, monkeypatch, rows, hot, windows):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "WINDOWS", windows)
    got = suffixes.drop_repeated_bytes(make(rows)).drop("kept").collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == slow_bytes([r[:2] for r in rows])


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order = suffixes.multikey_order(keys)
    rows = [tuple(k[i] for k in keys) for i in order]
    assert rows == sorted(rows)


def test_leaks(spark, make):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    items = [(k, f"{text(20)}.\n{text(6)}") for k in range(30)] + [(90, None), (91, ""), (92, "only three words"), (93, text(200))]
    part = items[2][1].split()
    rows = [(k, text(300)) for k in range(20)] + [(50, f"{text(100)} {items[7][1].upper()} {text(90)}"), (51, items[3][1]), (52, " ".join(part[:12])), (None, items[4][1]), (54, items[93 - 60][1] + " " + text(30)), (55, text(127) + " only three words " + text(5)), (55, text(9)), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.find_leaks(make(rows), bench).collect())
    assert got == [("50", 7), ("51", 3), ("54", 93), ("55", 92), ("None", 4)]
    left = decontam.drop_leaks(make(rows), bench)
    assert left.count() == len(rows) - 5 and left.columns == make(rows).columns
    assert decontam.find_leaks(make(rows), bench.limit(0)).count() == 0


def test_leaks_of_long_items(spark, make):
    rng = random.Random(8)
    text = lambda n, v="v": " ".join(f"{v}{rng.randrange(2000)}" for _ in range(n))
    items = [(1, f"{text(63)}.\nthe the"), (2, text(64) + " the"), (3, f"{text(190, 'q')}.\n{text(30, 'a')}"), (4, text(129))]
    whole = items[2][1].split()
    rows = [(k, f"{text(100)} the {text(100)} the") for k in range(10)] + [(20 + k, f"{text(k)} {i[1]} {text(70)}") for k, i in enumerate(items)]
    rows += [(30, " ".join(whole[:190])), (31, " ".join(whole[190:])), (32, " ".join(whole[-55:])), (33, " ".join(whole[:110]) + " " + text(300) + " " + " ".join(whole[110:])), (34, " ".join(whole[:64]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(make(rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(20, 1), (21, 2), (22, 3), (23, 4), (33, 3)]
    assert {r["answer_overlap"] for r in found} == {1.0} and all(r["question_overlap"] == 1.0 for r in found if r["doc_id"] < 30)
    assert [len(p) for p in decontam.cut([0] * 65)] == [32, 33] and decontam.cut([]) == []


def test_rounds_do_not_change_scores(spark, make, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{min(rng.randrange(90), rng.randrange(90))}" for _ in range(n))
    items = [(k, text(rng.choice([8, 20, 50, 90, 150]))) for k in range(40)] + [(90, None), (91, "")]
    def edited(t):
        return " ".join("other" if rng.random() < 0.03 else w for w in t.split())
    rows = [(k, f"{text(50)} {edited(t)} {text(50)}") for k, t in items[:40]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    look = lambda: sorted((r[0], r[1], *(round(x, 9) for x in tuple(r)[2:])) for r in decontam.find_leaks(make(rows), bench).collect())
    one = look()
    monkeypatch.setattr(decontam, "CHUNK_CHARS", 1500)
    assert len(one) > 10 and look() == one


def test_pruning_loses_no_hit():
    rng = random.Random(5)
    text = lambda n: " ".join(f"v{min(rng.randrange(80), rng.randrange(80))}" for _ in range(n))
    index = decontam.Index([(k, text(rng.randrange(3, 60))) for k in range(40)])
    where, size, part, weight = index.post
    for _ in range(30):
        t = text(120)
        seen = {index.vocabulary[w] for w in decontam.words(t) if w in index.vocabulary}
        score = {}
        for term in seen:
            for k in range(where[term], where[term] + size[term]):
                score[part[k]] = score.get(part[k], 0) + weight[k]
        found = {p: s for _, p, s, *_ in index.search([t])}
        for p, (_, words_, own, q, a) in enumerate(index.parts):
            held = [index.vocabulary.get(w, -1) for w in decontam.words(t)]
            n = min(5, len(words_))
            theirs = {tuple(held[j : j + n]) for j in range(len(held) - n + 1)}
            good = score.get(p, 0) >= decontam.LEAST and len(own & theirs) >= 0.8 * len(own) and all(len(x & {*held}) >= 0.8 * len(x) for x in (q, a) if x)
            assert (p in found) == good and (not good or abs(found[p] - score[p]) < 1e-9)


def test_cells_and_blocks_of_large_regions(make, monkeypatch):
    """Small leaves make regions large: they are measured against pivots, fall into cells, and cells that stay large into blocks."""
    rng = random.Random(11)
    rows = [(1000 * b + i, t) for b in range(3) for i, t in edited(20 + b, 40)[:40]]
    base = rows[0][1].split()
    rows += [(9000 + i, " ".join([*base[: 110 - 4 * i], *(f"c{rng.randrange(9999)}" for _ in range(4 * i))])) for i in range(25)]  # a chain: neighbours are near, ends far apart
    for pivots, stuck in ((4, 0.9), (3, 0.1)):
        for name, value in (("LEAF", 5), ("PIVOTS", pivots), ("STUCK", stuck)):
            monkeypatch.setattr(jaccard, name, value)
        used = []
        for name in ("_cells", "_blocks", "_measured"):
            monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), n=name: (used.append(n), f(*a))[1])
        got = jaccard.near_classes(make(rows), size=4, num=70, den=100).collect()
        assert sorted((str(r["id"]), r["n"], str(r["component"])) for r in got) == slow_components(rows, 4, 70, 100)
        assert {*used} >= {"_cells", "_measured"}


def test_groups_across_boundaries(make, monkeypatch):
    """Every shared anchor is dealt by windows; one window that very many documents have is a splitter several times over, and its group lies in several buckets."""
    common = "the quick brown fox jumps over the lazy dog and never looks back at the hedge"
    rng = random.Random(12)
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    rows = [(k, noise() + common + noise()) for k in range(200, 0, -1)]
    used = []
    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "FLUSH", 1000)  # many portions, so that many records of one string move
    monkeypatch.setattr(suffixes, "_across", lambda found, f=suffixes._across: (used.append(found.where("string is not null").groupBy("string").count().agg({"count": "max"}).first()[0]), f(found))[1])
    got = suffixes.drop_repeated_bytes(make(rows, 8)).drop("kept").collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == slow_bytes(rows)
    assert used and used[0] > 1  # some string is in several buckets


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(0)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw = np.concatenate([raw, raw[:500]])
    begin = np.arange(len(raw) - 50)
    for length in (50, 24):
        order, new = suffixes.suffix_order(raw, begin, length)
        found = [raw.tobytes()[k : k + length] for k in begin[order]]
        assert found == sorted(found) and new.tolist() == [True, *(a != b for a, b in zip(found, found[1:], strict=False))]


def test_enough_parts_are_shared():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (8, 30, 200, 2000):
        x = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for _ in range(20):
            y = np.unique(np.concatenate([rng.permutation(x)[int(size * 0.08) :], rng.integers(0, 2**64, int(size * 0.07), np.uint64)]))
            both, either = jaccard.overlap(x, y)
            if not 85 * either <= 100 * both < 100 * either:
                continue
            (a, need), (b, also) = (jaccard.shared_parts(h, 85, 100) for h in (x, y))
            common = [0, 0]
            for sig in {*a.tolist()} & {*b.tolist()}:
                common[sig & 1] += 1
            assert any(n is not None and m is not None and c >= max(n, m) for n, m, c in zip(need, also, common, strict=True))

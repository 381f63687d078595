import numpy as np
import pytest

from edgeloom.llm import langid, pieces

from .conftest import ODD


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def all_ways(v, s):
    found = []

    def walk(at, score, ids):
        if at == len(s):
            found.append((score, ids))
            return
        for end in range(at + 1, min(len(s), at + v.longest) + 1):
            hit = v.scores.get(s[at:end])
            if hit:
                walk(end, score + hit[0], [*ids, hit[1]])
            elif end == at + 1:
                walk(end, score + v.unknown, ids + v.ids(s[at:end]))

    walk(0, 0.0, [])
    return sorted(found, key=lambda f: -f[0])


@pytest.mark.parametrize("text", ["the cat", "a  bé\nx", "☃ 𝄞 on", "ab▁c", "hello", " ", "in the", "\n\n", "퟿"])
def test_n_best_of_whole_texts(vocabulary, text):
    ids, best = pieces.Encoder(vocabulary).encode([text], 5)[0]
    ways = all_ways(vocabulary, " " + text)
    assert [s for s, _ in best] == [s for s, _ in ways[:5]]
    spelled = [pieces.apply_changes(ids, c).tolist() for _, c in best]
    assert len({*map(tuple, spelled)}) == len(spelled) and all((s, i) in ways for (s, _), i in zip(best, spelled, strict=True))


def test_a_star_agrees_with_the_vectorised_pass(vocabulary, monkeypatch):
    words = [" thonderfully", " Straßenbahn", " xq𝄞zz", "x", " a"]
    one = pieces.Encoder(vocabulary)
    one.learn(words)
    monkeypatch.setattr(pieces, "SHORT", 0)
    two = pieces.Encoder(vocabulary)
    two.learn(words)
    for w in words:
        ways = vocabulary.n_best(w, 2)
        for e in (one, two):
            k = e.known[w]
            assert e.score[k] == ways[0][0] and e.flat[e.at[k] : e.at[k] + e.len[k]].tolist() == ways[0][1]
            assert e.gap[k] == (ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf)


def test_round_trip_of_odd_texts(make, monkeypatch):
    df = make([(i, t) for i, t, *_ in ODD])
    out = pieces.encode(df)
    assert out.where("not exact").count() == 0 and out.count() == len(ODD)
    back = pieces.decode(out).select("doc_id", "text").collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i), t or "") for i, t, *_ in ODD)
    short = {r["doc_id"]: r for r in out.where("doc_id in (1, 2)").collect()}
    assert all(r["pieces"] == [] and len(r["n_best"]) == 1 for r in short.values())
    digest = pieces.encode(df, digest=True).where("doc_id = 0").first()
    assert digest["n_pieces"] == len(out.where("doc_id = 0").first()["pieces"]) and digest["scores"] == sorted(digest["scores"], reverse=True)


def test_vocabulary_rejects_pieces_across_segments():
    with pytest.raises(ValueError):
        pieces.Vocabulary([("a b", -1.0, 0)], range(256))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_texts(make):
    rows = [(k, "der die und das nicht" if k % 2 else "the and of that with", "de" if k % 2 else "en") for k in range(60)] + [(100 + k, r[1], None) for k, r in enumerate(ODD)]
    model = langid.fit(make(rows))
    assert model.classes == ["de", "en"] and model.predict("die und") [0] == "de" and model.predict("THE WITH")[0] == "en"
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(make(rows).withColumnRenamed("doc_id", "k"), model).join(make(rows).selectExpr("doc_id as k", "text"), "k").collect()}
    assert got[""] == got[" \n\t "] == got["9" * 5_000] == ("und", 0.0) and got["x" * 60_000][0] != "und"
    assert langid.predict(make([(1, None)]), model).first()["lang_pred"] == "und"
    empty = langid.fit(make([(1, "abc", None)]))
    assert empty.classes == [] and empty.predict("abc") == ("und", 0.0)


def test_temperature_is_found():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    k = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.temperature(z * 5, k) - 5) < 0.5 and langid.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_long_texts_are_profiled_in_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcé 𝄞 .x"), 3000))
    ids, has = langid.grams(text)
    model = langid.Model(["a", "b"], rng.standard_normal((langid.DIM, 2)).astype(np.float32), np.zeros(2), 1.0)
    whole = model.predict(text)
    for size in (1, 2, 3, 7, 1000, 2999):
        monkeypatch.setattr(langid, "LONG", size)
        found, also = langid.profile(text)
        assert has == also and (found == np.bincount(ids, minlength=langid.DIM)).all()
        assert model.predict(text)[0] == whole[0] and abs(model.predict(text)[1] - whole[1]) < 1e-5


def test_learner_against_plain_updates():
    """FTRL-proximal as its paper has it, one weight at a time."""
    rng = np.random.default_rng(2)
    rows = [(int(k), np.array([int(k), 5 + int(rng.integers(0, 4))]), rng.random(2)) for k in rng.integers(0, 3, 40)]
    w, bias = langid.train(rows, 3, 2)
    z, n, zb, nb = {}, {}, [0.0] * 3, [0.0] * 3

    def weight(z_, n_, l1):
        return 0.0 if abs(z_) <= l1 else -(z_ - np.sign(z_) * l1) / ((langid.BETA + n_**0.5) / langid.ALPHA + langid.L2)

    for _ in range(2):
        for k, at, x in rows:
            have = {(f, c): weight(z.get((f, c), 0.0), n.get((f, c), 0.0), langid.L1) for f in at.tolist() for c in range(3)}
            b = [weight(zb[c], nb[c], 0.0) for c in range(3)]
            s = [sum(v * have[f, c] for f, v in zip(at.tolist(), x.tolist(), strict=True)) + b[c] for c in range(3)]
            e = [np.exp(v - max(s)) for v in s]
            for c in range(3):
                g0 = e[c] / sum(e) - (c == k)
                for f, v in zip(at.tolist(), x.tolist(), strict=True):
                    g, old = v * g0, n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / langid.ALPHA * have[f, c]
                    n[f, c] = old + g * g
                zb[c] += g0 - ((nb[c] + g0 * g0) ** 0.5 - nb[c] ** 0.5) / langid.ALPHA * b[c]
                nb[c] += g0 * g0
    for (f, c), v in z.items():
        assert abs(w[f, c] - weight(v, n[f, c], langid.L1)) < 1e-9
    assert all(abs(bias[c] - weight(zb[c], nb[c], 0.0)) < 1e-9 for c in range(3))

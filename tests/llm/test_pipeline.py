import corpus_pipeline
from edgeloom.llm import decontam, pieces

from .test_joins import slow_components
from .test_text_rules import slow_metrics


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_leaks", "segmentation"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    m = {i: slow_metrics(t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if m[i][0] >= 50 and m[i][4] * 100 <= 50 * m[i][0]}
    seen, left = {}, {}
    for i in sorted(rows):
        ls, gone = rows[i].split("\n"), set()
        for k in range(len(ls) - 2):
            if seen.setdefault(tuple(ls[k : k + 3]), (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        if len(gone) < len(ls):
            left[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    one = {int(i) for i, _, c in slow_components(sorted(left.items()), 5, 80, 100) if i == c}
    left = {i: t for i, t in left.items() if i in one}
    index = decontam.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    left = {i: t for i, t in left.items() if not index.search([t])}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {*out} == {*left}
    v = pieces.Vocabulary.load()
    coder = pieces.Encoder(v)
    for i, t in left.items():
        assert out[i]["exact"] and coder.decode(pieces.np.array(out[i]["pieces"])).decode() == t and out[i]["n_chars"] == len(t)


def test_stages_take_odd_and_empty_documents(spark, make, tmp_path):
    from .conftest import ODD

    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (make(ODD), make(ODD).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, str(tmp_path)).count() <= df.count()


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_what_stages_make_of_odd_documents(spark, make, tmp_path):
    from .conftest import ODD

    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = make(ODD), dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    assert run("quality_rules").count() == 0
    cut = {5: "a\nb\nc", 11: ""}
    got = run("line_dedup")
    assert got.columns == docs.columns and pairs(got) == sorted([(i, cut.get(i, t)) for i, t in ODD], key=repr)
    assert {r["doc_id"]: r["n_chars"] for r in got.collect() if r["doc_id"] in cut} == {5: 5, 11: 0}
    assert pairs(run("near_duplicates")) == sorted([r for r in ODD if r[0] != 4], key=repr)
    assert pairs(run("benchmark_leaks")) == sorted(ODD, key=repr)
    last = run("segmentation").collect()
    assert len(last) == len(ODD) and all(r["exact"] for r in last)


def test_a_failing_host_takes_its_good_documents_along(spark, make):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "too short", "en", "rotten") for k in range(40)] + [(100, good, "en", "rotten")] + [(200 + k, good, "en", f"h{k % 5}") for k in range(60)] + [(400, good, "en", None), (400, good, "en", None)]
    got = corpus_pipeline.quality_rules(spark, make(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(200, 260), 400, 400]

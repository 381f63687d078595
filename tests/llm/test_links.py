from pyspark.sql import functions as F

from edgeloom.llm import revisits, urls
from edgeloom.llm.components import connected_components

RECORDS = "record_id long, target_uri string, captured_at long, record_type string, http_status int, etag string, last_modified string, headers array<struct<name:string,value:string>>, block string"


def rec(i, uri, at, kind="response", status=200, etag=None, day=None, headers=()):
    return (i, uri, at, kind, status, etag, day, list(headers), "clash")


def test_revisits(spark, monkeypatch):
    rows = [
        rec(1, "http://www.x.org/a?b=2&a=1", 10, etag='"1"', headers=[("Content-Type", "t"), ("Age", "0")]), rec(2, "https://X.org:443/a/?a=1&b=2#f", 20, "revisit", 304, 'W/"1"', headers=[("content-type", "no"), ("age", "5"), ("Date", "d")]),
        rec(3, "http://x.org/a?a=1&b=2", 20, etag='"2"'), rec(4, "http://x.org/a?a=1&b=2&utm_x=3", 21, "revisit", 304, '"1"'), rec(5, "http://x.org/a?a=1&b=2", 25, status=404), rec(6, "http://x.org/a?a=1&b=2", 30, "revisit", 304, None, "tuesday"),
        rec(7, "http://y.org/", 5, "revisit", 304), rec(8, None, 9, "revisit", 304), rec(9, "http://x.org/a?a=1&b=2", None, "revisit", 304), rec(10, "http://z.org", 1, day="monday"), rec(11, "http://z.org", 1, day="tuesday"), rec(12, "http://z.org/", 2, "revisit", 304, "e", "tuesday"), rec(12, "http://z.org/", 2, "revisit", 304, "e", "tuesday"),
    ]
    for blocks in (64, 2):
        monkeypatch.setattr(revisits, "TIME_BLOCKS", blocks)
        got = sorted((r["record_id"], r["status"], r["refers_to"]) for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect())
        assert got == [(2, "validated", 1), (4, "mismatch", 3), (6, "unverified", 3), (7, "missing", None), (8, "missing", None), (9, "missing", None), (12, "validated", 11), (12, "validated", 11)]
    merged = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).where("record_id = 2").first()["headers"]
    assert [tuple(h) for h in merged] == [("age", "5"), ("content-type", "t"), ("date", "d")]


def test_a_hot_url_agrees_with_brute_force(spark):
    rows = [rec(k, "http://h.org/", (k * 37) % 500, "revisit" if k % 3 else "response", 304 if k % 3 else 200, str(k % 4)) for k in range(600)]
    full = [r for r in rows if r[3] == "response"]
    want = {r[0]: max(((f[2], f[0]) for f in full if f[2] < r[2]), default=(0, None))[1] for r in rows if r[3] == "revisit"}
    assert {r["record_id"]: r["refers_to"] for r in revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()} == want


def test_verdicts_and_aliases(spark):
    link = '<html><link rel="canonical" href="{}"></html>'.format
    pages = [
        (1, "http://a.example.com/en/1", ""), (2, "http://www.example.com/en/1", None), (3, "https://www.example.com/fr", ""), (4, "http://x.net/es/9", ""), (5, None, None), (6, "no url", ""), (7, "HTTP://Xcom/", ""),
        (8, "http://blog.org/p", link("http://x.net/fr/2")), (9, "https://www.blog.org/p/?utm_source=f#top", ""), (10, "http://other.org/q", '<meta http-equiv="refresh" content="0;url=/r">'), (11, "http://other.org/r", link("http://blog.org/p")),
        (12, "http://safe.org/", link("http://ok.com/")), (13, "http://safe.org/index.html?ref=z", link("http://x.net/es/1")), (14, "http://lonely.org", "canonical"), (14, "http://lonely.org", "canonical"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, rule string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_pages(df).collect()}
    assert out[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and out[2][2:] == ("www.example.com/en/", "allow") and out[3][2:] == ("com/", "allow") and out[4][2:] == ("net/es/", "block")
    assert out[5] == out[6] == ("", "", None, "allow") and out[7] == ("xcom", "/", None, "allow")
    assert [out[k][3] for k in (8, 9, 10, 11)] == ["block"] * 4  # by links, a refresh and conventional redirects
    assert [out[k][3] for k in (12, 13, 14)] == ["allow"] * 3  # an explicitly allowed member wins
    moved = spark.createDataFrame([("http://lonely.org/", "http://q.net/es/"), (None, None)], "from_url string, to_url string")
    assert {r["verdict"] for r in urls.judge_pages(df, moved).where("page_id = 14").collect()} == {"block"}


def test_links_however_written(spark):
    far = ' data-x="' + "y" * 1000 + '"'
    pages = [
        ('<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://x.net/es/1">', ["http://x.net/es/1"]), ('<LINK REL="CANONICAL" HREF="http://x.net/es/2">', ["http://x.net/es/2"]),
        (f'<link{far} rel="canonical"{far} href="http://x.net/es/3"{far}>', ["http://x.net/es/3"]), (f"<link href='/p'{far} rel='nofollow canonical'>", ["http://h.org/p"]), (f'<meta{far} content="5;url=q"{far} http-equiv=refresh>', ["http://h.org/a/q"]),
        ('<link rel="canonical" href="b.html">', ["http://h.org/a/b.html"]), ('<link rel=canonical href="../up/./c?d=../e">', ["http://h.org/up/c?d=../e"]), ('<link rel=canonical href="//x.net/es/4">', ["http://x.net/es/4"]), ('<link rel=canonical href="?z=1">', ["http://h.org/a/i?z=1"]),
        ("""<meta http-equiv="refresh" content="0;url='http://x.net/es/5'">""", ["http://x.net/es/5"]), ("""<meta http-equiv='refresh' content='0; url="r"'>""", ["http://h.org/a/r"]), ('<meta http-equiv="refresh" content="3; http://x.net/es/6">', ["http://x.net/es/6"]),
        ('<base href="/root/"><link rel="canonical" href="f">', ["http://h.org/root/f"]), ('<link rel="canonical" href="u1"><link rel="canonical" href="u2">', ["http://h.org/a/u1", "http://h.org/a/u2"]), ('<link rel="canonical" href="login?to=http://x.net/es/">', ["http://h.org/a/login?to=http://x.net/es/"]),
        ('<meta http-equiv="refresh" content="30"><meta http-equiv="refresh" content="0;url="><link rel="canonical" href="#top"><link rel="canonical" href="mailto:a@b.c"><link rel="stylesheet" href="canonical.css"><link rel=canonical>', []), (None, []), ("", []),
    ]
    df = spark.createDataFrame([(k, "http://h.org/a/i?j=1#k", h) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    found = {r["page_id"]: r["to"] for r in df.select("page_id", urls.link_targets("html", "url").alias("to")).collect()}
    assert found == {k: to for k, (_, to) in enumerate(pages)}
    assert {r["page_id"] for r in urls.judge_pages(df.withColumn("url", F.concat(F.lit("http://n"), "page_id", F.lit(".org/")))).where("verdict = 'block'").collect()} == {0, 1, 2, 7, 9, 11}
    bare = spark.createDataFrame([("http://h.org", '<link rel="canonical" href="x">'), (None, '<link rel="canonical" href="x">'), ("no url", '<link rel="canonical" href="/x">')], "url string, html string")
    assert [r[0] for r in bare.select(urls.link_targets("html", "url")).collect()] == [["http://h.org/x"], [], []]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (100, 101)] + [(500, k) for k in range(501, 600)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, **{k: 500 for k in range(500, 600)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains_in_any_order(spark):
    import random

    shuffled = random.Random(6).sample(range(1000, 1400), 400)
    backward = [2000, *range(2399, 2000, -1)]
    edges = [e for path in (shuffled, backward) for e in zip(path, path[1:], strict=False)] + [(3000 + k // 3, 3000 + k) for k in range(1, 300)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(shuffled, 1000), **dict.fromkeys(backward, 2000), **dict.fromkeys(range(3000, 3300), 3000)}
    words = [(f"n{a}", f"n{b}") for a, b in edges[:399]]
    assert {r["component"] for r in connected_components(spark.createDataFrame(words, "a string, b string")).collect()} == {"n1000"}

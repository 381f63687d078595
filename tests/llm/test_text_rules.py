import hashlib
import re

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import lines, pii, quality

from .conftest import ODD


def slow_metrics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = {x: 0 for x in triples}
    for x in triples:
        count[x] += 1
    covered = {k + j for k, x in enumerate(triples) if count[x] > 1 for j in range(3)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered)


def test_rules_of_odd_texts(odd):
    got = quality.rule_metrics(odd).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r)[1:] == slow_metrics(r["text"])


def test_hosts_are_shrunk_and_join_back(spark, make):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, bad, "en", "rotten") for k in range(40)] + [(100, good, "en", "rotten")] + [(200 + k, good, "en", f"h{k % 5}") for k in range(60)] + [(300, bad, "en", "tiny"), (400, good, "en", None), (401, bad, "en", None)]
    out = {r["doc_id"]: r for r in quality.judge(make(rows)).collect()}
    assert not out[100]["kept"] and out[100]["host_rejected"] and not out[100]["base_failed"]
    assert all(out[200 + k]["kept"] for k in range(60)) and out[400]["kept"] and not out[401]["kept"]
    assert 0 < out[300]["host_rate"] < 1
    left = quality.keep_good(make(rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, r in out.items() if r["kept"]) and left.columns == make(rows).columns
    assert quality.keep_good(make(rows).limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    t, out = text or "", []
    for no, kind in enumerate(pii.BASE):
        pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end()))
    return sorted(out)


PRIVATE = [
    "write a.b+c@x-y.co.uk, d@e.f_g@h.i or 🙂é@b.c", "1.2.3.4.5.6.7.8 and 256.1.1.1, 10.0.0.255 0001.2.3.04", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 378282246310005", "+44 20 7946 0958 and +1 (555) 010-9999x +1", "@@@ a@b a@b.c.d@e.f",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "+" + "1" * 40, "4" * 16 + " 4242424242424242", "the of é 𝄞 79927398713000000 0.0.0.0", "a" * 30_000 + "@b.c", "1." * 9_000, "x@y.z " * 1_000,
]


def test_base_spans_against_plain_patterns(make):
    df = pii.find_spans(make([*PRIVATE, *(r[1] for r in ODD)]))
    for r in df.select("text", "spans").collect():
        assert [(s["start"], s["no"], s["end"]) for s in r["spans"] if s["no"] < 4] == slow_spans(r["text"])


def test_checksums_and_context(make):
    texts = ["account GB82 WEST 1234 5698 7654 32 here", "code GB82WEST12345698765433", "see 10.1.1.1", "server address 10.1.1.1"]
    got = {r["text"]: r["spans"] for r in pii.find_spans(make(texts)).select("text", "spans").collect()}
    assert [s["kind"] for s in got[texts[0]]] == ["iban"] and got[texts[1]] == []
    assert got[texts[3]][0]["score"] > got[texts[2]][0]["score"]
    assert pii.redact(make([texts[3]])).first()["text"] == "server address <ip>"


@pytest.mark.parametrize("rows", [ODD, [(k, f"a{k}\nx\ny\nz\nx\ny\nz") for k in range(40)]])
def test_repeated_lines_against_brute_force(make, rows):
    seen, gone = {}, {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key):
        ls = t.split("\n")
        cut = gone.setdefault((i, t), set())
        for k in range(len(ls) - 2):
            if seen.setdefault(tuple(ls[k : k + 3]), (i, t, k)) != (i, t, k):
                cut |= {k, k + 1, k + 2}
    got = lines.drop_repeated_lines(make(rows)).withColumn("was", F.lit(1)).collect()
    want = sorted(("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) if t is not None else None for i, t in ((r[0], r[1]) for r in rows)), key=str)
    assert sorted((r["text"] for r in got), key=str) == want
    assert sum(r["_n_removed"] for r in got) == sum(len(gone[r[0], r[1]]) for r in rows if r[1] is not None)


def test_line_digest_of_one_row(make):
    r = lines.digest(make([(3, "a\nb\nc\nd\na\nb\nc")])).first()
    assert tuple(r) == (3, 7, 3, hashlib.sha256(b"a\nb\nc\nd").hexdigest())


def slow_added(text):
    """The added kinds by plain Python: (kind, start, end, score)."""
    digits = lambda m: [int(c) for c in m if c.isdigit()]
    number = lambda m: "".join(c if c.isdigit() else str(ord(c) - 55) for c in (m.replace(" ", "")[4:] + m.replace(" ", "")[:4]))
    ok = {
        "iban": lambda m: 15 <= len(m.replace(" ", "")) <= 34 and int(number(m)) % 97 == 1,
        "dni": lambda m: "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[:8]) % 23] == m[-1],
        "ssn": lambda m: not (m[:3] in ("000", "666") or m[0] == "9" or m[4:6] == "00" or m[-4:] == "0000"),
        "nhs": lambda m: sum(d * (10 - k) for k, d in enumerate(digits(m))) % 11 == 0,
        "aba": lambda m: sum(d * (3, 7, 1)[k % 3] for k, d in enumerate(digits(m))) % 10 == 0,
    }
    out = []
    for kind in pii.PATTERNS:
        if kind in ok:
            for m in re.finditer(pii.PATTERNS[kind], text):
                around = (text[max(0, m.start() - pii.REACH) : m.start()] + " " + text[m.end() : m.end() + pii.REACH]).lower()
                score = pii.SCORE[kind] + (pii.NEAR if re.search(rf"(?<![a-z0-9])({pii.CONTEXT[kind]})(?![a-z0-9])", around) else 0)
                if ok[kind](m[0]) and score >= pii.LEAST:
                    out.append((kind, m.start(), m.end(), round(score, 3)))
    return sorted(out)


def test_added_kinds_against_plain_patterns(make):
    texts = [
        "routing 021000021 and 021000022", "number 021000021", "NHS 943 476 5919, patient 9434765918", "943 476 5919", "dni 12345678Z 12345678A 00000000-T", "my ssn: 219-09-9999 or 000-12-3456", "code 219-09-9999",
        "hotel shipping discard 219-09-9999 antisocial", "iban GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "x" * 5000 + " bank 121000358 " + "y" * 5000,
    ]
    got = {r["text"]: sorted((s["kind"], s["start"], s["end"], round(s["score"], 3)) for s in r["spans"] if s["no"] > 3) for r in pii.find_spans(make(texts)).select("text", "spans").collect()}
    assert got == {t: slow_added(t) for t in texts}
    assert [len(got[t]) for t in texts] == [1, 0, 1, 0, 2, 1, 0, 0, 2, 1]  # context words decide about rows


def test_context_words_are_whole(make):
    texts = ["shipping 10.1.1.1", "ip 10.1.1.1", "hotel +44 20 7946 0958", "tel +44 20 7946 0958"]
    got = {r["text"]: r["spans"][0]["score"] for r in pii.find_spans(make(texts)).select("text", "spans").collect()}
    assert [round(got[t], 1) for t in texts] == [0.6, 0.8, 0.6, 0.8]

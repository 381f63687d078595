"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds. A run of characters that begins a match is entered at its first character only, or where
#: the last match ended (\G), and repeats are possessive, so that a long run is read once and no group recurses;
#: neither changes what the plain pattern matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "dni": r"(?<![A-Za-z0-9.-])[0-9]{8}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "nhs": r"(?<![A-Za-z0-9.+-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![A-Za-z0-9-])",
    "aba": r"(?<![A-Za-z0-9.+-])[0-9]{9}(?![A-Za-z0-9-])",
}
#: A cheap test that a text without a match usually fails.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?+){13}[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
    "dni": r"[0-9]{8}-?[A-Z]",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "nhs": r"[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}",
    "aba": r"[0-9]{9}",
}
BASE = ("email", "ip", "card", "phone")
#: Whole words that make a kind more likely when they stand near a span (fixed values).
CONTEXT = {
    "email": "e-?mail|mail|mailto|contact|write|reply",
    "ip": "ip|ipv4|address|host|server",
    "card": "card|visa|mastercard|credit|debit|payment|tarjeta|carte|karte",
    "phone": "phone|tel|telephone|telefon|teléfono|call|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "dni": "dni|nif|documento|identidad",
    "ssn": "ssn|social|security",
    "nhs": "nhs|patient|health",
    "aba": "aba|routing|bank|transfer|wire",
}
#: Score of a confirmed span, what a context word within REACH characters adds, and the least score for added kinds: a number whose checksum one in ten or so passes by chance stays with a context word only.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "dni": 0.6, "ssn": 0.3, "nhs": 0.4, "aba": 0.4}
NEAR, REACH, LEAST = 0.2, 40, 0.5


def _valid(kind: str, m: str) -> str:
    """SQL that confirms match m; each branch bounds a match's length before it walks along it."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) < 3 or (length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255'))"
    if kind == "card":
        luhn = f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + case when i % 2 = 1 then cast(substr(reverse({digits}), i, 1) as int) else case when cast(substr(reverse({digits}), i, 1) as int) > 4 then 2 * cast(substr(reverse({digits}), i, 1) as int) - 9 else 2 * cast(substr(reverse({digits}), i, 1) as int) end end) % 10 = 0"
        return f"case when length({digits}) between 14 and 19 then {luhn} else false end"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "iban":
        code = f"replace({m}, ' ', '')"
        turned = f"concat(substr({code}, 5), substr({code}, 1, 4))"
        return f"case when length({code}) between 15 and 34 then aggregate(sequence(1, length({turned})), 0, (r, i) -> case when ascii(substr({turned}, i, 1)) >= 65 then (r * 100 + ascii(substr({turned}, i, 1)) - 55) % 97 else (r * 10 + ascii(substr({turned}, i, 1)) - 48) % 97 end) = 1 else false end"
    if kind == "dni":  # the letter is the number modulo 23
        return f"substr('TRWAGMYFPDXBNJZSQVHLCKE', cast({digits} as int) % 23 + 1, 1) = right({m}, 1)"
    if kind == "ssn":  # numbers that are never given out
        return f"not (substr({m}, 1, 3) in ('000', '666') or substr({m}, 1, 1) = '9' or substr({m}, 5, 2) = '00' or right({m}, 4) = '0000')"
    if kind in ("nhs", "aba"):  # weighted sums modulo 11 and 10
        weight, base = ("11 - i", 11) if kind == "nhs" else ("element_at(array(3, 7, 1), (i - 1) % 3 + 1)", 10)
        return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + ({weight}) * cast(substr({digits}, i, 1) as int)) % {base} = 0"
    return "true"


#: Match ends are summed up in blocks, so that a text with very many matches doesn't cost their square.
BLOCK = 256


def find_spans(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """docs plus spans: array of (start, no, end, kind, score), by start and then kind; places are code points, end exclusive.

    Matches are leftmost and don't overlap within a kind; those of different kinds may. A match that its validator
    rejects is dropped and not tried again. Base kinds stay whatever their score; added ones need LEAST. Null text has
    no spans. Everything stays in the row: no shuffle, and an input column named spans is replaced.
    """
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for no, kind in enumerate(kinds):
        pattern, hint = PATTERNS[kind].replace("\\", "\\\\"), HINTS[kind].replace("\\", "\\\\")
        none = "cast(array() as array<{}>)".format
        df = df.withColumn("_m", F.expr(f"case when _t rlike '{hint}' then regexp_extract_all(_t, '{pattern}', 0) else {none('string')} end"))
        # a match ends after the gaps up to it and the matches before it
        df = df.withColumn("_n", F.expr(f"case when size(_m) > 0 then zip_with(slice(split(_t, '{pattern}', -1), 1, size(_m)), _m, (g, m) -> length(g) + length(m)) else {none('int')} end"))
        df = df.withColumn("_blocks", F.expr(f"case when size(_m) > 0 then transform(sequence(0, (size(_n) - 1) div {BLOCK}), b -> aggregate(slice(_n, cast(b * {BLOCK} + 1 as int), {BLOCK}), {none('int')}, (acc, x) -> concat(acc, array(coalesce(try_element_at(acc, -1), 0) + x)))) else {none('array<int>')} end"))
        df = df.withColumn("_from", F.expr("aggregate(_blocks, array(0), (acc, r) -> concat(acc, array(element_at(acc, -1) + element_at(r, -1))))"))
        df = df.withColumn("_ends", F.expr("flatten(transform(_blocks, (r, b) -> transform(r, e -> e + _from[b])))"))
        df = df.withColumn("_found", F.expr(f"filter(zip_with(_ends, _m, (e, m) -> struct(e - length(m) as a, e as z, m as m)), x -> {_valid(kind, 'x.m')})"))
        near = f"lower(concat(substr(_t, greatest(x.a - {REACH}, 0) + 1, least(x.a, {REACH})), ' ', substr(_t, x.z + 1, {REACH}))) rlike '(?<![a-z0-9])({CONTEXT[kind]})(?![a-z0-9])'"
        spans = f"transform(_found, x -> struct(x.a as start, {no} as no, x.z as end, '{kind}' as kind, cast({SCORE[kind]} as double) + case when {near} then {NEAR} else 0.0D end as score))"
        df = df.withColumn(f"_s{no}", F.expr(spans if kind in BASE else f"filter({spans}, s -> s.score >= {LEAST})"))
        df = df.drop("_m", "_n", "_blocks", "_from", "_ends", "_found")
    lists = [f"_s{no}" for no in range(len(kinds))]
    return df.withColumn("spans", F.sort_array(F.concat(*lists))).drop("_t", *lists)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in angle brackets; of overlapping spans the first wins."""
    df = find_spans(docs.withColumn("_plain", F.coalesce(F.col(text), F.lit(""))), text)
    walk = "aggregate(spans, struct('' as done, 0 as at), (acc, s) -> case when s.start >= acc.at then struct(concat(acc.done, substr(_plain, acc.at + 1, s.start - acc.at), '<', s.kind, '>') as done, s.end as at) else acc end, acc -> concat(acc.done, substr(_plain, acc.at + 1)))"
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.expr(walk))).drop("spans", "_plain")


def span_digest(spans: str) -> str:
    """SQL for the text kind:start:end of each span, joined by commas."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the op6 contract."""
    df = find_spans(docs.select("doc_id", "text"))
    base = f"filter(spans, s -> s.no < {len(BASE)})"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.no = {no})) as bigint)").alias(f"n_{kind}") for no, kind in enumerate(BASE)]
    scores = "array_join(transform(spans, s -> format_string('%.1f', s.score)), ',')"
    return df.select("doc_id", *counts, F.sha2(F.expr(span_digest(base)), 256).alias("base_sha256"), F.expr(span_digest("spans")).alias("spans"), F.expr(scores).alias("scores"))

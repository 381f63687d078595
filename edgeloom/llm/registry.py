"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lines, pieces, pii, quality, revisits, suffixes, urls
from .common import table


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digest(table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_classes(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op9_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op10_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_revisits, op2_language, op3_url_filter, op4_host_quality, op5_benchmark_leaks, op6_personal_data, op7_jaccard_join, op8_line_dedup, op9_byte_dedup, op10_n_best_pieces)}

SQL: dict[str, str] = {}

#: Words and rules of op4 as DuckDB has them; host failure rates with the same prior.
SQL["op4_host_quality"] = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
rep as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from win),
cov as (select doc_id, count(distinct i + o) as n from rep, (values (0), (1), (2)) v(o) where c > 1 group by doc_id),
m as (
  select w.doc_id, w.source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from w left join cov using (doc_id)),
j as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
h as (select source as host, cast(count(*) as double) as n, cast(sum(base_failed::int) as double) as f from j where source is not null group by 1),
p as (select count(*) as hosts, sum(f) / sum(n) as mean, coalesce(var_samp(f / n), 0) as v, avg(1.0 / n) as noise from h),
q as (select hosts, mean, greatest(0, v - mean * (1 - mean) * noise) as between_v from p),
s as (select mean, greatest(2, case when between_v > 0 then mean * (1 - mean) / between_v - 1 when hosts > 1 and mean > 0 and mean < 1 then 1e6 else 2 end) as k from q),
r as (select host, (f + mean * k) / (n + k) > 0.8 as rejected from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not coalesce(rejected, false)) as kept from j left join r on source = host
"""

SQL["op8_line_dedup"] = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
win as (select doc_id, unnest(range(1, len(ls) - 1)) as i, ls from d where len(ls) >= 3),
k as (select doc_id, i, ls[i] as a, ls[i + 1] as b, ls[i + 2] as c from win),
o as (select doc_id, i, row_number() over (partition by a, b, c order by doc_id, i) as n from k),
gone as (select distinct doc_id, i + j as line from o, (values (0), (1), (2)) v(j) where n > 1),
g as (select doc_id, list(line) as ix from gone group by doc_id),
e as (select d.doc_id, text, ls, coalesce(ix, []) as ix from d left join g using (doc_id))
select doc_id, cast(case when text is null then 0 else len(ls) end as bigint) as n_lines, cast(len(ix) as bigint) as n_removed,
  sha256(case when len(ix) = 0 then coalesce(text, '') else coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(ix, i)), lambda i: ls[i]), chr(10)), '') end) as kept_sha256 from e
"""

SQL["op1_revisits"] = r"""
with p as (select page_id, url, coalesce(html, '') as h from pages),
c as (
  select page_id, url, h, md5(h) as tag, 'day ' || (page_id % 28) as day, regexp_replace(url, '#.*$', '') as u from p),
k as (
  select *, 'http://' || regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^:/?#]*://([^/?]*)', 1)), '^www\d*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(u, '^[^:/?#]*://[^/?]*([^?]*)', 1), '/+$', '') as site,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '(?i)^(jsessionid|phpsessid|sid|utm_[a-z]+|fbclid|gclid)(=|$)'))) as qs from c),
r as (select page_id, tag, day, length(h) as n, site || case when len(qs) > 0 then '?' || array_to_string(qs, '&') else '' end as canonical_url, url from k),
w as (select *, page_id * 10 + 5 + 10 * (page_id * 7919 % 997) as seen from r),
a as (
  select w.page_id, w.canonical_url, w.seen, w.tag, w.day, max_by(x.page_id, x.page_id) as ref from w left join r x on x.canonical_url = w.canonical_url and x.page_id * 10 < w.seen group by all),
j as (
  select a.*, x.tag as rtag, x.day as rday, x.n as rn, case when a.ref is null then 'missing' when a.page_id % 3 <> 0 then case when a.tag = x.tag then 'validated' else 'mismatch' end
    when a.page_id % 2 <> 0 then case when a.day = x.day then 'validated' else 'mismatch' end else 'unverified' end as status from a left join r x on x.page_id = a.ref)
select page_id * 2 + 1 as record_id, page_id, canonical_url, status, ref * 2 as refers_to,
  case when status in ('validated', 'unverified') then 'cache-control=max-age=600;content-length=' || rn || ';content-type=text/html;date=' || seen || ';etag=' || rtag end as headers from j
"""

SQL["op3_url_filter"] = r"""
with p as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(verdict, rule) as (values ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
m as (
  select h.page_id, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as rule_verdict
  from h join rules on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/'))) group by h.page_id),
k as (
  select h.*, rule, rule_verdict,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*?://', ''), '#.*$', ''), '([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '(/index)?\.html?($|\?)', '\2'), '/+($|\?)', '\1') as u
  from h left join m using (page_id)),
a as (select *, case when contains(url, '://') then regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^(www|m)\.', '') || regexp_replace(u, '^[^/?]*', '') end as alias_of from k),
b as (select alias_of from a group by alias_of having bool_or(rule_verdict = 'block') and not coalesce(bool_or(rule_verdict = 'allow'), false))
select page_id, host, path, rule, coalesce(rule_verdict, case when alias_of in (select alias_of from b where alias_of is not null) then 'block' else 'allow' end) as verdict, alias_of from a
"""

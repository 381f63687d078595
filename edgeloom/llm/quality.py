"""Quality rules: per-document rules, and host verdicts from failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_staged, keep_where, staged

#: Characters that count as symbols, and white space as the word pattern has it (fixed values).
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.8
#: Prior strength used when the hosts' rates don't vary enough to estimate one, in documents.
WEAK_PRIOR = 2.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def rule_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus the columns METRICS (same-named input columns are replaced).

    A null text has no words. All work stays inside the row: no shuffle, and a long text costs its own sort only.
    Three-word windows are compared by 64-bit fingerprints within one text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    df = df.withColumn("_windows", F.expr("case when size(_words) >= 3 then transform(sequence(1, size(_words) - 2), i -> xxhash64(_words[i - 1], _words[i], _words[i + 1])) else cast(array() as array<bigint>) end"))
    # only texts that repeat a window pay for the sort of (window, place)
    df = df.withColumn("_sorted", F.expr("case when size(_windows) > size(array_distinct(_windows)) then sort_array(transform(_windows, (h, i) -> struct(h, i))) else cast(array() as array<struct<h: bigint, i: int>>) end"))
    df = df.withColumn("_starts", F.expr("sort_array(transform(filter(_sorted, (e, k) -> (k > 0 and _sorted[k - 1].h = e.h) or (k < size(_sorted) - 1 and _sorted[k + 1].h = e.h)), e -> e.i))"))
    repeat = F.expr("aggregate(zip_with(_starts, slice(_starts, 2, greatest(size(_starts), 1)), (p, q) -> least(3, coalesce(q - p, 3))), 0L, (n, x) -> n + x)")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("long"))
    df = (
        df.withColumn("word_chars", F.length(F.translate(t, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeat)
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    )
    return df.drop("_words", "_windows", "_sorted", "_starts", "_lines")


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected), one row a host; rows without a host are left out.

    Rates get a beta prior whose mean and strength come from all hosts by the method of moments, so a host with few
    documents stays near the corpus rate. Counts are combined before the shuffle: a host with a third of all rows
    costs one row a task. The staged result is as small as the hosts are few, and its size decides how it is joined.
    """
    hosts = staged(judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    n, mean, var, noise = hosts.agg(F.count(F.lit(1)), F.sum("n_failed") / F.greatest(F.sum("n_docs"), F.lit(1)), F.var_samp(rate), F.avg(F.lit(1.0) / F.col("n_docs"))).first()
    mean, between = mean or 0.0, max(0.0, (var or 0.0) - (mean or 0.0) * (1 - (mean or 0.0)) * (noise or 0.0))
    strength = mean * (1 - mean) / between - 1 if between > 0 else None
    strength = max(WEAK_PRIOR, strength) if strength is not None else max(WEAK_PRIOR, 1e6 if n > 1 and 0 < mean < 1 else WEAK_PRIOR)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its columns but the text, the METRICS, and kept. A document without a host has its own verdict only."""
    rules = staged(rule_metrics(docs, text).drop(text))
    hosts = host_verdicts(rules, host, max_rate=max_rate).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    out = rules.join(hosts, rules[host] == hosts["_host"], "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that judge() keeps, all columns unchanged. The rules run twice so that no text is shuffled."""
    rules = staged(rule_metrics(docs.select(host, text), text).select(host, "base_failed"))
    bad = staged(host_verdicts(rules, host).where("host_rejected").select(F.col("host").alias("_host")))
    drop_staged(rules)
    clash = {*METRICS, "_words", "_windows", "_sorted", "_starts", "_lines", "_host"} & {*docs.columns}
    if clash:
        ok = keep_where(rule_metrics(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text)), text), ~F.col("base_failed")).select("_row.*")
    else:
        ok = keep_where(rule_metrics(docs, text), ~F.col("base_failed")).select(*docs.columns)
    return ok.join(bad, ok[host] == bad["_host"], "left_anti")

"""Not-modified revisits in web archives: each is resolved to the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that don't replace those stored with the response (fixed values).
FORBIDDEN = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Session and tracking parameters that a canonical URL leaves out (fixed values).
SESSION = "jsessionid|phpsessid|sid|utm_[a-z]+|fbclid|gclid"
#: Time is cut at this many quantiles, so that a URL with very many captures is spread over as many groups.
TIME_BLOCKS = 64

HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: str) -> Column:
    """Scheme and host in lower case, http for https, no www., default port, fragment, session parameters or final slash, parameters sorted; null where there is no '://'."""
    u = F.regexp_replace(F.col(url), r"#.*$", "")
    site = F.lower(F.regexp_extract(u, r"^[^:/?#]*://([^/?]*)", 1))
    site = F.regexp_replace(F.regexp_replace(site, r"^www\d*\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(rf"(?i)^(?:{SESSION})(?:=|$)")))
    return F.when(F.col(url).rlike(r"^[^:/?#]+://"), F.concat(F.lit("http://"), site, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured_at, status, refers_to, headers.

    records: record_id, target_uri, captured_at (long), record_type ('response' or 'revisit'), http_status, etag,
    last_modified, headers (array of (name, value)); other columns are ignored. A full response has type 'response'
    and status 200. status is 'validated' (the entity tags agree, weak marks aside, or, where either lacks one, the
    dates), 'mismatch' (they don't), 'unverified' (no validator on both sides) or 'missing' (no earlier response; also
    for a null URL or time). Of responses at one time the greatest record_id counts, and a response at the revisit's
    own time isn't earlier. headers holds the merged headers by name: the stored ones, replaced by those of the
    revisit that are permitted; null if mismatch or missing.

    Rows of one URL are split by quantiles of time, and each block starts with the last response before it, so no
    group grows with a hot URL and one shuffle suffices. Payloads never move.
    """
    r = records.select(
        "record_id", canonical_url("target_uri").alias("canonical_url"), F.col("captured_at").cast("long").alias("captured_at"), "record_type",
        F.regexp_replace(F.col("etag"), r"^W/", "").alias("etag"), "last_modified", F.col("http_status").cast("int").alias("http_status"),
        F.coalesce(F.transform("headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))), F.expr(f"cast(array() as {HEADERS})")).alias("headers"),
    )
    cuts = records.agg(F.percentile_approx(F.col("captured_at").cast("long"), [k / TIME_BLOCKS for k in range(1, TIME_BLOCKS)], 1000)).first()[0]
    cuts = sorted({*(cuts or ())})
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("captured_at"))) if cuts else F.lit(0)
    placed = r.where("canonical_url is not null and captured_at is not null").withColumn("block", block)
    full = (F.col("record_type") == "response") & (F.col("http_status") == 200)
    response = F.struct("captured_at", "record_id", "etag", "last_modified", "headers")
    placed = placed.withColumn("response", F.when(full, response))
    # for every block of a URL with rows, the last response of the blocks before it
    ends = placed.groupBy("canonical_url", "block").agg(F.max("response").alias("response"))
    carried = ends.withColumn("response", F.max("response").over(Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).where("response is not null")
    rows = placed.where((F.col("record_type") == "revisit") | F.col("response").isNotNull()).unionByName(carried.withColumn("captured_at", F.col("response.captured_at")), allowMissingColumns=True)
    before = Window.partitionBy("canonical_url", "block").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("ref", F.max("response").over(before)).where("record_type = 'revisit'").drop("block", "response")
    lost = r.where("record_type = 'revisit' and (canonical_url is null or captured_at is null)")
    found = found.unionByName(lost, allowMissingColumns=True)
    agree = F.when(F.col("etag").isNotNull() & F.col("ref.etag").isNotNull(), F.col("etag") == F.regexp_replace("ref.etag", r"^W/", "")).when(F.col("last_modified").isNotNull() & F.col("ref.last_modified").isNotNull(), F.col("last_modified") == F.col("ref.last_modified"))
    status = F.when(F.col("ref").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "validated").otherwise("mismatch")
    found = found.withColumn("status", status).withColumn("_new", F.filter("headers", lambda h: ~h["name"].isin(*FORBIDDEN)))
    merged = F.sort_array(F.concat(F.expr("filter(ref.headers, h -> not exists(_new, x -> x.name = h.name))"), F.col("_new")))
    return found.select("record_id", "canonical_url", "captured_at", "status", F.col("ref.record_id").alias("refers_to"), F.when(F.col("status").isin("validated", "unverified"), merged).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of every page, for tables that hold pages but no archive: a full response, and a later revisit under a variant of its URL.

    Nothing of a page decides whether it takes part; page_id sets the times and which validators a record carries.
    """
    tag, day = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.col("url").alias("target_uri"), (F.col("page_id") * 10).alias("captured_at"), F.lit("response").alias("record_type"), F.lit(200).alias("http_status"),
        tag.alias("etag"), day.alias("last_modified"),
        F.array(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.length(F.coalesce("html", F.lit("")))), pair("Cache-Control", F.lit("max-age=60")), pair("ETag", tag)).alias("headers"),
    )
    later = F.col("page_id") * 10 + 5 + 10 * (F.col("page_id") * 7919 % 997)
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again")).alias("target_uri"), later.alias("captured_at"), F.lit("revisit").alias("record_type"), F.lit(304).alias("http_status"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("W/"), tag)).alias("etag"), F.when(F.col("page_id") % 2 != 0, day).alias("last_modified"),
        F.array(pair("Content-Length", F.lit("0")), pair("Cache-Control", F.lit("max-age=600")), pair("Date", later)).alias("headers"),
    )
    return response.unionByName(revisit)


def digest(pages: DataFrame) -> DataFrame:
    out = resolve_revisits(records_of_pages(pages))
    return out.select("record_id", F.expr("record_id div 2").alias("page_id"), "canonical_url", "status", "refers_to", F.expr("array_join(transform(headers, h -> concat(h.name, '=', h.value)), ';')").alias("headers"))

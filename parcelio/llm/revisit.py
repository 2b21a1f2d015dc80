"""Not-modified captures: which earlier full response a revisit stands for.

An as-of join by canonical URL finds for each revisit the latest full response
captured before it. If the revisit's validators fit, the response's payload and
headers are taken over, the headers that a not-modified answer may change being
replaced by the revisit's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")
#: Query parameters that name a visit and not a page (fixed values).
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid"
#: Seconds of one slice of time; a URL's captures are joined slice by slice.
SLICE = 3600


def canonical_url(url: Column) -> Column:
    """Host and path that captures of one page share.

    Scheme, `www.`, default port, fragment, tracking parameters and trailing
    slashes go; the host is in lower case; parameters are sorted. A text that is
    no http URL stays as it is, without white space around it; null stays null.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    form = r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?@]*@)?([^/?:]+)(?::[0-9]*)?([^?]*)\??(.*)$"
    port = F.regexp_extract(plain, r"^[A-Za-z]+://(?:[^/?@]*@)?[^/?:]+:([0-9]+)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, form, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, form, 2), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(plain, form, 3), f"(^|&)(?i:{TRACKING})=[^&]*", "")
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(plain.rlike(form), whole).otherwise(plain)


def _strip_weak(tag: Column) -> Column:
    """An entity tag for the weak comparison that not-modified answers use."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record.

    `records` has `record_id`, `kind` (`response` or `revisit`), `url`, `ts`
    (seconds), `status`, `headers` (a map, names in any case) and `digest` of the
    payload. A full response is a `response` with status 200. Result:
    `record_id`, `url` (canonical), `response_id`, `outcome`, `digest`, `headers`.

    The latest full response of the same canonical URL with a smaller `ts` is
    the candidate, the greatest `record_id` among equal ones. `outcome`:
    `resolved`; `no_response`; `mismatch` if a validator differs; `unvalidated`
    if the two have no validator in common. Validators are the entity tag (weak
    comparison), else the time of last modification, else the payload digest.
    Only resolved revisits have `response_id`, `digest` and merged headers (names
    in lower case); others keep their own headers and a null digest. Records
    with null url or ts never resolve, nor serve; a null map has no headers.
    Repeated revisits are resolved each, repeated responses count once. An empty
    table gives no rows; other columns are ignored.
    """
    pairs = F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    listed = F.array_sort(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))
    rows = records.select(
        F.col("record_id").cast("long"),
        (F.col("kind") == "revisit").alias("revisit"),
        canonical_url(F.col("url")).alias("url"),
        F.col("ts").cast("long"),
        (F.col("kind").eqNullSafe("response") & F.col("status").cast("int").eqNullSafe(200)).alias("full"),
        listed.alias("headers"),
        F.col("digest").cast("string"),
    ).filter("revisit OR full")
    able = F.col("url").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("slice", F.floor(F.col("ts") / SLICE))
    found = F.when(F.col("full") & able, F.struct("ts", "record_id", "digest", "headers"))

    # The last response of each earlier slice: one row per URL and slice.
    ends = rows.filter(F.col("full") & able).groupBy("url", "slice").agg(F.max(F.struct("ts", "record_id", "digest", "headers")).alias("end"))
    needed = rows.filter(F.col("revisit") & able).select("url", "slice").distinct()
    whole = needed.join(ends, ["url", "slice"], "full_outer")
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("early", F.last("end", ignorenulls=True).over(before)).select("url", "slice", "early")

    # Within a slice: revisits come before responses of the same second.
    within = Window.partitionBy("url", "slice").orderBy("ts", F.col("full"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(found, ignorenulls=True).over(within)).filter("revisit")
    joined = near.join(whole, ["url", "slice"], "left").withColumn("hit", F.when(able, F.coalesce("near", "early")))

    mine, theirs = F.map_from_entries(_distinct("headers")), F.map_from_entries(_distinct("hit.headers"))
    joined = joined.withColumn("mine", mine).withColumn("theirs", theirs)
    tags = [_strip_weak(F.col(m)["etag"]) for m in ("mine", "theirs")]
    times = [F.trim(F.col(m)["last-modified"]) for m in ("mine", "theirs")]
    same = F.coalesce(tags[0] == tags[1], times[0] == times[1], F.col("digest") == F.col("hit.digest"))
    outcome = (
        F.when(F.col("hit").isNull(), "no_response").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    )
    joined = joined.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    new = F.map_filter("mine", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("theirs", lambda k, _: ~F.map_contains_key(new, k))
    return joined.select(
        "record_id",
        "url",
        F.when(good, F.col("hit.record_id")).alias("response_id"),
        "outcome",
        F.when(good, F.col("hit.digest")).alias("digest"),
        F.when(good, F.map_concat(kept, new)).otherwise(F.col("mine")).alias("headers"),
    )


def _distinct(name: str) -> Column:
    """Sorted headers; of names that differ in case only, the last one in order stays."""
    listed = F.col(name)
    return F.filter(listed, lambda e, i: (i == F.size(listed) - 1) | (F.element_at(listed, (F.least(i + 2, F.size(listed))).cast("int"))["key"] != e["key"]))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records for stored pages: a full response of each, and a revisit later on.

    Page n is captured at second 60 n, and revisited 1 to 7 days later under a
    variant of its URL with, by turns, the same tag, a weak tag, only the time of
    last modification, another tag, only the digest, or no validator.
    """
    page = F.col("page_id").cast("long")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select(page.alias("page"), "url", digest.alias("digest"), F.pmod(page, F.lit(6)).alias("turn"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    stamp = F.concat(F.lit("t"), (F.col("page") * 60).cast("string"))
    full = rows.select(
        (F.col("page") * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        (F.col("page") * 60).alias("ts"),
        F.lit(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), stamp,
            F.lit("Date"), stamp, F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
        "digest",
    )
    shown = (
        F.when(F.col("turn").isin(0, 3), tag).when(F.col("turn") == 1, F.concat(F.lit("W/"), tag)).otherwise(F.lit(None))
    )
    shown = F.when(F.col("turn") == 3, F.lit('"changed"')).otherwise(shown)
    later = F.col("page") * 60 + 86400 * (1 + F.pmod("page", F.lit(7)))
    own = F.create_map(
        F.lit("etag"), shown, F.lit("last-modified"), F.when(F.col("turn") == 2, stamp),
        F.lit("date"), F.concat(F.lit("t"), later.cast("string")), F.lit("content-length"), F.lit("0"),
    )
    again = rows.select(
        (F.col("page") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(F.col("url"), F.when(F.col("turn") % 2 == 0, F.lit("#again")).otherwise(F.lit(""))).alias("url"),
        later.alias("ts"),
        F.lit(304).alias("status"),
        F.map_filter(own, lambda _, v: v.isNotNull()).alias("headers"),
        F.when(F.col("turn") == 4, F.col("digest")).alias("digest"),
    )
    return full.unionByName(again)

"""WARC not-modified revisits: an as-of join to the latest earlier full response of the canonical URL.

Records are windowed by (URL, time segment), so a URL holding a third of all records spreads
over its segments; the last full response of each segment is carried to later ones through a
table of one row per URL and segment.  Only (time, record id) pairs move; headers are fetched
by record id afterwards, and payloads not at all unless asked for.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the fields a not-modified answer may update (RFC 9110, 15.4.5), and the last change
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SEGMENT = 100_000
#: fixed values: rewrites that make a URL canonical, in order
REWRITES = (
    ("#.*$", ""),                                        # fragment
    ("^[A-Za-z]+://", ""),                               # scheme
    ("^(www|m)[.]", ""),                                 # host aliases
    ("[?&](utm_[a-z]+|ref|page)=[^&]*", ""),             # tracking and paging
    ("([.]html|/)$", ""),                                # trailing slash, extension
)


def canonical_url(url: Column) -> Column:
    for pattern, to in REWRITES:
        url = F.regexp_replace(url, pattern, to)
    return F.lower(url)


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve_revisits(records: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, response_id, state and headers.

    ``records`` has record_id long, kind ("response" or "revisit"), status int, url, ts long and
    headers map of lower-case names; other columns are ignored.  A full response is a response
    of status 200.  A revisit refers to the latest full response of its canonical URL before it,
    by (ts, record_id).  ``state`` is

    * ``resolved``: the entity tags agree (weakly), or, unless both have one, the times of last change;
    * ``mismatch``: the validator compared differs;
    * ``unverified``: no validator is in both;
    * ``orphan``: there is no earlier full response.

    ``headers`` are the response's, with those of ``PERMITTED`` replaced by the revisit's, where
    resolved; else null.  Null headers are none; a null URL, time or record id refers to nothing
    and is no response.  Rows repeating a record id are returned each; as a response they count once.
    An empty table gives an empty table.
    """
    r = records.select("record_id", "kind", "status", canonical_url(F.col("url")).alias("url_key"), "ts",
                       F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    r = r.withColumn("seg", F.floor(F.col("ts") / F.lit(segment)))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    point = F.when(full, F.struct("ts", "record_id"))
    moves = r.where("url_key IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL").select("record_id", "kind", "url_key", "ts", "seg", point.alias("point"))
    before = Window.partitionBy("url_key", "seg").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = moves.withColumn("near", F.last("point", ignorenulls=True).over(before)).where("kind = 'revisit'")
    # the last full response of each segment, carried to the segments after it
    by_seg = moves.groupBy("url_key", "seg").agg(F.max("point").alias("latest"))
    earlier = Window.partitionBy("url_key").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_seg.select("url_key", "seg", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["url_key", "seg"], "left").select(
        F.col("record_id").alias("rev_id"), F.coalesce("near.record_id", "carried.record_id").alias("response_id")).distinct()
    sources = r.where(full).select(F.col("record_id").alias("response_id"), F.col("headers").alias("old")).dropDuplicates(["response_id"])
    known = found.where("response_id IS NOT NULL").join(sources, "response_id")
    revisits = r.where("kind = 'revisit'").join(known, F.col("record_id") == F.col("rev_id"), "left")
    tag = lambda h: F.regexp_replace(_header(h, "etag"), "^W/", "")
    tag_a, tag_b = tag(F.col("headers")), tag(F.col("old"))
    time_a, time_b = _header(F.col("headers"), "last-modified"), _header(F.col("old"), "last-modified")
    state = (F.when(F.col("response_id").isNull(), "orphan")
             .when(tag_a.isNotNull() & tag_b.isNotNull(), F.when(tag_a == tag_b, "resolved").otherwise("mismatch"))
             .when(time_a.isNotNull() & time_b.isNotNull(), F.when(time_a == time_b, "resolved").otherwise("mismatch"))
             .otherwise("unverified"))
    new = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("old", lambda k, _: ~F.map_contains_key(new, k))
    out = revisits.withColumn("state", state)
    return out.select("record_id", "url_key", "ts", "response_id", "state",
                      F.when(F.col("state") == "resolved", F.map_concat(kept, new)).alias("headers"))


def with_payloads(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the ``body`` of the response they refer to."""
    bodies = records.select(F.col("record_id").alias("response_id"), "body").dropDuplicates(["response_id"])
    return resolved.where("state = 'resolved'").join(bodies, "response_id")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl's records made from ``pages`` (page_id, url, html): each page's response, then two revisits.

    The first revisit comes before the page's own response for every seventh page and carries
    the page's entity tag, weak for every third; the second has another tag for every fifth
    page, and none for every eleventh.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    p = pages.select("page_id", "url", tag.alias("tag"), "html")
    i = F.col("page_id")
    common = lambda age, when: [F.lit("cache-control"), F.lit(f"max-age={age}"), F.lit("date"), when.cast("string")]
    first_ts = F.when(i % 7 == 0, i * 10 - 5).otherwise(i * 10 + 1_000_005)
    answer = F.struct((i * 3).alias("record_id"), F.lit("response").alias("kind"), F.lit(200).alias("status"), (i * 10).alias("ts"),
                      F.create_map(F.lit("etag"), F.col("tag"), F.lit("content-type"), F.lit("text/html"), *common(60, i * 10)).alias("headers"))
    weak = F.when(i % 3 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    one = F.struct((i * 3 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), first_ts.alias("ts"),
                   F.create_map(F.lit("etag"), weak, F.lit("set-cookie"), F.lit("a=1"), *common(120, first_ts)).alias("headers"))
    other = F.when(i % 5 == 0, F.lit('"changed"')).otherwise(F.col("tag"))
    late = i * 10 + 2_000_007
    two = F.struct((i * 3 + 2).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), late.alias("ts"),
                   F.when(i % 11 == 0, F.create_map(*common(180, late))).otherwise(
                       F.create_map(F.lit("etag"), other, *common(180, late))).alias("headers"))
    return p.select("url", F.explode(F.array(answer, one, two)).alias("r")).select("url", "r.*")

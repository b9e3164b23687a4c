"""Not-modified revisits of a web archive, resolved to the responses they stand for.

A revisit record says that a server answered 304: the body is that of an earlier response. It is resolved
by an as-of join on the canonical URL to the latest earlier full response; validators must agree, and
the headers that a 304 may update are merged over the stored ones.

The as-of join sorts all records by (URL, time) into ranges. Inside a range a window finds the last
response; across ranges only the last response of a URL that a range begins in the middle of is carried,
at most one row per range. So a URL that holds a third of all records is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import partitions, pick, stored

# Header fields that a not-modified answer does not update, as HTTP caching defines them,
# and query parameters that do not select content.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)"

FIELDS = ("record_id", "kind", "url", "at", "etag", "last_modified", "digest", "headers")


def canonical_url(url: str | Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameters, parameters
    sorted, and no slash at the end of a path; null for null."""
    text = F.trim(F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"(?s)#.*$", ""))
    head = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _entries(headers: Column) -> Column:
    """Header fields as an array of (name, value), names in lower case."""
    fields = F.coalesce(F.map_entries(headers), F.expr("array()").cast("array<struct<key:string,value:string>>"))
    return F.transform(fields, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))


def merged_headers(old: Column, new: Column) -> Column:
    """Stored fields with those of ``new`` that a 304 may update in their place, sorted by name."""
    fresh = F.filter(_entries(new), lambda e: ~e["name"].isin(*NOT_UPDATED))
    kept = F.filter(_entries(old), lambda e: ~F.exists(fresh, lambda f: f["name"] == e["name"]))
    return F.array_sort(F.concat(kept, fresh))


def _verdict(new: Column, old: Column) -> Column:
    """resolved, unverified (no validator on both sides), or what differs. Entity tags compare weakly."""
    tag = lambda c: F.regexp_replace(c["etag"], r"^W/", "")
    pairs = [("etag", tag(new), tag(old)), ("last_modified", new["last_modified"], old["last_modified"]),
             ("digest", new["digest"], old["digest"])]
    wrong = F.coalesce(*[F.when(a != b, F.lit(f"{name} differs")) for name, a, b in pairs])
    some = F.lit(False)
    for _, a, b in pairs:
        some = some | (a.isNotNull() & b.isNotNull())
    return F.when(old.isNull(), F.lit("no earlier response")).when(wrong.isNotNull(), wrong).when(
        some, F.lit("resolved")).otherwise(F.lit("unverified"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url (canonical), at, refers_to, verdict, digest and headers.

    ``records`` has record_id, kind ('response' or 'revisit'), url, at (any ordered type), etag, last_modified,
    digest and headers (map). ``refers_to`` is the latest response of the canonical URL before ``at``, of
    several at one moment the one with the largest record_id; equal times are not earlier. Only resolved
    revisits get its digest and the merged headers (array of name, value). Revisits without url or time have
    no earlier response; records of other kinds take no part. Null headers are none. Repeated revisits are
    resolved each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = records.sparkSession
    named = pick(records, *FIELDS).where(F.col("kind").isin("response", "revisit")).withColumn("key", canonical_url("url"))
    body = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    # A response of the same moment comes after the revisit: it is not earlier.
    late = (F.col("kind") == "response").cast("int")
    events = named.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select(
        "key", "at", late.alias("late"), "record_id", body.alias("own"),
        F.when(F.col("kind") == "response", body).alias("response"))
    order = ["at", "late", "record_id"]
    ranged, _ = stored(
        events.repartitionByRange(partitions(spark), "key", *order).withColumn("range", F.spark_partition_id()), "records")
    inside = Window.partitionBy("range", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("before", F.last("response", ignorenulls=True).over(inside)).where("late = 0")
    # The last response of a URL in each range; a URL is cut where ranges meet, so few are carried on.
    last = ranged.where("late = 1").groupBy("key", "range").agg(
        F.max_by("response", F.struct("at", "record_id")).alias("last"))
    spans = ranged.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    several = spans.groupBy("key").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("key")
    cut = spans.join(several, "key").join(last, ["key", "range"], "left")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried, _ = stored(cut.select("key", "range", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
                        .where("carried IS NOT NULL"), "carried")
    # Every range but the first begins in the middle of one URL at most: a row per range.
    found = seen.join(F.broadcast(carried), ["key", "range"], "left").withColumn("old", F.coalesce("before", "carried"))
    lost = named.where((F.col("kind") == "revisit") & (F.col("key").isNull() | F.col("at").isNull())).select(
        "key", "at", "record_id", body.alias("own"), F.lit(None).cast(ranged.schema["response"].dataType).alias("old"))
    both = found.select("key", "at", "record_id", "own", "old").unionByName(lost)
    judged = both.withColumn("verdict", _verdict(F.col("own"), F.col("old")))
    good = F.col("verdict") == "resolved"
    return judged.select(
        "record_id", F.col("key").alias("url"), "at", F.col("old.record_id").alias("refers_to"), "verdict",
        F.when(good, F.col("old.digest")).alias("digest"),
        F.when(good, merged_headers(F.col("old.headers"), F.col("own.headers"))).alias("headers"))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved revisits with ``body``, from (record_id, body) of the responses."""
    return resolved.where("verdict = 'resolved'").join(
        bodies.select(F.col("record_id").alias("refers_to"), "body"), "refers_to")

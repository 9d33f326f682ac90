"""WARC revisit records: find the response a not-modified record stands for, and merge headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.session import materialize, shuffle_width

# Header fields that a not-modified answer must not change in the stored response.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
]
# Fixed value: query parameters that only track where a visit came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Key of a page: without scheme, user, ``www.``, default port, fragment, trailing slashes and
    tracking parameters; host in lower case, parameters sorted. Null for null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#(?s:.*)$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?((?s:.*))$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names equal but for case the last one stays. Null: no headers."""
    pairs = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.transform(F.coalesce(F.map_entries(headers), pairs), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(entries, pairs, lambda out, e: F.array_append(F.filter(out, lambda old: old["key"] != e["key"]), e))
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, each permitted field of ``fresh`` replacing the one of its name."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def _verdict(etag: Column, modified: Column, full: Column) -> Column:
    """Weak comparison of entity tags if the revisit has one, else of modification dates."""
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    same = F.when(etag.isNotNull(), weak(etag) == weak(full["etag"])).otherwise(modified == full["last_modified"])
    return (
        F.when(full.isNull(), "orphan")
        .when(etag.isNull() & modified.isNull(), "unverified")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )


def resolve_revisits(records: DataFrame, payload: list[str]) -> DataFrame:
    """One row per revisit of ``records(record_id, url, ts, kind, etag, last_modified, headers, *payload)``.

    Returns ``record_id, canonical_url, ts, status, refers_to, headers`` and the payload columns. A
    revisit meets the latest full response of the same canonical URL with an earlier ``ts`` (of
    several at one ``ts`` the largest record_id). status: ``resolved`` (validators agree: refers_to,
    merged headers and payload are set), ``mismatch``, ``unverified`` (the revisit has no validator),
    ``orphan`` (no earlier response, url or ts). Only resolved rows carry response data.

    kind is ``response`` or ``revisit``; rows of any other kind, or null, are left out. A response
    without url or ts serves nobody. Repeated revisits give a row each. Null headers are no headers.
    Empty tables give an empty table; extra columns are ignored.

    The as-of join is one sort: rows are range-partitioned by (url, time), so a URL with a third of
    all captures spreads over many slices; each slice is searched alone, and the last response of
    earlier slices is handed on through a table with at most one row per slice, hence broadcast.
    """
    full = F.struct("record_id", "etag", "last_modified", lower_keys(F.col("headers")).alias("headers"), *payload)
    key = canonical_url(F.col("url"))
    slim = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", key.alias("canonical_url"), "ts", (F.col("kind") == "response").cast("int").alias("is_full"),
        F.when(F.col("kind") == "revisit", F.col("etag")).alias("etag"),
        F.when(F.col("kind") == "revisit", F.col("last_modified")).alias("last_modified"),
        F.when(F.col("kind") == "revisit", lower_keys(F.col("headers"))).alias("headers"),
        F.when((F.col("kind") == "response") & F.col("ts").isNotNull() & key.isNotNull(), full).alias("full"),
    )
    order = ["ts", "is_full", "record_id"]
    ranged = materialize(
        slim.repartitionByRange(shuffle_width(records.sparkSession), "canonical_url", *order).withColumn("slice", F.spark_partition_id())
    )
    latest = ranged.groupBy("canonical_url", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("full"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = latest.select("canonical_url", "slice", F.last("full", ignorenulls=True).over(earlier).alias("handed")).where("handed is not null")
    inside = Window.partitionBy("canonical_url", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranged.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("is_full = 0")
    met = near.join(F.broadcast(handed), ["canonical_url", "slice"], "left").withColumn(
        "full", F.when(F.col("ts").isNotNull(), F.coalesce("near", "handed"))
    )
    judged = met.withColumn("status", _verdict(F.col("etag"), F.col("last_modified"), F.col("full")))
    of = lambda c: F.when(F.col("status") == "resolved", c)
    return judged.select(
        "record_id", "canonical_url", "ts", "status", of(F.col("full.record_id")).alias("refers_to"),
        of(merged_headers(F.col("full.headers"), F.col("headers"))).alias("headers"), *[of(F.col(f"full.{c}")).alias(c) for c in payload],
    )

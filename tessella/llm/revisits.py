"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

The join is a window maximum in two steps. Within (URL, time bucket) a revisit looks at earlier
responses of its bucket; a second window over the buckets of a URL carries the latest response
of earlier buckets. A hot URL is thus spread over its buckets. Validators of the revisit are
then compared with the response's, and the revisit's permitted headers replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that only track.
TRACKING = "ref|source|utm_[a-z]+|fbclid|gclid|sessionid"


def canonical(url: Column) -> Column:
    """Canonical URL: no scheme, user, fragment, default port, leading www., tracking parameters or final slash; host lower-cased.

    Null for a null URL; a URL without a scheme and host is kept as it is, without its fragment.
    """
    bare = F.regexp_replace(url, "#.*$", "")
    head = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]+)(:[0-9]+)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, head, 1)), r"^www\.", "")
    port = F.regexp_replace(F.regexp_extract(bare, head, 2), "^:(80|443)$", "")
    rest = F.regexp_replace(bare, head, "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), rf"(^|&)(?:{TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/$", "")
    return F.when(host == "", bare).otherwise(F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def resolve(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """capture_id, url_key, response_id, state, headers; one row per revisit.

    captures: capture_id long, url, fetched_at timestamp, kind ('response' or 'revisit'), status
    int, headers map<string,string> (lower-case names). A full response is a 'response' of
    status 200. The latest strictly earlier one answers a revisit; of equal times the larger id.
    state: 'resolved' (an etag or last-modified agrees, and none that both have differs),
    'unverified' (they share no validator), 'mismatch' (they differ; response_id is kept, headers
    are the revisit's own) or 'missing'. Weak etags ('W/') compare without the mark. headers is
    a JSON object by name. Null URLs, times and headers match nothing: 'missing'. Repeated rows
    are reported each; no revisits give no rows. Extra columns are ignored.
    """
    headers = F.coalesce("headers", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    rows = captures.select("capture_id", canonical(F.col("url")).alias("url_key"), F.unix_micros("fetched_at").alias("at"), "kind", "status", headers.alias("headers"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * 1_000_000)))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("at").isNotNull(), F.struct("at", "capture_id"))
    rows = rows.withColumn("full", full)
    known = rows.where("url_key is not null and at is not null")
    earlier = Window.partitionBy("url_key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    within = known.withColumn("here", F.max("full").over(earlier)).where("kind = 'revisit'")
    carried = known.groupBy("url_key", "bucket").agg(F.max("full").alias("last"))
    carried = carried.select("url_key", "bucket", F.max("last").over(Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = within.join(carried, ["url_key", "bucket"], "left").withColumn("answer", F.coalesce("here", "before"))
    lost = rows.where("kind = 'revisit' and (url_key is null or at is null)").withColumn("answer", F.lit(None).cast("struct<at:bigint,capture_id:bigint>"))
    asked = found.select("capture_id", "url_key", "headers", F.col("answer.capture_id").alias("response_id"), F.col("answer.at").alias("response_at")).unionByName(
        lost.select("capture_id", "url_key", "headers", F.col("answer.capture_id").alias("response_id"), F.col("answer.at").alias("response_at"))
    )
    stored = rows.where("full is not null").groupBy(F.col("url_key").alias("k"), F.col("at").alias("a"), F.col("capture_id").alias("c")).agg(F.max(F.map_entries("headers")).alias("entries"))
    stored = stored.withColumn("stored", F.map_from_entries("entries")).drop("entries")
    both = asked.join(stored, (asked["url_key"] == stored["k"]) & (asked["response_at"] == stored["a"]) & (asked["response_id"] == stored["c"]), "left")

    tag = lambda m, k: F.regexp_replace(F.col(m)[k], "^W/", "")
    same = [(tag("headers", k) == tag("stored", k)) for k in ("etag", "last-modified")]
    differs = F.coalesce(~same[0], F.lit(False)) | F.coalesce(~same[1], F.lit(False))
    agrees = F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))
    state = F.when(F.col("response_id").isNull(), "missing").when(differs, "mismatch").when(agrees, "resolved").otherwise("unverified")
    both = both.withColumn("state", state)
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    chosen = F.when(F.col("state").isin("resolved", "unverified"), merged).otherwise(F.col("headers"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(chosen)))
    return both.select("capture_id", "url_key", "response_id", "state", F.to_json(ordered).alias("headers"))

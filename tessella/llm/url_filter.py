"""URL filters as a temporal list join, in DataFrame functions only.

Dated list entries (a pattern put on or taken off a list) become validity intervals. A capture
meets the intervals of every pattern its URL can match - the host, its parent domains and the
host with each leading path, of the depths that the lists have - by equality, and of those the ones in force when it was fetched.
Captures are first reduced to distinct (host and path, time) keys, so a hot host is joined once
for each distinct key; the join back is plain and adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; '' if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(found), r"\.$", "")


def path(url: Column) -> Column:
    """Path of an absolute URL from its first slash to the query or fragment; '' if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: open) from (pattern, category, action, at).

    action is 'add' or 'remove'; of several events of an entry at one time 'remove' wins.
    Adding what is listed and removing what is not change nothing. Rows with a null are ignored.
    """
    events = entries.where("pattern is not null and category is not null and at is not null and action in ('add', 'remove')")
    events = events.groupBy("pattern", "category", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "category").orderBy("at")
    changes = events.withColumn("was", F.lag("action").over(order)).where("action <> coalesce(was, 'remove')")
    spans = changes.withColumn("valid_to", F.lead("at").over(order))
    return spans.where("action = 'add'").select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def depths(entries: DataFrame) -> DataFrame:
    """One row: label_depths and segment_depths, the distinct numbers of labels of host patterns and of segments of path patterns."""
    parts = F.size(F.split("pattern", "/")) - 1
    return entries.agg(
        F.collect_set(F.when(parts == 0, F.size(F.split("pattern", r"\.")))).alias("label_depths"),
        F.collect_set(F.when(parts > 0, parts)).alias("segment_depths"),
    )


def patterns(host_col: Column, path_col: Column, label_depths: Column, segment_depths: Column) -> Column:
    """Every pattern of the depths that matches: the host and its suffixes of two labels or more, and host with leading path segments ('h/a/b')."""
    labels = F.split(host_col, r"\.")
    n = F.size(labels)
    fits = F.filter(label_depths, lambda k: (k == n) | ((k >= 2) & (k < n)))
    suffixes = F.transform(fits, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    segments = F.filter(F.split(path_col, "/"), lambda s: s != "")
    prefixes = F.transform(F.filter(segment_depths, lambda k: k <= F.size(segments)), lambda k: F.concat_ws("/", host_col, F.array_join(F.slice(segments, 1, k), "/")))
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, fetched_at, blocked, n_entries, categories; one row per capture.

    captures: capture_id, url, fetched_at. An entry is in force from valid_from until before
    valid_to. categories are distinct, sorted and comma-joined ('' if none). A URL that is null
    or has no host, and a null fetch time, match nothing. Repeated captures are reported each.
    Empty lists block nothing; no captures give no rows. Other columns are ignored.
    """
    rows = captures.select("capture_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "fetched_at")
    keys = rows.where("host <> '' and fetched_at is not null").select("host", "path", "fetched_at").distinct()
    keys = keys.crossJoin(F.broadcast(depths(entries)))  # one row
    met = keys.select("host", "path", "fetched_at", F.explode(patterns(F.col("host"), F.col("path"), F.col("label_depths"), F.col("segment_depths"))).alias("pattern")).join(validity(entries), "pattern")
    active = met.where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    verdict = active.groupBy("host", "path", "fetched_at").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    verdict = shared_table(verdict, "url-verdicts")  # written, so that a join on a hot page can be split
    return rows.join(verdict, ["host", "path", "fetched_at"], "left").select(
        "capture_id", "host", "fetched_at", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("categories", F.lit("")).alias("categories")
    )

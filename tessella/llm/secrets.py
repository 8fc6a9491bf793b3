"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

A scan finds candidate strings in every whole text. Their hashes are counted over the corpus by
distinct repository and distinct owner: a value many owners hold is a copied example, a value
that stays with few owners looks live. The base kinds are reported wherever they match; the
wider `opaque` kind is reported only where ownership says that it looks live.

A match's offset is the running sum of the pieces before it, a window over a document's matches,
so the work is linear in a text and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

# The base patterns of the query's contract. A run that is too short is dropped
# there after the match; for the second and third kind a bounded pattern finds the same spans.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A long run of credential characters; it must mix letters and digits.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")

MATCH = "array<struct<ord:int,gap:bigint,len:bigint,value_hash:string>>"


def _matches(text: Column, pattern: str, group: int, kind: int, keep) -> Column:
    """All leftmost non-overlapping matches as MATCH: code points before it since the last match, its own, and its value's hash if kept."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    return F.zip_with(
        gaps,
        F.arrays_zip(whole.alias("m"), value.alias("v")),
        lambda g, x: F.struct(F.lit(kind).alias("ord"), F.length(g).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("len"), F.when(keep(x["v"]), F.sha2(x["v"], 256)).alias("value_hash")),
    ).cast(MATCH)


def _where(cond: Column, matches: Column) -> Column:
    return F.when(cond, matches).otherwise(F.array().cast(MATCH))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: Column, owner_col: Column) -> DataFrame:
    """uid, doc_id, repo, owner and all matches of every row."""
    t, always = F.col("text"), lambda v: F.lit(True)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), repo_col.alias("repo"), owner_col.alias("owner"))
    return rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        "repo",
        "owner",
        F.concat(
            _where(t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), _matches(t, ASSIGN, 2, 0, lambda v: F.length(v) >= 12)),
            _where(t.contains("AKIA"), _matches(t, ACCESS, 0, 1, always)),
            _where(t.rlike(HEX), _matches(t, HEX, 0, 2, always)),
            _where(t.rlike(OPAQUE), _matches(t, OPAQUE, 0, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))),
        ).alias("matches"),
    )


def spans(rows: DataFrame) -> DataFrame:
    """uid, repo, owner, start, ord, end, value_hash: all base spans, and opaque spans outside of them."""
    each = rows.where(F.size("matches") > 0).select("uid", "repo", "owner", F.posexplode("matches").alias("pos", "m")).repartition("uid")
    each = each.select("uid", "repo", "owner", "pos", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("uid", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("end", end).where("value_hash is not null").withColumn("start", F.col("end") - F.col("len"))
    # An opaque span meets a base span if one that starts before its end ends after its start.
    base = F.col("ord") < 3
    before = Window.partitionBy("uid").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("covered", F.max(F.when(base, F.col("end"))).over(before))
    return found.where(base | F.col("covered").isNull() | (F.col("covered") <= F.col("start"))).select("uid", "repo", "owner", "start", "ord", "end", "value_hash")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, repos, owners, uses from (value_hash, repo, owner): distinct values are combined before they move, so a hot hash is no hot task."""
    return candidates.groupBy("value_hash").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"), F.count("*").alias("uses"))


def _joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: Column | None = None, owner_col: Column | None = None, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied; one row per input row.

    A value looks live when at most max_owners distinct owners and max_repos distinct
    repositories hold it; n_live and n_copied count the row's candidates on either side. A null
    text is empty and has no spans; a null repository or owner counts as none. Texts are scanned
    whole, in time linear in their length and matches. Spans that start together go in the order
    of KINDS. Repeated rows are reported each, also with equal or null ids; other columns are
    not read and may have any name. An empty table gives no rows.
    """
    repo = F.col("source") if repo_col is None else repo_col
    owner = F.col("source") if owner_col is None else owner_col
    rows = shared_table(scan(docs, id_col, text_col, repo, owner), "secrets-matches")
    found = shared_table(spans(rows), "secrets-spans")

    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    owned = shared_table(ownership(found), "secrets-owners")  # written, so that a join on a hot value can be split
    judged = found.join(owned, "value_hash").withColumn("live", live)
    base, span = F.col("ord") < 3, F.struct("start", "ord", "end")
    count = lambda k: F.count_if(F.col("ord") == k)
    verdict = judged.groupBy("uid").agg(
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(base | F.col("live"), span))).alias("every"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    none = F.lit("")
    return rows.select("uid", "doc_id").join(verdict, "uid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce(_joined("base"), none), 256).alias("base_sha256"),
        F.coalesce(_joined("every"), none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )

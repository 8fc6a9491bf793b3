"""Joins that repair references, deduplicate and detect changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import related_set, trim_controls
from .containment import tags_in_texts
from .targets import best_targets


def first_by(df: DataFrame, key: str | Column, order: list[Column]) -> DataFrame:
    """The first row of each key in the order (keep-first map)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose non-null key has no parent."""
    p = parents.select(F.col(parent_key).alias("__p"))
    return children.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("__p"), "left_anti")


def existing_related(entries: DataFrame) -> DataFrame:
    """id, related_fixed: the related list reduced to titles that exist in the entry's project, order kept."""
    wanted = entries.select("id", "project_id", F.posexplode(related_set(F.col("related"))).alias("pos", "title"))
    titles = entries.select("project_id", "title").distinct()
    kept = wanted.join(titles, ["project_id", "title"], "left_semi")
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), ",").alias("related_fixed"))


def missing_reverse(entries: DataFrame) -> DataFrame:
    """title, add: related links whose target exists but does not link back."""
    pairs = entries.select("title", F.explode(related_set(F.col("related"))).alias("to")).distinct()
    known = pairs.join(entries.select(F.col("title").alias("to")).distinct(), "to", "left_semi").where("title <> to")
    back = pairs.select(F.col("title").alias("to"), F.col("to").alias("title"))
    return known.join(back, ["title", "to"], "left_anti").select(F.col("to").alias("title"), F.col("title").alias("add"))


def add_reverse(entries: DataFrame) -> DataFrame:
    """id, related with the missing reverse titles appended in alphabetical order."""
    adds = missing_reverse(entries).groupBy("title").agg(F.array_sort(F.collect_set("add")).alias("adds"))
    have = F.filter(F.split(F.coalesce("related", F.lit("")), ","), lambda x: x != "")
    return entries.join(adds, "title", "left").select("id", F.array_join(F.concat(have, F.coalesce("adds", F.array().cast("array<string>"))), ",").alias("related"))


def backfilled_project(entries: DataFrame, docs: DataFrame, projects: DataFrame) -> DataFrame:
    """id, project_id: a missing project from the entry's document, else from the only project there is."""
    only = projects.agg(F.when(F.count("*") == 1, F.max("project_id")).alias("only"))
    parents = docs.select(F.col("id").alias("document_id"), F.col("project_id").alias("doc_project"))
    joined = entries.join(parents, "document_id", "left").crossJoin(F.broadcast(only))  # one row
    return joined.select("id", F.coalesce("project_id", "doc_project", "only").alias("project_id"))


def project_by_title(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """id, project_id of documents whose title begins with a project's name and '_' (smallest project wins).

    The prefix is cut at each '_' and met by equality, so no pair of document and project is tried in vain.
    """
    cuts = F.expr("transform(sequence(1, size(split(title, '_'))), i -> substring_index(title, '_', i))")
    heads = docs.where("title like '%\\_%'").select("id", F.explode(F.filter(cuts, lambda c: F.length(c) < F.length("title"))).alias("name"))
    return heads.join(projects, "name").groupBy("id").agg(F.min("project_id").alias("project_id"))


def duplicates_by_hash(df: DataFrame, content: Column, order: str) -> DataFrame:
    """hash, first (smallest `order`) and copies of every content."""
    return df.groupBy(F.sha2(content, 256).alias("hash")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def new_by_hash(incoming: DataFrame, existing: DataFrame, content: str, order: str) -> DataFrame:
    """Incoming rows, one of each content, whose content is not there yet."""
    keyed = lambda d: d.withColumn("hash", F.sha2(F.col(content), 256))
    return first_by(keyed(incoming), "hash", [F.asc(order)]).join(keyed(existing).select("hash"), "hash", "left_anti")


def first_urls(results: DataFrame, cap: int = 20) -> DataFrame:
    """First result of each URL (case ignored) in query then result order, `cap` in all."""
    once = first_by(results, F.lower("url"), [F.asc("query_ord"), F.asc("result_ord")])
    return once.orderBy("query_ord", "result_ord").limit(cap)


def change_counts(current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: total, new, changed, unchanged, deleted, dirty from (entry_id, hash) now and as stored."""
    a = current.select(F.col("entry_id").alias("a"), F.col("hash").alias("now"))
    b = stored.select(F.col("entry_id").alias("b"), F.col("hash").alias("was"))
    both = a.join(b, F.col("a") == F.col("b"), "full")
    fresh = F.col("was").isNull() & F.col("now").isNotNull()
    changed = F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))
    return both.agg(
        F.count("now").alias("total"),
        F.count_if(fresh).alias("new"),
        F.count_if(changed).alias("changed"),
        F.count_if(F.col("was") == F.col("now")).alias("unchanged"),
        F.count_if(F.col("now").isNull()).alias("deleted"),
        F.count_if(fresh | changed).alias("dirty"),
    )


def dirty(current: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries without a stored hash or with another one, by id; at most `limit`."""
    was = stored.select("entry_id", F.col("hash").alias("was"))
    out = current.join(was, "entry_id", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).drop("was")
    return out if limit is None else out.orderBy("entry_id").limit(max(1, limit))


def latest_wins(stored: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of stored and updated rows with equal keys (null equals null) the one of largest `order` stays."""
    cols = stored.columns
    value = F.max_by(F.struct(*[c for c in cols if c not in keys]), F.col(order))
    merged = stored.unionByName(updates.select(*cols)).groupBy(*keys).agg(value.alias("v"))
    return merged.select(*keys, "v.*").select(*cols)


def candidate_targets(entries: DataFrame, top: int = 12) -> DataFrame:
    """source, target, score, position: best link targets by shared document (4), shared source name (2) and shared keywords (1 each)."""
    return best_targets(entries, top)


def missing_tags(entries: DataFrame, charts: DataFrame) -> DataFrame:
    """chart_id, tags: keywords (two characters or more) and titles of entries that a chart's title or content contains and its keyword string does not.

    Keywords are split at commas only; case counts; a chart table may have no title, and without a
    project_id in both tables all entries and charts are of one project. A chart's text is read once.
    """
    project = F.col("project_id") if "project_id" in entries.columns and "project_id" in charts.columns else F.lit(0)
    keywords = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), trim_controls), lambda k: F.length(k) >= 2)
    tags = entries.select(project.alias("project"), F.explode(F.concat(keywords, F.array("title"))).alias("tag"), F.lit(0).alias("value")).where("tag <> ''")
    title = F.col("title") if "title" in charts.columns else F.lit(None).cast("string")
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    found = tags_in_texts(tags, charts.select(project.alias("project"), F.col("id").alias("row"), text.alias("text")))
    have = charts.select(F.col("id").alias("chart_id"), F.coalesce("keywords", F.lit("")).alias("have"))
    hits = found.withColumnRenamed("row", "chart_id").join(have, "chart_id").where(~F.contains("have", "tag"))
    return hits.groupBy("chart_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))

"""Listings: optional filters, keyword search, order, pages; federated search; active configuration."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_each, trim_controls
from .containment import tags_in_texts

# The mark of a failed caption, and the labels of keywords and library in a prompt's list.
FAILED_MARK, KEYWORDS_LABEL, LIBRARY_LABEL = "失败", "关键词", "库"


def _folded(c: Column) -> Column:
    """Comparison key that ignores case and accents."""
    return F.collate(c, "UNICODE_CI_AI")


def listing(df: DataFrame, equal: dict[str, object] | None = None, keyword: str | None = None, keyword_in: Iterable[str] = (), exclude: dict[str, list] | None = None) -> DataFrame:
    """Rows where every given equality holds, the keyword stands in one of the columns (case and accents ignored) and no excluded value does.

    A value of None in `equal` does not filter. Excluding values drops nulls, too, as SQL does.
    """
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    if keyword:
        hit = F.lit(False)
        for name in keyword_in:
            hit = hit | F.coalesce(F.contains(_folded(F.col(name)), _folded(F.lit(keyword))), F.lit(False))
        df = df.where(hit)
    for name, values in (exclude or {}).items():
        df = df.where(~F.col(name).isin(values))
    return df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one-row total, rows of the page)."""
    return df.agg(F.count("*").alias("total")), df.orderBy(*order).offset((number - 1) * size).limit(size)


def federated(branches: dict[str, tuple[DataFrame, str, Column]], keyword: str, per_scope: int = 20) -> DataFrame:
    """scope, id, title of up to per_scope keyword hits of each branch (frame, title column, order)."""
    out = None
    for scope, (df, title, order) in branches.items():
        hits = listing(df, keyword=keyword, keyword_in=[title]).orderBy(order, "id").limit(per_scope)
        part = hits.select(F.lit(scope).alias("scope"), F.col("id").cast("long").alias("id"), F.col(title).alias("title"))
        out = part if out is None else out.unionByName(part)
    return out


def active_config(configs: DataFrame, purposes: list[str]) -> DataFrame:
    """The enabled configuration of largest id whose purpose is one of `purposes`."""
    return configs.where("enabled").where(F.col("purpose").isin(purposes)).orderBy(F.desc("id")).limit(1)


def settings_with_prefix(settings: DataFrame, prefix: str) -> DataFrame:
    """key (without the prefix) and value of the settings under a prefix."""
    return settings.where(F.col("setting_key").startswith(prefix)).select(F.substring("setting_key", len(prefix) + 1, 1 << 30).alias("key"), "value")


def file_checks(files: DataFrame, allowed: list[str], most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """name, ok, problem of (name, content): empty, too large, extension not allowed, or content of another type."""
    from ..functions.text import extension

    ext, head = extension(F.col("name")), F.upper(F.hex(F.substring("content", 1, 4)))
    # First bytes of the checked types.
    kind = F.when(head == "25504446", "pdf").when(head == "89504E47", "png").when(F.substring(head, 1, 6) == "FFD8FF", "jpg").when(head == "D0CF11E0", "ole")
    claims = F.when(ext == "pdf", "pdf").when(ext == "png", "png").when(ext.isin("jpg", "jpeg"), "jpg").when(ext.isin("doc", "xls", "ppt"), "ole")
    size = F.coalesce(F.length("content"), F.lit(0))
    problem = (
        F.when(size == 0, "empty")
        .when(size > most_bytes, "too_large")
        .when(~ext.isin(allowed), "extension")
        .when(claims.isNotNull() & ~claims.eqNullSafe(kind), "content")
    )
    return files.select("name", problem.isNull().alias("ok"), F.coalesce(problem, F.lit("")).alias("problem"))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Point lookups: the rows of the listed ids, all in one join; unknown ids give nothing."""
    return df.join(ids.select(F.col(key)).distinct(), key, "left_semi")


def mentions(df: DataFrame, text: str, most: int = 20) -> DataFrame:
    """The first rows by id whose title contains the text, case ignored."""
    return df.where(F.contains(F.lower("title"), F.lit(text.lower()))).orderBy("id").limit(most)


def failed_captions(images: DataFrame, ids: list[int] | None = None, mark: str = FAILED_MARK) -> DataFrame:
    """Images to caption again: the listed ids, or without a list those whose content has the failure mark."""
    kept = images.where("media_type = 'image'")
    return kept.where(F.contains("content", F.lit(mark))) if ids is None else kept.where(F.col("id").isin(ids))


def waiting(tasks: DataFrame, status: str = "parsed") -> DataFrame:
    """Documents left in a status, to be queued again in the order of upload."""
    return tasks.where(F.col("status") == status).select("id", F.row_number().over(Window.partitionBy("project_id").orderBy("upload_time", "id")).alias("position"), "project_id")


def chosen_config(settings: DataFrame, configs: DataFrame, purposes: list[str], fallback: str, able: Column) -> DataFrame:
    """project_id, config_id, origin: a project's own enabled setting, else the enabled configuration of one of the purposes, else an able one of the fallback purpose.

    settings: project_id, id, enabled, use_main. configs: project_id, id, enabled, purpose and what
    `able` reads. Of equal priority the largest id counts; projects without any give no row.
    """
    own = settings.where("enabled and not use_main").select("project_id", F.col("id").alias("config_id"), F.lit(0).alias("priority"))
    kind = F.when(F.col("purpose").isin(purposes), 1).when((F.col("purpose") == fallback) & able, 2)
    others = configs.where("enabled").select("project_id", F.col("id").alias("config_id"), kind.alias("priority")).where("priority is not null")
    best = own.unionByName(others).groupBy("project_id").agg(F.min(F.struct("priority", (-F.col("config_id")).alias("last"))).alias("b"))
    origin = F.element_at(F.array(F.lit("setting"), F.lit("purpose"), F.lit("fallback")), F.col("b.priority") + 1)
    return best.select("project_id", (-F.col("b.last")).alias("config_id"), origin.alias("origin"))


def related_entry(clicks: DataFrame, entries: DataFrame) -> DataFrame:
    """click, entry_id: the first entry of exactly the clicked title, else the first whose trimmed title is equal without regard to case; null if there is none."""
    loose = lambda c: lower_each(trim_controls(c))
    exact = entries.groupBy(F.col("title").alias("click")).agg(F.min("id").alias("exact_id"))
    close = entries.groupBy(loose(F.col("title")).alias("loose")).agg(F.min("id").alias("close_id"))
    met = clicks.select("click", loose(F.col("click")).alias("loose")).join(exact, "click", "left").join(close, "loose", "left")
    return met.select("click", F.coalesce("exact_id", "close_id").alias("entry_id"))


def related_or_found(clicks: DataFrame, entries: DataFrame) -> DataFrame:
    """click, entry_id, origin: related_entry() ("title"); where it finds none, the newest entry (created_at, then the smallest id) whose title, content or keywords hold the click ("search"); null if there is none.

    The search ignores case, but not accents, and leaves images and tables out. All clicks are searched for in one pass
    over the entries' texts.
    """
    known = related_entry(clicks.distinct(), entries)
    open_ = known.where("entry_id is null and click <> ''").select(F.lit(0).alias("project"), lower_each(F.col("click")).alias("tag"), F.lit(0).alias("value"))
    text = F.concat_ws("\0", *[lower_each(F.col(c)) for c in ("title", "content", "keywords")])
    texts = entries.where(~F.col("entry_type").isin("image", "table")).select(F.lit(0).alias("project"), F.col("id").alias("row"), text.alias("text"))
    hits = tags_in_texts(open_, texts).select("row", "tag").join(entries.select(F.col("id").alias("row"), "created_at"), "row")
    first = hits.groupBy(F.col("tag").alias("low")).agg(F.max_by("row", F.struct("created_at", -F.col("row"))).alias("found"))
    met = known.join(first, lower_each(F.col("click")) == F.col("low"), "left")
    origin = F.when(F.col("entry_id").isNotNull(), "title").when(F.col("found").isNotNull(), "search")
    return met.select("click", F.coalesce("entry_id", "found").alias("entry_id"), origin.alias("origin"))


def title_list(entries: DataFrame, detailed: bool = False, most: int | None = None) -> DataFrame:
    """project_id, lines: a project's titles as a bullet list by id, with keywords and library on request; at most `most` titles.

    The list is meant for a prompt. Without a limit it grows with the project, so it is one row.
    """
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("id"))
    rows = entries if most is None else entries.withColumn("__n", place).where(F.col("__n") <= most)
    line = F.concat(F.lit("- "), "title")
    if detailed:
        words = F.when(F.coalesce("keywords", F.lit("")) != "", F.concat(F.lit(f" [{KEYWORDS_LABEL}: "), "keywords", F.lit("]"))).otherwise("")
        library = F.when(F.col("entry_library").isNotNull(), F.concat(F.lit(f" ({LIBRARY_LABEL}: "), "entry_library", F.lit(")"))).otherwise("")
        line = F.concat(line, words, library)
    listed = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("lines"))

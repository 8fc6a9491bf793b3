"""Changes to stored tables, as new DataFrames for the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import related_set, trim_controls
from .containment import tags_in_texts
from .repair import latest_wins

# Keywords added to an image that became a table; what is stored with matched and new
# entries of images; names and columns of a vector's metadata; and the fields of a failed extraction.
TABLE_KEYWORDS = "表格,OCR"
MEDIA_TYPES = ("image", "table")
NOTES = {"table": "**关联表格数据**：\n", "image": "**关联图片描述**：\n"}
IMAGE_KEYWORDS = {"table": "表格,OCR,图片表格", "image": "图片,图表,图示"}
IMAGE_CONFIDENCE = {"table": 0.85, "image": 0.8}
METADATA = {
    "title": "title", "content": "content", "library": "entry_library", "sourceName": "source_name", "entryType": "entry_type",
    "mediaType": "media_type", "mediaPath": "media_path", "sourceOrigin": "source_origin", "tableMarkdown": "table_markdown", "projectId": "project_id",
}
FAILURE = {"relation_type": "extract_failed", "extractor": "llm", "status": "rejected"}


def upsert(stored: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest_wins(stored, updates, keys, order)


def without(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not among the removed ones (null keys stay)."""
    return df.join(gone.select(F.col(gone_key or key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def cascade_delete(documents: DataFrame, entries: DataFrame, vectors: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Documents, entries and vectors after deleting the documents in `gone` (id)."""
    lost = entries.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    return {"documents": without(documents, gone, "id"), "entries": without(entries, lost, "id"), "vectors": without(vectors, lost, "id")}


def still_present(states: DataFrame, entries: DataFrame) -> DataFrame:
    """Build states whose entry still exists."""
    return states.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")


def reviewed(entries: DataFrame, ids: DataFrame, status: str, reviewer: str) -> DataFrame:
    """Entries with status and reviewer set for the listed ids."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return entries.join(hit, "id", "left").withColumns({"status": F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")), "reviewer": F.when(F.col("__hit"), F.lit(reviewer)).otherwise(F.col("reviewer"))}).drop("__hit")


def promoted(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of accepted candidates between two existing nodes. nodes: entry_id, node_id; the last node of an entry counts."""
    last = nodes.groupBy("entry_id").agg(F.max("node_id").alias("node_id"))
    side = lambda p: last.select(F.col("entry_id").alias(f"{p}_entry_id"), F.col("node_id").alias(f"{p}_id"))
    met = candidates.where("status = 'accepted'").join(side("source"), "source_entry_id").join(side("target"), "target_entry_id").where("source_id <> target_id")
    return met.select("source_id", "target_id", F.concat(F.lit("semantic_"), "relation_type").alias("edge_type"), F.col("confidence").alias("weight"))


def event_log(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Append-only events: job_id, event_type, payload_json of the named columns."""
    return rows.select("job_id", "event_type", F.to_json(F.struct(*payload)).alias("payload_json"))


def replace_project(new: DataFrame, path: str) -> None:
    """Overwrite only the projects that `new` holds (dynamic partition overwrite)."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def with_columns(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Additive schema migration: `df` with the missing columns of `wanted` as nulls."""
    return df.unionByName(wanted.limit(0), allowMissingColumns=True)


def index_rows(entries: DataFrame, embedding: Column) -> DataFrame:
    """id, embedding, metadata (ten texts, '' where nothing is known, medium "text") of entries that may be searched.

    A column that `entries` lacks is taken as unknown.
    """
    value = lambda column: F.col(column).cast("string") if column in entries.columns else F.lit(None).cast("string")
    meta = F.create_map(*[x for name, column in METADATA.items() for x in (F.lit(name), F.coalesce(value(column), F.lit("text" if name == "mediaType" else "")))])
    return entries.where(F.col("status").isin("approved", "pending")).select("id", embedding.alias("embedding"), meta.alias("metadata"))


def reindexed(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The vector index (id, embedding, metadata) with fresh rows in place of those of the same ids."""
    return without(index, fresh, "id").unionByName(fresh)


def renamed_charts(charts: DataFrame) -> DataFrame:
    """id, title: '<project>_<图片|表格>_<n>[.ext]' by upload time within project and kind. charts: id, project_id, project, kind, upload_time, title."""
    from pyspark.sql import Window

    from ..functions.text import extension

    n = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy("upload_time", "id"))
    label = F.when(F.col("kind") == "table", "表格").otherwise("图片")
    ext = extension(F.col("title"))
    return charts.select("id", F.concat_ws("_", "project", label, n.cast("string")).alias("stem"), ext.alias("ext")).select("id", F.concat("stem", F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise("")).alias("title"))


def related_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, project_id, title, target, action ('add' or 'remove') of related titles that an update put in or took out. before, after: id, project_id, title, related."""
    lists = after.join(before.select("id", related_set(F.col("related")).alias("old")), "id").select("id", "project_id", "title", "old", related_set(F.col("related")).alias("new"))
    event = lambda action, gone, kept: F.transform(F.array_except(gone, kept), lambda t: F.struct(F.lit(action).alias("action"), t.alias("target")))
    none = F.array().cast("array<string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    return lists.select("id", "project_id", "title", F.inline(F.concat(event("add", new, old), event("remove", old, new)))).select("id", "project_id", "title", "target", "action")


def with_reverse_links(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """id, related of entries whose list changes when related_changes are mirrored: the first entry of the target title in the project gains or loses the changed title.

    Lists are ordered: what was there, then new titles by name. An empty list becomes null.
    """
    first = entries.groupBy("project_id", F.col("title").alias("target")).agg(F.min("id").alias("target_id"))
    asked = changes.join(first, ["project_id", "target"])
    titles = lambda action: F.array_sort(F.collect_set(F.when(F.col("action") == action, F.col("title"))))
    by = asked.groupBy(F.col("target_id").alias("id")).agg(titles("add").alias("more"), titles("remove").alias("less"))
    have = F.coalesce(related_set(F.col("related")), F.array().cast("array<string>"))
    rows = entries.join(by, "id").select("id", have.alias("have"), "more", "less")
    rows = rows.select("id", "have", F.array_except(F.array_union("have", "more"), F.array_except("less", "more")).alias("now"))
    return rows.where("have <> now").select("id", F.nullif(F.array_join("now", ","), F.lit("")).alias("related"))


def re_extracted(entries: DataFrame, documents: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries after documents (id) were extracted again: their old entries go, the fresh ones come; entries without a document stay."""
    return without(entries, documents, "document_id", "id").unionByName(fresh)


def failures(replies: DataFrame, parsed: Column) -> DataFrame:
    """Rows for replies that could not be read: relation type 'extract_failed', confidence 0, rejected. replies: id, reply, error."""
    reason = F.coalesce("error", F.when(F.col("reply").isNull(), F.lit("no reply")), F.lit("unknown_error"))
    return replies.where(parsed.isNull()).select(F.col("id").alias("source_id"), reason.alias("reason"), F.lit(0.0).alias("confidence"), *[F.lit(v).alias(k) for k, v in FAILURE.items()])


def as_tables(images: DataFrame, read: DataFrame) -> DataFrame:
    """Images turned into table entries by their recognised Markdown (read: id, markdown); images without a path or a result stay."""
    met = images.join(read, "id", "left")
    hit = F.col("markdown").isNotNull() & F.col("media_path").isNotNull()
    suffix = F.concat(F.coalesce(F.concat("keywords", F.lit(",")), F.lit("")), F.lit(TABLE_KEYWORDS))
    new = {"table_markdown": F.col("markdown"), "media_type": F.lit("table"), "entry_type": F.lit("table"), "keywords": suffix}
    return met.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).drop("markdown")


def captioned(entries: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, entry_id: the first entry (smallest id) of the image's project whose title stands in its file name, caption or Markdown.

    images: id, project_id, filename, caption, markdown. Entries that are images or tables
    themselves are left out (where there is an entry_type), as are images without a project. Titles
    of any length count, an empty one stands in every text, and each text is read once.
    """
    named = entries.where(~F.col("entry_type").isin(*MEDIA_TYPES)) if "entry_type" in entries.columns else entries
    titles = named.where("project_id is not null").select(F.col("project_id").alias("project"), F.col("title").alias("tag"), F.col("id").alias("value"))
    text = F.concat_ws("\0", "filename", "caption", "markdown")
    hits = tags_in_texts(titles, images.where("project_id is not null").select(F.col("project_id").alias("project"), F.col("id").alias("row"), text.alias("text")))
    return hits.groupBy(F.col("row").alias("image_id")).agg(F.min("value").alias("entry_id"))


def with_images(entries: DataFrame, images: DataFrame, kind: str = "image", approve: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, content of entries that images were matched to; new entries of the images themselves).

    kind "table": what is stored with the matched entry is the recognised Markdown, else the caption.
    Several images of one entry are added in order of their ids, each unless the content so far holds
    it; an entry without content begins with the note. images: id, project_id, filename, caption, markdown,
    media_path, library, document_id, source_origin; the new entries come without an id.
    """
    note, text = NOTES[kind], "markdown" if kind == "table" else "caption"
    matched = captioned(entries, images if kind == "table" else images.withColumn("markdown", F.lit(None).cast("string")))
    said = matched.join(images.where(F.col(text).isNotNull()).select(F.col("id").alias("image_id"), F.col(text).alias("said")), "image_id")
    lists = said.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "said"))), lambda x: x["said"]).alias("said"))

    def added(content: Column, piece: Column) -> Column:
        whole = F.concat(F.lit(note), piece)
        return F.when(content == "", whole).when(F.contains(content, piece), content).otherwise(F.concat(content, F.lit("\n\n"), whole))

    before = F.coalesce("content", F.lit(""))
    changed = entries.join(lists, F.col("id") == F.col("entry_id")).select("id", before.alias("before"), F.aggregate("said", before, added).alias("content"))
    fixed = {"entry_type": kind, "media_type": kind, "keywords": IMAGE_KEYWORDS[kind], "status": "approved" if approve else "pending"}
    new = images.select(
        F.col("filename").alias("title"), F.col("filename").alias("source_name"), F.col("caption").alias("content"), F.col("library").alias("entry_library"), "document_id", "project_id", "media_path", "source_origin",
        F.lit(IMAGE_CONFIDENCE[kind]).alias("confidence"), (F.col("markdown") if kind == "table" else F.lit(None).cast("string")).alias("table_markdown"), *[F.lit(v).alias(k) for k, v in fixed.items()],
    )
    return changed.where("before <> content").select("id", "content"), new


def merged_tags(charts: DataFrame, tags: DataFrame) -> DataFrame:
    """id, keywords of charts whose keyword string lacks one of their document's tags; a tag found anywhere in the old string is not added. tags: document_id, tags (comma-separated)."""
    have = F.coalesce("keywords", F.lit(""))
    each = F.filter(F.transform(F.split("tags", ","), trim_controls), lambda t: t != "")
    rows = charts.join(tags, "document_id").select("id", have.alias("have"), each.alias("each"))
    new = F.filter("each", lambda t: ~F.contains(F.col("have"), t))
    rows = rows.select("id", "have", new.alias("new")).where(F.size("new") > 0)
    return rows.select("id", F.array_join(F.concat(F.when(F.col("have") != "", F.array("have")).otherwise(F.array().cast("array<string>")), "new"), ",").alias("keywords"))


def alive_tasks(tasks: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Tasks without those that ended (completed or failed) over `seconds` ago."""
    ended = F.col("status").isin("completed", "failed")
    return tasks.where(~ended | (F.unix_timestamp("ts") >= F.unix_timestamp(now) - seconds))

"""File sources: documents in folders, text tables, vector files, logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markdown import markdown_table
from ..functions.text import extension, folder_context, source_identity, strip_html
from ..operators.storage import shared_table

TEXT_TYPES = ["txt", "md", "csv", "json", "rtf"]


def folder(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """path, name, ext, identity, context, size, hash, content of every file below a folder (dot-files left out)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    out = files.select("path", name.alias("name"), extension(name).alias("ext"), source_identity(F.col("path")).alias("identity"), folder_context(F.col("path")).alias("context"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")
    out = out.where(~F.col("name").startswith("."))
    return out.where(F.col("ext").isin(allowed)) if allowed else out


def is_ooxml(content: Column) -> Column:
    """Whether a file begins like a ZIP archive."""
    return (F.length(content) >= 4) & (F.substring(content, 1, 2) == F.lit(b"PK"))


def archive_text(content: bytes, part: str) -> str:
    """XML text of the members of a ZIP archive whose name matches, tags as spaces; '' for anything unreadable."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = " ".join(z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if re.fullmatch(part, n))
    except (zipfile.BadZipFile, KeyError):
        return ""
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", xml), flags=re.ASCII).strip()


# Where the text lies in packed office formats.
PARTS = {
    "docx": r"word/document\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/slides/slide\d+\.xml",
    "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml",
}


def document_text(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text of files by extension: plain text, HTML, packed office formats, and `parsers` (extension -> function) for others.

    Types without a reader have a null text. Spark partitions the files; a reader sees one file.
    """
    known = {ext: (lambda b, p=part: archive_text(b, p)) for ext, part in PARTS.items()} | (parsers or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [known[e](bytes(c)) if e in known else None for e, c in zip(b["ext"], b["content"], strict=True)]})

    plain = F.decode("content", "UTF-8")
    simple = files.where(F.col("ext").isin([*TEXT_TYPES, "html", "htm"])).select("path", F.when(F.col("ext").isin("html", "htm"), strip_html(plain)).otherwise(plain).alias("text"))
    packed = files.where(~F.col("ext").isin([*TEXT_TYPES, "html", "htm"])).select("path", "ext", "content").mapInPandas(read, "path string, text string")
    return simple.unionByName(packed)


def read_by_chain(files: DataFrame, chains: dict[str, list[tuple[str, Callable[[bytes], str]]]]) -> DataFrame:
    """path, text, reader, reasons of every file: the readers of its extension are tried one after another.

    chains: extension -> [(name, function)]. Only files that a reader failed on (it raised, or gave no
    text) go to the next one, so costly readers see few files; contents are read from the source again.
    reasons lists '<reader>: <error>' of each failure. A file that every reader failed on stays, without text and
    reader, as does one of an unknown type, for the reason 'unsupported type'.
    """
    schema = "path string, text string, reader string, reason string"

    def stage(k: int):
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for path, ext, content in zip(b["path"], b["ext"], b["content"], strict=True):
                    name, reader = chains[ext][k]
                    try:
                        text = reader(bytes(content))
                        out.append((path, text, name, None) if text else (path, None, None, f"{name}: no text"))
                    except Exception as e:  # a reader may fail in any way; the next one is asked
                        out.append((path, None, None, f"{name}: {str(e) or type(e).__name__}"))
                yield pd.DataFrame(out, columns=["path", "text", "reader", "reason"])

        return read

    none = F.lit(None).cast("string")
    known = F.col("ext").isin(list(chains)) if chains else F.lit(False)
    unknown = files.where(~F.coalesce(known, F.lit(False))).select("path", none.alias("text"), none.alias("reader"), F.array(F.concat(F.lit("unsupported type: "), F.coalesce("ext", F.lit("")))).alias("reasons"))
    done, failed = unknown, None
    for k in range(max(map(len, chains.values()), default=0)):
        able = files.where(F.col("ext").isin([e for e, c in chains.items() if len(c) > k])).select("path", "ext", "content")
        if failed is not None:
            able = able.join(failed.select("path"), "path", "left_semi")
        tried = shared_table(able.mapInPandas(stage(k), schema), "read-stage")
        before = tried.withColumn("reasons", F.array_compact(F.array("reason")))
        if failed is not None:
            # What has no further reader is done; the others carry their reasons on.
            gone = failed.join(tried.select("path"), "path", "left_anti")
            done = done.unionByName(gone.select("path", none.alias("text"), none.alias("reader"), "reasons"))
            before = before.join(failed.select("path", F.col("reasons").alias("earlier")), "path").withColumn("reasons", F.concat("earlier", "reasons"))
        done = done.unionByName(before.where("reader is not null").select("path", "text", "reader", "reasons"))
        failed = shared_table(before.where("reader is null").select("path", "reasons"), "read-failed")
    if failed is not None:
        done = done.unionByName(failed.select("path", none.alias("text"), none.alias("reader"), "reasons"))
    return done


def csv_to_markdown(text: Column) -> Column:
    """Markdown table of a CSV text: blank lines skipped, rows padded, pipes escaped."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    # Cells outside quotes are split at commas; quotes go, doubled ones become one.
    cells = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(F.concat(F.lit(","), x), F.lit(r',((?:"(?:[^"]|"")*"|[^",])*)'), F.lit(1)), lambda c: F.trim(F.replace(F.regexp_replace(c, r'(?<!")"(?!")|^"|"$', ""), F.lit('""'), F.lit('"')))))
    return markdown_table(cells)


def vector_file(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding, metadata of a vector index kept as one JSON document {dimension, entries: [{id, vector, metadata}]}."""
    schema = "dimension int, entries array<struct<id:bigint,vector:array<float>,metadata:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("entries").alias("e"))
    return rows.select("e.id", F.col("e.vector").alias("embedding"), "e.metadata")


def vectors_as_json(vectors: DataFrame) -> DataFrame:
    """One JSON line for each vector; the index itself is kept as Parquet."""
    return vectors.select(F.to_json(F.struct("id", F.col("embedding").alias("vector"), "metadata")).alias("value"))


def log_tail(spark: SparkSession, path: str, limit: int = 1000) -> DataFrame:
    """number, line of the last `limit` lines of a log file or of a folder of them, numbered from 1 in order.

    Files follow each other by modification time, then by path; only the newest are read: one, then
    twice as many while their lines do not suffice. Within a file, lines go by the block they were read in and
    their place in it. Each task keeps its own last lines, so what moves is `limit` rows for each.
    A path that does not exist gives no lines.
    """
    from pyspark.errors import AnalysisException

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        listed = files.load(path).select("path", "modificationTime", "length")  # contents are not read
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "number long, line string")
    newest = listed.where("length > 0").orderBy(F.desc("modificationTime"), F.desc("path"))
    k, lines = 1, None
    while True:
        taken = [r["path"] for r in newest.limit(k).collect()]  # as many names as files that are read
        if not taken:
            return spark.createDataFrame([], "number long, line string")
        at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
        lines = spark.read.text(taken).select(at.alias("at"), F.col("value").alias("line")).orderBy(F.desc("at")).limit(limit)
        if len(taken) < k or lines.count() == limit:
            break
        k *= 2
    order = Window.orderBy("at")  # over `limit` rows
    return lines.select(F.row_number().over(order).cast("long").alias("number"), "line")


def file_tree(found: DataFrame, documents: DataFrame) -> DataFrame:
    """path, parent, name, is_dir, size, imported, doc_id of every file (path, size) and of the folders above it.

    A path with a part that begins with a dot is left out. doc_id is the smallest id of documents
    (id, file_path) of that path. Nesting is by `parent` ('' at the top); sorted by path, folders
    and files are in the order of display. Folders without files are not known.
    """
    parts = F.split("path", "/")
    shown = found.where(~F.exists(parts, lambda p: p.startswith(".")))
    known = documents.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("doc_id"))
    files = shown.join(known, "path", "left").select("path", F.lit(False).alias("is_dir"), F.col("size").cast("long").alias("size"), F.col("doc_id").isNotNull().alias("imported"), "doc_id")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = shown.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    none = lambda t: F.lit(None).cast(t)
    nodes = files.unionByName(folders.select("path", F.lit(True).alias("is_dir"), none("long").alias("size"), none("boolean").alias("imported"), none("long").alias("doc_id")))
    cut = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return nodes.select("path", cut.alias("parent"), F.element_at(parts, -1).alias("name"), "is_dir", "size", "imported", "doc_id")

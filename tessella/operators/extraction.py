"""Relations and entries extracted by a model, validated and stored by DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp_confidence
from ..functions.relations import parse_entries, parse_relations, readable, relation_errors, relation_status, relation_type, with_errors
from ..functions.text import normalised, shortened
from .mutations import failures
from .repair import candidate_targets, first_by
from .storage import shared_table

#: (system prompt, user prompt) -> reply
Model = Callable[[str, str], str]


def replies(prompts: DataFrame, model: Model, system: str = "", attempts: int = 3) -> DataFrame:
    """id, reply, error: the model's reply to each of `prompts` (id, prompt); after `attempts` failures no reply but the last error, as a failed row must not stop the others."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for prompt in b["prompt"]:
                reply = error = None
                for _ in range(attempts):
                    try:
                        reply, error = model(system, prompt), None
                        break
                    except (OSError, TimeoutError) as e:
                        error = str(e) or None
                out.append(reply)
                errors.append(error)
            yield pd.DataFrame({"id": b["id"], "reply": out, "error": errors})

    return prompts.select("id", "prompt").mapInPandas(ask, "id long, reply string, error string")


def title_index(entries: DataFrame) -> DataFrame:
    """key, id, content: the first entry of each normalised title; blank titles are left out."""
    keyed = entries.withColumn("key", normalised(F.col("title"))).where("key <> ''")
    return first_by(keyed, "key", [F.asc("id")]).select("key", "id", "content")


def validated(raw: DataFrame, entries: DataFrame, reject: float = 0.65, accept: float = 0.82) -> DataFrame:
    """source_id, target_id, relation_type, confidence, evidence, reason, status of extracted relations.

    raw: entry_id (the entry that was read) and the parsed fields of a relation. An unknown or
    foreign source title is an error; the relation then counts for the entry that was read.
    """
    index = title_index(entries)
    mine = entries.select(F.col("id").alias("entry_id"), F.col("content").alias("own_text"))
    side = lambda p: index.select(F.col("key").alias(f"{p}_key"), F.col("id").alias(f"{p}_id"), F.col("content").alias(f"{p}_text"))
    rows = raw.join(mine, "entry_id").withColumns({"s_key": normalised(F.col("sourceTitle")), "t_key": normalised(F.col("targetTitle"))})
    rows = rows.join(side("s").drop("s_text"), "s_key", "left").join(side("t"), "t_key", "left")
    ok = F.col("s_id").eqNullSafe(F.col("entry_id"))
    errors = relation_errors(F.col("relationType"), F.col("evidence"), ok, F.col("entry_id"), F.col("t_id"), F.col("own_text"), F.col("t_text"))
    kind = relation_type(F.col("relationType"))
    rows = rows.withColumn("errors", errors)
    return rows.select(
        F.col("entry_id").alias("source_id"),
        F.col("t_id").alias("target_id"),
        kind.alias("relation_type"),
        clamp_confidence(F.col("confidence")).alias("confidence"),
        "evidence",
        with_errors(F.col("reason"), F.col("errors")).alias("reason"),
        relation_status(F.col("confidence"), kind, F.col("errors"), reject, accept).alias("status"),
    )


def extract_relations(entries: DataFrame, model: Model, top: int = 12, text_chars: int = 3000) -> DataFrame:
    """Relations of each entry to its best candidate targets, as the model states them, validated.

    An entry whose reply did not come or cannot be read has one row of type 'extract_failed', rejected, with the
    reason and no target. The model is asked once: replies are written before they are read.
    """
    targets = candidate_targets(entries, top).join(entries.select(F.col("id").alias("target"), "title"), "target")
    listed = targets.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]), "\n").alias("titles"))
    prompt = F.concat_ws("\n", F.concat(F.lit("Source: "), "title"), shortened(F.coalesce("content", F.lit("")), text_chars), F.lit("Targets:"), "titles")
    asked = shared_table(replies(entries.join(listed, "id").select("id", prompt.alias("prompt")), model), "replies")
    raw = asked.select(F.col("id").alias("entry_id"), F.inline(parse_relations(F.col("reply"))))
    failed = failures(asked, F.when(readable(F.col("reply")), True)).drop("extractor")
    return validated(raw, entries).unionByName(failed, allowMissingColumns=True)


def extract_entries(chunks: DataFrame, model: Model) -> DataFrame:
    """id, chunk_no and the fields of every entry that the model finds in a chunk; a bad reply gives none. chunks: id, chunk_no, chunk."""
    keyed = chunks.select(F.xxhash64("id", "chunk_no").alias("key"), "id", "chunk_no", F.col("chunk").alias("prompt"))
    asked = replies(keyed.select(F.col("key").alias("id"), "prompt"), model).withColumnRenamed("id", "key")
    return keyed.drop("prompt").join(asked, "key").select("id", "chunk_no", F.inline(parse_entries(F.col("reply"))))


def reranked(hits: DataFrame, score: Callable[[str, str], float] | None, question: str) -> DataFrame:
    """Hits (id, text) with `rerank`: the scorer's value, 1.0 without a scorer."""
    if score is None:
        return hits.withColumn("rerank", F.lit(1.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "rerank": [float(score(question, t)) for t in b["text"]]})

    return hits.join(hits.select("id", "text").mapInPandas(run, "id long, rerank double"), "id")

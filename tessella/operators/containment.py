"""Which tags stand in which texts, by an Aho-Corasick automaton over the tags: one pass over each text.

Tags that have at most SLICE_CHARS characters together (checked) are broadcast and the texts stay
where they are. More tags are dealt out by hash to slices of that size within each project, and the texts of a
project, in shares of SHARE_CHARS characters, meet each slice of it: a task holds one automaton
of bounded size and reads texts one after another. A project that holds most texts is many
shares, one that holds most tags many slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CHARS, SHARE_CHARS = 1_000_000, 256_000_000
FOUND = "row long, tag string, value long"


class Matcher:
    """All of `tags` (tag, value) that a text contains, in one pass. An empty tag stands in every text."""

    def __init__(self, tags: Iterable[tuple[str, int | None]]) -> None:
        self.always, self.automaton = [], ahocorasick.Automaton()
        for t in tags:
            if t[0]:
                self.automaton.add_word(t[0], t)
            else:
                self.always = [t]
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[str, int | None]]:
        hits = {t for _, t in self.automaton.iter(text)} if len(self.automaton) else set()
        return [*hits, *self.always]


def _batch(rows: list[int], hits: list[tuple[str, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([t for t, _ in hits], pa.string()), pa.array([v for _, v in hits], pa.int64())], names=["row", "tag", "value"])


def _scanned(matchers: Iterator[tuple[Matcher | None, int, str]]) -> Iterator[pa.RecordBatch]:
    rows, hits = [], []
    for matcher, row, text in matchers:
        found = matcher.found(text) if matcher is not None else []
        rows += [row] * len(found)
        hits += found
        if len(rows) > 50_000:
            yield _batch(rows, hits)
            rows, hits = [], []
    yield _batch(rows, hits)


def tags_in_texts(tags: DataFrame, texts: DataFrame, slice_chars: int = SLICE_CHARS, share_chars: int = SHARE_CHARS) -> DataFrame:
    """row, tag, value: every distinct tag of a text's project that the text contains, case counting.

    tags: project, tag, value (of equal tags the smallest counts). texts: project, row, text. Null
    projects match each other, null tags and texts nothing; an empty tag matches every text.
    """
    spark = tags.sparkSession
    project = F.coalesce(F.concat(F.lit("p"), F.col("project").cast("string")), F.lit("")).alias("project")
    tags = tags.where("tag is not null").groupBy(project, "tag").agg(F.min("value").alias("value"))
    texts = texts.where("text is not null").select(project, F.col("row").cast("long").alias("row"), "text")
    size = tags.groupBy("project").agg(F.sum(F.length("tag") + 1).alias("chars"))
    if (size.agg(F.sum("chars")).first()[0] or 0) <= slice_chars:
        known: dict[str, list[tuple[str, int | None]]] = {}
        for r in tags.collect():  # at most slice_chars characters
            known.setdefault(r["project"], []).append((r["tag"], r["value"]))
        shared = spark.sparkContext.broadcast(known)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[str, Matcher] = {}

            def each():
                for b in batches:
                    for p, row, text in zip(*(b.column(c).to_pylist() for c in ("project", "row", "text")), strict=True):
                        if p not in made and p in shared.value:
                            made[p] = Matcher(shared.value[p])
                        yield made.get(p), row, text

            return _scanned(each())

        return texts.mapInArrow(scan, FOUND)
    slices = size.select("project", F.ceil(F.col("chars") / slice_chars).cast("int").alias("slices"))
    shares = texts.groupBy("project").agg(F.ceil((F.sum(F.length("text")) + 1) / share_chars).cast("int").alias("shares"))
    # Projects cut into several parts are fewer than all characters by the size of a part.
    cut = F.broadcast(slices.join(shares, "project").where("slices > 1 or shares > 1"))
    one = lambda n: F.coalesce(n, F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), one(n)).cast("int")
    left = tags.join(cut, "project", "left").select("project", dealt("tag", "slices").alias("slice"), every("shares").alias("share"), F.lit(None).cast("long").alias("row"), F.col("tag").alias("text"), "value")
    none = F.lit(None).cast("long").alias("value")
    right = texts.where("row is not null").join(cut, "project", "left").select("project", every("slices").alias("slice"), dealt("row", "shares").alias("share"), "row", "text", none)
    at = ["project", "slice", "share"]
    met = left.unionByName(right).repartition(*at).sortWithinPartitions(*at, F.col("row").asc_nulls_first())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            here, words, matcher = None, [], None
            for b in batches:
                for p, s, h, row, text, value in zip(*(b.column(c).to_pylist() for c in (*at, "row", "text", "value")), strict=True):
                    if (p, s, h) != here:
                        here, words, matcher = (p, s, h), [], None
                    if row is None:
                        words.append((text, value))
                        continue
                    if words:  # all tags of a slice come before its texts
                        matcher, words = Matcher(words), []
                    yield matcher, row, text

        return _scanned(each())

    return met.mapInArrow(meet, FOUND)

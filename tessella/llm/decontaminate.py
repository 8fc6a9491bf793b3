"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Windows of an item's number of words slide over every document one word at a time. A window can
reach the similarity only if enough of its shingles are shingles of items of that size; windows
that cannot are skipped, which loses no match. The others get a SimHash fingerprint. Cut into
radius + 1 blocks, two fingerprints within the radius agree on one block at least, so an equality
join on (size, block, value) finds all of them. An item that shares enough shingles with a window
although its fingerprint lies beyond the radius is named by the task that reads the window, so
the radius loses no match. Candidates are then compared by their exact weighted shingles. A benchmark over `slice_shingles` is taken in slices of that
size, one pass each, so what a pass broadcasts is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .wordhash import Words, majority

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
#: Shingles of windows that are fingerprinted at once, and bytes of windows that leave a task at once.
PIECE_SHINGLES, PIECE_BYTES = 1 << 18, 1 << 22

def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode()


def weighted_similarity(a: str, b: str, k: int) -> float:
    """Weighted Jaccard of the k-word shingles of two word strings; a shingle weighs its count."""
    count = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    x, y = count(a.split()), count(b.split())
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


class Items:
    """Benchmark items grouped by number of words, as tasks need them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        ids = [i for i, _ in rows]
        words = Words([_lower(t) for _, t in rows])
        sizes = words.upto - words.first
        self.rows, by, rows = [], {}, {}
        for i, (size, first) in enumerate(zip(sizes.tolist(), words.first.tolist(), strict=True)):
            if size:
                k = min(SHINGLE, size)
                one = words.shingles(k)[first : first + size - k + 1]
                fp = int(majority(one, np.array([len(one)]))[0])
                self.rows.append((ids[i], size, fp, words.text(first, size)))
                by.setdefault((k, size), []).append(np.unique(one))
                rows.setdefault((k, size), []).append(np.full(len(by[k, size][-1]), len(self.rows) - 1))
        self.classes = {key: np.unique(np.concatenate(v)) for key, v in by.items()}
        # For each class the rows of the items that hold each of its shingles, and where a shingle's rows begin.
        self.holders = {}
        for key, v in by.items():
            every = np.concatenate(v)
            self.holders[key] = np.concatenate(rows[key])[np.argsort(every, kind="stable")], np.searchsorted(np.sort(every), self.classes[key])
        self.prints = np.array([fp for _, _, fp, _ in self.rows], np.uint64)
        self.shingles = {k: np.unique(np.concatenate([v for (kk, _), v in self.classes.items() if kk == k])) for k in {k for k, _ in self.classes}}


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _windows(items: Items, threshold: float, radius: int):
    bits = np.uint64(44)
    seen = {}
    for k, values in items.shingles.items():
        seen[k] = np.zeros(1 << 20, bool)
        seen[k][values >> bits] = True

    def beyond(key: tuple[int, int], sh: np.ndarray, at: np.ndarray, first: int, m: int, least: int, prints: dict[int, int]) -> Iterator[tuple[int, int]]:
        """(start, item row): items with `least` shingles or more in a window, their fingerprint beyond the radius."""
        members, (holders, begin) = items.classes[key], items.holders[key]
        end = np.append(begin[1:], len(holders))
        for s, fp in prints.items():  # one window at a time bounds the memory
            inside = at[np.searchsorted(at, first + s) : np.searchsorted(at, first + s + m)]
            which = np.searchsorted(members, sh[inside])
            n = end[which] - begin[which]
            rows, shared = np.unique(holders[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_counts=True)
            rows = rows[shared >= least]
            yield from ((s, i) for i in rows[np.bitwise_count(items.prints[rows] ^ np.uint64(fp)) > radius].tolist())

    def of(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, str, int | None]]:
        """(text, start, item size, fingerprint, words, None) of every window that may reach the similarity; the same with an item's row where that lies beyond the radius."""
        words = Words(texts)
        for k, values in items.shingles.items():
            sh = words.shingles(k)
            maybe = np.flatnonzero(seen[k][sh >> bits])
            hits = maybe[_member(sh[maybe], values)]
            owner = np.searchsorted(words.upto, hits, side="right")
            hits, owner = hits[hits + k <= words.upto[owner]], owner[hits + k <= words.upto[owner]]
            for d in np.unique(owner).tolist():
                first, n = int(words.first[d]), int(words.upto[d] - words.first[d])
                mine = hits[owner == d]
                for (kk, size), members in items.classes.items():
                    if kk != k:
                        continue
                    m_item, m = size - k + 1, min(size, n) - k + 1
                    least = math.ceil(threshold * (m + m_item) / (1 + threshold) - 1e-9)
                    if least > m or len(mine) < least:
                        continue
                    at = mine[_member(sh[mine], members)]
                    flags = np.zeros(n - k + 2, np.int64)
                    flags[at - first + 1] = 1
                    total = np.cumsum(flags)
                    every = np.flatnonzero(total[m:] - total[: len(total) - m] >= least)
                    for starts in np.split(every, range(0, len(every), max(1, PIECE_SHINGLES // m))[1:]):
                        if not len(starts):
                            continue
                        runs = np.concatenate([sh[first + s : first + s + m] for s in starts.tolist()])
                        prints = majority(runs, np.full(len(starts), m))
                        fps = dict(zip(starts.tolist(), prints.tolist(), strict=True))
                        for s, fp in fps.items():
                            yield d, s, size, fp, words.text(first + s, min(size, n)), None
                        for s, i in beyond((kk, size), sh, at, first, m, least, fps):
                            yield d, s, size, fps[s], words.text(first + s, min(size, n)), i

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        cols[3] = np.array(cols[3], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "size", "fp", "words", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = part.column(0).to_pylist()
                found, held = [], 0
                for row in of([_lower(t) for t in part.column(1).to_pylist()]):
                    found.append((ids[row[0]], *row[1:]))
                    held += len(row[4]) + 100
                    if held > PIECE_BYTES:
                        yield rows_of(found)
                        found, held = [], 0
                yield rows_of(found)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, radius: int = RADIUS, slice_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, similarity, start, n_windows: every document-item pair with a window at `threshold` or more.

    similarity and start are of the best window (first of equals, in words); n_windows counts
    the windows that reach the threshold. A text shorter than an item is one window. Items of
    fewer than five words have one shingle of all their words; items without words match
    nothing. Null texts are empty; a null item id is kept as null. Repeated document rows with
    one id are one document here; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / 4 / slice_shingles))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    blocks = lambda fp: F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(cut, cut[1:], strict=False)])

    @F.pandas_udf(DoubleType())
    def similarity(a, b):  # noqa: ANN001, ANN202
        return a.combine(b, lambda x, y: weighted_similarity(x, y, min(SHINGLE, len(y.split()))))

    found = None
    for s in range(slices):
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        items = Items([(r[0], r[1]) for r in mine.collect()])  # a slice of bounded size
        if not items.rows:
            continue
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        known = spark.createDataFrame([(i, n, signed(fp), t, row) for row, (i, n, fp, t) in enumerate(items.rows)], "item_id long, size int, item_fp long, item_words string, row long")
        # One block more than the fingerprint has: the item's row, for windows that name it.
        known = known.select("*", F.posexplode(F.concat(blocks("item_fp"), F.array("row"))).alias("block", "value"))
        windows = source.mapInArrow(_windows(items, threshold, radius), "doc_id long, start long, size int, fp long, words string, item long")
        named = F.concat(F.array_repeat(F.lit(None).cast("long"), radius + 1), F.array("item"))
        keyed = windows.select("*", F.posexplode(F.when(F.col("item").isNull(), blocks("fp")).otherwise(named)).alias("block", "value"))
        near = keyed.join(F.broadcast(known), ["size", "block", "value"])
        differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
        first_equal = F.array_position(blocks(differ), F.lit(0).cast("long")) == F.col("block") + 1
        near = near.where((F.col("block") > radius) | (first_equal & (F.bit_count(differ) <= radius)))
        part = near.select("doc_id", "item_id", "start", similarity("words", "item_words").alias("similarity")).where(F.col("similarity") >= threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start long, n_windows long")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    pairs = found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count("*").alias("n_windows"))
    return pairs.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), "n_windows")

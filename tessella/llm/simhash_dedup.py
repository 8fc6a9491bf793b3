"""SimHash near-dedup with BK-trees over shards of distinct fingerprints.

Two fingerprints within `radius` bits agree on at least blocks - radius of `blocks` equal
slices, so every linked pair meets in a shard keyed by one choice of slices. A shard's distinct
fingerprints form a BK-tree (children keyed by the integer Hamming distance to their parent) and
each fingerprint follows only the edges within the radius. A shard of more than `shard_cap`
fingerprints (a big group of near copies) is cut again: the bits that its members do not share
yet are sliced in turn, until eight bits or fewer are left and 256 values fill a shard. So every
link is found by a tree, and no tree is larger than that. A broadcast of all shard trees would
grow with the corpus; they travel to their queries by the shard key instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, star_components
from .wordhash import majority

SEED, SHINGLE = 42, 3


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `size` words (all words if there are fewer); no words: no hashes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, seed)]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - size + 1].tolist()
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, hashes, sizes, held = [], [], [], 0
        for text in [*batch.column(1), None]:
            last = text is None
            if last or held > 400_000:
                prints.append(majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
                hashes, sizes, held = [], [], 0
            if not last:
                got = shingle_hashes((text.as_py() or "").encode())
                hashes += got
                sizes.append(len(got))
                held += len(got)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row; null and blank texts have 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree of 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (nxt := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = nxt

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within `radius`; only edges d - radius .. d + radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            todo += [edges[e] for e in range(max(0, d - radius), d + radius + 1) if e in edges]
        return found


def _shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values: (value, smallest value of its part)."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):  # ascending, so a smaller position is a smaller value
        for j in tree.near(v, radius):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values, out = None, [], []
        mask = (1 << 64) - 1
        signed = lambda v: v - (1 << 64) if v >> 63 else v

        def close() -> None:
            if len(values) > 1:
                out.extend(_shard_links(values, radius))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([signed(x[i]) for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])
            out.clear()
            return made

        for batch in batches:
            for key, fp in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if key != shard:
                    close()
                    shard, values = key, []
                values.append(fp & mask)
            yield flush()
        close()
        yield flush()

    return run


def _choices(fixed: int, radius: int, blocks: int) -> list[int]:
    """Bit masks that hold the `fixed` bits and one choice of blocks - radius equal slices of the others."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cut = [round(len(free) * i / blocks) for i in range(blocks + 1)]
    slices = [sum(1 << b for b in free[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    return [fixed | sum(c) for c in combinations(slices, blocks - radius)]


def links(prints: DataFrame, radius: int = 2, blocks: int = 4, shard_cap: int = 256) -> DataFrame:
    """src, dst: links among distinct fingerprints (`prints`: fp) that join exactly those connected within `radius`."""
    if not 0 <= radius < blocks:
        raise ValueError("radius is less than blocks and not below 0")
    long = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    rows, masks, found, last = prints.select("fp", F.lit(0).alias("choice")), [0], None, False
    while not last:
        per = len(_choices(0, radius, blocks))
        masks = [m for fixed in masks for m in _choices(fixed, radius, blocks)]
        last = max(64 - m.bit_count() for m in masks) <= 8 or radius == 0
        mask = F.get(F.array(*[long(m) for m in masks]), F.col("choice"))
        keyed = rows.select("fp", F.explode(F.sequence(F.col("choice") * per, F.col("choice") * per + per - 1)).alias("choice"))
        keyed = keyed.withColumn("slice", F.col("fp").bitwiseAND(mask))
        if last:
            met = small = keyed
        else:
            sizes = keyed.groupBy("choice", "slice").agg(F.count("*").alias("n")).where("n > 1")
            met = checkpointed(keyed.join(sizes, ["choice", "slice"]))
            small = met.where(F.col("n") <= shard_cap)
        small = small.select("choice", "slice", "fp").repartition("choice", "slice").sortWithinPartitions("choice", "slice", F.col("fp") < 0, "fp")
        trees = small.mapInArrow(_tree_links(radius), "src long, dst long")
        found = trees if found is None else found.unionByName(trees)
        if not last:
            rows = met.where(F.col("n") > shard_cap).select("fp", "choice")
            last = rows.isEmpty()
    return found.where("src <> dst").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int = 4, shard_cap: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per input row.

    Rows link when their fingerprints differ in at most `radius` bits; component_id is the
    smallest id reachable. Null, empty and blank texts have fingerprint zero and link like any
    other. Repeated rows share a component; a null id gets the component of its fingerprint
    and never names one unless all ids there are null. A bit set in exactly half the shingles is
    0. Texts are read whole, however long. Only the two named columns are read, so others may
    have any name. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = star_components(links(distinct.select("fp"), radius, blocks, shard_cap))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Exact dedup by an extendible-hash index on shared files.

1. Each input task deletes white space from its texts, collapses equal texts of a batch to one
   entry and writes entries (64-bit pseudo-key, length, compressed bytes) to the shared folder.
2. Entry counts by key prefix give the directory: starting from one bucket it doubles while a
   bucket holds more than `capacity` entries. A bucket that the last bit cannot split (one
   text, many entries) gets overflow pages instead.
3. Each (bucket, page) is a key range with one owner. Owners read it in key order, chain the
   entries of a key and compare their bytes; two texts with one key stay two chain entries.
   Chains of different overflow pages are merged by a second, small pass over their leaders.

No task ever holds more than one batch and the distinct texts of one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, shared_table

ENTRY = "uid long, doc_id long, n_cp long, key long, text_sha256 string, rep_uid long, body binary, cnt long, best_cp long, best_doc long"
LINK = "uid long, leader long, key long, cnt long, best_cp long, best_doc long, body binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId() << 40, 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        seen: dict[bytes, int] = {}
        n = len(ids)
        uid = [part + row + i for i in range(n)]
        row += n
        cps, keys, shas, reps, bodies = [0] * n, [0] * n, [""] * n, [0] * n, [None] * n
        cnt, best = [0] * n, [None] * n
        for i in range(n):
            raw = texts[i].as_py()
            raw = b"" if raw is None else raw.encode()
            body = raw.translate(None, SPACES)
            cps[i] = len(raw) if raw.isascii() else len(raw.decode())
            r = seen.setdefault(body, i)
            mine = (-cps[i], ids[i] is None, ids[i])
            if r == i:
                keys[i] = np.uint64(xxhash.xxh64_intdigest(body)).astype(np.int64)
                shas[i] = hashlib.sha256(body).hexdigest()
                bodies[i] = squeeze(body)
                best[i] = mine
            else:
                keys[i], shas[i] = keys[r], shas[r]
                best[r] = min(best[r], mine)
            cnt[r] += 1
            reps[i] = uid[r]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(uid, pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(cps, pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(reps, pa.int64()),
                pa.array(bodies, pa.binary()),
                pa.array(cnt, pa.int64()),
                pa.array([b and -b[0] for b in best], pa.int64()),
                pa.array([b and b[2] for b in best], pa.int64()),
            ],
            names=["uid", "doc_id", "n_cp", "key", "text_sha256", "rep_uid", "body", "cnt", "best_cp", "best_doc"],
        )


def directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and number of overflow pages for each slot of a directory of 2**depth slots.

    counts: entries by key prefix, in prefix order. The directory starts with one bucket and
    doubles; at each doubling the buckets over `capacity` are split by one more bit.
    """
    depth = int(np.log2(len(counts)))
    local = np.zeros(1, np.int64)
    for d in range(depth):
        full = counts.reshape(1 << d, -1).sum(1) > capacity
        local = np.repeat(np.where(full & (local == d), d + 1, local), 2)
    slots = np.arange(1 << depth)
    bucket = (slots >> (depth - local)) << (depth - local)
    held = np.zeros(1 << depth, np.int64)
    np.add.at(held, bucket, counts)
    return bucket, np.maximum(1, -(-held[bucket] // capacity))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: uid, key, cnt, best_cp, best_doc, body -> LINK, a body for leaders only."""
    key, chain = None, []
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keys, uids, leaders, bodies = cols["key"].to_pylist(), cols["uid"].to_pylist(), [], []
        for i, (k, u) in enumerate(zip(keys, uids, strict=True)):
            if k != key:
                key, chain = k, []
            body = cols["body"][i].as_py()
            leader = next((x for x, b in chain if b == body), None)
            if leader is None and chain:  # another compression of equal bytes, or a collision
                plain = zstandard.decompress(body)
                leader = next((x for x, b in chain if zstandard.decompress(b) == plain), None)
            if leader is None:
                chain.append((u, body))
            leaders.append(u if leader is None else leader)
            bodies.append(body if leader is None else None)
        yield pa.RecordBatch.from_arrays(
            [cols["uid"], pa.array(leaders, pa.int64()), cols["key"], cols["cnt"], cols["best_cp"], cols["best_doc"], pa.array(bodies, pa.binary())],
            names=["uid", "leader", "key", "cnt", "best_cp", "best_doc", "body"],
        )


def _owned(rows: DataFrame, *by: str) -> DataFrame:
    cols = ["uid", "key", "cnt", "best_cp", "best_doc", "body"]
    return rows.repartition(*by).sortWithinPartitions("key", "uid").select(*cols).mapInArrow(_chains, LINK)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, max_depth: int = 20) -> DataFrame:
    """Groups of equal texts -> doc_id, keep_id, group_size, kept, text_sha256, n_cp.

    Texts are equal when identical without the six ASCII white-space characters; a null text
    is an empty one, and all blank texts form one group. The row with the most code points
    stays, then the one with the smallest id. One row per input row: rows that repeat an id
    and text are members of one group and, if that id stays, are all marked kept. A null id
    loses ties against any other. An empty table gives no rows; other columns are ignored. Texts
    are compared whole, however long. The directory, which is broadcast, has 2**max_depth slots
    (12 MB) at most; a larger corpus gets larger buckets instead.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    entries = shared_table(source.mapInArrow(_entries, ENTRY), "exact-index")
    reps = entries.where("cnt > 0")

    total = reps.count()
    capacity = max(capacity, total >> (max_depth - 2))
    depth = int(min(max_depth, max(4, np.ceil(np.log2(max(1, total / capacity))) + 3)))
    slot = F.shiftrightunsigned("key", 64 - depth).cast("int")
    counts = np.zeros(1 << depth, np.int64)
    for r in reps.groupBy(slot.alias("slot")).count().toLocalIterator():  # at most 2**max_depth rows
        counts[r["slot"]] = r["count"]
    bucket, pages = directory(counts, capacity)
    held = np.flatnonzero(counts)
    index = docs.sparkSession.createDataFrame(pa.table({"slot": held, "bucket": bucket[held], "pages": pages[held]})).selectExpr("int(slot) slot", "int(bucket) bucket", "int(pages) pages")

    placed = reps.withColumn("slot", slot).join(F.broadcast(index), "slot").withColumn("page", F.pmod("uid", "pages"))
    first = _owned(placed, "bucket", "page")
    if (pages > 1).any():
        first = shared_table(first, "exact-chains")
        spread = F.broadcast(index.where("pages > 1").select("slot"))
        leaders = first.where("uid = leader").withColumn("slot", slot).join(spread, "slot", "left_semi")
        merged = _owned(leaders.select("uid", "key", F.lit(0).cast("long").alias("cnt"), "best_cp", "best_doc", "body"), "key")
        merged = merged.select(F.col("uid").alias("page_leader"), F.col("leader").alias("top"))
        links = first.drop("body").join(merged, first["leader"] == merged["page_leader"], "left")
        links = links.select("uid", F.coalesce("top", "leader").alias("leader"), "cnt", "best_cp", "best_doc")
    else:
        links = first.drop("body", "key")
    links = shared_table(links, "exact-links")

    best = F.min(F.struct((-F.col("best_cp")).alias("a"), F.col("best_doc").isNull().alias("b"), F.col("best_doc").alias("doc")))
    groups = links.groupBy("leader").agg(F.sum("cnt").alias("group_size"), best["doc"].alias("keep_id"))
    found = links.select(F.col("uid").alias("rep_uid"), "leader").join(groups, "leader").drop("leader")
    return entries.select("doc_id", "n_cp", "text_sha256", "rep_uid").join(found, "rep_uid").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_cp"
    )

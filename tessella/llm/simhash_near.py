"""Near-duplicate groups by SimHash, BK-trees and exact five-word shingles (similarity 0.8 or more).

At that similarity fingerprints (of 128 bits here) differ in 20 bits or so, too many for equal slices to bring a
pair together. Shards are therefore made of what such a pair must share: in any fixed order of
all shingles, two texts of similarity s have a common shingle among the first n - ceil(s n) + 1 of
each. The order here goes by how common a shingle is (the rarest first), then by hash, so a line
that many documents hold joins only documents that consist of such lines. Among the documents of
a shingle each fingerprint searches a BK-tree, following only edges within the radius; short texts, whose
fingerprints scatter, meet all of fitting size instead. What is connected by such links is a
shard. In a shard every pair of fitting size is compared by exact shingle sets unless both are already
in one group. Shards over `shard_cap` documents or
`shard_bytes` of text are dealt out at random in pieces of that size, twice, which joins a large
group of near copies in linear work. What is not in a shard's largest group by then is dealt out
once more, to meet every piece of the shard: every pair that is not connected yet is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined_by_key, shared_table, star_components
from .wordhash import NOT_SPACE, Words, batches_of, majority

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 46
#: Pairs of at most so many shingles are brought together whatever their distance.
PLAIN_SIZE = 32
#: Size in bits of the fixed table of common shingles, and how many are looked at.
COMMON_BITS, COMMON_MAX = 24, 100_000


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text has one, of all its words."""
    out = []
    for part in batches_of(texts):
        words = Words([t.lower() for t in texts[part]], NOT_SPACE)
        by_size: dict[int, np.ndarray] = {}
        for first, end in zip(words.first.tolist(), words.upto.tolist(), strict=True):
            k = min(SHINGLE, end - first)
            if k not in by_size and k:
                by_size[k] = words.shingles(k)
            out.append(np.unique(by_size[k][first : end - k + 1]) if k else np.zeros(0, np.uint64))
    return out


def _encoded(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").encode() for x in column]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of at most 1,000 rows and, but for a single longer text, 1 MB."""
    for batch in batches:
        ids, texts = np.asarray(batch.column(0)).astype(np.int64), _encoded(batch.column(1))
        yield from ((ids[part], texts[part]) for part in batches_of(texts))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that stand out within a part: held by 3 and by one in 200 of its documents or more."""
    for _, texts in _parts(batches):
        values, counts = np.unique(np.concatenate([*shingle_sets(texts), np.zeros(0, np.uint64)]), return_counts=True)
        keep = counts >= max(3, len(texts) // 200)
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["h", "n"])


def _keys(level: np.ndarray, similarity: float):
    """(key, id, n, low, fp, fp2): a row for each document and prefix shingle, with its fingerprint and set size.

    level: by the leading bits of a shingle, 0 or how common it is. A common shingle gives one
    row of a part, with n = -1, and links of its other documents to that one (low).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            order = np.argsort(ids, kind="stable")
            sets = shingle_sets([texts[i] for i in order])
            ids, sizes = ids[order], np.array([len(s) for s in sets], np.int64)
            prints = fingerprints(np.concatenate([*sets, np.zeros(0, np.uint64)]), sizes).view(np.int64)
            keys, hot = [], []
            for s in sets:
                late = level[(s >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]
                first = np.argsort(late, kind="stable")  # the rarest first, then by hash
                most = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
                keys.append(s[first[:most]])
                hot.append(late[first[:most]] > 0)
            owner = np.repeat(np.arange(len(sets)), [len(k) for k in keys])
            key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            hot = np.concatenate([*hot, np.zeros(0, bool)]).astype(bool)
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            again = hot & (first[back] != np.arange(len(key)))
            links = np.unique(np.stack([ids[owner[again]], ids[owner[first[back[again]]]]]), axis=1)
            links = links[:, links[0] != links[1]]
            row, k = ~again, links.shape[1]
            none = np.zeros(k, np.int64)
            low = pa.array(np.concatenate([np.zeros(row.sum(), np.int64), links[1]]), mask=np.arange(row.sum() + k) < row.sum())
            n = np.where(hot, -1, sizes[owner])[row]
            halves = [pa.array(np.concatenate([prints[owner[row], j], none])) for j in range(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[row], links[0]])), pa.array(np.concatenate([ids[owner[row]], links[0]])), pa.array(np.concatenate([n, none]).astype(np.int32)), low, *halves], names=["key", "id", "n", "low", "fp", "fp2"]
            )

    return run


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each run of hashes, as two columns: the SimHash of the hashes and of the hashes mixed again."""
    again = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.stack([majority(hashes, sizes), majority(again ^ (again >> np.uint64(32)), sizes)], axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints (rows)."""
    return np.bitwise_count(a ^ b).astype(np.int64).sum(axis=-1)


def bk_visit(prints: np.ndarray, radius: int, visit) -> None:
    """Search a BK-tree of `prints` for all of them at once.

    A node keeps the rest of its branch in children keyed by Hamming distance to it; the
    fingerprints searched for go down together, each only along edges within `radius` of its own
    distance. visit(node, positions) gets every node with all positions within the radius.
    """
    todo = [(np.arange(len(prints)), np.arange(len(prints)))] if len(prints) else []
    while todo:
        branch, asked = todo.pop()
        node, rest = branch[0], branch[1:]
        d = distance(prints[asked], prints[node])
        visit(int(node), asked[d <= radius])
        if len(rest):
            edge = distance(prints[rest], prints[node])
            order = np.argsort(edge, kind="stable")
            cuts = np.flatnonzero(np.diff(edge[order])) + 1
            for child in np.split(rest[order], cuts):
                e = int(distance(prints[child[0]], prints[node]))
                down = asked[np.abs(d - e) <= radius]
                if len(down):
                    todo.append((child, down))


def _similar_size(a: np.ndarray, b: int | np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


class Labels:
    """Smallest position connected to each position so far. known: positions of equal values are connected already."""

    def __init__(self, n: int, known: np.ndarray | None = None) -> None:
        self.label = np.arange(n)
        if known is not None and n:
            _, first, back = np.unique(known, return_index=True, return_inverse=True)
            self.label = first[back]

    def merge(self, found: np.ndarray) -> None:
        names = np.unique(self.label[found])
        if len(names) > 1:
            self.label[np.isin(self.label, names[1:])] = names[0]


def near_labels(prints: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Smallest position connected to each position by links of fitting sizes that are within the radius or of PLAIN_SIZE shingles at most."""
    known = Labels(len(prints))

    def visit(i: int, found: np.ndarray) -> None:
        found = found[(known.label[found] != known.label[i]) & _similar_size(sizes[found], sizes[i], similarity)]
        known.merge(np.append(found, i))

    bk_visit(prints, radius, visit)
    short = np.flatnonzero(sizes <= PLAIN_SIZE)
    short = short[np.argsort(sizes[short], kind="stable")]  # where two sizes fit, those between them do
    for i in np.flatnonzero(_similar_size(sizes[short[1:]], sizes[short[:-1]], similarity)).tolist():
        known.merge(short[i : i + 2])
    return known.label


def _meet(similarity: float, radius: int, cap: int):
    """Rows sorted by key and id -> links that connect what is near among the documents of a key.

    A key with common rows or over `cap` documents links all of them to the first: more than
    needed, so nothing is lost, and the exact comparison comes later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)]
        empty = [h.copy() for h in held]

        def links(rows: list[np.ndarray]) -> tuple[list, list]:
            key, ids, sizes, prints = rows
            src, dst = [], []
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            length = np.diff(np.append(begin, len(key)))
            two = begin[length == 2]
            plain = (sizes[two] < 0) | (sizes[two + 1] < 0)
            near = (distance(prints[two], prints[two + 1]) <= radius) | (np.maximum(sizes[two], sizes[two + 1]) <= PLAIN_SIZE)
            near &= _similar_size(sizes[two], sizes[two + 1], similarity)
            two = two[plain | near]
            src.append(ids[two + 1])
            dst.append(ids[two])
            for b, n in zip(begin[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                at = slice(b, b + n)
                label = np.zeros(n, np.int64) if n > cap or sizes[at].min() < 0 else near_labels(prints[at], sizes[at], radius, similarity)
                src.append(ids[at][label != np.arange(n)])
                dst.append(ids[at][label[label != np.arange(n)]])
            return src, dst

        def batch_of(src: list, dst: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64()) for x in (src, dst)], names=["src", "dst"])

        for batch in batches:
            made = np.asarray(batch.column(3).is_valid())
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            cols.append(np.stack([np.asarray(batch.column(i)) for i in (4, 5)], axis=1).view(np.uint64))
            rows = [np.concatenate([h, c[~made].astype(h.dtype)]) for h, c in zip(held, cols, strict=True)]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            src, dst = links([r[:last] for r in rows])
            held = [r[last:] for r in rows]
            if len(held[0]) > cap:
                src.append(held[1][1:])
                dst.append(np.full(len(held[1]) - 1, held[1][0]))
                held = [h[:1].copy() for h in held]
                held[2][:] = -1
            src.append(cols[1][made])
            dst.append(np.asarray(batch.column(3).drop_null()))
            yield batch_of(src, dst)
        yield batch_of(*links(held if len(held[0]) else empty))

    return run


def verified_links(ids: list[int], sets: list[np.ndarray], similarity: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, smallest id of its group) within one piece: all pairs at the similarity are connected, by exact shingle sets.

    known: documents of equal values are in one group already and are not compared.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)

    # Postings of the piece: one document's overlaps with all others are counted at once.
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    held = np.bincount(term)
    begin = np.cumsum(held) - held
    posted, first = owner[np.argsort(term, kind="stable")], np.cumsum(sizes) - sizes

    groups = Labels(len(sets), None if known is None else np.array([known[i] for i in order]))
    for i in range(len(sets)):
        found = np.flatnonzero((groups.label != groups.label[i]) & _similar_size(sizes, sizes[i], similarity))
        if not len(found) or not sizes[i]:
            continue
        terms = term[first[i] : first[i] + sizes[i]]
        n = held[terms]
        both = np.bincount(posted[np.repeat(begin[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))[found]
        groups.merge(np.append(found[both >= similarity * (sizes[i] + sizes[found] - both) - 1e-9], i))
    return [(ids[i], ids[k]) for i, k in enumerate(groups.label.tolist()) if k != i and ids[i] != ids[k]]


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(_encoded(table.column("text").combine_chunks()))
        found = verified_links(table.column("id").to_pylist(), sets, similarity, table.column("known").to_pylist())
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return run


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, shard_cap: int = 2000, shard_bytes: int = 2_000_000
) -> DataFrame:
    """id, component_id of every document that has a near copy; component_id is the smallest id of its group.

    Words are split at ASCII white space with A-Z lower-cased; similarity is the Jaccard of
    distinct five-word shingles (a shorter text: one shingle of all words). Links at
    `similarity` or more are followed to their ends. Shingles in common bring every such pair
    together; of pairs with more than PLAIN_SIZE shingles the tree loses those whose fingerprints differ in more than
    `radius` of 128 bits: at similarity 0.8 the distance is 19.3 bits on average and over 46 for fewer than one pair in 10^8
    (radius 128 compares all). Blank and null texts and rows
    without an id are in no group; rows that repeat an id count as one document by any of
    their texts. Equal texts are in one group, and ties need no order: the smallest id names a
    group. Texts are read whole; a piece of a shard holds about `shard_bytes` of text or one
    longer text. Only the two named columns are read. No groups give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    often = rows.mapInArrow(_common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON_MAX)
    top = often.collect()  # COMMON_MAX at most
    at = (np.array([r["h"] for r in top], np.int64).view(np.uint64) >> np.uint64(64 - COMMON_BITS)).astype(np.int32)
    how = np.array([r["n"].bit_length() for r in top], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast((at, how))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.zeros(1 << COMMON_BITS, np.uint8)
        np.maximum.at(level, *shared.value)
        return _keys(level, similarity)(batches)

    met = rows.mapInArrow(keys, "key long, id long, n int, low long, fp long, fp2 long").repartition("key").sortWithinPartitions("key", "id")
    met = met.mapInArrow(_meet(similarity, radius, shard_cap), "src long, dst long")
    roots = star_components(met).withColumnRenamed("node", "id")
    texts = shared_table(rows.join(roots, "id").withColumn("size", F.octet_length("text").cast("long")), "near-texts")
    pieces = F.ceil(F.greatest(F.count("*") / shard_cap, F.sum("size") / shard_bytes)).cast("int")
    sizes = texts.groupBy("root").agg(F.count("*").alias("held"), pieces.alias("pieces"))
    total = texts.count()
    shards = checkpointed(joined_by_key(roots, sizes, "root", "held", total).select("id", "root", "held", "pieces", F.col("id").alias("known")))
    texts = texts.select("id", "text")

    def compared(dealt: DataFrame) -> DataFrame:
        """Links found within the pieces (id, root, known, a, b)."""
        dealt = texts.join(dealt, "id").select("id", "text", "root", "known", "a", "b")
        return dealt.groupBy("root", "a", "b").applyInArrow(_verify(similarity), "src long, dst long")

    def piece(of: str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id"), of).cast("int")

    links = compared(shards.select("id", "root", "known", piece("pieces", 1).alias("a"), F.lit(0).alias("b")))
    large = shards.where("pieces > 1")
    if not large.isEmpty():
        links = checkpointed(links.unionByName(compared(large.select("id", "root", "known", piece("pieces", 2).alias("a"), F.lit(1).alias("b")))))
        # What two random deals joined is settled; the largest group of a shard need not meet itself again.
        groups = star_components(links).withColumnsRenamed({"node": "id", "root": "group"})
        large = checkpointed(large.join(groups, "id", "left").withColumn("known", F.coalesce("group", "id")).drop("group"))
        held = large.groupBy("root", "known").agg(F.count("*").alias("n"))
        most = held.groupBy("root").agg(F.max_by("known", F.struct("n", "known")).alias("most"), F.sum("n").alias("whole"), (F.sum("n") - F.max("n")).alias("others"))
        large = joined_by_key(large, most, "root", "whole", total).where("others > 0")
        large = checkpointed(large.withColumn("rest", F.ceil(F.col("others") * F.col("pieces") / F.col("whole")).cast("int")))
        minor = F.col("known") != F.col("most")
        mine = large.where(minor).select("id", "root", "known", piece("rest", 3).alias("a"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("b"))
        all_ = large.select("id", "root", "known", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("a"), piece("pieces", 4).alias("b"), minor.alias("minor"), piece("rest", 3).alias("own"))
        all_ = all_.where("not (minor and a = own)").select("id", "root", "known", "a", "b")
        links = links.unionByName(compared(mine.unionByName(all_)))
    return star_components(links).select(F.col("node").alias("id"), F.col("root").alias("component_id"))

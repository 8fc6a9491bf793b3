"""Links of a graph in parts that work on arrays, for the rounds of graph.louvain.

A part is one row: the links of a range of nodes, sorted, as arrays. In a round each node sends its
label once to every part that sees it, so labels move and links do not. Parts are ranges of ids because ids made together
are often linked together, and then few parts see a node; where they are not, a part sees more nodes and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import checkpointed, placed

PART = "slot int, own binary, seen binary, start binary, at binary, w binary"
WISH = "code long, d double, home long, to long, more double"
#: Labels that leave a task in one go.
SENT = 500_000


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v, w) of one task as one row of PART: own nodes, all nodes seen, where the links of each own node start, at which seen node they end."""
    read = [[b.column(c).to_numpy(zero_copy_only=False) for c in "uvw"] for b in batches]
    if not sum(len(x[0]) for x in read):
        return
    u, v, w = (np.concatenate(x) for x in zip(*read))
    order = np.lexsort((v, u))
    u, v, w = u[order], v[order], w[order]
    own, start = np.unique(u, return_index=True)
    seen = np.unique(np.concatenate([own, v]))
    arrays = own, seen, np.append(start, len(u)), np.searchsorted(seen, v).astype(np.int32), w
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["slot", "own", "seen", "start", "at", "w"])


def _seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seen in zip(b.column("part").to_pylist(), b.column("seen")):
            codes = np.frombuffer(seen.as_buffer(), np.int64)
            for i in range(0, len(codes), SENT):
                piece = codes[i : i + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.full(len(piece), part, np.int32))], names=["code", "part"])


def part_keys(spark: SparkSession, parts: int) -> list[int]:
    """A key for each part, chosen so that a shuffle by key to as many tasks gives each its own."""
    k = spark.range(30 * parts + 100).select(F.col("id").cast("int").alias("k"))
    found = {r["slot"]: r["k"] for r in k.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("slot")).agg(F.min("k").alias("k")).collect()}
    return [found.get(i, -1 - i) for i in range(parts)]


class Parts:
    """links: u, v, w (long, long, double), each link both ways; all links of one u lie in one part."""

    def __init__(self, links: DataFrame, parts: int) -> None:
        spark = links.sparkSession
        keys = F.array(*[F.lit(k) for k in part_keys(spark, parts)])
        # Written before it is dealt out again: ranges are made from a sample.
        packed = checkpointed(links.repartitionByRange(parts, "u").mapInArrow(_packed, PART))
        self.parts, self.packed = parts, placed(packed.withColumn("part", F.element_at(keys, F.col("slot") + 1)).drop("slot"), "part", parts)
        self.places = checkpointed(self.packed.select("part", "seen").mapInArrow(_seen, "code long, part int").groupBy("code").agg(F.sort_array(F.collect_list("part")).alias("parts")))

    def _met(self, labels: DataFrame, names: list[str], columns: list[str], work, schema: str) -> DataFrame:  # noqa: ANN001
        """work(part's row, labels by seen node) for each part that gets a label. labels: code and `names`, 8 bytes each."""
        sent = labels.join(self.places, "code").select("parts", "code", *names).mapInArrow(_sender(["code", *names]), "part int, body binary").repartition(self.parts, "part")
        return self.packed.select("part", *columns).groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(_worker(1 + len(names), work), schema)

    def wishes(self, known: DataFrame, twice: float, least_gain: float) -> DataFrame:
        """WISH rows: nodes that gain by more than `least_gain` if they move. known: code, c, t, d of every node with links."""
        return self._met(known, ["c", "t", "d"], ["own", "seen", "start", "at", "w"], _wishes(twice, least_gain), WISH)

    def unbeaten(self, bids: DataFrame) -> DataFrame:
        """code: those of `bids` (code, bid) whose neighbours all bid less or nothing."""
        return self._met(bids, ["bid"], ["own", "seen", "start", "at"], _unbeaten, "code long")


def _sender(names: list[str]):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            to = b.column("parts")
            values = [b.column(c).to_numpy(zero_copy_only=False).view(np.int64) for c in names]
            held.append((to.value_lengths().to_numpy(zero_copy_only=False), to.flatten().to_numpy(zero_copy_only=False), np.stack(values)))
            n += len(held[-1][1])
            if n >= SENT:
                yield _bodies(held)
                held, n = [], 0
        if n:
            yield _bodies(held)

    return run


def _bodies(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes, part, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held], axis=1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(part, kind="stable")
    part, row = part[order], row[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    bodies = [values[:, piece].tobytes() for piece in np.split(row, cuts)]
    return pa.RecordBatch.from_arrays([pa.array(part[np.append(0, cuts)], pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])


def _worker(k: int, work):  # noqa: ANN001, ANN202
    def run(part: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(sent):
            return pd.DataFrame()
        kinds = {"own": np.int64, "seen": np.int64, "start": np.int64, "at": np.int32, "w": np.float64}
        p = {c: np.frombuffer(part[c].iloc[0], kinds[c]) for c in part.columns if c in kinds}
        labels = np.concatenate([np.frombuffer(x, np.int64).reshape(k, -1) for x in sent["body"]], axis=1)
        return work(p, np.searchsorted(p["seen"], labels[0]), labels[1:])

    return run


def _hashed(x: np.ndarray) -> np.ndarray:
    """xxhash64(x) of Spark."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    h = np.full(len(x), 42 + 8, np.uint64) + five
    h ^= turn(x.view(np.uint64) * two, 31) * one
    h = turn(h, 27) * one + four
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _wishes(twice: float, least_gain: float):  # noqa: ANN202
    def work(p: dict[str, np.ndarray], at: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
        own, seen, start = p["own"], p["seen"], p["start"]
        label, total, degree = np.empty(len(seen), np.int64), np.empty(len(seen)), np.empty(len(seen))
        label[at], total[at], degree[at] = labels[0], labels[1].view(np.float64), labels[2].view(np.float64)
        names, first, group = np.unique(label, return_index=True, return_inverse=True)
        total, tie = total[first], -_hashed(names)
        me = np.searchsorted(seen, own)
        home, d = group[me], degree[me]
        # The weight of each node's links into each community of its neighbours.
        key = np.repeat(np.arange(len(own)), np.diff(start)) * len(names) + group[p["at"]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        u, c = np.divmod(key[begin], len(names))
        into, mine = np.add.reduceat(p["w"][order], begin), c == home[u]
        gain = into - (total[c] - np.where(mine, d[u], 0.0)) * d[u] / twice
        stay = np.zeros(len(own))
        stay[u[mine]] = np.maximum(gain[mine], 0.0)
        best = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, u[1:] != u[:-1])))
        of = np.flatnonzero(gain == best[u])
        of = of[np.lexsort((names[c[of]], tie[c[of]], u[of]))]
        last = of[np.append(u[of][1:] != u[of][:-1], True)]
        more = best - stay
        go = more > least_gain
        return pd.DataFrame({"code": own[go], "d": d[go], "home": names[home[go]], "to": names[c[last][go]], "more": more[go]})

    return work


def _unbeaten(p: dict[str, np.ndarray], at: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
    none = np.iinfo(np.int64).min
    bid = np.full(len(p["seen"]), none)
    bid[at] = labels[0]
    other = np.maximum.reduceat(bid[p["at"]], p["start"][:-1])
    me = bid[np.searchsorted(p["seen"], p["own"])]
    return pd.DataFrame({"code": p["own"][me > other]})

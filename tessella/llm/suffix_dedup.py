"""Removal of repeated 50-byte strings by a truncated, distributed difference-cover suffix sort.

A difference cover D of the residues modulo V has, for any two positions, a shift below V that
moves both into D. So two equal strings of LENGTH bytes share, at one shift, a sampled suffix
with an equal prefix of LENGTH - V + 1 bytes.

1. Sample: the suffixes at positions of the cover are named by their prefix of that length.
   Names are sorted within key ranges; a name that occurs once in the corpus ends its suffix's
   part, as a unique name ends the recursion of the full algorithm. Only prefixes of LENGTH bytes
   matter here, so one level of names suffices and no ranks beyond it are made.
2. Merge: the suffixes, sampled or not, that reach a repeated name within V bytes are sorted
   together by their LENGTH-byte prefix, again by key ranges; adjacent equal prefixes are one
   string, and all but those of the smallest document are marked.
3. Cover: each document removes the bytes under its marked strings.

Documents travel as chunks of a few MB in a bucketed table, so each phase joins its answers to
the chunks without moving text again. Between phases only packed names, prefix hashes
and bits move. A task never holds more than a chunk or a key range. Exact copies are settled
first by the digest of the whole text. Strings are equal by two hashes of different bases, 40 bits
of each and those of the key range; bytes are not compared. As ranges grow with the corpus, so
does the hash: n candidates are expected to give n / 10**18 false equalities.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_root, shared_table

LENGTH = 50
V, COVER = 21, (3, 6, 7, 12, 14)  # a perfect difference set: each residue is one difference
NAME = LENGTH - V + 1
CHUNK_BYTES, RANGE_BYTES = 2_000_000, 12_000_000
LAST = (1 << 63) - 1  # stands for a null id: after all others

_P, _SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_TABLES: dict[int, list[np.ndarray]] = {}
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> list[np.ndarray]:
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = 1 << (n - 1).bit_length()
        _TABLES[base] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(p))])) for p in (base, pow(base, -1, 1 << 64))]
    return _TABLES[base]


class Chunk:
    """Documents of one chunk in id order, with hashes of their fixed-length substrings."""

    def __init__(self, ids: list[int], lens: list[int], blob: bytes, copies: list[int] | None) -> None:
        self.ids, self.lens = np.array(ids, np.int64), np.array(lens, np.int64)
        self.raw = zstandard.decompress(blob)
        self.begin = np.cumsum(self.lens) - self.lens
        self.single = np.ones(len(ids), bool)
        self.single[copies or []] = False
        n = len(self.raw)
        self.doc = np.repeat(np.arange(len(ids)), self.lens)
        self.off = np.arange(n) - self.begin[self.doc] if n else np.zeros(0, np.int64)
        self.room = self.lens[self.doc] - self.off if n else np.zeros(0, np.int64)
        self.sums: dict[int, np.ndarray] = {}
        self.live = self.single & (self.lens >= LENGTH)

    def hashes(self, at: np.ndarray, length: int, base: int = _P) -> np.ndarray:
        """Mixed polynomial hashes in powers of `base` of the strings of a length at the positions."""
        up, down = _powers(base, max(1, len(self.raw)))
        if base not in self.sums:
            values = (np.frombuffer(self.raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(self.raw)]
            self.sums[base] = np.concatenate([[np.uint64(0)], np.cumsum(values)])
        sums = self.sums[base]
        h = (sums[at + length] - sums[at]) * down[at]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_P)
        return h ^ (h >> np.uint64(32))

    def names(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and their names of `bits` bits."""
        cover = np.zeros(V, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.off % V] & (self.room >= NAME) & self.live[self.doc]) if len(self.off) else self.off
        return at, self.hashes(at, NAME) >> np.uint64(64 - bits)

    def candidates(self, at: np.ndarray, back: np.ndarray, first: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Positions whose LENGTH-byte string reaches a repeated name.

        at: sampled positions; back, first: which distinct name each has, and the first place of each.
        """
        owners = self.doc[at]
        here = np.zeros(len(first), bool)
        here[back[owners != owners[first][back]]] = True  # in two documents of this chunk
        hit = at[(here | repeated)[back]]
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, np.maximum(hit - V + 1, self.begin[self.doc[hit]]), 1)
        np.add.at(step, hit + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.room >= LENGTH))


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of unsigned values.

    Leading bits and position are sorted as one number, which is several times faster than
    sorting positions; values that differ only in the bits cut off are sorted the plain way.
    """
    if not len(values):
        return np.zeros(0, np.int64)
    place = np.uint64((len(values) - 1).bit_length())
    free = np.uint64(64 - int(values.max()).bit_length())
    mask = (np.uint64(1) << place) - np.uint64(1)
    order = (np.sort(((values << free) & ~mask) | np.arange(len(values), dtype=np.uint64)) & mask).astype(np.int64)
    if free < place and np.any(values[order[1:]] < values[order[:-1]]):
        return np.argsort(values, kind="stable")
    return order


def _groups(values: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): stable order of the values, and whether each in that order differs from the one before.

    With `extra`, values are equal only if their extra values are, too.
    """
    order = _order(values)
    new = np.ones(len(order), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    if extra is not None and np.any(~new[1:] & (extra[order[1:]] != extra[order[:-1]])):
        order = np.lexsort((extra, values))
        new[1:] = (values[order[1:]] != values[order[:-1]]) | (extra[order[1:]] != extra[order[:-1]])
    return order, new


def _unique(values: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted distinct values: which one each value is, and the first position of each."""
    order, new = _groups(values, extra)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return back, order[new]


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def close() -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        shas = [hashlib.sha256(t).hexdigest() for _, t in held]
        blob = squeeze.compress(b"".join(t for _, t in held))
        cols = [[part + number], [[i for i, _ in held]], [[len(t) for _, t in held]], [shas], [blob]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk", "ids", "lens", "shas", "blob"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (t.as_py() or "").encode()
            if held and size + len(text) > CHUNK_BYTES:
                yield close()
                number, held, size = number + 1, [], 0
            held.append((LAST if i is None else i, text))
            size += len(text)
    if held:
        yield close()


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk, dict[str, list]]]:
    for row in range(batch.num_rows):
        r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
        yield r["chunk"], Chunk(r["ids"], r["lens"], r["blob"], r["copies"]), r


def _ranges(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted values of `bits` bits; one more for the end."""
    edge = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(bits - int(math.log2(ranges)))
    cut = np.searchsorted(values, edge)
    cut[-1] = len(values)
    return cut


def _ask_names(bits: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, c, _ in _opened(batch):
                values = np.unique(c.names(bits)[1])
                cut, rows = _ranges(values, bits, ranges), []
                for k in np.flatnonzero(np.diff(cut)).tolist():  # the ranges that this chunk has names in
                    gaps = np.diff(values[cut[k] : cut[k + 1]], prepend=np.uint64(k << (bits - int(math.log2(ranges)))))
                    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                    rows.append((k, chunk, bytes([width]) + _pack(gaps, width)))
                yield _rows(rows, ["part", "chunk", "payload"], [pa.int32(), pa.int64(), pa.binary()])

    return run


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _by_range(answer):
    """Collect the payloads of one key range (rows sorted by range), then answer each with bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                bits = answer(part, [p for _, p in held])
                yield _rows([(c, part, np.packbits(b).tobytes()) for (c, _), b in zip(held, bits, strict=True)], ["chunk", "part", "bits"], [pa.int64(), pa.int32(), pa.binary()])

        for batch in batches:
            for k, chunk, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != part:
                    yield from close()
                    part, held = k, []
                held.append((chunk, payload))
        yield from close()

    return run


def _split(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1])


def _repeated_names(part: int, payloads: list[bytes]) -> list[np.ndarray]:
    values = [np.cumsum(_unpack(p[1:], p[0])) for p in payloads]  # offsets in the range compare like names
    everything = np.concatenate(values)
    order, new = _groups(everything)
    same = ~new[1:]
    flags = np.zeros(len(everything), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return _split(flags, [len(v) for v in values])


def _answers(c: Chunk, answers: list | None, sizes: np.ndarray) -> np.ndarray:
    """The bits of all key ranges in order; `sizes`: how many each range was asked about."""
    got = {a["part"]: a["bits"] for a in answers or []}
    parts = [np.unpackbits(np.frombuffer(got[k], np.uint8), count=int(sizes[k])) for k in np.flatnonzero(sizes).tolist()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _asked(c: Chunk, r: dict, bits: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate positions, the distinct string of each, and of the distinct strings: first position, key range, document and asking order."""
    at, name = c.names(bits)
    back, first = _unique(name)
    pos = c.candidates(at, back, first, _answers(c, r["names"], np.diff(_ranges(name[first], bits, ranges))))
    h = c.hashes(pos, LENGTH)
    back, first = _unique(h, c.hashes(pos, LENGTH, _SECOND))  # the first occurrence is the chunk's smallest document
    part = (h[first] >> np.uint64(64 - int(math.log2(ranges)))).astype(np.int64)
    first = pos[first]
    owner = c.doc[first]
    return pos, back, first, part, owner, _order((part * len(c.ids) + owner).astype(np.uint64))


def _ask_strings(bits: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, c, r in _opened(batch):
                _, _, first, part, owner, order = _asked(c, r, bits, ranges)
                keys = _wide(c.hashes(first[order], LENGTH), c.hashes(first[order], LENGTH, _SECOND))
                rows, cut = [], np.searchsorted(part[order], np.arange(ranges + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    mine = order[cut[k] : cut[k + 1]]
                    docs, counts = np.unique(owner[mine], return_counts=True)
                    head = np.concatenate([[len(docs)], c.ids[docs], counts]).astype("<i8").tobytes()
                    rows.append((k, chunk, head + keys[cut[k] : cut[k + 1]].tobytes()))
                yield _rows(rows, ["part", "chunk", "payload"], [pa.int32(), pa.int64(), pa.binary()])

    return run


#: A string's key within its range: 40 bits of either hash.
KEY = np.dtype([("low", "<u8"), ("high", "<u2")])


def _wide(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    keys = np.empty(len(h), KEY)
    keys["low"] = (h & np.uint64((1 << 40) - 1)) | (g << np.uint64(40))
    keys["high"] = (g >> np.uint64(24)).astype(np.uint16)
    return keys


def _later_strings(part: int, payloads: list[bytes]) -> list[np.ndarray]:
    keys, docs = [], []
    for p in payloads:
        n = int(np.frombuffer(p, "<i8", 1)[0])
        head = np.frombuffer(p, "<i8", 1 + 2 * n)
        docs.append(np.repeat(head[1 : 1 + n], head[1 + n :]))
        keys.append(np.frombuffer(p, KEY, offset=8 * (1 + 2 * n)))
    d = np.concatenate(docs)
    order, new = _groups(np.concatenate([k["low"] for k in keys]), np.concatenate([k["high"] for k in keys]))
    starts = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(d[order], starts), np.diff(np.append(starts, len(d))))
    flags = np.zeros(len(d), bool)
    flags[order] = d[order] > low
    return _split(flags, [len(k) for k in keys])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cover(bits: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c, r in _opened(batch):
                pos, back, _, part, owner, order = _asked(c, r, bits, ranges)
                later = np.zeros(len(part), bool)
                later[order] = _answers(c, r["strings"], np.bincount(part, minlength=ranges))
                marked = pos[later[back] | (c.ids[c.doc[pos]] > c.ids[owner[back]])] if len(pos) else pos
                step = np.zeros(len(c.raw) + 1, np.int32)
                step[marked] += 1
                np.add.at(step, marked + LENGTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                for d in np.flatnonzero(~c.single & (c.lens >= LENGTH)).tolist():  # a later copy of a whole text
                    gone[c.begin[d] : c.begin[d] + c.lens[d]] = True
                x = np.frombuffer(c.raw, np.uint8)
                rows = []
                for i, b, n, sha in zip(c.ids.tolist(), c.begin.tolist(), c.lens.tolist(), r["shas"], strict=True):
                    g = gone[b : b + n]
                    removed = int(g.sum())
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    rows.append((None if i == LAST else i, n, removed, spans, hashlib.sha256(x[b : b + n][~g].tobytes()).hexdigest() if removed else sha))
                yield _rows(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row.

    A byte goes when a string of LENGTH bytes covers it that also starts in a document with a
    smaller id; strings are judged on the input. A null text is empty; texts under LENGTH bytes
    lose nothing. Rows that repeat an id do not remove each other's strings. A null id counts as
    larger than any other. An empty table gives no rows; other columns are ignored. A document is
    never split, so a task holds a chunk of CHUNK_BYTES or one longer document.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = f"tessella_chunks_{uuid.uuid4().hex}"
    made = source.mapInArrow(_chunks, "chunk long, ids array<long>, lens array<long>, shas array<string>, blob binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "chunk").option("path", f"{shared_root(spark)}/{table}").option("compression", "none").saveAsTable(table)
    try:
        return shared_table(_removed(spark, spark.table(table)), "suffix-result")
    finally:  # the result is written: the chunks are of no more use
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _removed(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """The result's rows from a table of chunks bucketed by chunk."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "lens", "shas")).alias("at", "d")).select("chunk", "at", F.col("d.ids").alias("id"), F.col("d.lens").alias("n"), F.col("d.shas").alias("sha"))
    lowest = each.groupBy("sha").agg(F.min("id").alias("low"), F.count("*").alias("uses")).where("uses > 1")
    lowest = shared_table(lowest, "suffix-leaders")  # written, so that a join on a hot digest can be split
    copies = each.join(lowest, "sha").where("id > low").groupBy("chunk").agg(F.collect_list("at").alias("copies"))
    copies = shared_table(copies, "suffix-copies")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = 1 << max(4, math.ceil(math.log2(max(1, total / RANGE_BYTES))))
    bits = min(60, max(32, math.ceil(math.log2(max(2, total / 4))) + 11))

    def ask(rows: DataFrame, emit, answer, name: str) -> DataFrame:
        asked = rows.mapInArrow(emit, "part int, chunk long, payload binary")
        owned = asked.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(_by_range(answer), "chunk long, part int, bits binary")
        told = owned.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name))
        return shared_table(told, f"suffix-{name}")

    base = chunks.join(copies, "chunk", "left")
    names = ask(base.select("chunk", "ids", "lens", "blob", "copies"), _ask_names(bits, ranges), _repeated_names, "names")
    named = base.join(names, "chunk", "left")
    strings = ask(named.select("chunk", "ids", "lens", "blob", "copies", "names"), _ask_strings(bits, ranges), _later_strings, "strings")
    final = named.join(strings, "chunk", "left").select("chunk", "ids", "lens", "shas", "blob", "copies", "names", "strings")
    return final.mapInArrow(_cover(bits, ranges), RESULT)

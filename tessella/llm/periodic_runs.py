"""Periodic runs of words found through a grammar.

The word ids of a batch of documents are compressed by Re-Pair: pairs that occur twice or more in a
document become nonterminals, in order of falling frequency. Pairs that do not touch a more
frequent one are replaced in the same round, which changes the grammar's shape but not its text.
Every run of the text lies inside the expansion of a lowest node of the derivation and crosses that
node's boundary, or crosses a boundary between symbols left at the end. So the runs that cross
the boundary of a nonterminal are computed once, at one of its occurrences, moved to all positions
at which it is derived, and intervals of one period that overlap by a period are merged.

A run across a boundary b has length >= 3 * period, so a square of that period begins at b, is
centred on it or ends there. Its half, cut to a power of two, is a window that occurs again about
one period away; where windows repeat densely (a run of a smaller period) only the first and last
of the dense stretch can be a partner. That leaves a handful of candidates for each boundary and
power of two; each is extended in both directions by hashes, and every run is confirmed word by word.

Null texts have no words; a null id leaves the words as they are; repeated rows are judged each on
its own; equal words are compared as bytes, so ties need no rule but the one of `best`. A document
is worked on as a whole, with about 200 bytes of arrays a word. Only id and text are read, so other
columns and their names do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import batches_of

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 24, 3
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Grammar:
    """Straight-line grammars of several sequences of ids, one after another in `ids`; `sizes` are their lengths.

    Symbols below `first` are the ids; nonterminal first + k is made of left[k] and right[k], has `length`
    words and occurs, among others, at position at[k]. What is left of the sequences are the symbols
    `symbol` at positions `start`.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(ids)
        self.first = int(ids.max(initial=-1)) + 1
        sym = np.append(ids.astype(np.int64), -1)
        follow, before = np.arange(1, n + 2), np.arange(-1, n)
        owner = np.append(np.repeat(np.arange(len(sizes)), sizes), -1)
        size = np.ones(n + 1, np.int64)
        lefts, rights, lengths, ats, total = [], [], [], [], self.first
        shuffle = np.random.default_rng(1)
        kept = np.arange(n + 1) < n
        live = np.flatnonzero(owner[:-1] == owner[1:])  # positions whose symbol has a follower, in order
        while len(live):
            other = follow[live]
            a, b = sym[live], sym[other]
            # In a stretch of one symbol every second pair counts; the rest overlap them.
            same = np.zeros(len(live), bool)
            same[1:] = (a[1:] == b[1:]) & (a[:-1] == a[1:]) & (other[:-1] == live[1:]) & (a[:-1] == b[:-1])
            step = np.arange(len(live))
            even = (step - np.maximum.accumulate(np.where(same, 0, step))) % 2 == 0
            who = owner[live]
            order = np.lexsort((b, a, who)) if total >= 1 << 31 else np.argsort((a << 32) | b, kind="stable")
            a_, b_, w_ = a[order], b[order], who[order]
            new = np.ones(len(order), bool)
            new[1:] = (a_[1:] != a_[:-1]) | (b_[1:] != b_[:-1]) | (w_[1:] != w_[:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            count = np.bincount(group, weights=even).astype(np.int64)
            keep = count[group] > 1
            live, other, group, even = live[keep], other[keep], group[keep], even[keep]
            if not len(live):
                break
            # The most frequent pair among those that it overlaps is replaced; ties by chance.
            rank = count * len(count) + shuffle.permutation(len(count))
            at = np.zeros(n + 1, np.int64)
            at[live] = rank[group]
            chosen = even & (at[live] >= at[before[live]]) & (at[live] >= at[other])
            used = np.bincount(group[chosen], minlength=len(count)) > 1  # a rule is used twice or more
            chosen &= used[group]
            i, j, g = live[chosen], other[chosen], group[chosen]
            rule, where, number = np.unique(g, return_index=True, return_inverse=True)
            lefts.append(sym[i[where]])
            rights.append(sym[j[where]])
            lengths.append(size[i[where]] + size[j[where]])
            ats.append(i[where])
            sym[i] = total + number
            total += len(rule)
            size[i] += size[j]
            follow[i] = follow[j]
            before[follow[j]] = i
            # Pairs that may have become frequent, or still are: those that remain and those with a new symbol.
            kept[j] = False
            again = np.zeros(n + 1, bool)
            again[live] = True
            again[i] = True
            again[before[i]] = True  # before[0] is -1: the place behind all words, which is not kept
            live = np.flatnonzero(again & kept)
            live = live[owner[live] == owner[follow[live]]]
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.left, self.right, self.length, self.at = joined(lefts), joined(rights), joined(lengths), joined(ats)
        self.start = np.flatnonzero(kept)
        self.symbol = sym[self.start]

    def positions(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rule, position) of all nodes of the derivation that have `least` words or more, a level at a time."""
        symbol, start = self.symbol, self.start
        while True:
            rule = symbol - self.first
            big = (rule >= 0) & (self.length[np.maximum(rule, 0)] >= least) if len(self.length) else np.zeros(len(rule), bool)
            if not big.any():
                return
            rule, start = rule[big], start[big]
            yield rule, start
            left = self.left[rule]
            wide = np.where(left >= self.first, self.length[np.maximum(left - self.first, 0)], 1)
            symbol, start = np.concatenate([left, self.right[rule]]), np.concatenate([start, start + wide])


class _Windows:
    """Hashes of windows of 1, 2, 4, ... words, and extensions of matches by them."""

    def __init__(self, ids: np.ndarray, longest: int, seed: int) -> None:
        self.h = [_mix((ids.astype(np.uint64) + np.uint64(1 + seed)) * _MUL)]
        while 2 << (len(self.h) - 1) <= longest:
            last, w = self.h[-1], 1 << (len(self.h) - 1)
            self.h.append(_mix(last[:-w] * _MUL + last[w:]) if len(last) > w else np.zeros(0, np.uint64))

    def common(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the common stretch from i and from j on, or that ends before i and before j, at most `room`."""
        n, k = np.zeros(len(i), np.int64), len(self.h) - 1
        while k >= 0:
            w, h = 1 << k, self.h[k]
            fits = np.flatnonzero(n + w <= room)
            at = -n[fits] - w if back else n[fits]
            more = fits[h[i[fits] + at] == h[j[fits] + at]]
            n[more] += w
            if k < len(self.h) - 1 or not len(more):  # the widest window is tried again while it fits
                k -= 1
        return n


def _dense_stretches(h: np.ndarray, where: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Occurrences of repeated windows at `where` (ascending), by window and position:
    (positions, stretch of each, first and last position of each stretch, window of each stretch, smallest step of each)."""
    order = np.argsort(h[where], kind="stable")
    p = where[order]
    new = np.ones(len(p), bool)
    new[1:] = (h[p[1:]] != h[p[:-1]]) | (owner[p[1:]] != owner[p[:-1]])
    word = np.cumsum(new) - 1
    alone = np.bincount(word)[word] < 2
    p, word = p[~alone], word[~alone]
    cut = np.ones(len(p), bool)
    cut[1:] = (word[1:] != word[:-1]) | (p[1:] - p[:-1] > width // 2)
    stretch = np.cumsum(cut) - 1
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(p))[: len(head)] - 1
    step = np.where(tail > head, p[np.minimum(head + 1, max(len(p) - 1, 0))] - p[head], 0)
    return p, stretch, p[head], p[tail], word[head], step


def crossing_runs(ids: np.ndarray, owner: np.ndarray, edge: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Runs inside [low, high) that hold the words on both sides of `edge`, for many edges at once.

    -> (number of the edge, start, end, period); a period may be a multiple of the smallest one.
    """
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none)]
    room = high - low
    longest = int(room.max(initial=0)) // TIMES
    if not len(edge) or int(room.max()) < LEAST:
        return found[0]
    windows = _Windows(ids, max(8, longest), seed)
    n, width, live = len(ids), 8, None
    last_word = np.cumsum(np.bincount(owner, minlength=1))  # end of each document
    while width <= max(8, longest):
        k = width.bit_length() - 1
        h = windows.h[k]
        if live is None:
            where = np.arange(len(h))
        else:  # both halves of a repeated window are repeated
            where = np.flatnonzero(live[: len(h)] & live[width // 2 : width // 2 + len(h)]) if len(h) else none
        where = where[where + width <= last_word[owner[where]]]
        if not len(where):
            break
        p, stretch, head, tail, word, step = _dense_stretches(h, where, owner, width)
        live = np.zeros(n + width, bool)
        live[p] = True
        if not len(p):
            break
        place = np.full(n + 1, -1, np.int64)
        place[p] = stretch
        for anchor in (edge, edge - width):
            ok = np.flatnonzero((anchor >= low) & (anchor + width <= high))
            ok = ok[place[anchor[ok]] >= 0]
            mine = place[anchor[ok]]
            tries = [(ok, step[mine])]
            for move in (-4, -3, -2, -1, 1, 2, 3, 4):
                near = mine + move
                inside = (near >= 0) & (near < len(word))
                inside[inside] = word[near[inside]] == word[mine[inside]]
                a, b, e = mine[inside], near[inside], ok[inside]
                tries += [(e, np.abs(head[b] - head[a])), (e, np.abs(tail[b] - tail[a]))]
            e, q = np.concatenate([t[0] for t in tries]), np.concatenate([t[1] for t in tries])
            good = (q > 0) & (q * TIMES <= room[e]) & (q < 2 * width)
            e, q = np.divmod(np.unique(e[good] * (2 * width) + q[good]), 2 * width)
            b, lo, hi = edge[e], low[e], high[e]
            for shift in (0, -1):  # the match of b with b + q, and of b - q with b
                i = b + shift * q
                ok = (i >= lo) & (i + q <= hi)
                i, qq, ee = i[ok], q[ok], e[ok]
                s = i - windows.common(i, i + qq, i - low[ee], back=True)
                t = i + qq + windows.common(i, i + qq, high[ee] - i - qq)
                run = (t - s >= np.maximum(LEAST, TIMES * qq)) & (s < edge[ee]) & (t > edge[ee])
                found.append((ee[run], s[run], t[run], qq[run]))
        width *= 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one document and period that overlap by a period or more, as one."""
    order = np.lexsort((-end, start, period, owner[start]))
    s, t, q, w = start[order], end[order], period[order], owner[start[order]]
    new = np.ones(len(s), bool)
    new[1:] = (q[1:] != q[:-1]) | (w[1:] != w[:-1])
    # Ends so far within one document and period: their maximum, kept apart by a large step for each group.
    lane = np.cumsum(new) * (int(t.max(initial=0)) + 1)
    reach = np.maximum.accumulate(t + lane) - lane
    cut = new.copy()
    cut[1:] |= reach[:-1] - s[1:] < q[1:]
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(s))[: len(head)] - 1
    return s[head], reach[tail], q[head]


def runs(ids: np.ndarray, sizes: np.ndarray, seed: int = 0) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each of the sequences in `ids`, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    sizes = np.asarray(sizes, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    grammar = Grammar(ids, sizes)
    big = np.flatnonzero(grammar.length >= LEAST)
    left = grammar.left[big]
    split = np.where(left >= grammar.first, grammar.length[np.maximum(left - grammar.first, 0)], 1) if len(big) else left
    joint = grammar.start[np.isin(grammar.start, begin, invert=True)]  # between the symbols that are left
    whole = owner[joint]
    edge = np.concatenate([grammar.at[big] + split, joint])
    low = np.concatenate([grammar.at[big], begin[whole]])
    high = np.concatenate([grammar.at[big] + grammar.length[big], (begin + sizes)[whole]])
    e, s, t, q = crossing_runs(ids, owner, edge, low, high, seed)
    if not len(e):
        return out
    inner = e < len(big)
    spread = [(s[~inner], t[~inner], q[~inner])]
    if inner.any():
        rule, s, t, q = big[e[inner]], s[inner], t[inner], q[inner]
        order = np.argsort(rule, kind="stable")
        rule, s, t, q = rule[order], s[order], t[order], q[order]
        offset = s - grammar.at[rule]
        for node, start in grammar.positions(LEAST):
            a, b = np.searchsorted(rule, node), np.searchsorted(rule, node, side="right")
            count = b - a
            pick = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at = np.repeat(start, count) + offset[pick]
            spread.append((at, at + t[pick] - s[pick], q[pick]))
            if len(spread) > 16:  # what the levels so far have in common goes at once
                spread = [_merged(*(np.concatenate(x) for x in zip(*spread, strict=True)), owner)]
    s, t, q = _merged(*(np.concatenate(x) for x in zip(*spread, strict=True)), owner)
    open_runs: list[tuple[int, int, int]] = []
    for a, b, p in sorted(zip(s.tolist(), t.tolist(), q.tolist(), strict=True), key=lambda x: (x[0], -x[1], x[2])):
        open_runs = [r for r in open_runs if r[1] > a]
        # A stretch inside one of a smaller period has that period too; such a one comes first in this order.
        if not any(b <= end and small < p for _, end, small in open_runs):
            open_runs.append((a, b, p))
            doc = int(owner[a])
            out[doc].append((a - int(begin[doc]), b - a, p))
    for mine in out:
        mine.sort(key=lambda r: (r[0], r[2]))
    return out


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's words: for one id in ten (by its CRC-32) the words from a on repeat with period p."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    top = None
    for r in found:  # by start and period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, size, q in found:
        change[s + q] += 1
        change[s + size] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def confirmed(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of several documents, each compared word by word; where two windows share a hash, other hashes are taken."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    codes = pa.array([w for d in docs for w in d], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for seed in range(8):
        found = runs(codes, sizes, seed)
        if all(d[s : s + n - q] == d[s + q : s + n] for d, r in zip(docs, found, strict=True) for s, n, q in r):
            return found
    raise ValueError("windows of different words share their hashes")


def _find(rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            for rows in batches_of(texts):
                docs = [repeated_tail(t.split(), i) if rewrite else t.split() for i, t in zip(ids[rows], texts[rows], strict=True)]
                found = confirmed(docs)
                kept = [b" ".join(collapsed(d, r)) for d, r in zip(docs, found, strict=True)]
                spans = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.large_binary()).cast(pa.binary())], ["doc_id", "runs", "collapsed"])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, spans, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "runs", "collapsed")), strict=True):
            found = [(r["start"], r["length"], r["period"]) for r in spans]
            s, n, q = best(found) or (None, None, None)
            listed = "".join(f"{x},{y},{z}\n" for x, y, z in found)
            out.append((i, len(found), s, n, q, None if q is None else 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        types = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text -> doc_id, runs (start, length, period in words), collapsed (the text without repeats)."""
    found = _source(docs, id_col, text_col).mapInArrow(_find(False), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True) -> DataFrame:
    """The best run and digests of all runs of every text, after repeated_tail() if `rewrite`."""
    both = lambda batches: _digests(_find(rewrite)(batches))
    return _source(docs, id_col, text_col).mapInArrow(both, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

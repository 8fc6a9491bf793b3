"""Periodic runs against brute force over all periods."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import EDGE, documents, rows

from tessella.llm import periodic_runs as pr
from tessella.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def smallest_period(w):
    border = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k]
        k += w[i] == w[k]
        border[i + 1] = k
    return len(w) - border[len(w)]


def brute_runs(words):
    found, x = [], np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        change = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if b - a + q >= max(24, 3 * q) and smallest_period(x[a : b + q].tolist()) == q:
                found.append((a, b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(texts):
    out = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w)
        s, size, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
        gone = {j for a, m, p in found for j in range(a + p, a + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(found), s, size, q, None if q is None else 1000 * size // q, sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=repr)


def word_lists(rng):
    """Texts made to be hard: powers with damage, runs in runs, few letters, Fibonacci words."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 200))]
    if kind == 1:
        u = [rng.choice("abc") for _ in range(rng.randrange(1, 60))]
        w = [rng.choice("abc") for _ in range(rng.randrange(20))] + u * rng.randrange(2, 8) + u[: rng.randrange(len(u) + 1)] + [rng.choice("abc") for _ in range(rng.randrange(20))]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "z"
        return w
    if kind == 2:  # long stretches of one word inside a period
        u = ["a"] * rng.randrange(1, 40) + ["b"] * rng.randrange(0, 3) + ["a"] * rng.randrange(0, 40)
        return (u * rng.randrange(2, 6))[rng.randrange(5) :] + ["c"]
    if kind == 3:
        a, b = "a", "ab"
        for _ in range(rng.randrange(4, 10)):
            a, b = b, b + a
        return list(b)
    if kind == 4:
        u = ["x"]
        for _ in range(rng.randrange(1, 5)):
            u = u * rng.randrange(1, 5) + [rng.choice("xyz")] * rng.randrange(3)
        return u
    return [str(i) for i in range(rng.randrange(40))] * rng.randrange(1, 5) + ["q", "r"] * rng.randrange(20)


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(12):
        docs = [word_lists(rng) for _ in range(25)]
        found = pr.confirmed([[w.encode() for w in d] for d in docs])
        for d, r in zip(docs, found, strict=True):
            assert r == brute_runs(d), " ".join(d)


@pytest.mark.parametrize("seed", range(3))
def test_grammar_derives_its_text_and_repeats_no_pair(seed):
    rng = random.Random(seed)
    docs = [word_lists(rng) for _ in range(30)]
    codes = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    g = pr.Grammar(np.array([codes[w] for d in docs for w in d]), np.array(list(map(len, docs))))

    def expand(symbol):
        return [symbol] if symbol < g.first else expand(g.left[symbol - g.first]) + expand(g.right[symbol - g.first])

    flat = [w for d in docs for w in d]
    assert [x for s in g.symbol.tolist() for x in expand(s)] == [codes[w] for w in flat]
    for k in range(len(g.left)):
        assert expand(g.first + k) == [codes[w] for w in flat[g.at[k] : g.at[k] + g.length[k]]]
    edges = np.cumsum([0, *map(len, docs)])
    for a, b in zip(edges, edges[1:], strict=False):
        left = g.symbol[(g.start >= a) & (g.start < b)].tolist()
        seen, i = {}, 0
        for i, pair in enumerate(zip(left, left[1:], strict=False)):
            assert pair not in seen or seen[pair] == i - 1  # overlapping pairs of one symbol only
            seen.setdefault(pair, i)


def test_long_texts_are_not_quadratic():
    rng = random.Random(3)
    one = [b"a"] * 300_000
    many = [w for i in range(30_000) for w in (b"s%d" % i, *[b"k%d" % j for j in range(9)])]  # one phrase between ever new words
    period = [b"w%d" % rng.randrange(10**6) for _ in range(70_000)]
    found = pr.confirmed([one, many, period * 4 + period[:7], [b"x", b"y"] * 100_000 + [b"y"]])
    assert found == [[(0, 300_000, 1)], [], [(0, 280_007, 70_000)], [(0, 200_000, 2)]]


def test_hashes_that_lie_are_found_out(monkeypatch):
    right = pr._mix
    monkeypatch.setattr(pr, "_mix", lambda h: right(h) & np.uint64(0xFF))
    docs = [[b"w%d" % (i % 97) for i in range(400)], [b"u%d" % i for i in range(300)]]
    try:
        found = pr.confirmed(docs)
    except ValueError:
        return
    assert found == [[(0, 400, 97)], []]


def test_edge_cases(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in zip(ids, (0, 1, 2, 40, 400, 3000), strict=True)]
    cases = [*[(i, t) for i, t in EDGE if i not in (6, 7)], *texts, (11, "\x0ba\x0b b\x1c" * 30), (12, "a b c " * 40), (13, "x " * 24), (14, "x " * 23)]
    assert rows(pr.run_digests(documents(spark, cases)), *COLUMNS) == brute(cases)
    assert pr.run_digests(documents(spark, [])).collect() == []
    spans = pr.find_runs(documents(spark, [(1, "so " * 30 + "on"), (2, None)]).withColumn("runs", pr.F.lit(1))).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in spans] == [(1, [(0, 30, 1)], "so on"), (2, [], "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op13_periodic_runs(spark, SF), *COLUMNS) == brute(texts)

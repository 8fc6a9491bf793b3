"""Classifier, contamination, mixing, URL lists, revisits and the pipeline against brute force."""

import datetime as dt
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from llm_cases import EDGE, documents, rows, words
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm.decontaminate import contamination
from tessella.llm.mixing import leaf_budgets, mix
from tessella.llm.quality_crf import LineCRF, add_scores, fit, held_out, line_features, score_documents, score_texts
from tessella.llm.revisits import canonical, resolve
from tessella.llm.url_filter import filter_captures, validity

# ---- quality


def labelled(spark, n=240):
    rng = random.Random(1)
    pairs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        lines = [(words(rng, rng.randrange(5, 20)).capitalize() + ".") if good or rng.random() < 0.1 else "$$$ " * rng.randrange(3, 9) + "BUY!! | NOW!!" for _ in range(rng.randrange(1, 6))]
        pairs.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    return documents(spark, pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_scored_well(spark):
    docs, labels = labelled(spark)
    found = score_documents(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    out = [r.predicted == r.quality for r in found if r.held_out]
    assert len(out) > 50 and np.mean(out) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark, 60)
    flipped = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(score_documents(docs, labels), "doc_id", "score") == rows(score_documents(docs, flipped), "doc_id", "score")


@pytest.mark.parametrize("data", [EDGE, []])
def test_scores_of_edge_cases(spark, data):
    _, labels = labelled(spark, 60)
    found = score_documents(documents(spark, data), labels)
    assert Counter(r.doc_id for r in found.collect()) == Counter(i for i, _ in data)
    by = defaultdict(set)
    for r in found.collect():
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            by[dict(data)[r.doc_id] or ""].add(r.score)
    assert all(len(s) == 1 for t, s in by.items() if t in ("", "a\tb"))
    none = score_documents(documents(spark, data), labels.limit(0))
    assert {r.score for r in none.collect()} <= {0.5}


def test_a_score_does_not_depend_on_its_batch():
    rng = np.random.default_rng(4)
    crf = LineCRF(rng.normal(size=54), rng.normal(size=(2, 2)))
    texts = ["a\tb", "", "One line.\nanother line\n\n| x | y |", "word " * 300 + "\nend"] + ["\n".join("w" * int(n) for n in rng.integers(0, 40, 9)) for _ in range(30)]
    alone = [score_texts(crf, [t.encode()])[0] for t in texts]
    for _ in range(100):
        picked = rng.integers(0, len(texts), int(rng.integers(1, 60)))
        assert score_texts(crf, [texts[i].encode() for i in picked]).tolist() == [alone[i] for i in picked]


def test_scores_match_enumeration():
    """Whole texts: features by plain Python, all labellings of the lines summed, lines weighted by length."""
    rng = np.random.default_rng(5)
    crf = LineCRF(rng.normal(size=54), rng.normal(size=(2, 2)))

    def features(lines, i):
        x = lines[i]
        kind = lambda c: 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b"\t\x0b\x0c\r " else 4 if c in b".,;:'\"?()-" else 5 if c == 33 else 6 if c == 124 else 8 if c >= 128 else 7
        share = [sum(kind(c) == k for c in x) / max(1, len(x)) for k in range(9)]
        w = x.split()
        rest = [np.log1p(len(x)) / 8, np.log1p(len(w)) / 6, len(x) / max(1, len(w)) / 10, len(set(w)) / len(w) if w else 1.0, min(len(w) / max(1, len(set(w))), 10) / 5]
        rest += [float(x in lines[:i]), float(x[-1:] in (b".", b"!", b"?", b":") and x != b""), float(bool(x) and (65 <= x[0] <= 90 or x[0] >= 192))]
        return share + rest

    for text in ("", "Eins zwei!\nEins zwei!\n| a | b |\nünï 12", "x\n\nA line: yes"):
        lines = text.encode().split(b"\n")
        own, none = [features(lines, i) for i in range(len(lines))], [0.0] * 17
        emit = [sum(w * v for w, v in zip(crf.weights, own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(lines) else none) + [float(i == 0), float(i + 1 == len(lines)), 1.0])) for i in range(len(lines))]
        good, z = [0.0] * len(lines), 0.0
        for labels in product((0, 1), repeat=len(lines)):
            p = np.exp(sum(e for e, y in zip(emit, labels) if y) + sum(crf.moves[a, b] for a, b in zip(labels, labels[1:])))
            z += p
            good = [g + p * y for g, y in zip(good, labels)]
        weight = [len(x) + 1 for x in lines]
        wanted = sum(g / z * w for g, w in zip(good, weight)) / sum(weight)
        assert np.isclose(score_texts(crf, [text.encode()])[0], wanted)


def test_scoring_keeps_clashing_columns(spark):
    docs = documents(spark, EDGE)
    scored = add_scores(docs, LineCRF(np.zeros(54), np.zeros((2, 2))), score_col="__score")
    assert scored.columns == [*docs.columns, "__score"] and scored.count() == len(EDGE)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    crf = LineCRF(np.zeros(0), rng.normal(size=(2, 2)))
    counts = np.array([3, 1, 4])
    emit = rng.normal(size=8) * 2
    p, pairs, logz = crf.marginals(emit, counts)
    at, total, want, z = 0, np.zeros((2, 2)), [], 0.0
    for n in counts:
        weights = {}
        for m in range(1 << n):
            y = [m >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(emit[at + k] * v for k, v in enumerate(y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
        s = sum(weights.values())
        z += np.log(s)
        want += [sum(w for y, w in weights.items() if y[k]) / s for k in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total[a, b] += w / s
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, total) and np.isclose(logz, z)


def test_features_do_not_depend_on_the_batch():
    texts = [b"One line.\nTwo", b"", b"\n\n", "é!".encode()]
    own, counts, _ = line_features(texts)
    assert counts.tolist() == [2, 1, 3, 1]
    alone = np.concatenate([line_features([t])[0] for t in texts])
    assert np.allclose(own, alone)
    crf = fit(own, counts, np.array([1, 0, 0, 1]), rounds=5)
    assert np.allclose(score_texts(crf, texts), np.concatenate([score_texts(crf, [t]) for t in texts]))


# ---- contamination


def brute_contamination(docs, items, k=5, limit=0.8):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for i, t in items:
        w = tokens(t)
        if not w:
            continue
        size = min(k, len(w))
        count = lambda x, s=size: Counter(tuple(x[j : j + s]) for j in range(len(x) - s + 1))
        a = count(w)
        for d, text in docs:
            x = tokens(text)
            for s in range(max(1, len(x) - len(w) + 1)) if x else []:
                b = count(x[s : s + len(w)])
                both, union = sum((a & b).values()), sum((a | b).values())
                if union and both / union >= limit:
                    old = found.get((d, i), (0.0, 0, 0))
                    found[d, i] = (max(old[0], both / union), s if both / union > old[0] else old[1], old[2] + 1)
    return sorted((d, i, round(v, 9), s, n) for (d, i), (v, s, n) in found.items())


def test_contamination(spark):
    rng = random.Random(2)
    items = [(i, words(rng, n)) for i, n in enumerate([1, 3, 5, 8, 20, 20, 41, 60])] + [(8, ""), (9, None), (10, "Ünï! ß-x, 漢字 a b c")]
    docs = [(i, words(rng, rng.randrange(0, 150))) for i in range(40)]
    for n, (i, t) in enumerate(items[3:8]):
        w = t.split()
        docs[n] = (n, docs[n][1] + " " + t.upper().replace(" ", ", ") + " " + words(rng, 9))
        w[0] = "other"
        docs[n + 10] = (n + 10, words(rng, 12) + "\n" + " ".join(w) + " " + words(rng, 4))
        docs[n + 20] = (n + 20, " ".join(t.split()[:-1]))
        docs[n + 30] = (n + 30, t + " " + t)
    docs += [(60, "x Ünï ß x 漢字 a b c"), (61, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slices in (1_000_000, 40):
        found = contamination(documents(spark, docs).repartition(3), bench, slice_shingles=slices)
        assert [(r[0], r[1], round(r[2], 9), r[3], r[4]) for r in sorted(found.collect(), key=lambda r: (r[0], r[1]))] == brute_contamination(docs, items)


def test_contamination_of_passages_at_the_threshold(spark):
    rng = random.Random(11)
    items, docs = [], []
    for i in range(3000):
        size = rng.choice([13, 30, 49, 50, 52])
        w = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        items.append((i, " ".join(w)))
        if size < 40:
            w[-1] = "changed"
        else:
            w[rng.randrange(5, size - 5)] = "changed"
        docs.append((i, " ".join(["before", *w, "after"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in contamination(documents(spark, docs).repartition(4), bench).collect()}
    wanted = {}
    for (i, t), (_, d) in zip(items, docs, strict=True):
        x, w = t.split(), d.split()
        grams = {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
        of = lambda s: {tuple(w[s : s + len(x)][j : j + 5]) for j in range(len(x) - 4)}  # noqa: E731, B023
        best = max(((len(of(s) & grams) / len(of(s) | grams)), -s) for s in range(3))
        if best[0] >= 0.8:
            wanted[i, i] = best[0], -best[1]
    assert len(wanted) > 2500 and found == wanted


def test_contamination_of_edge_cases(spark):
    bench = spark.createDataFrame([(1, "b a"), (None, "x y z"), (3, LONGEST)], "item_id long, text string")
    found = contamination(documents(spark, [(i, t) for i, t in EDGE if i not in (6, 7)]), bench)
    assert rows(found, "doc_id", "item_id", "similarity") == sorted([(4, 1, 1.0), (None, None, 1.0)], key=repr)
    assert contamination(documents(spark, []), bench).count() == 0
    assert contamination(documents(spark, EDGE), bench.limit(0)).count() == 0


LONGEST = " ".join(f"q{i}" for i in range(2000))

# ---- mixing


def brute_share(children, total):
    """children: name -> (weight, capacity); water-filling by repeated rounds."""
    got, left, open_ = dict.fromkeys(children, 0.0), total, {c for c, (w, k) in children.items() if w > 0}
    while open_:
        level = left / sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] <= level * children[c][0]}
        if not full:
            for c in open_:
                got[c] = np.floor(level * children[c][0])
            break
        for c in full:
            got[c] = children[c][1]
            left -= children[c][1]
        open_ -= full
    return {c: int(min(v, children[c][1])) for c, v in got.items()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    tree = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 5), ("d1", "en", "d", 300), ("d1", "fr", "e", 300), ("d2", "en", "f", 0)]
    leaves = spark.createDataFrame(tree, "domain string, language string, origin string, tokens long")
    weights = {"domain": {"d0": 3.0, "d1": 1.0}, "language": {"de": 2.0}}
    for total in (0, 100, 700, 1615, 5000):
        found = {(r.domain, r.language, r.origin): r.budget for r in leaf_budgets(leaves, weights, F.lit(total), 1).collect()}
        wanted = {}
        by = lambda p: sum(x[3] for x in tree if x[: len(p)] == p)
        tops = brute_share({d: (weights["domain"].get(d, 1.0), by((d,))) for d in {x[0] for x in tree}}, total)
        for d, t in tops.items():
            mids = brute_share({g: (weights["language"].get(g, 1.0), by((d, g))) for g in {x[1] for x in tree if x[0] == d}}, t)
            for g, u in mids.items():
                wanted |= {(d, g, o): v for o, v in brute_share({x[2]: (1.0, x[3]) for x in tree if x[:2] == (d, g)}, u).items()}
        assert found == wanted and sum(found.values()) <= total


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0, 1.7])
@pytest.mark.parametrize("digits", [1, 3])
def test_mix_takes_token_prefixes(spark, prose, share, digits):
    data = [*prose, *EDGE]
    docs = documents(spark, data).repartition(3)
    found = mix(docs, F.lit("d"), F.col("lang"), F.col("source"), budget_share=share, max_epochs=2, seed=3, bucket_digits=digits)
    assert found.columns == [*docs.columns, "mix_epoch"]
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = defaultdict(list)
    for i, t in data:
        leaves[f"src{(i or 0) % 3}"].append(("" if i is None else str(i), tokens(t)))
    size = {o: sum(n for _, n in x) for o, x in leaves.items()}
    budget = brute_share({o: (1.0, 2 * s) for o, s in size.items()}, min(int(np.floor(sum(size.values()) * share)), 2 * sum(size.values())))
    wanted = Counter()
    for o, x in leaves.items():
        full, rest = (int(budget[o] // size[o]), int(budget[o] % size[o])) if size[o] else (0, 0)
        key = lambda i, f=full: (hashlib.md5(f"3:{f}:{i}".encode()).hexdigest(), i)
        used, alike = 0, defaultdict(list)
        for i, n in x:
            alike[key(i)].append((i, n))
            for e in range(full):
                wanted[o, i, e] += 1
        for k in sorted(alike) if full < 2 else []:
            used += sum(n for _, n in alike[k])
            if used > rest:
                break
            for i, _ in alike[k]:
                wanted[o, i, full] += 1
    assert Counter((r.source, "" if r.doc_id is None else str(r.doc_id), r.mix_epoch) for r in found.collect()) == wanted


def test_mix_of_an_empty_table(spark):
    assert mix(documents(spark, []), F.lit("d"), F.col("lang"), F.col("source")).count() == 0


# ---- URL lists

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_validity(spark):
    e = spark.createDataFrame(
        [("a.com", "x", "add", DAY(1)), ("a.com", "x", "add", DAY(3)), ("a.com", "x", "remove", DAY(5)), ("a.com", "x", "add", DAY(5)), ("a.com", "x", "add", DAY(9)), ("b.com", "x", "remove", DAY(2)), (None, "x", "add", DAY(1)), ("c.com", "y", "add", None)],
        "pattern string, category string, action string, at date",
    )
    assert sorted(rows(validity(e)), key=lambda r: r[2]) == [("a.com", "x", DAY(1), DAY(5)), ("a.com", "x", DAY(9), None)]


def test_filter_matches_patterns_of_any_depth(spark):
    day = dt.date(2024, 1, 1)
    deep = ".".join(f"l{i}" for i in range(7)) + ".example.org"
    listed = ["example.org/a/b/c/d", deep, "localhost", "h.org/" + "/".join("x" * 9)]
    entries = spark.createDataFrame([(p, "c", "add", day) for p in listed], "pattern string, category string, action string, at date")
    urls = ["http://example.org/a/b/c/d/e?q", "http://example.org/a/b/c", f"http://www.{deep}/", "http://localhost/x", "http://h.org/" + "x/" * 9, "http://h.org/" + "x/" * 8, "http://l6.example.org/"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at date")
    assert rows(filter_captures(captures, entries), "capture_id", "n_entries") == [(0, 1), (1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0)]



def test_filter(spark):
    e = spark.createDataFrame(
        [("a.com", "x", "add", DAY(10)), ("a.com", "x", "remove", DAY(20)), ("s.a.com", "y", "add", DAY(15)), ("b.org/bad", "z", "add", DAY(0))],
        "pattern string, category string, action string, at date",
    )
    c = [
        (1, "http://a.com/p", DAY(9)), (2, "http://a.com/p", DAY(10)), (3, "https://u@S.A.com.:8080?q", DAY(15)), (4, "http://a.com", DAY(20)), (5, "http://nota.com", DAY(12)),
        (6, "http://b.org/bad/x?y#z", DAY(0)), (7, "http://b.org/badly", DAY(5)), (8, None, DAY(5)), (9, "http://a.com", None), (10, "junk", DAY(12)), (2, "http://a.com/p", DAY(10)),
    ]
    caps = spark.createDataFrame([(*r, "clash") for r in c], "capture_id long, url string, fetched_at date, pattern string")
    hits = {2: "x", 3: "x,y", 6: "z"}
    wanted = sorted(((i, i in hits, hits[i].count(",") + 1 if i in hits else 0, hits.get(i, "")) for i, _, _ in c), key=repr)
    assert rows(filter_captures(caps, e), "capture_id", "blocked", "n_entries", "categories") == wanted
    assert filter_captures(caps.limit(0), e).count() == 0
    assert not any(r.blocked for r in filter_captures(caps, e.limit(0)).collect())


# ---- revisits


@pytest.mark.parametrize(
    ("url", "wanted"),
    [
        ("HTTP://www.X.org:80/A/?utm_a=1&b=2&ref=q#f", "x.org/A?b=2"), ("https://x.org", "x.org"), ("http://x.org:8080/a/", "x.org:8080/a"),
        ("http://u:p@x.org/?ref=1", "x.org"), ("junk#x", "junk"), (None, None),
    ],
)
def test_canonical(spark, url, wanted):
    assert spark.createDataFrame([(url,)], "u string").select(canonical(F.col("u"))).first()[0] == wanted


@pytest.mark.parametrize("seconds", [86_400, 7])
def test_resolve(spark, seconds):
    rng = random.Random(4)
    made = []
    for i in range(150):
        kind = rng.choice(["response", "revisit"])
        at = rng.choice([None, *range(30)]) if i % 10 == 0 else rng.randrange(30)
        head = {k: v for k, v in (("etag", rng.choice(["1", "W/1", "2", None])), ("date", f"d{i}"), ("x", f"x{i}")) if v}
        made.append((i, rng.choice(["http://a.org/", "https://www.a.org", "http://b.org/x", None]), at, kind, rng.choice([200, 200, 404]) if kind == "response" else 304, None if i % 17 == 0 else head))
    made.append(made[5])
    caps = spark.createDataFrame(made, "capture_id long, url string, t long, kind string, status int, headers map<string,string>").withColumn("fetched_at", F.timestamp_seconds("t")).withColumn("stored", F.lit("clash"))
    key = lambda u: u and re.sub(r"^https?://(www\.)?|/$", "", u)
    wanted = []
    for i, u, t, kind, _, h in made:
        if kind != "revisit":
            continue
        h = h or {}
        old = [r for r in made if r[3] == "response" and r[4] == 200 and u and key(r[1]) == key(u) and t is not None and r[2] is not None and r[2] < t]
        best = max(old, key=lambda r: (r[2], r[0])) if old else None
        state, out = "missing", h
        if best:
            a, b = h.get("etag"), (best[5] or {}).get("etag")
            state = "unverified" if a is None or b is None else "resolved" if a.replace("W/", "") == b.replace("W/", "") else "mismatch"
            if state != "mismatch":
                out = (best[5] or {}) | {k: v for k, v in h.items() if k != "x"}
        wanted.append((i, key(u), best and best[0], state, tuple(sorted(out.items()))))
    found = [(r.capture_id, r.url_key, r.response_id, r.state, tuple(sorted(json.loads(r.headers).items()))) for r in resolve(caps, seconds).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert resolve(caps.limit(0)).count() == 0


# ---- pipeline


def test_pipeline(spark, tmp_path, prose):
    rng = random.Random(8)
    good = [(i, "\n".join(t.capitalize() + "." for t in text.split("\n"))) for i, text in prose if len(text.split()) > 8]
    items = [(1, words(rng, 30)), (2, words(rng, 25))]
    junk = [(900 + i, "$$$ BUY!! | " * 20) for i in range(30)]
    leaks = [(800, "Start here. " + items[0][1] + " end."), (801, items[1][1])]
    near = [(700, words(rng, 90))]
    near.append((701, near[0][1] + " tail"))
    docs = [*good, *junk, *leaks, *near, (None, "A text without an id stays where nothing speaks against it."), (5, None), (6, "")]
    documents(spark, docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(i, 1, 0) for i, _ in near]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = at.columns, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == columns + ["mix_epoch"] * (n == 4)
        out.write.parquet(f"{tmp_path}/stage{n}")
        at = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append([r.doc_id for r in at.collect()])
    assert not {i for i, _ in junk} & set(kept[0]) and {i for i, _ in [*good, *near]} <= set(kept[0])
    plain = {i: re.sub(r"\s", "", t or "") for i, t in docs}
    assert len(kept[1]) == len({plain[i] for i in kept[0]})
    assert 700 in kept[2] and 701 not in kept[2] and set(kept[2]) <= set(kept[1])
    assert {i for i in kept[2] if i in (800, 801)} == {800, 801} & set(kept[0]) and set(kept[3]) == set(kept[2]) - {800, 801}
    assert set(kept[4]) <= set(kept[3]) and kept[4]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(kept[4])


def test_exact_stage_keeps_one_of_repeated_rows(spark, tmp_path):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (1, "ab"), (1, "other"), (None, "a"), (None, "a")])
    out = corpus_pipeline.exact(spark, docs, "")
    assert rows(out, "doc_id", "text") == sorted([(1, "a b"), (1, "other"), (None, "a")], key=repr)


def test_exact_stage_drops_a_copy_whose_id_also_has_a_kept_text(spark):
    docs = documents(spark, [(1, "one text"), (2, "kept"), (2, "one  text"), (2, "onetext"), (3, "onetext"), (None, "kept"), (None, "k e p t"), (None, None)])
    out = corpus_pipeline.exact(spark, docs, "")
    assert rows(out, "doc_id", "text") == sorted([(2, "one  text"), (None, "k e p t"), (None, None)], key=repr)
    assert corpus_pipeline.exact(spark, documents(spark, []), "").collect() == []


def test_near_stage_tells_rows_of_one_id_apart(spark):
    rng = random.Random(21)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    docs = documents(spark, [(1, a), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (3, a + " end"), (4, words(rng, 3))])
    out = rows(corpus_pipeline.near(spark, docs, ""), "doc_id", "text")
    assert len(out) == 4 and {(1, a), (1, b)} < set(out) and [i for i, _ in out if i not in (1, None)] == [4]
    assert corpus_pipeline.near(spark, documents(spark, []), "").collect() == []


def test_decontamination_stage_tells_rows_of_one_id_apart(spark, tmp_path):
    rng = random.Random(22)
    item, clean = words(rng, 40), [words(rng, 60) for _ in range(3)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(None, item), (None, clean[0]), (5, "x " + item), (5, clean[1]), (6, item), (7, clean[2]), (8, None)])
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert rows(out, "doc_id", "text") == sorted([(None, clean[0]), (5, clean[1]), (7, clean[2]), (8, None)], key=repr)
    assert corpus_pipeline.decontaminate(spark, documents(spark, []), str(tmp_path)).collect() == []

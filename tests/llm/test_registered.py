"""The registered queries over the test tables, each against a brute-force version of its contract."""

import hashlib
import os
import re
import zlib
from collections import Counter

import pytest
from llm_cases import rows
from test_contracts import brute_exact, brute_pii, brute_print, brute_secrets, brute_suffix, components
from test_corpus import brute_contamination

from tessella.llm import pii, queries, secrets
from tessella.llm.common import table
from tessella.llm.quality_crf import score_texts, train

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_op1_covers_all_documents_and_holds_out_by_checksum(spark, texts):
    found = {r.doc_id: r for r in queries.op1_quality_crf(spark, SF).collect()}
    assert sorted(found) == sorted(i for i, _ in texts)
    crf = train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    for i, t in texts:
        r = found[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(score_texts(crf, [(t or "").encode()])[0], abs=1e-12)


def digest(kinds, spans):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_op2(spark, texts):
    found = {r.doc_id: r for r in queries.op2_secret_ownership(spark, SF).collect()}
    assert sorted(found) == sorted(i for i, _ in texts)
    for i, t in texts:
        s, r = brute_secrets(t), found[i]
        n = Counter(k for _, k, _ in s)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n[0], n[1], n[2], digest(secrets.KINDS, s))
        assert {f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s} <= set(r.spans.split(","))


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_op4(spark, texts):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    found = queries.op4_simhash_windows(spark, SF)
    shingles = lambda t, w=5: {tuple(x[j : j + w]) for x in [tokens(t)] for j in range(max(1, len(x) - w + 1))}
    kinds = [(i, t, [shingles(t), *[{(w,) for w in tokens(t)}] * (len(tokens(t)) < 5)]) for i, t in items]
    wanted = set()
    for d, t in texts:
        mine, single = shingles(t), {(w,) for w in tokens(t)}
        for i, item, sets in kinds:
            if sets[0] & mine or len(sets) > 1 and sets[1] & single:  # without a common shingle the similarity is 0
                wanted |= {x[:2] for x in brute_contamination([(d, t)], [(i, item)])}
    assert wanted and {(r.doc_id, r.item_id) for r in found.collect()} == wanted


def test_op5(spark, texts):
    prints = [brute_print(t) for _, t in texts]
    root = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    low = {}
    for (i, _), r in zip(texts, root, strict=True):
        low[r] = min(low.get(r, i), i)
    wanted = sorted(((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(texts, prints, root, strict=True)), key=repr)
    assert rows(queries.op5_simhash_bktree(spark, SF), "doc_id", "fingerprint", "component_id") == wanted


def test_op6(spark, texts):
    found = {r.doc_id: r for r in queries.op6_pii_deobfuscation(spark, SF).collect()}
    assert sorted(found) == sorted(i for i, _ in texts)
    for i, t in texts:
        s, r = brute_pii(t), found[i]
        n = Counter(k for _, k, _ in s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n[0], n[1], n[2], n[3])
        assert r.base_sha256 == hashlib.sha256(pii.joined(s).encode()).hexdigest()
        assert not s or set(pii.joined(s).split(",")) <= set(r.spans.split(","))


def test_op8(spark, texts):
    assert rows(queries.op8_exact_dedup(spark, SF), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(texts)


def test_op10(spark, texts):
    assert rows(queries.op10_difference_cover(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(texts)

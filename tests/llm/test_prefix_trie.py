"""The prefix trie against a brute-force trie and against its SQL."""

import hashlib
import os
import random
import zlib

import pytest
from llm_cases import rows

from tessella.llm import oracles, queries
from tessella.llm import prefix_trie as trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, path string, top long, rank int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table_of(spark, turns):
    return spark.createDataFrame([(*t, "k", 1, "p", 2, 3) for t in turns], SCHEMA)


def originals(turns):
    """Ordered (role, text) turns of each conversation."""
    out = {}
    sha = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, n, r, t in turns:
        if c is not None:
            out.setdefault(c, []).append((n is not None, n or 0, sha(r or "", t or ""), (r or "", t or "")))
    return {c: [x[3] for x in sorted(ts)] for c, ts in out.items()}


def rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def brute(convs):
    """All nodes by their definitions."""
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    found = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        found.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(x) > len(q) and x[: len(q)] == q for x in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


def random_turns(seed, n=60, longest=7, first=3):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        size = rng.randrange(1, longest)
        out += [(c, i, rng.choice(["user", "assistant"]), "héllo" if i < first else f"t{rng.randrange(3)}") for i in range(size)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations(spark, seed):
    turns = random_turns(seed)
    assert rows(trie.conversation_trie(table_of(spark, turns)), *COLUMNS) == brute(rebuilt(originals(turns)))


@pytest.mark.parametrize("group_turns", [trie.GROUP_TURNS, 30])
def test_deep_conversations_by_groups_and_by_rounds(spark, group_turns):
    rng = random.Random(7)
    turns = []
    for c in range(24):
        kind = c % 3  # three families that share long beginnings, copies included
        for i in range([5, 19, 37][kind] + (c % 4)):
            turns.append((c, i, "user", f"{kind}-{i}" if i < 17 + c // 12 else f"x{rng.randrange(2)}"))
    numbered = trie.turns(table_of(spark, turns))
    assert rows(trie.build_trie(trie.own_turns(numbered), group_turns), *COLUMNS) == brute(originals(turns))


def test_a_thousand_turns_take_few_rounds(spark, monkeypatch):
    written = []
    keep = trie.shared_table
    monkeypatch.setattr(trie, "shared_table", lambda df, name: written.append(name) or keep(df, name))
    turns = [(c, i, "user", f"t{i}" if i < 3 else f"{c}-{i}") for c in (1, 2) for i in range(1000 if c == 1 else 4)]
    found = rows(trie.build_trie(trie.own_turns(trie.turns(table_of(spark, turns)))), *COLUMNS)
    assert len(found) == 4 + 997 + 1 and len(written) < 22
    assert [r for r in found if r[1] == 1000] == [(1, 1000, 1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_edge_cases(spark):
    turns = [
        (1, None, "user", "a"), (1, 0, None, None), (1, 2, "", ""), (2, 1, "user", "same"), (2, 1, "user", "same"), (2, 1, "user", "tie"),
        (None, 1, "user", "nobody"), (3, 1, "user", "x" * 300_000), (4, 5, "u", "ab"), (9, 5, "ua", "b"), (5, 0, "user", "😀"), (7, 0, "user", "😀"),
    ]
    assert rows(trie.conversation_trie(table_of(spark, turns)), *COLUMNS) == brute(rebuilt(originals(turns)))
    own = trie.build_trie(trie.own_turns(trie.turns(table_of(spark, turns))))
    assert rows(own, *COLUMNS) == brute(originals(turns))
    assert trie.conversation_trie(table_of(spark, [])).collect() == []


def test_ids_of_a_crowded_end_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 100)
    keyed = [(b"a", c) for c in range(500)] + [(b"b", 7)]
    batches = [trie.pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "conv_id": [c for _, c in part]}) for part in (keyed[:30], keyed[30:333], keyed[333:])]
    chunks = list(trie._id_chunks(iter(batches)))
    assert sum(len(b) for b in chunks) > 50
    found = [r for b in trie._ends(iter(chunks)) for r in b.to_pylist()]
    sha = hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert found == [{"key": b"a", "conv_id": 0, "n_convs": 500, "ends_sha256": sha}, {"key": b"b", "conv_id": 7, "n_convs": 1, "ends_sha256": hashlib.sha256(b"7").hexdigest()}]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = con.execute(oracles.SQL["op12_prefix_trie"])
    assert [d[0] for d in wanted.description] == list(COLUMNS)
    found = rows(queries.op12_prefix_trie(spark, SF), *COLUMNS)
    assert found == sorted(wanted.fetchall(), key=repr)
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == brute(rebuilt(originals(turns)))

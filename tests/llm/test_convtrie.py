import hashlib
import random
import zlib

import numpy as np
import pytest

from lindero.llm import convtrie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(seqs):
    """The rows of the trie in plain Python, from all prefixes."""
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in below)]
        ends = sorted(c for c in members if len(seqs[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), len(leaves),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "k", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, keys string, depth int")


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, seed, words=3, turns=7):
    """Conversations that share starts, some of them whole."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(600), n):
        for t in range(r.randrange(1, turns)):
            rows.append((c, t, r.choice(["user", "assistant"]), "é🙂 word" * r.randrange(words)))
    return rows


@pytest.fixture
def many_parts(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,n", [(1, 150), (2, 60)])
def test_against_all_prefixes(spark, many_parts, monkeypatch, seed, n):
    monkeypatch.setattr(convtrie, "IDS", 3)
    monkeypatch.setattr(convtrie, "ROWS", 5)
    rows = made(n, seed)
    rows += [(1000 + i, t, "user", "hot") for i in range(40) for t in range(3)]  # copies
    rows += [(2000 + i, t, "user", f"hot {t}" if t else "hot") for i in range(30) for t in range(1 + i % 5)]
    assert got(convtrie.conversation_trie(table(spark, rows))) == brute(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, "a"), (1, 0, "", "a"), (1, 0, "user", None), (2, 3, None, None), (None, 0, "user", "x"), (103, 1, "user", "long " * 50_000), (100, 5, "user", "x"), (100, None, None, "x\x00y")]
    rows += [(7, t, "user", str(t)) for t in range(400)] + [(7, t, "user", str(t)) for t in range(390, 400)]
    rows += [(c, 0, "u", "t") for c in range(900, 930)]  # of these some have no turn left
    assert got(convtrie.conversation_trie(table(spark, rows))) == brute(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert got(convtrie.conversation_trie(table(spark, []))) == []
    assert got(convtrie.conversation_trie(table(spark, [(None, 1, "a", "b")]))) == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert got(convtrie.conversation_trie(table(spark, [(lone, 0, "a", "b")]))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_a_part_gives_compressed_edges_only():
    """Of a long sequence without a branch, one point is made."""
    key = lambda t: bytes([t]) * convtrie.KEY
    seq = lambda *ts: (b"".join(map(key, ts)), np.array([10 * t for t in ts], "<i8"))
    rows = [(1, *seq(1, 2, 3, 4)), (5, *seq(1, 2, 3, 4)), (3, *seq(1, 2, 9))]
    out = list(convtrie._part(iter(rows), -1, -1))
    closed = [(r[3], r[4], r[5], r[6], r[7], r[8], r[10]) for r in out if r[0] == convtrie._CLOSED]
    assert closed == [(4, 2, 1, 0, 1, 40, [30, 0]), (3, 1, 3, 0, 1, 0, [0]), (2, 3, 1, 2, 2, 110, [10, 0])]
    assert [(r[3], r[4], r[6], r[7], r[8]) for r in out if r[0] == convtrie._OPEN] == [(0, 3, 1, 2, 130)]

import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, documents, prose

from lindero.llm import minhash
from lindero.llm.similar import shingles


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs, in plain Python."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {" ".join(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[find(i)] = min(least.get(find(i), id_), id_)
    return sorted(((id_, len(s), least.get(find(i)), id_ is not None and id_ == least[find(i)]) for i, ((id_, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(seed, groups=12, copies=12):
    """Copies of copies, some of which share just under and some just over 0.8."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(100 * seed + g, r.choice([5, 9, 30, 80, 300])).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 30)):
                w[r.randrange(len(w))] = f"new{r.random()}"
            rows.append(" ".join(w))
            base = w if r.random() < 0.5 else base
    return [(i, t) for i, t in zip(r.sample(range(10_000), len(rows)), rows, strict=True)]


@pytest.mark.parametrize("seed,rounds,chunk", [(1, 3, 1024), (2, 0, 5), (3, 1, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, rounds, chunk):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "_TILE", 3)
    rows = near_copies(seed) + [(20_000 + i, "a common line of six words") for i in range(40)]
    want = brute(rows)
    assert got(minhash.near_duplicates(documents(spark, rows).repartition(5))) == want
    assert 20 < len({w[2] for w in want}) < len(rows) - 60


def test_awkward_rows(spark):
    rows = AWKWARD + [(30, "One two"), (31, "one TWO"), (31, "three"), (None, "one two"), (None, "alone among rows"), (32, "a b c d"), (33, "É a b c"), (34, "é a b c")]
    assert got(minhash.near_duplicates(documents(spark, rows))) == brute(rows)
    assert got(minhash.near_duplicates(documents(spark, []))) == []
    assert got(minhash.near_duplicates(documents(spark, [(1, None), (2, " ")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_near_the_similarity():
    r = random.Random(5)
    off = []
    for _ in range(200):
        a = [f"w{r.randrange(10**6)}" for _ in range(300)]
        b = list(a)
        for _ in range(r.randrange(40)):
            b[r.randrange(300)] = f"v{r.random()}"
        sets = [shingles(" ".join(x).encode(), 4) for x in (a, b)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        low = minhash.minima(sets)
        x, y = minhash.signature(low)
        lanes = [(int(x[k]) >> s & 15) == (int(y[k]) >> s & 15) for k in range(8) for s in range(0, 64, 4)]
        assert lanes == [int(p) & 15 == int(q) & 15 for p, q in zip(*low, strict=True)]
        off.append(minhash.estimate(sum(lanes)) - true)
        if true >= 0.8:
            assert sum(lanes) >= minhash.least_equal() and (minhash.bands(low)[0] == minhash.bands(low)[1]).any()
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


def test_lanes_are_counted_alike_in_spark(spark):
    low = minhash.minima([np.arange(i, i + 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in (0, 5)])
    a, b = minhash.signature(low).view(np.int64).tolist()
    want = int(((low[0] & np.uint64(15)) == (low[1] & np.uint64(15))).sum())
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(minhash._equal_lanes("a", "b")).first()[0] == want

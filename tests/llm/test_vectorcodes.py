import hashlib
import math
import random

import numpy as np

from lindero.llm import vectorcodes


def brute(rows):
    """vec_id -> (code, error, label_error), and the hash of the codebooks, in plain Python over all distances."""
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(ok[0][1]) // 16
    cut = lambda v: [v[p * w : p * w + w] for p in range(16)]
    cuts = [cut(v) for _, v, _ in ok]
    first = sorted(range(len(ok)), key=lambda r: ok[r][0])[:64]
    books = [[cuts[r][p] for r in first] for p in range(16)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (d(c[p], books[p][e]), e)) for p in range(16)] for c in cuts]

    for _ in range(2):
        codes = assign()
        for p in range(16):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cuts, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = assign()
    errors = [sum(d(c[p], books[p][k[p]]) for p in range(16)) for c, k in zip(cuts, codes, strict=True)]
    by = {}
    for (_, _, label), e in zip(ok, errors, strict=True):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{x:02x}" for x in k), e, by[label]) for (i, _, label), k, e in zip(ok, codes, errors, strict=True)}, sha


KIND = "vec_id long, embedding array<float>, label int, id string, code string, error double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 0.5) for i, v, label in rows], KIND)


def got(df):
    rows = df.collect()
    return {r.vec_id: (r.code, r.error, r.label_error) for r in rows}, {r.codebooks_sha256 for r in rows}


def made(n, seed, length=32, step=0.25):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0, 1) / step) * step for _ in range(length)], r.choice([0, 1, None])) for i in r.sample(range(10 * n), n)]


def test_against_all_distances(spark):
    rows = made(300, 1) + [(5001, None, 1), (5002, [None] * 32, 1), (5003, [float("nan")] * 32, 0), (5004, [float("inf")] + [0.0] * 31, None), (5005, [], 1)]
    rows += [(6000 + i, rows[7][1], 1) for i in range(50)]  # copies
    want, sha = brute(rows)
    found, shas = got(vectorcodes.compress(table(spark, rows).repartition(5)))
    assert found == want and shas == {sha}
    assert 5001 not in found


def test_few_rows_and_ties(spark):
    rows = [(3, [0.0] * 16, None), (1, [1.0] * 16, None), (2, [-1.0] * 16, 4), (9, [0.0] * 16, 4)]
    want, sha = brute(rows)
    found, shas = got(vectorcodes.compress(table(spark, rows)))
    assert found == want and shas == {sha}


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0] * 16, 1), (2, [2.0] * 15, 1), (3, [2.0] * 48, 1), (4, [1e30] + [0.0] * 15, 1), (None, [3.0] * 16, 2), (1, [1.0] * 16, 1), (1, [0.5] * 16, 1)]
    out = vectorcodes.compress(table(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.error) for r in out) == [(0, 0), (1, 0), (1, 0), (1, 0)]
    assert vectorcodes.compress(table(spark, [])).collect() == []
    assert vectorcodes.compress(table(spark, [(1, None, None)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_annuli_leave_out_entries_and_keep_ties():
    r = np.random.default_rng(3)
    spread = r.choice([20, 100, 500], (3064, 1))
    every = np.floor(r.normal(0, 1, (3064, 4)) * spread).astype(int)
    entries, parts = every[:64], every[64:]
    entries[40] = entries[11]
    parts[:64] = entries
    code, d, pairs = vectorcodes.Annuli(entries).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (d == every.min(1)).all()
    assert pairs < 0.7 * every.size
    one = vectorcodes.Annuli(entries[:1]).nearest(parts)
    assert (one[0] == 0).all() and (one[1] == every[:, 0]).all()


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = made(120, 5)
    df = table(spark, rows)
    books = vectorcodes.fit(df)
    for r in vectorcodes.decode(vectorcodes.encode(df, books, ["vec_id", "embedding"]), books).collect():
        assert sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(r.embedding, r.decoded, strict=True)) == r.error

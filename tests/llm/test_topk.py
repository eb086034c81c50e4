import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lindero.llm import topk


def slow(rows, k):
    """Every row as a query against all other rows; equal query rows once."""
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, v) for i, v in good if i % 100 == 0}):
        own = good.index((i, q))
        scored = sorted(((sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(good) if n != own and len(v) == len(q)), key=lambda x: (-x[0], x[1]))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n):
    r = random.Random(3)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(r.gauss(0, 1)) for _ in range(12)]) for i in range(n)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # one very common vector
    rows += [(3000, None), (3100, []), (3200, [1.0, None]), (3300, [float("nan")] * 12), (3400, [float("inf")] * 12), (None, rows[1][1]), (3500, [1.0, 2.0]), (3501, [0.5, 0.25]), (7, rows[7][1])]
    rows += [(200, [f(r.gauss(0, 1)) for _ in range(12)]) for _ in range(3)] + [(200, rows[200][1])] * 2 + [(200, [0.5, 0.5])]  # one id, several queries
    return rows + [(4000, [f(-x) for x in rows[5][1]]), (4100, [0.0] * 12), *[(4200, rows[5][1])] * 20]


@pytest.mark.parametrize("first,step,tile", [(1024, 64, 16_000_000), (10, 3, 700), (40, 4, 10_000), (5000, 64, 2000)])
def test_equals_brute_force(spark, monkeypatch, first, step, tile):
    for name, value in (("FIRST_ROWS", first), ("STEP", step), ("TILE_BYTES", tile), ("BATCH", 100)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(900)
    df = spark.createDataFrame([(i, v, "x", True) for i, v in rows], "vec_id long, embedding array<float>, id string, asked boolean")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score", "query_key"]
    rows_got = got.collect()
    assert sorted(tuple(r)[:4] for r in rows_got) == slow(rows, 10)
    assert len({r.query_key for r in rows_got if r.query_id == 200}) == 5


def test_phases_keep_the_best():
    r = np.random.default_rng(0)
    for _ in range(200):
        parts, ids = r.integers(-50, 50, (4, 300)), r.permutation(300)
        total = parts.sum(0)
        top = topk.best(total, ids, 10)
        cutoff = int(total[top].min())
        last = int(ids[top][total[top] == cutoff].max())
        assert set(topk.sufficient(parts, ids, cutoff, last)) == set(top)
        safe = np.sort(total[topk.local_lists(parts, ids, 10)])[-10]
        assert safe <= cutoff


def test_empty_and_large_numbers(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
    df = spark.createDataFrame([(100, [3e6, 1.0]), (1, [2e6, 7.0]), (2, [-2e6, 7.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r)[:4] for r in got] == [(100, 1, 1, 3072000000 * 2048000000 + 7168 * 1024), (100, 2, 2, -3072000000 * 2048000000 + 7168 * 1024)]

import pathlib
import random
import tempfile

import numpy as np
import pytest
from helpers import AWKWARD, documents, prose

import corpus_pipeline
from lindero.llm import similar
from lindero.llm.common import written_table
from lindero.llm.similar import near_duplicates


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def slow_components(rows):
    sets, label = [slow_set(t) for _, t in rows], list(range(len(rows)))
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(((d, min((e for (e, _), x in zip(rows, label, strict=True) if x == y and e is not None), default=None)) for (d, _), y in zip(rows, label, strict=True)), key=repr)


def edited(seed, n, edits):
    words, r = prose(seed, n).split(), random.Random(edits)
    for i in r.sample(range(n), edits):
        words[i] = f"edit{edits}x{i}"
    return " ".join(words)


def near_copies():
    """Copies with so many edits that they lie on both sides of the threshold, chains, and a line that all have."""
    rows = [(1000 - 20 * g - k, edited(g, n, k)) for g, n in enumerate((12, 30, 90, 160, 300)) for k in range(9)]
    words = prose(77, 100).split()
    rows += [(1500 + i, " ".join(words[4 * i : 4 * i + 60])) for i in range(8)]
    return rows + [(2000 + i, prose(500 + i, 30) + " a line that is found in each of these texts and many others") for i in range(60)]


@pytest.mark.parametrize("rows", [AWKWARD, near_copies()], ids=["awkward", "near"])
@pytest.mark.parametrize("rounds,chunk", [(0, 7), (2, 1024)])
def test_equals_brute_force(spark, monkeypatch, rows, rounds, chunk):
    monkeypatch.setattr(similar, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(similar, "CHUNK", chunk)
    got = near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == slow_components(rows)
    assert len({r[1] for r in got}) < len(rows)


def test_keys_keep_the_bound():
    r = random.Random(1)
    for _ in range(100):
        n = r.randrange(1, 200)
        a = np.array(sorted(r.sample(range(10_000), n)), np.uint64)
        gone = r.randrange(n // 9 + 1)
        b = np.unique(np.concatenate([a[np.array(r.sample(range(n), n - gone), int)], np.array(r.sample(range(10_000, 20_000), gone), np.uint64)]))
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            counts = np.random.default_rng(n).integers(0, 4, similar.COUNTERS).astype(np.uint8)
            met = np.intersect1d(similar.keys(a, counts), similar.keys(b, counts))
            assert len(met) >= min(similar.shared_keys(len(a)), similar.shared_keys(len(b)))


@pytest.mark.parametrize("chunk", [3, 1000])
def test_close_pairs_lose_none(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    texts = [t for _, t in near_copies()]
    sets = [similar.shingles(t.encode()) for t in texts]
    rows = [(key, len(sets), i, len(s), i // 2, similar.cells(s), [5, -9]) for key in (5, -9) for i, s in enumerate(sets)]
    met = spark.createDataFrame(rows, "key long, size long, rep long, n long, label long, cells binary, keys array<long>").repartition(5)
    rows = [tuple(r) for r in similar.close_pairs(met, (4, 5)).collect()]
    got = set(rows)
    assert len(got) == len(rows)
    true = {(a, b) for b in range(len(sets)) for a in range(b) if a // 2 != b // 2 and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert true and true <= got and len(got) < len(sets) ** 2 / 10


def test_last_round_carries_open_keys_only(spark, monkeypatch):
    """Keys under which no labels differ, as nearly all keys of a text are its own, don't go along with it."""
    carried, whole = [], similar.close_pairs

    def looked_at(met, least):
        carried.extend((r.key, r.keys) for r in met.select("key", "keys").collect())
        return whole(met, least)

    monkeypatch.setattr(similar, "close_pairs", looked_at)
    monkeypatch.setattr(similar, "HUB_ROUNDS", 0)
    got = near_duplicates(documents(spark, near_copies())).collect()
    assert sorted(map(tuple, got), key=repr) == slow_components(near_copies())
    held = {k for k, _ in carried}
    assert carried and all(k in keys and held.issuperset(keys) for k, keys in carried)


def test_keys_of_the_same_texts_are_one(spark):
    """Texts that share a passage share all its keys; a text's other keys are its own."""
    keys = {1: [1, 2, 3, 4, 10, 11], 2: [1, 2, 3, 4, 12], 3: [3, 4, 5, -7], 4: [5, -7, 13], 5: [14, 15], 6: [], 7: [1, 2, 3, 4]}
    rows = spark.createDataFrame([(rep, 9 * rep, k) for rep, k in keys.items()], "rep long, n long, keys array<long>")
    got = sorted(map(tuple, similar.shared(rows).select("rep", "n", "key", "times").collect()))
    assert got == sorted((rep, 9 * rep, key, 2) for key, reps in {1: (1, 2, 7), 3: (1, 2, 3, 7), -7: (3, 4)}.items() for rep in reps)


def test_shuffles_go_with_their_query(spark, tmp_path):
    """No file of a shuffle is left when a table has been written."""
    left = lambda: {p for top in {spark.conf.get("spark.local.dir", tempfile.gettempdir())} for p in pathlib.Path(top).glob("blockmgr-*/*/shuffle_*.data")}
    before = left()
    out = written_table(spark.range(1000).repartition(3, "id").groupBy("id").count())
    made = left() - before
    assert out.count() == 1000
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "plain"))
    assert not made and left() - before


def test_counts_of_shingles(spark):
    rows = near_copies() + [(9000 + i, "the same text for all of them here") for i in range(300)]
    got = similar.shingle_counts(documents(spark, rows).repartition(7))
    want = np.zeros(similar.COUNTERS, np.int64)
    for _, t in rows:
        np.add.at(want, similar._place(similar.shingles(t.encode())), 1)
    assert (got == np.minimum(want, 255)).all() and got.max() == 255


def test_stage_removes_edited_copies(spark):
    rows = [(1, prose(1, 160)), (2, edited(1, 160, 2)), (3, edited(1, 160, 60)), (4, prose(4, 160))]
    left = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in left) == [1, 3, 4]

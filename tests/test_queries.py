import glob
import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lindero.functions import listing, text
from lindero.plans import sample
from lindero.plans.file_queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return v if isinstance(v, str) else str(v) if not isinstance(v, (int, float)) and not hasattr(v, "item") else float(f"{float(v):.9g}")

    df = df[sorted(df.columns)]
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want) and len(want)


def test_cross_source_duplicates_has_the_pairs_from_the_default_threshold(spark):
    """Pairs of the registered query against a comparison of all pairs; some lie between 0.62 and 0.7."""
    df = sample.listings(spark, FOLDER)
    df = df.withColumns({f"k_{f}": text.match_key(F.col(f)) for f in listing.MATCH_TEXTS})
    score = listing.duplicate_score("a", "b").alias("score")
    every = df.alias("a").join(df.alias("b"), F.expr("a.source < b.source")).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), score).where("score >= 0.62")
    want = {(r.left_id, r.right_id): round(r.score, 6) for r in every.collect()}
    assert {(r.left_id, r.right_id): r.score for r in QUERIES["cross_source_duplicates"](spark, FOLDER).collect()} == want
    assert any(s < 0.7 for s in want.values())


def test_likely_duplicates_stop_where_enough_pairs_score_more(spark, monkeypatch):
    """The first pairs are those of a search from the least score on, though pairs that score less aren't met; with too few, all steps are gone through."""
    from lindero.operators import spatial

    df = sample.listings(spark, FOLDER)
    want = spatial.cross_source_pairs(df).orderBy(F.desc("score"), "left_id", "right_id").collect()
    met, pairs = [], spatial._pairs
    monkeypatch.setattr(spatial, "_pairs", lambda slim, least: met.append(least) or pairs(slim, least))
    assert spatial.likely_duplicates(df, most=3).collect() == want[:3] and min(met) > 0.62
    assert spatial.likely_duplicates(df, most=len(want) + 1).collect() == want and min(met) == 0.62


def test_seed_stability_has_ten_seeds_by_five_splits(spark, monkeypatch):
    """The registered query makes as many fits as the operator does by itself, each on rows of its own."""
    from lindero.operators import evaluation

    seeds, tests = [], set()

    def fitted(train, *a, **how):
        seeds.append(how["seed"] if "seed" in how else a[-1])

    def predicted(model, rows):
        tests.add(rows.select(F.bit_xor(F.xxhash64("price")).alias("x")).first().x)
        return rows.withColumn("predicted_price", F.col("price") * 2)

    monkeypatch.setattr(evaluation, "fit_model", fitted)
    monkeypatch.setattr(evaluation, "predict", predicted)
    got = {r.metric: r for r in QUERIES["seed_stability"](spark, FOLDER).collect()}
    assert sorted(seeds) == sorted([*range(10)] * 5) and len(tests) == 50
    assert set(got) == {"mae", "mape", "r2", "within_20_pct", "within_30_pct"} and got["mape"].mean == pytest.approx(100) and got["mae"].std > 0


@pytest.mark.parametrize("sources", [3, 2, 1, 0])
def test_sources_are_dealt_only_to_sides_that_they_can_be_on(spark, sources):
    """The first source is never the right one of a pair, nor the last the left one."""
    from lindero.operators import spatial

    df = sample.listings(spark, FOLDER).where(F.col("source") < "portal_" + "abcd"[sources])
    pairs = spatial.cross_source_pairs(df)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    bounds = set(re.findall(r"source#\d+ ([<>]) (portal_\w)", plan))
    assert sources == 0 or bounds == {(">", "portal_a"), ("<", "portal_" + "abc"[sources - 1])}
    of = {r.id: r.source for r in df.select("id", "source").collect()}
    got = pairs.collect()
    assert all(of[r.left_id] < of[r.right_id] for r in got) and bool(got) == (sources > 1)

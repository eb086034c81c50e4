"""Operators on small tables: quantiles and ranks against plain Python, models, streams and whole plans."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lindero.functions import listing, text
from lindero.operators import comparables, evaluation, metrics, quantiles, scopes, upsert, windows
from lindero.plans import pipelines, sample
from lindero.sources import portals
from lindero.streaming import ingest


def groups(seed, n=4000):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1), float(r.randint(0, 3)), r.expovariate(1e-6)]), i) for i in range(n)]
    return rows + [("lone", 5.0, n), ("none", None, n + 1), ("a", None, n + 2)]


@pytest.mark.parametrize("small,accuracy", [(1_000_000, 10_000), (100, 200), (100, 30)])
def test_quantiles_equal_brute_force(spark, monkeypatch, small, accuracy):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rows = groups(1)
    df = spark.createDataFrame(rows, "k string, x double, id long").withColumn("y", -F.col("x")).repartition(5)
    wanted = {f"{c}{int(100 * p)}": (c, p) for c in "xy" for p in (0, 0.05, 0.5, 0.68, 0.999, 1)}
    for keys in ([], ["k"]):
        got = {r["k"] if keys else "all": r for r in quantiles.quantiles(df, wanted, *keys).collect()}
        for k in {r[0] for r in rows} if keys else {"all"}:
            x = np.array([v for g, v, _ in rows if v is not None and (not keys or g == k)])
            if len(x):
                for name, (c, p) in wanted.items():
                    assert got[k][name] == pytest.approx(np.quantile(x if c == "x" else -x, p), rel=1e-12)
            else:
                assert k not in got or got[k]["x50"] is None


def test_quantiles_of_middling_groups_keep_few_values(spark, monkeypatch):
    """Groups far below SMALL values are told by their brackets, too: only what lies there is kept apart. More groups than are sent to all tasks give the same."""
    monkeypatch.setattr(quantiles, "SMALL", 3000)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    kept, sums = [], quantiles.running_sums
    monkeypatch.setattr(quantiles, "running_sums", lambda counts, *how: kept.append(counts.count()) or sums(counts, *how))
    values = {k: [r.x for r in df.where(F.col("k") == k).collect()] for k in (0, 1)}
    for groups_sent in (10, 1):
        monkeypatch.setattr(quantiles, "GROUPS", groups_sent)
        got = {r.k: r.m for r in quantiles.quantiles(df, {"m": ("x", 0.5)}, "k").collect()}
        assert got == {k: pytest.approx(np.median(v), rel=1e-12) for k, v in values.items()}
    assert max(kept) < 400


@pytest.mark.parametrize("buckets", [2, 256])
def test_ranks_and_running_sums(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rows = groups(2, 900)
    df = spark.createDataFrame(rows, "k string, x double, id long").repartition(3)
    got = {r.id: (r["__rank"], r["__n"]) for r in quantiles.ranked(df, ["k"], F.col("x"), "id").collect()}
    for k in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in order] == [(i + 1, len(order)) for i in range(len(order))]
    steps = spark.createDataFrame([(k, float(i), 1.0 + i % 3) for k in ("a", None) for i in range(300)], "k string, x double, w double")
    for r in quantiles.running_sums(steps, ["k"], "x", "w").collect():
        assert r.so_far == sum(1.0 + i % 3 for i in range(int(r.x) + 1)) and r.all == sum(1.0 + i % 3 for i in range(300))


@pytest.mark.parametrize("buckets", [2, 64])
def test_slugs_of_a_common_title(spark, monkeypatch, buckets):
    """Most rows share a slug, some share a number, too, and some have none."""
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rows = [("casa" if i % 10 else f"lote {i % 3}", None if i % 50 == 1 else i // 3 % 40, i) for i in range(600)]
    df = spark.createDataFrame(rows, "slug string, n int, id long").repartition(4)
    got = {r.id: r.unique_slug for r in windows.numbered_slugs(df, "slug", "n", "id").collect()}
    held = {}
    for slug, _, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        held[slug] = held.get(slug, 0) + 1
        assert got[i] == (slug if held[slug] == 1 else f"{slug}-{held[slug]}")
    assert len(set(got.values())) == 600


@pytest.fixture(scope="module")
def priced(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["casa", "terreno"]), 40.0 + i % 90, r.choice(["M1", "M2", "M3"]), "s" + str(i % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, property_type string, size double, municipality string, source string")
    return df.withColumn("price", F.col("size") * 10_000 * F.when(F.col("property_type") == "casa", 3).otherwise(1) + F.col("id") % 7 * 1000).withColumn("fold", (F.col("id") % 2).cast("int")).cache()


def fitted(train, test):
    return evaluation.fit_predict(train, test, ["size"], ["property_type"], "random_forest")


def test_models_are_compared(spark, priced, monkeypatch):
    few = {n: evaluation.MODELS[n] for n in ("random_forest", "gradient_boosting")}
    monkeypatch.setattr(evaluation, "MODELS", few)
    got = evaluation.compare_models(priced, "fold", 2, ["size"], ["property_type"]).collect()
    assert [(r.model, r.target) for r in sorted(got, key=lambda r: (r.model, r.target))] == [(m, t) for m in sorted(few) for t in ("log", "raw")]
    assert [r.mae for r in got] == sorted(r.mae for r in got) and all(r.n == 240 and r.r2 > 0.8 for r in got)


def test_ablation_and_left_out_groups(spark, priced):
    got = evaluation.ablation(priced, "fold", 2, {"size": (["size"], []), "both": (["size"], ["property_type"])}, model="random_forest").orderBy("step").collect()
    assert got[0].mae_change == 0 and got[1].mae_change == pytest.approx(got[1].mae - got[0].mae) and got[1].mae_change < 0
    out = {r.left_out: r.n for r in evaluation.leave_one_out(priced, "municipality", ["M1", "M2"], fitted).collect()}
    assert out == {m: priced.where(F.col("municipality") == m).count() for m in ("M1", "M2")}


def test_permutation_importance(spark, priced):
    model = evaluation.fit_model(priced, ["size"], ["property_type"], "random_forest")
    error = lambda rows: metrics.errors(evaluation.predict(model, rows).withColumn("actual_price", F.col("price"))).select("mae")
    got = {r.feature: r for r in evaluation.permutation_importance(error, priced.withColumn("noise", F.lit(1.0)), ["size", "property_type", "noise"], repeats=2).collect()}
    assert got["size"].importance > 0 and got["property_type"].importance > 0 and abs(got["noise"].importance) + got["noise"].spread < 1e-6


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 1000, 1023])
def test_permuted_numbers_are_all_numbers(spark, n):
    rows = spark.range(n).select("id", *[evaluation.permuted(F.col("id"), n, seed).alias(f"p{seed}") for seed in (1, 2)]).collect()
    for c in ("p1", "p2"):
        assert sorted(r[c] for r in rows) == list(range(n))
    if n >= 1000:
        assert sum(r.p1 == r.id for r in rows) < 10 and sum(r.p1 == r.p2 for r in rows) < 10
        assert abs(np.corrcoef([r.id for r in rows], [r.p1 for r in rows])[0, 1]) < 0.15


def test_rows_are_numbered_over_parts(spark):
    df, n = evaluation.numbered(spark.range(0, 1000, 1, 7).where("id % 3 <> 0"))
    assert n == 666 and sorted(r["__row"] for r in df.collect()) == list(range(666))


def test_resamples_draw_as_many_rows_as_there_are(spark):
    df = spark.range(0, 5000, 1, 6).where("id < 1200 or id > 3000").selectExpr("double(id) as x", "1.0d as one")
    rows = metrics.resampled(df, ["x", "one"], 200, 7).collect()
    n = df.count()
    assert sorted(r.replicate for r in rows) == list(range(1, 201)) and all(r.draws == n == r.one for r in rows)
    values = np.array([r.x for r in df.collect()])
    means = np.array([r.x / n for r in rows])
    assert abs(means.mean() - values.mean()) < 5 * values.std() / np.sqrt(n * 200) and 0.8 < means.std() / (values.std() / np.sqrt(n)) < 1.25
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(metrics.resampled(df, ["x", "one"], 200, 7).collect())]


def test_folds_are_even_and_keep_groups_whole(spark):
    r = random.Random(3)
    sizes = {f"g{i}": r.choice([1, 1, 1, 2, 2, 5, 17, 40]) for i in range(300)} | {None: 9, "": 3}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string").repartition(4)
    rows = windows.group_folds(df, F.col("g"), 4).collect()
    of = {}
    for x in rows:
        of.setdefault(x.g, set()).add(x.fold)
    assert len(rows) == sum(sizes.values()) and all(len(f) == 1 for f in of.values()) and set(of) == set(sizes)
    loads = [sum(x.fold == f for x in rows) for f in range(4)]
    assert max(loads) - min(loads) <= 1
    for trial in range(200):
        sizes = [(s, r.randint(1, r.choice([1, 3, 40]))) for s in r.sample(range(1, r.choice([4, 30, 500])), r.randint(1, 3))]
        folds, loads = r.randint(1, 6), None
        loads, runs = [0] * folds, windows.deal_out(sizes, folds)
        for size, many in sorted(sizes, reverse=True):
            for at in range(many):
                want = min(range(folds), key=lambda f: (loads[f], f))
                start, turn = [x for x in runs[size] if x[0] <= at][-1]
                assert turn[(at - start) % len(turn)] == want
                loads[want] += size


def test_a_model_tells_its_features_in_order(spark, priced):
    model = evaluation.fit_model(priced, ["size"], ["property_type", "municipality"], "random_forest")
    assert evaluation.feature_contract(model) == (["size"], ["property_type", "municipality"])
    evaluation.check_contract(model, ["size"], ["property_type", "municipality"])
    with pytest.raises(ValueError, match="takes"):
        evaluation.check_contract(model, ["size"], ["municipality", "property_type"])
    with pytest.raises(ValueError, match="municipality"):
        evaluation.predict(model, priced.drop("municipality"))


def test_models_are_kept(spark, priced, tmp_path):
    model = evaluation.fit_model(priced, ["size"], ["property_type"], "random_forest")
    evaluation.save_model(model, str(tmp_path / "m"))
    again = evaluation.load_model(str(tmp_path / "m"))
    rows = lambda m: sorted((r.id, r.predicted_price) for r in evaluation.predict(m, priced.limit(20)).collect())
    assert rows(model) == rows(again)


def test_first_or_create(spark):
    known = spark.createDataFrame([("v1", "A", "active"), ("v2", "A", "off")], "version string, name string, status string")
    asked = spark.createDataFrame([("v2", "A"), ("v3", "A"), ("v3", "A"), (None, "A")], "version string, name string")
    got = sorted(tuple(r) for r in upsert.first_or_create(known, asked, ["version", "name"], {"status": "active"}).collect())
    assert got == [("v1", "A", "active"), ("v2", "A", "off"), ("v3", "A", "active")]


def test_upsert_counts_errors(spark):
    old = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id int, v double")
    new = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 1.0), (4, None), (None, 2.0)], "id int, v double")
    r = upsert.upsert_counts(old, new, ["id"], F.col("v").isNotNull(), ["v"], broken=F.col("id").isNull()).first()
    assert (r.created, r.updated, r.unchanged, r.skipped, r.errors) == (1, 1, 1, 1, 1)


def test_folding(spark):
    got = spark.range(1).select(text.ascii_fold(F.lit("ÁÉÑ Ørsted Straße Æther Łódź çÇ ŞŸ")), text.ascii_fold(F.lit(None).cast("string"))).first()
    assert got[0] == "aen orsted strasse aether lodz cc sy" and got[1] is None


def test_new_pages_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 00:10:00"), ("u2", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "url string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(folder)
    stream = ingest.new_pages(spark.readStream.schema("url string, at timestamp").parquet(folder), ["url"], "at")
    q = stream.writeStream.format("memory").queryName("new_pages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.table("new_pages").collect()) == ["u1", "u2"]


def test_versions_of_a_snapshot(spark, tmp_path):
    import os

    out, source = str(tmp_path / "s"), str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame([(i % 2, i, i)], "k int, v int, t int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v int, t int").parquet(source)
        ingest.upsert_into(spark, stream, out, ["k"], "t", str(tmp_path / "c")).awaitTermination(120)
    assert sorted(d for d in os.listdir(f"{out}/manifest")) == ["version=2", "version=3"]
    assert sorted((r.k, r.v) for r in ingest.snapshot(spark, out).collect()) == [(0, 2), (1, 3)]
    assert sorted((r.k, r.v) for r in ingest.snapshot(spark, out, 3).collect()) == [(0, 2), (1, 1)]


def pages_of(spark, **contents):
    return spark.createDataFrame([("p", f"https://example.com/property/{k}-page", v) for k, v in contents.items()], "source string, url string, content string")


def test_structured_pages(spark):
    html = """<html><title>Lote en venta</title><p>Superficie 500 m2</p><p>Colonia: Centro Norte en venta El Rosario, Cuautla, Morelos</p><p>3 recámaras</p>
    <a href="https://maps.example.com/@18.81,-98.95">m</a><p>US$ 12,000</p><script type="application/ld+json">{"@type": "Thing", "offers": {"price": "a tratar"}}</script>
    <script type="application/ld+json">not json</script><div>Propiedades similares <p>$9,999</p><p>terreno 1 m2</p></div></html>"""
    swapped = '<h1>Terreno plano</h1><script>x={"lng": -98.9, "name": 1, "lat": 18.7}</script><p>terreno de 120 m2, $ 5</p><p>1,200 m² de construcción</p>'
    got = {r.source_id: r for r in portals.parse_structured(pages_of(spark, lote=html, otro=swapped, nada=None), F.lit("Morelos"), F.lit("Cuautla")).collect()}
    a, b, none = got["lote-page"], got["otro-page"], got["nada-page"]
    assert (a.title, a.property_type, a.operation, a.price, a.currency) == ("Lote en venta", "otro", "venta", 12000.0, "USD")
    assert (a.latitude, a.longitude, a.coordinate_source, a.generic_area_m2, a.land_area_source, a.land_area_m2) == (18.81, -98.95, "map_url_at", None, "visible_label", 500.0)
    assert (a.neighborhood, a.locality, a.state, a.municipality, a.bedrooms) == ("El Rosario", "Cuautla", "Morelos", "Cuautla", 3)
    assert [(e.label, e.value) for e in a.area_evidence] == [("terreno", 500.0), ("generic", 500.0)] and "Superficie 500 m2" in a.area_evidence[0].snippet
    assert (b.property_type, b.latitude, b.longitude, b.coordinate_source, b.land_area_m2, b.construction_area_m2, b.bedrooms) == ("terreno", 18.7, -98.9, "json_inline_reversed", 120.0, 1200.0, None)
    assert (none.title, none.price, none.latitude, none.area_evidence) == (None, None, None, [])


def test_plots_take_a_generic_area(spark):
    page = "<title>Terreno en venta en la zona más tranquila de toda la ciudad</title><p>250 m2</p>"
    for parse, source in ((portals.parse_structured, "visible_label"), (portals.parse_breadcrumbs, "visible_label"), (portals.parse_labelled, "visible_label")):
        r = parse(pages_of(spark, lote=page)).first()
        assert (r.property_type, r.land_area_m2, r.land_area_source, r.generic_area_m2) == ("terreno", 250.0, source, None)


def test_labelled_places(spark):
    page = lambda where: f'<p class="price">MX$ 1,250,000</p><span itemprop="address">Localización: {where}</span>'
    got = {r.source_id: r for r in portals.parse_labelled(pages_of(spark, a1=page("Av. Sol 5, Centro, Cuautla, Mor., 62740"), b1=page("Col. Lomas, H. Cuautla, Morelos"), c1=page("El Paraíso, México"), d1="Anuncio")).collect()}
    assert [(r.street, r.neighborhood, r.locality, r.state, r.postal_code) for r in (got["a1-page"], got["b1-page"], got["c1-page"], got["d1-page"])] == [
        ("Av. Sol 5", "Centro", "Cuautla", "Mor.", "62740"), (None, "Lomas", "H. Cuautla", "Morelos", None), (None, "El Paraíso", None, None, None), (None, None, None, None, None),
    ]
    assert (got["a1-page"].price, got["a1-page"].currency) == (1250000.0, "MXN")


def test_sources_by_kind(spark):
    df = pages_of(spark, uno="<title>Casa</title>").unionByName(pages_of(spark, dos="<title>Casa</title>").withColumn("source", F.lit("q")))
    got = portals.by_source(df, {"structured": ["p"], "labelled": ["q"]})
    assert got.columns == portals.COLUMNS and sorted(r.source for r in got.collect()) == ["p", "q"]


def test_training_set_leaves_flagged_rows_out(spark):
    base = dict(id=1, source="s", source_id="x", price=1e6, property_type="casa", municipality="m", neighborhood="n", inegi_cve_ageb="a", population_density=1.0, housing_density=1.0, establishments_500m=1, establishments_1km=2, land_area_m2=100.0, construction_area_m2=80.0, bedrooms=2, bathrooms=1.0, coordinate_quality="high", latitude=18.0, longitude=-99.0, quality_flags=["missing_price"])
    cases = [{}, {"id": 2, "source_id": "y"}, {"id": 3, "price": 2e6, "quality_flags": ["invalid_price"]}, {"id": 4, "price": 3e6, "inegi_cve_ageb": None}, {"id": 5, "price": 4e6}]
    schema = "id int, source string, source_id string, price double, property_type string, municipality string, neighborhood string, inegi_cve_ageb string, population_density double, housing_density double, establishments_500m int, establishments_1km int, land_area_m2 double, construction_area_m2 double, bedrooms int, bathrooms double, coordinate_quality string, latitude double, longitude double, quality_flags array<string>"
    df = spark.createDataFrame([tuple((base | x).values()) for x in cases], schema)
    assert sorted(r.id for r in pipelines.training_set(df).collect()) == [1, 5]
    assert df.select(listing.surface_ratio()).first()[0] == 0.8


def test_scopes(spark):
    df = spark.createDataFrame([(1, "a", None, None, None, "s"), (2, None, None, None, None, "s"), (3, None, "n", "m", None, "t")], "id int, address_text string, neighborhood string, municipality string, state string, source string")
    assert [r.id for r in scopes.to_geocode(df).collect()] == [1, 3] and [r.id for r in scopes.to_geocode(df, "t", "m", 5).collect()] == [3]
    assert [r.fold for r in windows.group_folds(spark.createDataFrame([(None,)], "g string"), F.col("g")).collect()] == [0]


def test_comparables_of_large_keys_come_in_blocks(spark, monkeypatch):
    """Keys that are dealt into many chunks and parts give what whole keys give; each target's tier is the first that has enough."""
    df = sample.listings(spark, "/root/testdata/sf0.001").where("price > 0 and construction_area_m2 > 0 and latitude is not null and id < 3000")
    df = df.withColumn("price", F.when(F.col("id") % 3 == 0, 1e6).otherwise(F.col("price"))).withColumn("construction_area_m2", F.when(F.col("id") % 3 == 0, 100.0).otherwise(F.col("construction_area_m2")))  # equal unit prices
    rows = lambda: {r.target_id: (r.strategy, r.comparable_count, *[None if x is None else round(x, 6) for x in (r.mean_similarity, r.p25, r.p50, r.p75)]) for r in comparables.estimate(df, df).collect()}
    whole = rows()
    for name, value in (("CHUNK", 11), ("TARGETS", 5), ("_TILE", 3)):
        monkeypatch.setattr(comparables, name, value)
    assert rows() == whole and len(whole) > 300 and len({v[0] for v in whole.values()}) > 1
    assert comparables.estimate(df.where("false"), df).count() == 0 == comparables.estimate(df, df.where("false")).count()


def test_comparables_of_a_block_are_scored_by_distinct_values(monkeypatch):
    """Distances of points that repeat are found once for a tile, and the figures are those of all pairs."""
    rng, seen, metres = np.random.default_rng(3), [], comparables._metres
    monkeypatch.setattr(comparables, "_metres", lambda *a: seen.append(metres(*a)) or seen[-1])

    def rows(n):
        point, many = rng.integers(0, 20, n), {"built": 300, "land": 90, "beds": 5, "baths": 4, "park": 3, "ageb": 3}
        facts = {c: rng.integers(1, high, n).astype(float) for c, high in many.items()}
        return facts | {"self": np.arange(n), "klass": np.ones(n, int), "neighborhood": np.zeros(n, int), "lat": 19 + point / 100, "lon": point % 3 - 99.0, "unit": np.sort(rng.random(n)), **{f"r{i}": np.full(n, np.nan) for i in range(3)}}

    t, k = rows(150), rows(1300)
    k["unit"][-7:] = np.nan
    got = dict(zip(["self", "likes", "n", "scores", "weights", "p25", "p50", "p75"], comparables._block(t, k, None, 35.0, True), strict=True))
    assert 0 < sum(x.size for x in seen) <= 20 * 20 * -(-150 // comparables._TILE)
    rise = lambda a, b, start: min(1.0, max(0.0, (min(a, b) / max(a, b) - start) / (1 - start)))
    for i in range(0, 150, 15):
        a = {n: v[got["self"][i]] for n, v in t.items()}
        far = metres(a["lat"], a["lon"], k["lat"], k["lon"])
        score = np.array([rise(a["built"], x, 0.7) * 20 + rise(a["land"], y, 0.5) * 15 for x, y in zip(k["built"], k["land"], strict=True)])
        score += sum(np.maximum(0, 1 - np.abs(k[n] - a[n]) / 2) * w for n, w in (("beds", 10), ("baths", 8), ("park", 5)))
        score += np.maximum(0, (1 - far / 3000) * 25) + 10 + np.where(k["ageb"] == a["ageb"], 7, 0)
        ok = (score >= 35) & (k["self"] != a["self"])
        used = ok & ~np.isnan(k["unit"])
        weight = np.where(used, np.exp(score / 50) / (1 + far / 1000), 0)
        at = np.searchsorted(np.cumsum(weight), 0.5 * weight.sum())
        assert (got["likes"][i], got["n"][i], got["p50"][i]) == (ok.sum(), used.sum(), k["unit"][at]) and got["n"][i] > 0
        assert np.allclose([got["scores"][i], got["weights"][i]], [score[used].sum(), weight.sum()])


def test_cross_validation_finds_its_rows_once(spark):
    """However many folds, statistics and figures read them."""
    seen = spark.sparkContext.accumulator(0)

    def price(i):
        seen.add(1)
        return 1000.0 + i

    rows = spark.range(60).select("id", F.udf(price, "double")("id").alias("price"), (F.col("id") % 2).alias("fold"), F.col("id").cast("double").alias("size"))
    got = evaluation.cross_validate(rows, "fold", 2, numeric=["size"], categorical=[], model="random_forest")
    assert metrics.errors(got.withColumn("actual_price", F.col("price"))).first().n == 60 and seen.value == 60


def test_structured_pages_are_searched_only_for_words_that_they_have(spark):
    """A long number would take each pattern of a number beside a label the square of its digits; letters that patterns take for others count as these."""
    told = '<script type="application/ld+json">{"name":"Casa","offers":{"price":"5"},"geo":{"latitude":"18.5","longitude":-99.0},"address":{"addressLocality":"Centro","postalCode":"62000"}}</script>'

    def read(said):
        pages = spark.createDataFrame([("p", "https://e.com/casa/1234", f"<html><body>{told}<p>{said}</p></body></html>")], "source string, url string, content string")
        begin = time.monotonic()
        return portals.parse_structured(pages).first(), time.monotonic() - begin

    few, short = read("7" * 30 + " x")
    many, long = read("7" * 40_000 + " x")
    assert (few.bedrooms, many.bedrooms, many.price, many.latitude, many.neighborhood) == (None, None, 5, 18.5, "Centro")
    assert long < short + 10
    odd = read("3 RECÁMARAS, baño\u017f 2.5, E\u017ftac\u0131onam\u0130entos 4, LOTE 90 M², 70 m2 de CONSTRUCC\u0130ÓN")[0]
    assert (odd.bedrooms, odd.bathrooms, odd.parking_spaces, odd.land_area_m2, odd.construction_area_m2) == (3, 2.5, 4, 90, 70)

import math
import random

import pytest
from pyspark.sql import functions as F

from lindero.functions import geo, listing, text
from lindero.operators import comparables, metrics, spatial


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "raw,price,currency",
    [("$1,002,000 MXN", 1002000.0, "MXN"), ("USD 450,000.50", 450000.5, "USD"), ("1234,56", 1234.56, None), ("1.2.3 MN", None, "MXN"), ("  ", None, None), (None, None, None), ("a consultar $", None, "MXN"), ("$ 0", 0.0, "MXN")],
)
def test_price(spark, raw, price, currency):
    assert tuple(one(spark, text.price(F.lit(raw)))[0]) == (price, currency)


def test_text(spark):
    lit = F.lit
    assert one(spark, text.area(lit("200 m²")), text.area(lit("1,250 m2")), text.area(lit("1,5 m2")), text.whole(lit("-3 rec")), text.number(lit("2,5 baños"))) == [200.0, 1250.0, 15.0, -3, 2.5]
    kinds = ["Casa en venta", "Departamento nuevo", "Bodega industrial", "Casona", "local con terreno", "", None]
    assert one(spark, *[text.property_type(lit(k).cast("string")) for k in kinds]) == ["casa", "departamento", "bodega", "otro", "terreno", None, None]
    assert one(spark, *[text.operation(lit(k)) for k in ("Ventana amplia", "se renta", "For rent", "x", "")]) == ["venta", "renta", "renta", "desconocido", "desconocido"]
    assert one(spark, text.clean_text(lit(" a \n\t b ")), text.clean_text(lit(" \n")), text.slug(lit("¡Día Ñandú 5!")), text.code(lit("7"), 3), text.code(lit("12345"), 3)) == ["a b", None, "dia-nandu-5", "007", "12345"]
    assert one(spark, text.census_number(lit("*")), text.census_number(lit(" 12 ")), text.flags(lit('["a"]')), text.flags(lit("{bad")), text.flags(lit(None).cast("string"))) == [None, 12.0, ["a"], [], []]


def test_urls(spark):
    raw = "HTTPS://Example.com/Casa/abc-123/?utm_source=x&b=2&c=&GCLID=9#top"
    url = text.canonical_url(F.lit(raw))
    assert one(spark, url, text.source_id(url), text.source_id(text.canonical_url(F.lit("https://a.mx/x"))))[:2] == ["https://example.com/Casa/abc-123?b=2", "abc-123"]
    assert len(one(spark, text.source_id(text.canonical_url(F.lit("https://a.mx/x"))))[0]) == 40


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([(18.123456, -99.1, 12345678.4, None, 100.04, 3, 2.5, None), (None, None, 1.0, None, None, 3, None, None)], "a double, b double, c double, d double, e double, f int, g double, h int")
    got = [r[0] for r in df.select(text.python_fingerprint("a", "b", "c", "d", "e", "f", "g", "h")).collect()]
    want = '{"bathrooms":2.5,"bedrooms":3,"construction_area_m2":100.0,"latitude":18.12346,"longitude":-99.1,"price":12345678.0}'
    assert got == [hashlib.sha1(want.encode()).hexdigest(), None]


def haversine(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_geo(spark):
    p = [F.lit(x) for x in (18.82767, -98.95424, 19.4326, -99.1332)]
    d, e, inside, key, xy = one(spark, geo.haversine(*p), geo.haversine_clipped(*p), geo.within("region_17", p[0], p[1]), geo.key(p[0], p[1]), geo.lambert(F.lit(12.0), F.lit(-102.0)))
    assert abs(d - haversine(18.82767, -98.95424, 19.4326, -99.1332)) < 1e-6 and abs(d - e) < 1e-6 and inside and key == "18827670:-98954240"
    assert abs(xy.x - 2_500_000) < 1e-6 and abs(xy.y) < 1e-6


def test_bands_and_readiness(spark):
    rows = [(900000.0, "<1M"), (2500000.0, "2M-3M"), (25000000.0, ">20M"), (1e6, "1M-2M"), (0.0, None), (None, None)]
    df = spark.createDataFrame(rows, "price double, want string")
    assert all(r[0] == r[1] for r in df.select(listing.price_band(), "want").collect())
    base = dict(price=1e6, property_type="casa", inegi_cve_ageb="x", population_density=1.0, housing_density=1.0, establishments_500m=1, establishments_1km=2, land_area_m2=100.0, construction_area_m2=80.0, bedrooms=2, bathrooms=1.0, coordinate_quality="high", latitude=18.0, longitude=-99.0)
    cases = [({}, "A"), ({"coordinate_quality": "medium"}, "B"), ({"construction_area_m2": None}, "C"), ({"inegi_cve_ageb": None}, "D"), ({"price": None}, "E"), ({"property_type": "terreno", "coordinate_quality": "medium", "bedrooms": None}, "B"), ({"property_type": "departamento", "land_area_m2": None}, "A")]
    schema = "price double, property_type string, inegi_cve_ageb string, population_density double, housing_density double, establishments_500m int, establishments_1km int, land_area_m2 double, construction_area_m2 double, bedrooms int, bathrooms double, coordinate_quality string, latitude double, longitude double"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    assert [r[0] for r in df.select(listing.readiness()).collect()] == [w for _, w in cases]


def test_weighted_quantile_and_reconcile(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 4.0), (None, 9.0), (float("nan"), 9.0), (5.0, 0.0)], "v double, w double")
    assert metrics.weighted_quantiles(df, "v", "w", {"q": 0.5}).first().q == 3.0
    m = spark.createDataFrame([(3.8e6, 1.3e6, 0.8, 12, 0.3), (1e6, None, None, None, None)], "ml_prediction double, market_base double, market_strength double, comparable_count long, dispersion double")
    a, b = comparables.reconcile(m).collect()
    assert a.estimated_value < 3.8e6 and a.market_weight > 0.75
    assert (b.estimated_value, b.market_weight, b.confidence) == (1e6, 0.0, "LOW")


def test_points_in_polygons(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    square = [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    areas = spark.createDataFrame([(1, star), (2, square)], "area_id int, ring array<struct<x:double,y:double>>")
    points = [(1, 1.0, 1.0, 1), (2, 3.0, 2.0, None), (3, 4.0, 4.0, 1), (4, 5.0, 5.0, 2), (5, 9.0, 9.0, None), (6, 0.0, 2.0, 1), (7, 1.0, 2.0, 1), (8, None, 1.0, None)]
    df = spark.createDataFrame(points, "id int, latitude double, longitude double, want int")
    got = {r.id: r.area_id for r in spatial.point_in_polygon(df, areas, "id").collect()}
    assert got == {i: w for i, _, _, w in points}


def norm(x):
    return x or ""


def test_cross_source_pairs_lose_nothing(spark):
    r = random.Random(1)
    rows = []
    for i in range(260):
        lat = r.choice([18.9, 18.90001, 19.1])
        rows.append((i, r.choice("abc"), r.choice(["M1", "M2", None]), r.choice(["N1", "N2", "N3", "", None]), r.choice(["S1", "S2", None, ""]), r.choice(["casa", "terreno"]), r.choice([None, 0.0, 0.5, *[1e6 * (1 + k / 30) for k in range(8)]]), r.choice([None, 100.0, 105.0, 90.5]), r.choice([None, 50.0, 54.0, 60.0]), r.choice([None, 2, 3]), r.choice([None, 1.0, 1.5]), lat, -99.0, r.choice(["f1", "f2", None])))
    schema = "id int, source string, municipality string, neighborhood string, street string, property_type string, price double, land_area_m2 double, construction_area_m2 double, bedrooms int, bathrooms double, latitude double, longitude double, dedupe_fingerprint string"
    df = spark.createDataFrame(rows, schema)

    def close(a, b, t):
        return a is not None and b is not None and (a == b or abs(a - b) / max(abs(a), abs(b), 1) <= t)

    want = {}
    for a in rows:
        for b in rows:
            if a[1] < b[1]:
                s = sum(w for k, w in ((2, 0.12), (3, 0.12), (4, 0.10), (5, 0.10)) if norm(a[k]) and norm(a[k]) == norm(b[k]))
                s += sum(w for k, w, t in ((6, 0.20, 0.12), (7, 0.12, 0.10), (8, 0.12, 0.10), (9, 0.07, 0.01), (10, 0.07, 0.01)) if close(a[k], b[k], t))
                s += 0.08 if haversine(a[11], a[12], b[11], b[12]) <= 75 or (a[13] and a[13] == b[13]) else 0
                want[a[0], b[0]] = s / 1.1
    for least in (0.25, 0.45, 0.62, 0.8):
        got = {(r.left_id, r.right_id): r.score for r in spatial.cross_source_pairs(df, least).where(f"score > {least} + 1e-9").collect()}
        assert got.keys() == {k for k, v in want.items() if v >= least + 1e-9} and len(got) > 20
        assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    with pytest.raises(ValueError, match="agree in nothing"):
        spatial.cross_source_pairs(df, 0.2)


def test_radius_and_neighbours(spark):
    r = random.Random(2)
    points = [(i, 19 + r.random() / 50, -99 + r.random() / 50) for i in range(150)] + [(150, None, None), (151, 19.0, -99.0), (152, 19.0, -99.0)]
    places = [(i, r.choice(["461", "72"]), 19 + r.random() / 50, -99 + r.random() / 50) for i in range(120)]
    df = spark.createDataFrame(points, "id int, latitude double, longitude double")
    pl = spark.createDataFrame(places, "place_id int, activity string, latitude double, longitude double")
    got = {r.id: (r.all_500m, r.retail_1000m) for r in spatial.radius_counts(df, pl, "id", {"all": "", "retail": "46"}).collect()}
    for i, a, b in points:
        d = [(haversine(a, b, c, e), k) for _, k, c, e in places] if a else []
        assert got[i] == (sum(x <= 500 for x, _ in d), sum(x <= 1000 and k == "461" for x, k in d))
    near = {r.id: r.nearby for r in spatial.neighbours(df, "id", 120.0).collect()}
    for i, a, b in points:
        assert near[i] == (sum(1 for _, c, e in points if c and haversine(a, b, c, e) < 120) if a else 0)


def test_texts_within_texts_are_written_down_once(spark):
    """Each step reads what the one before gave; if a step stood twice in the plan, these would stand in it dozens of times."""
    df = spark.createDataFrame([(" 1,200 m2 ",), ("  ",), (None,)], "t string")
    kept = text.area(text.clean_text(text.clean_text(F.col("t")))).alias("a")
    money = text.price(text.clean_text(F.col("t")))
    got = df.select(kept, money["price"].alias("p"), text.property_type(F.col("t")).alias("k"), text.operation(F.col("t")).alias("o"))
    plan = df.select(kept)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3 and plan.count("regexp_extract(") == 1
    assert got.collect() == [(1200.0, 12002.0, "otro", "desconocido"), (None, None, None, "desconocido"), (None, None, None, "desconocido")]


def test_rows_of_one_point_are_met_as_one(spark, monkeypatch):
    rows = [(i, 19.0 + (i % 3) / 1000, -99.0) for i in range(30)] + [(30, None, None)]
    here = [(i, "46" if i % 2 else "72", 19.0003 + (i % 4) / 1000, -99.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    pl = spark.createDataFrame(here, "place_id long, activity string, latitude double, longitude double")
    met, near = [], spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda t, p, m: met.append((t.count(), p.count())) or near(t, p, m))
    got = {tuple(r)[:4] for r in spatial.nearest(df, pl, "id", F.col("place_activity"), 500.0, 3).collect()}
    assert met == [(3, 4)]  # points, not rows
    metres = lambda a, b: round(abs(a - b) * 10000) * 11.1
    want = set()
    for i, y, _ in rows[:-1]:
        for kind in ("46", "72"):
            order = sorted((metres(y, py), p) for p, k, py, _ in here if k == kind)
            want |= {(i, kind, n + 1, p) for n, (_, p) in enumerate(order[:3])}
    assert got == want
    counts = {r.id: r.all_120m for r in spatial.radius_counts(df, pl, "id", {"all": ""}, (120,)).collect()}
    plane = {r.id: r.within_120m for r in spatial.planar_counts(df, pl, "id", (120,)).collect()}
    by_hand = {i: sum(y is not None and metres(y, py) <= 120 for _, _, py, _ in here) for i, y, _ in rows}
    assert counts == plane == by_hand and spatial._points(df).count() == 3

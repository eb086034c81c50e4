from lindero.operators import requests
from lindero.operators.upsert import update_rows
from lindero.plans import pipelines

ASKED = "request_id int, settlement_id int, state string, municipality string, neighborhood string, postal_code string, latitude double, longitude double, location_source string, location_precision string"
KNOWN = "settlement_id int, settlement string, state string, municipality string, postal_code string"
PLACED = "settlement_id int, latitude double, longitude double"


def test_locations(spark):
    rows = [
        (1, 7, None, "Cuautla", None, None, None, None, None, None),  # the default state
        (2, 7, "Morelos", "Cuautla", "x", "y", 1.0, 2.0, "device", "device"),
        (3, 7, "Morelos", "Cuautla", "x", "y", 1.0, 2.0, "manual_geocode", "street"),
        (4, 7, "Morelos", None, None, None, 1.0, 2.0, "device", "device"),
        (5, 8, None, "Cuautla", None, None, None, 2.0, "device", "device"),  # no answer for it
        (6, None, None, None, "x", None, 1.0, 2.0, "manual_geocode", "street"),
        (7, None, None, None, None, None, 1.0, None, "device", None),
        (8, 99, None, "Cuautla", None, None, None, None, None, None),
        (9, 8, None, "Cuautla", None, None, 1.0, 2.0, "device", None),
    ]
    known = spark.createDataFrame([(7, "Centro", "Morelos", "Cuautla", "62740"), (8, "Sur", "Morelos", "Cuautla", "62741")], KNOWN)
    placed = spark.createDataFrame([(7, 18.5, -99.5), (8, None, -99.0)], PLACED)
    got = {r[0]: tuple(r)[1:] for r in requests.resolved_locations(spark.createDataFrame(rows, ASKED), known, placed).collect()}
    there = ("Morelos", "Cuautla", "Centro", "62740")
    gone = (None,) * 8
    assert got == {
        1: (*there, 18.5, -99.5, "sepomex_geocoded", "neighborhood", None), 2: (*there, 1.0, 2.0, "device", "device", None), 3: (*there, 18.5, -99.5, "sepomex_geocoded", "neighborhood", None),
        4: (*gone, "settlement_not_there"), 5: (*gone, "settlement_not_located"), 6: (None, None, "x", None, 1.0, 2.0, "manual_geocode", "street", None), 7: (*gone, "no_location"),
        8: (*gone, "settlement_not_there"), 9: ("Morelos", "Cuautla", "Sur", "62741", 1.0, 2.0, "device", None, None),
    }
    assert requests.resolved_locations(spark.createDataFrame([], ASKED), known, placed).count() == 0


def test_first_model_requests(spark):
    fields = "property_id int, property_type string, colonia string, land_area_m2 double, land_area double, construction_area_m2 double, construction_area double, bedrooms int, bathrooms double, parking_spaces int, property_age_years int, latitude double, longitude double"
    rows = [
        (1, "house", " COL_1", 0.0, 70.9, 80.5, 1.0, 3, 2.5, None, 0, 18.0, None),
        (2, "office", None, None, None, None, None, None, None, None, None, None, None),
        (3, "land", "  ", None, None, None, None, None, None, None, None, None, None),
        (4, "apartment", "COL_2", None, None, None, None, None, None, None, None, None, None),
        (5, None, "COL_1", None, None, None, None, None, None, None, None, None, None),
        (6, "land", "0", None, None, None, None, None, None, None, None, None, None),
    ]
    catalog = spark.createDataFrame([("COL_1 ", "Z1", 1.1)], "colonia string, zone string, factor double")
    got = {r.property_id: r for r in requests.first_model_requests(spark.createDataFrame(rows, fields), catalog).collect()}
    assert tuple(got[1])[1:] == ("casa", "COL_1", 70, 80, 3, 2, 0, 0, 18.0, 0.0, "Z1", 1.1, None)
    errors = {i: r.error for i, r in got.items() if r.error}
    assert errors == {2: "unsupported_property_type", 3: "missing_legacy_colonia", 4: "unknown_colonia", 5: "unsupported_property_type", 6: "missing_legacy_colonia"}


def test_geocode_counts(spark):
    fields = "geocode_precision string, geocode_latitude double, geocode_longitude double"
    rows = [("street", 1.0, 2.0), ("street", 0.0, 2.0), ("street", None, 2.0), (None, 1.0, 2.0), ("", 1.0, 2.0), ("unknown", 1.0, 2.0), ("elsewhere", 1.0, 2.0), ("state", 1.0, 2.0)]
    got = [tuple(r) for r in requests.geocode_counts(spark.createDataFrame(rows, fields)).collect()]
    assert [p for p, _ in got] == ["total", *requests.PRECISIONS]
    assert {p: n for p, n in got if n} == {"total": 8, "street": 1, "state": 1, "failed": 5}
    assert {n for _, n in requests.geocode_counts(spark.createDataFrame([], fields)).collect()} == {0}


def test_updates(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)], "id int, name string, value double")
    changes = spark.createDataFrame([(1, 9.0, 1), (1, None, 2), (5, 5.0, 1), (None, 7.0, 1)], "id int, value double, run int")
    got = update_rows(old, changes, "id", ["value"], "run")
    assert got.columns == old.columns
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "a", None), (2, "b", 2.0), (None, "c", 3.0)]


def test_reparse_takes_each_sources_parser(spark):
    page = lambda title: f"<html><head><title>{title}</title></head><body>Casa <p class=\"price\">MX$ 900,000</p><button data-x=\"18.5\" data-y=\"-99.1\">Mapa</button></body></html>"
    rows = [(1, "p", "https://e.com/listing-1", page("old")), (4, "p", "https://e.com/listing-1", page("new")), (2, "q", "https://e.com/property/L-12345", page("Terreno")), (3, "z", "https://e.com/x", page("none")), (5, "p", "https://e.com/listing-2", None)]
    raw = spark.createDataFrame(rows, "raw_id long, source string, url string, content string")
    got = {(r.source, r.raw_id): r for r in pipelines.reparse(raw, {"labelled": ["p"], "structured": ["q"]}).collect()}
    assert set(got) == {("p", 4), ("q", 2), ("p", 5)}
    assert got["p", 4].title == "new" and "missing_price" in got["p", 5].quality_flags
    assert got["p", 4].dedupe_fingerprint is not None and got["p", 5].title is None and got["p", 5].dedupe_fingerprint is None

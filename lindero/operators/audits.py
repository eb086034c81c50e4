"""Audits of listings and models: reliable fields, sources, requests, pages, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions import listing, places
from lindero.operators import metrics
from lindero.operators.quantiles import join_groups, quantiles

#: Where a reliable area was read.
RELIABLE_AREAS = ["visible_label", "metadata", "description"]
#: Traces of a map or a coordinate in a page, and their patterns.
MAP_TRACES = [
    ("latitude", "latitude"), ("longitude", "longitude"), ("lat", r"\blat\b"), ("lng", r"\blng\b"), ("location", "location"), ("coordinates", "coordinates"),
    ("map", r"\bmap\b|mapa"), ("maps.google", r"maps\.google|google\.com/maps"), ("google_maps", "google_maps|googleMaps"), ("center", r"\bcenter\b"),
    ("marker", r"\bmarker\b"), ("iframe", "<iframe"), ("data-*", "data-[a-z0-9_-]+"),
]
#: What a valuation request may say.
REQUEST_VALUES = {
    "property_type": ["house", "apartment", "land"], "state": ["Morelos", "Ciudad de México"], "location_source": ["device", "manual_geocode", "sepomex_geocoded"],
    "location_precision": ["device", "neighborhood", "postal_code", "locality", "municipality"],
}

#: How far a model generalises: not, in part, well.
DECISIONS = ["A_NO_GENERALIZA", "B_GENERALIZA_PARCIALMENTE", "C_GENERALIZA_RAZONABLEMENTE"]

c = F.col


def reliability(df: DataFrame) -> DataFrame:
    """metric, n, percent: how many listings have a field that can be relied on, in one pass over them."""
    has = lambda *names: listing.no(F.coalesce(*[F.nullif(c(n), F.lit("")) for n in names]).isNotNull())
    priced, typed, exact = c("price").isNotNull(), listing.no(c("property_type") != "otro"), c("latitude").isNotNull() & c("longitude").isNotNull()
    land, built = c("land_area_m2").isNotNull(), c("construction_area_m2").isNotNull()
    tests = {
        "price": listing.positive("price"), "land_area": land & listing.no(c("land_area_source").isin(RELIABLE_AREAS)), "construction_area": built & listing.no(c("construction_area_source").isin(RELIABLE_AREAS)),
        "both_areas": land & built, "ambiguous_area": c("generic_area_m2").isNotNull(), "property_type": typed, "location_text": has("location_raw", "address_text", "neighborhood"),
        "neighborhood": has("neighborhood"), "address": has("address_text"), "coordinates": exact, "price_type_land": priced & typed & land, "price_type_construction": priced & typed & built,
        "price_type_areas": priced & typed & land & built, "price_type_construction_place": priced & typed & built & (has("neighborhood") | exact),
    }
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()])
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c(n).alias("n")) for n in ("total", *tests)])).alias("x")
    return counts.select(long, "total").select("x.metric", "x.n", F.coalesce(F.try_divide(c("x.n") * 100.0, c("total")), F.lit(0.0)).alias("percent"))


def value_counts_json(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """key and, for each field, its values' counts as a JSON object in the order of the values; counted before anything is gathered."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(c(f).cast("string"), F.lit("missing")).alias("value")) for f in fields])).alias("x"))
    counts = long.groupBy(key, c("x.field").alias("field"), c("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    per = [F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(c("field") == f, F.struct("value", "n")))))).alias(f) for f in fields]
    return counts.groupBy(key).agg(*per)


def source_profile(listings: DataFrame, predictions: DataFrame, fields: tuple[str, ...] = ("property_type", "municipality", "coordinate_quality")) -> DataFrame:
    """A row for each source: size, median price, counts as JSON, missing areas in percent, errors of its predictions."""
    gone = lambda n: (F.avg(c(n).isNull().cast("double")) * 100).alias(n.replace("area_m2", "missing_pct"))
    size = listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"), gone("land_area_m2"), gone("construction_area_m2"))
    size = join_groups(size, quantiles(listings, {"median_price": ("price", 0.5)}, "source"), "source")
    errors = metrics.errors(predictions, "source").select("source", "mae", "mape", "within_20_pct", "within_30_pct")
    return size.join(value_counts_json(listings, "source", *fields), "source").join(errors, "source", "left")


def field_accuracy(read: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, n, right, missing, percent: the fields read against the true ones, over rows that are in both."""
    both = read.select(key, *[c(f).alias(f"r_{f}") for f in fields]).join(truth.select(key, *[c(f).alias(f"t_{f}") for f in fields]), key)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c(f"r_{f}").eqNullSafe(c(f"t_{f}")).alias("right"), (c(f"r_{f}").isNull() & c(f"t_{f}").isNotNull()).alias("gone")) for f in fields])).alias("x"))
    return long.groupBy(c("x.field").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_if("x.right").alias("right"), F.count_if("x.gone").alias("missing"), (F.avg(c("x.right").cast("double")) * 100).alias("percent"))


def map_traces(html: Column) -> Column:
    """Which traces of a map or a coordinate a page has."""
    return F.filter(F.array(*[F.when(listing.no(html.rlike(f"(?i){p}")), F.lit(n)) for n, p in MAP_TRACES]), lambda x: x.isNotNull())


def request_errors() -> Column:
    """The fields of a valuation request that break a rule, in the order of the rules; empty if it may be valued."""
    number = lambda n: c(n).cast("string").try_cast("double")
    blank = lambda n: F.coalesce(c(n).cast("string"), F.lit("")) == ""
    outside = lambda n, low, high: ~blank(n) & ~listing.no(number(n).between(low, high))
    whole = lambda n: ~blank(n) & ~listing.no((number(n) >= 0) & (number(n) == F.floor(number(n))))
    needed = lambda n, unless: F.when(blank(n), ~listing.no(c("property_type") == unless)).otherwise(~listing.no(number(n) > 0))
    among = lambda n: ~blank(n) & ~c(n).isin(REQUEST_VALUES[n])
    tests = [
        (blank("property_type") | among("property_type"), "property_type"), (among("state"), "state"), (outside("latitude", -90, 90), "latitude"), (outside("longitude", -180, 180), "longitude"),
        (among("location_source"), "location_source"), (among("location_precision"), "location_precision"), (needed("land_area_m2", "apartment"), "land_area_m2"),
        (needed("construction_area_m2", "land"), "construction_area_m2"), (whole("bedrooms"), "bedrooms"), (~blank("bathrooms") & ~listing.no(number("bathrooms") >= 0), "bathrooms"),
        (whole("parking_spaces"), "parking_spaces"), ((blank("latitude") | blank("longitude")) & blank("postal_settlement_id"), "postal_settlement_id"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())


def robustness(n: Column, within_20: Column, within_30: Column, mape: Column) -> Column:
    return (
        F.when(n < 10, "INSUFFICIENT_DATA").when((within_20 >= 40) & (mape <= 45), "ROBUST").when((within_30 >= 50) & (mape <= 75), "PROMISING").otherwise("WEAK")
    )


def decision(r2: Column, within_20: Column, mae_std: Column, weak: Column, extreme_mape: Column) -> Column:
    """One of DECISIONS, from a model's errors, their spread over seeds, the number of weak groups and the worst error among extreme bands."""
    return (
        F.when((r2 < 0.35) | (within_20 < 25), DECISIONS[0]).when((weak >= 3) | F.coalesce(extreme_mape > 60, F.lit(True)), DECISIONS[1])
        .when((r2 >= 0.6) & (mae_std < 900_000), DECISIONS[2]).otherwise(DECISIONS[1])
    )


def points_of_interest(elements: DataFrame) -> DataFrame:
    """category, name, kind, latitude, longitude, address of the elements (lat, lon, center, tags) that have a category and a place."""
    tags = c("tags")
    place = F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.struct("lat", "lon")).otherwise(F.struct(c("center.lat").alias("lat"), c("center.lon").alias("lon")))
    keep = [x for x in elements.columns if x not in ("lat", "lon", "center", "tags")]
    named = elements.select(*keep, places.category(tags).alias("category"), places.name(tags).alias("name"), places.kind(tags).alias("kind"), place.alias("p"), places.address(tags).alias("address"))
    return named.where("category is not null and p.lat is not null and p.lon is not null").select(*keep, "category", "name", "kind", c("p.lat").alias("latitude"), c("p.lon").alias("longitude"), "address")

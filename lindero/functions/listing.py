"""Rules over a listing's columns, which come by name from a DataFrame of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindero.functions import geo, text

#: Upper bounds and names of the price bands, which hold their lower bound.
BANDS = [(1e6, "<1M"), (2e6, "1M-2M"), (3e6, "2M-3M"), (5e6, "3M-5M"), (8e6, "5M-8M"), (12e6, "8M-12M"), (20e6, "12M-20M"), (float("inf"), ">20M")]
#: Flags that take a listing out of training.
ERROR_FLAGS = ["invalid_price", "invalid_construction_area", "invalid_land_area", "suspicious_construction_area", "suspicious_land_area", "suspicious_price_m2", "suspicious_price_per_construction_m2", "suspicious_price_per_land_m2"]
#: Municipalities in which the model is weak.
WEAK_MUNICIPALITIES = ["Cuernavaca", "Yautepec", "Temixco", "Emiliano Zapata", "Ayala"]

c = F.col


def no(x: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(x, F.lit(False))


def given(name: str) -> Column:
    """Neither null nor zero nor blank."""
    return no((c(name).cast("string") != "") & no(c(name).try_cast("double") != 0) | (c(name).cast("string") != "") & c(name).try_cast("double").isNull())


def positive(name: str) -> Column:
    return no(c(name) > 0)


def market_segment() -> Column:
    return F.when(c("property_type").isin("casa", "departamento"), "residential").when(c("property_type") == "terreno", "land")


def price_band(name: str = "price") -> Column:
    band = F.when(~positive(name), F.lit(None).cast("string"))
    for top, label in BANDS[:-1]:
        band = band.when(c(name) < top, label)
    return band.otherwise(BANDS[-1][1])


def band_index(band: Column) -> Column:
    return F.coalesce(*[F.when(band == label, F.lit(i)) for i, (_, label) in enumerate(BANDS)])


def _per_m2(area: str) -> Column:
    return F.when(positive("price") & positive(area), F.round(F.try_divide(c("price"), c(area)), 2))


def price_per_construction_m2() -> Column:
    return _per_m2("construction_area_m2")


def price_per_land_m2() -> Column:
    return F.when(c("property_type") == "terreno", _per_m2("land_area_m2"))


def usable_location() -> Column:
    return no(c("coordinate_quality").isin("high", "medium")) | no((c("latitude") != 0) & (c("longitude") != 0))


def readiness() -> Column:
    """A to E, from complete and precise to hardly usable."""
    land, built = positive("land_area_m2"), positive("construction_area_m2")
    rooms, baths = c("bedrooms").isNotNull(), c("bathrooms").isNotNull()
    kind = c("property_type")
    basic = positive("price") & no(kind.isin("casa", "departamento", "terreno"))
    features = basic & no(c("inegi_cve_ageb") != "") & F.expr("population_density is not null and housing_density is not null and establishments_500m is not null and establishments_1km is not null")
    complete = F.when(kind == "terreno", land).when(kind == "departamento", built & rooms & baths).otherwise(land & built & rooms & baths)
    enough = F.when(kind == "terreno", land).when(kind == "departamento", built & (rooms | baths)).otherwise((land | built) & (rooms | baths))
    grade = c("coordinate_quality")
    return (
        F.when(features & complete & no(grade == "high"), "A").when(features & complete & no(grade == "medium"), "B")
        .when(features & enough & usable_location(), "C").when(basic & usable_location(), "D").otherwise("E")
    )


def _listed(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(no(test), F.lit(name)) for test, name in pairs]), lambda x: x.isNotNull())


def quality_flags() -> Column:
    """What is missing, invalid or suspicious, in the order of the rules."""
    price, built, land, generic = c("price"), c("construction_area_m2"), c("land_area_m2"), c("generic_area_m2")
    unit, ratio = F.try_divide(price, built), F.try_divide(built, land)
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    return _listed(
        (c("latitude").isNull() | c("longitude").isNull(), "missing_coordinates"), (price.isNull(), "missing_price"), (price <= 0, "invalid_price"),
        (built.isNull(), "missing_construction_area"), (built <= 0, "invalid_construction_area"), (built > 5000, "suspicious_construction_area"),
        (land.isNull(), "missing_land_area"), (land <= 0, "invalid_land_area"), (land > 100000, "suspicious_land_area"),
        (c("bedrooms") > 20, "suspicious_bedrooms"), (c("bathrooms") > 20, "suspicious_bathrooms"), (land == built, "same_land_and_construction_area"),
        (generic.isNotNull() & land.isNull() & built.isNull(), "generic_area_only"),
        (generic.isNotNull() & (land.isNotNull() | built.isNotNull()), "suspicious_area_assignment"), (generic.isNotNull(), "ambiguous_area"),
        ((ratio < 0.15) | (ratio > 4), "suspicious_surface_pair"),
        (blank("location_raw") & blank("address_text") & blank("neighborhood"), "missing_location"),
        ((price != 0) & (built > 0) & ((unit < 1000) | (unit > 200000)), "suspicious_price_m2"),
    )


def enriched_flags(existing: Column) -> Column:
    """Existing flags and those of the enriched listing, sorted, each once."""
    price, built, land = c("price"), c("construction_area_m2"), c("land_area_m2")
    unit, ground = price_per_construction_m2(), price_per_land_m2()
    more = _listed(
        (price <= 0, "invalid_price"), (land <= 0, "invalid_land_area"), (built <= 0, "invalid_construction_area"), (land > 100000, "suspicious_land_area"),
        (built > 5000, "suspicious_construction_area"), (c("bedrooms") > 20, "suspicious_bedrooms"), (c("bathrooms") > 20, "suspicious_bathrooms"),
        ((unit < 1000) | (unit > 200000), "suspicious_price_per_construction_m2"), ((ground < 100) | (ground > 100000), "suspicious_price_per_land_m2"),
    )
    return F.array_sort(F.array_distinct(F.concat(existing, more)))


def location_quality() -> Column:
    """A to E by what places the listing."""
    exact = c("latitude").isNotNull() & c("longitude").isNotNull()
    has = lambda n: no(c(n) != "")
    return (
        F.when(exact & has("neighborhood") & has("municipality"), "A").when(exact & has("municipality"), "B")
        .when(has("neighborhood") & has("municipality"), "C").when(has("municipality"), "D").otherwise("E")
    )


def duplicate_group() -> Column:
    """The text that listings of one property share: place, type and numbers to two decimals; a missing field keeps its place."""
    words = [F.lower(F.trim(F.coalesce(c(n), F.lit("")))) for n in ("municipality", "neighborhood", "property_type")]
    numbers = [F.when(c(n).isNotNull(), F.format_string("%.2f", c(n).cast("double"))).otherwise("") for n in ("price", "construction_area_m2", "land_area_m2")]
    return F.concat_ws("|", *words, *numbers)


def first_duplicate_group() -> Column:
    """The group of the first data set: source, price, place, areas and rooms; numbers to two decimals without needless zeros but one, whole numbers as they are."""
    parts = []
    for n, kind in (("source", ""), ("price", "f"), ("municipality", ""), ("neighborhood", ""), ("land_area_m2", "f"), ("construction_area_m2", "f"), ("bedrooms", "i"), ("bathrooms", "f")):
        number = F.when(c(n).isNotNull(), F.regexp_replace(F.format_string("%.2f", F.round(c(n).cast("double"), 2)), r"(\.\d)0$", "$1")) if kind == "f" else c(n).cast("string")
        parts.append(F.coalesce(number if kind else F.lower(F.trim(c(n))), F.lit("")))
    return F.concat_ws("|", *parts)


def surface_ratio() -> Column:
    """Built over land area to six decimals; null unless both are above 0."""
    return F.when(positive("construction_area_m2") & positive("land_area_m2"), F.round(F.try_divide("construction_area_m2", "land_area_m2"), 6))


def known_values(features: Column) -> Column:
    """A map without its nulls."""
    return F.map_filter(features, lambda _, v: v.isNotNull())


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return no((a == b) | (F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance))


#: The texts that duplicates share; a pair's rows carry each one's match key as k_ and its name.
MATCH_TEXTS = ["street", "neighborhood", "municipality", "property_type"]


#: Weights of equal texts, weights and tolerances of close numbers, and the weight of a near place or an equal fingerprint.
TEXT_WEIGHTS = {"municipality": 0.12, "neighborhood": 0.12, "street": 0.10, "property_type": 0.10}
NUMBER_WEIGHTS = {"price": (0.20, 0.12), "land_area_m2": (0.12, 0.10), "construction_area_m2": (0.12, 0.10), "bedrooms": (0.07, 0.01), "bathrooms": (0.07, 0.01)}
PLACE_WEIGHT = 0.08


def duplicate_score(left: str, right: str, hashed: bool = False) -> Column:
    """Likeness of two listings, given by the aliases of their rows, from 0 to 1. The rows carry their match keys, which are made once a row and not once a pair.

    hashed: match keys and fingerprints are hashes, null for blank ones.
    """
    a, b = (lambda n: c(f"{left}.{n}")), (lambda n: c(f"{right}.{n}"))
    equal = lambda n: no(a(n) == b(n)) if hashed else no((a(n) != "") & (a(n) == b(n)))
    # Most places are told apart by their latitude: a thousandth of a degree is 111 m.
    near = no((F.abs(a("latitude") - b("latitude")) < 0.001) & (geo.haversine(a("latitude"), a("longitude"), b("latitude"), b("longitude")) <= 75))
    tests = [(equal(f"k_{n}"), w) for n, w in TEXT_WEIGHTS.items()]
    tests += [(_close(a(n), b(n), t), w) for n, (w, t) in NUMBER_WEIGHTS.items()]
    tests += [(equal("dedupe_fingerprint") | near, PLACE_WEIGHT)]
    total = F.lit(0.0)
    for test, weight in tests:
        total = total + F.when(test, weight).otherwise(0.0)
    return total / sum(w for _, w in tests)


def geocode_usability(precision: Column) -> Column:
    return F.when(precision.isin("exact_address", "street"), "high").when(precision.isin("postal_code", "neighborhood"), "medium").when(precision == "locality", "low").otherwise("unusable")


def geocode_confidence(importance: Column, precision: Column) -> Column:
    #: What a precision adds to the importance.
    boost = {"exact_address": 0.35, "street": 0.25, "postal_code": 0.2, "neighborhood": 0.15, "locality": 0.05, "municipality": 0.0, "state": -0.1}
    table = F.coalesce(*[F.when(precision == k, F.lit(v)) for k, v in boost.items()], F.lit(-0.2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(importance, F.lit(0.4)) + table))


def capped_precision(precision: Column, street: Column, neighborhood: Column, postal_in_text: Column) -> Column:
    """No more precise than what was asked with."""
    coarse = F.when(no(neighborhood != ""), "neighborhood").otherwise("locality")
    capped = F.when(precision.isin("exact_address", "street") & ~no(street != ""), F.when(postal_in_text, "postal_code").otherwise(coarse)).otherwise(precision)
    return F.when((capped == "postal_code") & ~postal_in_text, coarse).otherwise(capped)


#: Notes of the coordinate check.
NOTES = {
    "outside": "coordenada fuera del rango esperado de Morelos", "crowded": "sin reverse geocoding; coordenada compartida o muy cercana a otros listings", "alone": "sin reverse geocoding; coordenada única no verificable",
    "state": "reverse geocoding no confirma Morelos", "municipality": "reverse geocoding no confirma municipio", "shared": "municipio coincide; coordenada compartida por varias propiedades",
}
#: What confirms a coordinate, in the order of the note.
EVIDENCE = ["calle coincide", "CP coincide", "colonia/zona coincide", "municipio coincide"]


def coordinate_check(shared: Column, nearby: Column, reverse_known: Column, state_ok: Column, municipality_ok: Column, street_ok: Column, postcode_ok: Column, neighborhood_ok: Column) -> Column:
    """struct(status, note, quality) of a coordinate, from its box, what the reverse geocoder confirms and who shares it."""
    row = lambda status, note, quality: F.struct(F.lit(status).alias("status"), (F.lit(NOTES[note]) if isinstance(note, str) else note).alias("note"), F.lit(quality).alias("quality"))
    found = F.array_join(_listed(*zip((street_ok, postcode_ok, neighborhood_ok, municipality_ok), EVIDENCE, strict=True)), ", ")
    exact = no(street_ok) | no(postcode_ok) | no(neighborhood_ok)
    return (
        F.when(~no(geo.within("region_17", c("latitude"), c("longitude"))), row("inconsistent", "outside", "unusable"))
        .when(~no(reverse_known), F.when((shared > 1) | (nearby > 1), row("unknown", "crowded", "low")).otherwise(row("unknown", "alone", "medium")))
        .when(~no(state_ok), row("inconsistent", "state", "unusable")).when(~no(municipality_ok), row("inconsistent", "municipality", "unusable"))
        .when(exact & (shared == 1) & (nearby == 1), row("consistent", found, "high"))
        .when(shared == 1, row("partially_consistent", found, "medium")).otherwise(row("partially_consistent", "shared", "low"))
    )


def residential_reason() -> Column:
    """Why a request can't be valued as a home; null if it can."""
    return (
        F.when(~no(c("property_type").isin("casa", "departamento")), "unsupported_property_type")
        .when(c("latitude").isNull() | c("longitude").isNull(), "missing_location").when(~positive("construction_area_m2"), "missing_construction_area")
        .when((c("property_type") == "casa") & ~positive("land_area_m2"), "missing_land_area")
    )


def first_model_reason() -> Column:
    """Why a request can't be valued by the first model; null if it can."""
    return F.when(~no(c("property_type").isin("casa", "departamento", "terreno")), "unsupported_property_type").when(c("latitude").isNull() | c("longitude").isNull(), "missing_location")


def confidence(estimate: Column) -> Column:
    weak = (F.coalesce(c("inegi_cve_ageb"), F.lit("")) == "") | ~no(estimate.between(1e6, 12e6)) | no(c("municipality").isin(WEAK_MUNICIPALITIES))
    return F.when(weak, "LOW").otherwise("MEDIUM")


def display_price(price: Column, currency: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(price, 0), F.lit(" "), F.coalesce(currency, F.lit("MXN")))


def display_address(*parts: str) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.trim(c(p)), F.lit("")) for p in parts])

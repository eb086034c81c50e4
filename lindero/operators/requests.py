"""Requests for a valuation and for a geocoder: the place that a request names, what the first model takes, how a geocoding run went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.listing import no

#: The state of a request that names none.
DEFAULT_STATE = "Morelos"
#: Property types of requests and what the first model calls them.
FIRST_MODEL_TYPES = {"house": "casa", "apartment": "depa", "land": "terreno"}
#: Precisions that an audit of geocoded rows lists, in order.
PRECISIONS = ["exact_address", "street", "postal_code", "neighborhood", "locality", "municipality", "state", "failed"]

c = F.col


def resolved_locations(requests: DataFrame, settlements: DataFrame, geocoded: DataFrame) -> DataFrame:
    """request_id, the place of each request and error, which is null where there is a place.

    requests: request_id, settlement_id, state, municipality, neighborhood, postal_code, latitude, longitude, location_source and
    location_precision; settlements: settlement_id (unique), settlement, state, municipality, postal_code; geocoded: settlement_id
    (unique), latitude and longitude, the answers of a geocoder for settlements. A settlement must lie in the state and municipality asked
    for. A device's own coordinates come before the settlement's; other coordinates count only where no settlement is named. Where there
    is an error all columns of the place are null; a request without any column filled has the error no_location.
    """
    place = settlements.select("settlement_id", *[c(n).alias(f"__{n}") for n in ("settlement", "state", "municipality", "postal_code")], F.lit(True).alias("__known"))
    answers = geocoded.where("latitude is not null and longitude is not null").select("settlement_id", c("latitude").alias("__latitude"), c("longitude").alias("__longitude"))
    df = requests.join(place, "settlement_id", "left").join(answers, "settlement_id", "left")
    named = c("settlement_id").isNotNull()
    within = no(c("__known")) & no(c("__state") == F.coalesce("state", F.lit(DEFAULT_STATE))) & c("__municipality").eqNullSafe(c("municipality"))
    own = c("latitude").isNotNull() & c("longitude").isNotNull()
    device = own & no(c("location_source") == "device")
    error = F.when(named & ~within, "settlement_not_there").when(~device & named & c("__latitude").isNull(), "settlement_not_located").when(~named & ~own, "no_location")
    df = df.withColumns({"error": error, "__placed": error.isNull() & ~device & named, "__named": named})
    given = lambda n, of: F.when(c("error").isNull(), F.when(c("__named"), c(of)).otherwise(c(n))).alias(n)
    moved = lambda n, to: F.when(c("error").isNull(), F.when(c("__placed"), to).otherwise(c(n))).alias(n)
    return df.select(
        "request_id", given("state", "__state"), given("municipality", "__municipality"), given("neighborhood", "__settlement"), given("postal_code", "__postal_code"),
        moved("latitude", c("__latitude")), moved("longitude", c("__longitude")), moved("location_source", F.lit("sepomex_geocoded")), moved("location_precision", F.lit("neighborhood")), "error",
    )


def _number(*names: str) -> Column:
    """The first of the columns that is neither null nor zero, without its fraction; zero if none is."""
    return F.coalesce(*[F.nullif(c(n), F.lit(0).cast("double")) for n in names], F.lit(0.0)).cast("long")


def first_model_requests(properties: DataFrame, catalog: DataFrame) -> DataFrame:
    """property_id, the fields that the first model takes, the zone and factor of the colonia, and error: why it can't be asked, or null.

    properties: property_id, property_type, colonia, land_area_m2, land_area, construction_area_m2, construction_area, bedrooms, bathrooms,
    parking_spaces, property_age_years, latitude, longitude; catalog: colonia (unique once trimmed), zone, factor. Zeros count as not given.
    """
    known = catalog.select(F.trim("colonia").alias("colonia"), "zone", "factor", F.lit(True).alias("__known"))
    named = F.when(~F.trim("colonia").isin("", "0"), F.trim("colonia"))
    kinds = F.create_map(*[F.lit(x) for pair in FIRST_MODEL_TYPES.items() for x in pair])
    df = properties.withColumns({"colonia": named, "tipo": F.try_element_at(kinds, c("property_type"))}).join(known, "colonia", "left")
    error = F.when(c("tipo").isNull(), "unsupported_property_type").when(c("colonia").isNull(), "missing_legacy_colonia").when(c("__known").isNull(), "unknown_colonia")
    return df.select(
        "property_id", "tipo", "colonia", _number("land_area_m2", "land_area").alias("m2_terreno"), _number("construction_area_m2", "construction_area").alias("m2_construccion"), _number("bedrooms").alias("recamaras"),
        _number("bathrooms").alias("banos"), _number("parking_spaces").alias("estacionamientos"), _number("property_age_years").alias("antiguedad_anios"),
        F.coalesce("latitude", F.lit(0.0)).alias("lat"), F.coalesce("longitude", F.lit(0.0)).alias("lng"), "zone", "factor", error.alias("error"),
    )


def geocode_counts(rows: DataFrame) -> DataFrame:
    """precision and n, in one pass: total, then each of PRECISIONS. A row without a place or of unknown precision has failed; other precisions count in the total only.

    rows: geocode_precision, geocode_latitude, geocode_longitude; a coordinate of zero is none. No rows give zeros.
    """
    placed = no(c("geocode_latitude") != 0) & no(c("geocode_longitude") != 0) & no(~c("geocode_precision").isin("", "unknown"))
    precision = F.when(placed, c("geocode_precision")).otherwise("failed")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(precision == p).alias(p) for p in PRECISIONS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("precision"), c(p).alias("n")) for p in ("total", *PRECISIONS)])).alias("x")).select("x.*")

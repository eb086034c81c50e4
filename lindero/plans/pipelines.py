"""The batch path from raw pages to a training set, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.functions import listing, text
from lindero.operators import cover, spatial, windows
from lindero.sources import pages, portals


def _flagged(rows: DataFrame) -> DataFrame:
    c = F.col
    printed = text.python_fingerprint(c("latitude"), c("longitude"), c("price"), c("land_area_m2"), c("construction_area_m2"), c("bedrooms"), c("bathrooms"), c("parking_spaces"))
    return rows.withColumns({"dedupe_fingerprint": printed, "quality_flags": listing.quality_flags()})


def listings_from_pages(raw: DataFrame) -> DataFrame:
    """Parsed pages with fingerprint and quality flags; a page that tells nothing keeps a row with flags."""
    return _flagged(pages.parse(raw).withColumns({"location_raw": F.lit(None).cast("string"), "address_text": F.col("street")}))


def reparse(raw: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """The stored raw pages (raw_id, source, url, content) read anew by their sources' parsers: the newest page of each listing, with its raw_id, fingerprint and flags.

    kinds: the sources of each kind of page; pages of other sources are left out.
    """
    return windows.first_of(_flagged(portals.by_source(raw, kinds)), ["source", "source_id"], [F.desc("raw_id")])


def enrich(rows: DataFrame, polygons: DataFrame, census: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """Usable listings with their area, its census figures and counts of places. census: area_id, population, houses, area_km2."""
    usable = rows.where(listing.usable_location())
    area = spatial.point_in_polygon(usable, polygons, key)
    rates = census.select("area_id", F.try_divide("population", "area_km2").alias("population_density"), F.try_divide("houses", "area_km2").alias("housing_density"))
    counts = spatial.radius_counts(usable, places, key, {"establishments": ""}, (500, 1000))
    return usable.join(area, key).join(rates, "area_id", "left").join(counts, key)


def enrich_layers(rows: DataFrame, layers: dict[str, DataFrame], census: DataFrame, places: DataFrame, categories: dict[str, str], key: str = "id", radii: tuple[int, ...] = (500, 1000)) -> DataFrame:
    """All rows with their area in each layer, its census figures and counts of places.

    Only rows of high or medium quality are placed, by their own coordinates or else the geocoder's, and their quality is their own
    or else the geocoder's. The first layer decides: where none of its areas covers a row, the others and the census tell nothing.
    layers: area_id and rings by name; census: area_id of the first layer, population, houses, area_km2.
    """
    quality = F.coalesce("coordinate_quality", "geocode_usability")
    placed = rows.select(key, quality.alias("quality"), F.coalesce("latitude", "geocode_latitude").alias("latitude"), F.coalesce("longitude", "geocode_longitude").alias("longitude"))
    usable = placed.where("quality in ('high', 'medium') and latitude is not null and longitude is not null")
    first, *others = layers
    found = cover.layers_of(usable, layers, key).select(key, first, *[F.when(F.col(first).isNotNull(), F.col(n)).alias(n) for n in others])
    rates = census.select(F.col("area_id").alias(first), F.try_divide("population", "area_km2").alias("population_density"), F.try_divide("houses", "area_km2").alias("housing_density"))
    counts = spatial.radius_counts(usable, places, key, categories, radii)
    told = usable.select(key, F.lit(True).alias("__usable")).join(found, key).join(rates, first, "left").join(counts, key)
    exact = F.when(quality == "high", "exact_coordinate").when(quality == "medium", "approximate_coordinate").otherwise("unusable")
    assigned = F.when(F.col("__usable").isNotNull() & F.col(first).isNull(), "unusable").otherwise(exact)
    return rows.drop(*layers).join(told, key, "left").withColumn("ageb_assignment_quality", assigned).drop("__usable")


def training_set(rows: DataFrame) -> DataFrame:
    """Graded listings without error flags, one for each duplicate group."""
    graded = rows.withColumns({
        "market_segment": listing.market_segment(), "price_band": listing.price_band(), "price_per_construction_m2": listing.price_per_construction_m2(),
        "price_per_land_m2": listing.price_per_land_m2(), "training_readiness": listing.readiness(), "duplicate_group_id": listing.duplicate_group(),
    })
    clean = graded.where(~F.arrays_overlap("quality_flags", F.array(*map(F.lit, listing.ERROR_FLAGS))) & F.col("training_readiness").isin("A", "B", "C"))
    return windows.first_of(clean, ["duplicate_group_id"], ["source", "source_id", "id"])

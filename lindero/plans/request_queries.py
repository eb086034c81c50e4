"""Registered queries over requests, stored pages that are read anew, updates and a stream; they join those of lindero.plans.page_queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lindero.operators import requests
from lindero.operators.stored import shared_dir
from lindero.operators.upsert import update_rows
from lindero.plans import pipelines, sample
from lindero.plans.page_queries import _TITLE, ORACLES, QUERIES, _labelled
from lindero.plans.queries import _BASE, _read, query
from lindero.streaming import ingest

__all__ = ["ORACLES", "QUERIES"]

c = F.col

#: c is the customer table, n the nation table; SQL that Spark and other engines read alike.
_REQUESTS = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 30 END AS settlement_id, CASE WHEN c_custkey % 5 <> 0 THEN CASE c_custkey % 30 % 2 WHEN 0 THEN 'Morelos' ELSE 'Ciudad de México' END END AS state,
CASE WHEN c_custkey % 7 = 0 THEN 'Otro' ELSE concat('Municipio ', CAST(c_custkey % 30 % 3 AS VARCHAR(20))) END AS municipality, CASE WHEN c_custkey % 11 = 0 THEN 'Centro' END AS neighborhood, CAST(NULL AS VARCHAR(20)) AS postal_code,
CASE WHEN c_custkey % 3 <> 0 THEN 18.0e0 + c_custkey % 100 / 100.0e0 END AS latitude, CASE WHEN c_custkey % 13 <> 0 THEN -99.0e0 - c_custkey % 100 / 100.0e0 END AS longitude, CASE c_custkey % 2 WHEN 0 THEN 'device' ELSE 'manual_geocode' END AS location_source, 'device' AS location_precision FROM c"""
_SETTLED = "SELECT n_nationkey AS settlement_id, n_name AS settlement, CASE n_nationkey % 2 WHEN 0 THEN 'Morelos' ELSE 'Ciudad de México' END AS state, concat('Municipio ', CAST(n_nationkey % 3 AS VARCHAR(20))) AS municipality, CAST(62000 + n_nationkey AS VARCHAR(20)) AS postal_code FROM n"
_LOCATED = "SELECT n_nationkey AS settlement_id, CASE WHEN n_nationkey % 6 <> 0 THEN 18.5e0 + n_nationkey / 100.0e0 END AS latitude, -99.5e0 - n_nationkey / 100.0e0 AS longitude FROM n"
_OF = lambda n, then: f"CASE WHEN error IS NULL THEN CASE WHEN sid IS NOT NULL THEN {then} ELSE {n} END END AS {n}"
_MOVED = lambda n, then: f"CASE WHEN error IS NULL THEN CASE WHEN sid IS NOT NULL AND NOT device THEN {then} ELSE {n} END END AS {n}"


@query(f"""WITH c AS (SELECT * FROM customer), n AS (SELECT * FROM nation), q AS ({_REQUESTS}), s AS ({_SETTLED}), g AS ({_LOCATED}),
j AS (SELECT q.*, q.settlement_id AS sid, s.settlement AS s_settlement, s.state AS s_state, s.municipality AS s_municipality, s.postal_code AS s_postal_code, g.latitude AS g_latitude, g.longitude AS g_longitude,
  q.latitude IS NOT NULL AND q.longitude IS NOT NULL AS own, q.latitude IS NOT NULL AND q.longitude IS NOT NULL AND q.location_source = 'device' AS device FROM q LEFT JOIN s ON s.settlement_id = q.settlement_id LEFT JOIN g ON g.settlement_id = q.settlement_id),
e AS (SELECT *, CASE WHEN sid IS NOT NULL THEN CASE WHEN coalesce(s_state <> coalesce(state, 'Morelos') OR s_municipality <> municipality, TRUE) THEN 'settlement_not_there' WHEN NOT device AND g_latitude IS NULL THEN 'settlement_not_located' END WHEN NOT own THEN 'no_location' END AS error FROM j)
SELECT request_id, {_OF('state', 's_state')}, {_OF('municipality', 's_municipality')}, {_OF('neighborhood', 's_settlement')}, {_OF('postal_code', 's_postal_code')}, {_MOVED('latitude', 'g_latitude')}, {_MOVED('longitude', 'g_longitude')},
{_MOVED('location_source', "'sepomex_geocoded'")}, {_MOVED('location_precision', "'neighborhood'")}, error FROM e""")
def resolved_locations(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    asked = spark.sql(_REQUESTS.replace("FROM c", "FROM {c}"), c=_read(spark, sf_dir, "customer"))
    return requests.resolved_locations(asked, spark.sql(_SETTLED.replace("FROM n", "FROM {n}"), n=nation), spark.sql(_LOCATED.replace("FROM n", "FROM {n}"), n=nation))


_PROPERTIES = """SELECT id AS property_id, CASE id % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'apartment' WHEN 2 THEN 'land' ELSE CASE WHEN id % 3 = 0 THEN 'office' END END AS property_type,
CASE WHEN id % 9 = 0 THEN ' ' WHEN id % 10 = 0 THEN '0' WHEN id % 7 <> 0 THEN concat(' COL_', CAST(id % 12 AS VARCHAR(20)), ' ') END AS colonia, CASE WHEN id % 3 = 0 THEN 0.0e0 ELSE land_area_m2 END AS land_area_m2, CASE WHEN id % 2 = 0 THEN 55.7e0 END AS land_area,
construction_area_m2, 31.9e0 AS construction_area, bedrooms, bathrooms, parking_spaces, id % 40 AS property_age_years, latitude, longitude FROM l"""
_CATALOG = "SELECT concat('COL_', CAST(s_suppkey AS VARCHAR(20)), ' ') AS colonia, concat('Z', CAST(s_suppkey % 4 AS VARCHAR(20))) AS zone, 1.0e0 + s_suppkey / 100.0e0 AS factor FROM s WHERE s_suppkey < 9"
_WHOLE = lambda *names: f"CAST(trunc(coalesce({', '.join(f'nullif({n}, 0)' for n in names)}, 0)) AS BIGINT)"


@query(f"""{_BASE}, s AS (SELECT * FROM supplier), offered AS ({_PROPERTIES}), k AS ({_CATALOG}),
t AS (SELECT *, CASE property_type WHEN 'house' THEN 'casa' WHEN 'apartment' THEN 'depa' WHEN 'land' THEN 'terreno' END AS tipo, nullif(nullif(trim(colonia), ''), '0') AS named FROM offered)
SELECT property_id, tipo, named AS colonia, {_WHOLE('land_area_m2', 'land_area')} AS m2_terreno, {_WHOLE('construction_area_m2', 'construction_area')} AS m2_construccion, {_WHOLE('bedrooms')} AS recamaras, {_WHOLE('bathrooms')} AS banos, {_WHOLE('parking_spaces')} AS estacionamientos,
{_WHOLE('property_age_years')} AS antiguedad_anios, coalesce(latitude, 0) AS lat, coalesce(longitude, 0) AS lng, zone, factor, CASE WHEN tipo IS NULL THEN 'unsupported_property_type' WHEN named IS NULL THEN 'missing_legacy_colonia' WHEN zone IS NULL THEN 'unknown_colonia' END AS error
FROM t LEFT JOIN k ON trim(k.colonia) = named""")
def first_model_requests(spark, sf_dir):
    rows = spark.sql(_PROPERTIES.replace("FROM l", "FROM {l}"), l=sample.listings(spark, sf_dir))
    return requests.first_model_requests(rows, spark.sql(_CATALOG.replace("FROM s", "FROM {s}"), s=_read(spark, sf_dir, "supplier")))


_KINDS = [*requests.PRECISIONS[:-1], "unknown", "", "other"]


@query(f"""{_BASE}, g AS (SELECT nullif(({_KINDS!r})[id % 11 + 1], 'other') AS p, CASE WHEN id % 8 <> 0 THEN latitude ELSE 0 END AS y, longitude AS x FROM l),
f AS (SELECT CASE WHEN coalesce(y <> 0 AND x <> 0 AND p NOT IN ('', 'unknown'), FALSE) THEN p ELSE 'failed' END AS p FROM g)
SELECT 'total' AS precision, count(*) AS n FROM f UNION ALL SELECT k.p, count(f.p) FROM (SELECT unnest({requests.PRECISIONS!r}) AS p) k LEFT JOIN f ON f.p = k.p GROUP BY 1""")
def geocode_counts(spark, sf_dir):
    kind = F.nullif(F.get(F.array(*map(F.lit, _KINDS)), (c("id") % 11).cast("int")), F.lit("other"))
    df = sample.listings(spark, sf_dir)
    return requests.geocode_counts(df.select(kind.alias("geocode_precision"), F.when(c("id") % 8 != 0, c("latitude")).otherwise(0.0).alias("geocode_latitude"), c("longitude").alias("geocode_longitude")))


@query(f"""{_BASE} SELECT 'portal' AS source, concat('listing-', id) AS source_id, CASE WHEN id % 7 = 0 THEN 2 * id ELSE 2 * id + 1 END AS raw_id, CASE WHEN id % 7 = 0 THEN 'Viejo' ELSE {_TITLE} END AS title,
CASE WHEN id % 7 <> 0 THEN coalesce(round(price), 0) END AS price, CASE WHEN id % 7 <> 0 THEN latitude END AS latitude FROM l""")
def reparsed_listings(spark, sf_dir):
    """Some listings have an older page, some of these no other."""
    rows = _labelled(spark, sf_dir)
    old = rows.where("id % 3 = 0 or id % 7 = 0").select((c("id") * 2).alias("raw_id"), "source", "url", F.lit('<html><head><meta property="og:title" content="Viejo"></head><body></body></html>').alias("content"))
    raw = old.unionByName(rows.where("id % 7 <> 0").select((c("id") * 2 + 1).alias("raw_id"), "source", "url", "content"))
    return pipelines.reparse(raw, {"labelled": ["portal"]}).select("source", "source_id", "raw_id", "title", "price", "latitude")


@query(f"""{_BASE} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN price / 2 END WHEN id % 5 = 0 THEN price / 4 ELSE price END AS price, CASE WHEN id % 3 = 0 THEN 'low' WHEN id % 5 = 0 THEN NULL ELSE coordinate_quality END AS coordinate_quality, municipality FROM l""")
def updated_rows(spark, sf_dir):
    """Two runs of changes by id, of which the later one counts where both have a row, and changes of rows that there are none of."""
    df = sample.listings(spark, sf_dir).select("id", "price", "coordinate_quality", "municipality")
    second = df.where("id % 3 = 0").select("id", F.when(c("id") % 2 == 0, c("price") / 2).alias("price"), F.lit("low").alias("coordinate_quality"), F.lit(2).alias("run"))
    first = df.where("id % 5 = 0").select("id", (c("price") / 4).alias("price"), F.lit(None).cast("string").alias("coordinate_quality"), F.lit(1).alias("run"))
    unknown = second.withColumn("id", -c("id") - 1)
    return update_rows(df, second.unionByName(first).unionByName(unknown), "id", ["price", "coordinate_quality"], "run")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def streamed_snapshot(spark, sf_dir):
    """The events as a stream into a snapshot that keeps the newest of each user and type."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    ingest.upsert_into(spark, stream, f"{place}/snapshot", ["user_id", "event_type"], "event_id", f"{place}/checkpoint", buckets=16).awaitTermination()
    return ingest.snapshot(spark, f"{place}/snapshot").select("user_id", "event_type", "event_id", "value")

"""Listings, predictions, places and areas made from the order tables, by SQL that Spark and other engines read alike.

The test tables hold no listings, so each order stands for one: its key and customer place it, size it and price it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: o is the orders table.
LISTINGS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'portal_a' WHEN 1 THEN 'portal_b' ELSE 'portal_c' END AS source,
  concat('L-', CAST(o_orderkey - o_orderkey % 2 AS VARCHAR(20))) AS source_id,
  concat('https://example.com/listing/', CAST(o_orderkey AS VARCHAR(20))) AS url,
  concat(CASE o_orderkey % 5 WHEN 0 THEN 'Casa' WHEN 1 THEN 'Casa sola' WHEN 2 THEN 'Departamento' WHEN 3 THEN 'Depa nuevo' ELSE 'Terreno' END,
    CASE o_orderkey % 4 WHEN 0 THEN ' en venta ' WHEN 1 THEN '  en renta' WHEN 2 THEN ' en   venta' ELSE '' END) AS title,
  CASE o_orderkey % 5 WHEN 0 THEN 'casa' WHEN 1 THEN 'casa' WHEN 2 THEN 'departamento' WHEN 3 THEN 'departamento' ELSE 'terreno' END AS property_type,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 0.0e0 ELSE o_totalprice * 40 END AS price,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'USD' ELSE 'MXN' END AS currency,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 18.5e0 + (o_custkey * 37 % 400) / 1000.0e0 + (o_orderkey % 3) / 10000.0e0 END AS latitude,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE -99.5e0 + (o_custkey * 91 % 500) / 1000.0e0 + (o_orderkey % 5) / 10000.0e0 END AS longitude,
  concat('Municipio ', CAST(o_custkey % 8 AS VARCHAR(20))) AS municipality,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('Colonia Núm. ', CAST(o_custkey % 40 AS VARCHAR(20))) END AS neighborhood,
  CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE concat('Calle ', CAST(o_custkey % 90 AS VARCHAR(20))) END AS street,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 6000.0e0 ELSE 40.0e0 + (o_orderkey * 7 % 400) END AS construction_area_m2,
  CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE 60.0e0 + (o_orderkey * 11 % 900) END AS land_area_m2,
  CASE WHEN o_orderkey % 29 = 0 THEN 80.0e0 END AS generic_area_m2,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 6 END AS INT) AS bedrooms,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE (o_orderkey % 7) / 2.0e0 END AS bathrooms,
  CAST(o_orderkey % 4 AS INT) AS parking_spaces,
  CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS coordinate_quality,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE concat('A', CAST(o_custkey % 60 AS VARCHAR(20))) END AS inegi_cve_ageb,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 50 + 0.5e0 END AS population_density,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 30 + 0.25e0 END AS housing_density,
  CAST(o_custkey % 100 AS INT) AS establishments_500m, CAST(o_custkey % 300 AS INT) AS establishments_1km,
  CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS published_at, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 14 = 0 THEN o_orderdate END AS deleted_at,
  o_orderkey % 8 = 0 AS is_featured,
  concat('fp-', CAST(o_custkey % 500 AS VARCHAR(20))) AS dedupe_fingerprint
FROM orders"""

PREDICTIONS = f"""
SELECT id, source, source_id, property_type, municipality, neighborhood, price AS actual_price,
  price * (0.7e0 + (id * 13 % 60) / 100.0e0) AS predicted_price, CAST(id % 5 AS INT) AS fold, coordinate_quality
FROM ({LISTINGS}) AS l WHERE price > 0"""

#: Points of interest: suppliers and customers at places of their own.
PLACES = """
SELECT s_suppkey AS place_id, concat(CASE s_suppkey % 4 WHEN 0 THEN '46' WHEN 1 THEN '72' WHEN 2 THEN '62' ELSE '61' END, CAST(1000 + s_suppkey % 7 AS VARCHAR(20))) AS activity,
  18.5e0 + (s_suppkey * 53 % 400) / 1000.0e0 AS latitude, -99.5e0 + (s_suppkey * 71 % 500) / 1000.0e0 AS longitude
FROM supplier"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "orders", LISTINGS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "orders", PREDICTIONS)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "supplier", PLACES)


def _made(spark: SparkSession, sf_dir: str, table: str, query: str) -> DataFrame:
    return spark.sql(query.replace(f"FROM {table}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

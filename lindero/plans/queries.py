"""Registered queries: each operator at work on the sample tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.functions import geo, listing, places, text
from lindero.operators import comparables, evaluation, holdout, metrics, scopes, serving, spatial, upsert, windows
from lindero.operators.quantiles import join_groups, quantiles
from lindero.plans import sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BASE = f"WITH l AS ({sample.LISTINGS}), p AS ({sample.PREDICTIONS}), pl AS ({sample.PLACES})"
_BAND = lambda x: "CASE WHEN {0} IS NULL OR {0} <= 0 THEN NULL ".format(x) + " ".join(f"WHEN {x} < {int(top)} THEN '{label}'" for top, label in listing.BANDS[:-1]) + f" ELSE '{listing.BANDS[-1][1]}' END"
_ERRORS = _BASE + f""", e AS (SELECT *, predicted_price - actual_price AS residual, abs(predicted_price - actual_price) AS absolute_error,
  abs(predicted_price - actual_price) / greatest(actual_price, 1.0) * 100 AS percentage_error, predicted_price / greatest(actual_price, 1.0) AS prediction_ratio, {_BAND("actual_price")} AS price_band FROM p)"""
_METRICS = """count(*) AS n, round(avg(absolute_error), 4) AS mae, round(median(absolute_error), 4) AS median_ae, round(sqrt(avg(residual * residual)), 4) AS rmse,
  round(1 - sum(residual * residual) / (var_pop(actual_price) * count(*)), 6) AS r2, round(avg(percentage_error), 4) AS mape, round(median(percentage_error), 4) AS median_ape,
  round(avg(CASE WHEN percentage_error <= 10 THEN 100.0 ELSE 0 END), 4) AS within_10_pct, round(avg(CASE WHEN percentage_error <= 20 THEN 100.0 ELSE 0 END), 4) AS within_20_pct,
  round(avg(CASE WHEN percentage_error <= 30 THEN 100.0 ELSE 0 END), 4) AS within_30_pct, round(avg(residual), 4) AS bias_mean, round(median(residual), 4) AS bias_median, round(median(prediction_ratio), 6) AS median_prediction_ratio"""


def _distance(a: str, b: str, names: tuple[str, str] = ("latitude", "longitude")) -> str:
    la, lo = names
    h = f"(sin(radians({b}.{la} - {a}.{la}) / 2) * sin(radians({b}.{la} - {a}.{la}) / 2) + cos(radians({a}.{la})) * cos(radians({b}.{la})) * sin(radians({b}.{lo} - {a}.{lo}) / 2) * sin(radians({b}.{lo} - {a}.{lo}) / 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _half_up(x: str) -> str:
    """Two decimals of the number's decimal text, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 15)), 2) AS DOUBLE)"


def rounded(df: DataFrame, places: int = 4, **other: int) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, other.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PUBLISHED = "status = 'published' AND published_at IS NOT NULL AND deleted_at IS NULL"


@query(f"""{_BASE}, f AS (SELECT * FROM l WHERE {_PUBLISHED} AND property_type = 'casa' AND price >= 1000000 AND price <= 9000000 AND bedrooms >= 2 AND contains(lower(strip_accents(title)), 'casa'))
SELECT id, title, price, municipality, (SELECT count(*) FROM f) AS total FROM f ORDER BY price, id LIMIT 9 OFFSET 9""")
def catalog_page(spark, sf_dir):
    df = scopes.published(sample.listings(spark, sf_dir))
    df = scopes.where_given(df, property_type="casa", municipality="", neighborhood=None)
    df = scopes.keyword(scopes.where_range(df, price=(1e6, 9e6), bedrooms=(2, None)), "CÁSA", "title")
    return scopes.page(df, "price_asc", 2, 9).select("id", "title", "price", "municipality", "total")


@query(f"""{_BASE}, v AS (SELECT * FROM l WHERE {_PUBLISHED})
SELECT 'municipality' AS facet, municipality AS value FROM v WHERE trim(municipality) <> '' GROUP BY ALL
UNION ALL SELECT 'property_type', property_type FROM v GROUP BY ALL UNION ALL SELECT 'neighborhood', neighborhood FROM v WHERE neighborhood IS NOT NULL GROUP BY ALL""")
def catalog_facets(spark, sf_dir):
    return scopes.facets(scopes.published(sample.listings(spark, sf_dir)), "municipality", "property_type", "neighborhood")


@query(f"{_BASE} SELECT id, published_at FROM l WHERE {_PUBLISHED} ORDER BY published_at DESC, id LIMIT 6")
def latest_listings(spark, sf_dir):
    return scopes.order(scopes.published(sample.listings(spark, sf_dir)), "newest").limit(6).select("id", "published_at")


@query(f"{_BASE} SELECT id, price FROM l WHERE deleted_at IS NULL ORDER BY price DESC NULLS LAST, id LIMIT 15")
def admin_page_by_price(spark, sf_dir):
    return scopes.order(scopes.visible(sample.listings(spark, sf_dir)), "price_desc").limit(15).select("id", "price")


@query(f"""{_BASE}, i AS (SELECT * FROM l WHERE id = 12)
SELECT id, published_at FROM l WHERE {_PUBLISHED} AND property_type = (SELECT property_type FROM i) AND municipality = (SELECT municipality FROM i) AND id <> 12 ORDER BY published_at DESC, id LIMIT 3""")
def related_listings(spark, sf_dir):
    df = sample.listings(spark, sf_dir)
    return serving.related(df, df.where("id = 12")).select("id", "published_at")


@query(f"""{_BASE} SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL AND status = 'published') AS published, count(*) FILTER (deleted_at IS NULL AND status = 'draft') AS draft,
count(*) FILTER (deleted_at IS NULL AND status = 'archived') AS archived, count(*) FILTER (deleted_at IS NULL AND is_featured) AS featured, count(*) FILTER (deleted_at IS NULL AND property_type = 'casa') AS houses,
count(*) FILTER (deleted_at IS NULL AND property_type = 'departamento') AS apartments, count(*) FILTER (deleted_at IS NULL AND property_type = 'terreno') AS land, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM l""")
def dashboard_counts(spark, sf_dir):
    return serving.dashboard(sample.listings(spark, sf_dir))


@query("SELECT p_partkey AS id, arg_min(l_orderkey * 10 + l_linenumber, (CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_linenumber, l_orderkey * 10 + l_linenumber)) AS image_id FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def cover_images(spark, sf_dir):
    images = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("property_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"), (F.col("l_returnflag") == "A").alias("is_cover"), F.col("l_linenumber").alias("position"))
    return serving.covers(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), images)


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def nested_children(spark, sf_dir):
    got = serving.with_nested(_read(spark, sf_dir, "customer").select("c_custkey"), _read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderkey"], "orders")
    return got.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT s_suppkey, count(*) AS n, count(DISTINCT p_type) AS types FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def bridge_join(spark, sf_dir):
    bridge = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return serving.through_bridge(_read(spark, sf_dir, "supplier"), bridge, _read(spark, sf_dir, "part"), "s_suppkey", "p_partkey").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("types"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SETTLEMENTS = "SELECT n_name AS settlement, r_name AS state, CAST(n_nationkey AS VARCHAR(20)) AS postal_code FROM nation JOIN region ON r_regionkey = n_regionkey"


@query(f"SELECT * FROM ({_SETTLEMENTS}) WHERE state = 'ASIA' AND contains(lower(settlement), 'tion_1') ORDER BY settlement, postal_code LIMIT 15")
def settlement_suggestions(spark, sf_dir):
    places = spark.sql(_SETTLEMENTS.replace("FROM nation JOIN region", "FROM {n} JOIN {r}"), n=_read(spark, sf_dir, "nation"), r=_read(spark, sf_dir, "region"))
    return serving.suggestions(places, "TION_1", state="ASIA")


@query(f"""{_BASE} SELECT id, CASE WHEN property_type IS NULL OR property_type NOT IN ('casa', 'departamento') THEN 'unsupported_property_type' WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_location'
WHEN coalesce(construction_area_m2, 0) <= 0 THEN 'missing_construction_area' WHEN property_type = 'casa' AND coalesce(land_area_m2, 0) <= 0 THEN 'missing_land_area' END AS reason FROM l""")
def eligibility_reasons(spark, sf_dir):
    return sample.listings(spark, sf_dir).select("id", listing.residential_reason().alias("reason"))


@query(f"{_BASE} SELECT id, price FROM l WHERE coalesce(currency, 'MXN') = 'MXN' AND price > 0 AND latitude IS NOT NULL AND source IN ('portal_a', 'portal_b') AND latitude BETWEEN 18.0 AND 19.2 AND longitude BETWEEN -99.6 AND -98.4")
def training_filter(spark, sf_dir):
    df = sample.listings(spark, sf_dir).na.drop(subset=["latitude", "longitude"])
    return df.where((F.coalesce("currency", F.lit("MXN")) == "MXN") & listing.positive("price") & F.col("source").isin("portal_a", "portal_b") & geo.within("region_17", F.col("latitude"), F.col("longitude"))).select("id", "price")


@query(f"{_BASE} SELECT coalesce(coordinate_quality, 'missing') AS value, count(*) AS n FROM l GROUP BY 1")
def value_counts(spark, sf_dir):
    return sample.listings(spark, sf_dir).groupBy(F.coalesce("coordinate_quality", F.lit("missing")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


_FIELDS = ["price", "currency", "latitude", "neighborhood", "bedrooms"]


@query(f"{_BASE} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, round(count({f}) * 100.0 / count(*), 4) AS percent FROM l" for f in _FIELDS))
def presence(spark, sf_dir):
    df = sample.listings(spark, sf_dir)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in _FIELDS])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.coalesce(F.try_divide(F.col(f) * 100.0, F.col("n")), F.lit(0.0)).alias("percent")) for f in _FIELDS])).alias("x"))
    return rounded(long.select("x.*"))


@query(f"{_BASE} SELECT source, count(*) AS n, round(min(price), 4) AS low, round(median(price), 4) AS median, round(avg(price), 4) AS mean, round(max(price), 4) AS high FROM l WHERE price > 0 GROUP BY source")
def positive_price_stats(spark, sf_dir):
    df = sample.listings(spark, sf_dir).where(listing.positive("price"))
    means = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.avg("price").alias("mean"), F.max("price").alias("high"))
    return rounded(join_groups(means, quantiles(df, {"median": ("price", 0.5)}, "source"), "source"))


@query(f"""{_BASE} SELECT property_type, count(price) AS count, count(*) - count(price) AS missing, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(CASE WHEN count(price) = 1 THEN 0 ELSE stddev_samp(price) END, 4) AS std,
round(min(price), 4) AS min, round(max(price), 4) AS max, round(quantile_cont(price, 0.05), 4) AS p05, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.95), 4) AS p95 FROM l GROUP BY 1""")
def price_profile(spark, sf_dir):
    return rounded(metrics.profile(sample.listings(spark, sf_dir), "price", "property_type"))


@query(f"""{_BASE}, b(band_index, price_band) AS (VALUES {", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(listing.BANDS))}), c AS (SELECT {_BAND("price")} AS price_band, count(*) AS n FROM l GROUP BY 1)
SELECT band_index, b.price_band, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / (SELECT sum(n) FROM c WHERE price_band IS NOT NULL), 4) AS percent FROM b LEFT JOIN c ON b.price_band = c.price_band""")
def band_distribution(spark, sf_dir):
    return rounded(metrics.band_distribution(sample.listings(spark, sf_dir)))


@query(f"""{_BASE}, u AS (SELECT property_type, municipality, {_half_up('price / construction_area_m2')} AS unit FROM l WHERE price > 0 AND construction_area_m2 > 0),
q AS (SELECT property_type, municipality, quantile_cont(unit, 0.25) AS q1, quantile_cont(unit, 0.5) AS q2, quantile_cont(unit, 0.75) AS q3 FROM u GROUP BY 1, 2)
SELECT u.property_type, u.municipality, count(*) AS n, round(any_value(q2), 6) AS median, round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS low, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS high,
count(*) FILTER (unit < q1 - 1.5 * (q3 - q1) OR unit > q3 + 1.5 * (q3 - q1)) AS outliers FROM u JOIN q ON u.property_type = q.property_type AND u.municipality = q.municipality GROUP BY 1, 2""")
def price_fences(spark, sf_dir):
    df = sample.listings(spark, sf_dir).withColumn("unit", listing.price_per_construction_m2())
    return rounded(metrics.fences(df, "unit", "property_type", "municipality"), 6)


@query(f"{_ERRORS} SELECT {_METRICS} FROM e")
def error_metrics(spark, sf_dir):
    return rounded(metrics.errors(sample.predictions(spark, sf_dir)), r2=6, median_prediction_ratio=6)


@query(f"{_ERRORS}, g AS (SELECT property_type, municipality, {_METRICS} FROM e GROUP BY 1, 2) SELECT *, CASE WHEN n < 20 THEN 'insufficient' WHEN n < 300 THEN 'weak' ELSE 'usable' END AS sample_quality FROM g")
def error_metrics_by_group(spark, sf_dir):
    df = metrics.errors(sample.predictions(spark, sf_dir), "property_type", "municipality")
    return rounded(df.withColumn("sample_quality", metrics.sample_quality(F.col("n"), 20, 300)), r2=6, median_prediction_ratio=6)


@query(f"{_ERRORS}, g AS (SELECT fold, count(*) AS n, avg(absolute_error) AS mae, avg(percentage_error) AS mape, 1 - sum(residual * residual) / (var_pop(actual_price) * count(*)) AS r2 FROM e GROUP BY 1) SELECT count(DISTINCT fold) AS folds, CAST(sum(n) AS BIGINT) AS n, round(avg(mae), 4) AS mae, round(avg(mape), 4) AS mape, round(avg(r2), 6) AS r2 FROM g")
def fold_mean_metrics(spark, sf_dir):
    return rounded(metrics.fold_means(sample.predictions(spark, sf_dir)).select("folds", "n", "mae", "mape", "r2"), r2=6)


@query(f"{_ERRORS}, g AS (SELECT price_band, count(*) AS n, avg(percentage_error) AS mape, avg(residual) AS bias_mean, median(prediction_ratio) AS r FROM e GROUP BY 1) SELECT price_band, n, round(mape, 4) AS mape, round(bias_mean, 4) AS bias_mean, round(r, 4) AS median_prediction_ratio, CASE WHEN r > 1.05 THEN 'over' WHEN r < 0.95 THEN 'under' ELSE 'balanced' END AS direction FROM g")
def band_bias(spark, sf_dir):
    return rounded(metrics.band_bias(sample.predictions(spark, sf_dir)))


@query(f"{_ERRORS} SELECT count(*) AS n, round(corr(residual, id), 6) AS correlation FROM e WHERE id IS NOT NULL")
def residual_correlation(spark, sf_dir):
    return rounded(metrics.correlation(metrics.with_errors(sample.predictions(spark, sf_dir)), "residual", "id"), 6)


@query(_BASE + ", m AS (" + " UNION ALL ".join(f"SELECT '{s}' AS scope, {v} AS value, '{f}' AS field, count(*) - count({f}) AS missing, round((count(*) - count({f})) * 100.0 / count(*), 4) AS percent FROM l GROUP BY 2" for f in _FIELDS for s, v in (("global", "'all'"), ("source", "source"), ("property_type", "property_type"))) + ") SELECT * FROM m")
def missingness(spark, sf_dir):
    return rounded(metrics.missingness(sample.listings(spark, sf_dir), _FIELDS, "source", "property_type"))


_POINTS = (0.5, 0.68, 0.8, 0.9, 0.95)


@query(_ERRORS + ", m AS (" + " UNION ALL ".join(f"SELECT '{s}' AS scope, {v} AS value, '{m}' AS metric, count(*) AS n, " + ", ".join(f"round(quantile_cont({x}, {q}), 4) AS p{round(100 * q)}" for q in _POINTS) + " FROM e GROUP BY 2" for m, x in metrics.ERRORS.items() for s, v in (("global", "'all'"), ("property_type", "property_type"), ("price_band", "price_band"))) + ") SELECT * FROM m")
def error_percentiles(spark, sf_dir):
    return rounded(metrics.error_percentiles(sample.predictions(spark, sf_dir), "property_type", "price_band"))


@query(f"""{_ERRORS}, c AS (SELECT {", ".join(f"quantile_cont(predicted_price, {i}.0 / 6) AS c{i}" for i in range(1, 6))} FROM e),
b AS (SELECT e.*, {" + ".join(f"(CASE WHEN c{i} < predicted_price THEN 1 ELSE 0 END)" for i in range(1, 6))} AS bin FROM e, c)
SELECT bin, count(*) AS n, round(avg(actual_price), 4) AS actual_mean, round(avg(predicted_price), 4) AS predicted_mean, round(median(actual_price), 4) AS actual_median, round(median(predicted_price), 4) AS predicted_median, round(avg(residual), 4) AS bias FROM b GROUP BY 1""")
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(sample.predictions(spark, sf_dir)))


@query(f"""{_ERRORS}, h AS (SELECT * FROM e WHERE fold <> 0), t AS (SELECT * FROM e WHERE fold = 0),
g AS (SELECT municipality, quantile_cont(percentage_error, 0.8) AS a, quantile_cont(percentage_error, 0.9) AS b FROM h GROUP BY 1 HAVING count(*) >= 20), z AS (SELECT quantile_cont(percentage_error, 0.8) AS a, quantile_cont(percentage_error, 0.9) AS b FROM h),
w AS (SELECT t.*, coalesce(g.a, z.a) / 100 AS pa, coalesce(g.b, z.b) / 100 AS pb FROM t LEFT JOIN g ON g.municipality = t.municipality, z)
SELECT property_type, count(*) AS n, round(avg(CASE WHEN actual_price BETWEEN predicted_price * (1 - pa) AND predicted_price * (1 + pa) THEN 100.0 ELSE 0 END), 4) AS coverage_80, round(avg(CASE WHEN actual_price BETWEEN predicted_price * (1 - pb) AND predicted_price * (1 + pb) THEN 100.0 ELSE 0 END), 4) AS coverage_90,
round(avg(2 * predicted_price * pb), 2) AS mean_width, round(median(2 * predicted_price * pb), 2) AS median_width FROM w GROUP BY 1""")
def interval_coverage(spark, sf_dir):
    df = sample.predictions(spark, sf_dir)
    at = metrics.intervals(df.where("fold <> 0"), df.where("fold = 0"), "municipality", 20)
    return rounded(metrics.coverage(at, "property_type"), 4, mean_width=2, median_width=2)


def _method(name: str, key: str | None, least: int) -> str:
    own = f"LEFT JOIN (SELECT {key}, quantile_cont(percentage_error, 0.8) AS a, quantile_cont(percentage_error, 0.9) AS b FROM h GROUP BY 1 HAVING count(*) >= {least}) g ON g.{key} = t.{key}" if key else "LEFT JOIN (SELECT NULL::DOUBLE AS a, NULL::DOUBLE AS b) g ON true"
    return f"""SELECT '{name}' AS method, count(*) AS n, round(avg(CASE WHEN actual_price BETWEEN predicted_price * (1 - pa) AND predicted_price * (1 + pa) THEN 100.0 ELSE 0 END), 4) AS coverage_80, round(avg(CASE WHEN actual_price BETWEEN predicted_price * (1 - pb) AND predicted_price * (1 + pb) THEN 100.0 ELSE 0 END), 4) AS coverage_90,
round(avg(2 * predicted_price * pb), 2) AS mean_width, round(median(2 * predicted_price * pb), 2) AS median_width FROM (SELECT t.*, coalesce(g.a, z.a) / 100 AS pa, coalesce(g.b, z.b) / 100 AS pb FROM t {own}, z)"""


@query(f"""{_ERRORS}, h AS (SELECT * FROM e WHERE fold <> 0), t AS (SELECT * FROM e WHERE fold = 0), z AS (SELECT quantile_cont(percentage_error, 0.8) AS a, quantile_cont(percentage_error, 0.9) AS b FROM h)
{_method("global_pct", None, 0)} UNION ALL {_method("price_band_pct", "price_band", 10)} UNION ALL {_method("property_type_pct", "property_type", 20)}""")
def interval_methods(spark, sf_dir):
    df = sample.predictions(spark, sf_dir)
    return rounded(metrics.interval_methods(df.where("fold <> 0"), df.where("fold = 0")), 4, mean_width=2, median_width=2)


@query(f"{_BASE} SELECT municipality, " + ", ".join(f"count(*) FILTER (property_type = '{t}') AS {t}" for t in ("casa", "departamento", "terreno")) + " FROM l GROUP BY 1")
def type_crosstab(spark, sf_dir):
    return sample.listings(spark, sf_dir).groupBy("municipality").pivot("property_type", ["casa", "departamento", "terreno"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""{_BASE}, s AS (SELECT property_type, price AS v, sum(construction_area_m2) AS w FROM l WHERE price IS NOT NULL AND construction_area_m2 > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY property_type ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY property_type) AS t FROM s)
SELECT property_type, round(min(CASE WHEN c >= 0.25 * t THEN v END), 4) AS p25, round(min(CASE WHEN c >= 0.5 * t THEN v END), 4) AS p50, round(min(CASE WHEN c >= 0.75 * t THEN v END), 4) AS p75 FROM r GROUP BY 1""")
def weighted_quantiles(spark, sf_dir):
    return rounded(metrics.weighted_quantiles(sample.listings(spark, sf_dir), "price", "construction_area_m2", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "property_type"))


_KEY = "CAST(CAST(round(latitude * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(longitude * 1000) AS BIGINT) AS VARCHAR)"


@query(f"{_BASE}, g AS (SELECT {_KEY} AS k, count(*) AS n FROM l WHERE latitude IS NOT NULL GROUP BY 1) SELECT count(*) AS places, count(*) FILTER (n = 1) AS unique_places, count(*) FILTER (n > 1) AS shared_places, max(n) AS largest FROM g")
def coordinate_groups(spark, sf_dir):
    df = sample.listings(spark, sf_dir).where("latitude is not null")
    g = df.groupBy(geo.key(F.col("latitude"), F.col("longitude"), 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("n") == 1).alias("unique_places"), F.count_if(F.col("n") > 1).alias("shared_places"), F.max("n").alias("largest"))


@query(f"{_BASE} SELECT dedupe_fingerprint, count(*) AS n, count(DISTINCT source) AS sources, min(id) AS first_id FROM l GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def fingerprint_groups(spark, sf_dir):
    return sample.listings(spark, sf_dir).groupBy("dedupe_fingerprint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min("id").alias("first_id")).where("sources >= 2")


@query(f"{_BASE}, g AS (SELECT count(*) AS n FROM l GROUP BY dedupe_fingerprint) SELECT count(*) FILTER (n > 1) AS groups_with_duplicates, (coalesce(sum(n) FILTER (n > 1), 0))::BIGINT AS records_in_duplicate_groups, sum(n - 1)::BIGINT AS records_removed FROM g")
def duplicate_summary(spark, sf_dir):
    return windows.duplicate_summary(sample.listings(spark, sf_dir), "dedupe_fingerprint")


@query(f"{_BASE}, g AS (SELECT dedupe_fingerprint AS g, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 20) SELECT dedupe_fingerprint, n AS count, source, source_id, title, price FROM l JOIN g ON g = dedupe_fingerprint")
def duplicate_examples(spark, sf_dir):
    return windows.duplicate_examples(sample.listings(spark, sf_dir), "dedupe_fingerprint", ["source", "source_id", "title", "price", "not_there"])


@query(f"""{_BASE}, q AS (SELECT source, CASE WHEN latitude IS NOT NULL AND neighborhood <> '' AND municipality <> '' THEN 'A' WHEN latitude IS NOT NULL AND municipality <> '' THEN 'B' WHEN neighborhood <> '' AND municipality <> '' THEN 'C' WHEN municipality <> '' THEN 'D' ELSE 'E' END AS g FROM l)
SELECT source, {", ".join(f"count(*) FILTER (g = '{g}') AS {g.lower()}" for g in "ABCDE")} FROM q GROUP BY 1""")
def location_quality_counts(spark, sf_dir):
    g = sample.listings(spark, sf_dir).withColumn("g", listing.location_quality())
    return g.groupBy("source").agg(*[F.count_if(F.col("g") == x).alias(x.lower()) for x in "ABCDE"])


@query(f"""{_ERRORS}, g AS (SELECT municipality, count(*) AS n, avg(percentage_error) AS mape, avg(CASE WHEN percentage_error <= 20 THEN 100.0 ELSE 0 END) AS w FROM e GROUP BY 1)
SELECT municipality, n AS current_count, CASE WHEN n < 20 OR mape > 70 THEN 'high' WHEN n < 50 OR w < 45 THEN 'medium' ELSE 'low' END AS priority, greatest(n, 40) AS recommended_target FROM g""")
def collection_requirements(spark, sf_dir):
    by = metrics.errors(sample.predictions(spark, sf_dir), "municipality")
    return evaluation.requirements(by, "municipality", F.lit(None).cast("long"))


_VALUATIONS = "SELECT o_orderkey AS prediction_id, o_custkey AS valuation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS model, o_totalprice AS estimated_value, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders"


def _valuations(spark, sf_dir):
    return spark.sql(_VALUATIONS.replace("FROM orders", "FROM {o}"), o=_read(spark, sf_dir, "orders"))


@query(f"""WITH v AS ({_VALUATIONS}), w AS (SELECT valuation_id, max(CASE WHEN model = 'v1' THEN estimated_value END) AS v1, max(CASE WHEN model = 'v2' THEN estimated_value END) AS v2 FROM v GROUP BY 1)
SELECT valuation_id, round(v1, 4) AS v1, round(v2, 4) AS v2, round(v2 - v1, 4) AS difference, round((v2 - v1) / v1 * 100, 4) AS difference_percent FROM w""")
def model_differences(spark, sf_dir):
    return rounded(serving.model_differences(_valuations(spark, sf_dir), ["v1", "v2"]))


@query(f"""WITH v AS ({_VALUATIONS}), r AS (SELECT *, row_number() OVER (PARTITION BY valuation_id ORDER BY created_at DESC, prediction_id DESC) AS k FROM v WHERE status = 'completed' AND estimated_value > 0), x AS (SELECT * FROM r WHERE k = 1),
c AS (SELECT c_custkey AS valuation_id, CASE c_custkey % 3 WHEN 0 THEN 'terreno' ELSE 'casa' END AS t, c_acctbal AS legacy FROM customer)
SELECT c.valuation_id, CASE WHEN t = 'terreno' THEN 'unavailable' WHEN x.estimated_value IS NOT NULL AND c.valuation_id % 2 = 0 THEN 'v2' WHEN legacy > 0 THEN 'legacy' ELSE 'unavailable' END AS origin,
CASE WHEN t <> 'terreno' THEN coalesce(CASE WHEN c.valuation_id % 2 = 0 THEN x.estimated_value END, CASE WHEN legacy > 0 THEN legacy END) END AS value,
CASE WHEN t = 'terreno' THEN 'unsupported_property_type' WHEN NOT (x.estimated_value IS NOT NULL AND c.valuation_id % 2 = 0) AND NOT legacy > 0 THEN 'no_valid_result' END AS reason FROM c LEFT JOIN x ON x.valuation_id = c.valuation_id""")
def result_resolution(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("valuation_id"), F.when(F.col("c_custkey") % 3 == 0, "terreno").otherwise("casa").alias("property_type"), F.col("c_acctbal").alias("legacy_value"))
    return serving.resolve(c, _valuations(spark, sf_dir), F.col("valuation_id") % 2 == 0)


@query(f"""{_ERRORS}, f AS (SELECT e.*, id % 40 = 0 AS wrong FROM e), c AS (SELECT quantile_cont(actual_price, 0.05) AS a, quantile_cont(actual_price, 0.95) AS b, quantile_cont(percentage_error, 0.95) AS x FROM f)
SELECT id, CASE WHEN wrong THEN 'probably_wrong' WHEN actual_price >= b OR actual_price <= a THEN 'extreme_price' ELSE 'extreme_error' END AS outlier_type FROM f, c WHERE wrong OR actual_price >= b OR actual_price <= a OR percentage_error >= x""")
def outlier_types(spark, sf_dir):
    df = sample.predictions(spark, sf_dir).withColumn("flags", F.array(F.when(F.col("id") % 40 == 0, "invalid_price").otherwise("missing_price")))
    return metrics.outliers(df, listing.ERROR_FLAGS).select("id", "outlier_type")


@query(f"{_BASE} SELECT l.id, count(*) FILTER (d <= 5000) AS all_5000m, count(*) FILTER (d <= 10000) AS all_10000m, count(*) FILTER (d <= 5000 AND starts_with(activity, '46')) AS retail_5000m, count(*) FILTER (d <= 10000 AND starts_with(activity, '46')) AS retail_10000m FROM l LEFT JOIN (SELECT t.id AS tid, activity, {_distance('t', 'pl')} AS d FROM l t, pl) x ON x.tid = l.id GROUP BY 1")
def place_counts(spark, sf_dir):
    near = spatial.radius_counts(sample.listings(spark, sf_dir), sample.places(spark, sf_dir), "id", {"all": "", "retail": "46"}, (5000, 10000))
    return near


@query(f"{_BASE}, d AS (SELECT l.id, substr(activity, 1, 2) AS category, place_id, {_distance('l', 'pl')} AS distance_m FROM l, pl), r AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY distance_m, place_id) AS rank FROM d WHERE distance_m <= 8000) SELECT id, category, CAST(rank AS INT) AS rank, place_id, round(distance_m, 3) AS distance_m FROM r WHERE rank <= 5")
def nearest_places(spark, sf_dir):
    got = spatial.nearest(sample.listings(spark, sf_dir), sample.places(spark, sf_dir), "id", F.substring("place_activity", 1, 2), 8000.0, 5)
    return rounded(got, 3)


@query(f"{_BASE}, t AS (SELECT id, latitude, longitude, CAST(floor(latitude * 1000) AS BIGINT) AS y FROM l), b AS (SELECT id, latitude, longitude, y + d AS y FROM t, (VALUES (-1), (0), (1)) v(d)) SELECT t.id, count(*) FILTER (b.id IS NOT NULL AND {_distance('t', 'b')} < 25) AS nearby FROM t LEFT JOIN b ON t.y = b.y GROUP BY 1")
def near_listings(spark, sf_dir):
    return spatial.neighbours(sample.listings(spark, sf_dir), "id", 25.0)


def _squares(spark):
    """Forty rectangles over the region, some overlapping."""
    rows = [(i, 18.5 + (i % 8) * 0.05, 18.56 + (i % 8) * 0.05, -99.5 + (i // 8) * 0.1, -99.39 + (i // 8) * 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "area_id int, south double, north double, west double, east double")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.withColumn("ring", F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south")))


@query(f"{_BASE}, a AS (SELECT CAST(i AS INT) AS area_id, 18.5e0 + (i % 8) * 0.05e0 AS s, 18.56e0 + (i % 8) * 0.05e0 AS n, -99.5e0 + (i // 8) * 0.1e0 AS w, -99.39e0 + (i // 8) * 0.1e0 AS e FROM range(40) r(i)) SELECT id, min(area_id) AS area_id FROM l LEFT JOIN a ON latitude BETWEEN s AND n AND longitude BETWEEN w AND e GROUP BY 1")
def area_of_point(spark, sf_dir):
    return spatial.point_in_polygon(sample.listings(spark, sf_dir), _squares(spark), "id")


def _norm_sql(x: str) -> str:
    return f"coalesce(trim(regexp_replace(translate(lower({x}), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', ' ', 'g')), '')"


_CLOSE = lambda x, tolerance: f"coalesce(a.{x} = b.{x} OR abs(a.{x} - b.{x}) / greatest(abs(a.{x}), abs(b.{x}), 1.0) <= {tolerance}, FALSE)"
_SAME = lambda x: f"(a.k_{x} <> '' AND a.k_{x} = b.k_{x})"
_LIKENESS = " + ".join([f"CASE WHEN {_SAME(x)} THEN {w} ELSE 0e0 END" for x, w in (("municipality", "0.12e0"), ("neighborhood", "0.12e0"), ("street", "0.10e0"), ("property_type", "0.10e0"))]
    + [f"CASE WHEN {_CLOSE(x, t)} THEN {w} ELSE 0e0 END" for x, w, t in (("price", "0.20e0", "0.12e0"), ("land_area_m2", "0.12e0", "0.10e0"), ("construction_area_m2", "0.12e0", "0.10e0"), ("bedrooms", "0.07e0", "0.01e0"), ("bathrooms", "0.07e0", "0.01e0"))]
    + [f"CASE WHEN coalesce({_distance('a', 'b')} <= 75, FALSE) OR coalesce(a.dedupe_fingerprint <> '' AND a.dedupe_fingerprint = b.dedupe_fingerprint, FALSE) THEN 0.08e0 ELSE 0e0 END"])
#: Pairs that can reach 0.682 of the weights' 1.10: one join for each kind of key, and all conditions again.
_PAIRS = f"""{_BASE}, k AS (SELECT *, {", ".join(f"{_norm_sql(x)} AS k_{x}" for x in listing.MATCH_TEXTS)} FROM l),
j AS ({" UNION ".join(f"SELECT a.id AS left_id, b.id AS right_id FROM k a JOIN k b ON {on} WHERE a.source < b.source" for on in (
    "a.k_street = b.k_street AND a.k_street <> ''", "a.k_neighborhood = b.k_neighborhood AND a.k_neighborhood <> ''",
    f"a.k_municipality = b.k_municipality AND a.k_municipality <> '' AND {_CLOSE('price', '0.12e0')}",
    f"a.k_property_type = b.k_property_type AND a.k_property_type <> '' AND a.price BETWEEN b.price * 0.87 AND b.price * 1.15 AND {_CLOSE('price', '0.12e0')} AND {_CLOSE('land_area_m2', '0.10e0')} AND {_CLOSE('construction_area_m2', '0.10e0')}"))}),
s AS (SELECT left_id, right_id, ({_LIKENESS}) / (0.12e0 + 0.12e0 + 0.10e0 + 0.10e0 + 0.20e0 + 0.12e0 + 0.12e0 + 0.07e0 + 0.07e0 + 0.08e0) AS score FROM j JOIN k a ON a.id = left_id JOIN k b ON b.id = right_id)"""  # fmt: skip


@query(f"{_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM s WHERE score >= 0.62")
def cross_source_duplicates(spark, sf_dir):
    return rounded(spatial.cross_source_pairs(sample.listings(spark, sf_dir)), 6)


@query(f"{_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM s WHERE score >= 0.62 ORDER BY s.score DESC, left_id, right_id LIMIT 100")
def likely_duplicates(spark, sf_dir):
    return rounded(spatial.likely_duplicates(sample.listings(spark, sf_dir)), 6)


# Picks, orders and samples


@query(f"{_BASE}, d AS (SELECT *, row_number() OVER (PARTITION BY dedupe_fingerprint ORDER BY source_id, id) AS k FROM l) SELECT id, dedupe_fingerprint FROM d WHERE k = 1")
def keep_first_of_group(spark, sf_dir):
    return windows.first_of(sample.listings(spark, sf_dir), ["dedupe_fingerprint"], ["source_id", "id"]).select("id", "dedupe_fingerprint")


@query(f"""{_BASE}, t AS (SELECT id, url, municipality, source_id, row_number() OVER (PARTITION BY municipality ORDER BY id) AS turn FROM l), u AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY turn, municipality) AS k FROM t)
SELECT id, turn, municipality FROM u WHERE k = 1 ORDER BY turn, municipality LIMIT 100""")
def round_robin(spark, sf_dir):
    return windows.interleave(sample.listings(spark, sf_dir), "municipality", ["id"], "source_id", 100).select("id", F.col("turn").cast("long").alias("turn"), "municipality")


@query(f"{_ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY percentage_error, id) AS k, count(*) OVER (PARTITION BY municipality) AS n FROM e) SELECT municipality, id FROM r WHERE k = n // 2 + 1")
def middle_errors(spark, sf_dir):
    return windows.middle_of(metrics.with_errors(sample.predictions(spark, sf_dir)), ["municipality"], ["percentage_error", "id"]).select("municipality", "id")


@query(f"{_ERRORS}, a AS (SELECT * FROM e ORDER BY percentage_error DESC, id LIMIT 20), b AS (SELECT * FROM e ORDER BY absolute_error DESC, id LIMIT 20), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT id, round(percentage_error, 4) AS percentage_error FROM u ORDER BY u.percentage_error DESC, id LIMIT 40")
def worst_predictions(spark, sf_dir):
    got = windows.worst(metrics.with_errors(sample.predictions(spark, sf_dir)), ["percentage_error", "absolute_error"], 20, 40, "id")
    return rounded(got.select("id", "percentage_error"))


@query(f"{_ERRORS} SELECT id, round(percentage_error, 4) AS percentage_error FROM e ORDER BY e.percentage_error, absolute_error, id LIMIT 25")
def best_predictions(spark, sf_dir):
    return rounded(metrics.with_errors(sample.predictions(spark, sf_dir)).orderBy("percentage_error", "absolute_error", "id").limit(25).select("id", "percentage_error"))


@query("SELECT p_partkey AS id, replace(p_name, ' ', '-') || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def numbered_slugs(spark, sf_dir):
    df = _read(spark, sf_dir, "part").withColumn("slug", text.slug(F.col("p_name")))
    return windows.numbered_slugs(df, "slug", "p_partkey").select(F.col("p_partkey").alias("id"), "unique_slug")


_FOLD_OF = "list_position(loads, list_min(loads))"


@query(f"""WITH RECURSIVE l AS ({sample.LISTINGS}), g AS (SELECT dedupe_fingerprint AS g, count(*) AS n FROM l GROUP BY 1), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, substr(md5(g), 1, 12), g) AS k FROM g),
f(k, fold, loads) AS (SELECT 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT o.k, {_FOLD_OF}::BIGINT, list_transform(loads, lambda x, i: x + CASE WHEN i = {_FOLD_OF} THEN n ELSE 0 END) FROM f JOIN o ON o.k = f.k + 1)
SELECT dedupe_fingerprint, CAST(fold - 1 AS INTEGER) AS fold, count(*) AS n FROM l JOIN o ON o.g = dedupe_fingerprint JOIN f ON f.k = o.k GROUP BY ALL""")
def group_folds(spark, sf_dir):
    df = windows.group_folds(sample.listings(spark, sf_dir), F.col("dedupe_fingerprint"))
    return df.groupBy("dedupe_fingerprint", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY property_type ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) AS k FROM l) SELECT id, property_type FROM r WHERE k <= 50")
def stratified_sample(spark, sf_dir):
    return windows.exact_sample(sample.listings(spark, sf_dir), ["property_type"], F.lit(50), "id", 7).select("id", "property_type")


@query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS place, max(value) AS score FROM events GROUP BY 1")
def best_candidate(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("place"), F.col("value").alias("score"), F.col("event_id").alias("ordinal"))
    return serving.best_place(df, "user_id")


# Snapshots


_OLD = "SELECT * FROM l WHERE created_at < TIMESTAMP '1998-01-01'"
_NEW = "SELECT * FROM l WHERE created_at >= TIMESTAMP '1996-01-01'"


def _old_new(spark, sf_dir):
    df = sample.listings(spark, sf_dir).select("source_id", "source", "price", "created_at", "id")
    return df.where("created_at < timestamp '1998-01-01'"), df.where("created_at >= timestamp '1996-01-01'").withColumn("price", F.col("price") * 1.5)


@query(f"""{_BASE}, b AS (SELECT 0 AS nw, source, source_id, price, created_at, id FROM ({_OLD}) UNION ALL SELECT 1, source, source_id, price * 1.5, created_at, id FROM ({_NEW})),
r AS (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY nw DESC, created_at DESC) AS k, min(created_at) OVER (PARTITION BY source, source_id) AS first_at FROM b) SELECT source, source_id, round(price, 4) AS price, first_at AS created_at FROM r WHERE k = 1""")
def upsert_snapshot(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return rounded(upsert.upsert(old, new, ["source", "source_id"], "created_at", ("created_at",)).select("source", "source_id", "price", "created_at"))


@query(f"""{_BASE}, o AS (SELECT id, price FROM ({_OLD})), n AS (SELECT id, price * 1.5 AS price FROM ({_NEW}))
SELECT count(*) FILTER (n.id % 71 <> 0 AND n.price > 0 AND o.id IS NULL) AS created, count(*) FILTER (n.id % 71 <> 0 AND n.price > 0 AND o.id IS NOT NULL AND n.price IS DISTINCT FROM o.price) AS updated,
count(*) FILTER (n.id % 71 <> 0 AND n.price > 0 AND o.id IS NOT NULL AND n.price IS NOT DISTINCT FROM o.price) AS unchanged, count(*) FILTER (NOT coalesce(n.price > 0, FALSE) AND n.id % 71 <> 0) AS skipped, count(*) FILTER (n.id % 71 = 0) AS errors FROM n LEFT JOIN o ON o.id = n.id""")
def upsert_counts(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return upsert.upsert_counts(old, new, ["id"], F.col("price") > 0, ["price"], broken=F.col("id") % 71 == 0)


@query(f"{_BASE} SELECT id FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE o.id = n.id)")
def unseen_rows(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return upsert.unseen(new, old, ["id"]).select("id")


@query("""WITH c AS (SELECT event_type AS key, arg_max(value, event_id) AS value, max(epoch(ts)::BIGINT) AS stored_at FROM events GROUP BY 1), w AS (SELECT DISTINCT event_type AS key FROM events), m AS (SELECT max(stored_at) AS t FROM c)
SELECT w.key, c.value, CASE WHEN m.t - stored_at <= 3600 THEN 'cache' ELSE 'stale' END AS origin FROM w JOIN c ON c.key = w.key, m""")
def cached_values(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("stored_at"))
    cache = e.groupBy("key").agg(F.max_by("value", "event_id").alias("value"), F.max("stored_at").alias("stored_at"))
    newest = cache.agg(F.max("stored_at").alias("now"))
    with_now = cache.crossJoin(F.broadcast(newest))  # one row
    none = cache.limit(0).select("key", "value")
    return upsert.fresh_or_stale(e, with_now.withColumn("stored_at", F.col("stored_at") - F.col("now")).drop("now"), none, "key", F.lit(0), 3600)


@query("SELECT l_orderkey, l_linenumber, sha256(l_returnflag || l_linestatus || CAST(l_partkey AS VARCHAR)) AS content_hash FROM lineitem")
def content_hashes(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").withColumn("raw", F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")))
    return upsert.with_hash(df, "raw").select("l_orderkey", "l_linenumber", "content_hash")


# Baselines, membership, lookups


@query(f"""{_BASE}, tr AS (SELECT * FROM l WHERE price > 0 AND id % 5 <> 0), te AS (SELECT * FROM l WHERE price > 0 AND id % 5 = 0), g AS (SELECT neighborhood, median(price) AS m FROM tr GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT te.*, coalesce(g.m, (SELECT median(price) FROM tr)) AS predicted_price, te.price AS actual_price FROM te LEFT JOIN g ON g.neighborhood = te.neighborhood)
SELECT count(*) AS n, round(avg(abs(predicted_price - actual_price)), 4) AS mae, round(avg(abs(predicted_price - actual_price) / greatest(actual_price, 1)) * 100, 4) AS mape FROM e""")
def group_median_baseline(spark, sf_dir):
    df = sample.listings(spark, sf_dir).where(listing.positive("price"))
    got = evaluation.group_median(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "neighborhood").withColumn("actual_price", F.col("price"))
    return rounded(metrics.errors(got).select("n", "mae", "mape"))


@query(f"""{_BASE}, q AS (SELECT *, {_BAND("price")} AS price_band FROM l WHERE property_type IN ('casa', 'departamento') AND currency = 'MXN' AND price > 0 AND coordinate_quality IN ('high', 'medium') AND inegi_cve_ageb <> '' AND created_at >= TIMESTAMP '1996-01-01'),
k AS (SELECT * FROM l WHERE created_at < TIMESTAMP '1996-01-01'),
m AS (SELECT q.*, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.source = q.source AND k.source_id = q.source_id) THEN 'historical_source_id' WHEN EXISTS (SELECT 1 FROM k WHERE k.url = q.url) THEN 'historical_url' WHEN EXISTS (SELECT 1 FROM k WHERE k.dedupe_fingerprint = q.dedupe_fingerprint) THEN 'historical_fingerprint' END AS old,
  row_number() OVER (ORDER BY CASE WHEN municipality = 'Municipio 1' THEN 0 WHEN municipality = 'Municipio 2' THEN 1 ELSE 2 END, CASE WHEN price_band IN ('<1M', '1M-2M', '2M-3M', '12M-20M', '>20M') THEN 0 ELSE 1 END, property_type <> 'departamento', source = 'portal_c', source_id, id) AS o FROM q),
d AS (SELECT *, coalesce(old, CASE WHEN row_number() OVER (PARTITION BY dedupe_fingerprint, old IS NULL ORDER BY o) > 1 THEN 'holdout_internal_duplicate' END) AS reason FROM m),
s AS (SELECT id, o FROM d WHERE reason IS NULL ORDER BY o LIMIT 40)
SELECT id, 'selected' AS outcome FROM s UNION ALL SELECT id, reason FROM d WHERE reason IS NOT NULL AND ((SELECT count(*) FROM s) < 40 OR o < (SELECT max(o) FROM s))""")
def holdout_selection(spark, sf_dir):
    df = sample.listings(spark, sf_dir).withColumns({"market_segment": listing.market_segment(), "price_band": listing.price_band(), "training_readiness": F.lit("B")})
    rows = df.where(holdout.is_candidate() & (F.col("created_at") >= F.lit("1996-01-01").cast("timestamp")))
    chosen, excluded = holdout.select(rows, df.where("created_at < timestamp '1996-01-01'"), holdout.priority(["Municipio 1"], ["Municipio 2"], "portal_c"), 40)
    return chosen.select("id", F.lit("selected").alias("outcome")).unionByName(excluded.select("id", F.col("reason").alias("outcome")))


@query("SELECT n_name, coalesce(CAST(c_pop AS DOUBLE), 0) AS population FROM nation LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS c_pop FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON c_nationkey = n_nationkey")
def census_lookup(spark, sf_dir):
    census = _read(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(text.code(F.col("c_nationkey"), 3).alias("key")).agg(F.max("c_acctbal").alias("population"))
    n = _read(spark, sf_dir, "nation").withColumn("key", text.code(F.col("n_nationkey"), 3))
    return n.join(census, "key", "left").select("n_name", F.coalesce("population", F.lit(0.0)).alias("population"))


# Comparables


_RISE = lambda a, b, start: f"least(1e0, greatest(0e0, (least({a}, {b}) / greatest({a}, {b}) - {start}e0) / (1 - {start}e0)))"
_ROOMS = " + ".join(f"greatest(0e0, 1 - abs(coalesce(k.{n}, 0)::DOUBLE - coalesce(t.{n}, 0)::DOUBLE) / 2) * {w}" for n, w in (("bedrooms", 10), ("bathrooms", 8), ("parking_spaces", 5)))
_EQUAL = lambda n: f"(coalesce(t.{n}, '') = coalesce(k.{n}, ''))"
_HALF = "(sin(radians(k.latitude - t.latitude) / 2) * sin(radians(k.latitude - t.latitude) / 2) + cos(radians(t.latitude)) * cos(radians(k.latitude)) * sin(radians(k.longitude - t.longitude) / 2) * sin(radians(k.longitude - t.longitude) / 2))"
_TIER_OF = lambda x: "CASE " + " ".join(f"WHEN {x} = '{n}' THEN {v}e0" for n, v in comparables.TIERS) + " END"


@query(f"""{_BASE}, d AS (SELECT * FROM l WHERE deleted_at IS NULL AND latitude IS NOT NULL AND price > 0 AND construction_area_m2 > 0),
m AS (SELECT t.id AS target_id, t.property_type, t.construction_area_m2 AS tb, t.land_area_m2 AS tl, k.id AS kid, k.price, k.construction_area_m2 AS kb, k.land_area_m2 AS kl, 2 * 6371000.0 * asin(sqrt(least(1e0, greatest(0e0, {_HALF})))) AS dist,
  {_EQUAL("neighborhood")} AS nb, {_EQUAL("inegi_cve_ageb")} AS ag, {_EQUAL("municipality")} AS mu, {_RISE("t.construction_area_m2", "k.construction_area_m2", 0.7)} * 20
  + CASE WHEN t.property_type = 'casa' AND t.land_area_m2 > 0 THEN CASE WHEN k.land_area_m2 > 0 THEN {_RISE("t.land_area_m2", "k.land_area_m2", 0.5)} ELSE 0e0 END * 15 ELSE 15e0 END + {_ROOMS} AS part FROM d t JOIN d k ON t.property_type = k.property_type AND t.id <> k.id),
s AS (SELECT *, greatest(0e0, (1 - dist / 3000.0) * 25) + part + CASE WHEN nb THEN 10e0 ELSE 0e0 END + CASE WHEN ag THEN 7e0 ELSE 0e0 END AS score FROM m),
c AS (SELECT target_id, count(*) FILTER (nb AND score >= 35) AS a, count(*) FILTER (ag AND score >= 35) AS b, count(*) FILTER (dist <= 1000 AND score >= 35) AS c, count(*) FILTER (dist <= 2000 AND score >= 35) AS d FROM s GROUP BY 1),
st AS (SELECT target_id, CASE WHEN a >= 3 THEN '{comparables.TIERS[0][0]}' WHEN b >= 3 THEN '{comparables.TIERS[1][0]}' WHEN c >= 3 THEN '{comparables.TIERS[2][0]}' WHEN d >= 3 THEN '{comparables.TIERS[3][0]}' ELSE '{comparables.TIERS[4][0]}' END AS strategy FROM c),
x AS (SELECT s.*, strategy, CASE WHEN property_type = 'casa' AND tl > 0 THEN CASE WHEN kl > 0 THEN kb + 0.5e0 * kl END ELSE kb END AS size, CASE WHEN property_type = 'casa' AND tl > 0 THEN tb + 0.5e0 * tl ELSE tb END AS wanted FROM s JOIN st ON st.target_id = s.target_id
  WHERE CASE strategy WHEN '{comparables.TIERS[0][0]}' THEN nb AND score >= 35 WHEN '{comparables.TIERS[1][0]}' THEN ag AND score >= 35 WHEN '{comparables.TIERS[2][0]}' THEN dist <= 1000 AND score >= 35 WHEN '{comparables.TIERS[3][0]}' THEN dist <= 2000 AND score >= 35 ELSE mu END),
y AS (SELECT *, price / size AS unit, exp(least(3e0, greatest(0e0, score / 50))) / (1 + dist / 1000) AS weight FROM x WHERE size > 0 AND wanted > 0),
u AS (SELECT target_id, unit, sum(weight) AS w FROM y GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY target_id ORDER BY unit ROWS UNBOUNDED PRECEDING) AS so_far, sum(w) OVER (PARTITION BY target_id) AS whole FROM u),
q AS (SELECT target_id, min(unit) FILTER (so_far >= 0.25e0 * whole) AS p25, min(unit) FILTER (so_far >= 0.5e0 * whole) AS p50, min(unit) FILTER (so_far >= 0.75e0 * whole) AS p75 FROM r GROUP BY 1),
f AS (SELECT target_id, min(strategy) AS strategy, count(*) AS n, avg(score) AS mean, min(wanted) AS wanted FROM y GROUP BY 1), g AS (SELECT f.*, q.* EXCLUDE (target_id), CASE WHEN p50 > 0 THEN (p75 - p25) / p50 END AS spread FROM f JOIN q ON q.target_id = f.target_id)
SELECT target_id, strategy, n AS comparable_count, round(mean, 6) AS mean_similarity, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(spread, 6) AS dispersion, round(p50 * wanted, 6) AS market_base,
round(greatest(0e0, least(1e0, 0.35e0 * {_TIER_OF("strategy")} + 0.25e0 * least(n / 10e0, 1e0) + 0.2e0 * least(mean / 100, 1e0) + 0.2e0 * exp(-least(coalesce(spread, 2e0), 3e0)))), 6) AS market_strength FROM g""")
def comparable_market(spark, sf_dir):
    df = sample.listings(spark, sf_dir).where("deleted_at is null and latitude is not null and price > 0 and construction_area_m2 > 0")
    return rounded(comparables.estimate(df, df), 6)


@query(f"""{_BASE}, m AS (SELECT id, price AS market_base, price * (0.4 + (id % 30) / 10.0) AS ml_prediction, (id % 100) / 100.0 AS s, id % 14 AS n, (id % 9) / 10.0 AS dispersion FROM l),
w AS (SELECT *, market_base > 0 AS h, greatest(0.05, least(0.95, CASE WHEN market_base < 1500000 THEN 0.75 + 0.2 * s ELSE 0.15 + 0.75 * s END)) AS w, exp(-abs(ln(greatest(0.05, least(20.0, ml_prediction / nullif(market_base, 0))))) / ln(2.0)) AS a FROM m)
SELECT id, round(CASE WHEN h THEN w * market_base + (1 - w) * ml_prediction ELSE ml_prediction END, 0) AS estimated_value, CASE WHEN h AND s >= 0.75 AND n >= 10 AND dispersion <= 0.4 AND a >= 0.6 THEN 'HIGH' WHEN h AND s >= 0.5 AND n >= 5 AND dispersion <= 0.7 AND a >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM w""")
def reconciled_values(spark, sf_dir):
    m = sample.listings(spark, sf_dir).select("id", F.col("price").alias("market_base"), (F.col("price") * (F.lit(0.4) + (F.col("id") % 30) / 10.0)).alias("ml_prediction"), ((F.col("id") % 100) / 100.0).alias("market_strength"), (F.col("id") % 14).alias("comparable_count"), ((F.col("id") % 9) / 10.0).alias("dispersion"))
    return rounded(comparables.reconcile(m).select("id", "estimated_value", "confidence"), 0)


# Listing rules


@query(f"""{_BASE} SELECT id, lower(title) LIKE '%venta%' AS dummy, CASE WHEN regexp_matches(lower(title), '\\bcasa\\b') THEN 'casa' WHEN regexp_matches(lower(title), '\\bdepartamento\\b|\\bdepa\\b') THEN 'departamento' WHEN regexp_matches(lower(title), '\\bterreno\\b') THEN 'terreno' ELSE 'otro' END AS kind,
CASE WHEN contains(lower(title), 'venta') THEN 'venta' WHEN contains(lower(title), 'rent') THEN 'renta' ELSE 'desconocido' END AS operation, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title FROM l""")
def normalized_titles(spark, sf_dir):
    t = F.col("title")
    return sample.listings(spark, sf_dir).select("id", F.lower(t).contains("venta").alias("dummy"), text.property_type(t).alias("kind"), text.operation(t).alias("operation"), text.clean_text(t).alias("title"))


@query(f"""{_BASE} SELECT id, CASE WHEN property_type IN ('casa', 'departamento') THEN 'residential' WHEN property_type = 'terreno' THEN 'land' END AS segment, {_BAND("price")} AS price_band,
CASE WHEN price > 0 AND construction_area_m2 > 0 THEN {_half_up('price / construction_area_m2')} END AS per_built, CASE WHEN property_type = 'terreno' AND price > 0 AND land_area_m2 > 0 THEN {_half_up('price / land_area_m2')} END AS per_land FROM l""")
def derived_prices(spark, sf_dir):
    return sample.listings(spark, sf_dir).select("id", listing.market_segment().alias("segment"), listing.price_band().alias("price_band"), listing.price_per_construction_m2().alias("per_built"), listing.price_per_land_m2().alias("per_land"))


_FEATURES = "coalesce(price > 0, FALSE) AND coalesce(property_type IN ('casa', 'departamento', 'terreno'), FALSE) AND coalesce(inegi_cve_ageb <> '', FALSE) AND population_density IS NOT NULL AND housing_density IS NOT NULL AND establishments_500m IS NOT NULL AND establishments_1km IS NOT NULL"
_LAND, _BUILT, _USABLE = "coalesce(land_area_m2 > 0, FALSE)", "coalesce(construction_area_m2 > 0, FALSE)", "(coalesce(coordinate_quality IN ('high', 'medium'), FALSE) OR coalesce(latitude <> 0 AND longitude <> 0, FALSE))"


@query(f"""{_BASE}, r AS (SELECT id, {_FEATURES} AS f, coordinate_quality AS q, {_USABLE} AS u, coalesce(price > 0, FALSE) AND property_type IN ('casa', 'departamento', 'terreno') AS b,
CASE property_type WHEN 'terreno' THEN {_LAND} WHEN 'departamento' THEN {_BUILT} AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL ELSE {_LAND} AND {_BUILT} AND bedrooms IS NOT NULL AND bathrooms IS NOT NULL END AS c,
CASE property_type WHEN 'terreno' THEN {_LAND} WHEN 'departamento' THEN {_BUILT} AND (bedrooms IS NOT NULL OR bathrooms IS NOT NULL) ELSE ({_LAND} OR {_BUILT}) AND (bedrooms IS NOT NULL OR bathrooms IS NOT NULL) END AS s FROM l)
SELECT id, CASE WHEN f AND c AND q = 'high' THEN 'A' WHEN f AND c AND q = 'medium' THEN 'B' WHEN f AND s AND u THEN 'C' WHEN b AND u THEN 'D' ELSE 'E' END AS readiness FROM r""")
def training_readiness(spark, sf_dir):
    return sample.listings(spark, sf_dir).select("id", listing.readiness().alias("readiness"))


_FLAG_TESTS = [
    ("latitude IS NULL OR longitude IS NULL", "missing_coordinates"), ("price IS NULL", "missing_price"), ("price <= 0", "invalid_price"), ("construction_area_m2 IS NULL", "missing_construction_area"), ("construction_area_m2 <= 0", "invalid_construction_area"),
    ("construction_area_m2 > 5000", "suspicious_construction_area"), ("land_area_m2 IS NULL", "missing_land_area"), ("land_area_m2 <= 0", "invalid_land_area"), ("land_area_m2 > 100000", "suspicious_land_area"), ("bedrooms > 20", "suspicious_bedrooms"), ("bathrooms > 20", "suspicious_bathrooms"),
    ("land_area_m2 = construction_area_m2", "same_land_and_construction_area"), ("generic_area_m2 IS NOT NULL AND land_area_m2 IS NULL AND construction_area_m2 IS NULL", "generic_area_only"), ("generic_area_m2 IS NOT NULL AND (land_area_m2 IS NOT NULL OR construction_area_m2 IS NOT NULL)", "suspicious_area_assignment"),
    ("generic_area_m2 IS NOT NULL", "ambiguous_area"), ("construction_area_m2 / nullif(land_area_m2, 0) < 0.15 OR construction_area_m2 / nullif(land_area_m2, 0) > 4", "suspicious_surface_pair"), ("coalesce(neighborhood, '') = ''", "missing_location"),
    ("price <> 0 AND construction_area_m2 > 0 AND (price / construction_area_m2 < 1000 OR price / construction_area_m2 > 200000)", "suspicious_price_m2"),
]


@query(f"{_BASE} SELECT id, concat_ws(',', {', '.join(f'CASE WHEN {t} THEN {chr(39)}{n}{chr(39)} END' for t, n in _FLAG_TESTS)}) AS flags FROM l")
def quality_flags(spark, sf_dir):
    df = sample.listings(spark, sf_dir).withColumns({"location_raw": F.lit(None).cast("string"), "address_text": F.lit("")})
    return df.select("id", F.concat_ws(",", listing.quality_flags()).alias("flags"))


_MORE_FLAGS = [
    ("price <= 0", "invalid_price"), ("land_area_m2 <= 0", "invalid_land_area"), ("construction_area_m2 <= 0", "invalid_construction_area"), ("land_area_m2 > 100000", "suspicious_land_area"), ("construction_area_m2 > 5000", "suspicious_construction_area"),
    ("bedrooms > 20", "suspicious_bedrooms"), ("bathrooms > 20", "suspicious_bathrooms"), ("price > 0 AND construction_area_m2 > 0 AND (price / construction_area_m2 < 999.995 OR price / construction_area_m2 >= 200000.005)", "suspicious_price_per_construction_m2"),
    ("property_type = 'terreno' AND price > 0 AND land_area_m2 > 0 AND (price / land_area_m2 < 99.995 OR price / land_area_m2 >= 100000.005)", "suspicious_price_per_land_m2"), ("id % 3 = 0", "missing_location"), ("id % 6 = 0", "invalid_price"),
]


@query(f"{_BASE} SELECT id, array_to_string(list_sort(list_distinct([{', '.join(f'CASE WHEN {t} THEN {chr(39)}{n}{chr(39)} END' for t, n in _MORE_FLAGS)}])), ',') AS flags FROM l")
def enriched_flags(spark, sf_dir):
    told = F.when(F.col("id") % 6 == 0, '["missing_location", "invalid_price"]').when(F.col("id") % 3 == 0, '["missing_location"]').when(F.col("id") % 5 == 0, "no list")
    df = sample.listings(spark, sf_dir).withColumn("flags", text.flags(told))
    return df.select("id", F.concat_ws(",", listing.enriched_flags(F.col("flags"))).alias("flags"))


@query(f"{_BASE} SELECT id, lower(trim(municipality)) || '|' || coalesce(lower(trim(neighborhood)), '') || '|' || property_type || '|' || coalesce(printf('%.2f', price), '') || '|' || coalesce(printf('%.2f', construction_area_m2), '') || '|' || coalesce(printf('%.2f', land_area_m2), '') AS group_id FROM l")
def duplicate_group_ids(spark, sf_dir):
    return sample.listings(spark, sf_dir).select("id", listing.duplicate_group().alias("group_id"))


@query(f"{_BASE} SELECT id, CASE WHEN coalesce(inegi_cve_ageb, '') = '' OR NOT coalesce(price BETWEEN 1000000 AND 12000000, FALSE) THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM l")
def confidence_rule(spark, sf_dir):
    return sample.listings(spark, sf_dir).select("id", listing.confidence(F.col("price")).alias("confidence"))


@query(f"{_BASE} SELECT id, {_norm_sql('neighborhood')} AS k, nullif(regexp_replace(regexp_replace(translate(lower(neighborhood), 'áéíóúüñ', 'aeiouun'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug, CASE WHEN latitude IS NOT NULL THEN CAST(CAST(round(latitude * 1000000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(longitude * 1000000) AS BIGINT) AS VARCHAR) ELSE '' END AS place_key, latitude IS NOT NULL AND latitude BETWEEN 19.0 AND 19.7 AND longitude BETWEEN -99.4 AND -98.9 AS in_valley FROM l")
def place_keys(spark, sf_dir):
    la, lo = F.col("latitude"), F.col("longitude")
    return sample.listings(spark, sf_dir).select("id", text.match_key(F.col("neighborhood")).alias("k"), text.slug(F.col("neighborhood")).alias("slug"), geo.key(la, lo).alias("place_key"), geo.within("region_09", la, lo).alias("in_valley"))


_PRECISIONS = ["exact_address", "street", "postal_code", "neighborhood", "locality", "municipality", "state", "unknown"]


@query(f"""{_BASE}, g AS (SELECT id, ([{", ".join(f"'{x}'" for x in _PRECISIONS)}])[id % 8 + 1] AS precision, (id % 20) / 20.0 AS importance FROM l)
SELECT id, CASE WHEN precision IN ('exact_address', 'street') THEN 'high' WHEN precision IN ('postal_code', 'neighborhood') THEN 'medium' WHEN precision = 'locality' THEN 'low' ELSE 'unusable' END AS usability,
round(greatest(0.0, least(1.0, importance + CASE precision WHEN 'exact_address' THEN 0.35 WHEN 'street' THEN 0.25 WHEN 'postal_code' THEN 0.2 WHEN 'neighborhood' THEN 0.15 WHEN 'locality' THEN 0.05 WHEN 'municipality' THEN 0.0 WHEN 'state' THEN -0.1 ELSE -0.2 END)), 6) AS confidence FROM g""")
def geocode_rules(spark, sf_dir):
    df = sample.listings(spark, sf_dir).select("id", F.array(*map(F.lit, _PRECISIONS))[(F.col("id") % 8).cast("int")].alias("precision"), ((F.col("id") % 20) / 20.0).alias("importance"))
    return rounded(df.select("id", listing.geocode_usability(F.col("precision")).alias("usability"), listing.geocode_confidence(F.col("importance"), F.col("precision")).alias("confidence")), 6)


_KEY6 = "CAST(CAST(round(latitude * 1000000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(longitude * 1000000) AS BIGINT) AS VARCHAR)"
_N = listing.NOTES


@query(f"""{_BASE}, t AS (SELECT id, latitude, longitude, CAST(floor(latitude * 1000) AS BIGINT) AS y FROM l), b AS (SELECT id, latitude, longitude, y + d AS y FROM t, (VALUES (-1), (0), (1)) v(d)),
n AS (SELECT t.id, count(*) FILTER (b.id IS NOT NULL AND {_distance('t', 'b')} < 25) AS nearby FROM t LEFT JOIN b ON t.y = b.y GROUP BY 1), s AS (SELECT {_KEY6} AS k, count(*) AS shared FROM l WHERE latitude IS NOT NULL GROUP BY 1),
q AS (SELECT l.*, nearby, shared, l.id % 7 <> 0 AS known, l.id % 13 <> 0 AS state_ok, l.id % 12 <> 0 AS place_ok, street IS NOT NULL AND l.id % 2 = 0 AS street_ok, l.id % 10 = 0 AS code_ok, neighborhood IS NOT NULL AND l.id % 4 = 1 AS area_ok,
  coalesce(latitude BETWEEN 18.0 AND 19.2 AND longitude BETWEEN -99.6 AND -98.4, FALSE) AS inside FROM l JOIN n ON n.id = l.id LEFT JOIN s ON s.k = {_KEY6}),
r AS (SELECT *, concat_ws(', ', CASE WHEN street_ok THEN '{listing.EVIDENCE[0]}' END, CASE WHEN code_ok THEN '{listing.EVIDENCE[1]}' END, CASE WHEN area_ok THEN '{listing.EVIDENCE[2]}' END, '{listing.EVIDENCE[3]}') AS found,
  CASE WHEN NOT inside THEN 1 WHEN NOT known THEN CASE WHEN shared > 1 OR nearby > 1 THEN 2 ELSE 3 END WHEN NOT state_ok THEN 4 WHEN NOT place_ok THEN 5 WHEN (street_ok OR code_ok OR area_ok) AND shared = 1 AND nearby = 1 THEN 6 WHEN shared = 1 THEN 7 ELSE 8 END AS o FROM q)
SELECT id, CASE o WHEN 2 THEN 'unknown' WHEN 3 THEN 'unknown' WHEN 6 THEN 'consistent' WHEN 7 THEN 'partially_consistent' WHEN 8 THEN 'partially_consistent' ELSE 'inconsistent' END AS status,
CASE o WHEN 1 THEN '{_N["outside"]}' WHEN 2 THEN '{_N["crowded"]}' WHEN 3 THEN '{_N["alone"]}' WHEN 4 THEN '{_N["state"]}' WHEN 5 THEN '{_N["municipality"]}' WHEN 8 THEN '{_N["shared"]}' ELSE found END AS note,
CASE o WHEN 2 THEN 'low' WHEN 3 THEN 'medium' WHEN 6 THEN 'high' WHEN 7 THEN 'medium' WHEN 8 THEN 'low' ELSE 'unusable' END AS quality FROM r""")
def coordinate_audit(spark, sf_dir):
    c, at = F.col, geo.key(F.col("latitude"), F.col("longitude"))
    df = sample.listings(spark, sf_dir).withColumn("state", F.lit("Morelos"))
    shared = df.where("latitude is not null").groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("shared"))
    j = df.withColumn("at", at).join(shared, "at", "left").join(spatial.neighbours(df, "id", 25.0), "id")
    told = {"state": F.when(c("id") % 13 == 0, "Puebla").otherwise("Morelos"), "city": F.when(c("id") % 12 == 0, "Otra ciudad").otherwise(F.concat(F.lit("H. "), F.upper("municipality"))), "road": F.when(c("id") % 2 == 0, F.lit("Calle Larga")), "suburb": F.when(c("id") % 4 == 1, c("neighborhood"))}
    j = j.withColumn("address", F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]))
    ok = lambda parts, expected: places.confirms(c("address"), parts, expected)
    check = listing.coordinate_check(c("shared"), c("nearby"), c("id") % 7 != 0, ok(["state"], c("state")), ok(["city", "town"], c("municipality")), places.street_matches(c("address")["road"], F.regexp_replace("street", "Calle", "Calle Larga")), c("id") % 10 == 0, ok(["suburb"], c("neighborhood")))
    return j.select("id", check.alias("x")).select("id", "x.*")


@query("SELECT p_partkey AS id, '$' || format('{:,}', CAST(round(p_retailprice * 1000) AS BIGINT)) || ' MXN' AS price, p_brand || ', ' || p_type AS address FROM part")
def display_texts(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), listing.display_price(F.round(F.col("p_retailprice") * 1000), F.lit(None).cast("string")).alias("price"), listing.display_address("p_brand", "p_type").alias("address"))


@query()
def python_fingerprints(spark, sf_dir):
    c = F.col
    df = sample.listings(spark, sf_dir)
    return df.select("id", text.python_fingerprint(c("latitude"), c("longitude"), c("price"), c("land_area_m2"), c("construction_area_m2"), c("bedrooms"), c("bathrooms"), c("parking_spaces")).alias("fingerprint"))


# Resampling and models


@query()
def bootstrap_intervals(spark, sf_dir):
    return rounded(metrics.bootstrap(sample.predictions(spark, sf_dir)))


@query()
def cross_validated_model(spark, sf_dir):
    df = sample.listings(spark, sf_dir).where(listing.positive("price"))
    df = windows.group_folds(df, listing.duplicate_group())
    got = evaluation.cross_validate(df, "fold", 5, numeric=["construction_area_m2", "bathrooms"], categorical=["property_type", "neighborhood"], model="random_forest")
    return rounded(metrics.errors(got.withColumn("actual_price", F.col("price"))))

"""Grouped figures: error metrics, profiles, distributions, intervals and calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions import listing
from lindero.operators.quantiles import join_groups, quantiles, running_sums
from lindero.operators.stored import cut


def with_errors(df: DataFrame) -> DataFrame:
    """absolute_error, percentage_error (of at least 1), prediction_ratio, residual and price_band."""
    floor = F.greatest(F.col("actual_price"), F.lit(1.0))
    return df.withColumns({
        "residual": F.col("predicted_price") - F.col("actual_price"),
        "absolute_error": F.abs(F.col("predicted_price") - F.col("actual_price")),
        "percentage_error": F.abs(F.col("predicted_price") - F.col("actual_price")) / floor * 100,
        "prediction_ratio": F.col("predicted_price") / floor,
        "price_band": listing.price_band("actual_price"),
    })


def enriched(predictions: DataFrame, known: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Predictions with the errors and the fields of the listings that agree in all of the columns on, nulls with nulls."""
    return join_groups(with_errors(predictions), known.select(*on, *fields), *on)


#: The medians among the error metrics.
MEDIANS = {"median_ae": ("absolute_error", 0.5), "median_ape": ("percentage_error", 0.5), "bias_median": ("residual", 0.5), "median_prediction_ratio": ("prediction_ratio", 0.5)}


def mean_errors(df: DataFrame, *keys: str) -> DataFrame:
    """The error metrics that sums give, in one pass, of all rows together or by keys."""
    return _means(with_errors(df), *keys)


def _means(e: DataFrame, *keys: str) -> DataFrame:
    share = lambda p: (F.avg((F.col("percentage_error") <= p).cast("double")) * 100).alias(f"within_{p}_pct")
    # 1 - SSE / SST, with SST from the moments that one pass gives.
    r2 = F.lit(1.0) - F.try_divide(F.sum(F.col("residual") * F.col("residual")), F.var_pop("actual_price") * F.count(F.lit(1)))
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), r2.alias("r2"),
        F.avg("percentage_error").alias("mape"), share(10), share(20), share(30), F.avg("residual").alias("bias_mean"),
    )


def errors(df: DataFrame, *keys: str) -> DataFrame:
    """Error metrics of all rows together, or by keys: sums in one pass, and exact medians."""
    e = with_errors(df)
    names = ("n", "mae", "median_ae", "rmse", "r2", "mape", "median_ape", "within_10_pct", "within_20_pct", "within_30_pct", "bias_mean", "bias_median", "median_prediction_ratio")
    return join_groups(_means(e, *keys), quantiles(e, MEDIANS, *keys), *keys).select(*keys, *names)


def sample_quality(n: Column, poor: int = 10, fair: int = 20) -> Column:
    return F.when(n < poor, "insufficient").when(n < fair, "weak").otherwise("usable")


def fold_means(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Metrics by fold, then their means: not the metrics of all rows."""
    by = errors(df, fold)
    return by.agg(F.count_distinct(fold).alias("folds"), F.sum("n").alias("n"), *[F.avg(x).alias(x) for x in by.columns if x not in (fold, "n")])


def band_bias(df: DataFrame) -> DataFrame:
    ratio = F.col("median_prediction_ratio")
    return errors(df, "price_band").select("price_band", "n", "mape", "bias_mean", "median_prediction_ratio", F.when(ratio > 1.05, "over").when(ratio < 0.95, "under").otherwise("balanced").alias("direction"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's, over rows that have both; null for fewer than three."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r")).select("n", F.when(F.col("n") > 2, F.col("r")).alias("correlation"))


def profile(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, missing, moments and percentiles; the deviation of one value is 0."""
    x = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"),
        F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    points = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    q = quantiles(df, {n: (value, p) for n, p in points.items()}, *keys)
    return join_groups(stats, q, *keys).select(*keys, "count", "missing", "mean", "median", "std", "min", "max", "p05", "p25", "p75", "p95")


def band_distribution(df: DataFrame, price: str = "price") -> DataFrame:
    """All bands in order, empty ones too."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(listing.BANDS)], "band_index int, price_band string")
    counts = df.groupBy(listing.price_band(price).alias("price_band")).agg(F.count(F.lit(1)).alias("found")).where("price_band is not null")
    joined = F.broadcast(bands).join(counts, "price_band", "left").select("band_index", "price_band", F.coalesce("found", F.lit(0)).alias("n"))  # eight rows
    return joined.withColumn("percent", F.coalesce(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), F.lit(0.0)))


def fences(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Quartile fences of a value by keys, and how many rows lie outside."""
    x = F.col(value)
    have = df.where(x.isNotNull())
    q = quantiles(have, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}, *keys)
    edges = q.select(*keys, "median", F.expr("q1 - 1.5 * (q3 - q1)").alias("low"), F.expr("q3 + 1.5 * (q3 - q1)").alias("high"))
    return join_groups(have, edges, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("median").alias("median"), F.first("low").alias("low"), F.first("high").alias("high"), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("outliers"))


def missingness(df: DataFrame, fields: list[str], *scopes: str) -> DataFrame:
    """scope, value, field, missing, percent: over all rows and by each scope, in one grouping."""
    long = df.select(*scopes, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("gone")) for f in fields])).alias("x")).select(*scopes, "x.field", "x.gone")
    sets = [[F.col("field")], *[[F.col("field"), F.col(s)] for s in scopes]]
    out = long.groupingSets(sets, "field", *scopes).agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("missing"), *[F.grouping(s).alias(f"g_{s}") for s in scopes])
    scope = F.coalesce(*[F.when(F.col(f"g_{s}") == 0, s) for s in scopes], F.lit("global"))
    value = F.coalesce(*[F.when(F.col(f"g_{s}") == 0, F.coalesce(F.col(s).cast("string"), F.lit("missing"))) for s in scopes], F.lit("all"))
    return out.select(scope.alias("scope"), value.alias("value"), "field", "missing", (F.col("missing") * 100.0 / F.col("n")).alias("percent"))


#: The errors whose percentiles are reported.
ERRORS = {"absolute_percentage_error": "percentage_error", "absolute_error": "absolute_error", "residual": "residual"}


def error_percentiles(df: DataFrame, *scopes: str) -> DataFrame:
    """scope, value, metric, n and p50 to p95 of each error, over all rows and by each scope, from one copy of the rows for each scope."""
    e, points = with_errors(df), (0.5, 0.68, 0.8, 0.9, 0.95)
    scope = lambda name, value: F.struct(F.lit(name).alias("scope"), value.cast("string").alias("value"))
    all_ = F.array(scope("global", F.lit("all")), *[scope(s, F.col(s)) for s in scopes])
    spread = e.select(F.explode(all_).alias("__s"), *ERRORS.values()).select("__s.*", *ERRORS.values())
    names = lambda m: [f"{m}_{round(100 * p)}" for p in points]
    q = quantiles(spread, {n: (c, p) for m, c in ERRORS.items() for n, p in zip(names(m), points, strict=True)}, "scope", "value")
    rows = join_groups(spread.groupBy("scope", "value").agg(*[F.count(c).alias(f"{m}_n") for m, c in ERRORS.items()]), q, "scope", "value")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_n").alias("n"), *[F.col(n).alias(f"p{round(100 * p)}") for n, p in zip(names(m), points, strict=True)]) for m in ERRORS])
    return rows.select("scope", "value", F.explode(each).alias("x")).select("scope", "value", "x.*")


def calibration(df: DataFrame, bins: int = 6) -> DataFrame:
    """Actual and predicted means and medians by right-closed quantile bins of the prediction."""
    cuts = quantiles(df, {f"c{i}": ("predicted_price", i / bins) for i in range(1, bins)})
    cut = F.array(*[F.col(f"c{i}") for i in range(1, bins)])
    binned = join_groups(df, cuts.select(cut.alias("cuts"))).withColumn("bin", F.size(F.filter("cuts", lambda x: x < F.col("predicted_price")))).drop("cuts")
    means = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("actual_price").alias("actual_mean"), F.avg("predicted_price").alias("predicted_mean"), F.avg(F.col("predicted_price") - F.col("actual_price")).alias("bias"))
    return join_groups(means, quantiles(binned, {"actual_median": ("actual_price", 0.5), "predicted_median": ("predicted_price", 0.5)}, "bin"), "bin")


def intervals(history: DataFrame, df: DataFrame, key: str | None, least: int) -> DataFrame:
    """low and high at 80 and 90 percent, from the errors of the row's group, or of all where the group has fewer than least."""
    e = with_errors(history)
    q = lambda name: {f"{name}_80": ("percentage_error", 0.8), f"{name}_90": ("percentage_error", 0.9)}
    all_ = quantiles(e, q("__all"))
    own = []
    if key is not None:
        have = e.groupBy(key).agg(F.count(F.lit(1)).alias("__have"))
        own = [join_groups(have, quantiles(e, q("__own"), key), key).where(F.col("__have") >= least).drop("__have")]
        df = df if key in df.columns else with_errors(df)
    joined = join_groups(join_groups(df, own[0], key) if own else df, all_)
    p = lambda level: F.coalesce(*[F.col(f"__own_{level}")] * len(own), F.col(f"__all_{level}"))
    at = {f"{side}_{level}": F.col("predicted_price") * (1 + sign * p(level) / 100) for level in (80, 90) for side, sign in (("low", -1), ("high", 1))}
    return joined.withColumns(at).drop("__own_80", "__own_90", "__all_80", "__all_90")


def interval_methods(history: DataFrame, df: DataFrame) -> DataFrame:
    """method, coverage and width of the intervals from the errors of all rows, of the price band (10 at least) and of the property type (20 at least)."""
    methods = {"global_pct": (None, 0), "price_band_pct": ("price_band", 10), "property_type_pct": ("property_type", 20)}
    return reduce(DataFrame.unionByName, [coverage(intervals(history, df, key, least)).select(F.lit(m).alias("method"), "*") for m, (key, least) in methods.items()])


def coverage(df: DataFrame, *keys: str) -> DataFrame:
    inside = lambda n: (F.avg(F.col("actual_price").between(F.col(f"low_{n}"), F.col(f"high_{n}")).cast("double")) * 100).alias(f"coverage_{n}")
    wide = df.withColumn("__width", F.col("high_90") - F.col("low_90"))
    means = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), inside(80), inside(90), F.avg("__width").alias("mean_width"))
    return join_groups(means, quantiles(wide, {"median_width": ("__width", 0.5)}, *keys), *keys)


def weighted_quantiles(df: DataFrame, value: str, weight: str, points: dict[str, float], *keys: str, small: bool = False) -> DataFrame:
    """The smallest value at which the weights so far reach the share; rows without a finite value or a positive weight don't count.

    small: no group has more values than a task can sort.
    """
    v, w = F.col(value), F.col(weight)
    ok = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & ~F.isnan(w) & (w > 0) & (w != float("inf")))
    # Equal values are one step, so that they are summed before the window runs over them.
    steps = ok.groupBy(*keys, value).agg(F.sum(w).alias("w"))
    if small:
        by = Window.partitionBy(*keys)
        run = steps.withColumns({"so_far": F.sum("w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(by)})
    else:
        run = running_sums(steps, list(keys), value, "w")
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("so_far") >= q * F.col("all"), v)).alias(n) for n, q in points.items()])


def outliers(df: DataFrame, error_flags: list[str]) -> DataFrame:
    """The first kind that applies: flagged data, a price beyond p05 or p95, an error beyond p95."""
    e = with_errors(df)
    cuts = quantiles(e, {"__low": ("actual_price", 0.05), "__high": ("actual_price", 0.95), "__error": ("percentage_error", 0.95)})
    kind = (
        F.when(F.coalesce(F.arrays_overlap("flags", F.array(*map(F.lit, error_flags))), F.lit(False)), "probably_wrong")
        .when((F.col("actual_price") >= F.col("__high")) | (F.col("actual_price") <= F.col("__low")), "extreme_price")
        .when(F.col("percentage_error") >= F.col("__error"), "extreme_error")
    )
    return join_groups(e, cuts).withColumn("outlier_type", kind).where("outlier_type is not null").drop("__low", "__high", "__error")


def resampled(df: DataFrame, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """replicate, draws and, for each column, the sum over a resample of all rows, of which each replicate draws exactly as many as there are.

    The draws are split over the parts, and in a part over its batches, by binomial draws of what is left, which makes them
    those of a multinomial; in a batch each draw picks a row. A part's numbers come from its own seed, so a task that runs
    again draws alike, and only the parts' sizes go through the driver. A task gives out a row for each replicate.
    """
    kept = cut(df.select(*[F.col(c).cast("double").alias(c) for c in columns])).withColumn("part", F.spark_partition_id())
    sizes = {r.part: r.n for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers a part
    names = ["replicate", "draws", *columns]

    def share(part: int) -> np.ndarray:
        """The draws of a part, by splits of the parts in halves from all of them down to it."""
        parts = sorted(sizes)
        draws, low, high = np.full(replicates, sum(sizes.values()), np.int64), 0, len(parts)
        while high - low > 1:
            middle = (low + high) // 2
            left, right = (sum(sizes[p] for p in parts[a:b]) for a, b in ((low, middle), (middle, high)))
            first = np.random.default_rng([seed, 0, low, high]).binomial(draws, left / (left + right))
            if parts.index(part) < middle:
                draws, high = first, middle
            else:
                draws, low = draws - first, middle
        return draws

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                part = batch.column(len(columns))[0].as_py()
                left, rows, rng = share(part), sizes[part], np.random.default_rng([seed, 1, part])
                sums = np.zeros((replicates, len(columns)))
                drawn = left.copy()
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))], 1)
            taken = rng.binomial(left, min(1.0, len(values) / rows))
            left, rows = left - taken, rows - len(values)
            for r in np.flatnonzero(taken).tolist():
                sums[r] += np.bincount(rng.integers(0, len(values), taken[r]), minlength=len(values)) @ values
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1)), pa.array(drawn), *[pa.array(sums[:, i]) for i in range(len(columns))]], names=names)

    out = kept.mapInArrow(run, ", ".join(["replicate long", "draws long", *[f"`{c}` double" for c in columns]]))
    return out.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names[1:]])


def bootstrap(df: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """metric, mean, low and high: percentile intervals of mean errors and shares over resamples of as many rows."""
    e = with_errors(df)
    share = lambda n: (F.col("percentage_error") <= n).cast("double") * 100
    figures = {"mae": F.col("absolute_error"), "mape": F.col("percentage_error"), "within_20_pct": share(20), "within_30_pct": share(30)}
    each = resampled(e.select(*[v.alias(m) for m, v in figures.items()]), list(figures), replicates, seed)
    long = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) / F.col("draws")).alias("v")) for m in figures])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))  # over the replicates
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), q.alias("q")).select("metric", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))

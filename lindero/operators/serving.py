"""What a site reads: dashboards, covers, related items, results of valuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.listing import no
from lindero.operators.scopes import published
from lindero.operators.windows import first_of


def dashboard(df: DataFrame) -> DataFrame:
    """Counts in one pass. The total includes deleted listings; the others don't."""
    live = F.col("deleted_at").isNull()
    count = lambda test: F.count_if(live & no(test))
    return df.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "published").alias("published"), count(F.col("status") == "draft").alias("draft"),
        count(F.col("status") == "archived").alias("archived"), count(F.col("is_featured")).alias("featured"), count(F.col("property_type") == "casa").alias("houses"),
        count(F.col("property_type") == "departamento").alias("apartments"), count(F.col("property_type") == "terreno").alias("land"), F.count_if(~live).alias("deleted"),
    )


def covers(properties: DataFrame, images: DataFrame) -> DataFrame:
    """Each property with its cover: the one marked so, else the first by position."""
    best = first_of(images, ["property_id"], [F.desc("is_cover"), "position", "image_id"]).select(F.col("property_id").alias("id"), "image_id")
    return properties.select("id").join(best, "id", "left")


def with_nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with the list of their children, in order; an empty list where there is none."""
    lists = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many to many."""
    return left.join(bridge, left_key).join(right, right_key)


def related(df: DataFrame, item: DataFrame, n: int = 3) -> DataFrame:
    """Published listings of the item's type and place, the newest, the item itself excepted."""
    i = F.broadcast(item.limit(1).select(F.col("id").alias("__id"), F.col("property_type").alias("__type"), F.col("municipality").alias("__place")))  # one row
    same = (F.col("property_type") == F.col("__type")) & (F.col("municipality") == F.col("__place")) & (F.col("id") != F.col("__id"))
    return published(df).join(i, same).drop("__id", "__type", "__place").orderBy(F.desc("published_at"), "id").limit(n)


def suggestions(places: DataFrame, word: str, state: str | None = None, municipality: str | None = None, n: int = 15) -> DataFrame:
    from lindero.functions.text import fold
    from lindero.operators.scopes import where_given

    return where_given(places, state=state, municipality=municipality).where(fold(F.col("settlement")).contains(fold(F.lit(word)))).orderBy("settlement", "postal_code").limit(n)


def latest_valid(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each valuation that succeeded with a value."""
    ok = predictions.where("status = 'completed' and estimated_value > 0")
    return first_of(ok, ["valuation_id"], [F.desc("created_at"), F.desc("prediction_id")])


def resolve(valuations: DataFrame, predictions: DataFrame, use_new: Column) -> DataFrame:
    """valuation_id, origin, value, reason: land is unavailable; else the new model's result where it is on and valid; else the old one's; else none."""
    p = latest_valid(predictions).select("valuation_id", F.col("estimated_value").alias("__new"))
    joined = valuations.join(p, "valuation_id", "left")
    new = F.when(use_new, F.col("__new"))
    old = F.when(F.col("legacy_value") > 0, F.col("legacy_value"))
    land = F.col("property_type") == "terreno"
    origin = F.when(land, "unavailable").when(new.isNotNull(), "v2").when(old.isNotNull(), "legacy").otherwise("unavailable")
    reason = F.when(land, "unsupported_property_type").when(new.isNull() & old.isNull(), "no_valid_result")
    return joined.select("valuation_id", origin.alias("origin"), F.when(~land, F.coalesce(new, old)).alias("value"), reason.alias("reason"))


def model_differences(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Each valuation's values by model, and the difference of the second from the first, absolute and in percent."""
    wide = predictions.groupBy("valuation_id").pivot("model", models).agg(F.max("estimated_value"))
    a, b = F.col(models[0]), F.col(models[1])
    return wide.withColumns({"difference": b - a, "difference_percent": F.try_divide(b - a, a) * 100})


def best_place(df: DataFrame, key: str) -> DataFrame:
    """The candidate with the highest score for each key; the earlier one of equals."""
    return df.groupBy(key).agg(F.max_by("place", F.struct("score", -F.col("ordinal"))).alias("place"), F.max("score").alias("score"))


def place_score(country: Column, state: Column, municipality: Column, settlement: Column, exact: Column) -> Column:
    """Points of what a geocoder's place confirms."""
    points = lambda test, n: F.when(no(test), n).otherwise(0)
    return points(country, 30) + points(state, 30) + points(municipality, 30) + points(settlement, 25) + F.when(no(exact), 10).otherwise(5)

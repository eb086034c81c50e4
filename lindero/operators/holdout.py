"""Selection of an outside test set: candidates in order of priority, less those known before and inner duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.functions.listing import no, positive

#: Municipalities and bands that go first, and the source that goes last.
FIRST, SECOND = ["Cuernavaca", "Yautepec", "Temixco", "Emiliano Zapata"], ["Jiutepec", "Xochitepec", "Cuautla", "Atlatlahucan"]
LAST_SOURCE = "mercadolibre"
FIRST_BANDS = ["<1M", "1M-2M", "2M-3M", "12M-20M", ">20M"]


def is_candidate() -> Column:
    given = lambda n: F.col(n).isNotNull()
    return (
        no(F.col("market_segment") == "residential") & no(F.col("property_type").isin("casa", "departamento")) & no(F.col("training_readiness").isin("A", "B", "C"))
        & no(F.col("currency") == "MXN") & positive("price") & no(F.col("coordinate_quality").isin("high", "medium"))
        & no(F.col("inegi_cve_ageb") != "") & given("population_density") & given("establishments_1km")
    )


def priority(first: list[str] = FIRST, second: list[str] = SECOND, last_source: str = LAST_SOURCE) -> list[Column]:
    place = F.when(no(F.col("municipality").isin(first)), 0).when(no(F.col("municipality").isin(second)), 1).otherwise(2)
    band = F.when(no(F.col("price_band").isin(FIRST_BANDS)), 0).otherwise(1)
    return [place, band, no(F.col("property_type") != "departamento"), no(F.col("source") == last_source), F.coalesce("source_id", F.lit("")), F.col("id")]


def select(rows: DataFrame, known: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(selected, excluded with reason). Rows after the limit-th selected one are in neither.

    The running count of selected rows is found by their rank among those that could be: rows
    ordered beyond the limit-th of them are never looked at, so one ordered cut stands for the loop.
    """
    by = lambda k, name: known.select(*k).where(" and ".join(f"{x} is not null" for x in k)).distinct().withColumn(name, F.lit(True))
    marked = rows.join(by(["source", "source_id"], "__id"), ["source", "source_id"], "left").join(by(["url"], "__url"), "url", "left").join(by(["dedupe_fingerprint"], "__print"), "dedupe_fingerprint", "left")
    reason = F.when(F.col("__id"), "historical_source_id").when(F.col("__url"), "historical_url").when(F.col("__print"), "historical_fingerprint")
    marked = marked.withColumn("__old", reason).withColumn("__key", F.coalesce(F.nullif("dedupe_fingerprint", F.lit("")), F.concat_ws("|", "source", "source_id")))
    order_ = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    ranked = marked.select("*", *order_)
    names = [f"__o{i}" for i in range(len(order))]
    again = F.row_number().over(Window.partitionBy("__key", F.col("__old").isNull()).orderBy(*names)) > 1
    ranked = ranked.withColumn("reason", F.coalesce("__old", F.when(again, "holdout_internal_duplicate"))).drop("__id", "__url", "__print", "__old", "__key")
    chosen = ranked.where("reason is null").orderBy(*names).limit(limit)
    # The place of the last one chosen, as one row; nothing after it was reached if the limit was.
    last = chosen.agg(F.max(F.struct(*names)).alias("__last"), F.count(F.lit(1)).alias("__n"))
    excluded = ranked.where("reason is not null").crossJoin(F.broadcast(last)).where((F.col("__n") < limit) | (F.struct(*names) < F.col("__last")))  # one row
    return chosen.drop("reason", *names), excluded.drop("__last", "__n", *names)

"""Filters, pages and orders of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.functions.listing import no

#: Orders of the catalog. The id decides between equals.
SORTS = {
    "price_asc": ["price", "id"],
    "price_desc": [F.desc, "price", "id"],
    "newest": [F.desc, "published_at", "id"],
    "featured": [F.desc, "is_featured", "published_at", "id"],
}


def visible(df: DataFrame, with_deleted: bool = False) -> DataFrame:
    return df if with_deleted else df.where("deleted_at is null")


def published(df: DataFrame) -> DataFrame:
    return visible(df).where("status = 'published' and published_at is not null")


def featured(df: DataFrame) -> DataFrame:
    return df.where("is_featured")


def offered(df: DataFrame, operation: str) -> DataFrame:
    """Listings for sale or for rent."""
    return df.where(F.col("operation") == operation)


def to_geocode(df: DataFrame, source: str | None = None, municipality: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with any text that a geocoder can use, by id."""
    some = df.where(F.coalesce("address_text", "neighborhood", "municipality", "state").isNotNull())
    ordered = where_given(some, source=source, municipality=municipality).orderBy("id")
    return ordered.limit(limit) if limit else ordered


def stored(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by their last change, the newest first; the id decides between equals."""
    ordered = df.orderBy(F.desc_nulls_last("updated_at"), "id")
    return ordered.limit(limit) if limit else ordered


def census_blocks(df: DataFrame, entity: str | None = None) -> DataFrame:
    """The rows of a census that stand for a whole area: block code 000, and area code not 0000 where one entity is asked for."""
    whole = df.where("MZA = '000'")
    return whole.where((F.col("ENTIDAD") == entity) & (F.col("AGEB") != "0000")) if entity else whole


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality on each column whose value is given."""
    for name, value in equal.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def where_range(df: DataFrame, **bounds) -> DataFrame:
    """name=(low, high); either may be None."""
    for name, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    return df


def keyword(df: DataFrame, word: str | None, *columns: str) -> DataFrame:
    """Any of the columns has the word; case and accents don't matter."""
    if not word:
        return df
    hits = [F.collate(F.col(x), "UNICODE_CI_AI").contains(F.collate(F.lit(word), "UNICODE_CI_AI")) for x in columns]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return df.where(found)


def order(df: DataFrame, sort: str) -> DataFrame:
    how = SORTS.get(sort, SORTS["newest"])
    down = how[0] is F.desc
    return df.orderBy(*[F.desc_nulls_last(x) if down and x != "id" else F.asc_nulls_first(x) for x in (how[1:] if down else how)])


def page(df: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """One page (from 1) with the total of the whole list beside each row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return order(df, sort).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values that aren't blank, by column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("facet"), F.col(x).cast("string").alias("value")) for x in columns])).alias("x"))
    return long.select("x.*").where("trim(value) <> ''").distinct()


def flagged(flags: Column, names: list[str]) -> Column:
    """The flags (texts joined by commas) share one with the names."""
    return no(F.arrays_overlap(F.split(flags, ","), F.array(*map(F.lit, names))))

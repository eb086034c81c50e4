"""Snapshots that take in new rows by key. Each returns the next snapshot; the old one stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.operators.windows import first_of


def upsert(old: DataFrame, new: DataFrame, keys: list[str], recency: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The latest row of each key; columns of keep_first stay what they were at first. Null key parts equal each other."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = first_of(both, keys, [F.desc("__new"), F.desc(recency)]).drop("__new")
    if not keep_first:
        return latest
    first = both.groupBy(*keys).agg(*[F.min(c).alias(f"__{c}") for c in keep_first])
    joined = latest.alias("l").join(first.alias("f"), [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left").select("l.*", *[f"f.__{c}" for c in keep_first])
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in keep_first}).drop(*[f"__{c}" for c in keep_first])


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str], valid: Column, changed: list[str], broken: Column | None = None) -> DataFrame:
    """One row: created, updated, unchanged, skipped (not valid) and errors (broken rows, which count as nothing else)."""
    marked = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__old"))
    bad = F.coalesce(broken, F.lit(False)) if broken is not None else F.lit(False)
    joined = new.withColumns({"__bad": bad, "__valid": F.coalesce(valid, F.lit(False)) & ~bad}).join(marked, keys, "left")
    same = F.lit(True)
    for c in changed:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    known = F.coalesce("__old", F.lit(False))
    return joined.agg(
        F.count_if(F.col("__valid") & ~known).alias("created"), F.count_if(F.col("__valid") & known & ~same).alias("updated"),
        F.count_if(F.col("__valid") & known & same).alias("unchanged"), F.count_if(~F.col("__valid") & ~F.col("__bad")).alias("skipped"),
        F.count_if("__bad").alias("errors"),
    )


def update_rows(old: DataFrame, changes: DataFrame, key: str, fields: list[str], recency: str) -> DataFrame:
    """The next snapshot: each row with the fields of its newest change, which may be null; rows without a change stay, changes of unknown rows are nothing."""
    newest = first_of(changes.where(F.col(key).isNotNull()), [key], [F.desc(recency)])
    marked = newest.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__changed"))
    joined = old.join(marked, key, "left")
    return joined.withColumns({f: F.when(F.col("__changed"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).select(*old.columns)


def unseen(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the old snapshot lacks."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def with_hash(df: DataFrame, content: str) -> DataFrame:
    """content_hash, the SHA-256 of a raw page."""
    return df.withColumn("content_hash", F.sha2(F.col(content), 256))


def fresh_or_stale(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, key: str, now: Column, ttl_seconds: int) -> DataFrame:
    """value and origin by key: a cached value within its time, else a fetched one, else the stale one."""
    c = cache.select(key, F.col("value").alias("__cached"), (now - F.col("stored_at") <= ttl_seconds).alias("__fresh"))
    joined = wanted.select(key).distinct().join(c, key, "left").join(fetched.select(key, F.col("value").alias("__fetched")), key, "left")
    fresh = F.when(F.col("__fresh"), F.col("__cached"))
    origin = F.when(fresh.isNotNull(), "cache").when(F.col("__fetched").isNotNull(), "fetched").when(F.col("__cached").isNotNull(), "stale")
    return joined.select(key, F.coalesce(fresh, F.col("__fetched"), F.col("__cached")).alias("value"), origin.alias("origin"))


def first_or_create(known: DataFrame, asked: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """The known rows as they are, and a row with the defaults for each key asked for that they lack; a null key asks for none."""
    new = asked.select(*keys).na.drop(subset=keys).distinct().join(known.select(*keys), keys, "left_anti")
    return known.unionByName(new.withColumns({n: F.lit(v) for n, v in defaults.items()}), allowMissingColumns=True)

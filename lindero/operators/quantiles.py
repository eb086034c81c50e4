"""Exact quantiles and ranks of large groups, without a task that holds or sorts a whole group.

A bounded sketch of each group brackets a quantile; only values within the bracket are kept apart, and what lies
below is just counted. A group of at most twice ACCURACY values needs no bracket, and SMALL rows in all need no sketch. Ranks come from buckets of a group's values:
the buckets' sizes are summed up first, and rows are ordered within their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.operators.stored import cut

#: Rows that are told apart whole, and the accuracy of the sketch that brackets the quantiles of more.
SMALL, ACCURACY = 1_000_000, 10_000
#: Groups whose brackets go to all tasks, so that rows of a large one aren't shuffled to one task; more are small ones.
GROUPS = 10_000
#: Buckets of a group for ranks.
BUCKETS = 256

_LEAST, _MOST = float("-inf"), float("inf")


def join_groups(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left with the columns of right's row for its group; null keys are a group. Without keys right is a single row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    names = [f"__group{i}" for i in range(len(keys))]
    renamed = right.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & left[k].eqNullSafe(renamed[n])
    return left.join(renamed, on, "left").drop(*names)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], *keys: str) -> DataFrame:
    """keys and, for each name in wanted (column, point), the exact quantile of the column's values, between neighbours in proportion.

    Nulls don't count; a group without values has null or no row.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    points = {c: sorted({p for d, p in wanted.values() if d == c}) for c in columns}
    if df.count() <= SMALL:  # no group is larger, so each fits a task
        found = df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, points[c]))).alias(f"__q{i}") for i, c in enumerate(columns)])
        return found.select(*keys, *[F.col(f"__q{columns.index(c)}")[points[c].index(p)].alias(name) for name, (c, p) in wanted.items()])
    src = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    slack = 2 / ACCURACY
    aggregates = []
    for i, c in enumerate(columns):
        about = [min(1.0, max(0.0, p + d)) for p in points[c] for d in (-slack, slack)]
        aggregates += [F.count(f"__x{i}").alias(f"__n{i}"), F.percentile_approx(f"__x{i}", about, ACCURACY).alias(f"__s{i}")]
    sketch = src.groupBy(*keys).agg(*aggregates)
    few = 2 * ACCURACY  # from here on the sketch's error is at least two ranks, and the bracket holds both neighbours
    for i, c in enumerate(columns):
        bracket = lambda at, low, high: F.struct(F.lit(at).alias("at"), low.alias("low"), high.alias("high"))
        s = F.col(f"__s{i}")
        narrow = [bracket(1000 * i + 1 + j, s[2 * j] if p - slack > 0 else F.lit(_LEAST), s[2 * j + 1] if p + slack < 1 else F.lit(_MOST)) for j, p in enumerate(points[c])]
        sketch = sketch.withColumn(f"__b{i}", F.when(F.col(f"__n{i}") > few, F.array(*narrow)).otherwise(F.array(bracket(1000 * i, F.lit(_LEAST), F.lit(_MOST)))))
    sketch = cut(sketch)
    joined = join_groups(src, F.broadcast(sketch) if keys and sketch.count() <= GROUPS else sketch, *keys)  # so many groups at most
    # What lies below a bracket becomes one value, which adds up before the shuffle.
    def held(i: int) -> Column:
        x, n = F.col(f"__x{i}"), F.col(f"__n{i}")
        inside = F.filter(F.col(f"__b{i}"), lambda b: x <= b["high"])
        return F.transform(inside, lambda b: F.struct(b["at"].alias("at"), n.alias("n"), F.when(x >= b["low"], x).otherwise(_LEAST).alias("x")))

    counts = joined.select(*keys, F.explode(F.concat(*[held(i) for i in range(len(columns))])).alias("__h")).select(*keys, "__h.*").groupBy(*keys, "at", "n", "x").agg(F.count(F.lit(1)).alias("count"))
    # A bracket of a very large group still holds many values, so these are summed up by buckets.
    run = running_sums(cut(counts), [*keys, "at"], "x", "count").withColumnRenamed("so_far", "upto")
    picks = []
    for name, (c, p) in wanted.items():
        i, j = columns.index(c), points[c].index(p)
        mine = F.col("at").isin(1000 * i, 1000 * i + 1 + j)
        rank = p * (F.col("n") - 1)
        at = lambda r: F.min(F.when(mine & (F.col("upto") >= r + 1), F.col("x")))  # noqa: E731, B023
        low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(F.when(mine, rank - F.floor(rank)))
        picks.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(name))
    return run.groupBy(*keys).agg(*picks)


def _bucketed(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """df with __number and __bucket, which rises with it within a group."""
    numbered = df.withColumn("__number", number.cast("double"))
    edges = numbered.groupBy(*keys).agg(F.percentile_approx("__number", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("__edges"))
    return join_groups(numbered, edges, *keys).withColumn("__bucket", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col("__number"))), F.lit(-1))).drop("__edges")


def running_sums(df: DataFrame, keys: list[str], number: str, weight: str) -> DataFrame:
    """df with so_far, the sum of weight over rows of the group up to this one by number, and all, the group's sum. Numbers of a group must differ."""
    held = _bucketed(df, keys, F.col(number))
    sizes = held.groupBy(*keys, "__bucket").agg(F.sum(weight).alias("__w"))
    by = Window.partitionBy(*keys)
    before = sizes.withColumns({"__before": F.coalesce(F.sum("__w").over(by.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "all": F.sum("__w").over(by)}).drop("__w")
    within = F.sum(weight).over(Window.partitionBy(*keys, "__bucket").orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    return join_groups(held, before, *keys, "__bucket").withColumn("so_far", F.col("__before") + within).drop("__number", "__bucket", "__before")


def ranked(df: DataFrame, keys: list[str], number: Column, *ties: str) -> DataFrame:
    """df with __rank (from 1, by number and then ties; rows without a number first) and __n, the group's rows."""
    held = _bucketed(df, keys, number)
    sizes = held.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__w"))
    by = Window.partitionBy(*keys)
    before = sizes.withColumns({"__before": F.coalesce(F.sum("__w").over(by.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__w").over(by)}).drop("__w")
    within = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("__number", *ties))
    return join_groups(held, before, *keys, "__bucket").withColumn("__rank", F.col("__before") + within).drop("__number", "__bucket", "__before")

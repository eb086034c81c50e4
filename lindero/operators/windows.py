"""Picks and orders within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lindero.operators.quantiles import ranked


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    return top_of(df, keys, order, 1)


def top_of(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def middle_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at place n // 2 of each sorted group; the first column of the order is a number."""
    return ranked(df, keys, F.col(order[0]), *order[1:]).where("__rank = floor(__n / 2) + 1").drop("__rank", "__n")


def interleave(df: DataFrame, group: str, order: list[str], key: str, limit: int) -> DataFrame:
    """One row of each group in turn, by a number and ties; the first of rows with one key counts; cut to limit."""
    turn = ranked(df, [group], F.col(order[0]), *order[1:]).withColumnRenamed("__rank", "turn").drop("__n")
    return first_of(turn, [key], ["turn", group]).orderBy("turn", group).limit(limit)


def numbered_slugs(df: DataFrame, slug: str, number: str, *ties: str) -> DataFrame:
    """slug, slug-2, slug-3 and so on for rows that would share one, in the order of a number and ties; no task orders all rows of a slug."""
    turn = F.col("__rank")
    return ranked(df, [slug], F.col(number), *ties).withColumn("unique_slug", F.when(turn == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, turn))).drop("__rank", "__n")


def duplicate_summary(df: DataFrame, group: str) -> DataFrame:
    """One row: groups of several rows, the rows in them, and the rows that go when one of each group stays."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.agg(F.count_if(several).alias("groups_with_duplicates"), zero(F.sum(F.when(several, F.col("n")))).alias("records_in_duplicate_groups"), zero(F.sum(F.col("n") - 1)).alias("records_removed"))


def duplicate_examples(df: DataFrame, group: str, fields: list[str], most: int = 20) -> DataFrame:
    """All rows, with the fields that there are, of the first groups (by name) of several rows, and how many each group has."""
    several = df.groupBy(group).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1).where(F.col(group).isNotNull())
    first = several.orderBy(group).limit(most)
    return df.join(F.broadcast(first), group).select(group, "count", *[f for f in fields if f in df.columns])  # so many rows at most


def deal_out(sizes: list[tuple[int, int]], folds: int) -> dict[int, list[tuple[int, list[int]]]]:
    """For groups of each size (size, how many), by size, the folds that they go to in turn: (from this group on, these folds again and again).

    Larger groups come first, and each goes to the fold with the fewest rows, the first of equals. Groups of one size are dealt in
    one go: folds with the fewest rows take turns until the next one is no longer ahead of them.
    """
    loads, out = [0] * folds, {}
    for size, many in sorted(sizes, reverse=True):
        runs, done = [], 0
        while done < many:
            order = sorted(range(folds), key=lambda f: (loads[f], f))
            # The folds that one more group of this size each does not bring past the others take a turn.
            first = loads[order[0]]
            turn = [f for f in order if (loads[f], f) < (first + size, order[0])]
            ahead = [loads[f] for f in order if f not in turn]
            times = max(1, min((many - done) // len(turn), (min(ahead) - first) // size if ahead else many))
            if (many - done) < len(turn):
                turn, times = turn[: many - done], 1
            runs.append((done, turn))
            for f in turn:
                loads[f] += size * times
            done += len(turn) * times
        out[size] = runs
    return out


def group_folds(df: DataFrame, group: Column, folds: int = 5) -> DataFrame:
    """A fold for each row: whole groups stay together, and folds are as even as dealing the largest groups first makes them.

    Groups of one size come in the order of a hash. Only the sizes that occur, with how many groups have each, go
    through the driver; of n rows there are at most 1.5 times the root of n.
    """
    key = F.coalesce(group.cast("string"), F.lit(""))
    keyed = df.withColumns({"__null": group.isNull(), "__group": key})
    groups = keyed.groupBy("__null", "__group").agg(F.count(F.lit(1)).alias("__size"))
    hashed = F.conv(F.substring(F.md5(F.col("__group").cast("binary")), 1, 12), 16, 10).cast("long")
    placed = ranked(groups, ["__size"], hashed, "__group", "__null").withColumn("__rank", F.col("__rank") - 1)
    runs = deal_out([(r["__size"], r["many"]) for r in groups.groupBy("__size").agg(F.count(F.lit(1)).alias("many")).collect()], folds)
    rows = [(size, at, turn) for size, list_ in runs.items() for at, turn in list_]
    table = df.sparkSession.createDataFrame(rows, "__size long, at long, turn array<int>").groupBy("__size").agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("__runs"))
    mine = F.element_at(F.filter("__runs", lambda r: r["at"] <= F.col("__rank")), -1)
    of = placed.join(table, "__size").select("__null", "__group", mine["turn"][((F.col("__rank") - mine["at"]) % F.size(mine["turn"])).cast("int")].alias("fold"))
    return keyed.join(of, ["__null", "__group"]).drop("__null", "__group")


def worst(df: DataFrame, columns: list[str], each: int, most: int, key: str) -> DataFrame:
    """The union of the rows that are highest by each column, once each, cut to most."""
    tops = [df.orderBy(F.desc(x), key).limit(each) for x in columns]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates([key]).orderBy(F.desc(columns[0]), key).limit(most)


def exact_sample(df: DataFrame, strata: list[str], n: Column, key: str, seed: int) -> DataFrame:
    """Exactly n rows of each stratum (all, if fewer), by a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    # The order's first 48 bits as a number, which has the same order.
    dealt = ranked(df.withColumn("__order", order), strata, F.conv(F.substring("__order", 1, 12), 16, 10).cast("long"), "__order", key)
    return dealt.where(F.col("__rank") <= n).drop("__rank", "__n", "__order")

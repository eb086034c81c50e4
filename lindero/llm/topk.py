"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's components are dealt into groups, each of which scores a candidate by its part of the
product. The candidates are laid out once, by levels of which each has 64 times the rows of those
before, and stay where they are; queries go to them in tiles of bounded size.

Phase 1 gathers local score lists over the first level, a small share of all: each group's best k
candidates for a query, by their part. The k-th best of the exact scores so found, with its id, is a
safe cutoff, for at least k candidates reach it. Phase 2 sends the cutoffs out with the queries. A
candidate that reaches one overall must reach an even share of it in some group, so the tasks of the
next level collect those entries, less those that bounds on the other groups exclude. Phase 3 resolves
them: their parts are summed, and what doesn't reach the cutoff, ids included, is dropped. The level's
best lists give the cutoffs of the next. So each product is computed once, and since about 64 k entries
reach a cutoff however many candidates a level has, what is shuffled grows with the number of queries.

Nulls and edge cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different lengths are not compared; of equal scores the
smaller id comes first; rows that share an id are candidates each for itself, also for the queries
with that id, which leave out one row only, their own; query rows with one id and different vectors are
queries each for itself, told apart by query_key, and those with the same vector are one; a query that
has fewer candidates than k gets all; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_since, tables_so_far, written_table

#: Rows of the first level, about, and how many times the rows of those before a level has.
FIRST_ROWS, STEP = 1024, 64
#: Bytes of the query vectors that are sent to all tasks at a time; another tile follows when they are done.
TILE_BYTES = 16_000_000
#: Candidates that a task holds at once, and queries whose parts are in memory at a time.
BATCH, _QUERIES = 4096, 64
GROUPS = 4


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024, asked: F.Column | None = None) -> DataFrame:
    """id and v, the components' floor(scale * x) as longs, and asked, of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked") if asked is not None else F.lit(True).alias("asked")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(queries: np.ndarray, candidates: np.ndarray, shares: list[slice]):
    """A function from a range of queries to the parts of their products, groups by queries by candidates; by floats where those are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        q, c = queries.astype(np.float64), [np.ascontiguousarray(candidates[:, s].T, np.float64) for s in shares]
        return lambda a, b: np.stack([q[a:b, s] @ x for s, x in zip(shares, c, strict=True)])
    return lambda a, b: np.stack([np.stack([(x[None, s] * candidates[:, s]).sum(1) for x in queries[a:b]]) for s in shares])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of a row's scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _sized(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, pa.Table]]:
    """ids, components and rows by length of the vectors."""
    out = {}
    size = np.array(pc.list_value_length(table.column("v")).to_pylist(), np.int64)
    for n in np.unique(size).tolist():
        part = pa.table(table.filter(pa.array(size == n))).combine_chunks()
        out[n] = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks()), part
    return out


def _shares(n: int, groups: int) -> list[slice]:
    edges = np.linspace(0, n, min(groups, n) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def local_lists(parts: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: places of each group's best k candidates; parts: groups by candidates."""
    return np.unique(np.concatenate([best(p, ids, k) for p in parts]))


def sufficient(parts: np.ndarray, ids: np.ndarray, cutoff: int, last_id: int) -> np.ndarray:
    """Phases 2 and 3: places of the candidates that reach the cutoff, by the even share, the bounds and then the sums."""
    even = -(-cutoff // len(parts))  # some group has at least the mean, rounded up, as scores are whole
    seen = parts >= even
    at = np.flatnonzero(seen.any(0))
    # A group that does not list a candidate adds less than the even share.
    at = at[np.where(seen[:, at], parts[:, at], even - 1).sum(0) >= cutoff]
    total = parts[:, at].sum(0)
    return at[(total > cutoff) | (total == cutoff) & (ids[at] <= last_id)]


def _lists(candidates: DataFrame, sent: Broadcast, k: int, groups: int, first: bool = False) -> DataFrame:
    """query (its number in the tile), id, score: of each task phase 1's lists, or its best k candidates of those that reach the cutoffs."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for n, (ids, vectors, _) in _sized(batch).items():
                if n not in sent.value:
                    continue
                number, queries, cutoffs = sent.value[n]
                parts_of = products(queries, vectors, _shares(n, groups))
                for a in range(0, len(queries), _QUERIES):
                    parts = parts_of(a, a + _QUERIES)
                    for i, cutoff in enumerate(cutoffs[a : a + _QUERIES]):
                        mine = parts[:, i]
                        at = local_lists(mine, ids, k) if first else sufficient(mine, ids, *cutoff) if cutoff else np.arange(len(ids))
                        if len(at):
                            rows = held.setdefault(int(number[a + i]), [[], []])
                            rows[0].append(ids[at])
                            rows[1].append(mine[:, at].sum(0).astype(np.int64))
                            if sum(map(len, rows[0])) > 8 * k:
                                _cut(rows, k)
        for q, rows in held.items():
            _cut(rows, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0][0]), q, np.int64)), pa.array(rows[0][0]), pa.array(rows[1][0])], names=["query", "id", "score"])

    return candidates.select("id", "v").mapInArrow(run, "query long, id long, score long")


def _cut(rows: list[list], k: int) -> None:
    ids, scores = np.concatenate(rows[0]), np.concatenate(rows[1])
    at = best(scores, ids, k)
    rows[0], rows[1] = [ids[at]], [scores[at]]


def _top(lists: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query; a task sends k at most, so a window gets a bounded number for each."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _tile(queries: DataFrame) -> tuple[dict, pa.Table]:
    """A tile's vectors by length, as (numbers, vectors, cutoffs), and its table of query, query_id, query_key and own, the product with itself."""
    out, known, at = {}, [], 0
    for n, (ids, vectors, part) in _sized(queries.toArrow()).items():
        number = np.arange(at, at + len(ids))
        out[n] = (number, vectors, [None] * len(ids))
        known.append(pa.table({"query": number, "query_id": ids, "query_key": part.column("key"), "own": (vectors * vectors).sum(1)}))
        at += len(ids)
    return out, pa.concat_tables(known) if known else None


def _with_cutoffs(tile: dict, lists: DataFrame, k: int) -> dict:
    """The tile with the score and the id of the k-th best candidate so far of each query that has k."""
    found = lists.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("id")).alias("id"))).alias("least")).where(F.col("n") >= k)
    cutoffs = {r["query"]: (r["least"]["score"], -r["least"]["id"]) for r in found.collect()}  # two numbers for each query of the tile
    return {n: (number, vectors, [cutoffs.get(q) for q in number.tolist()]) for n, (number, vectors, _) in tile.items()}


def _without_own(lists: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Ranked lists of k + 1, less one row that has the query's id and its product with itself, which is the query's own or like it in all."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    own = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = lists.join(known, "query").withColumn("at", F.row_number().over(w)).withColumn("gone", F.coalesce(F.min(F.when(own, F.col("at"))).over(Window.partitionBy("query")), F.lit(k + 2)))
    left = ranked.where("at <> gone").withColumn("rank", F.expr("at - if(at > gone, 1, 0)")).where(F.col("rank") <= k)
    return left.select("query_id", "rank", F.col("id").alias("vec_id"), "score", "query_key")


def top_k(vectors: DataFrame, queries: F.Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, groups: int = GROUPS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_key for the rows that the condition queries picks."""
    spark, mark = vectors.sparkSession, tables_so_far()
    bounded_batches(spark, BATCH)
    total, levels = vectors.count(), 0
    while FIRST_ROWS * STEP**levels < total:
        levels += 1
    place = F.pmod(F.xxhash64("id", "v"), F.lit(STEP**levels))
    level = sum((F.when(place >= STEP**i, 1).otherwise(0) for i in range(levels)), F.lit(0))
    rows = written_table(quantise(vectors, id_col, vector_col, scale, queries).withColumn("level", level), by="level")
    numbers = rows.where("asked").agg(F.sum(F.size("v"))).first()[0] or 0
    tiles = max(1, -(-8 * numbers // TILE_BYTES))
    asked = rows.where("asked").select("id", "v", F.xxhash64("v").alias("key")).distinct().withColumn("tile", F.pmod(F.xxhash64("id", "key"), F.lit(tiles)).cast("int"))
    asked = written_table(asked, by="tile")
    results = []
    for t in range(tiles):
        tile, known = _tile(asked.where(F.col("tile") == t).select("id", "v", "key"))
        if known is None:
            continue
        # One more than k, since a query's own row is a candidate until the end.
        send = spark.sparkContext.broadcast  # TILE_BYTES of vectors, about, and a cutoff each
        sent = send(tile)
        tile = _with_cutoffs(tile, _top(_lists(rows.where("level = 0"), sent, k + 1, groups, first=True), k + 1), k + 1)
        sent.destroy()
        lists = None
        for i in range(levels + 1):
            sent = send(tile)
            found = _lists(rows.where(F.col("level") == i), sent, k + 1, groups)
            lists = written_table(_top(found if lists is None else found.unionByName(lists), k + 1).drop("rank"))
            sent.destroy()  # workers would hold it on
            if i < levels:
                tile = _with_cutoffs(tile, lists, k + 1)
        results.append(written_table(_without_own(lists, spark.createDataFrame(known), k)))
        drop_since(spark, mark, rows, asked, *results)
    drop_since(spark, mark, *results)
    schema = "query_id long, rank int, vec_id long, score long, query_key long"
    return spark.read.schema(schema).parquet(*[r.lindero_place for r in results]) if results else spark.createDataFrame([], schema)


def top_k_sql(k: int = 10) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""

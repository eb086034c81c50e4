"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, without loss: the second rule of operator 4.

Of two such sets of n and m shingles, at least 0.8 max(n, m) are shared. So, with all shingles in one
order, the first n - 0.8 n + k of the one and the first m - 0.8 m + k of the other share k or more.
These first ones are the keys under which texts meet; keys that the same texts have count as one. The order may be any that all texts share: rare
shingles come first, by counts over all texts in a table of fixed size, so that what many texts have is
rarely a key and a text that differs in more than a fifth of its shingles meets hardly any other.

Texts that meet are compared in rounds. The first rounds compare each only with one of those under
its key, a hub. The last one looks at all pairs under a key that are not yet in one component, so nothing
is missed, but a large group of near copies has mostly come together before. It does so inside tasks, in
blocks of bounded size, by how many shingles the texts have in each of CELLS cells: two sets differ at
least by the Manhattan distance of these counts. Only pairs that this bound leaves are given out, and
then compared by their whole sets.

Nulls and edge cases: null and blank texts have no shingle and are copies of each other; a text of
fewer words than a shingle is one shingle; shingles are told apart by XXH64, sets by XXH3-128; rows
with a null id get the component of the ids they link with, or null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_since, drop_tables, lean, map_texts, slices, tables_so_far, utf8, written_table
from lindero.llm.graph import components

#: The seed of XXH64.
SEED = 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Counters of shingles, a byte each, and the counters of a block of them that is summed and sent as one.
COUNTERS, _BLOCK = 1 << 24, 1 << 16
#: Bits of the map that picks out texts to compare: 8 MB however many there are, and how many bits one of its pages has.
BITS, _PAGE = 1 << 26, 1 << 15
#: Rounds that compare with hubs only.
HUB_ROUNDS = 3
#: Passes in which keys are counted, each over its share of them, so that only a share is ever in a shuffle.
PASSES = 4
#: Cells whose shingles are counted, a byte each, and texts of a key that a task compares with as many others at a time.
CELLS, CHUNK = 128, 1024


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted, as unsigned longs."""
    words = text.lower().split()  # on bytes: A-Z only, and the ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([h(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = start[shingle - 1 :] + size[shingle - 1 :]
    hashes = np.fromiter([h(line[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())], np.uint64, n - shingle + 1)  # noqa: B905
    return np.unique(hashes)


def shared_keys(n: int) -> int:
    """How many keys a text of n shingles shares with any that is as large or larger and similar."""
    return min(4, 1 + n // 10)


def _place(found: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (found % np.uint64(COUNTERS)).astype(np.int64)


def keys(found: np.ndarray, counts: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The keys of a sorted set: its first shingles by their counts, then by their hashes."""
    n = len(found)
    found = found[np.argsort(counts[_place(found)], kind="stable")]
    return found[: n + (-least[0] * n // least[1]) + shared_keys(n)]


def cells(found: np.ndarray) -> bytes:
    """How many shingles a set has in each cell, up to 255; that limit brings counts no further apart."""
    return np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def shingle_counts(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> np.ndarray:
    """For each counter how many texts have one of its shingles, up to 255, over all texts: COUNTERS bytes, whatever the input."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = COUNTERS // _BLOCK
    kind = "block int, counts binary"

    def packed(held: dict[int, np.ndarray]):
        for block, n in held.items():
            body = zlib.compress(np.minimum(n, 255).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([body], pa.binary())], names=["block", "counts"])

    def count(batches):
        held = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices([len(t) for t in texts]):
                at, n = np.unique(np.concatenate([_place(shingles(t, shingle)) for t in texts[a:b]]), return_counts=True)
                held[at] += n.astype(np.int32)
        rows = held.reshape(blocks, _BLOCK)
        yield from packed({i: rows[i] for i in np.flatnonzero(rows.any(1)).tolist()})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = held.setdefault(block, np.zeros(_BLOCK, np.int32))
                n += np.frombuffer(zlib.decompress(body), np.uint8)
        yield from packed(held)

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, kind)
    # A task that adds holds the blocks that are dealt to it, all of them at most.
    out = np.zeros((blocks, _BLOCK), np.uint8)
    for r in parts.repartition("block").mapInArrow(add, kind).toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint8)
    return out.reshape(-1)


def _keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int, sent: Broadcast, least: tuple[int, int]) -> DataFrame:
    """id_col, whole (equal for equal sets), n, the keys and the cells."""
    def make():
        counts = sent.value

        def run(texts):
            sets = [shingles(t, shingle) for t in texts]
            return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets], [keys(s, counts, least).view(np.int64) for s in sets], [cells(s) for s in sets]]

        return run

    return map_texts(docs, [id_col], text_col, "whole binary, n long, keys array<long>, cells binary", make)


def _compare(rows: tuple[np.ndarray, ...], least: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block (side, rep, n, label, cells, keys) that may be similar: of different labels, and of different sides if it has two.

    keys: those of the texts that are smaller than the block's; a pair that shares several keys belongs to the smallest.
    """
    side, rep, n, label, cell, of = rows
    out = []
    two = (side != side[0]).any()
    for i in range(len(rep) - 1):
        fits = (label[i + 1 :] != label[i]) & (n[i + 1 :] * least[1] >= n[i] * least[0]) & (n[i] * least[1] >= n[i + 1 :] * least[0])
        if two:
            fits &= side[i + 1 :] != side[i]
        at = i + 1 + np.flatnonzero(fits)
        if len(at):
            total = n[at] + n[i]
            apart = np.abs(cell[at] - cell[i]).sum(1)
            # The sets share at most half of what is left of their sizes.
            at = at[sum(least) * (total - apart) >= 2 * least[0] * total]
            at = at[[of[i].isdisjoint(of[j]) for j in at.tolist()]] if len(at) else at
            if len(at):
                out.append((np.minimum(rep[at], rep[i]), np.maximum(rep[at], rep[i])))
    return out


def close_pairs(met: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a and b of the texts under a key (key, size, rep, n, label, cells, keys) that have different labels and may be similar, each pair once.

    The texts of a common key are dealt into chunks, and each pair of chunks is a block of its own.
    """
    spark = met.sparkSession
    bounded_batches(spark)
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    smaller = F.filter("keys", lambda k: k < F.col("key")).alias("keys")
    dealt = met.select("key", "rep", "n", "label", "cells", smaller, own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    block = F.struct("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    # The block's hash stands for it; blocks that share one are told apart by its key and chunks.
    dealt = dealt.select(F.xxhash64(block).alias("block"), "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "n", "label", "cells", "keys")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "key", "low", "high")

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # of the block that goes on into the next batch
        name = None

        def done():
            if held and sum(len(h[0]) for h in held) > 1:
                for a, b in _compare(tuple(np.concatenate(x) for x in zip(*held, strict=True)), least):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            block, key, low, high, side, rep, n, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            cell = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
            of = np.empty(batch.num_rows, object)
            of[:] = [frozenset(x) for x in batch.column(9).to_pylist()]
            names = np.stack([block, key, low.astype(np.int64), high.astype(np.int64)], 1)
            starts = np.concatenate([[0], 1 + np.flatnonzero((names[1:] != names[:-1]).any(1)), [len(names)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if name is None or (names[a] != name).any():
                    yield from done()
                    name = names[a]
                held.append((side[a:b], rep[a:b], n[a:b], label[a:b], cell[a:b], of[a:b]))
        yield from done()

    return ordered.mapInArrow(lean(run), "a long, b long")


def among(wanted: DataFrame) -> tuple[Callable[[F.Column], F.Column], Broadcast]:
    """A test of ids by a bitmap of BITS hashes, which lets all wanted ids pass and few others, so that few texts are shuffled; and what it sends."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    at = place(F.col("id")) + 1  # Spark's bitmaps count from 1
    bits = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = np.zeros((BITS // _PAGE, _PAGE // 8), np.uint8)
    for r in bits.toLocalIterator():  # BITS / 8 bytes in all
        whole[r.bucket - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = wanted.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        n = at.to_numpy()
        return pd.Series((sent.value[n >> 3] >> (n & 7)) & 1 > 0)

    return lambda c: test(place(c)), sent


def similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) those that are similar, by their whole sets, as edges (fp, hub)."""
    pairs = written_table(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # One row of each representative brings its text; rows of equal ids and other texts go again by their sets.
    ids = written_table(rows.join(wanted, "rep").groupBy("rep", "whole").agg(F.struct(F.min("id").alias("id")).alias("i")).select("rep", "whole", "i.id"))
    fits, sent = among(ids)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(fits(F.col("id")))
    texts = texts.join(ids.select(F.col("id").alias("__id")).distinct(), F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def make():
        def run(found):
            sets = [shingles(t, shingle) for t in found]
            return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets]]

        return run

    sets = map_texts(texts, [], "text", "whole binary, shingles array<long>", make)
    have = written_table(sets.join(ids.select("rep", "whole"), "whole").dropDuplicates(["whole"]).select("rep", "shingles"))
    sent.destroy()  # workers would hold it on
    both = pairs.join(have.toDF("a", "left"), "a").join(have.toDF("b", "right"), "b")
    shared = F.size(F.array_intersect("left", "right"))
    enough = sum(least) * shared >= least[0] * (F.size("left") + F.size("right"))
    out = written_table(both.where(enough).select(F.col("a").alias("fp"), F.col("b").alias("hub")))
    drop_tables(pairs, ids, have)
    return out


def shared(with_keys: DataFrame) -> DataFrame:
    """rep, n, key, times: the keys of several texts, of those that the same texts have one only, with how many these are.

    Most keys are of one text, and a passage that some texts share gives them all its keys.
    """
    all_, parts = with_keys.select("rep", F.explode("keys").alias("key")), []
    for i in range(PASSES):
        own = all_.where(F.pmod("key", F.lit(PASSES)) == i)
        several = own.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
        parts.append(written_table(own.join(several, "key")))
    met = reduce(DataFrame.unionByName, parts)
    # Sets of texts are told apart by 128 bits, their size and their ends.
    by = [F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    kinds = met.groupBy("key").agg(*by).groupBy("size", "low", "high", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times"))
    out = written_table(met.join(kinds.select("key", "times"), "key").join(with_keys.select("rep", "n"), "rep").select("rep", "n", "key", "times"))
    drop_tables(*parts)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """id_col and component_id, the smallest id that can be reached over pairs of similar texts."""
    mark = tables_so_far()
    sent = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text_col, shingle))  # COUNTERS bytes
    found = written_table(_keyed(docs, id_col, text_col, shingle, sent, least).withColumnRenamed(id_col, "id"))
    sent.destroy()
    distinct = found.groupBy("whole").agg(F.min("id").alias("first"), F.first(F.struct("n", "keys", "cells")).alias("x")).select("whole", "first", "x.*")
    with_keys = written_table(distinct.withColumn("rep", F.monotonically_increasing_id()))
    reps = written_table(with_keys.select("rep", "whole", "first", "cells"))
    rows = written_table(found.select("id", "whole").join(reps.select("whole", "rep"), "whole"))
    drop_tables(found)
    met = held = shared(with_keys)
    drop_tables(with_keys)
    needed = lambda n: F.least(F.lit(4), F.lit(1) + F.floor(F.col(n) / 10))  # noqa: E731  shared_keys()
    fits = F.expr(f"a.n * {least[1]} >= b.n * {least[0]} and b.n * {least[1]} >= a.n * {least[0]}")
    edges: list[DataFrame] = []
    joined = None
    for turn in range(HUB_ROUNDS + 1):
        # Keys with one label keep it, so only the others go on. They are counted before the texts of a key meet, which the join may split.
        label = F.col("rep") if joined is None else F.coalesce("label", "rep")
        now = (met if joined is None else met.join(joined.withColumnRenamed("fp", "rep"), "rep", "left")).withColumn("label", label)
        of_key = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
        mixed = written_table(now.join(of_key, "key"))
        drop_tables(held)
        held, met = mixed, mixed.select("rep", "n", "key", "times")
        if turn < HUB_ROUNDS:
            hub = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("at"), "rep", "n", "label")).alias("b"))
            near = mixed.select("key", "times", F.struct("rep", "n", "label").alias("a")).join(hub, "key").where("a.label <> b.label").where(fits)
            counted = near.groupBy(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n")).agg(F.sum("times").alias("times"))
            pairs = counted.where(F.col("times") >= F.least(needed("a_n"), needed("b_n"))).select("a", "b")
        else:
            # Of a text's keys only those under which labels still differ can be shared by a pair, so no others are carried along.
            open_keys = mixed.groupBy("rep").agg(F.collect_list("key").alias("keys"))
            pairs = close_pairs(mixed.join(reps.select("rep", "cells"), "rep").join(open_keys, "rep"), least)
        edges.append(similar(pairs, rows, docs, id_col, text_col, shingle, least))
        joined = components(reduce(DataFrame.unionByName, edges))
    named = joined.join(reps.select(F.col("rep").alias("fp"), "first"), "fp")
    smallest = named.groupBy("label").agg(F.min("first").alias("least"))
    merged = named.join(smallest, "label").select(F.col("fp").alias("rep"), "least")
    # Both sides of the last join come from files, so that a set of very many copies can be split.
    home = written_table(reps.join(merged, "rep", "left").select("rep", F.coalesce("least", "first").alias("component_id")))
    drop_since(docs.sparkSession, mark, rows, home)
    return rows.join(home, "rep").select(F.col("id").alias(id_col), "component_id")

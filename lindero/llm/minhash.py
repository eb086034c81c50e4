"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, by b-bit MinHash.

A set has 128 minima, one for each of as many hash functions. Four of them make a band, and sets that agree in a band
meet: two sets of similarity 0.8 agree in none of the 32 bands with a probability of 5e-8. Of each minimum the low 4 bits are
kept; a set's signature is 512 bits. Of two signatures the bits that differ are counted, and the share of equal minima,
less those that agree by chance (1 in 16), estimates the similarity. Pairs whose estimate lies six standard
deviations or more below 0.8 go; all others are confirmed on the full sets.

Equal sets are one from the start. Sets that meet are not paired up: in the first rounds each set is confirmed with one
other at most, the one of the best estimate among the hubs, one for each band. Linked sets get one label. The last
round looks at all pairs of a band that still have different labels, in blocks of bounded size inside tasks,
and each pair under the first band that it shares. So a large group of near copies has come together before,
and no link is missed. There, pairs just below 0.8, of which such a group has very many, go by a second look: two sets differ
at least by the Manhattan distance of how many shingles they have in each of 256 cells.

Nulls and edge cases: a text of fewer words than a shingle is one shingle; null and blank texts have none, link with nothing and are
components of their own; shingles are told apart by XXH64, sets by XXH3-128; rows that repeat an id count as one document
of several texts (the component is the smallest id reachable from the row's text); rows with a null id get the component of
the ids they link with, or null, and are not kept; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_since, drop_tables, map_texts, tables_so_far, written_table
from lindero.llm.graph import components
from lindero.llm.similar import among, shingles

#: Minima of a set, minima of a band, and bits that are kept of each.
MINIMA, BAND, BITS = 128, 4, 4
BANDS, _WORDS = MINIMA // BAND, MINIMA * BITS // 64
#: The least similarity, as a fraction, and how many standard deviations an estimate may lie below it.
LEAST, DEVIATIONS = (4, 5), 6.0
#: Rounds that confirm one pair of each set at most.
HUB_ROUNDS = 3
#: Cells whose shingles are counted, a byte each, and pairs whose counts are compared at a time.
CELLS, _LOOKED = 256, 1 << 13
#: Sets of a band that a task compares with as many others at a time; rows of a tile; shingles that are hashed at a time.
CHUNK, _TILE, _HASHED = 1024, 32, 1 << 16

_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 1 << 64, MINIMA, np.uint64, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The lowest bit of each lane.
_LANES = sum(1 << i for i in range(0, 64, BITS))


def least_equal(least: tuple[int, int] = LEAST) -> int:
    """How many lanes of two signatures must agree for the sets to go on."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * least[0] / least[1]
    return math.ceil(MINIMA * equal - DEVIATIONS * math.sqrt(MINIMA * equal * (1 - equal)))


def estimate(equal: Column | float) -> Column | float:
    """The similarity that a number of equal lanes stands for, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MINIMA for each set, none of which is empty."""
    out, a = np.empty((len(sets), MINIMA), np.uint64), 0
    while a < len(sets):
        b, held = a + 1, len(sets[a])
        while b < len(sets) and held + len(sets[b]) <= _HASHED:
            held += len(sets[b])
            b += 1
        every = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]])]).astype(np.int64)
        for k in range(MINIMA):
            out[a:b, k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], starts)
        a = b
    return out


def signature(low: np.ndarray) -> np.ndarray:
    """The low bits of each row of minima, side by side in _WORDS numbers."""
    lanes = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), _WORDS, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def bands(low: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima; keys of different bands differ."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(low), 1))
    for r in range(BAND):
        out = (out ^ low[:, r::BAND]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def cells(found: np.ndarray) -> bytes:
    """How many shingles a set has in each cell, up to 255; that limit brings counts no further apart."""
    return np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, whole (equal for equal sets; null for an empty one), n, signature and bands."""

    def make():
        def run(texts):
            sets = [shingles(t, shingle) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            low = minima([sets[i] for i in full])
            whole, sign, keys = ([None] * len(sets) for _ in range(3))
            for i, s, k in zip(full, signature(low).view(np.int64), bands(low).view(np.int64), strict=True):
                whole[i], sign[i], keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), s, k
            return [whole, [len(s) for s in sets], sign, keys]

        return run

    found = map_texts(docs, [id_col], text_col, "__whole binary, __n long, __signature array<long>, __bands array<long>", make)
    return found.toDF("id", "whole", "n", "signature", "bands")


def _equal_lanes(a: str, b: str) -> Column:
    """How many lanes of two signatures agree: bits that differ, gathered in the lowest bit of their lane and counted."""
    low = F.lit(_LANES)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(low))

    return F.lit(MINIMA) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def _sizes_fit(a: str, b: str, least: tuple[int, int]) -> Column:
    return (F.col(a) * least[1] >= F.col(b) * least[0]) & (F.col(b) * least[1] >= F.col(a) * least[0])


def _mixed(met: DataFrame, state: DataFrame) -> DataFrame:
    """The sets that meet (key, at, rep) with their n, label and signature, but for keys whose sets have one label."""
    now = met.join(state, "rep")
    keys = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    return now.join(keys, "key")


def _hub_pairs(now: DataFrame, turn: int, least: tuple[int, int]) -> DataFrame:
    """For each set the hub of the best estimate among those of its keys that have another label: a, b, label_a, label_b."""
    hub = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("at"), "rep", "n", "label", "signature")).alias("h"))
    hub = hub.select("key", *[F.col(f"h.{c}").alias(f"hub_{c}") for c in ("rep", "n", "label", "signature")])
    pairs = now.join(hub, "key").where(F.col("label") != F.col("hub_label")).where(_sizes_fit("n", "hub_n", least)).withColumn("equal", _equal_lanes("signature", "hub_signature")).where(F.col("equal") >= least_equal(least))
    best = pairs.groupBy("rep").agg(F.max(F.struct("equal", F.col("hub_rep").alias("b"), F.col("label").alias("label_a"), F.col("hub_label").alias("label_b"))).alias("x"))
    return best.select(F.col("rep").alias("a"), "x.b", "x.label_a", "x.label_b")


def _compare(at: int, side: np.ndarray, rep: np.ndarray, n: np.ndarray, label: np.ndarray, sign: np.ndarray, keys: np.ndarray, cell: np.ndarray, least: tuple[int, int]) -> list[np.ndarray]:
    """Places (i, j) of the pairs of one block that may be similar: of different labels, and of different sides if it has two; a pair belongs to the first band that it shares."""
    order = np.lexsort((label, side))
    cut = int((side != side.max()).sum())  # of two sides, the rows of the first stand before it
    wanted, low, out = least_equal(least), np.uint64(_LANES), []
    for a in range(0, cut or len(rep), _TILE):
        mine = order[a : min(a + _TILE, cut or len(rep))]
        other = order[cut:] if cut else order[a + 1 :]
        if not len(other):
            break
        fits = (label[mine][:, None] != label[other]) & (n[mine][:, None] * least[1] >= n[other] * least[0]) & (n[other] * least[1] >= n[mine][:, None] * least[0])
        if not cut:
            fits &= np.arange(a, a + len(mine))[:, None] < np.arange(a + 1, len(order))
        i, j = np.nonzero(fits)
        for s in range(0, len(i), _LOOKED):
            x, y = mine[i[s : s + _LOOKED]], other[j[s : s + _LOOKED]]
            d = sign[x] ^ sign[y]
            d |= d >> np.uint64(2)
            d |= d >> np.uint64(1)
            ok = MINIMA - np.bitwise_count(d & low).sum(1) >= wanted
            x, y = x[ok], y[ok]
            total = n[x] + n[y]
            ok = sum(least) * (total - np.abs(cell[x] - cell[y]).sum(1)) >= 2 * least[0] * total  # they share half of the rest at most
            ok &= (keys[x] == keys[y]).argmax(1) == at
            out.append(np.stack([x[ok], y[ok]]))
    return out


def _block_pairs(met: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b, label_a and label_b of the sets of a key (key, at, size, rep, n, label, signature, bands, cells) that have different labels and may be similar.

    The sets of a common key are dealt into chunks, and each pair of chunks is a block of its own.
    """
    bounded_batches(met.sparkSession)
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    dealt = met.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), chunks - 1))}).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    names = ("block", "key", "low", "high", "own", "at", "rep", "n", "label", "signature", "bands", "cells")
    # The block's hash stands for it; blocks that share one are told apart by key and chunks.
    ordered = dealt.withColumn("block", F.xxhash64("key", "low", "high")).select(*names).repartition("block").sortWithinPartitions("block", "key", "low", "high")

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # of the block that goes on into the next batch
        name = None

        def done():
            at, *rows = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if len(at) > 1:
                for i, j in _compare(int(at[0]), *rows, least):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[1][i]), pa.array(rows[1][j]), pa.array(rows[3][i]), pa.array(rows[3][j])], names=["a", "b", "label_a", "label_b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
            sign, keys = (batch.column(i).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for i in (9, 10))
            cell = np.frombuffer(b"".join(batch.column(11).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
            names_ = np.stack([c.astype(np.int64) for c in cols[:4]], 1)
            starts = [0, *(1 + np.flatnonzero((names_[1:] != names_[:-1]).any(1))).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if name is not None and (names_[a] != name).any():
                    yield from done()
                name = names_[a]
                held.append(tuple(c[a:b] for c in (cols[5], cols[4], cols[6], cols[7], cols[8], sign, keys, cell)))
        if held:
            yield from done()

    return ordered.mapInArrow(run, "a long, b long, label_a long, label_b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Edges (fp, hub) between labels whose sets (rep, shingles) are similar."""
    sets = sets.select("rep", "shingles")
    both = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    enough = sum(least) * F.size(F.array_intersect("left", "right")) >= least[0] * (F.size("left") + F.size("right"))
    return both.where(enough).select(F.col("label_a").alias("fp"), F.col("label_b").alias("hub")).distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rep, shingles and cells of the sets wanted (rep, whole, id), read again from one text each."""
    fits, sent = among(wanted)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(fits(F.col("id")))

    def make():
        def run(found):
            sets = [shingles(t, shingle) for t in found]
            return [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.view(np.int64) for s in sets], [cells(s) for s in sets]]

        return run

    sets = map_texts(texts, [], "text", "whole binary, shingles array<long>, cells binary", make)
    out = written_table(sets.join(wanted.select("rep", "whole"), "whole").dropDuplicates(["rep"]).select("rep", "shingles", "cells"))
    sent.destroy()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, least: tuple[int, int] = LEAST) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id that can be reached over pairs of similar texts) and kept (this row's id is the component's)."""
    spark, mark = docs.sparkSession, tables_so_far()
    found = written_table(signed(docs, id_col, text_col, shingle))
    whole = found.where("whole is not null").groupBy("whole").agg(F.min("id").alias("first"), F.first(F.struct("n", "signature", "bands")).alias("x"))
    reps = written_table(whole.select("whole", "first", "x.*").withColumn("rep", F.monotonically_increasing_id()))
    every = reps.select("rep", F.posexplode("bands").alias("at", "key"))
    common = every.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    held = written_table(every.join(common, "key"))
    meeting = held.select("rep").distinct()
    state = written_table(reps.join(meeting, "rep").select("rep", "n", F.col("rep").alias("label"), "signature"))
    sets = _shingle_sets(docs, written_table(reps.join(meeting, "rep").select("rep", "whole", F.col("first").alias("id"))), id_col, text_col, shingle)
    for turn in range(HUB_ROUNDS + 1):
        now = written_table(_mixed(held.select("key", "at", "rep"), state))
        drop_tables(held)
        held = now
        pairs = _hub_pairs(now, turn, least) if turn < HUB_ROUNDS else _block_pairs(now.join(reps.select("rep", "bands"), "rep").join(sets.select("rep", "cells"), "rep"), least)
        joined = components(_confirmed(written_table(pairs), sets, least)).toDF("label", "to")
        after = written_table(state.join(joined, "label", "left").select("rep", "n", F.coalesce("to", "label").alias("label"), "signature"))
        drop_tables(state)
        state = after
    named = state.select("rep", "label").join(reps.select("rep", "whole", "first"), "rep")
    smallest = named.groupBy("label").agg(F.min("first").alias("least"))
    merged = named.join(smallest, "label").select("whole", "least")
    # Both sides of the last join come from files, so that a set of very many copies can be split.
    home = written_table(reps.select("whole", "first").join(merged, "whole", "left").select("whole", F.coalesce("least", "first").alias("component_id")))
    drop_since(spark, mark, found, home)
    full = found.where("whole is not null").select("id", "whole", "n").join(home, "whole").select("id", "n", "component_id")
    out = full.unionByName(found.where("whole is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_duplicates_sql(table: str = "documents") -> str:
    """The same in SQL, by all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {table}),
s AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS x FROM w),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT k.r AS a, o.r AS b, count(*) AS shared FROM s k JOIN s o ON o.x = k.x AND o.r <> k.r GROUP BY 1, 2) p JOIN n i ON i.r = p.a JOIN n j ON j.r = p.b WHERE 100 * shared >= 80 * (i.n + j.n - shared)),
c(r, o) AS (SELECT r, r FROM w UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.o),
m AS (SELECT c.r, min(w.doc_id) AS component_id FROM c JOIN w ON w.r = c.o GROUP BY c.r)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(w.doc_id = component_id, FALSE) AS kept FROM w JOIN m ON m.r = w.r LEFT JOIN n ON n.r = w.r"""

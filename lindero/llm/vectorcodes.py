"""Product codes of vectors: each vector is cut into 16 parts, and each part is replaced by the nearest of 64 entries of its own codebook.

Components become integers, floor(256 x), so all distances are exact. Codebooks start as the parts of the
vectors with the smallest ids and are refined in two rounds: parts are assigned, entries become the means of
theirs, rounded down. A part's nearest entry is found by annular norm pruning: entries are sorted by norm, those of
the nearest norms give a first distance d, and only entries whose norm differs from the part's by d or less,
an interval that two binary searches find, can be nearer. They are evaluated from the middle outwards, a few at a time,
and the interval is looked up again with the best distance so far; entries on its edges are among them.

Only codebooks and their sums, whose size is 64 vectors, go through the driver; a task sends its sums as one row for
each component of each entry. Vectors are read four times and never shuffled; the codes are, to sum errors by label.

Nulls and edge cases: vectors that are null or empty, or that hold null or non-finite components, take no part, nor do
those with a component of LIMIT or more (their squares would not fit a long), nor those whose length isn't that of the first vector
whose length is a multiple of 16. Rows that repeat an id are coded each by its own vector, and start codebooks in the
order of id and vector; a null id counts as larger than all others. Fewer than 64 vectors make fewer entries. Null
labels are one label. An empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, written_table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are told apart to 1 / SCALE.
SCALE = 256
#: Components are smaller than this, so that squared distances fit a long.
LIMIT = 1 << 16
#: Added to a distance before the search, far more than square roots are off by.
_SLACK = 1e-3
#: Entries on each side that are evaluated before the interval is looked up again, and pairs that are evaluated at a time.
_WAVE, _PAIRS = 4, 1 << 18
_NONE = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """Integer entries by part, entry and position, and the length of the vectors that they code."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class Annuli:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(1).astype(float))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def _keys(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance, then index, in one number."""
        d = parts - self.entries[at]
        return (d * d).sum(1) * ENTRIES + self.order[at]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The index of each part's nearest entry (the lowest of equals), their squared distance, and how many pairs were evaluated."""
        own, n = np.sqrt((parts * parts).sum(1).astype(float)), len(self.norms)
        best, pairs = np.full(len(parts), _NONE), 0
        left = np.searchsorted(self.norms, own)
        right, open_ = left.copy(), np.arange(len(parts))  # evaluated so far: from left up to right
        while len(open_):
            reach = np.where(best[open_] == _NONE, np.inf, np.sqrt((best[open_] // ENTRIES).astype(float)) + _SLACK)
            low, high = np.searchsorted(self.norms, own[open_] - reach, "left"), np.searchsorted(self.norms, own[open_] + reach, "right")
            a, b = left[open_], right[open_]
            down, up = np.minimum(a, np.maximum(low, a - _WAVE)), np.maximum(b, np.minimum(high, b + _WAVE))
            wide = (a - down) + (up - b)
            going = np.flatnonzero(wide)
            open_, wide, low, high, skip = open_[going], wide[going], down[going], a[going], (b - a)[going]
            left[open_], right[open_] = low, up[going]
            upto, pairs = np.cumsum(wide), pairs + int(wide.sum())
            for i, j in _chunks(upto):
                m = wide[i:j]
                starts = upto[i:j] - m - (upto[i - 1] if i else 0)
                at = np.arange(int(m.sum())) - np.repeat(starts, m) + np.repeat(low[i:j], m)
                at += np.where(at >= np.repeat(high[i:j], m), np.repeat(skip[i:j], m), 0)  # past what was evaluated before
                rows = open_[i:j]
                best[rows] = np.minimum(best[rows], np.minimum.reduceat(self._keys(parts[np.repeat(rows, m)], at), starts))
        return best % ENTRIES, best // ENTRIES, pairs


def _chunks(upto: np.ndarray):
    """Ranges of rows that hold about _PAIRS pairs each."""
    a = 0
    while a < len(upto):
        held = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, held + _PAIRS, "right")))
        yield a, b
        a = b


def _whole(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector takes part, if its length is the right one."""
    v = F.col(f"`{vec_col}`")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float(LIMIT))))


def _integers(column: pa.Array, length: int) -> np.ndarray:
    """floor(256 x) of a batch's vectors, by row, part and position."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, PARTS, length // PARTS)


def _assigned(parts: np.ndarray, found: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    codes, errors = np.empty((len(parts), PARTS), np.int64), np.zeros(len(parts), np.int64)
    for p, a in enumerate(found):
        codes[:, p], d, _ = a.nearest(parts[:, p])
        errors += d
    return codes, errors


def first_codebooks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks | None:
    """The parts of the vectors with the 64 smallest ids; None if no vector takes part."""
    kept = _whole(vectors, vec_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    order = [F.asc_nulls_last("id"), "v"]
    one = kept.orderBy(*order).limit(1).collect()
    if not one:
        return None
    length = len(one[0].v)
    rows = kept.where(F.size("v") == length).orderBy(*order).limit(ENTRIES).collect()  # 64 vectors
    q = np.floor(SCALE * np.array([r.v for r in rows])).astype(np.int64).reshape(len(rows), PARTS, length // PARTS)
    return Codebooks(np.ascontiguousarray(q.transpose(1, 0, 2)))


def refined(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> Codebooks:
    """Each entry becomes the mean of the parts assigned to it, rounded down; an entry without parts stays."""
    entries, length = books.entries, books.length
    _, n, width = entries.shape

    def sums(batches):
        found = [Annuli(e) for e in entries]
        held = np.zeros((PARTS, n, width + 1), np.int64)  # the last one counts
        for batch in batches:
            if batch.num_rows:
                parts = _integers(batch.column(0), length)
                codes, _ = _assigned(parts, found)
                for p in range(PARTS):
                    np.add.at(held[p, :, :width], codes[:, p], parts[:, p])
                    held[p, :, width] += np.bincount(codes[:, p], minlength=n)
        at = np.flatnonzero(held.any(2))
        where = (np.repeat(at, width + 1) * (width + 1) + np.tile(np.arange(width + 1), len(at))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(held.reshape(-1)[where])], names=["place", "value"])

    bounded_batches(vectors.sparkSession, 10_000)
    kept = _whole(vectors, vec_col).where(F.size(F.col(f"`{vec_col}`")) == length).select(F.col(f"`{vec_col}`").cast("array<double>"))
    total = np.zeros(PARTS * n * (width + 1), np.int64)
    for r in kept.mapInArrow(sums, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():  # 64 vectors
        total[r.place] = r.value
    total = total.reshape(PARTS, n, width + 1)
    count = total[:, :, width:]
    return Codebooks(np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), entries))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after some rounds over all vectors; None if no vector takes part."""
    books = first_codebooks(vectors, id_col, vec_col)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books, vec_col)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], vec_col: str = "embedding") -> DataFrame:
    """The columns kept of the vectors that take part, with code (a byte for each part) and error."""
    length, entries = books.length, books.entries
    src = _whole(vectors, vec_col).where(F.size(F.col(f"`{vec_col}`")) == length)
    src = src.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vec_col}`").cast("array<double>").alias("__vector"))
    kind = src.sparkSession.createDataFrame([], "__code binary, __error long").schema
    out = type(kind)(src.schema.fields[:-1] + kind.fields)

    def run(batches):
        found = [Annuli(e) for e in entries]
        for batch in batches:
            codes, errors = _assigned(_integers(batch.column(len(keep)), length), found) if batch.num_rows else (np.zeros((0, PARTS)), np.zeros(0, np.int64))
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], packed, pa.array(errors)], names=out.fieldNames())

    bounded_batches(vectors.sparkSession, 10_000)
    return src.mapInArrow(run, out).withColumnsRenamed({"__code": "code", "__error": "error"})


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """codes with decoded, the vector that each code stands for."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in part]) for part in books.entries.tolist()])
    at = lambda i: F.conv(F.hex(F.substring(F.col(code_col), i + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*[parts[i][at(i)] for i in range(PARTS)]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, code (two hex digits for each part), error, label_error (the errors of a label's vectors) and codebooks_sha256."""
    books = fit(vectors, id_col, vec_col)
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    if books is None:
        return named.where("false").select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written_table(encode(named, books, ["id", "label"], "v"))
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    joined = coded.join(by, F.col("label").eqNullSafe(F.col("same")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def compress_sql(table: str = "embeddings") -> str:
    """The same in SQL, by all distances."""
    nearest = lambda book: f"(SELECT vec_id, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d FROM (SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN {book} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL)"
    means = lambda book: f"SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT c.part, a.entry, c.pos, CAST(floor(sum(c.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM c JOIN {nearest(book)} a ON a.vec_id = c.vec_id AND a.part = c.part GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos"
    return f"""WITH v AS (SELECT vec_id, label, embedding AS e FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, len(e) // {PARTS} AS width, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM v),
c AS MATERIALIZED (SELECT vec_id, i // width AS part, i % width AS pos, CAST(floor({SCALE} * x::DOUBLE) AS BIGINT) AS x FROM u),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
b0 AS MATERIALIZED (SELECT part, entry, pos, x FROM c JOIN s ON s.vec_id = c.vec_id WHERE entry < {ENTRIES}),
b1 AS MATERIALIZED ({means("b0")}), b2 AS MATERIALIZED ({means("b1")}), a AS MATERIALIZED {nearest("b2")},
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id)
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256 FROM r JOIN v ON v.vec_id = r.vec_id"""

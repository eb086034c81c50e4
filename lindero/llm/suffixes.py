"""Removal of passages that repeat, by sparse suffixes.

Every window of min_words words selects one of its positions, the first with the smallest hash of
the gram words that follow; equal windows select alike wherever they stand. Only the suffixes at
selected positions are kept, about two in 44. They are not sorted: suffixes that may match meet by the hash
of their first words, and one that meets no other is out. A suffix with its reach, which is all windows that selected it,
is compared as a whole, by a hash of the reach, with those that it meets; where these differ, the windows of the reach are looked at one
by one, by a hash each, once for each different reach, which finds what extending a match to both sides would find.
The result is exact but for the hashes: a window counts as repeated just when its words occur elsewhere too.

Of equal windows the first, in the order of documents and positions, is kept. Every word that is cut
still stands where the first of the windows that cover it stands, so no content is lost. Comparing
neighbours alone would not do: of three texts of which two pairs share different stretches, both
later ones could lose a stretch that the first doesn't have.

A document is a row's id and text: rows of one id and different texts are told apart by a hash of the
text, and rows that repeat both are one document, which repeats nothing of itself. Documents are
ordered by id, those without an id last, and then by that hash.

Nulls and edge cases: a text under min_words words, as are null and empty ones, has no passage; rows
with a null id take part like others; a passage that repeats within one text counts too; words are
what stands between ASCII white space, letter case included; texts may be of any length; other columns
are kept, whatever their names; an empty table gives an empty result; gram must be from 1 to min_words.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_since, drop_tables, lean, plain_names, tables_so_far, text_key, utf8, written_table

MIN_WORDS, GRAM = 50, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = 4096
#: Windows of a reach at most, so that a long holds a bit for each; windows further from their position are a reach of their own.
_BITS = 60


@cache
def _powers(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    n = blocks * _STEP
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of any stretch of a text's words."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        up, self.down = _powers(self.n // _STEP + 1)
        h = xxhash.xxh3_64_intdigest
        own = np.fromiter([h(w) for w in words], np.uint64, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: self.n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return (raw ^ (raw >> np.uint64(31))) * _MIX


def select(text: bytes, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Selected positions as (first window, last window, hash of the gram, hash of the reach)."""
    if len(text) < 2 * min_words - 1:
        return None
    h = Hashes(text)
    if h.n < min_words:
        return None
    at = np.arange(h.n - gram + 1)
    grams = h.of(at, at + gram)
    width = min_words - gram + 1
    window = np.arange(h.n - min_words + 1)
    chosen = window + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1)
    part = (chosen - window) // _BITS  # the same for equal windows
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])]))
    last = np.append(new[1:] - 1, len(chosen) - 1)
    place = chosen[new]
    reach = h.of(new, last + min_words)
    # The place within the reach and its length belong to what is compared.
    reach = (reach ^ ((place - new).astype(np.uint64) << np.uint64(8)) ^ (last - new).astype(np.uint64)) * _BASE
    return new, last, grams[place] + part[new].astype(np.uint64) * _MIX, reach ^ (reach >> np.uint64(29))


def _suffixes(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [select(t, min_words, gram) for t in utf8(batch.column(2))]
            have = [i for i, x in enumerate(found) if x]
            if have:
                first, last, g, r = (np.concatenate([found[i][k] for i in have]) for k in range(4))
                of = pa.array(np.repeat(have, [len(found[i][0]) for i in have]))
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(r.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "at", "windows", "gram", "reach"])

    return docs.mapInArrow(lean(run), f"id {docs.schema['id'].dataType.simpleString()}, key long, at int, windows int, gram long, reach long")


def _windows(asked: DataFrame, min_words: int) -> DataFrame:
    """A row for each window of the reaches asked for (id, key, text, reaches)."""

    def run(batches):
        for batch in batches:
            for i, (text, reaches) in enumerate(zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                h = Hashes(text)
                size = [r["windows"] for r in reaches]
                start = np.concatenate([np.arange(r["at"], r["at"] + r["windows"]) for r in reaches])
                place = start - np.repeat([r["at"] for r in reaches], size)
                of = pa.array(np.full(len(start), i))
                columns = [pa.array(h.of(start, start + min_words).view(np.int64))]
                columns += [pa.array(np.repeat(np.array([r[name] for r in reaches], np.int64), size)) for name in ("gram", "reach")]
                columns += [pa.array(np.repeat(np.array([r["many"] for r in reaches], bool), size)), pa.array(place.astype(np.int32))]
                columns += [batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "gram", "reach", "many", "place", "id", "key", "at"])

    return asked.mapInArrow(lean(run), f"window long, gram long, reach long, many boolean, place int, id {asked.schema['id'].dataType.simpleString()}, key long, at int")


def _place(at: str = "at") -> F.Column:
    """Where a window stands, in the order of documents and positions."""
    return F.struct(F.col("id").isNull().alias("missing"), F.col("id").alias("id"), F.col("key").alias("key"), F.expr(at).alias("at"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """id_col, start_word, end_word, keep, first_id, text_key: the stretches of repeated windows.

    keep is true for those that are the first of their kind, false for those that repeat an earlier
    one; first_id is the smallest of the ids that come first for the suffixes concerned. text_key
    tells documents of one id apart.
    """
    if not 0 < gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    spark, mark = docs.sparkSession, tables_so_far()
    bounded_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"), text.alias("text")).where("text is not null")
    # Written: the suffixes are found once, both sides of the join are dealt by it alone, and the rows of a very common gram can be split.
    all_ = written_table(_suffixes(src, min_words, gram))
    beside = written_table(all_.groupBy("gram").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("gram"))
    suffixes = written_table(all_.join(beside, "gram", "left_semi"))
    drop_tables(all_, beside)
    # One row for each different reach, which keeps its first place; a great many copies add up before the shuffle.
    reaches = suffixes.groupBy("gram", "reach").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.min("windows").alias("windows"))
    reaches = written_table(reaches.withColumn("many", F.col("first") != F.col("last")).drop("last"))
    kinds = written_table(reaches.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")))
    near = reaches.join(kinds, "gram")
    full = F.expr("shiftleft(1L, windows) - 1")
    alike = near.where("kinds = 1 and many").select("gram", "reach", "many", "first", full.alias("repeated"), full.alias("own"), F.col("first.id").alias("first_id"))
    # Where neighbours differ: extend by the windows of one text for each reach.
    asked = near.where("kinds > 1").select(F.col("first.id").alias("id"), F.col("first.key").alias("key"), F.struct(F.col("first.at").alias("at"), "windows", "gram", "reach", "many").alias("r"))
    asked = asked.groupBy("id", "key").agg(F.collect_list("r").alias("reaches")).toDF("asked_id", "asked_key", "reaches")
    texts = src.join(asked, (F.col("key") == F.col("asked_key")) & F.col("id").eqNullSafe(F.col("asked_id"))).select("id", "key", "text", "reaches")
    windows = written_table(_windows(texts, min_words))
    known = windows.groupBy("window").agg(F.max("many").alias("many"), F.min(_place()).alias("start"), F.max(_place()).alias("last"))
    known = written_table(known.where("many or start <> last").select("window", "start"))
    bit = F.expr("shiftleft(1L, place)")
    extended = (
        windows.join(known, "window")
        .groupBy("gram", "reach")
        .agg(F.max("many").alias("many"), F.min(_place("at - place")).alias("first"), F.bit_or(bit).alias("repeated"), F.bit_or(F.when(_place() == F.col("start"), bit).otherwise(F.lit(0).cast("long"))).alias("own"), F.min("start.id").alias("first_id"))
    )
    found = written_table(alike.unionByName(extended))
    at_first = _place() == F.col("first")
    marks = [
        "id", "key", "at", "first_id", F.when(at_first, F.expr("repeated & ~own")).otherwise(F.col("repeated")).alias("cut"),
        F.when(at_first, F.col("own")).otherwise(F.lit(0).cast("long")).alias("keep"),
    ]
    # Most reaches have one place, which they name; only the places of the others are looked up.
    alone = found.where("not many").withColumns({n: F.col(f"first.{n}") for n in ("id", "key", "at")}).select(*marks)
    members = alone.unionByName(suffixes.join(found.where("many"), ["gram", "reach"]).select(*marks))
    # A document's marks are as many as its suffixes; rows that repeat it add none.
    by_doc = members.groupBy("id", "key").agg(F.collect_set(F.struct("at", "cut", "keep", "first_id")).alias("marks"))
    kind = src.schema["id"].dataType.simpleString()
    drop_since(spark, mark, suffixes, found)

    def run(batches):
        for batch in batches:
            of, rows = [], []
            for i, marks in enumerate(batch.column(2).to_pylist()):
                for keep in (False, True):
                    for span in _spans(marks, "keep" if keep else "cut", min_words):
                        of.append(i)
                        rows.append((*span[:2], keep, span[2]))
            if of:
                start, end, keep, first = zip(*rows, strict=True)
                at = pa.array(of)
                columns = [batch.column(0).take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(keep, pa.bool_()), pa.array(first, batch.column(0).type), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start_word", "end_word", "keep", "first_id", "text_key"])

    return by_doc.mapInArrow(lean(run), f"`{id_col}` {kind}, start_word int, end_word int, keep boolean, first_id {kind}, text_key long")


def _spans(marks: list[dict], which: str, min_words: int) -> list[list]:
    """The union of the marked windows of one text."""
    out: list[list] = []
    for m in sorted((m for m in marks if m[which]), key=lambda m: m["at"]):
        bits = m[which]
        while bits:
            low = (bits & -bits).bit_length() - 1
            start = m["at"] + low
            run = bits >> low
            n = ((~run) & (run + 1)).bit_length() - 1  # ones in a row
            bits &= ~(((1 << n) - 1) << low)
            end = start + n - 1 + min_words
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
                out[-1][2] = min((x for x in (out[-1][2], m["first_id"]) if x is not None), default=None)
            else:
                out.append([start, end, m["first_id"]])
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between the other words stays."""
    if not spans:
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(at, starts[a])])
        at = max(at, starts[b])
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """All rows and columns of docs, with each repeated passage left in its first place only."""
    plain, at = plain_names(docs), docs.columns.index(text_col)
    id_, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    names = plain.columns
    spans = repeats(plain, id_, text, min_words, gram).where("not keep").groupBy(F.col(id_).alias("id"), F.col("text_key").alias("key")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    joined = plain.join(spans, F.col(id_).eqNullSafe(F.col("id")) & (text_key(F.col(text)) == F.col("key")), "left").drop("id", "key")

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            if any(spans):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                new = [cut_text(t, [(s["start_word"], s["end_word"]) for s in x]) if x else t for t, x in zip(texts, spans, strict=True)]
                column = pa.array(new, pa.binary()).cast(pa.string())
            else:
                column = batch.column(at)
            columns = [column if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)

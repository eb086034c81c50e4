"""SimHash near-duplicate groups.

A text's fingerprint has 64 bits, each set where more than half of the shingles' XXH64 hashes
have it. Two fingerprints that differ in d bits have popcounts per segment whose Manhattan
distance is at most d. So the fingerprints are laid on the grid of their segment popcounts, and
only those with another one within that distance go on to the exact comparison of bits.

Both steps meet in the middle: two points of the grid within distance 2 share a point within
distance 1 of each, and so do two fingerprints in the space of bits. No pair is ever emitted,
so the work is linear in the distinct fingerprints, whatever the size of a group of copies.

keep_one() takes another rule, a similarity of 0.8 or more of the sets of five-word shingles. Fingerprints
of such texts differ in up to some 20 bits, a distance within which the popcounts of unlike texts lie too,
so lindero.llm.similar finds them by what their sets share (the README has the figures).

Nulls and edge cases: null and blank texts have fingerprint zero, which links like any other; a
text of fewer words than a shingle is one shingle; equal texts share a fingerprint and hence a
component; rows with a null id get the component of the ids they link with, or null; an empty
table gives an empty result; other columns are not read. keep_one() tells rows apart by id and text:
rows that repeat both are one document, and a null id counts as larger than all others.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm import similar
from lindero.llm.common import drop_since, map_texts, plain_names, tables_so_far, text_key, written_table
from lindero.llm.graph import components

#: Two bits a segment: 32 segments, each with a popcount of 0, 1 or 2.
SEGMENTS = 32
#: The seed of XXH64.
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = text.lower().split()  # on bytes: A-Z only, and the ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(line, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = start[shingle - 1 :] + size[shingle - 1 :]
    hashes = np.fromiter([h(line[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())], np.uint64, n - shingle + 1)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col and fp, the fingerprint's 64 bits as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, [id_col], text_col, "fp long", make)


def _popcounts(fp: F.Column) -> F.Column:
    """The popcounts of the 32 two-bit segments, side by side in a long: of each segment the sum of its bits."""
    half, low = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    return fp.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _grid() -> F.Column:
    """The point's own cell and those within distance 1; null where a count would leave 0 to 2."""
    own, near = F.col("own"), [F.col("own")]
    for i in range(SEGMENTS):
        count = F.shiftrightunsigned(own, 2 * i).bitwiseAND(F.lit(3))
        # 0 <-> 1 flips the low bit; 1 <-> 2 flips both.
        low, both = (own.bitwiseXOR(F.shiftleft(F.lit(x).cast("long"), 2 * i)) for x in (1, 3))
        near += [F.when(count == 0, low).when(count == 1, both), F.when(count == 1, low).when(count == 2, both)]
    return F.array(*near)


def _flips() -> F.Column:
    """The fingerprint and the 64 that differ in one bit."""
    return F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")


def candidates(distinct: DataFrame) -> DataFrame:
    """The fingerprints that have another one within Manhattan distance 2 of their segment popcounts."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = distinct.repartition(parts, "fp").select("fp", _popcounts(F.col("fp")).alias("own")).select("fp", F.explode(_grid()).alias("cell")).where("cell is not null")
    shared = cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("cell")
    return cells.join(shared, "cell", "left_semi").select("fp").distinct()


def links(found: DataFrame) -> DataFrame:
    """Edges (fp, hub) between distinct fingerprints of at most 2 differing bits; they connect just what the links connect.

    All fingerprints that share a value within one bit are within two bits of each other, so a
    star around the smallest stands for all their pairs. At most 65 can share a value.
    """
    near = found.select("fp", F.explode(_flips()).alias("value"))
    group = near.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = group.select(F.explode("fps").alias("fp"), F.array_min("fps").alias("hub"))
    return star.where("fp <> hub").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the smallest id that can be reached over links of 2 bits or fewer)."""
    mark = tables_so_far()
    rows = written_table(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"))
    first = written_table(rows.groupBy("fp").agg(F.min("id").alias("first")))
    labels = components(links(candidates(first.select("fp"))))
    named = labels.join(first, "fp")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    merged = named.join(least, "label").select("fp", "least")
    # Both sides of the last join come from files, so that a fingerprint of very many copies can be split.
    home = written_table(first.join(merged, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    drop_since(docs.sparkSession, mark, rows, home)
    return rows.join(home, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """All columns of docs, of each group of texts that similarity links only the row that comes first by id and text."""
    plain = plain_names(docs)
    text, id_ = (F.col(f"c{docs.columns.index(c)}") for c in (text_col, id_col))
    # Cast, so that the parts may be null here as they may where the rows are read back: else the join would not see one type.
    kind = f"struct<missing:boolean,id:{docs.schema[id_col].dataType.simpleString()},key:bigint>"
    rows = plain.withColumn("row", F.struct(id_.isNull(), id_, text_key(text)).cast(kind))
    groups = similar.near_duplicates(rows.select("row", text.alias("text")), "row", "text", shingle, similarity)
    first = groups.where("row = component_id").select("row").distinct()
    # Both steps deal the texts by row, so they are shuffled once; an inner join, since a semi-join would go before the first step.
    return rows.dropDuplicates(["row"]).join(first, "row").drop("row").toDF(*docs.columns)

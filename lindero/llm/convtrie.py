"""The prefix trie of conversations, by Patricia construction, with figures for each of its nodes.

A turn becomes a key of 16 bytes, a hash of its role and text; a conversation is the string of its keys. The strings
are sorted over all tasks, each of which goes through its part once with a stack. Neighbours tell where the tree
branches, so only points are made: branches, ends and leaves, each with the edge above it, which is compressed.
Figures come together on the points; nodes with one child, on the edges, are expanded afterwards from the sums of the
sizes below them on their edge.

A node whose conversations lie in several parts is a prefix of those next to a part's border, no longer than what the
two beside the border share. Each of the parts makes it a point, and all its figures add up over the parts: a node counts as
a child, and its size as one that is needed, only in the first of its parts, a leaf only in its last. So a first
turn that very many conversations share is counted where they lie, and only its sums meet.

Nulls and edge cases: rows without a conversation's id take no part; a null turn comes first, turns of equal numbers are ordered
by role and text and all count; a null role or text is empty; roles and texts are told apart by 128 bits of SHA-256; an
empty table gives an empty result, without a root; other columns, whatever their names, are not read. The turns of one
conversation are put in order by one task, as a stream, and their keys and sizes, 24 bytes a turn, are one row.
The ids that end at one node are hashed by one task as a stream, since their hash takes them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_since, tables_so_far, written_table

#: Bytes of a turn's key and of its size.
KEY, SIZE = 16, 8
#: Ids that end at a node and are kept before they are hashed and given out, and rows of a batch that is given out.
IDS, ROWS = 4096, 2000
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id, keys (KEY bytes a turn, in order) and sizes (code points, SIZE bytes a turn, little-endian)."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{turn_col}`").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text")).where("id is not null")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ordered = rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text")
    ordered = ordered.select("id", F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * KEY)).alias("key"), F.length("text").cast("long").alias("size"))

    def gather(batches):
        now, keys, sizes, done = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            each = batch.column(1).to_pylist()
            starts = [0, *(1 + np.flatnonzero(ids[1:] != ids[:-1])).tolist(), len(ids)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if ids[a] != now:
                    if now is not None:
                        done.append((now, b"".join(keys), b"".join(sizes)))
                    now, keys, sizes = int(ids[a]), [], []
                keys += each[a:b]
                sizes.append(size[a:b].astype("<i8").tobytes())
            if len(done) >= ROWS:
                yield _batch(done)
                done = []
        if now is not None:
            yield _batch([*done, (now, b"".join(keys), b"".join(sizes))])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["id", "keys", "sizes"])

    bounded_batches(conversations.sparkSession, ROWS)
    return ordered.mapInArrow(gather, "id long, keys binary, sizes binary")


def crossed(found: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of the conversation that the id, rounded to a multiple of every, names; h is the id's CRC-32 modulo most."""
    heads = found.where(F.col("id") % every == 0).select(F.col("id").alias("head"), F.expr(f"substring(keys, 1, {KEY * most})").alias("head_keys"), F.expr(f"substring(sizes, 1, {SIZE * most})").alias("head_sizes"))
    own = found.withColumns({"h": (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int"), "head": F.col("id") - F.col("id") % every})
    put = lambda c, n: F.expr(f"concat(coalesce(substring(head_{c}, 1, {n} * h), x''), substring({c}, {n} * h + 1))").alias(c)
    return own.join(heads, "head", "left").select("id", put("keys", KEY), put("sizes", SIZE))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    at = 0
    while at < 8:  # most that differ do so early
        if a[at * KEY : at * KEY + KEY] != b[at * KEY : at * KEY + KEY]:
            return at
        at += 1
    kind = np.dtype(f"V{KEY}")
    return int(np.flatnonzero(np.frombuffer(a, kind, n) != np.frombuffer(b, kind, n))[0])


def _borders(table: DataFrame) -> dict[int, tuple[int, int]]:
    """For each part how many turns its first sequence shares with the last one before, and its last with the next; -1 where there is none."""
    ends = table.groupBy("part").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    pairs = ends.select("part", "last", F.lead("first").over(Window.orderBy("part")).alias("next"))  # a row for each part

    def count(batches):
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-1 if b is None else shared_turns(a, b) for a, b in rows], pa.int32())], names=["part", "shared"])

    out, before = {}, -1
    for r in sorted(pairs.mapInArrow(count, "part int, shared int").collect()):  # two numbers a part
        out[r.part] = (before, r.shared)
        before = r.shared
    return out


class _Point:
    """An open point of the compressed tree: what is known of its conversations so far. saved leaves out the point's own size."""

    __slots__ = ("depth", "n", "low", "children", "leaves", "saved", "ids", "sha")

    def __init__(self, depth: int) -> None:
        self.depth, self.n, self.low, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ids: list[int] = []
        self.sha = None

    def hashed(self) -> None:
        if self.ids:
            text = ",".join(map(str, self.ids))
            if self.sha is None:
                self.sha = hashlib.sha256()
            else:
                text = f",{text}"
            self.sha.update(text.encode())
            self.ids = []


#: What a pass gives out: points that lie within a part, what parts know of the others, and ids that end at these.
_CLOSED, _OPEN, _IDS = 0, 1, 2
_ROW = "kind int, key binary, parent binary, depth int, n long, low long, children long, leaves long, saved long, ends string, edge array<long>, ids array<long>"


def _key(keys: bytes, depth: int) -> bytes:
    return xxhash.xxh3_128_digest(keys[: depth * KEY])


def _part(rows: Iterator[tuple[int, bytes, np.ndarray]], before: int, after: int) -> Iterator[tuple]:
    """Rows of _ROW for one part: its sequences (id, keys, sizes) in order, and what the borders share."""
    old = before  # nodes of the current path down to here were met in parts before
    stack = [_Point(d) for d in range(max(before, 0) + 1)]
    path = keys = None  # sums of the sizes, and the keys, down the current sequence

    def close(limit: int, last: bool) -> Iterator[tuple]:
        """Give out the points deeper than limit; last: those down to what the border after the part shares go on in others."""
        while stack[-1].depth > limit:
            p = stack.pop()
            f, e = p.depth, stack[-1].depth
            # A branch on the edge becomes a point; so do, one by one, nodes of the edge that go on after the border.
            on_edge = min(after, f - 1) if last else limit
            if e < on_edge:
                stack.append(_Point(on_edge))
                e = on_edge
            up = stack[-1]
            size = int(path[f] - path[f - 1])
            saved = p.saved + (p.n - (f > old)) * size
            key, parent = _key(keys, f), _key(keys, e)
            if f <= old or last and f <= after:
                if p.ids:
                    yield _IDS, key, None, f, 0, None, 0, 0, 0, None, None, p.ids
                yield _OPEN, key, parent, f, p.n, p.low, p.children, p.leaves, saved, None, [0], None
            else:
                p.hashed()
                yield _CLOSED, key, parent, f, p.n, p.low, p.children, p.leaves, saved, p.sha.hexdigest() if p.sha else _EMPTY, (path[f - 1] - path[e:f]).tolist(), None
            up.n += p.n
            up.low = p.low if up.low is None else min(up.low, p.low)
            up.leaves += p.leaves
            up.children += e + 1 > old
            up.saved += saved + (p.n - 1) * int(path[f - 1] - path[e])

    ahead = next(rows, None)
    while ahead is not None:
        (id_, keys, sizes), ahead = ahead, next(rows, None)
        length = len(sizes)
        path = np.concatenate([[0], np.cumsum(sizes)])
        right = shared_turns(keys, ahead[1]) if ahead is not None else after
        for depth in sorted({min(right, length), length}):
            if depth > stack[-1].depth:
                stack.append(_Point(depth))
        # The sequence's end: the deepest point, since shorter ones come first.
        p = stack[-1]
        p.n, p.low = p.n + 1, id_ if p.low is None else min(p.low, id_)
        p.leaves += right < length
        p.ids.append(id_)
        if len(p.ids) >= IDS:
            yield _IDS, _key(keys, length), None, length, 0, None, 0, 0, 0, None, None, p.ids
            p.hashed()
        if ahead is not None:
            yield from close(right, False)
            old = min(old, right)
    if path is not None:
        yield from close(0, True)
        root = stack[0]
        if root.ids:
            yield _IDS, _key(b"", 0), None, 0, 0, None, 0, 0, 0, None, None, root.ids
        yield _OPEN, _key(b"", 0), None, 0, root.n, root.low, root.children, root.leaves, root.saved, None, [0], None


def _points(table: DataFrame, borders: dict[int, tuple[int, int]]) -> DataFrame:
    """What each part of the sorted table knows, as rows of _ROW."""
    names = [f.name for f in table.sparkSession.createDataFrame([], _ROW).schema]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        def flat():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

        rows, held = flat(), []
        ahead = next(rows, None)
        while ahead is not None:
            part = ahead[0]

            def mine(part=part):
                nonlocal ahead
                while ahead is not None and ahead[0] == part:
                    row, ahead = ahead, next(rows, None)
                    yield row[1], row[2], np.frombuffer(row[3], "<i8")

            for r in _part(mine(), *borders[part]):
                held.append(r)
                if len(held) >= ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    ordered = table.repartition("part").sortWithinPartitions("part", "keys", "id").select("part", "id", "keys", "sizes")
    return ordered.mapInArrow(run, _ROW)


def _ends(chunks: DataFrame) -> DataFrame:
    """key and ends, the hash of all its ids, which come in chunks, in order and with commas between."""

    def run(batches):
        now, sha = None, None
        for b in batches:
            done = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha, sep = key, hashlib.sha256(), ""
                sha.update(f"{sep}{','.join(map(str, ids))}".encode())
                sep = ","
            if done:
                yield _named(done)
        if now is not None:
            yield _named([(now, sha.hexdigest())])

    def _named(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["key", "ends"])

    ordered = chunks.select("key", "ids", F.col("ids")[0].alias("first")).repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return ordered.mapInArrow(run, "key binary, ends string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """A row for each node of the trie of sequences (id, keys, sizes; each id once): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark, mark = found.sparkSession, tables_so_far()
    bounded_batches(spark, ROWS)
    table = written_table(found.repartitionByRange("keys", "id").sortWithinPartitions("keys", "id").withColumn("part", F.spark_partition_id()))
    built = written_table(_points(table, _borders(table)))
    names = ("key", "parent", "depth", "n", "low", "children", "leaves", "saved", "ends", "edge")
    sums = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]]
    opened = built.where(F.col("kind") == _OPEN).groupBy("key").agg(*sums)
    chunks = built.where(F.col("kind") == _IDS).join(opened.select("key"), "key", "left_semi")
    opened = opened.join(_ends(chunks), "key", "left").withColumns({"ends": F.coalesce("ends", F.lit(_EMPTY)), "edge": F.array(F.lit(0).cast("long"))})
    points = written_table(built.where(F.col("kind") == _CLOSED).select(*names).unionByName(opened.select(*names)))
    drop_since(spark, mark, points)
    named = points.join(points.select(F.col("key").alias("parent"), F.col("low").alias("above")), "parent", "left")
    nodes = named.select("depth", "low", "above", "n", "children", "leaves", "saved", "ends", F.size("edge").alias("long"), F.posexplode("edge").alias("at", "sum"))
    end, top = F.col("at") == F.col("long") - 1, F.col("at") == 0
    return nodes.select(
        F.col("low").alias("conv_id"), (F.col("depth") - F.col("long") + 1 + F.col("at")).cast("long").alias("depth"), F.when(top, F.col("above")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("sum")).alias("saved_tokens"), F.when(end, F.col("ends")).otherwise(_EMPTY).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations, each rebuilt with a head of another by crossed()."""
    return prefix_trie(crossed(sequences(conversations)))


def conversation_trie_sql(table: str = "conversations") -> str:
    """The same in SQL: a row for each prefix of each conversation, and for each node under each of those above it."""
    bits = "list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1))))"
    crc = f"xor(list_reduce({bits}, lambda s, b: xor(s >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295)"
    return f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS size FROM {table} WHERE conv_id IS NOT NULL),
o AS (SELECT c, count(*) AS m FROM t GROUP BY c), h AS (SELECT c, m, {crc} % 6 AS h FROM o),
b AS (SELECT h.*, least(h, coalesce(o.m, 0)) AS had FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
r AS (SELECT b.c, t.i AS d, k, size FROM b JOIN t ON t.c = b.c - b.c % 100 AND t.i <= b.h UNION ALL SELECT b.c, t.i - h + had, k, size FROM b JOIN t ON t.c = b.c AND t.i > b.h),
p AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, size, d = count(*) OVER (PARTITION BY c) AS last FROM r UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM r) FROM o),
n AS (SELECT path, d, min(c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM p GROUP BY path, d),
k AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.path = n.path),
s AS (SELECT left(path, 64 * j) AS path, sum((n - 1) * size) AS saved, count(*) FILTER (children = 0) AS leaves FROM w, range(d + 1) g(j) GROUP BY 1)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, u.c AS parent_conv_id, w.n AS n_convs, w.children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN s ON s.path = w.path LEFT JOIN n u ON w.d > 0 AND u.path = left(w.path, 64 * (w.d - 1))"""

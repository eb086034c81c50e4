"""Areas as cells of several sizes, so that points meet only the cells that they lie in.

An area is any number of rings: a point is inside if a ray from it crosses their edges an odd number of times, or if it lies on
an edge. So rings in rings are holes, and areas of several pieces need nothing special. A large area gets large cells inside,
which match without a test, and small ones along its border. A border cell keeps only the edges that meet it and whether its
lower right corner is inside; a point is as inside as that corner, but for the edges that a walk from the corner
up and then left to the point crosses, and these all meet the cell. So no test looks at a whole ring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The side of a cell of level 0 in degrees or other units; each level's side is a quarter of the one before.
SIDE = 64.0
#: The finest level, and how many edges a border cell may have without being split further.
FINEST, EDGES = 9, 16
#: Cells along an area's box, at most, at its first level.
FIRST = 4
#: Where the grid starts. Corners must not lie on edges, whose ends are numbers of few decimals.
_WEST, _SOUTH = -1024.0000001234567, -1024.0000007654321

_EDGE = "struct<ax:double,ay:double,bx:double,by:double>"
_CELL = f"level int, x long, y long, inner boolean, corner boolean, edges array<{_EDGE}>"


def edges_of(rings: list[list[tuple[float, float]]]) -> np.ndarray:
    """ax, ay, bx, by of all edges; a ring that is not closed gets closed."""
    parts = []
    for ring in rings:
        p = np.asarray([(x, y) for x, y in ring], float).reshape(-1, 2)
        if len(p) and (p[0] != p[-1]).any():
            p = np.vstack([p, p[:1]])
        if len(p) > 1:
            parts.append(np.hstack([p[:-1], p[1:]]))
    return np.vstack(parts) if parts else np.empty((0, 4))


def _left(e: np.ndarray, x: float, y: float) -> np.ndarray:
    """Whether the point lies to the left of each edge's line."""
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) - (e[:, 3] - e[:, 1]) * (x - e[:, 0]) > 0


def _inside(e: np.ndarray, x: float, y: float) -> bool:
    spans = (e[:, 1] > y) != (e[:, 3] > y)
    return bool((spans & (_left(e, x, y) == (e[:, 3] > e[:, 1]))).sum() % 2)


def _walk(e: np.ndarray, start: tuple[float, float], end: tuple[float, float]) -> bool:
    """Whether a walk from start up or down to end's height, and then left or right to it, changes sides, by the edges e."""
    at_turn = _left(e, start[0], end[1])
    up = ((e[:, 0] > start[0]) != (e[:, 2] > start[0])) & (_left(e, *start) != at_turn)
    along = ((e[:, 1] > end[1]) != (e[:, 3] > end[1])) & (_left(e, *end) != at_turn)
    return bool((int(up.sum()) + int(along.sum())) % 2)


def _meeting(e: np.ndarray, west: float, south: float, side: float) -> np.ndarray:
    """Which edges may meet a cell; a little more than its borders, as points are rounded into cells."""
    slack = side * 1e-6 + 1e-9
    w, s, ee, n = west - slack, south - slack, west + side + slack, south + side + slack
    near = (np.maximum(e[:, 0], e[:, 2]) >= w) & (np.minimum(e[:, 0], e[:, 2]) <= ee) & (np.maximum(e[:, 1], e[:, 3]) >= s) & (np.minimum(e[:, 1], e[:, 3]) <= n)
    sides = sum(_left(e, x, y).astype(int) for x, y in ((w, s), (w, n), (ee, s), (ee, n)))
    return near & (sides > 0) & (sides < 4) | near & (np.minimum(abs(e[:, 2] - e[:, 0]), abs(e[:, 3] - e[:, 1])) == 0)


def cells_of(rings: list[list[tuple[float, float]]]) -> Iterator[tuple[int, int, int, bool, bool, np.ndarray]]:
    """level, x, y, inner, corner and edges of the cells of one area, which don't overlap."""
    every = edges_of(rings)
    if not len(every):
        return
    xs, ys = every[:, [0, 2]], every[:, [1, 3]]
    size = max(xs.max() - xs.min(), ys.max() - ys.min())
    level = 0
    while level < FINEST and SIDE / 4 ** (level + 1) * FIRST >= size:
        level += 1
    side = SIDE / 4**level
    index = lambda v, start: int(np.floor((v - start) / side))
    todo = []
    for x in range(index(xs.min(), _WEST), index(xs.max(), _WEST) + 1):
        for y in range(index(ys.min(), _SOUTH), index(ys.max(), _SOUTH) + 1):
            corner = _inside(every, _WEST + (x + 1) * side, _SOUTH + y * side)
            todo.append((level, x, y, corner, every[_meeting(every, _WEST + x * side, _SOUTH + y * side, side)]))
    while todo:
        level, x, y, corner, e = todo.pop()
        if not len(e):
            if corner:
                yield level, x, y, True, True, e
        elif len(e) <= EDGES or level == FINEST:
            yield level, x, y, False, corner, e
        else:
            side, fine = SIDE / 4**level, SIDE / 4 ** (level + 1)
            start = (_WEST + (x + 1) * side, _SOUTH + y * side)
            for i in range(4 * x, 4 * x + 4):
                for j in range(4 * y, 4 * y + 4):
                    end = (_WEST + (i + 1) * fine, _SOUTH + j * fine)
                    todo.append((level + 1, i, j, corner ^ _walk(e, start, end), e[_meeting(e, _WEST + i * fine, _SOUTH + j * fine, fine)]))


def cover(areas: DataFrame, rings: str = "rings") -> DataFrame:
    """The other columns of areas with their cells. rings: array<array<struct<x, y>>>; an area is handled whole in a task."""
    keep = [c for c in areas.columns if c != rings]
    points = "array<array<struct<x:double,y:double>>>"
    src = areas.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{rings}`").cast(points).alias("__rings"))
    kind = src.sparkSession.createDataFrame([], _CELL).schema
    out = type(kind)(src.schema.fields[:-1] + kind.fields)
    arrow = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([(n, pa.float64()) for n in ("ax", "ay", "bx", "by")]))]

    def run(batches):
        for batch in batches:
            for i, area in enumerate(batch.column(len(keep)).to_pylist()):
                held = []
                for c in cells_of([[(p["x"], p["y"]) for p in ring] for ring in area or []]):
                    held.append((*c[:5], [dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in c[5].tolist()]))
                    if len(held) == 1000:
                        yield row(batch, i, held)
                        held = []
                if held:
                    yield row(batch, i, held)

    def row(batch, i, held):
        own = [pa.concat_arrays([batch.column(k).slice(i, 1)] * len(held)) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(x, t) for x, t in zip(zip(*held, strict=True), arrow, strict=True)]], names=out.fieldNames())

    return src.mapInArrow(run, out)


def _covers(x: Column, y: Column) -> Column:
    """Whether a cell's area covers a point of the cell, the area's edges included."""
    side = lambda e, px, py: (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
    width = F.lit(SIDE) / F.pow(F.lit(4.0), F.col("level"))
    east, south = F.lit(_WEST) + (F.col("x") + 1) * width, F.lit(_SOUTH) + F.col("y") * width
    on = F.exists("edges", lambda e: (side(e, x, y) == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    turn = lambda e: side(e, east, y) > 0
    up = F.filter("edges", lambda e: ((e["ax"] > east) != (e["bx"] > east)) & ((side(e, east, south) > 0) != turn(e)))
    along = F.filter("edges", lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((side(e, x, y) > 0) != turn(e)))
    odd = (F.size(up) + F.size(along)) % 2 == 1
    return F.col("inner") | on | (F.col("corner") != odd)


def covering(points: DataFrame, cells: DataFrame, key: str, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """key and the areas' columns for each point and each area that covers it. cells: what cover() gives, best from a written table.

    A point meets one cell of each level that occurs, so rows are dealt by cell and a large area is no larger key than a small one.
    """
    levels = [r.level for r in cells.select("level").distinct().collect()]  # ten numbers at most
    have = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py"))
    at = lambda c, start, n: F.floor((F.col(c) - F.lit(start)) / F.lit(SIDE / 4**n)).cast("long")
    places = F.array(*[F.struct(F.lit(n).alias("level"), at("__px", _WEST, n).alias("x"), at("__py", _SOUTH, n).alias("y")) for n in levels])
    spread = have.withColumn("__c", F.explode(places)).select(key, "__px", "__py", "__c.*") if levels else have.where("false").selectExpr(f"`{key}`", "__px", "__py", "0 AS level", "0L AS x", "0L AS y")
    own = [c for c in cells.columns if c not in ("level", "x", "y", "inner", "corner", "edges")]
    return spread.join(cells, ["level", "x", "y"]).where(_covers(F.col("__px"), F.col("__py"))).select(key, *own)


def by_point(points: DataFrame, key: str, find: Callable[[DataFrame], DataFrame], x: str = "longitude", y: str = "latitude") -> DataFrame:
    """key and what find() tells, or null, of the row's point. find() gets each point once, with __point as its key, and returns a row for it at most."""
    each = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).distinct()
    found = find(each.repartition(points.sparkSession.sparkContext.defaultParallelism, x, y).withColumn("__point", F.struct(x, y)))
    told = [c for c in found.columns if c != "__point"]
    return points.select(key, F.col(x).alias("__x"), F.col(y).alias("__y")).join(found.select(F.col("__point")[x].alias("__x"), F.col("__point")[y].alias("__y"), *told), ["__x", "__y"], "left").select(key, *told)


def first_covering(points: DataFrame, areas: DataFrame, key: str, area: str = "area_id", rings: str = "rings") -> DataFrame:
    """key and area, the first (by its id) that covers the point; null where none does."""
    cells = cover(areas.select(area, rings), rings)
    return by_point(points, key, lambda p: covering(p, cells, "__point").groupBy("__point").agg(F.min(area).alias(area)))


def layers_of(points: DataFrame, layers: dict[str, DataFrame], key: str, area: str = "area_id", rings: str = "rings") -> DataFrame:
    """key and a column for each layer: the first of its areas that covers the point. All layers are met in one pass over the points."""
    united = None
    for name, areas in layers.items():
        part = areas.select(F.lit(name).alias("layer"), F.col(area).alias("area"), F.col(rings).alias("rings"))
        united = part if united is None else united.unionByName(part)
    cells, firsts = cover(united), [F.min(F.when(F.col("layer") == n, F.col("area"))).alias(n) for n in layers]
    return by_point(points, key, lambda p: covering(p, cells, "__point").groupBy("__point").agg(*firsts))

import datetime
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lindero.operators import cover
from lindero.sources import shapefile


def inside(rings, x, y):
    """The even-odd rule over all edges, edges included, in plain Python."""
    odd = False
    for ring in rings:
        ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and (cross > 0) == (by > ay):
                odd = not odd
    return odd


def star(r, x, y, size, n):
    """A ring with n corners about a point."""
    turns = sorted(r.random() for _ in range(n))
    ring = [(x + size * (0.3 + 0.7 * r.random()) * math.cos(2 * math.pi * t), y + size * (0.3 + 0.7 * r.random()) * math.sin(2 * math.pi * t)) for t in turns]
    return [*ring, ring[0]]


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def areas_frame(spark, areas):
    data = [(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings is not None else None) for i, rings in areas]
    return spark.createDataFrame(data, "area_id int, rings array<array<struct<x: double, y: double>>>")


def test_points_in_areas_with_holes_and_of_all_sizes(spark):
    r = random.Random(4)
    areas = [(50 + i, [star(r, r.uniform(-100, -98), r.uniform(18, 20), 10 ** r.uniform(-3, 0), r.choice([3, 8, 200, 1500]))]) for i in range(40)]
    areas += [(1, [square(-99, 19, 1), square(-98.75, 19.25, 0.5), square(-98.6, 19.4, 0.1)])]  # a piece in a hole
    areas += [(2, [square(-99.5, 18.2, 0.25), star(r, -97, 18, 0.1, 30)])]  # two pieces
    areas += [(3, [square(-99.75, 18.0, 0.001)]), (200, [square(-110, 10, 30)]), (4, None), (5, []), (6, [[(1.0, 1.0)]])]
    points = [(i, r.uniform(-100.5, -96.5), r.uniform(17.5, 20.5)) for i in range(1500)]
    points += [(2000 + i, x, y) for i, (x, y) in enumerate([(-99.0, 19.0), (-98.75, 19.4), (-98.5, 19.25), (-98.55, 19.45), (-98.7, 19.3), (-99.75, 18.0), (-99.7495, 18.0005), (-110.0, 40.0), (-120.0, 10.0)])]
    points += [(3000 + i, *areas[i][1][0][0]) for i in range(40)]  # on a corner
    points += [(4000, None, 19.0), (4001, -99.0, None)]
    df = spark.createDataFrame(points, "id int, longitude double, latitude double").repartition(5)
    frame = areas_frame(spark, areas)
    got = {(x.id, x.area_id) for x in cover.covering(df, cover.cover(frame), "id").collect()}
    want = {(i, a) for i, x, y in points if x is not None and y is not None for a, rings in areas if rings and inside([g for g in rings if len(g) > 1], x, y)}
    assert got == want and len(want) > 2000
    first = {x.id: x.area_id for x in cover.first_covering(df, frame, "id").collect()}
    assert first == {i: min((a for j, a in want if j == i), default=None) for i, _, _ in points}


def test_large_areas_get_few_large_cells(spark):
    """An area a thousand times as wide as others gets large cells inside, and its border's cells few edges."""
    cells = list(cover.cells_of([star(random.Random(1), 0, 0, 10, 3000)]))
    inner = [c for c in cells if c[3]]
    assert inner and min(c[0] for c in inner) <= 3 and max(len(c[5]) for c in cells if c[0] < cover.FINEST) <= cover.EDGES
    assert len(list(cover.cells_of([square(0, 0, 10)]))) < 60
    areas = areas_frame(spark, [(1, [square(0, 0, 10)]), (2, [square(3, 3, 0.01)])])
    layers = cover.layers_of(spark.createDataFrame([(1, 3.005, 3.005), (2, 9.0, 9.0), (3, 11.0, 1.0)], "id int, longitude double, latitude double"), {"large": areas.where("area_id = 1"), "small": areas.where("area_id = 2")}, "id")
    assert {tuple(x) for x in layers.collect()} == {(1, 1, 2), (2, 1, None), (3, None, None)}
    assert cover.first_covering(spark.createDataFrame([(1, 1.0, 1.0)], "id int, longitude double, latitude double"), areas.where("false"), "id").collect() == [(1, None)]


def write_shapefile(base, shapes, rows, page=None, encoding="latin-1"):
    """A shapefile of polygons, written by the format's rules: shapes are lists of rings, or None."""
    body, index, at = b"", b"", 100
    for n, rings in enumerate(shapes):
        points = [p for r in rings or [] for p in r]
        if rings is None:
            shape = struct.pack("<i", 0)
        else:
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            shape = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", n + 1, len(shape) // 2) + shape
        index += struct.pack(">2i", at // 2, len(shape) // 2)
        at += 8 + len(shape)
    head = lambda n: struct.pack(">i20xi", 9994, n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (base.with_suffix(".shp")).write_bytes(head(100 + len(body)) + body)
    (base.with_suffix(".shx")).write_bytes(head(100 + len(index)) + index)
    fields = [(b"NAME", b"C", 12, 0), (b"POP", b"N", 9, 0), (b"AREA", b"N", 12, 3), (b"DAY", b"D", 8, 0), (b"OK", b"L", 1, 0)]
    described = b"".join(struct.pack("<11sc4xBB14x", *f) for f in fields)
    table = b"".join(r[0] + b"".join(v.encode(encoding)[:w].ljust(w) for v, (_, _, w, _) in zip(r[1:], fields, strict=True)) for r in rows)
    (base.with_suffix(".dbf")).write_bytes(struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 33 + len(described), 1 + sum(f[2] for f in fields)) + described + b"\r" + table)
    if page:
        base.with_suffix(".cpg").write_text(page)


@pytest.mark.parametrize("page,encoding", [(None, "latin-1"), ("ANSI 1252", "cp1252"), ("UTF-8", "utf-8"), ("ISO 88591", "latin-1")])
def test_shapefile_in_ranges(spark, tmp_path, page, encoding):
    shapes = [[square(i, 0, 1), square(i + 0.25, 0.25, 0.5)] if i % 3 else [square(i, 5, 1)] for i in range(23)]
    shapes[4] = None
    name = "Cañón 3" + (" €" if encoding == "cp1252" else "")
    rows = [(b" ", name, str(i), f"{i / 8:.3f}", "20240229", "T" if i % 2 else "F") for i in range(23)]
    rows[5], rows[6], rows[20] = (b"*", *rows[5][1:]), (b" ", "", "", "", "", "?"), (b" ", "x", "*********", "****", "0000", "")
    write_shapefile(tmp_path / "a", shapes, rows, page, encoding)
    shapefile.register(spark)
    df = spark.read.format("shapefile").option("rows", 5).load(str(tmp_path / "a.shp"))
    assert df.rdd.getNumPartitions() == 5
    got = {r.record: r for r in df.collect()}
    assert set(got) == set(range(23)) - {5}
    for i, r in got.items():
        assert r.rings == (None if shapes[i] is None else [[(float(x), float(y)) for x, y in ring] for ring in shapes[i]]) and r.kind == (0 if shapes[i] is None else 5)
        if i == 6:
            assert r[3:] == (None,) * 5
        elif i == 20:
            assert r[3:] == ("x", None, None, None, None)
        else:
            assert r[3:] == (name, i, i / 8, datetime.date(2024, 2, 29), bool(i % 2))
    assert dict(df.dtypes)["POP"] == "bigint" and dict(df.dtypes)["AREA"] == "double"
    near = spark.read.format("shapefile").option("box", "9.5,-1,11.5,2").load(str(tmp_path))
    assert {r.record for r in near.collect()} == {10, 11}  # 9 lies farther north


def test_shapefile_is_written_and_read_again(spark, tmp_path):
    data = [(i, f"área {i}" if i % 4 else None, i / 7, [[(float(x), float(y)) for x, y in square(i, i, 1)]] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(data, "id long, name string, size double, rings array<array<struct<x: double, y: double>>>").repartition(3)
    shapefile.register(spark)
    folder = str(tmp_path / "out")
    for _ in range(2):
        df.write.format("shapefile").mode("overwrite").save(folder)
    back = spark.read.format("shapefile").load(folder)
    assert sorted(back.select("id", "name", "size", "rings").collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
    found = cover.first_covering(spark.createDataFrame([(1, 7.5, 7.5), (2, 10.5, 10.5)], "key int, longitude double, latitude double"), back, "key", "id")
    assert {r.key: r.id for r in found.collect()} == {1: 7, 2: None}


def test_a_shapefile_needs_its_index(spark, tmp_path):
    write_shapefile(tmp_path / "a", [[square(0, 0, 1)]], [(b" ", "x", "1", "1", "20240101", "T")])
    (tmp_path / "a.shx").unlink()
    shapefile.register(spark)
    with pytest.raises(Exception, match="index"):
        spark.read.format("shapefile").load(str(tmp_path / "a.shp")).collect()


def test_points_are_looked_up_once(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(20)] + [(20, None, 1.0)], "id int, longitude double, latitude double")
    seen = []
    got = cover.by_point(df, "id", lambda p: seen.append(p.count()) or p.select("__point", F.col("longitude").alias("x")))
    assert seen == [2] and {tuple(r) for r in got.collect()} == {(i, float(i % 2)) for i in range(20)} | {(20, None)}

import glob
import json
import os
import random

from pyspark.sql import functions as F

from lindero.sources import bundles
from lindero.streaming import ingest


def test_a_small_box_reads_few_files(spark, tmp_path):
    r = random.Random(1)
    data = [(i, r.uniform(-100, -98), r.uniform(18, 20)) for i in range(4000)] + [(4000, None, 19.0), (4001, -99.0, None), (4002, -200.0, 95.0)]
    df = spark.createDataFrame(data, "id int, longitude double, latitude double").repartition(3)
    path = str(tmp_path / "b")
    for _ in range(2):
        bundles.write_bundle(df, path, 32)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/rows").collect()), key=repr) == sorted(data, key=repr)
    total = len(glob.glob(f"{path}/rows/*.parquet"))
    box = (-99.1, 18.9, -99.0, 19.0)
    found = bundles.files_of(spark, path, box)
    assert total > 20 and 1 <= len(found) <= 6
    inside = {i for i, x, y in data if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {x.id for x in bundles.read_box(spark, path, box).collect()} == inside and len(inside) > 3
    assert bundles.read_box(spark, path, (10, 10, 11, 11)).count() == 0


def test_the_curve_interleaves_bits(spark):
    side = bundles.SPAN / (1 << bundles.BITS)
    points = [(x, y, sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(20))) for x, y in [(0, 0), (1, 0), (0, 1), (5, 3), ((1 << 20) - 1, 12345)]]
    df = spark.createDataFrame([((x + 0.5) * side - 180, (y + 0.5) * side - 180, z) for x, y, z in points], "x double, y double, z long")
    assert df.where(bundles.z_order(F.col("x"), F.col("y")) != F.col("z")).count() == 0


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "snap")
    src.mkdir()

    def run(n, rows):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "at": f"2024-01-{d:02d}T00:00:00", "v": v}) for k, d, v in rows))
        stream = spark.readStream.schema("k string, at timestamp, v int").json(str(src))
        ingest.upsert_into(spark, stream, out, ["k"], "at", str(tmp_path / "cp"), buckets=8).awaitTermination(120)

    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{out}/data/**/*.parquet", recursive=True)}
    run(0, [(f"k{i}", 1, i) for i in range(100)])
    first = files()
    run(1, [("k3", 2, 300), ("k3", 1, 301), ("new", 1, 7)])
    second = files()
    kept = set(first) & set(second)
    assert len(kept) >= 6 and all(first[f] == second[f] for f in kept)
    rows = {r.k: r.v for r in ingest.snapshot(spark, out).collect()}
    assert rows == {f"k{i}": i for i in range(100)} | {"k3": 300, "new": 7}
    run(2, [("k3", 1, 5)])  # what arrives later counts, as in any upsert
    run(3, [("k4", 9, 44)])
    assert {r.k: r.v for r in ingest.snapshot(spark, out).collect()} == rows | {"k3": 5, "k4": 44}
    live = {f for d in ingest.manifest(spark, out)[1].values() for f in glob.glob(f"{out}/{d}/*.parquet")}
    assert len(live) < len(files()) <= len(live) + 4  # of replaced buckets only those of the version before are kept

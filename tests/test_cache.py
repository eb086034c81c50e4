import json

from lindero.streaming import cache

SCHEMA = "key string, at timestamp, payload string"


def test_entries_run_out(spark, tmp_path):
    """Batches in turn, each a file: an entry is fresh, then stale, then gone from the state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    batches = [
        [("a", "10:00:00", "one"), ("a", "10:00:00", None), ("a", "09:59:59", None), ("b", "10:00:00", None)],
        [("a", "10:01:00", None), ("a", "10:01:01", None), ("a", "10:01:02", "two"), ("a", "10:01:02", None), ("b", "10:01:00", "x"), ("b", "10:00:30", "old"), ("b", "10:01:10", None)],
        [("a", "10:10:00", None), ("c", "10:30:00", "late")],
        [("c", "10:30:01", None)],
        [("a", "10:31:00", None), ("c", "10:31:30", None)],
    ]
    try:
        for i, rows in enumerate(batches):
            (src / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "at": f"2024-01-01T{t}", "payload": p}) for k, t, p in rows))
            stream = spark.readStream.schema(SCHEMA).json(str(src))
            out = cache.answers(stream, 60, 600)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    got = sorted((r.key, r.at.strftime("%H:%M:%S"), r.payload or "", r.stale or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", "09:59:59", "", ""), ("a", "10:00:00", "one", "one"), ("a", "10:01:00", "one", "one"), ("a", "10:01:01", "", "one"), ("a", "10:01:02", "two", "two"), ("a", "10:10:00", "", "two"), ("a", "10:31:00", "", ""),
        ("b", "10:00:00", "", ""), ("b", "10:01:10", "x", "x"), ("c", "10:30:01", "late", "late"), ("c", "10:31:30", "", "late"),
    ]

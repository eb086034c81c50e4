"""The incremental ingest as a stream: pages that arrive are parsed once and taken into the snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lindero.operators.stored import cut
from lindero.operators.upsert import upsert
from lindero.operators.windows import first_of


def new_pages(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once; state older than the lateness is dropped."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Rows and mean value by window and key, given out when a window can't change any more."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), key, "n", "mean_value")


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, dict[int, str]]:
    """The snapshot's last version (of those before one, if given) and, for each bucket that has rows, its folder within the snapshot's; -1 and none where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    versions = [v for v in (int(n[8:]) for n in names if n.startswith("version=")) if before is None or v < before]
    if not versions:
        return -1, {}
    rows = spark.read.schema("bucket int, place string").json(f"{folder}/manifest/version={max(versions)}").collect()  # a row for each bucket
    return max(versions), {r.bucket: r.place for r in rows}


def snapshot(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the last version, or of some of its buckets; None where there are none."""
    _, places = manifest(spark, folder, before)
    wanted = [f"{folder}/{p}" for b, p in sorted(places.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*wanted) if wanted else None


def upsert_into(spark: SparkSession, stream: DataFrame, folder: str, keys: list[str], recency: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64) -> StreamingQuery:
    """Each batch makes the next version of a snapshot, whose rows lie in buckets by a hash of their keys: only buckets that the batch touches are written again.

    A version is a manifest that names each bucket's folder. It is written last, so readers see a batch whole or not at all, and a batch
    that runs again starts from the version before it and writes its folders again. What the last two versions don't name is removed.
    """

    def take(batch: DataFrame, number: int) -> None:
        new = first_of(transform(batch), keys, [F.desc(recency)]).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        new = cut(new)
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # as many numbers as buckets at most
        _, places = manifest(spark, folder, number)
        old = snapshot(spark, folder, number, touched)
        rows = new.drop("__bucket")
        if old is not None:
            rows = upsert(old, rows, keys, recency)
        data = f"data/batch={number}"
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{data}")
        now = places | {b: f"{data}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, place string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest/version={number}")
        _tidy(spark, folder, number, set(now.values()) | set(places.values()))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tidy(spark: SparkSession, folder: str, number: int, named: set[str]) -> None:
    """Remove what neither this version nor the one before names."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
    system = path("data").getFileSystem(conf)
    last = manifest(spark, folder, number)[0]
    for v in system.listStatus(path("manifest")):
        if v.getPath().getName() not in (f"version={number}", f"version={last}"):
            system.delete(v.getPath(), True)
    for batch in system.listStatus(path("data")):
        for bucket in system.listStatus(batch.getPath()):
            if bucket.isDirectory() and f"data/{batch.getPath().getName()}/{bucket.getPath().getName()}" not in named:
                system.delete(bucket.getPath(), True)

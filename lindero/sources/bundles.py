"""Bundles: tables of placed rows laid out by place, so that a box reads few of their files.

Rows are dealt over files along a Z-order curve of their coordinates, so a file's rows lie close together. Beside the files
lies a small table with each file's box and number of rows. Rows without a place come last on the curve, in files of their own box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a coordinate on the curve, and what it is spread over, in degrees.
BITS, SPAN = 20, 360.0
_BOX = "file string, rows long, west double, south double, east double, north double"


def _spread(c: Column) -> Column:
    """The bits of a number of up to 32 bits, each with a zero before it."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_order(x: Column, y: Column) -> Column:
    """A point's place on the curve; null where a coordinate is."""
    step = lambda c: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((c + SPAN / 2) / SPAN * (1 << BITS)))).cast("long")
    return F.when(x.isNotNull() & y.isNotNull(), _spread(step(x)).bitwiseOR(F.shiftleft(_spread(step(y)), 1)))


def write_bundle(df: DataFrame, path: str, files: int, x: str = "longitude", y: str = "latitude") -> None:
    """path/rows, in about so many files, and path/boxes."""
    spark = df.sparkSession
    ordered = df.withColumn("__z", z_order(F.col(x), F.col(y))).repartitionByRange(files, F.asc_nulls_last("__z")).sortWithinPartitions(F.asc_nulls_last("__z")).drop("__z")
    ordered.write.mode("overwrite").parquet(f"{path}/rows")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")
    edges = [f(F.col(c).cast("double")).alias(n) for n, f, c in (("west", F.min, x), ("south", F.min, y), ("east", F.max, x), ("north", F.max, y))]
    written = spark.read.parquet(f"{path}/rows").select(name, x, y)
    written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *edges).coalesce(1).write.mode("overwrite").json(f"{path}/boxes")  # a row for each file


def files_of(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> list[str]:
    """The files that hold rows of a box (west, south, east, north); their names, no more, go through the driver."""
    west, south, east, north = box
    boxes = spark.read.schema(_BOX).json(f"{path}/boxes")
    return sorted(f"{path}/rows/{r.file}" for r in boxes.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)).select("file").collect())


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], x: str = "longitude", y: str = "latitude") -> DataFrame:
    """The rows of a bundle whose place lies in a box, its edges included, from the files that may hold some."""
    found = files_of(spark, path, box)
    rows = spark.read.parquet(*found) if found else spark.read.parquet(f"{path}/rows").where("false")
    west, south, east, north = box
    return rows.where(F.col(x).between(west, east) & F.col(y).between(south, north))

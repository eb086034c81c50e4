"""What the operators share: table access, bounded Arrow batches, the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch that goes to a Python worker. Texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 500
#: Text bytes that a worker handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session, as in tests, may do without: it gets a folder of its own."""
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(place or f"{tempfile.gettempdir()}/lindero-{uuid.uuid4().hex}")
        held = spark.sparkContext.getCheckpointDir()
    return held


#: Folders of tables that were written and not yet removed, with a number that rises and the thread that wrote them.
_WRITTEN: dict[str, tuple[int, int]] = {}
_NUMBERS = itertools.count(1)


def written_table(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, so that a lost executor costs no recomputation of what went before; by: a column to lay it out by."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN[place] = (next(_NUMBERS), threading.get_ident())
    writer = df.write.partitionBy(by) if by else df.write
    with _shuffles_go(spark):
        writer.parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out.lindero_place = place
    return out


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """What a query shuffles goes from the disks as soon as it has ended, not when the driver's memory is next cleared."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop_tables(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, [t.lindero_place])


def tables_so_far() -> int:
    """A mark for drop_since()."""
    return next(_NUMBERS)


def drop_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Remove the tables that this thread wrote since a mark, but for some. Results that are not yet computed must not depend on them."""
    kept, mine = {t.lindero_place for t in but}, threading.get_ident()
    _remove(spark, [p for p, (n, by) in list(_WRITTEN.items()) if n > mark and by == mine and p not in kept])


def _remove(spark: SparkSession, places: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
        _WRITTEN.pop(place, None)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of Arrow batches, that gives its memory back when it ends: Python workers live on, and what allocators hold back of every earlier step counts as their executor's."""

    @functools.wraps(run)
    def lean_run(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ..., which clash with no name that an operator uses inside."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def text_key(text: F.Column) -> F.Column:
    """A hash of a text, which with its id tells rows apart; null is a text of its own."""
    return F.xxhash64(text.isNull(), text)


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 5 is 0; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most limit bytes each, or of one text."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, keep: list[str], text_col: str, schema: str, make: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """Columns computed from whole texts beside the columns kept.

    make() runs once in each task and returns a function from a slice of texts (UTF-8) to
    one list or array for each field of schema.
    """
    bounded_batches(df.sparkSession)
    names = [*keep] if text_col in keep else [*keep, text_col]
    at = names.index(text_col)
    src = df.select(*[F.col(f"`{c}`") for c in names]).withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    added = df.sparkSession.createDataFrame([], schema).schema
    types = [_arrow(f.dataType.simpleString()) for f in added]
    out = StructType(src.schema.fields[: len(keep)] + added.fields)
    labels = out.fieldNames()

    def run(batches):
        fn = make()
        for batch in batches:
            texts = utf8(batch.column(at))
            for a, b in slices([len(t) for t in texts]):
                cols = fn(texts[a:b])
                part = batch.slice(a, b - a)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return src.mapInArrow(lean(run), out)


def _arrow(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow(name[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[name]

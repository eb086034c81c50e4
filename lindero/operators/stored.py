"""Steps that are kept in the folder that all executors share, so that what follows neither repeats them nor loses them with an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint()

"""Connected components of a graph of links, by hooking and pointer jumping over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import drop_tables, written_table


def components(edges: DataFrame) -> DataFrame:
    """fp and label, the smallest end that can be reached over the edges (fp, hub); ends without an edge have no row."""
    edges = written_table(edges)
    both = edges.union(edges.select("hub", "fp")).toDF("src", "dst")
    held = labels = written_table(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("fp"), F.least("src", "low").alias("label")))
    while True:
        of = labels.select(F.col("fp").alias("dst"), F.col("label").alias("theirs"))
        heard = both.join(of, "dst").groupBy("src").agg(F.min("theirs").alias("theirs")).withColumnRenamed("src", "fp")
        hooked = labels.join(heard, "fp").select("fp", F.col("label").alias("was"), F.least("label", "theirs").alias("mid"))
        jump = labels.select(F.col("fp").alias("mid"), F.col("label").alias("next"))
        after = written_table(hooked.join(jump, "mid").select("fp", "was", F.least("mid", "next").alias("label")))
        drop_tables(held)
        held, labels = after, after.select("fp", "label")
        if after.where("was <> label").isEmpty():
            drop_tables(edges)
            return labels

"""Files in and out: start lists, delimited tables with preambles, embedded snapshots, outputs with a fixed order of fields."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Header names of postal files and the columns that they stand for.
POSTAL_HEADERS = {
    "d_codigo": "postal_code", "codigo": "postal_code", "codigo postal": "postal_code", "cp": "postal_code", "d_asenta": "settlement", "asentamiento": "settlement", "colonia": "settlement",
    "d_tipo_asenta": "settlement_type", "tipo": "settlement_type", "tipo de asentamiento": "settlement_type", "d_mnpio": "municipality", "municipio": "municipality", "d_estado": "state", "estado": "state",
    "c_estado": "state_code", "c_mnpio": "municipality_code", "d_ciudad": "city", "ciudad": "city", "d_zona": "zone", "zona": "zone",
}
POSTAL_FIELDS = ["state", "state_code", "municipality", "municipality_code", "settlement", "settlement_type", "postal_code", "city", "zone"]


def start_urls(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that is neither blank nor a comment."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).where("url <> '' and not startswith(url, '#')")


#: Quotes are doubled, as other readers and writers have them.
_QUOTES = {"quote": '"', "escape": '"'}


def table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """A delimited file with a header and a given schema; only the columns asked for are parsed. Texts may hold line breaks if multiline; such files are not split. An empty text is null."""
    df = spark.read.csv(path, schema=schema, header=True, encoding=encoding, mode="PERMISSIVE", multiLine=multiline, **_QUOTES)
    return df.select(*columns) if columns else df


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """UTF-8, with or without a mark, else Windows-1252, else Latin-1."""

    def one(b):
        for name in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass

    return content.map(one)


def postal_settlements(spark: SparkSession, path: str, source: str = "postal_file") -> DataFrame:
    """POSTAL_FIELDS and source from files with one of four delimiters, a header after any preamble, and alias names.

    Rows without a settlement or a code go. A file is the unit of work, as its header tells how to read it.
    """
    from lindero.functions.text import clean_text, fold

    text = spark.read.format("binaryFile").load(path).select(F.col("path"), _decoded("content").alias("text"))
    lines = text.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    names = list(POSTAL_HEADERS)
    mark = F.coalesce(*[F.when(F.size(F.split("line", d)) > 2, F.lit(d)) for d in ("\\|", "\t", ";", ",")])
    cells = F.transform(F.split("line", mark), lambda x: F.trim(fold(F.regexp_replace(x, '"', ""))))
    heads = lines.withColumns({"mark": mark, "cells": cells}).where(F.size(F.array_intersect("cells", F.array(*map(F.lit, names)))) >= 3)
    head = heads.groupBy("path").agg(F.min(F.struct("at", "mark", "cells")).alias("h"))
    rows = lines.join(F.broadcast(head), "path").where("at > h.at and trim(line) <> ''")  # a row for each file
    split = rows.withColumn("v", F.transform(F.split("line", F.col("h.mark")), lambda x: F.regexp_replace(x, '^\\s*"|"\\s*$', "")))

    def field(name: str):
        places = [F.array_position("h.cells", alias) for alias, field_ in POSTAL_HEADERS.items() if field_ == name]
        at = F.coalesce(*[F.nullif(p, F.lit(0)) for p in places])
        return clean_text(F.try_element_at("v", at.cast("int"))).alias(name)

    out = split.select(*[field(n) for n in POSTAL_FIELDS]).where("settlement is not null and postal_code is not null")
    return out.withColumns({"postal_code": F.lpad("postal_code", 5, "0"), "source": F.lit(source)})


@F.pandas_udf(StringType())
def _unzipped(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else gzip.decompress(b).decode("utf-8"))


def embedded_snapshot(df: DataFrame, column: str, fields: list[str], separator: str = "|") -> DataFrame:
    """Rows of a table that a text column holds as base64 of a gzip of separated lines."""
    lines = df.select(F.explode(F.split(_unzipped(F.unbase64(column)), "\n")).alias("line")).where("trim(line) <> ''")
    cells = F.split("line", f"[{separator}]")
    return lines.select(*[F.nullif(F.trim(F.try_element_at(cells, F.lit(i + 1))), F.lit("")).alias(f) for i, f in enumerate(fields)])


def write_table(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with the fields in order; those that the rows lack are empty. Blanks at the ends of a text stay."""
    rows = df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
    rows.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_QUOTES)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def missing(df: DataFrame, wanted: list[str]) -> list[str]:
    """What a dataset lacks, in the order of what is wanted."""
    return [f"missing column {c}" for c in wanted if c not in df.columns]


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a numeric key; bounds only deal the rows, they drop none."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()

"""Registered queries that write rows to files and read them back, read numbers and lists from text, and take models in and out of a comparison."""

from __future__ import annotations

import base64
import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lindero.functions import text
from lindero.operators import evaluation
from lindero.operators.stored import shared_dir
from lindero.operators.upsert import first_or_create
from lindero.plans import sample
from lindero.plans.queries import _BASE, _METRICS, _read, query, rounded
from lindero.plans.request_queries import ORACLES, QUERIES
from lindero.sources import files

__all__ = ["ORACLES", "QUERIES"]

c = F.col


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_FIELDS = ["id", "title", "notes", "price", "neighborhood", "latitude", "longitude", "bedrooms", "published_at"]


@query(f"{_BASE} SELECT id, title, CAST(NULL AS VARCHAR) AS notes, price, neighborhood, latitude, bedrooms FROM l")
def listings_through_csv(spark, sf_dir):
    """Listings as CSV with a fixed order of fields, one of which they lack, read back with a schema and without the other columns."""
    place = _place(spark)
    files.write_table(sample.listings(spark, sf_dir), place, _FIELDS)
    schema = "id long, title string, notes string, price double, neighborhood string, latitude double, longitude double, bedrooms int, published_at timestamp"
    return files.table(spark, place, schema, ["id", "title", "notes", "price", "neighborhood", "latitude", "bedrooms"])


@query("SELECT doc_id, md5(nullif(text, '')) AS text_md5, length(nullif(text, '')) AS n_letters, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars FROM documents")
def documents_through_csv(spark, sf_dir):
    """Whole texts, with their quotes and line breaks, as CSV and back; empty ones come back as null."""
    place, docs = _place(spark), _read(spark, sf_dir, "documents")
    files.write_table(docs, place, docs.columns)
    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes)
    return files.table(spark, place, schema, multiline=True).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_letters"), "lang", "source", "n_chars")


@query("SELECT user_id, event_type, count(*) AS n, min(value) AS least, max(value) AS most, max(CASE WHEN event_type = 'error' THEN value END) AS worst_error FROM events GROUP BY 1, 2")
def metrics_through_json(spark, sf_dir):
    """Figures by user and type of event as JSON and back; those that are null are left out of a line."""
    place = _place(spark)
    figures = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.max(F.when(c("event_type") == "error", c("value"))).alias("worst_error"))
    files.write_json(figures, place)
    return spark.read.schema(figures.schema).json(place)


@query("SELECT trim(url) AS url FROM pages WHERE page_id % 5 > 1 AND trim(url) <> '' AND NOT starts_with(trim(url), '#')")
def start_list(spark, sf_dir):
    """Addresses from text files with comments, blanks around them and empty lines."""
    place, kind = _place(spark), c("page_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("  # "), "url")).when(kind == 1, "   ").when(kind == 2, F.concat(F.lit("  "), "url", F.lit("  "))).otherwise(c("url"))
    _read(spark, sf_dir, "pages").select(line.alias("value")).write.text(place)
    return files.start_urls(spark, place)


#: Delimiters of postal files and, for each, one way to name the columns.
_POSTAL = {"|": "d_codigo|d_asenta|D_mnpio|d_estado|d_zona", "\t": "Código Postal\tColonia\tMunicipio\tEstado\tZona", ";": '"CP";"Asentamiento";"Municipio";"Estado";"Zona"', ",": "codigo,asentamiento,d_mnpio,estado,d_zona"}


@query("""SELECT n_name AS state, CAST(NULL AS VARCHAR) AS state_code, c_mktsegment AS municipality, CAST(NULL AS VARCHAR) AS municipality_code, concat('Colonia Ñandú ', CAST(c_custkey AS VARCHAR)) AS settlement, CAST(NULL AS VARCHAR) AS settlement_type,
lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') AS postal_code, CAST(NULL AS VARCHAR) AS city, CASE WHEN c_custkey % 3 <> 0 THEN 'Urbano' END AS zone, 'postal_file' AS source
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 17 <> 0 AND c_custkey % 19 <> 0""")
def postal_files(spark, sf_dir):
    """Files of a nation's rows, 50,000 keys to each, with lines before the header and one of four delimiters; rows without a settlement or a code go."""
    place, key = _place(spark), c("c_custkey")
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    of = lambda values: F.get(F.array(*map(F.lit, values)), (c("n_nationkey") % 4).cast("int"))
    fields = [F.when(key % 17 != 0, (key % 90000).cast("string")), F.when(key % 19 != 0, F.concat(F.lit("Colonia Ñandú "), key)), c("c_mktsegment"), c("n_name"), F.when(key % 3 != 0, "Urbano")]
    quote = F.when(of(_POSTAL) == ";", '"').otherwise("")
    line = F.array_join(F.array(*[F.concat(quote, F.coalesce(f, F.lit("")), quote) for f in fields]), "\u0001")
    file = F.concat_ws("-", "n_nationkey", F.floor(key / 50_000)).alias("file")
    body = rows.select(file, key.cast("long").alias("at"), F.replace(line, F.lit("\u0001"), of(_POSTAL)).alias("line"))
    first = F.array(F.lit("Catálogo de asentamientos"), F.lit(""), of(_POSTAL.values()))
    heads = rows.select("n_nationkey", file).distinct().select("file", F.posexplode(first).alias("at", "line")).withColumn("at", c("at").cast("long") - 3)
    ordered = body.unionByName(heads).repartition("file").sortWithinPartitions("file", "at")
    ordered.select("file", c("line").alias("value")).write.partitionBy("file").text(place)
    return files.postal_settlements(spark, f"{place}/file=*")


@F.pandas_udf(StringType())
def _zipped(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode())


@query("SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS settlement, c_mktsegment AS municipality FROM customer")
def embedded_settlements(spark, sf_dir):
    """Rows that a text column holds as base64 of a gzip, a hundred keys to a text."""
    line = F.concat_ws("|", "c_custkey", F.when(c("c_custkey") % 5 != 0, c("c_name")).otherwise(" "), "c_mktsegment")
    held = _read(spark, sf_dir, "customer").groupBy(F.floor(c("c_custkey") / 100).alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    return files.embedded_snapshot(held.select(_zipped("lines").alias("held")), "held", ["code", "settlement", "municipality"])


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(event_type, ';', CAST(user_id AS VARCHAR)) ELSE '' END AS flags, CASE event_id % 5 WHEN 0 THEN 2 ELSE 0 END AS n_flags,
CASE WHEN event_id % 4 = 0 THEN value END AS census, CASE WHEN event_id % 4 = 0 THEN round(value / nullif(user_id % 3, 0), 6) END AS per_user, lpad(CAST(event_id % 700 AS VARCHAR), 3, '0') AS code FROM events""")
def parsed_fields(spark, sf_dir):
    """Lists of flags, of which most are none, census numbers with marks for what is not told, quotients and padded codes."""
    kind, told = c("event_id") % 5, c("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('["'), "event_type", F.lit('","'), "user_id", F.lit('"]'))).when(kind == 1, c("props")).when(kind == 2, "[").when(kind == 3, "[]")
    number = F.when(told == 0, F.concat(F.lit(" "), c("value").cast("string"))).when(told == 1, "*").when(told == 2, "N/D").otherwise("  ")
    df = _read(spark, sf_dir, "events").withColumns({"f": text.flags(raw), "census": text.census_number(number)})
    return df.select("event_id", F.array_join("f", ";").alias("flags"), F.size("f").alias("n_flags"), "census", F.round(F.try_divide("census", c("user_id") % 3), 6).alias("per_user"), text.code(c("event_id") % 700, 3).alias("code"))


_FOLDED = "lower(strip_accents(text))"
for _letter, _plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i")):
    _FOLDED = f"replace({_FOLDED}, '{_letter}', '{_plain}')"


@query(f"SELECT doc_id, md5({_FOLDED}) AS folded_md5 FROM documents")
def folded_texts(spark, sf_dir):
    """Whole texts without accents."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_fold(c("text"))).alias("folded_md5"))


@query("""WITH k AS (SELECT DISTINCT p_brand AS name, p_type AS version FROM part WHERE p_size % 4 = 0), a AS (SELECT DISTINCT p_brand AS name, p_type AS version FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size % 7 <> 0)
SELECT name, version, 'active' AS status FROM k UNION ALL SELECT name, version, 'new' FROM (SELECT * FROM a EXCEPT SELECT * FROM k)""")
def registered_models(spark, sf_dir):
    """A registry of models by name and version, with a row for each that is asked for and that it lacks."""
    part = _read(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "name", "p_type": "version"})
    known = part.where("p_size % 4 = 0").select("name", "version").distinct().withColumn("status", F.lit("active"))
    asked = _read(spark, sf_dir, "lineitem").join(part, c("l_partkey") == c("p_partkey")).select("name", F.when(c("p_size") % 7 != 0, c("version")).alias("version"))
    return first_or_create(known, asked, ["name", "version"], {"status": "new"})


_SOURCES = ["portal_a", "portal_b", "portal_c"]


def _type_means(train, test):
    """Each row at the mean price of its type in the other rows."""
    means = train.where("price > 0").groupBy("property_type").agg(F.avg("price").alias("predicted_price"))
    return test.where("price > 0").join(means, "property_type")


@query(f"""{_BASE}, m AS (SELECT v.source, l.property_type, avg(l.price) AS mean FROM (SELECT unnest({_SOURCES!r}) AS source) v JOIN l ON l.source <> v.source WHERE l.price > 0 GROUP BY 1, 2),
q AS (SELECT l.source, l.price AS actual_price, m.mean AS predicted_price FROM l JOIN m ON m.source = l.source AND m.property_type = l.property_type WHERE l.price > 0),
e AS (SELECT *, predicted_price - actual_price AS residual, abs(predicted_price - actual_price) AS absolute_error, abs(predicted_price - actual_price) / greatest(actual_price, 1.0) * 100 AS percentage_error, predicted_price / greatest(actual_price, 1.0) AS prediction_ratio FROM q)
SELECT source AS left_out, {_METRICS} FROM e GROUP BY 1""")
def left_out_sources(spark, sf_dir):
    """Errors on each source's listings of what the other sources' prices tell."""
    return rounded(evaluation.leave_one_out(sample.listings(spark, sf_dir), "source", _SOURCES, _type_means), r2=6, median_prediction_ratio=6)

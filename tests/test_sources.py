import base64
import gzip
import json

from pyspark.sql import functions as F

from lindero.operators import upsert
from lindero.plans import pipelines
from lindero.sources import files, pages
from lindero.streaming import ingest

LD = {"@graph": [{"@type": "Product", "name": "Casa en venta en el centro", "description": "Amplia", "offers": {"price": "3250000", "priceCurrency": "MXN"}, "geo": {"latitude": "18.9201", "longitude": "-99.2301"}, "address": {"addressRegion": "Estado", "addressLocality": "Ciudad", "streetAddress": "Calle 5", "postalCode": "62000"}}]}
PAGE = f"""<html><head><title>t</title><meta property="og:title" content="Otro"><script type="application/ld+json">{json.dumps(LD)}</script></head>
<body><h1>Casa</h1><p>Terreno: 1,200 m² <b>Construcción</b> 240 m²</p><p>3 recámaras 2.5 baños 2 estacionamientos</p><a href="/p/uno-1?utm_x=1">a</a><a href="/p/dos-2">b</a><a href="/p/uno-1">a</a>
<p>Propiedades similares</p><p>9 recámaras $9</p></body></html>"""
PLAIN = """<html><head><meta property="og:title" content="Terreno en venta"></head><body><p>$1,500,000 MXN</p><span>500 m²</span><button data-p="18.81234,-98.95678">mapa</button></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("portal_a", "https://X.mx/p/casa-1/", PAGE), ("portal_b", "https://y.mx/p/lote-2", PLAIN), ("portal_b", "https://y.mx/p/nada", ""), ("portal_b", "https://y.mx/p/nulo", None)], "source string, url string, content string")
    a, b, c, d = pipelines.listings_from_pages(df).orderBy("url").collect()
    assert (a.title, a.property_type, a.operation, a.price, a.currency, a.latitude, a.longitude) == ("Casa en venta en el centro", "casa", "venta", 3250000.0, "MXN", 18.9201, -99.2301)
    assert (a.municipality, a.street, a.postal_code, a.land_area_m2, a.construction_area_m2, a.bedrooms, a.parking_spaces, a.source_id) == ("Ciudad", "Calle 5", "62000", 1200.0, 240.0, 3, 2, "casa-1")
    assert (b.property_type, b.price, b.currency, b.land_area_m2, b.latitude, b.longitude) == ("terreno", 1500000.0, "MXN", 500.0, 18.81234, -98.95678)
    assert "missing_price" in c.quality_flags and d.title is None and "missing_coordinates" in d.quality_flags
    links = pages.links(df.where("source = 'portal_a'"), "^/p/").collect()
    assert [r.url for r in links] == ["https://X.mx/p/uno-1".lower().replace("x.mx", "x.mx"), "https://x.mx/p/dos-2"]


def test_postal_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d_codigo,d_asenta,d_tipo_asenta,D_mnpio,d_estado\n62000,Centro,Colonia,Cuernavaca,Morelos\n1000,San Ángel,Colonia,Álvaro Obregón,Ciudad\n,,,,\n", encoding="utf-8-sig")
    (tmp_path / "b.txt").write_bytes("El catálogo\nd_codigo|d_asenta|D_mnpio|d_estado\n62010|Ocotepec Ñu|Cuernavaca|Morelos\n".encode("cp1252"))
    rows = files.postal_settlements(spark, str(tmp_path)).collect()
    assert sorted((r.postal_code, r.settlement, r.municipality, r.state) for r in rows) == [("01000", "San Ángel", "Álvaro Obregón", "Ciudad"), ("62000", "Centro", "Cuernavaca", "Morelos"), ("62010", "Ocotepec Ñu", "Cuernavaca", "Morelos")]


def test_snapshots_and_outputs(spark, tmp_path):
    blob = base64.b64encode(gzip.compress("a|1|x\nb||y\n".encode())).decode()
    df = spark.createDataFrame([(blob,)], "s string")
    assert [tuple(r) for r in files.embedded_snapshot(df, "s", ["n", "k", "z"]).collect()] == [("a", "1", "x"), ("b", None, "y")]
    files.write_table(spark.range(2), str(tmp_path / "o"), ["zeta", "id"])
    assert files.table(spark, str(tmp_path / "o"), "zeta string, id int", ["id"]).agg(F.sum("id")).first()[0] == 1
    (tmp_path / "u.txt").write_text("# x\n\nhttps://a\n")
    assert [r.url for r in files.start_urls(spark, str(tmp_path / "u.txt")).collect()] == ["https://a"]


def test_texts_through_csv(spark, tmp_path):
    rows = [(1, ' a "quoted", text \nwith\r\nbreaks '), (2, ""), (3, None), (4, "\\"), (5, '"')]
    files.write_table(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "o"), ["text", "id", "none"])
    got = files.table(spark, str(tmp_path / "o"), "text string, id long, none string", ["id", "text"], multiline=True)
    assert sorted(tuple(r) for r in got.collect()) == [(i, t or None) for i, t in rows]


def test_database_table_in_ranges(spark, tmp_path):
    """Bounds only deal the rows: those beyond them and those without a key are read, too."""
    url, driver = "jdbc:derby:memory:lindero;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    rows = spark.range(200).select(F.when(F.col("id") < 199, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    rows.write.mode("overwrite").option("driver", driver).jdbc(url, "listings")
    got = files.jdbc_table(spark, url, "listings", "k", 50, 100, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[1], r[0]) for r in got.collect()) == [(2 * i, i if i < 199 else None) for i in range(200)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 10, None), ("b", 1, 11, "x"), (None, 1, 12, None)], "k string, v int, t int, note string")
    new = spark.createDataFrame([("a", 2, 20), ("c", 3, 21), (None, 5, 22)], "k string, v int, t int")
    got = {r.k: (r.v, r.t) for r in upsert.upsert(old, new, ["k"], "t", ("t",)).collect()}
    assert got == {"a": (2, 10), "b": (1, 11), "c": (3, 21), None: (5, 12)}


def test_stream(spark, tmp_path):
    schema = "k string, v int, at timestamp"
    src = str(tmp_path / "in")
    batch = lambda rows: spark.createDataFrame(rows, "k string, v int, at string").select("k", "v", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").json(src)
    batch([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:05:00"), ("b", 1, "2024-01-01 00:00:00")])
    run = lambda: ingest.upsert_into(spark, spark.readStream.schema(schema).json(src), str(tmp_path / "snap"), ["k"], "at", str(tmp_path / "cp")).awaitTermination(60)
    run()
    batch([("b", 7, "2024-01-02 00:00:00"), ("c", 3, "2024-01-02 00:00:00")])
    run()
    assert {r.k: r.v for r in ingest.snapshot(spark, str(tmp_path / "snap")).collect()} == {"a": 2, "b": 7, "c": 3}
    pages_ = spark.readStream.schema("k string, v int, at timestamp").json(src).withColumnRenamed("v", "value")
    q = ingest.counts(pages_, "at", "k").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True)
    q.start().awaitTermination(60)
    assert {(r.k, r.n) for r in spark.table("counted").collect()} >= {("a", 2)}


def test_titles_as_written(spark):
    html = '<html><head>\n<!-- <title>no</title> --><title lang="x">A &amp; b &quot;c&quot; d&amp</title></head><body><a href="/x">x</a></body></html>'
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "html string")
    got = [tuple(r) for r in df.select(pages.marks("html").alias("m")).select("m.title", "m.written_title").collect()]
    assert got == [('A & b "c" d&', "A &amp; b &quot;c&quot; d&amp"), (None, None), (None, None)]

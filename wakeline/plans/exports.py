"""Queries of readers, sinks and streams: what is written and read again must equal what SQL makes of the tables."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile

from pyspark.sql import functions as F

from wakeline.operators import tables as ops
from wakeline.plans.registry import query
from wakeline.plans.suspects import FUSE_SQL, fused
from wakeline.sources import files, sinks
from wakeline.sources import testdata as td
from wakeline.sources.work import work_dir
from wakeline.streaming import events as streaming
from wakeline.streaming import silence


def fresh(spark, name: str) -> str:
    return f"{work_dir(spark)}/wakeline/{name}-{uuid.uuid4().hex}"


ORDER_ROW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@query("csv_round_trip", f"SELECT {ORDER_ROW} FROM orders")
def _(spark, d):
    o = td.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "cast(o_totalprice AS double) AS o_totalprice")
    path = sinks.write_once(o, fresh(spark, "orders-csv"), "csv", header="true")
    return files.csv(spark, path, o.schema)


@query("parquet_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    c = td.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return spark.read.parquet(sinks.write_once(c, fresh(spark, "customers")))


@query("headered_text", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    path = sinks.write_headered(td.table(spark, d, "supplier").select("s_suppkey", "s_name"), fresh(spark, "origins"))
    return spark.read.schema("s_suppkey long, s_name string").option("header", "true").option("sep", "\t").csv(path)


ZIP_ROWS = [("1", "2024-01-20T00:00:00", "-93.5", "25.5", "A"), ("2", "2024-01-20T00:01:00", "10.0", "25.5", "B"), ("007", "2024-01-20T00:02:00", "-93.0", "26.0", ""), ("4", "2024-01-20T00:03:00", "x", "26.0", "D")]


@query("zipped_csv", "SELECT * FROM (VALUES ('1', '2024-01-20T00:00:00', '-93.5', '25.5', CAST(NULL AS VARCHAR)), ('007', '2024-01-20T00:02:00', '-93.0', '26.0', NULL)) v(MMSI, BaseDateTime, LON, LAT, SOG)")
def _(spark, d):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("reports.csv", "MMSI,BaseDateTime,LON,LAT,VesselName\n" + "\n".join(map(",".join, ZIP_ROWS)) + "\n")
    path = files.put_bytes(spark, f"{fresh(spark, 'zips')}/day.zip", held.getvalue())
    return files.zipped_csv(spark, path, ["MMSI", "BaseDateTime", "LON", "LAT", "SOG"], (-95, 24, -92, 28))


PLACES = {"id": "s_suppkey", "name": "s_name", "lon": "-93e0 + ((s_suppkey * 31) % 500) * 1e-2", "lat": "25e0 + ((s_suppkey * 17) % 300) * 1e-2"}


@query("geojson_round_trip", f"SELECT id, name, 'Point' AS geometry_type, lon, lat FROM (SELECT {td.columns(PLACES)} FROM supplier)", "lon lat")
def _(spark, d):
    places = td.derived(spark, d, "supplier", PLACES).withColumn("posthoc", F.lit("x"))
    path = sinks.write_feature_collection(places, f"{fresh(spark, 'geojson')}.json")
    rows = files.geojson(spark, path, "id long, name string, posthoc string", without=("posthoc",))
    at = F.from_json("coordinates", "array<double>")
    return rows.select("id", "name", "geometry_type", at[0].alias("lon"), at[1].alias("lat"))


@query("geojson_lines", f"SELECT id, name, lon FROM (SELECT {td.columns(PLACES)} FROM supplier)", "lon")
def _(spark, d):
    path = sinks.write_feature_lines(td.derived(spark, d, "supplier", PLACES), fresh(spark, "features"))
    read = spark.read.schema("geometry struct<coordinates:array<double>>, properties struct<id:long, name:string>").json(path)
    return read.select("properties.id", "properties.name", F.col("geometry.coordinates")[0].alias("lon"))


XML = "<c><list>" + "".join(f"<calibrationVector><line>{100 * k}</line><pixel>0 40 80</pixel><sigmaNought>{k}.5 {k}.25 {k}.125</sigmaNought></calibrationVector>" for k in range(3)) + "</list></c>"


@query("xml_vectors", "SELECT CAST(100 * k AS BIGINT) AS line, CAST(p AS INT) AS place, p * 40e0 AS pixel, k + 1 / pow(2, p + 1) AS sigmaNought FROM range(3) a(k), range(3) b(p)", "pixel sigmaNought")
def _(spark, d):
    path = files.put_bytes(spark, f"{fresh(spark, 'xml')}.xml", XML.encode())
    return files.xml_vectors(spark, path, "calibrationVector", "line", ["pixel", "sigmaNought"])


@query("file_names", "SELECT * FROM (VALUES ('train', 'Oil', '3', 1), ('val', 'Oil_2', '12', 2)) v(split, kind, number, length)")
def _(spark, d):
    base = fresh(spark, "scans")
    for name, data in (("a/train_Oil (3).tif", b"x"), ("b/val_Oil_2 (12).tif", b"xy"), ("b/other.tif", b"z")):
        files.put_bytes(spark, f"{base}/{name}", data)
    found = files.catalogue(spark, base, r"^(train|val|test)_(Oil|Oil_2) \((\d+)\)$", ["split", "kind", "number"])
    return found.select("split", "kind", "number", F.col("length").cast("int").alias("length"))


@query("mapped_paths", "SELECT * FROM (VALUES (1, 'Images/Oil/a.tif'), (2, 'Mask/Oil/b.png')) v(id, path)")
def _(spark, d):
    raw = spark.createDataFrame([(1, "Set\\Tiff files\\Class_1\\archive_a.tif"), (2, "Set/Png/Class_1/archive2_b.png")], "id int, p string")
    return raw.select("id", files.mapped_path(F.col("p"), {"Tiff files": "Images", "Png": "Mask", "Class_1": "Oil"}).alias("path"))


@query("image_headers", "SELECT * FROM (VALUES ('a.png', 640, 480, 8, CAST(NULL AS VARCHAR)), ('b.png', NULL, NULL, NULL, 'not a PNG header')) v(file, width, height, bits, error)")
def _(spark, d):
    base = fresh(spark, "images")
    files.put_bytes(spark, f"{base}/a.png", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0, 0))
    files.put_bytes(spark, f"{base}/b.png", b"broken")
    return files.image_headers(spark, base).drop("length")


REGISTER = "COMPLEX_ID_NUM,STRUCTURE_NUMBER,AREA_CODE,BLOCK_NUMBER,STRUCTURE_NAME,BUS_ASC_NAME,INSTALL_DATE,REMOVAL_DATE,LONGITUDE,LATITUDE\n" + "\n".join([
    "10,1,MC, 20 ,A,One,2001-05-01,,-90.0,28.0", "10,2,MC,21,,Two,03/04/1999,2010-01-01,-90.1,28.0", "11,1,GC,5,B,Three,1-JAN-2030,,-90.2,28.0", "12,1,GC,6,C,Four,odd,19991231,-90.3,28.0", "13,1,EW,7,D,Five,,,-90.4,x", "14,1,EW,8,E,,7/9/2005,2040-01-01,-90.5,27.5",
])


@query("platform_register", "SELECT * FROM (VALUES ('10-1', 'MC 20 A (One)', -90.0e0, 28.0e0), ('14-1', 'EW 8 E ()', -90.5e0, 27.5e0)) v(id, name, lon, lat)", "lon lat", digits=2)
def _(spark, d):
    path = files.put_bytes(spark, f"{fresh(spark, 'register')}.txt", REGISTER.encode())
    raw = files.csv(spark, path, ", ".join(f"{c} string" for c in REGISTER.split("\n")[0].split(",")))
    return files.platform_register(raw, "2024-01-21 00:00:00").drop("installed")


@query("run_catalogue", "SELECT * FROM (VALUES ('backward', 'ok'), ('forward', 'failed')) v(stage, status)")
def _(spark, d):
    base = fresh(spark, "runs")
    for stage, fails in (("backward", False), ("forward", True)):
        try:
            with sinks.Stage(spark, base, stage, {"k": 1}):
                if fails:
                    raise ValueError("no particles")
        except ValueError:
            pass
    return files.documents(spark, f"{base}/*.manifest.json", "stage string, status string").drop("path")


@query("optional_source", "SELECT CAST(NULL AS BIGINT) AS id, NULL::VARCHAR AS label WHERE false")
def _(spark, d):
    return files.optional(spark, f"{d}/no_such_table.parquet", "id long, label string")


@query("manifest_upsert", "SELECT n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS sha256, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS stamp FROM nation")
def _(spark, d):
    n = td.table(spark, d, "nation")
    known = n.select(F.col("n_name").alias("path"), F.lit("old").alias("sha256"), F.lit(1).alias("stamp"))
    new = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("path"), F.lit("new").alias("sha256"), F.lit(2).alias("stamp"))
    return sinks.latest(known, new, "path", "stamp")


@query("manifest_difference", "SELECT * FROM (VALUES ('a.txt', 'same'), ('b.txt', 'changed'), ('c.txt', 'missing'), ('d.txt', 'new')) v(path, status)")
def _(spark, d):
    a, b = fresh(spark, "frozen"), fresh(spark, "now")
    for base, texts in ((a, "a1 b1 c1"), (b, "a1 b2 d1")):
        for x in texts.split():
            files.put_bytes(spark, f"{base}/{x[0]}.txt", x.encode())
    name = F.regexp_extract("path", r"([^/]*)$", 1).alias("path")
    return ops.manifest_difference(*(sinks.hashes(spark, base).select(name, "sha256") for base in (a, b)))


SUMMARY_COLUMNS = ("mmsi", "tier", "combined")


@query("summary_json", f"""WITH {FUSE_SQL} SELECT cluster_id, CAST(suspect_rank AS INT) AS suspect_rank, mmsi, tier, round(combined, 4) + 0.0 AS combined FROM fused WHERE suspect_rank <= 5""", "combined", digits=4)
def _(spark, d):
    text = sinks.summary_json(fused(spark, d), 5, *SUMMARY_COLUMNS)
    item = "struct<suspect_rank:int, mmsi:string, tier:string, combined:double>"
    read = text.select("cluster_id", F.explode(F.from_json("summary", f"struct<top:array<{item}>>")["top"]).alias("x"))
    return read.select("cluster_id", "x.*")


@query("entity_json", f"WITH {td.V2_SQL} SELECT mmsi, t, round(lon, 4) + 0.0 AS lon, CASE WHEN t % {5 * td.HOUR} <> 0 THEN round(lat, 4) + 0.0 END AS lat FROM pos", "lon lat", digits=3)
def _(spark, d):
    from wakeline.plans.attribution import positions_v2

    gaps = F.when(F.col("t") % (5 * td.HOUR) == 0, F.lit(float("nan"))).otherwise(F.col("lat"))
    p = sinks.compact(positions_v2(spark, d).select("mmsi", "t", "lon", gaps.alias("lat")))
    path = fresh(spark, "entities")
    p.withColumn("folder", F.col("mmsi").cast("int") % 10).repartition("folder").write.partitionBy("folder").json(path)
    return spark.read.schema("mmsi string, t long, lon double, lat double").json(path).select("mmsi", "t", "lon", "lat")


@query("frame_maps", f"""WITH {td.V2_SQL} SELECT mmsi, CAST(count(*) AS INT) AS n_frames, min(t) AS first_frame FROM (SELECT mmsi, t, row_number() OVER (PARTITION BY mmsi ORDER BY md5(mmsi || '-' || t || '-3'), t) AS n FROM pos) WHERE n <= 6 GROUP BY mmsi""")
def _(spark, d):
    from wakeline.plans.attribution import positions_v2

    maps = sinks.frame_maps(positions_v2(spark, d).select("mmsi", "t", "lon", "lat"), "t", 6, 3)
    keys = F.map_keys(F.from_json("frames", "map<string,array<double>>"))
    return maps.select("mmsi", F.size(keys).alias("n_frames"), F.array_min(F.transform(keys, lambda k: k.cast("long"))).alias("first_frame"))


@query("grid_overlap", "SELECT ix, iy FROM (SELECT p_partkey % 40 AS ix, p_partkey % 30 AS iy FROM part) INTERSECT SELECT s_suppkey % 40, s_suppkey % 20 FROM supplier")
def _(spark, d):
    a = td.table(spark, d, "part").selectExpr("p_partkey % 40 AS ix", "p_partkey % 30 AS iy")
    return a.intersect(td.table(spark, d, "supplier").selectExpr("s_suppkey % 40 AS ix", "s_suppkey % 20 AS iy"))


@query("grid_bounds", """SELECT greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT min(p_lon) AS lo, max(p_lon) AS hi FROM (SELECT -93e0 + ((p_partkey * 37) % 500) * 1e-2 AS p_lon FROM part)) a,
  (SELECT min(lon) AS lo, max(lon) AS hi FROM (SELECT -92e0 + ((s_suppkey * 31) % 700) * 1e-2 AS lon FROM supplier)) b""", "lo hi")
def _(spark, d):
    a = td.derived(spark, d, "part", td.CLOUD).agg(F.min("p_lon").alias("a0"), F.max("p_lon").alias("a1"))
    b = td.table(spark, d, "supplier").selectExpr("-92e0 + ((s_suppkey * 31) % 700) * 1e-2 AS lon").agg(F.min("lon").alias("b0"), F.max("lon").alias("b1"))
    return a.crossJoin(b).select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))  # one row each


# Streams over the events, as files.

US = td.US["duckdb"]


COLUMNS = ("cast(user_id AS string) AS mmsi", "cast(ts AS timestamp) AS ts", "event_id AS id", "value", "event_type")


def stream(spark, d, *columns: str):
    """The events table as a stream of files, as many at a time as there are."""
    return source(spark, d, *columns)[0]


def source(spark, d, *columns: str):
    """``stream``, and what ends it: one more report, of no entity, a year after the newest. It passes every watermark, and
    its own windows stay open, so that it is in no row."""
    e = td.table(spark, d, "events").selectExpr(*COLUMNS)
    path = fresh(spark, "reports")
    e.write.parquet(path)

    def end() -> None:
        last = spark.read.schema(e.schema).parquet(path).agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
        last.select(*(F.col(c.name) if c.name == "ts" else F.lit(None).cast(c.dataType).alias(c.name) for c in e.schema)).write.mode("append").parquet(path)

    return spark.readStream.schema(e.schema).parquet(path).select(*columns), end


# Every window is told, the last ones too.


@query("stream_sliding", f"SELECT mmsi, us - us % {td.HOUR} - k * {td.HOUR} AS start_us, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS mmsi, {US} AS us FROM events), range(6) g(k) GROUP BY ALL")
def _(spark, d):
    reports, end = source(spark, d, "mmsi", "ts")
    return streaming.settle(streaming.sliding_counts(reports), end)


@query("stream_hourly", f"SELECT us - us % {td.HOUR} AS start_us, count(*) AS n, avg(value) AS mean FROM (SELECT {US} AS us, value FROM events) GROUP BY ALL", "mean")
def _(spark, d):
    reports, end = source(spark, d, "ts", "value")
    return streaming.settle(streaming.hourly(reports), end)


@query("stream_sessions", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS mmsi, {US} AS us FROM events), s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY mmsi ORDER BY us) <= {td.HOUR} THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY mmsi ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT mmsi, min(us) AS start_us, max(us) + {td.HOUR} AS end_us, count(*) AS n FROM g GROUP BY mmsi, k""")
def _(spark, d):
    reports, end = source(spark, d, "mmsi", "ts")
    return streaming.settle(streaming.sessions(reports), end)


@query("stream_within", f"SELECT a.mmsi, a.id AS a, b.id AS b FROM (SELECT CAST(user_id AS VARCHAR) AS mmsi, {US} AS us, event_id AS id FROM events WHERE event_type = 'click') a JOIN (SELECT CAST(user_id AS VARCHAR) AS mmsi, {US} AS us, event_id AS id FROM events WHERE event_type = 'purchase') b ON a.mmsi = b.mmsi AND abs(a.us - b.us) <= {td.HOUR // 3}")
def _(spark, d):
    reports = stream(spark, d, "mmsi", "ts", "id", "event_type")
    return streaming.settle(streaming.within(reports.filter("event_type = 'click'"), reports.filter("event_type = 'purchase'"), 20))


# A silence is out when it ended at least an hour before the newest report; watermarks count in milliseconds.
PASSED = f"(SELECT max({US}) // 1000 * 1000 - {td.HOUR} FROM events)"


@query("stream_silent", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS mmsi, {US} AS us, min(event_id) AS id FROM events GROUP BY ALL),
n AS (SELECT *, lead(us) OVER (PARTITION BY mmsi ORDER BY us) AS following FROM e)
SELECT mmsi, us AS last_us, id, us + {6 * td.HOUR} AS silent_us FROM n WHERE coalesce(following > us + {6 * td.HOUR}, true) AND us + {6 * td.HOUR} <= {PASSED}""")
def _(spark, d):
    return streaming.settle(silence.silences(stream(spark, d, "mmsi", "ts", "id"), 6))


@query("stream_without_repeats", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS mmsi, event_type FROM events")
def _(spark, d):
    return streaming.settle(streaming.without_repeats(stream(spark, d, "mmsi", "ts", "event_type"), "mmsi", "event_type", late="400 days").select("mmsi", "event_type"))

"""Readers of outside files: CSV (also zipped), GeoJSON, XML, JSON documents, image headers, file catalogues."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wakeline.functions.geo import metres_per_degree


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes a small file through Spark's file systems, replacing one that is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(data))
    out.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if the path does not exist."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and given types: ids that look like numbers stay text, numbers are parsed exactly, values that do
    not fit are null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", timestampFormat="yyyy-MM-dd'T'HH:mm:ss")


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], box: tuple[float, float, float, float] | None = None, block: int = 8 << 20) -> DataFrame:
    """The named columns, as text, of the CSV files inside zip files; ``box`` (west, south, east, north) keeps the rows
    whose LON and LAT lie in it. A zip file is one task, read in blocks; a column that is not there is null."""
    import pyarrow.csv

    kept = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        header = z.open(name).readline().decode().rstrip("\r\n").split(",")
                        options = pyarrow.csv.ConvertOptions(column_types={c: pa.string() for c in header}, include_columns=kept, include_missing_columns=True, strings_can_be_null=True)
                        with z.open(name) as file:
                            for part in pyarrow.csv.open_csv(file, pyarrow.csv.ReadOptions(block_size=block), convert_options=options):
                                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in part.columns], kept)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, ", ".join(f"`{c}` string" for c in kept))
    if box:
        number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
        rows = rows.filter(number("LON").between(box[0], box[2]) & number("LAT").between(box[1], box[3]))
    return rows


def document(spark: SparkSession, path: str) -> dict:
    """A small JSON document (configuration, manifest) as a dict on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def documents(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One row for each JSON document that a pattern finds, with its path."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def geojson(spark: SparkSession, path: str, properties: StructType | str, without: Sequence[str] = ()) -> DataFrame:
    """A row for each feature: its properties but those named in ``without``, kind of geometry, coordinates as JSON text."""
    if isinstance(properties, StructType):
        properties = properties.simpleString()
    else:
        properties = f"struct<{', '.join(':'.join(x.split()) for x in properties.split(','))}>"
    raw = spark.read.text(path, wholetext=True)
    feature = f"struct<properties:{properties}, geometry:struct<type:string, coordinates:string>>"
    rows = raw.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates")).drop(*without)


def xml_vectors(spark: SparkSession, path: str, tag: str, line: str, lists: Sequence[str]) -> DataFrame:
    """Look-up vectors of an XML file: a row for each number of each ``tag``, with its line and place."""
    schema = f"{line} long, {', '.join(f'{c} string' for c in lists)}"
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    split = [F.transform(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x.cast("double")).alias(c) for c in lists]
    return raw.select(F.col(line), F.posexplode(F.arrays_zip(*split)).alias("place", "v")).select(line, "place", *(F.col("v")[c].alias(c) for c in lists))


def catalogue(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """Files under a folder whose name (without ending) fits a pattern, its groups as columns: path, length, sha256, names.
    Content is read for the hash alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    parts = [F.regexp_extract("name", pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), name.alias("name")).filter(F.col("name").rlike(pattern)).select("path", "length", "sha256", "name", *parts)


def image_headers(spark: SparkSession, path: str) -> DataFrame:
    """Width, height and bit depth of PNG files from their headers; a file that is none has ``error`` and nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = lambda start, n: F.conv(F.hex(F.substring("content", start, n)), 16, 10).cast("int")
    good = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    good = good & (F.length("content") >= 29) & (F.substring("content", 13, 4).cast("string") == "IHDR")
    when = lambda x: F.when(good, x)
    return files.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "length", when(at(17, 4)).alias("width"), when(at(21, 4)).alias("height"), when(at(25, 1)).alias("bits"), F.when(~good, "not a PNG header").alias("error"),
    )


def mapped_path(path: Column, folders: dict[str, str]) -> Column:
    """A catalogue's path in the terms of another: back slashes turned, the top folder gone, folder names mapped, an
    ``archive_`` before the file name dropped."""
    parts = F.slice(F.split(F.translate(path, "\\", "/"), "/"), 2, 1000)
    names = F.create_map(*(F.lit(x) for pair in folders.items() for x in pair))
    turned = F.transform(parts, lambda x: F.coalesce(F.try_element_at(names, x), F.regexp_replace(x, r"^archive2?_", "")))
    return F.array_join(turned, "/")


def mixed_date(text: Column) -> Column:
    """Dates in any of several notations; null if none fits."""
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "d-MMM-yyyy", "yyyyMMdd")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms))


def nad27_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Datum shift by the abridged Molodensky formula with the mean parameters of the contiguous United States: within
    some ten metres of a grid-based shift."""
    dx, dy, dz, da, df, a, f = -8.0, 160.0, 176.0, -69.4, -0.37264639e-4, 6378206.4, 1 / 294.9786982
    x, y = F.radians(lon), F.radians(lat)
    per_lat, per_lon = metres_per_degree(lat)
    north = -dx * F.sin(y) * F.cos(x) - dy * F.sin(y) * F.sin(x) + dz * F.cos(y) + (a * df + f * da) * F.sin(2 * y)
    return lon + (-dx * F.sin(x) + dy * F.cos(x)) / per_lon, lat + north / per_lat


def platform_register(raw: DataFrame, t0: str) -> DataFrame:
    """Structures that stand at T0, from a register of text columns: id, name, lon, lat, installed. Unknown dates do not
    exclude; rows without coordinates go."""
    install, removal, at = mixed_date(F.col("INSTALL_DATE")), mixed_date(F.col("REMOVAL_DATE")), F.lit(t0).cast("timestamp")
    number = lambda c: F.expr(f"try_cast(trim({c}) AS DOUBLE)")
    rows = raw.withColumns({"_x": number("LONGITUDE"), "_y": number("LATITUDE"), "installed": install, "_removed": removal})
    rows = rows.filter((F.col("installed").isNull() | (F.col("installed") <= at)) & (F.col("_removed").isNull() | (F.col("_removed") > at)) & F.col("_x").isNotNull() & F.col("_y").isNotNull())
    lon, lat = nad27_to_wgs84(F.col("_x"), F.col("_y"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    name = F.concat(F.concat_ws(" ", text("AREA_CODE"), text("BLOCK_NUMBER"), text("STRUCTURE_NAME")), F.lit(" ("), text("BUS_ASC_NAME"), F.lit(")"))
    return rows.select(F.concat_ws("-", "COMPLEX_ID_NUM", "STRUCTURE_NUMBER").alias("id"), name.alias("name"), lon.alias("lon"), lat.alias("lat"), "installed")

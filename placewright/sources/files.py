"""Readers: tables in text files, lists, web pages, documents and shapes."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import extension
from . import pdf, xls


def tsv(spark: SparkSession, path: str, columns: T.StructType, header: bool = False, null: str = "", quote: str = '"') -> DataFrame:
    """A tab-separated file of fixed columns."""
    return spark.read.schema(columns).option("sep", "\t").option("header", header).option("nullValue", null).option("quote", quote).csv(path)


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """8 columns; the quote mark is one that never occurs."""
    return tsv(spark, path, schema.ALTERNATE_NAME, quote="\b")


def osm_names(spark: SparkSession, path: str) -> DataFrame:
    """23 columns, NULL for null."""
    return tsv(spark, path, schema.OSM_NAME, null="NULL")


def conformed(spark: SparkSession, path: str, columns: T.StructType, out: str) -> None:
    """A bulk load: header, empty is null; replaces the table."""
    tsv(spark, path, columns, header=True).write.mode("overwrite").parquet(out)


def genesis(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, position, title) of lines of page and `;`-joined titles."""
    rows = tsv(spark, path, schema.GENESIS)
    return rows.select("page_id", F.posexplode(F.split("titles", ";")).alias("position", "title")).where("title != ''")


def country_info(spark: SparkSession, path: str) -> DataFrame:
    """The 19 columns after the preamble, which ends with the line of headings."""
    names = ["iso", "iso3", "iso_numeric", "fips", "country", "capital", "area_sqkm", "population", "continent", "tld", "currency_code", "currency_name", "phone", "postal_format", "postal_regex", "languages", "geonameid", "neighbours", "equivalent_fips"]
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    heading = F.contains("value", F.lit("Languages")) & F.contains(F.lower("value"), F.lit("fips"))
    return lines.where((F.size(parts) > 5) & ~heading).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]).withColumn("geonameid", F.expr("try_cast(geonameid AS int)"))


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """A lookup table kept at path: read if it was written and committed, else built and written."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dataset_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("path"))


#: Fixed: extensions of sources that are read, and those that are passed over.
READ = ["csv", "tsv", "xls", "xlsm", "xlsx", "docx", "pdf", "txt"]
PASSED_OVER = ["doc", "zip"]


def source_kind(name: Column, content_type: Column | None = None) -> Column:
    """How a source is read: by its extension, else by its content type, else as a page."""
    ext = F.lower(extension(F.regexp_replace(name, r"[?#].*$", "")))
    out = F.when(ext.isin(READ), ext).when(ext.isin(PASSED_OVER), "ignored")
    if content_type is not None:
        out = out.when(F.contains(content_type, F.lit("csv")), "csv").when(F.contains(content_type, F.lit("pdf")), "pdf").when(F.contains(content_type, F.lit("spreadsheet")), "xlsx").when(F.contains(content_type, F.lit("wordprocessing")), "docx").when(F.contains(content_type, F.lit("text/plain")), "txt")
    return out.otherwise("webpage")


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def _xlsx(data: bytes) -> list[list[str]]:
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        sheet = next(n for n in sorted(z.namelist()) if re.match(r"xl/worksheets/[^/]+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{m}row"):
            cells: list[str] = []
            for c in row.iter(f"{m}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))
                at = 0
                for ch in letters[0] if letters else "A":
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{m}v")
                value = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "")
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                cells += [""] * (at - 1 - len(cells)) + [value or ""]
            rows.append(cells)
    return rows


def parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, row, cells, error) of the files below a folder: text for txt, docx, pdf and pages, a row a line for tables.

    A file is read whole by one task, as these formats need. One that can't be read gives a row with nothing but the error; files that
    are passed over by their extension give none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("kind", source_kind(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for batch in batches:
            out = []
            for p, data, kind in zip(batch.path, batch.content, batch.kind, strict=True):
                data = bytes(data)
                try:
                    if kind in ("csv", "tsv"):
                        lines = csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter="," if kind == "csv" else "\t")
                        out += [(p, kind, None, i, cells, None) for i, cells in enumerate(lines)]
                    elif kind in ("xlsx", "xlsm", "xls"):
                        #: Either kind of workbook is called by the other's extension at times.
                        rows = xls.cells(data) if data[:8] == xls.SIGNATURE else _xlsx(data)
                        out += [(p, kind, None, i, cells, None) for i, cells in enumerate(rows)]
                    elif kind == "docx":
                        out.append((p, kind, _docx(data), None, None, None))
                    elif kind == "pdf":
                        out.append((p, kind, pdf.text(data), None, None, None))
                    elif kind in ("txt", "webpage"):
                        out.append((p, kind, data.decode("utf-8", "replace"), None, None, None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, IndexError, csv.Error, RecursionError) as e:
                    out.append((p, kind, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "kind", "text", "row", "cells", "error"])

    return files.mapInPandas(run, "path string, kind string, text string, row int, cells array<string>, error string")


#: Fixed: types of shapes; tens tell whether they have Z or M values too, which follow the points and aren't read.
NO_SHAPE, POINT, LINE, POLYGON, MULTIPOINT = 0, 1, 3, 5, 8


def _ring_sets(data: bytes) -> Iterator[tuple[int, list]]:
    """(shape type without Z and M, points or rings) of each record of a .shp file. Other types raise."""
    at = 100
    while at + 12 <= len(data):
        (length,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * length]
        (kind,) = struct.unpack("<i", body[:4])
        more, base = divmod(kind, 10)
        if base not in (NO_SHAPE, POINT, LINE, POLYGON, MULTIPOINT) or more > 2 or (base == NO_SHAPE and more):
            raise ValueError(f"shapes of type {kind} aren't read")
        if base == POINT:
            yield base, [struct.unpack("<2d", body[4:20])]
        elif base == MULTIPOINT:
            (points,) = struct.unpack("<i", body[36:40])
            flat = struct.unpack(f"<{2 * points}d", body[40 : 40 + 16 * points])
            yield base, list(zip(flat[::2], flat[1::2], strict=True))
        elif base in (LINE, POLYGON):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            pairs = list(zip(flat[::2], flat[1::2], strict=True))
            yield base, [pairs[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield base, []
        at += 8 + 2 * length


def _attributes(data: bytes) -> list[dict[str, str]]:
    """The records of a .dbf file."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields = [(data[i : i + 11].split(b"\0")[0].decode("latin-1"), data[i + 16]) for i in range(32, head - 1, 32)]
    out = []
    for r in range(n):
        row, at = {}, head + r * size + 1
        for name, width in fields:
            row[name] = data[at : at + width].decode("utf-8", "replace").strip()
            at += width
        out.append(row)
    return out


def _rings_to_polygons(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Outer rings (clockwise) with the holes that follow them."""
    out: list = []
    for ring in rings:
        turned = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
        if turned <= 0 or not out:
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, attributes, lon, lat, mpoly) of the shapefiles below a folder, also of those in zips; a point of several is the first, coordinates are longitude and latitude; lines are records without a shape."""
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select(F.col("content").alias("zip"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    pairs = files.groupBy(F.regexp_replace("path", r"\.\w+$", "").alias("path")).agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf"))
    return _shape_records(pairs.unionByName(_unzipped(zips)))


def zipped_shapes(spark: SparkSession, path: str) -> DataFrame:
    """As shapes(), of a table of (name, zip) that sinks.write_shapes wrote; paths are those within the zips."""
    return _shape_records(_unzipped(spark.read.parquet(path).select("zip")))


def _unzipped(zips: DataFrame) -> DataFrame:
    """(path, shp, dbf) of the shapefiles in a column of zips; other files in them are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch.zip:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    names = set(z.namelist())
                    stems = sorted(n[:-4] for n in names if n.endswith(".shp"))
                    yield pd.DataFrame([(n, z.read(f"{n}.shp"), z.read(f"{n}.dbf") if f"{n}.dbf" in names else None) for n in stems], columns=["path", "shp", "dbf"])

    return zips.mapInPandas(run, "path string, shp binary, dbf binary")


def _shape_records(pairs: DataFrame) -> DataFrame:
    """Records of (path, shp, dbf)."""
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("record", T.IntegerType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("mpoly", schema.MULTIPOLYGON)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, shp, dbf in zip(batch.path, batch.shp, batch.dbf, strict=True):
                known = _attributes(bytes(dbf)) if dbf is not None else []
                for i, (kind, found) in enumerate(_ring_sets(bytes(shp)) if shp is not None else []):
                    point = found[0] if kind in (POINT, MULTIPOINT) and found else None
                    mpoly = [[[{"x": x, "y": y} for x, y in ring] for ring in poly] for poly in _rings_to_polygons(found)] if kind == POLYGON else None
                    rows.append((p, i, known[i] if i < len(known) else {}, point and point[0], point and point[1], mpoly))
            yield pd.DataFrame(rows, columns=["path", "record", "attributes", "lon", "lat", "mpoly"])

    return pairs.mapInPandas(run, out)


#: Fixed: providers that are left out.
NO_BASEMAP = {"CartoDB", "Esri", "HERE", "MapBox", "Thunderforest"}


def basemaps(spark: SparkSession, providers: dict[str, list[str]]) -> DataFrame:
    """Names of base maps: provider.variant, and Blank; providers without variants have none."""
    names = ["Blank"] + [f"{k}.{v}" for k, vs in providers.items() if k not in NO_BASEMAP for v in vs]
    return spark.createDataFrame([(n,) for n in names], "name string").dropDuplicates(["name"])


def metadata_entries(df: DataFrame, key: str = "id", fields: str = "fields") -> DataFrame:
    """A map column as rows of metadata_id, key and value."""
    return df.select(F.col(key).alias("metadata_id"), F.explode(fields).alias("key", "value"))

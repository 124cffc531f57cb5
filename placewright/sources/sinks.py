"""Writers: maps as CSV, GeoJSON, shapes or a pair; training and decision exports; frequencies."""

from __future__ import annotations

import io
import struct
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..functions.text import short_date

FORMATS = ("csv", "geojson", "shp", "xy")
#: Fixed text of the projection file.
PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["Degree",0.017453292519943295]]'


def chosen(feature: DataFrame, featureplace: DataFrame, places: DataFrame) -> DataFrame:
    """Each feature with its correct place: of several the one of the lowest featureplace id."""
    first = featureplace.where("correct").groupBy("feature_id").agg(F.min_by(F.struct("place_id", "confidence"), "id").alias("_f")).select("feature_id", "_f.place_id", "_f.confidence")
    f = feature.select(F.col("id").alias("feature_id"), *[c for c in feature.columns if c not in ("id", "name", "feature_id")])
    return f.join(first, "feature_id").join(places.withColumnRenamed("id", "place_id"), "place_id")


def csv_rows(links: DataFrame) -> DataFrame:
    """Rows of the CSV map: latitude is y and longitude is x; pcode, times and shape only where any row of the order has them."""
    has = links.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in ("pcode", "start", "end", "mpoly") if c in links.columns]).first() if {"pcode", "start", "end", "mpoly"} & set(links.columns) else None
    flag = lambda c: bool(has and c in has.asDict() and has[c])
    cols = ["name", "confidence", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "country_code", F.col("geonames_id").alias("geonameid") if "geonames_id" in links.columns else F.col("place_id").alias("geonameid")]
    if flag("pcode"):
        cols.append("pcode")
    if flag("start") or flag("end"):
        cols += [short_date(F.col(c)).alias(f"{c}_time") if c in links.columns else F.lit(None).cast("string").alias(f"{c}_time") for c in ("start", "end")]
    if flag("mpoly"):
        cols.append(F.to_json("mpoly").alias("mpoly"))
    return links.select(*cols)


def geojson_features(links: DataFrame) -> DataFrame:
    """(admin_level, feature): one GeoJSON feature a row, keys sorted; absent times are left out, other nulls stay."""
    has = lambda c: c in links.columns
    mpoly = F.col("mpoly") if has("mpoly") else F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>")
    geometry = spatial.geojson(mpoly, F.col("lon"), F.col("lat"))
    known = [("admin1_code", _or_null(links, "admin1_code")), ("admin_level", F.col("admin_level")), ("confidence", F.col("confidence").cast("double")), ("country_code", F.col("country_code"))]
    times = [(f"{t}_time", short_date(F.col(t))) for t in ("end", "start") if has(t)]
    rest = [("geonames_id", _or_null(links, "geonames_id")), ("importance", F.coalesce("importance", F.lit(0.0))), ("name", F.col("name")), ("pcode", _or_null(links, "pcode")), ("timezone", _or_null(links, "timezone"))]
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), _json(v))) if k.endswith("_time") else F.concat(F.lit(f'"{k}": '), _json(v)) for k, v in sorted([*known, *times, *rest], key=lambda x: x[0])]
    properties = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return links.select("admin_level", "place_id", F.concat(F.lit('{"geometry": '), geometry, F.lit(', "properties": '), properties, F.lit(', "type": "Feature"}')).alias("feature"))


def _or_null(df: DataFrame, c: str):
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def _json(value):
    """A value as JSON text."""
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def write_geojson(links: DataFrame, path: str) -> None:
    """Features as lines below path; `collection` assembles a file of them where one is wanted."""
    features = geojson_features(links).orderBy(F.desc_nulls_first("admin_level"), "place_id").select(F.col("feature").alias("value"))
    features.write.mode("overwrite").text(path)


def collection(features: list[str]) -> str:
    """One FeatureCollection, of an order's map."""
    return '{"features": [' + ", ".join(features) + '], "type": "FeatureCollection"}'


def xy(links: DataFrame) -> DataFrame:
    """The pair of the first feature as JSON, one row, or null."""
    return links.agg(F.min_by(F.struct("lon", "lat"), "feature_id").alias("p")).select(F.when(F.col("p").isNull(), "null").otherwise(F.to_json(F.array("p.lon", "p.lat"))).alias("xy"))


def shape_parts(links: DataFrame) -> DataFrame:
    """One row a polygon of each feature's shape."""
    return links.where(F.col("mpoly").isNotNull()).select("feature_id", "name", F.posexplode("mpoly").alias("part", "polygon"))


def _shape_file(kind: int, bodies: list[bytes], box: tuple[float, float, float, float]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of record bodies, numbered in their order."""
    places, records, at = [], [], 50
    for i, body in enumerate(bodies):
        places.append(struct.pack(">2i", at, len(body) // 2))
        records.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + struct.pack("<8d", *box, 0, 0, 0, 0)
    return head(at) + b"".join(records), head(50 + 4 * len(bodies)) + b"".join(places)


#: Fixed: the body of a record without a shape.
_NO_SHAPE = struct.pack("<i", 0)


def _box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    return min(xs), min(ys), max(xs), max(ys)


def _points(points: list[tuple[float, float]]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of points; those without coordinates are records without a shape."""
    known = [p if p[0] == p[0] and p[1] == p[1] else None for p in points]
    return _shape_file(1, [struct.pack("<i2d", 1, *p) if p else _NO_SHAPE for p in known], _box([p for p in known if p]))


def shp_bytes(points: list[tuple[float, float]]) -> bytes:
    """A .shp file of points."""
    return _points(points)[0]


def _polygons(polygons: list[list[list[tuple[float, float]]]]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of polygons: rings are closed, the first is turned clockwise, holes the other way."""
    bodies, corners = [], []
    for polygon in polygons:
        rings = []
        for ring in polygon:
            ring = [*ring, ring[0]] if ring[0] != ring[-1] else ring
            turned = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
            rings.append(ring[::-1] if (turned > 0) != bool(rings) else ring)
        flat = [p for ring in rings for p in ring]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        body = struct.pack("<i4d2i", 5, *_box(flat), len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        bodies.append(body if rings else _NO_SHAPE)
        corners += flat
    return _shape_file(5, bodies, _box(corners))


#: Fixed: fields of a record; the format holds 10 letters of a name.
FIELDS = ("name", "confidence", "countrycod", "geonames_i", "pcode", "start_time", "end_time")
#: Bytes of a field, at least and at most; the format holds no more, so a longer name is cut at a whole letter.
NARROW, WIDE = 50, 254


def dbf_bytes(records: list[list[str | None]]) -> bytes:
    """A .dbf file of records of FIELDS in UTF-8; null is empty."""
    cells = [[(v or "").encode()[:WIDE].decode("utf-8", "ignore").encode() for v in r] for r in records]
    widths = [max([NARROW, *(len(r[i]) for r in cells)]) for i in range(len(FIELDS))]
    fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for name, w in zip(FIELDS, widths, strict=True))
    head = struct.pack("<4BIHH", 3, 0, 1, 1, len(cells), 33 + len(fields), 1 + sum(widths)) + b"\0" * 20
    return head + fields + b"\r" + b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in cells) + b"\x1a"


def shape_zip(name: str, records: list[list[str | None]], points: list[tuple[float, float]], shapes: list[list]) -> bytes:
    """A zip of `name`_points and, where there are any, `name`_polygons: a record for each polygon of each shape, with its feature's attributes."""
    parts = [(r, polygon) for r, shape in zip(records, shapes, strict=True) for polygon in shape]
    layers = {"points": (_points(points), records)}
    if parts:
        layers["polygons"] = (_polygons([p for _, p in parts]), [r for r, _ in parts])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for layer, ((shp, shx), rows) in layers.items():
            for ext, data in {"shp": shp, "shx": shx, "dbf": dbf_bytes(rows), "prj": PRJ, "cpg": "UTF-8"}.items():
                z.writestr(f"{name}_{layer}.{ext}", data)
    return out.getvalue()


def write_shapes(links: DataFrame, path: str) -> None:
    """A table of (name, zip), one zipped pair of point and polygon shapefiles for each batch of features; `files.zipped_shapes` reads it."""
    import uuid

    import pandas as pd

    has = lambda c: c in links.columns
    text = lambda c: F.col(c).cast("string") if has(c) else F.lit(None).cast("string")
    time = lambda c: short_date(F.col(c)) if has(c) else F.lit(None).cast("string")
    values = [text("name"), text("confidence"), text("country_code"), text("geonames_id" if has("geonames_id") else "place_id"), text("pcode"), time("start"), time("end")]
    #: Rings as x, y, x, y ...
    ring = lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"])))
    flat = F.transform("mpoly", lambda polygon: F.transform(polygon, ring)) if has("mpoly") else F.lit(None).cast("array<array<array<double>>>")

    def run(batches):
        for batch in batches:
            points = list(zip(batch.lon, batch.lat, strict=True))
            shapes = [[[list(zip(r[::2], r[1::2], strict=True)) for r in (polygon if polygon is not None else []) if r is not None and len(r)] for polygon in (m if m is not None else [])] for m in batch.mpoly]
            name = uuid.uuid4().hex
            yield pd.DataFrame({"name": [name], "zip": [shape_zip(name, [list(r) for r in batch["values"]], points, shapes)]})

    rows = links.select(F.array(*values).alias("values"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), flat.alias("mpoly"))
    rows.mapInPandas(run, "name string, zip binary").write.mode("overwrite").parquet(path)


def write_map(links: DataFrame, path: str, map_format: str = "all") -> list[str]:
    """Writes the map in one format or in all, side by side from one cached table."""
    wanted = FORMATS if map_format == "all" else (map_format,)
    if set(wanted) - set(FORMATS):
        raise ValueError(f"no writer for {map_format}; there are {', '.join(FORMATS)}")
    links = links.persist()
    jobs = {
        "csv": lambda p: csv_rows(links).write.mode("overwrite").option("header", True).csv(p),
        "geojson": lambda p: write_geojson(links, p),
        "shp": lambda p: write_shapes(links, p),
        "xy": lambda p: xy(links).write.mode("overwrite").text(p),
    }
    try:
        with ThreadPoolExecutor(len(wanted)) as pool:
            list(pool.map(lambda f: jobs[f](f"{path}/{f}"), wanted))
    finally:
        links.unpersist()
    return [f"{path}/{f}" for f in wanted]


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def frequency_features(freq: DataFrame, places: DataFrame) -> DataFrame:
    """(admin_level, feature) of the places that have shapes; their shares count those without too."""
    rows = freq.join(places.where(F.col("mpoly").isNotNull()).select(F.col("id").alias("place_id"), "name", "country_code", "lon", "lat", "mpoly"), "place_id")
    return rows.select("admin_level", F.to_json(F.struct("mpoly", F.struct("admin_level", "count", "country_code", "frequency", "lat", "lon", "name").alias("properties"), F.lit("Feature").alias("type"))).alias("feature"))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files (name, content) below a folder, each by the task that has its row, and gives their number. A task that is run again writes the same files."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    where = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

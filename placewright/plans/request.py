"""A map request from sources to chosen places, and the read side of the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract, resolve
from ..session import kept
from ..sources.files import source_kind

#: Fixed: values that count as true in forms, and formats that a map may have.
TRUE = ["true", "True", "TRUE", "on", "1", "yes", "t", "y"]
MAP_FORMATS = ["geojson", "gif", "jpg", "png", "xy", "csv", "shp"]
MOST_SOURCES, SOURCE_BYTES = 1000, 2000


def flag(value: Column) -> Column:
    return F.coalesce(value.cast("string").isin(TRUE), F.lit(False))


def map_format(value: Column) -> Column:
    return F.when(F.lower(value).isin(MAP_FORMATS), F.lower(value)).otherwise("all")


def cleaned_sources(rows: DataFrame) -> DataFrame:
    """rows (order_id, source_no, source_type, data) that are usable, with kind, fixed url, and a text short enough to keep."""
    is_url = F.col("source_type") == "link"
    url = F.when(is_url, text.fixed_url(F.col("data")))
    kind = F.when(is_url | (F.col("source_type") == "file"), source_kind(F.coalesce(url, F.col("data")))).otherwise(F.col("source_type"))
    short = F.when(F.octet_length("data") < SOURCE_BYTES, F.col("data"))
    ok = F.col("data").isNotNull() & (F.trim("data") != "") & F.col("source_no").between(0, MOST_SOURCES - 1)
    return rows.where(ok).select("order_id", "source_no", "source_type", kind.alias("kind"), url.alias("source_url"), short.alias("source_text"), "data")


def split_metadata(rows: DataFrame, is_metadata: Column) -> tuple[DataFrame, DataFrame]:
    """(metadata, data); what can't be told is data."""
    known = F.coalesce(is_metadata, F.lit(False))
    return rows.where(known), rows.where(~known)


def table_rows(sources: DataFrame) -> DataFrame:
    """(order_id, source_no, row, cells) of the sources that are tables in a text."""
    cells = F.when(F.col("kind") == "tsv", extract.table_cells(F.col("data"), "\t")).otherwise(extract.table_cells(F.col("data"), ","))
    return sources.where(F.col("kind").isin("csv", "tsv")).select("order_id", "source_no", F.posexplode(cells).alias("row", "cells"))


def locations(sources: DataFrame, places: DataFrame, stop: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(order_id, name, count, context, position) of sources: texts, pages with their tables, and tables; position is the number of the source.

    data holds what a source is made of. tables: (order_id, source_no, row, cells) of sources that had to be parsed, such as
    workbooks (`files.parsed_files`).
    """
    source = F.struct("order_id", "source_no").alias("source")
    as_text = sources.where(F.col("kind").isin("text", "txt", "docx")).select(source, F.col("data").alias("text"))
    pages = sources.where(F.col("kind") == "webpage").select(source, F.col("data").alias("html"))
    tabled = extract.locations_in_pages(pages, "source", places).where("origin = 'table'").select("source", "name", F.lit(1).alias("count"))
    rows = table_rows(sources)
    rows = rows if tables is None else rows.unionByName(tables.select("order_id", "source_no", F.col("row").cast("int").alias("row"), "cells"))
    tabled = tabled.unionByName(extract.locations_in_tables(rows.select(source, "row", "cells"), "source", places))
    texts = as_text.unionByName(pages.select("source", extract.page_text(F.col("html")).alias("text")))
    said = extract.locations_in_text(texts, "source", stop, pattern_only=True).join(tabled.select("source", "name"), ["source", "name"], "left_anti")
    found = tabled.withColumn("context", F.lit(None).cast("string")).unionByName(said)
    return found.select("source.order_id", F.col("source.source_no").alias("position"), "name", "count", "context")


def request_map(sources: DataFrame, places: DataFrame, stop: DataFrame | None = None, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """feature and featureplace of all orders in one lazy plan."""
    return resolve.resolve_locations(locations(cleaned_sources(sources), places, stop, tables), places)


def style(features: DataFrame) -> DataFrame:
    """A style for each feature; the first ten of an order are labelled."""
    from ..operators.analytics import labels

    return labels(features).select(F.col("id").alias("feature_id"), F.col("order_id").alias("mapstyle_id"), "label")


def finish(orders: DataFrame, ends: DataFrame) -> DataFrame:
    """orders (id, start) that ended (order_id, end): complete, with the duration in seconds."""
    out = orders.join(ends.select(F.col("order_id").alias("_o"), F.col("end").alias("_end")), F.col("id") == F.col("_o"), "left")
    return out.select(*[c for c in orders.columns if c not in ("complete", "end", "duration")], F.col("_end").isNotNull().alias("complete"), F.col("_end").alias("end"), (F.unix_timestamp("_end") - F.unix_timestamp("start")).cast("long").alias("duration"))


#: Exact-match filters of the lists, by what they list.
FILTERS = {"places": {"id", "country_code", "name", "name_normalized"}, "features": {"order_id", "verified"}, "orders": {"token"}, "tests": {"accuracy", "created"}}
REQUIRED = {"features": "order_id"}


def listed(df: DataFrame, what: str, params: dict, fields: str | None = None, offset: int = 0, limit: int = 10, order: str = "id") -> DataFrame:
    """A page of a list: known exact-match filters, chosen fields, no rows if a required filter is missing."""
    need = REQUIRED.get(what)
    if need and params.get(need) is None:
        df = df.limit(0)
    for key in sorted(FILTERS[what] & set(params)):
        df = df.where(F.col(key) == F.lit(params[key]))
    page = df.orderBy(order).offset(offset).limit(limit)
    return page.select(*[f for f in fields.split(",") if f in df.columns]) if fields else page


def feature_details(feature: DataFrame, featureplace: DataFrame, places: DataFrame) -> DataFrame:
    """(feature_id, detail): JSON of each candidate of a feature; keys without a value are left out."""
    p = places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "country_code", "population", "admin_level", "lat", "lon")
    rows = featureplace.join(feature.select(F.col("id").alias("feature_id"), F.col("name") if "name" in feature.columns else F.lit(None).cast("string").alias("name")), "feature_id").join(p, "place_id")
    truthy = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0"), F.col(c))
    alias = F.when(F.col("name") != F.col("place_name"), F.array("place_name"))
    return rows.select("feature_id", "place_id", F.to_json(F.struct("place_id", F.col("place_name").alias("name"), truthy("country_code").alias("country_code"), truthy("population").alias("population"), truthy("admin_level").alias("admin_level"), alias.alias("aliases"), "correct")).alias("detail"))


def metadata_lists(entries: DataFrame) -> DataFrame:
    """(metadata_id, entries): the sorted keys and values of each."""
    return entries.groupBy("metadata_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("entries"))


def verify(features: DataFrame, order_id: int) -> DataFrame:
    return features.withColumn("verified", F.when(F.col("order_id") == order_id, True).otherwise(F.col("verified")))


def set_correct(featureplace: DataFrame, changes: DataFrame) -> DataFrame:
    """featureplace with `correct` of single rows (id, correct) changed; other candidates keep theirs."""
    c = changes.select(F.col("id").alias("_id"), F.col("correct").alias("_c"))
    return featureplace.join(c, F.col("id") == F.col("_id"), "left").withColumn("correct", F.coalesce("_c", "correct")).drop("_id", "_c")


def geolocate(docs: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(key, latitude, longitude) of each text's first correct place by name."""
    found = extract.names_in_text(docs, key, pattern_only=True).select(F.col(key).alias("order_id"), "name", F.lit(0).alias("position"))
    #: Kept, as features and links are both made of them: texts are read once.
    feature, fp = resolve.resolve_locations(kept(found, "names"), places)
    rows = fp.where("correct").join(feature.select("feature_id", "name"), "feature_id").join(places.select(F.col("id").alias("place_id"), "lat", "lon"), "place_id")
    return rows.groupBy(F.col("order_id").alias(key)).agg(F.min_by(F.struct("lat", "lon"), F.struct("name", "place_id")).alias("_p")).select(key, F.col("_p.lat").alias("latitude"), F.col("_p.lon").alias("longitude"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

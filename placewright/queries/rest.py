"""Readers and writers held against what went in, and the smaller operators that remain, each under its own id."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import geodesic
from ..functions import spatial as S
from ..functions import text as T
from ..operators import analytics as A
from ..operators import gazetteer as G
from ..operators import resolve as R
from ..operators import topics
from ..plans import export
from ..plans import maintenance as M
from ..plans import request as Q
from ..session import scratch
from ..sources import files, sinks
from . import made_files
from .fixtures import asked
from .flows import order_sql
from .registry import query
from .spatial import METRES, SCORE, WIDE, lands


def _lines(df, *fields):
    """A path with the rows of df as lines of tab-separated fields."""
    path = scratch(df.sparkSession, "lines")
    df.select(F.array_join(F.array(*[f.cast("string") for f in fields]), "\t", "NULL").alias("value")).write.text(path)
    return path


@query("sc01_places", "v_place", sql="SELECT id, name, country_code, lon, lat FROM v_place")
def places(place):
    return place.select("id", "name", "country_code", "lon", "lat")


@query("sc02_alternate_names", "part", sql="""SELECT CAST(p_partkey AS INT) AS geonameid, 'en' AS language, '"' || p_name AS alternate_name, CAST(NULL AS VARCHAR) AS b FROM part""")
def alternate_names(part):
    """Quote marks are letters like any other."""
    none = F.lit("")
    path = _lines(part, F.col("p_partkey"), F.col("p_size"), F.lit("en"), F.concat(F.lit('"'), "p_name"), none, none, none, none)
    return files.alternate_names(part.sparkSession, path).select("geonameid", "language", "alternate_name", "b")


@query("sc03_osm_names", "v_place", sql="SELECT name, id AS osm_id, lon, lat, importance, CAST(NULL AS VARCHAR) AS street, country_code, CASE WHEN id % 2 = 0 THEN 'Q1' END AS wikidata FROM v_place")
def osm_names(place):
    known = {"name": F.col("name"), "osm_id": F.col("id"), "lon": F.col("lon"), "lat": F.col("lat"), "importance": F.col("importance"), "country_code": F.col("country_code"), "wikidata": F.when(F.col("id") % 2 == 0, "Q1")}
    path = _lines(place, *[known.get(c, F.lit(None)) for c in schema.OSM_NAME.names])
    return files.osm_names(place.sparkSession, path).select("name", "osm_id", "lon", "lat", "importance", "street", "country_code", "wikidata")


@query("sc04_conformed", "v_place", sql="SELECT id, name, population, admin_level FROM v_place")
def conformed(place):
    """Out as TSV with a header and in again with fixed types; what is empty is null."""
    spark, columns = place.sparkSession, place.select("id", "name", "population", "admin_level")
    path, out = scratch(spark, "tsv"), scratch(spark, "table")
    sinks.write_tsv(columns, path)
    files.conformed(spark, path, columns.schema, out)
    return spark.read.parquet(out)


@query("sc06_country_info", "nation", sql="SELECT n_name AS iso, 'C' || n_nationkey AS country, 'en,fr' AS languages, n_nationkey AS geonameid FROM nation")
def country_info(nation):
    """The lines before the headings, and the headings, are passed over."""
    spark = nation.sparkSession
    head = spark.createDataFrame([("# a note\tof\tmany\ttabs\tand\tmore\tLanguages",), ("#ISO\tISO3\tISO-Numeric\tfips\tCountry\tCapital\tLanguages\tgeonameid",)], "value string")
    rest = F.lit("")
    cells = [F.col("n_name"), rest, rest, rest, F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), *[rest] * 10, F.lit("en,fr"), F.col("n_nationkey").cast("string"), rest, rest]
    path = scratch(spark, "countries")
    head.unionByName(nation.select(F.array_join(F.array(*cells), "\t").alias("value"))).write.text(path)
    return files.country_info(spark, path).select("iso", "country", "languages", "geonameid")


@query("sc10_text_source", "documents", sql="SELECT doc_id AS order_id, 'text' AS kind, CASE WHEN strlen(text) < 2000 THEN text END AS source_text FROM documents WHERE trim(text) <> ''")
def text_source(documents):
    rows = documents.select(F.col("doc_id").alias("order_id"), F.lit(0).alias("source_no"), F.lit("text").alias("source_type"), F.col("text").alias("data"))
    return Q.cleaned_sources(rows).select("order_id", "kind", "source_text")


@query("sc12_files", "part", sql="SELECT 'csv' AS kind, CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")
def table_files(part):
    """Files of a folder, told apart by their names, as rows of cells."""
    spark, path = part.sparkSession, scratch(part.sparkSession, "files")
    part.select("p_partkey", "p_name").write.csv(path)
    return files.parsed_files(spark, path).select("kind", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


def _made(rows, folder: str, make, kind: str):
    """Files made of rows (name, data), each by the task that has its row, read back."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"name": batch.name, "content": [make(d) for d in batch.data]})

    path = scratch(rows.sparkSession, folder)
    sinks.write_files(rows.mapInPandas(run, "name string, content binary"), path)
    return files.parsed_files(rows.sparkSession, path).where(F.col("kind") == kind).withColumn("key", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))


@query("sc11_pdf_texts", "benchmark", sql=r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(NULL AS VARCHAR) AS error FROM benchmark")
def pdf_texts(benchmark):
    """Texts of PDF files, by the maps of their fonts."""
    rows = benchmark.select(F.concat(F.col("item_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("text").alias("data"))
    read = _made(rows, "pdf", lambda text: made_files.pdf_bytes([" ".join(line.split()) for line in text.split("\n")]), "pdf")
    return read.select(F.col("key").alias("item_id"), F.regexp_replace("text", r"\s+", " ").alias("text"), "error")


@query("sc12_workbooks", "nation", sql="SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def workbooks(nation):
    """Cells of a workbook (xls) a region."""
    lists = nation.groupBy(F.concat(F.col("n_regionkey").cast("string"), F.lit(".xls")).alias("name")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("data"))

    def make(data: str) -> bytes:
        import json

        return made_files.xls_bytes([[r["n_nationkey"], r["n_name"]] for r in json.loads(data)])

    read = _made(lists, "xls", make, "xls")
    return read.select(F.col("key").cast("int").alias("region"), "row", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


@query("g11_simplified_land", "v_country", sql="SELECT id, 4 AS rings, true AS fewer, true AS on_shore FROM v_country")
def simplified_land(country):
    """Ragged shapes with a lake and islands: the rings stay, with fewer vertices, all of which were there before. Tests hold that none cross."""
    shapes = lands(country).withColumnRenamed("mpoly", "before").withColumn("mpoly", F.col("before"))
    points = lambda c: F.flatten(F.flatten(c))
    out = M.simplified(shapes, 1.0)
    return out.select(F.col("pid").alias("id"), F.size(F.flatten("mpoly")).alias("rings"), (F.size(points("mpoly")) < F.size(points("before"))).alias("fewer"), (F.size(F.array_except(points("mpoly"), points("before"))) == 0).alias("on_shore"))


@query("sc15_dataset_list", "region", sql="SELECT r_name || '.zip' AS path FROM region")
def dataset_list(region):
    spark, path = region.sparkSession, scratch(region.sparkSession, "list")
    extra = spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string")
    extra.unionByName(region.select(F.concat("r_name", F.lit(".zip ")).alias("value"))).write.text(path)
    return files.dataset_list(spark, path)


@query("sc17_basemaps", "region", sql="SELECT 'Blank' AS name UNION ALL SELECT 'R' || r_regionkey || '.a' FROM region")
def basemaps(region):
    providers = {f"R{i}": ["a"] for i in range(5)} | {"Esri": ["b"], "HERE": ["c"], "Bare": []}
    return files.basemaps(region.sparkSession, providers)


@query("sk05_formats", "region", sql="SELECT unnest(['csv', 'geojson', 'shp', 'xy', 'gif', 'jpg', 'png', 'pdf']) AS format, unnest([true, true, true, true, false, false, false, false]) AS written")
def formats(region):
    """Images and PDF are refused before anything is written."""

    def accepted(name: str) -> bool:
        try:
            sinks.write_map(region, "", name) if name not in sinks.FORMATS else None
        except ValueError:
            return False
        return True

    return region.sparkSession.createDataFrame([(f, accepted(f)) for f in ("csv", "geojson", "shp", "xy", "gif", "jpg", "png", "pdf")], "format string, written boolean")


@query("sk07_training_tsv", "v_place", sql="""WITH p AS (SELECT name AS title, max(id) AS correct, name_normalized FROM v_place GROUP BY 1, 3), t AS (SELECT DISTINCT country_code AS page_id, name AS title FROM v_place)
 SELECT page_id, title, id AS place_id, id = correct AS correct FROM t JOIN p USING (title) JOIN v_place USING (name_normalized)""")
def training_tsv(place):
    """The export read back."""
    titles = place.select(F.col("country_code").alias("page_id"), F.col("name").alias("title")).distinct().withColumn("position", F.length("title"))
    rows = export.training(titles, place.withColumn("enwiki_title", F.col("name"))).select("page_id", "title", "place_id", "correct")
    path = scratch(place.sparkSession, "training")
    sinks.write_tsv(rows, path)
    return files.tsv(place.sparkSession, path, rows.schema, header=True)


@query("sk10_fan_out", "v_feature", "v_featureplace", "v_place", sql="""WITH c AS (SELECT feature_id FROM v_featureplace WHERE correct GROUP BY 1), n AS (SELECT count(*) AS n FROM c JOIN v_feature f ON f.id = c.feature_id)
 SELECT 'csv' AS format, true AS written, n AS n_rows FROM n UNION ALL SELECT 'geojson', true, n FROM n UNION ALL SELECT 'xy', true, 1 UNION ALL SELECT 'pdf', false, 0""")
def fan_out(feature, featureplace, place):
    """SK10, SK11: a map in all formats, looked up by format and counted in the files."""
    spark, path = place.sparkSession, scratch(place.sparkSession, "map")
    sinks.write_map(sinks.chosen(feature, featureplace, place), path)
    rows = {"csv": spark.read.option("header", True).csv(f"{path}/csv"), "geojson": spark.read.text(f"{path}/geojson"), "xy": spark.read.text(f"{path}/xy")}
    each = [(f, M.map_exists(spark, path, f), rows[f].count() if f in rows else 0) for f in ("csv", "geojson", "xy", "pdf")]
    return spark.createDataFrame(each, "format string, written boolean, n_rows long")


@query("sk12_append", "v_featureplace", sql="SELECT place_id, count(*) AS n FROM v_featureplace GROUP BY 1")
def append(featureplace):
    """Candidates go into their table batch by batch."""
    spark, path = featureplace.sparkSession, scratch(featureplace.sparkSession, "featureplace")
    for flag in (F.col("correct"), ~F.col("correct"), F.col("correct").isNull()):
        M.append(featureplace.where(flag), path)
    return spark.read.parquet(path).groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))


@query("sk13_accuracy_log", "v_place", sql="""WITH e AS (SELECT name, min_by(lon, id) AS x, min_by(lat, id) AS y FROM v_place GROUP BY name)
 SELECT admin_level, count(*) AS n, round(avg(CASE WHEN lon = x AND lat = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, true AS logged FROM v_place JOIN e USING (name) WHERE admin_level IN (0, 1, 2) GROUP BY 1""")
def accuracy_log(place):
    """A test of each of three levels is logged as it ends, and the log read back."""
    spark, path = place.sparkSession, scratch(place.sparkSession, "tests")
    expected = place.groupBy("name").agg(F.min_by("lon", "id").alias("x"), F.min_by("lat", "id").alias("y"))
    for level in (0, 1, 2):
        tested = A.accuracy(place.where(F.col("admin_level") == level).select("name", F.col("lon").alias("x"), F.col("lat").alias("y")), expected)
        M.append(tested.select(F.lit(level).alias("admin_level"), "n", "accuracy", F.current_timestamp().alias("created")), path)
    return spark.read.parquet(path).select("admin_level", "n", "accuracy", F.col("created").isNotNull().alias("logged"))


@query("p14_place_fields", "v_place", sql="SELECT id, country_code, name, name_normalized, admin_level FROM v_place")
def place_fields(place):
    return place.select("id", "country_code", "name", "name_normalized", "admin_level")


@query("j07_best_target", "v_place", "v_wikipedia", sql="""WITH t AS (SELECT DISTINCT substr(name, 1, length(name) - 1) AS target FROM v_place), n AS (SELECT DISTINCT name FROM v_place WHERE name NOT IN (SELECT target FROM t)),
 x AS (SELECT name, target, levenshtein(name, target) AS d FROM n JOIN t ON left(name, 1) = left(target, 1) WHERE levenshtein(name, target) <= 2),
 b AS (SELECT name, min(target) AS target, CAST(min(d) AS INT) AS edit_distance FROM x WHERE (name, d) IN (SELECT (name, min(d)) FROM x GROUP BY name) GROUP BY 1) SELECT id AS place_id, target, edit_distance FROM v_place JOIN b USING (name)""")
def best_target(place, wikipedia):
    """The nearest of all names that lack their last letter, of each place."""
    names = place.select(F.expr("substr(name, 1, length(name) - 1)").alias("name"))
    return R.by_distance(names, place, wikipedia).select("place_id", "target", "edit_distance")


@query("j09_country_of_point", "v_place", "v_country", sql="SELECT p.id, coalesce(CASE WHEN p.id % 3 = 0 THEN p.country_code END, min_by(c.country_code, c.id)) AS country_code FROM v_place p LEFT JOIN v_country c ON lon > west AND lon < east AND lat > south AND lat < north GROUP BY p.id, p.country_code")
def country_of_point(place, country):
    """Only null countries are filled."""
    some = place.withColumn("country_code", F.when(F.col("id") % 3 == 0, F.col("country_code")))
    return G.fill_countries(some, country).select("id", "country_code")


@query("j11_within", "v_place", sql=f"SELECT a.id AS a, b.id AS b FROM v_place a JOIN v_place b ON a.name = b.name WHERE {METRES.format(a='a', b='b')} <= 1000000")
def within(place):
    """Places of one name within a radius of each other, themselves included."""
    inputs = place.select(F.col("id").alias("input_id"), "name", "lat", "lon", "population")
    return G.candidates_nearby(inputs, place, 1_000_000, exact=False).select(F.col("input_id").alias("a"), F.col("place_id").alias("b"))


@query("a12_repeated_tokens", "part", sql="SELECT token, count(*) AS count FROM (SELECT unnest(string_split(p_name || ' only' || p_partkey, ' ')) AS token FROM part) GROUP BY 1 HAVING count(*) > 1")
def repeated_tokens(part):
    """Every occurrence counts; tokens of one occurrence go."""
    tokens = part.select(F.explode(F.split(F.concat("p_name", F.lit(" only"), F.col("p_partkey").cast("string")), " ")).alias("token"))
    return A.repeated_tokens(tokens)


@query("w01_country_position", "v_place", sql="SELECT country_code, CAST(row_number() OVER (ORDER BY count(*) DESC, country_code) AS INT) AS ccrank FROM v_place WHERE name IN (SELECT name FROM v_place WHERE admin_level = 0) GROUP BY 1")
def country_position(place):
    return R.country_ranking(asked(place), place).select("country_code", "ccrank")


@query("w02_dense_rank", "v_featureplace", "v_feature", "v_place", sql="""SELECT order_id, country_code, CAST(dense_rank() OVER (PARTITION BY order_id ORDER BY count(*) DESC) - 1 AS INT) AS rank
 FROM v_featureplace fp JOIN v_feature f ON f.id = fp.feature_id JOIN v_place p ON p.id = fp.place_id WHERE verified GROUP BY 1, 2""")
def dense_rank(featureplace, feature, place):
    linked = featureplace.join(feature.where("verified").select(F.col("id").alias("feature_id"), "order_id"), "feature_id").join(place.select(F.col("id").alias("place_id"), "country_code"), "place_id")
    return A.country_ranks(linked).select("order_id", "country_code", F.col("rank").cast("int").alias("rank"))


@query("w03_ties", "v_featureplace", sql="SELECT place_id, id, rank() OVER (PARTITION BY place_id ORDER BY confidence DESC) = 1 AS correct FROM v_featureplace")
def ties(featureplace):
    """All equal best scores of a place are correct."""
    return R.mark_correct(featureplace.select("place_id", "id", "confidence"), "place_id", score="confidence").select("place_id", "id", "correct")


@query("t07_unordered", "v_place", sql="SELECT id FROM v_place WHERE country_code = 'Brand#11' OR admin_level = 0")
def unordered(place):
    return place.where((F.col("country_code") == "Brand#11") | (F.col("admin_level") == 0)).select("id")


@query("t08_score_order", "v_place", sql=f"""WITH x AS (SELECT a.id AS a, b.id AS b, {SCORE.format(m='(' + METRES.format(a='a', b='b') + ')')} + CAST(b.population IS NOT NULL AS INT) * 10 + CAST(b.admin_level IS NOT NULL AS INT) * 10 AS score
 FROM v_place a JOIN v_place b ON a.name = b.name WHERE {METRES.format(a='a', b='b')} <= 1000000) SELECT a, b, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM x""")
def score_order(place):
    """Candidates of each place by their score."""
    inputs = place.select(F.col("id").alias("input_id"), "name", "lat", "lon", "population")
    ranked = G.ranked_nearby(inputs, place, 1_000_000, WIDE)
    return ranked.select(F.col("input_id").alias("a"), F.col("place_id").alias("b"), "score", "place")


@query("t10_columns", "v_place", sql="""WITH u AS (SELECT unnest(['id', 'name']) AS f, unnest([count(DISTINCT id), count(DISTINCT name)]) AS n FROM v_place), m AS (SELECT unnest(['importance', 'admin_level']) AS f, unnest([median(importance), median(admin_level)]) AS n FROM v_place)
 SELECT (SELECT f FROM u ORDER BY n DESC, f LIMIT 1) AS first_by_uniqueness, (SELECT f FROM m ORDER BY n DESC, f LIMIT 1) AS first_by_median""")
def columns(place):
    """Columns of a layer by uniqueness, and numeric ones by median."""
    profile = A.profile(place.select("id", "name", "importance", "admin_level"))
    falling = lambda c: F.struct(-F.col(c), "field")
    texts = profile.where("median IS NULL OR field = 'id'").agg(F.min_by("field", falling("uniqueness")).alias("first_by_uniqueness"))
    numbers = profile.where("field NOT IN ('id', 'name')").agg(F.min_by("field", falling("median")).alias("first_by_median"))
    return texts.join(numbers, F.lit(True))


@query("t11_by_name", "v_place", sql="SELECT name, id FROM v_place ORDER BY name, id")
def by_name(place):
    return place.select("name", "id").orderBy("name", "id")


@query("t13_any_order", "v_feature", sql="SELECT id FROM v_feature")
def any_order(feature):
    """Shuffled rows are the same rows."""
    return feature.select("id").orderBy(F.rand(7))


@query("t14_full_groups", "orders", sql="SELECT o_orderkey // 5000 AS batch, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 5000")
def full_groups(orders):
    """Groups of 5,000 lines by number, an incomplete one left out."""
    return orders.groupBy(F.floor(F.col("o_orderkey") / 5000).alias("batch")).agg(F.count(F.lit(1)).alias("n")).where("n = 5000")


@query("u01_by_name_and_alias", "v_place", "v_alias", "v_wikipedia", sql="""WITH n AS (SELECT name FROM v_place WHERE admin_level = 0 UNION SELECT alias FROM v_alias WHERE place_id IN (SELECT id FROM v_place WHERE admin_level = 0))
 SELECT id AS place_id, CAST(NULL AS VARCHAR) AS alias FROM v_place WHERE name IN (SELECT name FROM n) UNION ALL SELECT place_id, alias FROM v_alias WHERE alias IN (SELECT name FROM n)""")
def by_name_and_alias(place, alias, wikipedia):
    """A place found by its name and by an alias comes twice."""
    first = place.where("admin_level = 0").select(F.col("id").alias("place_id"))
    names = asked(place).union(alias.join(first, "place_id", "left_semi").select("alias"))
    return Q.union_all(R.by_name(names, place, wikipedia), R.by_alias(names, place, alias, wikipedia)).select("place_id", "alias")


@query("d16_finish", "v_feature", sql="SELECT id, id % 2 = 0 AS complete, CAST(CASE WHEN id % 2 = 0 THEN 90 END AS BIGINT) AS duration FROM v_feature")
def finish(feature):
    orders = feature.select("id", F.col("start_ts").cast("timestamp").alias("start"))
    ends = orders.where("id % 2 = 0").select(F.col("id").alias("order_id"), (F.col("start") + F.expr("INTERVAL 90 SECONDS")).alias("end"))
    return Q.finish(orders, ends).select("id", "complete", "duration")


@query("f01_edit_distance", "v_place", sql="SELECT id, CAST(levenshtein(name, substr(name, 3)) AS INT) AS two, CAST(CASE WHEN levenshtein(name, substr(name, 5)) <= 2 THEN 0 ELSE -1 END AS INT) AS four FROM v_place")
def edit_distance(place):
    """-1 beyond the threshold."""
    return place.select("id", F.levenshtein("name", F.expr("substr(name, 3)"), 2).alias("two"), F.levenshtein("name", F.expr("substr(name, 5)"), 2).alias("four"))


@query("f19_casts", "v_place", sql="SELECT id, CAST(CAST(greatest(abs(lon), abs(lat)) AS DECIMAL(10, 2)) AS DOUBLE) AS most, CAST(population > 20000 AS INT) AS large, CAST(id AS VARCHAR) AS name FROM v_place")
def casts(place):
    return place.select("id", F.greatest(F.abs("lon"), F.abs("lat")).cast("decimal(10,2)").cast("double").alias("most"), (F.col("population") > 20000).cast("int").alias("large"), F.col("id").cast("string").alias("name"))


@query("f23_tokens", "v_place", sql="SELECT id, 25 AS len, true AS alphanumeric FROM v_place")
def tokens(place):
    token = place.select("id", T.random_token().alias("token"))
    return token.select("id", F.length("token").alias("len"), F.col("token").rlike("^[0-9A-Za-z]+$").alias("alphanumeric"))


@query("g01_points", "v_place", sql="SELECT id, lon AS x, lat AS y FROM v_place")
def points(place):
    return place.select("id", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("point")).select("id", "point.x", "point.y")


@query("g04_within_5m", "v_place", sql=f"SELECT a.id, a.id % 10 AS step FROM v_place a JOIN (SELECT id, lat + (id % 10) * 0.000009::DOUBLE AS lat, lon FROM v_place) b ON a.id = b.id WHERE {METRES.format(a='a', b='b')} < 5")
def within_5m(place):
    """Points a metre further north at each step."""
    north = F.col("lat") + (F.col("id") % 10) * 0.000009
    return place.where(geodesic.nearer(F.col("lat"), F.col("lon"), north, F.col("lon"), 5)).select("id", (F.col("id") % 10).alias("step"))


@query("g07_reprojected", "v_place", sql="SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_place WHERE abs(lat) < 85")
def reprojected(place):
    """From web mercator metres back to degrees."""
    y = F.ln(F.tan(F.radians(F.col("lat")) / 2 + F.lit(math.pi / 4))) * 6378137.0
    metres = place.where(F.abs("lat") < 85).select("id", (F.radians("lon") * 6378137.0).alias("x"), y.alias("y"))
    point = metres.select("id", S.from_web_mercator(F.col("x"), F.col("y")).alias("p"))
    return point.select("id", (F.round("p.lon", 6) + 0.0).alias("lon"), (F.round("p.lat", 6) + 0.0).alias("lat"))


@query("g08_multipolygon", "v_country", sql="SELECT id, 1 AS polygons, 5 AS vertices, west AS x, south AS y FROM v_country")
def multipolygon(country):
    """A polygon as a multipolygon, and the first of many points."""
    shape = S.as_multipolygon(F.get(S.box_polygon(F.col("west"), F.col("east"), F.col("south"), F.col("north")), 0))
    ring = F.get(F.get(F.col("shape"), 0), 0)
    return country.select("id", shape.alias("shape")).select("id", F.size("shape").alias("polygons"), F.size(ring).alias("vertices"), F.element_at(ring, 1)["x"].alias("x"), F.element_at(ring, 1)["y"].alias("y"))


@query("g09_geojson", "v_place", sql="""SELECT id, '{"geometries": [{"coordinates":[' || round(lon, 6) || ',' || round(lat, 6) || '],"type":"Point"}], "type": "GeometryCollection"}' AS geometry FROM v_place""")
def geojson(place):
    none = F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>")
    return place.select("id", S.geojson(none, F.col("lon"), F.col("lat")).alias("geometry"))


@query("g11_simplified", "v_country", sql="SELECT id, 5 AS vertices, (east - west) * (north - south) AS area FROM v_country")
def simplified(country):
    """A vertex in the middle of an edge goes, corners stay."""
    ring = F.get(F.get(S.box_polygon(F.col("west"), F.col("east"), F.col("south"), F.col("north")), 0), 0)
    middle = F.struct(((F.col("west") + F.col("east")) / 2).alias("x"), F.col("south").alias("y"))
    shaped = country.select("id", F.array(F.array(F.concat(F.slice(ring, 1, 1), F.array(middle), F.slice(ring, 2, 4)))).alias("mpoly"))
    out = F.get(F.get(F.col("mpoly"), 0), 0)
    return M.simplified(shaped).select("id", F.size(out).alias("vertices"), F.round(S.area(out), 9).alias("area"))


@query("x09_additions", "v_place", "v_alias", "v_wikipedia", "v_feature", "v_featureplace", sql=order_sql("hot rin"))
def additions(place, alias, wikipedia, feature, featureplace):
    """A misspelt name that is added to an order: places within two edits in the order's first country, most probable first."""
    linked = featureplace.where("correct").join(feature.select(F.col("id").alias("feature_id"), "order_id"), "feature_id").join(place.select(F.col("id").alias("place_id"), "country_code"), "place_id")
    return R.possible_additions("hot rin", 7, A.country_ranks(linked), place, alias, wikipedia).select("place_id", "target", "edit_distance", "ccrank")


@query("x11_topic", "part")
def topic(part):
    """Names by the topic of a model of names and types; texts without known terms have none."""
    texts = part.select(F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return topics.build(texts, 5).topic(part.select("p_partkey", F.col("p_name").alias("text"))).select("p_partkey", "topic_id")


@query("x16_styles", "v_feature", sql="SELECT id AS feature_id, order_id AS mapstyle_id, row_number() OVER (PARTITION BY order_id ORDER BY id) <= 10 AS label FROM v_feature")
def styles(feature):
    return Q.style(feature)


# --- shapes in files, kept lookups, names of datasets, means ----------------------------------------------------------------


def _put(spark, path, data):
    """Writes one small file through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(data)
    out.close()


def _boxes(country):
    """Records, points and shapes of the countries, of which there are a few dozen."""
    rows = country.orderBy("id").collect()
    ring = lambda r: [(r.west, r.south), (r.east, r.south), (r.east, r.north), (r.west, r.north), (r.west, r.south)]
    return [[r.country_code, "1.0", r.country_code, str(r.id), None, None, None] for r in rows], [(r.west, r.south) for r in rows], [[[ring(r)]] for r in rows]


def _read_shapes(spark, path):
    rows = files.shapes(spark, path).where(F.col("mpoly").isNotNull())
    ring = F.get(F.get("mpoly", F.lit(0)), F.lit(0))
    return rows.select(F.col("attributes")["geonames_i"].cast("long").alias("id"), F.col("attributes")["countrycod"].alias("country_code"), F.size("mpoly").alias("polygons"), F.size(ring).alias("vertices"), F.round(S.area(ring), 6).alias("area"))


BOXES = "SELECT id, country_code, 1 AS polygons, 5 AS vertices, round((east - west) * (north - south), 6) AS area FROM v_country"


@query("sc07_shapefile", "v_country", sql=BOXES)
def shapefile(country):
    """Polygons and attributes of .shp and .dbf files."""
    import io
    import zipfile

    spark, path = country.sparkSession, scratch(country.sparkSession, "shp")
    with zipfile.ZipFile(io.BytesIO(sinks.shape_zip("boxes", *_boxes(country)))) as z:
        for name in z.namelist():
            _put(spark, f"{path}/{name}", z.read(name))
    return _read_shapes(spark, path)


@query("sc08_country_zips", "v_country", sql=BOXES)
def country_zips(country):
    """The same from two zips."""
    spark, path = country.sparkSession, scratch(country.sparkSession, "zips")
    for half in (0, 1):
        _put(spark, f"{path}/half{half}.zip", sinks.shape_zip(f"half{half}", *_boxes(country.where(F.col("id") % 2 == half))))
    return _read_shapes(spark, path)


@query("sc16_kept_lookup", "v_place", sql="SELECT name AS title, max(id) AS id FROM v_place GROUP BY 1")
def kept_lookup(place):
    """A lookup from titles to places, built once and then read from where it's kept."""
    spark, path = place.sparkSession, scratch(place.sparkSession, "lookup")

    def again():
        raise AssertionError("the lookup was built twice")

    files.cached(spark, path, lambda: place.groupBy(F.col("name").alias("title")).agg(F.max("id").alias("id")))
    return files.cached(spark, path, again)


@query("f27_means", "v_place", sql="""WITH m AS (SELECT country_code, avg(lon) AS x, avg(lat) AS y, median(population) AS middle FROM v_place GROUP BY 1)
 SELECT id, round(sqrt(pow(lon - x, 2) + pow(lat - y, 2)), 6) AS distance, CAST(middle AS DOUBLE) AS middle FROM v_place JOIN m USING (country_code)""")
def means(place):
    """Each place's distance from the mean point of its country, and the country's median population."""
    mean = place.groupBy("country_code").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.median("population").cast("double").alias("middle"))
    square = lambda a, b: F.pow(F.col(a) - F.col(b), F.lit(2.0))
    return place.join(mean, "country_code").select("id", F.round(F.sqrt(square("lon", "x") + square("lat", "y")), 6).alias("distance"), "middle")


@query("f28_dataset_name", "pages", sql="SELECT page_id, replace(replace(regexp_replace(url, '[./:-]', '_', 'g'), '___', '_'), '__', '_') AS name FROM pages")
def dataset_name(pages):
    return pages.select("page_id", T.dataset_name(F.col("url")).alias("name"))

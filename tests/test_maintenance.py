"""Jobs around the tables."""

from pyspark.sql import functions as F

from placewright.plans import maintenance as M
from placewright.sources import sinks

PLACES = "id long, name string, lat double, lon double, country_code string, population long, admin_level int"


def test_ranks_are_replaced_by_order(spark, tmp_path):
    at = str(tmp_path / "ranks")
    M.replace_ranks(spark.createDataFrame([(1, "A"), (2, "B")], "order_id long, country_code string"), at)
    M.replace_ranks(spark.createDataFrame([(2, "C"), (2, "C"), (2, "D")], "order_id long, country_code string"), at)
    got = {(r.order_id, r.country_code, r["rank"]) for r in spark.read.parquet(at).collect()}
    assert got == {(1, "A", 0), (2, "C", 0), (2, "D", 1)}
    M.append(spark.createDataFrame([(3, "E")], "order_id long, country_code string"), str(tmp_path / "log"))
    M.append(spark.createDataFrame([(4, "E")], "order_id long, country_code string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_single_places(spark):
    places = spark.createDataFrame([(1, " Éa ", 0.0, 0.0, None, None, 0), (2, "Bb", 1.0, 1.0, "X", 5, 2)], PLACES)
    after, got = M.conflate_one(places, "Bb", 1.0, 1.0001, 9)
    assert got.first().id == 2 and after.count() == 2
    after, got = M.conflate_one(places, "Bb", 50.0, 1.0)
    assert got.first().id == 3 and after.count() == 3
    assert M.trimmed_countries(places).where("id = 1").first().name == "Éa"
    assert M.normalized(places).where("id = 1").first().name_normalized.strip() == "ea"
    assert M.reset_topics(places).first().topic_id is None
    aliases = spark.createDataFrame([("B", 2)], "alias string, place_id long")
    assert M.add_alias(M.add_alias(aliases, places, "Bb", "Bee"), places, "Bb", "Bee").count() == 2
    osm = spark.createDataFrame([("Bern", "CH")], "name string, country string")
    wanted = spark.createDataFrame([("Bern", None), ("Bern", "DE")], "name string, country string")
    assert {r.country: r.found for r in M.in_osm(osm, wanted).collect()} == {None: True, "DE": False}
    urls = M.order_of_url(spark.createDataFrame([(4, "u")], "id long, url string"), spark.createDataFrame([("u",), ("v",)], "url string"))
    assert {r.url: r.order_id for r in urls.collect()} == {"u": 4, "v": None}
    assert spark.range(1).select(M.expired(F.date_sub(F.current_date(), 8)).alias("a"), M.expired(F.date_sub(F.current_date(), 7)).alias("b")).first() == (True, False)
    assert M.empty(spark, "PLACE").count() == 0


def test_shapes_are_simplified(spark):
    ring = [(0.0, 0.0), (5.0, 0.001), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, [[ring]]), (2, None)], "id int, mpoly array<array<array<struct<x:double,y:double>>>>")
    got = {r.id: r.mpoly for r in M.simplified(df).collect()}
    assert len(got[1][0][0]) == 5 and got[2] is None


def test_dataset(spark, tmp_path):
    rows = [(f"Town {chr(97 + i)}x", f"XX{i:03d}", "XX000", float(i), 1.0) for i in range(20)]
    layer = spark.createDataFrame(rows, "NAME string, PCODE string, PARENT_PC string, lon double, lat double")
    places = spark.createDataFrame([(1, "Town ax", 1.0, 0.0, "AA", 5, 3)], PLACES)
    box = spark.createDataFrame([(9, "AA", -1.0, 50.0, -1.0, 50.0)], "id long, country_code string, west double, east double, south double, north double")
    out = M.load_dataset(layer, "layer adm3", places, box)
    assert out["links"].count() == 1 and out["new"].count() == 19 and out["parents"].count() == 20
    links = places.withColumn("feature_id", F.lit(1)).withColumn("place_id", F.col("id")).withColumn("confidence", F.lit(0.5))
    sinks.write_map(links, str(tmp_path / "m"), "csv")
    assert M.map_exists(spark, str(tmp_path / "m"), "csv") and not M.map_exists(spark, str(tmp_path / "m"), "xy")

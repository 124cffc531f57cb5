"""Readers, writers, geometry, layers, topics, streaming and the small rules of the engine."""

import io
import json
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright import schema
from placewright.functions import spatial as S
from placewright.functions import text as T
from placewright.queries.made_files import pdf_bytes, xls_bytes
from placewright.operators import analytics, extract, gazetteer, layers, resolve, topics
from placewright.plans import export, request
from placewright.sources import files, sinks
from placewright.streaming import geoparse


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def points(*pairs):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs])


OUTER = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]


def test_polygon_with_hole(spark):
    shape = F.array(F.array(points(*OUTER), points(*HOLE)))
    for x, y, want in [(1, 1, True), (5, 5, False), (11, 5, False), (5, 3.9, True), (-1, 5, False)]:
        assert one(spark, S.contains(shape, F.lit(float(x)), F.lit(float(y)))) is want
    assert one(spark, S.polygon_area(F.get(shape, 0))) == 96.0
    c = one(spark, S.centroid(points(*OUTER)))
    assert (c.x, c.y) == (5.0, 5.0)
    assert one(spark, S.contains(F.lit(None).cast("array<array<array<struct<x:double,y:double>>>>"), F.lit(1.0), F.lit(1.0))) in (None, False)
    b = one(spark, S.box(shape))
    assert (b.west, b.east, b.south, b.north) == (0, 10, 0, 10)


def test_distance_and_bands(spark):
    assert [one(spark, S.band_score(F.lit(float(m)))) for m in (1, 10, 100, 1000, 10000, 10001)] == [11111, 1111, 111, 11, 1, 0]



def test_text_rules(spark):
    assert one(spark, T.normalize(F.lit("São Tomé"))) == "sao tome"
    assert one(spark, T.normalize(F.lit("Éa"))) == "éa"
    assert one(spark, T.without_prefix(F.lit("de Leon"))) == "Leon"
    assert one(spark, T.without_prefix(F.lit("eden"))) == "eden"
    assert one(spark, T.pattern_names(F.lit("Rio de Janeiro and New York City, not a Bay"))) == ["Rio de Janeiro", "New York City"]
    assert one(spark, T.ngrams(F.array(F.lit("a")))) == []
    assert one(spark, T.ngrams(F.split(F.lit("a b c"), " "))) == ["a b", "b c"]
    assert one(spark, T.bare(F.lit(".;,x,;."))) == ";,x,;"
    assert one(spark, T.prettify_topic(F.lit('0.5*"red" + 0.2*"blue" + 0.1*"x1" + 0.1*"tan"'))) == "red, blue and tan"
    assert one(spark, T.fixed_url(F.lit('"https://www.google.com/url?q=1&url=http%3A%2F%2Fa.example.com%2Fx&z=2"'))) == "http://a.example.com/x"
    assert one(spark, T.fixed_url(F.lit("a.example.com"))) == "http://a.example.com"
    assert [one(spark, T.admin_level(F.lit(x))) for x in ("adm2", "Shabiya", "the village", "none")] == [2, 1, 5, None]
    assert [one(spark, T.hygienic(F.lit(x))) for x in ("Rome", " ", "a,b", "a'b", "{x}")] == [True, False, False, False, False]
    assert len(one(spark, T.random_token(25))) == 25
    with pytest.raises(ValueError):
        T.random_token(-1)
    assert one(spark, T.tokenize(F.lit("The red_house: (in) Bali/again and_again averyverylongwordindeed"), ("again",))) == ["house", "bali"]


def test_names_of_by_length(spark):
    short = "lower words, only; here."
    assert "words" in one(spark, extract.names_of(F.lit(short))) and "lower words" in one(spark, extract.names_of(F.lit(short)))
    for n, pairs in ((499, True), (500, False)):
        text = ("abcd " * 100)[: n - 1] + "e"
        assert any(" " in x for x in one(spark, extract.names_of(F.lit(text)))) is pairs
    assert one(spark, extract.names_of(F.lit("abcde " * 20_000))) == []


def test_tables_and_pages(spark):
    places = spark.createDataFrame([(1, "Paris"), (2, "Rome")], "id long, name string")
    rows = spark.createDataFrame([(["Paris", "1"],), (["Rome", "2"],), (["", "3"],), (["Nowhere"],), (["city", "n"],)], "cells array<string>")
    out = extract.locations_in_table(rows, ["city", "n"], places).collect()
    assert [(r.name, r.fields["n"]) for r in out] == [("Paris", "1"), ("Rome", "2"), ("Nowhere", None)]
    assert extract.locations_in_table(rows, ["x", "y"], places).count() >= 3
    html = "<body><script>var Bad=1</script><table><tr><th>City</th></tr><tr><td><b>Paris</b></td></tr></table>Visit Rome and Paris &amp; Milano.</body>"
    pages = spark.createDataFrame([(1, "http://h/x/", html)], "page_id long, url string, html string")
    got = {(r.name, r.origin) for r in extract.locations_in_pages(pages, "page_id", places).collect()}
    assert ("Paris", "table") in got and ("Milano", "text") in got and ("Paris", "text") not in got
    linked = pages.withColumn("html", F.lit('<a href="a.zip">x</a><a class=z href="/b.ZIP"></a><a href="http://o/c.zip"></a>'))
    assert sorted(r.link for r in extract.zip_links(linked).collect()) == ["http://h/b.ZIP", "http://h/x/a.zip", "http://o/c.zip"]


def test_readers(spark, tmp_path):
    (tmp_path / "alt.tsv").write_text('5\t7\ten\tNew "York\t\t1\t\t\n')
    r = files.alternate_names(spark, str(tmp_path / "alt.tsv")).first()
    assert (r.geonameid, r.alternate_name, r.language) == (5, 'New "York', "en")
    (tmp_path / "osm.tsv").write_text("\t".join(["Bern", "NULL", "node", "12", "place", "city", "7.4", "46.9", "16", "0.6"] + ["NULL"] * 13) + "\n")
    r = files.osm_names(spark, str(tmp_path / "osm.tsv")).first()
    assert (r.name, r.alternative_names, r.osm_id, r.importance) == ("Bern", None, 12, 0.6)
    (tmp_path / "g.tsv").write_text("1\tA;B\n2\tC\n")
    assert [(r.page_id, r.position, r.title) for r in files.genesis(spark, str(tmp_path / "g.tsv")).collect()] == [("1", 0, "A"), ("1", 1, "B"), ("2", 0, "C")]
    (tmp_path / "list.txt").write_text("# no\n\na/b.zip\n")
    assert [r.path for r in files.dataset_list(spark, str(tmp_path / "list.txt")).collect()] == ["a/b.zip"]
    head = "#x\niso\tiso3\tn\tfips\tc\tcap\ta\tp\tLanguages\n"
    (tmp_path / "c.txt").write_text(head + "\t".join(["AD", "AND", "020", "AN", "Andorra", "A", "468", "84000", "EU", ".ad", "EUR", "Euro", "376", "x", "y", "ca", "3041565", "ES,FR", ""]) + "\n")
    r = files.country_info(spark, str(tmp_path / "c.txt")).collect()
    assert [(x.country, x.geonameid) for x in r] == [("Andorra", 3041565)]
    (tmp_path / "p.tsv").write_text("id\tname\n" + "")
    assert files.metadata_entries(spark.createDataFrame([(1, {"a": "b"})], "id long, fields map<string,string>")).first().value == "b"
    assert files.basemaps(spark, {"OSM": ["Mapnik", "DE"], "Stamen": [], "MapBox": ["x"]}).count() == 3


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("city,n\nParis,1\n")
    (tmp_path / "in" / "b.txt").write_text("Rome")
    with zipfile.ZipFile(tmp_path / "in" / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Oslo</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "in" / "d.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Lima</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "in" / "e.zip").write_text("x")
    (tmp_path / "in" / "f.pdf").write_bytes(pdf_bytes(["Kyiv lies on the Dnipro.", "Київ"]))
    (tmp_path / "in" / "g.xls").write_bytes(xls_bytes([["city", "n"], ["Oslo", 7]]))
    for bad in ("h.pdf", "i.xls", "j.docx", "k.xlsx"):
        (tmp_path / "in" / bad).write_bytes(b"damaged")
    (tmp_path / "in" / "l.pdf").write_bytes(pdf_bytes(["x"])[:300])
    rows = files.parsed_files(spark, str(tmp_path / "in")).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.error) == ["h.pdf", "i.xls", "j.docx", "k.xlsx", "l.pdf"]
    rows = [r for r in rows if not r.error]
    assert [r.text for r in rows if r.kind == "pdf"] == ["Kyiv lies on the Dnipro.\nКиїв"] and [r.cells for r in rows if r.kind == "xls"] == [["city", "n"], ["Oslo", "7"]]
    rows = [r for r in rows if r.kind not in ("pdf", "xls")]
    by = {(r.kind, r.row): (r.text, r.cells) for r in rows}
    assert by[("csv", 1)][1] == ["Paris", "1"] and by[("txt", None)][0] == "Rome" and by[("docx", None)][0] == "Oslo" and by[("xlsx", 0)][1] == ["", "Lima", "3"]
    assert len(rows) == 5


def test_shapes(spark, tmp_path):
    folder = tmp_path / "shp"
    folder.mkdir()
    (folder / "p.shp").write_bytes(sinks.shp_bytes([(1.5, 2.5), (3.0, 4.0)]))
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5]) + b"\0" * 15
    (folder / "p.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 2, 65, 6) + b"\0" * 20 + field + b"\r" + b" Aaa  " + b" Bbb  ")
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (folder / "q.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    rows = files.shapes(spark, str(folder)).orderBy("path", "record").collect()
    assert [(r.lon, r.lat, r.attributes) for r in rows[:2]] == [(1.5, 2.5, {"NAME": "Aaa"}), (3.0, 4.0, {"NAME": "Bbb"})]
    assert len(rows[2].mpoly[0][0]) == 4


def test_shapes_of_every_type(spark, tmp_path):
    """Z and M values are passed over, a point of several is the first, and a type that isn't known raises."""
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    flat = lambda points: b"".join(struct.pack("<2d", *p) for p in points)
    parts = lambda kind: struct.pack("<i4d2ii", kind, 0, 0, 1, 1, 1, len(ring), 0) + flat(ring) + struct.pack("<2d4d", 0, 9, 5, 6, 7, 8)
    several = lambda kind: struct.pack("<i4di", kind, 0, 0, 1, 1, 2) + flat([(7.0, 8.0), (9.0, 9.0)]) + struct.pack("<2d2d", 0, 9, 5, 6)
    single = lambda kind: struct.pack("<i2d2d", kind, 1.5, 2.5, 3.0, 4.0)
    bodies = [struct.pack("<i", 0)] + [f(k + m) for m in (0, 10, 20) for f, k in ((single, 1), (parts, 3), (parts, 5), (several, 8))]

    def put(name, bodies):
        (tmp_path / name).write_bytes(b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies)))

    put("a.shp", bodies)
    rows = files.shapes(spark, str(tmp_path)).orderBy("record").collect()
    assert len(rows) == 13
    for r in rows:
        kind = (r.record - 1) % 4 if r.record else None
        assert (r.lon, r.lat) == ({0: (1.5, 2.5), 3: (7.0, 8.0)}.get(kind, (None, None)))
        assert (r.mpoly is not None) == (kind == 2)
    put("b.shp", [struct.pack("<i", 31) + b"\0" * 40])
    with pytest.raises(Exception, match="type 31"):
        files.shapes(spark, str(tmp_path)).collect()


@pytest.fixture
def links(spark):
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    rows = [(1, 11, "Aä", 0.5, 2.0, 1.0, "FR", None, 3, square), (2, 12, 'B"q', 0.25, 4.0, 3.0, None, "p1", None, None), (3, 13, "C", None, 6.0, 5.0, "DE", None, 1, square * 2)]
    return spark.createDataFrame(rows, "feature_id long, place_id long, name string, confidence double, lat double, lon double, country_code string, pcode string, admin_level int, mpoly array<array<array<struct<x:double,y:double>>>>").withColumn("importance", F.lit(None).cast("double"))


def test_geojson(links, tmp_path):
    sinks.write_geojson(links, str(tmp_path / "g"))
    lines = [line for p in sorted((tmp_path / "g").glob("part-*")) for line in p.read_text().splitlines()]
    found = json.loads(sinks.collection(lines))
    props = [f["properties"] for f in found["features"]]
    assert [p["name"] for p in props] == ['B"q', "Aä", "C"]
    kinds = [[g["type"] for g in f["geometry"]["geometries"]] for f in found["features"]]
    assert kinds == [["Point"], ["Point", "Polygon"], ["Point", "MultiPolygon"]]
    assert props[0]["country_code"] is None and props[0]["importance"] == 0.0 and found["features"][1]["geometry"]["geometries"][0]["coordinates"] == [1.0, 2.0]


def test_maps(links, spark, tmp_path):
    assert sinks.csv_rows(links).columns == ["name", "confidence", "latitude", "longitude", "country_code", "geonameid", "pcode", "mpoly"]
    paths = sinks.write_map(links, str(tmp_path / "m"))
    assert {p.rsplit("/", 1)[1] for p in paths} == {"csv", "geojson", "shp", "xy"}
    assert spark.read.text(str(tmp_path / "m" / "xy")).first().value == "[1.0,2.0]"
    with pytest.raises(ValueError):
        sinks.write_map(links, str(tmp_path / "n"), "pdf")
    assert sinks.xy(links.limit(0)).first().xy == "null"
    assert sinks.shape_parts(links).count() == 3
    sinks.write_tsv(links.select("name"), str(tmp_path / "t"))


def test_shape_maps(links, spark, tmp_path):
    """Points and polygons come back with their attributes; holes stay with their polygon."""
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    holed = [(4, 14, "é" * 200, 0.125, None, 1.0, "IT", "p4", None, [[ring(0.0, 9.0), ring(1.0, 2.0)], [ring(20.0, 21.0)]])]
    links = links.withColumn("start", F.lit("2020-03-04").cast("date"))
    links = links.unionByName(spark.createDataFrame(holed, links.drop("importance", "start").schema), allowMissingColumns=True)
    sinks.write_map(links, str(tmp_path / "m"), "shp")
    rows = files.zipped_shapes(spark, str(tmp_path / "m" / "shp")).collect()
    points = {r.attributes["geonames_i"]: r for r in rows if r.path.endswith("_points")}
    assert {k: (r.lon, r.lat) for k, r in points.items() if k != "14"} == {"11": (1.0, 2.0), "12": (3.0, 4.0), "13": (5.0, 6.0)}
    assert points["12"].attributes == {"name": 'B"q', "confidence": "0.25", "countrycod": "", "geonames_i": "12", "pcode": "p1", "start_time": "20-03-04", "end_time": ""}
    assert points["14"].attributes["name"] == "é" * 127
    found = {}
    for r in rows:
        if r.path.endswith("_polygons"):
            found.setdefault(r.attributes["geonames_i"], []).append([[len(x) for x in polygon] for polygon in r.mpoly])
    assert {k: sorted(v) for k, v in found.items()} == {"11": [[[4]]], "13": [[[4]], [[4]]], "14": [[[5]], [[5, 5]]]}
    assert sum(map(len, found.values())) == sinks.shape_parts(links).count()
    for data in spark.read.parquet(str(tmp_path / "m" / "shp")).collect():
        with zipfile.ZipFile(io.BytesIO(data.zip)) as z:
            for n in [n for n in z.namelist() if n.endswith(".shp")]:
                shp, shx = z.read(n), z.read(n[:-1] + "x")
                assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx)
                assert all(struct.unpack(">i", shp[2 * o : 2 * o + 4])[0] == i + 1 for i, (o, _) in enumerate(struct.iter_unpack(">2i", shx[100:])))
                assert z.read(n[:-3] + "prj").decode() == sinks.PRJ


PLACES = "id long, name string, lat double, lon double, country_code string, population long, admin_level int"


def test_conflation(spark):
    places = spark.createDataFrame([(1, "A", 0.0, 0.0, None, None, 1), (2, "A", 0.0, 0.05, "X", 1000, None), (3, "B", 0.0, 0.0, "X", 5, 2)], PLACES)
    inputs = spark.createDataFrame([(1, "A", 0.0, 0.0001, "Y", 990, 0.1), (2, "A", 50.0, 50.0, "Z", 7, 0.2), (3, "A", 50.0, 50.001, "Z", 8, 0.3), (4, "C", 0.0, 0.0, None, None, 0.4)], "input_id long, name string, lat double, lon double, country_code string, population long, importance double")
    best = {r.input_id: r.place_id for r in gazetteer.best(gazetteer.candidates_nearby(inputs, places), "input_id").collect()}
    assert best == {1: 2}  # like population outweighs 11 m against 5.5 km
    out = {r.id: r for r in gazetteer.conflate(inputs, places).collect()}
    assert len(out) == 5  # the two inputs side by side are one new place
    closeness = {(a, b): one(spark, gazetteer.population_is_close(F.lit(a).cast("long"), F.lit(b).cast("long"))) for a in (None, 0, 950, 951, 1000) for b in (None, 0, 1000)}
    assert closeness[(951, 1000)] is True and closeness[(950, 1000)] is False and closeness[(None, 1000)] is False and closeness[(0, 0)] is False



def test_resolving(spark):
    places = spark.createDataFrame([(1, "Sao Paulo", "sao paulo", 10, 0.0, 0.0), (2, "São Paulo", "sao paulo", 10, 1.0, 1.0), (3, "Rio", "rio", 5, 2.0, 2.0)], "id long, name string, name_normalized string, population long, lat double, lon double")
    loc = spark.createDataFrame([(7, "São Paulo", 0, 2), (7, "Sao Paulo", 1, 3), (7, "bad, name", 2, 1), (7, "Rio", 3, None)], "order_id long, name string, position int, count int")
    feature, fp = resolve.resolve_locations(loc, places)
    f = {r.name: r.cnt for r in feature.collect()}
    assert f == {"Sao Paulo": 3, "Rio": 1}
    assert sum(r.correct for r in fp.collect()) == 3  # equal scores are all correct
    summed, _ = resolve.resolve_locations(loc, places, sum_counts=True)
    assert {r.name: r.cnt for r in summed.collect()} == {"Sao Paulo": 5, "Rio": 1}


def test_trained_score(spark):
    rows = [(float(i), i % 2 == 1 and i > 20) for i in range(60)]
    train = spark.createDataFrame([(a, 1.0 if b else 0.0) for a, b in rows], "importance double, correct double")
    model = resolve.trained_score(train, ["importance"])
    got = [r.score for r in model(train).orderBy("importance").collect()]
    assert got[0] < got[-1]


def test_ranks_with_null_country(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "A"), (1, "B"), (2, "A")], "order_id long, country_code string")
    got = {(r.order_id, r.country_code): r["rank"] for r in analytics.country_ranks(df).collect()}
    assert got == {(1, None): 0, (1, "A"): 1, (1, "B"): 1, (2, "A"): 0}


def test_corpus_popularity_as_written(spark):
    places = spark.createDataFrame([(1, "T", "t", "X"), (2, "U", "t", "Y"), (3, "V", "v", "Z")], "id long, enwiki_title string, name_normalized string, name string")
    titles = spark.createDataFrame([("T",), ("T",), ("V",)], "title string")
    assert {r.place_id: r.popularity for r in analytics.corpus_popularity(titles, places).collect()} == {1: 2, 2: -2, 3: 1}
    assert {r.place_id: r.popularity for r in analytics.corpus_popularity(titles, places, as_written=True).collect()} == {1: 0, 3: 1}


def test_accuracy_of_nothing(spark):
    none = spark.createDataFrame([], "name string, x double, y double")
    with pytest.raises(Exception, match="no features"):
        analytics.accuracy(none, none).collect()


def test_layers(spark):
    rows = [(f"Town {chr(97 + i // 26)}{chr(97 + i % 26)}", f"XX{i:03d}", f"XX{i // 10:03d}", float(i), "region" if i % 2 else "state") for i in range(60)]
    df = spark.createDataFrame(rows, "NAME_EN string, PCODE string, P_PC string, AREA_KM2 double, kind string")
    about = layers.parse_layer(df, "x")
    assert about["name"] == "NAME_EN" and about["pcode"] == "PCODE" and about["parent_pcode"] == "P_PC" and about["area_sqkm"] == "AREA_KM2" and about["admin_level"] == 1
    assert layers.load_layer(df, "x", "XX").count() == 60


def test_topics(spark):
    texts = ["river water flood water river"] * 6 + ["bank money credit money bank"] * 6 + [None, ""]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id long, text string, verified boolean")
    model = topics.build(df, k=2)
    got = {r.id: r.topic_id for r in model.topic(df).collect()}
    assert got[12] is None and len({got[i] for i in range(6)}) == 1
    assert model.show(3)[0][1].count('"') == 6
    fp = spark.createDataFrame([(i, 5, True) for i in range(12)], "feature_id long, place_id long, correct boolean")
    assert topics.tag_places(model, df, fp).count() == 1


def test_topics_of_rare_terms(spark):
    """Every repeated term has weights, however many terms are more frequent."""
    letters = str.maketrans("0123456789", "abcdefghij")
    word = lambda i: f"w{i:06d}".translate(letters)
    often = [(i, " ".join(word(j) for j in range(i * 100, i * 100 + 100)) + " common") for i in range(210)] * 3
    df = spark.createDataFrame([*often, *[(2000, "other thing")] * 400, (1000, "rare zebra"), (1001, "rare zebra"), (1002, "single")], "id long, text string")
    model = topics.build(df, k=2)
    assert model.weights.count() == 21_005
    got = {r.id: r.topic_id for r in model.topic(df).collect()}
    assert got[1000] is not None and got[1002] is None
    assert topics.build(df.where("id = 1002"), k=2).topic(df.where("id = 1000")).first().topic_id is None


def test_topics_against_numpy(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"term{chr(97 + i)}{chr(97 + t)}" for i in range(20)]) for _ in range(60 - 8 * t)) for t in range(6) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counts = {}
    for w in " ".join(texts).split():
        counts[w] = counts.get(w, 0) + 1
    terms = sorted(w for w in counts if counts[w] > 1)
    v = np.linalg.svd(np.array([[t.split().count(w) for w in terms] for t in texts], dtype=float))[2][:4]
    w = {r.term: r.w for r in topics.build(df, k=4).weights.collect()}
    assert sorted(w) == terms and np.allclose(np.abs(v), np.abs(np.array([w[t] for t in terms]).T), atol=1e-6)


def test_training_numbers(spark):
    rows = spark.createDataFrame([("p", 0, "A", 1, True), ("p", 0, "A", 2, False), ("p", 3, "B", 5, True)], "page_id string, position int, title string, place_id long, correct boolean")
    got = [(r.feature_no, r.featureplace_no) for r in export.numbered(rows).orderBy("position", "place_id").collect()]
    assert got == [(1, 1), (1, 2), (2, 3)]


def test_request(spark):
    places = spark.createDataFrame([(1, "Paris", "paris", 100)], "id long, name string, name_normalized string, population long").withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(2.0))
    rows = spark.createDataFrame([(1, 0, "text", "I like Paris. Really Paris."), (1, 1, "text", " "), (1, 2, "link", "a.example.com/x.csv"), (1, 5000, "text", "Paris")], "order_id long, source_no int, source_type string, data string")
    clean = request.cleaned_sources(rows).collect()
    assert [(r.source_no, r.kind) for r in clean] == [(0, "text"), (2, "csv")]
    feature, fp = request.request_map(rows, places)
    assert [(r.name, r.cnt, r.text) for r in feature.collect()] == [("Paris", 2, "I like Paris.")]


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "now in Paris"), (2, "Nothing")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    places = spark.createDataFrame([(9, "paris")], "id long, name_normalized string")
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = geoparse.mentions(stream, places).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.doc_id, r.place_id) for r in spark.table("found").collect()] == [(1, 9)]


def test_schema():
    assert len(schema.GEOENTITY) == 21 and "mpoly" in schema.PLACE.names


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_names_against_all_pairs(spark, monkeypatch):
    """No pair within so many edits is lost by the pieces, short names and repeated letters included, broadcast or not."""
    import random

    from placewright.operators import resolve as R

    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(500)})
    targets = sorted({*rng.sample(names, 20), *("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(60))})
    kinds = "id long, name string, lon double, lat double, country_code string, admin_level int, population long, feature_code string, importance double"
    places = spark.createDataFrame([(i, n, 1.0, 1.0, "X", None, None, None, None) for i, n in enumerate(names)], kinds)
    wiki = spark.createDataFrame([], "place_id long, charcount int")
    asked = spark.createDataFrame([(t,) for t in targets], "name string")
    for most in (1, 2, 3):
        want = {}
        for n in set(names) - set(targets):
            near = sorted((d, t) for t in targets if t[0] == n[0] and (d := _edits(n, t)) <= most)
            want |= {n: near[0]} if near else {}
        for few in (R.BROADCAST_NAMES, 0):
            monkeypatch.setattr(R, "BROADCAST_NAMES", few)
            got = {r.place_name: (r.edit_distance, r.target) for r in R.by_distance(asked, places, wiki, most=most).collect()}
            assert got == want


def test_nearby_against_all_pairs(spark):
    """No near pair is lost by the cubes, at the poles and the date line too."""
    import random

    from placewright.operators import gazetteer as G

    rng = random.Random(5)
    spot = lambda: rng.choice([(rng.uniform(89.9, 90), rng.uniform(-180, 180)), (rng.uniform(-0.1, 0.1), rng.choice([-180, 180]) + rng.uniform(-0.1, 0.1)), (rng.uniform(50, 50.2), rng.uniform(10, 10.2)), (rng.uniform(-90, -89.95), rng.uniform(-180, 180))])
    a, b = [(i, *spot()) for i in range(60)], [(i, *spot()) for i in range(60)]
    inputs = spark.createDataFrame([(i, "n", y, x, None) for i, y, x in a], "input_id long, name string, lat double, lon double, population long")
    places = spark.createDataFrame([(i, "n", y, x, None, None) for i, y, x in b], "id long, name string, lat double, lon double, population long, admin_level int")

    from placewright.functions import geodesic

    far = inputs.select("input_id", "lat", "lon").crossJoin(places.select("id", F.col("lat").alias("y"), F.col("lon").alias("x")))
    metres = {(r.input_id, r.id): r.m for r in far.select("input_id", "id", geodesic.distance(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")).alias("m")).collect()}
    for radius in (1_000, 10_000, 3_000_000, 30_000_000):
        want = {k for k, m in metres.items() if m <= radius}
        rows = G.candidates_nearby(inputs, places, radius).collect()
        assert {(r.input_id, r.place_id) for r in rows} == want and len(rows) == len(want) > 0


def test_medians(spark):
    import random
    import statistics

    from placewright.operators import analytics as A

    rng = random.Random(2)
    for n in (1, 2, 3, 4, 101, 5000):
        rows = [(rng.randint(0, 9), rng.choice([None, rng.gauss(0, 100)]), float(i)) for i in range(n)]
        got = {r.field: r.median for r in A.medians(spark.createDataFrame(rows, "a int, b double, `c.d` double"), ["a", "b", "c.d"]).collect()}
        for at, name in enumerate(("a", "b", "c.d")):
            known = [r[at] for r in rows if r[at] is not None]
            assert got.get(name) == (statistics.median(known) if known else None)


def test_folding_of_scripts(spark):
    from pyspark.sql import functions as F

    from placewright.functions import text as T

    cases = {"Ñandú": "nandu", "Straße": "strasse", "Łódź": "lodz", "Ærøskøbing": "aeroskobing", "Москва": "moskva", "Йошкар": "ioshkar", "Ἀθῆναι": "athenai", "Ho\u0302tel": "hotel", "Đà Nẵng": "da nang", "東京": "東京", "plain": "plain", "": ""}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, n string").select("n", T.fold(F.col("n")).alias("f"))
    assert {r.n: r.f for r in df.collect()} == cases


def test_tables_in_a_request(spark):
    """Tables in texts and parsed ones reach the map; quotes hold separators and line ends."""
    from pyspark.sql import functions as F

    from placewright.operators import extract as E
    from placewright.plans import request as Q

    text = 'no,City,"note, more"\r\n1,"Big ""Old"" Town",x\n\n2,Lima,"two\nlines"\n,,\n3,"city",z'
    (row,) = spark.range(1).select(E.table_cells(F.lit(text), ",").alias("c")).collect()
    assert row.c == [["no", "City", "note, more"], ["1", 'Big "Old" Town', "x"], ["2", "Lima", "two\nlines"], ["", "", ""], ["3", "city", "z"]]
    places = spark.createDataFrame([(1, "Lima", "lima"), (2, "Quito", "quito"), (3, "Cusco", "cusco")], "id long, name string, name_normalized string").withColumn("lon", F.lit(1.0)).withColumn("lat", F.lit(2.0))
    rows = [(1, 0, "csv", text), (1, 1, "tsv", "a\tb\nQuito\t5\nLima\t6\nnowhere\t7"), (1, 2, "text", "We went to Cusco and Lima."), (1, 3, "file", "book.xlsx"), (1, 4, "webpage", "<table><tr><td>Cusco</td></tr></table><p>then Quito</p>")]
    sources = spark.createDataFrame(rows, "order_id long, source_no int, source_type string, data string")
    tables = spark.createDataFrame([(1, 3, 0, ["Place", "n"]), (1, 3, 1, ["Lima", "2"]), (1, 3, 2, ["Lima", "3"])], "order_id long, source_no int, row int, cells array<string>")
    found = {(r.position, r.name): r["count"] for r in Q.locations(Q.cleaned_sources(sources), places, tables=tables).collect()}
    assert found == {(0, 'Big "Old" Town'): 1, (0, "Lima"): 1, (1, "Quito"): 1, (1, "Lima"): 1, (1, "nowhere"): 1, (2, "Cusco"): 1, (2, "Lima"): 1, (3, "Lima"): 2, (4, "Cusco"): 1, (4, "Quito"): 1}
    feature, links = Q.request_map(sources, places, tables=tables)
    assert {r.name for r in feature.collect()} == {"Lima", "Quito", "Cusco"} and links.where("correct").count() == 3


def test_topics_are_singular_vectors(spark):
    """Weights are those of the bags' decomposition, up to sign, and each text has its topic."""
    import random

    import numpy as np

    from placewright.operators import topics

    rng = random.Random(7)
    groups = [[f"{g}{w}" for w in ("mountain", "valley", "bridge", "harbour", "castle", "forest")] for g in ("ab", "cd", "ef")]
    texts = [" ".join(rng.choices(groups[i % 3], k=rng.randint(5, 15 + 5 * (i % 3)))) for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(5)
    model = topics.build(df, 3)
    weights = {r.term: r.w for r in model.weights.collect()}
    terms = sorted({w for t in texts for w in t.split() if sum(x.split().count(w) for x in texts) > 1})
    assert sorted(weights) == terms
    bags = np.array([[t.split().count(w) for w in terms] for t in texts], float)
    _, _, v = np.linalg.svd(bags, full_matrices=False)
    got = np.array([weights[w] for w in terms])
    for k in range(3):
        assert abs(abs(v[k] @ got[:, k]) - 1) < 1e-6
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-8)
    best = {r.i: r.topic_id for r in model.topic(df).collect()}
    assert best == {i: int(np.argmax(np.round(bags[i] @ got, 9))) for i in range(90)}


def test_topics_send_the_driver_less_than_a_vector(spark, monkeypatch):
    """Vectors over terms or texts stay on the executors, and equal singular values all have theirs."""
    import pickle

    from pyspark import RDD

    from placewright.operators import topics

    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"w{200 * (i % 30) + j:05d}".translate(letters) for j in range(200)) for i in range(30)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(5)
    sent, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: (sent.append(collect(rdd)), sent[-1])[1])
    model = topics.build(df, 3)
    assert model.weights.count() == 6000 and model.k == 3
    assert 0 < max(len(pickle.dumps(s)) for s in sent) < 8 * 6000
    got = np.array([r.w for r in model.weights.collect()])
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-8)
    bags = {r.i: np.array(r.s) for r in df.select("i", F.explode(F.split("text", " ")).alias("term")).join(model.weights, "term").groupBy("i").agg(F.array(*[F.sum(F.col("w")[c]) for c in range(3)]).alias("s")).collect()}
    assert np.allclose(sum(s * s for s in bags.values()), 2 * 200, rtol=1e-8)


def test_names_are_counted_without_comparing_each_with_the_whole_text():
    """Counts and first sentences against a plain search; a long text of different words takes no time that grows with its square."""
    import random
    import time

    from placewright.operators import extract as E

    rng = random.Random(3)
    for few in (E.FEW, 0):
        E.FEW, kept = few, E.FEW
        for _ in range(200):
            text = "".join(rng.choice(["aa", "ab", "Aaaa", " ", " ", ". ", "\n", "Bo Aaaa ", " ", "x" * 70]) for _ in range(60))
            listed = list(dict.fromkeys([w for w in text.split(" ") if len(w) > 3 and (few or not set(w) & set(".\n"))] + ["Bo Aaaa"] * ("Bo Aaaa" in text)))
            sentences = E._SENTENCE.split(text)
            assert E.counted_names(text, listed) == [(max(1, text.count(n)), next((s for s in sentences if n in s), None)) for n in listed]
        E.FEW = kept
    words = [f"{i:06d}w" for i in range(12_000)]
    began = time.process_time()
    assert {c for c, _ in E.counted_names(" ".join(words), words)} == {1}
    assert time.process_time() - began < 0.5


def test_a_part_of_bags_takes_few_bytes_an_entry(monkeypatch):
    """A part is made, and multiplied, without arrays of longer numbers beside its entries; bags of any length, empty ones too, come out as by plain sums."""
    import tracemalloc

    import numpy as np

    from placewright.operators import lanczos

    monkeypatch.setattr(lanczos, "AT_ONCE", 10_000, raising=False)
    rng = np.random.default_rng(5)
    parts, sent, plain = 7, [], []
    for batch in range(50):
        lengths = rng.integers(0, 60, 400).astype("int32")
        lengths[[0, 399]] = 0, 25_000 * (batch == 3)
        at, n = rng.integers(0, 900, lengths.sum()).astype("int32"), rng.integers(1, 9, lengths.sum()).astype("int32")
        plain.append((lengths, at, n))
        sent.append((3, (0, batch, lengths.tobytes(), at.tobytes(), n.tobytes())))
    lengths, at, n = (np.concatenate(c) for c in zip(*plain, strict=True))
    tracemalloc.start()
    ((p, (_, part)),) = lanczos._part(parts)(reversed(sent))
    made = tracemalloc.get_traced_memory()[1]
    x = rng.uniform(-1, 1, len(lengths))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    sums = part.by_term(x)
    back = part.by_bag(sums)
    used = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert p == 3 and made < 30 * len(at) and used < 4 * len(at), (made / len(at), used / len(at))
    bag = np.repeat(np.arange(len(lengths)), lengths)
    want = np.bincount(at, weights=n * x[bag], minlength=900)
    assert np.allclose(sums, want[part.names]) and sorted(part.names.tolist()) == np.unique(at).tolist()
    assert np.allclose(back, np.bincount(bag, weights=n * want[at], minlength=len(lengths)))
    assert all((part.names[part.bounds[t] : part.bounds[t + 1]] % parts == t).all() for t in range(parts)) and part.bounds[-1] == len(part.names)

"""Whole flows: geoparsing, resolving, exporting, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import extract as E
from ..operators import layers, topics
from ..operators import resolve as R
from ..plans import export
from ..plans import request as Q
from ..session import kept
from ..sources import files, sinks
from .fixtures import ASKED, MISSPELT, asked, fold_sql, misspelt, pcoded, views
from .registry import query

NAMES_SQL = f"SELECT DISTINCT doc_id, name FROM (SELECT doc_id, CASE WHEN starts_with(n, 'de ') THEN substr(n, 4) ELSE n END AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{T.NAME}', 1)) AS n FROM documents) WHERE length(n) > 3) WHERE length(name) > 0"


FOLDED = f"CASE WHEN length({fold_sql('name')}) > 3 THEN {fold_sql('name')} ELSE lower(name) END"


def resolved(documents: DataFrame, place: DataFrame) -> DataFrame:
    """(doc_id, name, place_id, confidence, correct) of the names in documents."""
    found = E.names_in_text(documents, "doc_id", pattern_only=True).select(F.col("doc_id").alias("order_id"), "name", F.lit(0).alias("position"))
    #: Kept, as features and links are both made of them: texts are read once.
    found = kept(found.where(T.hygienic(F.col("name"))), "names")
    feature, fp = R.resolve_locations(found, place.withColumn("name_normalized", T.normalize(F.col("name"))).withColumn("population", F.length("name").cast("long")))
    return fp.join(feature.select("feature_id", "name"), "feature_id").select(F.col("order_id").alias("doc_id"), "name", "place_id", F.col("confidence").cast("double").alias("confidence"), "correct")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(*views(spark, sf_dir, "documents", "v_text_place"))


@query("x04_flagship", "documents", "v_text_place", sql=f"""WITH n AS ({NAMES_SQL}), l AS (SELECT doc_id, name, {{fold}} AS nn FROM n), d AS (SELECT doc_id, nn FROM l GROUP BY 1, 2)
 SELECT d.doc_id, p.id AS place_id FROM d JOIN (SELECT id, {{fold}} AS nn FROM v_text_place) p USING (nn)""".replace("{fold}", FOLDED))
def flagship_links(documents, place):
    """Each document's names and their candidate places."""
    return resolved(documents, place).select("doc_id", "place_id")


@query("x01_names", "documents", sql=NAMES_SQL)
def names(documents):
    """X01 by the pattern: distinct names of each document."""
    return E.names_in_text(documents, "doc_id", pattern_only=True)


@query("x01_names_with_words", "documents", sql=f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w FROM documents), bare AS (SELECT doc_id, trim(trim(trim(trim(unnest(w)), ','), ';'), '.') AS name FROM w WHERE length(text) < 100000),
 pairs AS (SELECT doc_id, trim(trim(trim(trim(w[i] || ' ' || w[i + 1]), ','), ';'), '.') AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE length(text) < 500)),
 n AS (SELECT * FROM bare UNION SELECT * FROM pairs UNION SELECT doc_id, name FROM ({NAMES_SQL}))
 SELECT doc_id, name, greatest(1, CAST((length(text) - length(replace(text, name, ''))) // length(name) AS INT)) AS count FROM n JOIN documents USING (doc_id) WHERE length(name) > 3""")
def names_with_words(documents):
    """X01 in full: pattern, words and word pairs, with their count."""
    return E.locations_in_text(documents, "doc_id", context=False)


def _clean_sql(html: str) -> str:
    """Text without scripts, styles, comments and tags; DuckDB's patterns know no references, so scripts and styles go one after the other."""
    for rx in ("(?is)<script\\b.*?</script>", "(?is)<style\\b.*?</style>", "(?s)<!--.*?-->", "<[^>]*>"):
        html = f"regexp_replace({html}, '{rx}', ' ', 'g')"
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{mark}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


ARTICLE_SQL = _clean_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")
PAGE_SQL = f"SELECT page_id, CASE WHEN length({ARTICLE_SQL}) > 500 THEN {ARTICLE_SQL} ELSE {_clean_sql('html')} END AS text FROM pages"
CELLS_SQL = r"""SELECT page_id, trim(regexp_replace(c, '<[^>]*>', '', 'g')) AS name FROM (SELECT page_id, unnest(regexp_extract_all(r, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1)) AS c FROM
 (SELECT page_id, unnest(regexp_extract_all(t, '(?is)<tr\b.*?</tr>')) AS r FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<table\b.*?</table>')) AS t FROM pages)))"""


@query("x03_pages", "pages", "v_text_place", sql=f"""WITH c AS (SELECT DISTINCT page_id, name FROM ({CELLS_SQL}) WHERE length(name) > 2 AND name IN (SELECT name FROM v_text_place)),
 p AS ({PAGE_SQL}), n AS ({NAMES_SQL.replace('doc_id', 'page_id').replace('FROM documents', 'FROM p')}) SELECT page_id, name, 'table' AS origin FROM c UNION ALL SELECT page_id, name, 'text' FROM (SELECT * FROM n EXCEPT SELECT * FROM c)""")
def pages(pages, place):
    return E.locations_in_pages(pages, "page_id", place)


@query("sc13_page_text", "pages", sql=PAGE_SQL)
def page_text(pages):
    return pages.select("page_id", E.page_text(F.col("html")).alias("text"))


@query("sc09_links", "pages", sql="""SELECT page_id, unnest(['http://other.example.com/' || page_id || '.ZIP', regexp_extract(url, '^(https?://[^/]+)', 1) || '/data/' || page_id || '.zip', regexp_replace(url, '[^/]*$', '') || 'x' || page_id || '.zip']) AS link FROM pages""")
def links(pages):
    """Links of every page to zips: whole, from the root, and relative ones; others are left out."""
    n = F.col("page_id").cast("string")
    html = F.concat("html", F.lit('<a href="http://other.example.com/'), n, F.lit('.ZIP">'), F.lit('<A class="x" HREF="/data/'), n, F.lit('.zip">'), F.lit('<a href="x'), n, F.lit('.zip">'), F.lit('<a href="y.zip.html"><b href="z.zip">'))
    return E.zip_links(pages.withColumn("html", html))


@query("sc11_source_kind", "pages", sql="SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'csv' WHEN page_id % 4 = 1 THEN 'docx' WHEN page_id % 4 = 2 THEN 'ignored' ELSE 'webpage' END AS kind FROM pages")
def source_kind(pages):
    ends = F.get(F.array(F.lit("/a.csv"), F.lit("/b.DOCX?x=1"), F.lit("/c.zip"), F.lit("/d")), (F.col("page_id") % 4).cast("int"))
    return pages.select("page_id", files.source_kind(F.concat(F.lit("http://h.example.com"), ends)).alias("kind"))


@query("x02_table", "part", "v_place", sql="SELECT p_name AS name, p_brand AS brand FROM part")
def table(part, place):
    """The location column is found by the gazetteer, as no header tells."""
    rows = part.select(F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("cells"))
    found = E.locations_in_table(rows, ["id", "what", "brand"], place)
    return found.select("name", F.col("fields")["brand"].alias("brand"))


ORDER_SQL = """WITH r AS (SELECT country_code, CAST(dense_rank() OVER (ORDER BY count(*) DESC) - 1 AS INT) AS ccrank FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id JOIN v_place p ON p.id = fp.place_id WHERE correct AND order_id = 7 GROUP BY 1),
 f AS (SELECT id AS place_id, name AS target, 0 AS edit_distance, country_code FROM v_place WHERE name = '{name}' UNION ALL SELECT p.id, alias, 0, country_code FROM v_place p JOIN v_alias a ON p.id = a.place_id WHERE alias = '{name}'{more})
 SELECT place_id, target, edit_distance, coalesce(ccrank, 999) AS ccrank FROM f LEFT JOIN r USING (country_code)"""


def order_sql(name: str) -> str:
    near = """ UNION ALL SELECT id, '{n}', CAST(levenshtein(name, '{n}') AS INT), country_code FROM v_place WHERE left(name, 1) = left('{n}', 1) AND name <> '{n}' AND levenshtein(name, '{n}') <= 2 AND country_code IN (SELECT country_code FROM r WHERE ccrank = 0)"""
    return ORDER_SQL.format(name=name, more=near.format(n=name))


@query("x06_candidates", "v_place", "v_alias", "v_wikipedia", "v_feature", "v_featureplace", sql=order_sql("red plate"))
def candidates(place, alias, wikipedia, feature, featureplace):
    """Possible additions for an order, most probable first."""
    linked = featureplace.where("correct").join(feature.select(F.col("id").alias("feature_id"), "order_id"), "feature_id").join(place.select(F.col("id").alias("place_id"), "country_code"), "place_id")
    return R.possible_additions("red plate", 7, A.country_ranks(linked), place, alias, wikipedia).select("place_id", "target", "edit_distance", "ccrank")


RESOLVE_SQL = f"""WITH w AS ({ASKED}), r AS (SELECT country_code, CAST(row_number() OVER (ORDER BY count(*) DESC, country_code) AS INT) AS ccrank FROM v_place WHERE name IN (SELECT name FROM w) GROUP BY 1),
 f AS (SELECT id AS place_id, name AS target, 0 AS edit_distance, country_code FROM v_place WHERE name IN (SELECT name FROM w){{here}} UNION ALL SELECT p.id, alias, 0, country_code FROM v_place p JOIN v_alias a ON p.id = a.place_id WHERE alias IN (SELECT name FROM w){{here}}{{more}})
 SELECT place_id, target, edit_distance, ccrank FROM f LEFT JOIN r USING (country_code)"""
#: Places near a misspelt name in some countries: the nearest, then the smallest target.
NEAR_SQL = """ UNION ALL SELECT id, min_by(target, d || target), CAST(min(d) AS INT), country_code FROM (SELECT id, country_code, target, levenshtein(name, target) AS d FROM v_place p JOIN ({targets}) t ON left(name, 1) = left(target, 1)
 WHERE country_code IN ({countries}) AND name NOT IN ({exact}) AND levenshtein(name, target) <= 2) GROUP BY id, country_code"""


@query("x07_resolve", "v_place", "v_alias", "v_wikipedia", sql=RESOLVE_SQL.format(here="", more=""))
def resolve(place, alias, wikipedia):
    """All places of the names of level 0."""
    return R.resolve(asked(place), place, alias, wikipedia).select("place_id", "target", "edit_distance", "ccrank")


@query("x08_resolve_in_countries", "v_place", "v_alias", "v_wikipedia", sql=RESOLVE_SQL.format(here=" AND country_code IN (SELECT country_code FROM v_place WHERE admin_level = 0 AND starts_with(name, 'r'))", more=""))
def resolve_in_countries(place, alias, wikipedia):
    """In the countries whose names begin with r."""
    wanted = asked(place)
    return R.resolve(wanted, place, alias, wikipedia, countries=wanted.where(F.col("name").startswith("r"))).select("place_id", "target", "edit_distance", "ccrank")


@query("x07_resolve_thorough", "v_place", "v_alias", "v_wikipedia", sql=RESOLVE_SQL.replace(f"({ASKED})", f"(SELECT target AS name FROM ({MISSPELT}) UNION {ASKED})", 1).format(
    here="", more=NEAR_SQL.format(targets="SELECT DISTINCT name AS target FROM w", countries="SELECT country_code FROM r WHERE ccrank = 1", exact="SELECT name FROM w")))
def resolve_thorough(place, alias, wikipedia):
    """Names and misspelt names; these are looked for in the most frequent country."""
    wanted = asked(place).union(misspelt(place)).distinct()
    return R.resolve(wanted, place, alias, wikipedia, thorough=True).select("place_id", "target", "edit_distance", "ccrank")


@query("x15_geolocate", "documents", "v_text_place", sql=f"""WITH n AS ({NAMES_SQL}), l AS (SELECT doc_id, max(name) AS name, nn FROM (SELECT doc_id, name, {FOLDED} AS nn FROM n) GROUP BY 1, 3), p AS (SELECT id, {FOLDED} AS nn FROM v_text_place)
 SELECT doc_id, CAST(id % 90 AS DOUBLE) AS latitude, CAST(id % 180 AS DOUBLE) AS longitude FROM (SELECT doc_id, min_by(id, (l.name, id)) AS id FROM l JOIN p USING (nn) GROUP BY 1)""")
def geolocate(documents, place):
    spots = place.withColumn("lat", (F.col("id") % 90).cast("double")).withColumn("lon", (F.col("id") % 180).cast("double")).withColumn("name_normalized", T.normalize(F.col("name")))
    return Q.geolocate(documents, "doc_id", spots)


@query("x18_training", "v_place", sql="""WITH p AS (SELECT name AS title, max(id) AS correct, name_normalized FROM v_place GROUP BY 1, 3), t AS (SELECT DISTINCT country_code AS page_id, name AS title FROM v_place)
 SELECT page_id, title, id AS place_id, id = correct AS correct FROM t JOIN p USING (title) JOIN v_place USING (name_normalized)""")
def training(place):
    """X18, SK07, W06, J12: mentions with every place of the same name."""
    mentions = place.select(F.col("country_code").alias("page_id"), F.col("name").alias("title")).distinct()
    titles = mentions.withColumn("position", F.length("title"))
    return export.training(titles, place.withColumn("enwiki_title", F.col("name"))).select("page_id", "title", "place_id", "correct")


@query("a05_corpus_popularity", "v_featureplace", "v_place", sql="""WITH p AS (SELECT name AS title, max(id) AS correct, name_normalized FROM v_place GROUP BY 1, 3), h AS (SELECT q.name AS title, count(*) AS n FROM v_featureplace fp JOIN v_place q ON fp.place_id = q.id GROUP BY 1)
 SELECT id AS place_id, CAST(sum(CASE WHEN id = correct THEN n ELSE -n END) AS BIGINT) AS popularity FROM h JOIN p USING (title) JOIN v_place USING (name_normalized) GROUP BY 1""")
def corpus_popularity(featureplace, place):
    titles = featureplace.join(place.select(F.col("id").alias("place_id"), F.col("name").alias("title")), "place_id")
    return A.corpus_popularity(titles, place.withColumn("enwiki_title", F.col("name")))


@query("sk01_csv", "v_feature", "v_featureplace", "v_place", sql="""WITH c AS (SELECT feature_id, min_by(place_id, id) AS place_id, min_by(confidence, id) AS confidence FROM v_featureplace WHERE correct GROUP BY 1)
 SELECT p.name, confidence, p.lat AS latitude, p.lon AS longitude, p.country_code, p.id AS geonameid, strftime(start_ts, '%y-%m-%d') AS start_time, CAST(NULL AS VARCHAR) AS end_time FROM c JOIN v_feature f ON f.id = c.feature_id JOIN v_place p ON p.id = c.place_id""")
def csv(feature, featureplace, place):
    links = sinks.chosen(feature.withColumnRenamed("start_ts", "start"), featureplace, place)
    return sinks.csv_rows(links)


CHOSEN_SQL = "c AS (SELECT feature_id, min_by(place_id, id) AS place_id, min_by(confidence, id) AS confidence FROM v_featureplace WHERE correct GROUP BY 1)"


@query("sk02_geojson", "v_feature", "v_featureplace", "v_place", sql=f"""WITH {CHOSEN_SQL} SELECT p.admin_level, p.id AS place_id, name, country_code, CAST(confidence AS DOUBLE) AS confidence, round(lon, 6) AS x, round(lat, 6) AS y, strftime(start_ts, '%y-%m-%d') AS start_time, importance,
 'Feature' AS type, 'Point' AS kind, 10 AS properties FROM c JOIN v_feature f ON f.id = c.feature_id JOIN v_place p ON p.id = c.place_id""")
def geojson(feature, featureplace, place):
    """The features, read back from their JSON."""
    out = sinks.geojson_features(sinks.chosen(feature.withColumnRenamed("start_ts", "start"), featureplace, place))
    form = "type string, properties struct<admin_level: int, name: string, country_code: string, confidence: double, start_time: string, importance: double>, geometry struct<geometries: array<struct<coordinates: array<double>, type: string>>>"
    read = out.select("place_id", F.from_json("feature", form).alias("f"), F.size(F.json_object_keys(F.get_json_object("feature", "$.properties"))).alias("properties"))
    first = F.get("f.geometry.geometries", F.lit(0))
    return read.select(
        "f.properties.admin_level", "place_id", "f.properties.name", "f.properties.country_code", "f.properties.confidence",
        F.get(first["coordinates"], F.lit(0)).alias("x"), F.get(first["coordinates"], F.lit(1)).alias("y"), "f.properties.start_time", "f.properties.importance",
        "f.type", first["type"].alias("kind"), "properties",
    )


@query("sk04_xy", "v_feature", "v_featureplace", "v_place", sql="WITH c AS (SELECT feature_id, min_by(place_id, id) AS place_id FROM v_featureplace WHERE correct GROUP BY 1), o AS (SELECT min_by(place_id, feature_id) AS place_id FROM c) SELECT '[' || lon || ',' || lat || ']' AS xy FROM o JOIN v_place p ON p.id = o.place_id")
def xy(feature, featureplace, place):
    return sinks.xy(sinks.chosen(feature, featureplace, place))


@query("sk06_frequency_shapes", "v_feature", "v_featureplace", "v_place", "v_country", sql=f"""WITH {CHOSEN_SQL}, s AS (SELECT admin_level, place_id, CAST(sum(CASE WHEN coalesce(cnt, 0) = 0 THEN 1 ELSE cnt END) AS BIGINT) AS count FROM c JOIN v_feature f ON f.id = c.feature_id JOIN v_place p ON p.id = c.place_id GROUP BY 1, 2),
 t AS (SELECT *, round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY admin_level), 6) AS frequency FROM s) SELECT t.admin_level, count, frequency, name, lon AS x, lat AS y FROM t JOIN v_place p ON p.id = t.place_id WHERE place_id % 2 = 0""")
def frequency_shapes(feature, featureplace, place, country):
    from ..functions import spatial as S

    shaped = place.withColumn("mpoly", F.when(F.col("id") % 2 == 0, S.box_polygon(F.col("lon"), F.col("lon") + 1, F.col("lat"), F.col("lat") + 1)))
    out = sinks.frequency_features(A.frequency(sinks.chosen(feature, featureplace, place).select("place_id", "admin_level", "cnt")), shaped)
    at = lambda path, kind: F.get_json_object("feature", f"$.{path}").cast(kind)
    corner = "mpoly[0][0][0]"
    return out.select("admin_level", at("properties.count", "long").alias("count"), at("properties.frequency", "double").alias("frequency"), at("properties.name", "string").alias("name"), at(f"{corner}.x", "double").alias("x"), at(f"{corner}.y", "double").alias("y"))


@query("x10_topics", "documents")
def topics_of_documents(documents):
    """The topic of each text of a model of all texts."""
    model = topics.build(documents.select("text"))
    return model.topic(documents.select("doc_id", "text")).select("doc_id", "topic_id")


@query("x13_layer", "v_place", sql="""WITH u AS (SELECT count(DISTINCT name || id) / count(*) AS label, count(DISTINCT id) / count(*) AS code, count(*) FILTER (WHERE importance <> 0) / count(*) AS area FROM v_place)
 SELECT 'name' AS key, CASE WHEN label > 0.8 THEN 'label' END AS value FROM u UNION ALL SELECT 'pcode', CASE WHEN code > 0.95 THEN 'id_pcode' END FROM u UNION ALL SELECT 'admin_level', regexp_extract('regions adm2', '[0-9]$') UNION ALL SELECT 'area_sqkm', CASE WHEN area > 0.8 THEN 'area_km2' END FROM u""")
def layer(place):
    """What the columns of a layer mean."""
    df = place.select(F.concat_ws(" ", "name", F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("label"), pcoded().alias("id_pcode"), F.col("importance").alias("area_km2"))
    found = layers.parse_layer(df, "regions adm2")
    return place.sparkSession.createDataFrame([(k, str(v)) for k, v in found.items() if v], "key string, value string")


MIXED_PLACES = "SELECT name FROM v_place UNION SELECT country_code FROM v_country"


@query("x04_mixed_sources", "v_place", "v_country", "nation", "benchmark", sql=f"""WITH known AS ({MIXED_PLACES}),
 t AS (SELECT n_regionkey AS order_id, 0 AS position, n_name AS name, 1 AS count FROM nation UNION ALL SELECT n_regionkey, 1, n_name, 2 FROM nation UNION ALL SELECT n_regionkey, 2, n_name, 1 FROM nation
 UNION ALL SELECT 1000 + item_id, 0, name, 0 FROM (SELECT DISTINCT item_id, CASE WHEN starts_with(n, 'de ') THEN substr(n, 4) ELSE n END AS name FROM (SELECT item_id, unnest(regexp_extract_all(text, '{T.NAME}', 1)) AS n FROM benchmark) WHERE length(n) > 3))
 SELECT order_id, position, name, CASE WHEN position = 0 AND order_id >= 1000 THEN greatest(1, CAST((length(text) - length(replace(text, name, ''))) // length(name) AS INT)) ELSE count END AS count FROM t LEFT JOIN benchmark ON order_id = 1000 + item_id WHERE name <> ''""")
def mixed_sources(place, country, nation, benchmark):
    """X04, SC10-SC14: one request of tables (by header, and by the gazetteer), pages with tables and texts; every source gives its locations."""
    known = place.select("name").union(country.select("country_code")).distinct()
    by = nation.groupBy(F.col("n_regionkey").alias("order_id"))
    csv = by.agg(F.concat(F.lit("id,Country\r\n"), F.array_join(F.collect_list(F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"'))), "\r\n")).alias("data"))
    tsv = by.agg(F.concat(F.lit("what\tno\n"), F.array_join(F.collect_list(F.concat("n_name", F.lit("\tx\n\n"), "n_name", F.lit("\ty"))), "\n")).alias("data"))
    page = by.agg(F.concat(F.lit("<html><table><tr><th>no one</th></tr>"), F.array_join(F.collect_list(F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>7</td></tr>"))), ""), F.lit("</table><p>nothing else</p></html>")).alias("data"))
    text = benchmark.select((F.col("item_id") + 1000).alias("order_id"), F.col("text").alias("data"))
    parts = [df.select(F.col("order_id").cast("long").alias("order_id"), F.lit(no).alias("source_no"), F.lit(kind).alias("source_type"), "data") for df, no, kind in ((csv, 0, "csv"), (tsv, 1, "tsv"), (page, 2, "webpage"), (text, 0, "text"))]
    return Q.locations(Q.cleaned_sources(Q.union_all(*parts)), known).select("order_id", F.col("position").alias("position"), "name", F.col("count").cast("int").alias("count"))

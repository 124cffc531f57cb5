"""Scalars, filters, joins, counts, ranks and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import gazetteer as G
from ..operators import resolve as R
from ..plans import request as Q
from .fixtures import ASKED, MISSPELT, asked, fold_sql, misspelt
from .registry import query

FOLD_SQL, FOLD_NAME = fold_sql("text"), fold_sql("name")


def names(df, *values):
    return df.sparkSession.createDataFrame([(v,) for v in values], "name string")


# --- text -------------------------------------------------------------------------------------------------------------


@query("f02_fold", "documents", sql=f"SELECT doc_id, md5({FOLD_SQL}) AS folded FROM documents")
def fold(documents):
    return documents.select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


@query("f03_normalize", "v_text_place", sql=f"SELECT name, CASE WHEN length({FOLD_NAME}) > 3 THEN {FOLD_NAME} ELSE lower(name) END AS name_normalized FROM v_text_place")
def normalize(place):
    return place.select("name", T.normalize(F.col("name")).alias("name_normalized"))


@query("f10_pattern_names", "documents", sql=f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.NAME}', 1)) AS BIGINT) AS n FROM documents")
def pattern_names(documents):
    return documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(T.NAME), F.lit(1))).cast("long").alias("n"))


@query("f11_abbreviations", "documents", sql="SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z]{2}'))) AS BIGINT) AS n FROM documents")
def abbreviations(documents):
    return documents.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2}"), F.lit(0)))).cast("long").alias("n"))


@query("f12_bare_words", "documents", sql=r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents) WHERE length(trim(trim(trim(w, ','), ';'), '.')) > 3 GROUP BY doc_id")
def bare_words(documents):
    rows = documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.where(F.length(T.bare(F.col("w"))) > 3).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("f13_ngrams", "documents", sql=r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE length(text) < 500), g AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) SELECT doc_id, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM g GROUP BY 1, 2")
def ngrams(documents):
    rows = documents.where(F.length("text") < T.SHORT_TEXT).select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.explode(T.ngrams(F.col("w"))).alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n"))


@query("f14_tokens", "documents", sql=r"SELECT token, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(translate(lower(text), '#_()/:.', '       '), '\s+')) AS token FROM documents) WHERE length(token) > 3 AND length(token) < 15 GROUP BY token HAVING count(*) > 1")
def tokens(documents):
    """Topic tokens (A12: those that occur more than once in all)."""
    return A.repeated_tokens(documents.select(F.explode(T.tokenize(F.col("text"))).alias("token")))


@query("f16_prettify_topic", "documents", sql="""SELECT lang, min('"' || lang || '"') AS shown, min(lang) AS pretty FROM documents GROUP BY lang""")
def prettify(documents):
    return documents.groupBy("lang").agg(F.min(F.concat(F.lit('"'), "lang", F.lit('"'))).alias("shown")).select("lang", "shown", T.prettify_topic(F.col("shown")).alias("pretty"))


@query("f17_short_date", "orders", sql="SELECT o_orderkey AS id, strftime(o_orderdate, '%y-%m-%d') AS day FROM orders")
def short_date(orders):
    return orders.select(F.col("o_orderkey").alias("id"), T.short_date(F.col("o_orderdate")).alias("day"))


@query("f08_url", "pages", sql="SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'http://' || regexp_replace(url, '^https?://', '') END AS fixed FROM pages")
def fixed_url(pages):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"'), "url", F.lit('"'))).otherwise(F.regexp_replace("url", "^https?://", ""))
    return pages.select("page_id", T.fixed_url(raw).alias("fixed"))


@query("f09_extension", "pages", sql=r"SELECT page_id, regexp_extract(url, '[^.]*$') AS extension FROM pages")
def extension(pages):
    return pages.select("page_id", T.extension(F.col("url")).alias("extension"))


@query("f07_file_name", "pages", sql=r"""SELECT page_id, left(replace(replace(regexp_replace(url, '[/\\''".:]', '_', 'g'), '__', '_'), ' ', '_'), 1000) AS file FROM pages""")
def file_name(pages):
    return pages.select("page_id", T.file_name(F.col("url")).alias("file"))


@query("f24_admin_level", "v_place", sql="SELECT id, CASE WHEN name_normalized LIKE '%red%' THEN 1 WHEN name_normalized LIKE '%blue%' THEN 5 END AS level FROM v_place")
def admin_level(place):
    said = F.when(F.contains("name_normalized", F.lit("red")), "x ADM1 y").when(F.contains("name_normalized", F.lit("blue")), "Villages").otherwise("none")
    return place.select("id", T.admin_level(said).cast("int").alias("level"))


@query("f25_json", "events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events")
def json(events):
    parsed = F.from_json("props", "k long")
    return events.select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(parsed["k"].alias("k"))).alias("again"))


@query("p23_value_tests", "v_place", sql=r"SELECT id, regexp_matches(country_code || id, '^[A-Za-z]{2}\d{2,}') AS pcode, regexp_matches(CAST(id AS VARCHAR), '^\d+$') AS digits FROM v_place")
def value_tests(place):
    return place.select("id", T.is_pcode(F.concat("country_code", "id")).alias("pcode"), T.is_digits(F.col("id").cast("string")).alias("digits"))


@query("p11_hygiene", "v_text_place", sql="SELECT id, name FROM v_text_place WHERE NOT contains(name, 'e')")
def hygiene(place):
    raw = F.when(F.contains("name", F.lit("e")), F.concat("name", F.lit(" (x)"))).otherwise(F.concat(F.lit("  "), "name", F.lit(" ")))
    return place.withColumn("name", F.trim(raw)).where(T.hygienic(F.col("name"))).select("id", "name")


@query("p16_all_names", "v_place", sql="SELECT id, len(list_distinct([name, country_code, feature_code])) AS n FROM v_place")
def all_names(place):
    return place.withColumn("other_names", F.concat_ws(",", "name", "country_code")).select("id", F.size(T.all_names("name", "feature_code")).cast("long").alias("n"))


@query("p19_token_length", "documents", sql=r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents) WHERE length(w) > 2 GROUP BY doc_id")
def token_length(documents):
    return documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("w")).where(F.length("w") > 2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("p20_request_cleaning", "events", sql="SELECT event_id, CASE WHEN lower(event_type) IN ('geojson','gif','jpg','png','xy','csv','shp') THEN lower(event_type) ELSE 'all' END AS map_format, event_id % 2 = 1 AS flag FROM events")
def request_cleaning(events):
    return events.select("event_id", Q.map_format(F.col("event_type")).alias("map_format"), Q.flag((F.col("event_id") % 2).cast("string")).alias("flag"))


@query("p21_source_text", "documents", sql="SELECT doc_id, CASE WHEN octet_length(encode(text)) < 2000 THEN text END AS source_text FROM documents")
def source_text(documents):
    rows = documents.select(F.col("doc_id").alias("order_id"), F.lit(0).alias("source_no"), F.lit("text").alias("source_type"), F.col("text").alias("data"))
    return Q.cleaned_sources(rows).select(F.col("order_id").alias("doc_id"), "source_text")


# --- filters and projections -----------------------------------------------------------------------------------------


@query("p01_names_in", "v_place", sql="SELECT id, name FROM v_place WHERE name IN ('red plate', 'hot ring')")
def names_in(place):
    return place.join(F.broadcast(names(place, "red plate", "hot ring")), "name", "left_semi").select("id", "name")


@query("p04_prefix", "v_place", sql="SELECT id, name FROM v_place WHERE starts_with(name, 're')")
def prefix(place):
    return place.where(F.col("name").startswith("re")).select("id", "name")


@query("p07_typed_candidates", "v_place", "v_wikipedia", sql="""SELECT p.id AS place_id, CAST(admin_level AS VARCHAR) AS admin_level, upper(country_code) AS country_code, 999 AS ccrank, name AS target, 0 AS edit_distance,
 coalesce(population, 0) AS population, CAST(coalesce(charcount, 0) AS BIGINT) AS notability, importance > 0.5 AS is_important, upper(feature_code) AS feature_code FROM v_place p LEFT JOIN v_wikipedia w ON p.id = w.place_id WHERE name = 'red plate'""")
def typed_candidates(place, wikipedia):
    found = R.by_name(names(place, "red plate"), place, wikipedia).withColumn("ccrank", F.lit(None).cast("int"))
    return R.typed(found).select("place_id", "admin_level", "country_code", "ccrank", "target", "edit_distance", "population", "notability", "is_important", "feature_code")


@query("p09_null_fill", "v_place", sql="SELECT id, coalesce(population, 7) AS population, coalesce(country_code, 'XX') AS country_code FROM v_place")
def null_fill(place):
    changes = place.where("population IS NULL").select("id", F.lit(7).cast("long").alias("population"))
    return G.update_by_key(place, changes, "id").select("id", "population", "country_code")


@query("p10_population_close", "v_place", sql="""SELECT a.id AS a, b.id AS b, coalesce(a.population IS NOT NULL AND b.population > 0 AND CAST(abs(a.population - b.population) AS DOUBLE) / greatest(a.population, b.population) < 0.05, false) AS close
 FROM v_place a JOIN (SELECT name, min(id) AS id, min_by(coalesce(population, -1), id) AS population FROM v_place GROUP BY name) b ON a.name = b.name""")
def population_close(place):
    """Each place against the first of its name."""
    first = place.groupBy("name").agg(F.min_by(F.struct("id", "population"), "id").alias("f")).select("name", "f.id", "f.population")
    pairs = place.alias("a").join(first.alias("b"), F.col("a.name") == F.col("b.name"))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), G.population_is_close(F.col("a.population"), F.col("b.population")).alias("close"))


@query("p12_list_filter", "v_place", sql="SELECT id, name FROM v_place WHERE country_code = 'Brand#11' ORDER BY id LIMIT 10 OFFSET 5")
def list_filter(place):
    """Exact filters, chosen fields, a page."""
    return Q.listed(place, "places", {"country_code": "Brand#11", "unknown": 1}, "id,name", offset=5)


@query("p12_missing_filter", "v_feature", sql="SELECT id, cnt FROM v_feature WHERE false")
def missing_filter(feature):
    return Q.listed(feature, "features", {}, "id,cnt")


@query("p15_details", "v_feature", "v_featureplace", "v_place", sql="""SELECT feature_id, place_id, '{' || concat_ws(',', '"place_id":' || place_id, '"name":"' || name || '"', '"country_code":"' || country_code || '"', CASE WHEN population <> 0 THEN '"population":' || population END, CASE WHEN admin_level <> 0 THEN '"admin_level":' || admin_level END, CASE WHEN correct IS NOT NULL THEN '"correct":' || CAST(correct AS VARCHAR) END) || '}' AS detail
 FROM v_featureplace fp JOIN v_place p ON fp.place_id = p.id JOIN v_feature f ON f.id = fp.feature_id""")
def details(feature, featureplace, place):
    return Q.feature_details(feature, featureplace, place)


@query("p18_null_exclusion", "v_place", sql="SELECT count(*) AS n FROM v_place WHERE population IS NOT NULL AND name <> ''")
def null_exclusion(place):
    return place.where(F.col("population").isNotNull() & (F.col("name") != "")).agg(F.count(F.lit(1)).alias("n"))


@query("p24_metadata_split", "events", sql="SELECT event_type = 'click' AS is_metadata, count(*) AS n FROM events GROUP BY 1")
def metadata_split(events):
    meta, data = Q.split_metadata(events, F.col("event_type") == "click")
    one = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(flag).alias("is_metadata"), "n")
    return one(meta, True).unionByName(one(data, False))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("j01_name_or_alias", "v_place", "v_alias", "v_wikipedia", sql=f"""WITH wanted AS ({ASKED.replace("name FROM", "name AS n FROM")} UNION SELECT alias FROM v_alias WHERE starts_with(alias, 'PROMO')) SELECT id AS place_id, name AS target, NULL AS alias, charcount AS notability FROM v_place p LEFT JOIN v_wikipedia w ON p.id = w.place_id WHERE name IN (SELECT n FROM wanted)
 UNION ALL SELECT id, a.alias, a.alias, charcount FROM v_place p JOIN v_alias a ON p.id = a.place_id LEFT JOIN v_wikipedia w ON p.id = w.place_id WHERE a.alias IN (SELECT n FROM wanted)""")
def name_or_alias(place, alias, wikipedia):
    """Candidates by name and by alias, without deduplication."""
    wanted = asked(place).union(alias.where(F.col("alias").startswith("PROMO")).select("alias")).distinct()
    out = R.by_name(wanted, place, wikipedia).unionByName(R.by_alias(wanted, place, alias, wikipedia))
    return out.select("place_id", "target", "alias", "notability")


@query("j05_order_rank", "v_place", "v_feature", "v_featureplace", sql="""WITH r AS (SELECT order_id, country_code, dense_rank() OVER (PARTITION BY order_id ORDER BY count(*) DESC) - 1 AS rank FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id JOIN v_place p ON p.id = fp.place_id WHERE correct GROUP BY 1, 2)
 SELECT p.id AS place_id, CAST(r.rank AS INT) AS ccrank FROM v_place p LEFT JOIN r ON r.country_code = p.country_code AND r.order_id = 7 WHERE p.name = 'red plate'""")
def order_rank(place, feature, featureplace):
    """The rank of a candidate's country in an order, joined instead of looked up row by row."""
    linked = featureplace.where("correct").join(feature.select(F.col("id").alias("feature_id"), "order_id"), "feature_id").join(place.select(F.col("id").alias("place_id"), "country_code"), "place_id")
    none = place.sparkSession.createDataFrame([], "alias string, place_id long")
    wiki = place.sparkSession.createDataFrame([], "place_id long, charcount int")
    return R.candidates("red plate", 7, A.country_ranks(linked), place, none, wiki).select("place_id", "ccrank")


@query("j06_fuzzy", "v_place", "v_wikipedia", sql=f"""WITH t AS ({MISSPELT}), n AS (SELECT DISTINCT name FROM v_place WHERE name NOT IN (SELECT target FROM t)),
 d AS (SELECT name, levenshtein(name, target) AS d, target FROM n JOIN t ON left(name, 1) = left(target, 1) WHERE levenshtein(name, target) <= 2),
 b AS (SELECT name, CAST(min(d) AS INT) AS edit_distance, min_by(target, d || target) AS target FROM d GROUP BY 1) SELECT id AS place_id, edit_distance, target FROM v_place JOIN b USING (name)""")
def fuzzy(place, wikipedia):
    """Nearest target within two edits, for a misspelling of every name."""
    return R.by_distance(misspelt(place), place, wikipedia).select("place_id", "edit_distance", "target")


@query("j08_anti", "v_place", "v_wikipedia", sql="SELECT id FROM v_place p WHERE NOT EXISTS (SELECT 1 FROM v_wikipedia w WHERE w.place_id = p.id)")
def anti(place, wikipedia):
    return place.join(wikipedia.select(F.col("place_id").alias("id")), "id", "left_anti").select("id")


@query("j14_decisions", "v_feature", "v_featureplace", "v_place", sql="""SELECT order_id, fp.id AS featureplace_id, place_id, correct, name FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id JOIN v_place p ON p.id = fp.place_id""")
def decisions(feature, featureplace, place):
    from ..plans import export

    orders = feature.select(F.col("order_id").alias("id")).distinct()
    return export.decisions(orders, feature, featureplace, place.select("id", "name")).select("order_id", "featureplace_id", "place_id", "correct", "name")


@query("j13_chosen", "v_feature", "v_featureplace", "v_place", sql="""SELECT feature_id, min_by(place_id, fp.id) AS place_id FROM v_featureplace fp JOIN v_feature f ON f.id = fp.feature_id JOIN v_place p ON p.id = fp.place_id WHERE correct GROUP BY feature_id""")
def chosen(feature, featureplace, place):
    from ..sources import sinks

    return sinks.chosen(feature, featureplace, place).select("feature_id", "place_id")


@query("j16_linked_places", "v_place", "v_featureplace", sql="SELECT id FROM v_place WHERE id IN (SELECT place_id FROM v_featureplace WHERE correct)")
def linked_places(place, featureplace):
    return place.join(featureplace.where("correct").select(F.col("place_id").alias("id")), "id", "left_semi").select("id")


@query("j19_parents", "v_place", sql="SELECT min(a.id) AS parent_id, b.id AS child_id FROM v_place a JOIN v_place b ON a.name || a.country_code = b.name || b.country_code GROUP BY b.id")
def parents(place):
    coded = place.withColumn("pcode", F.concat("name", "country_code")).withColumn("parent_pcode", F.col("pcode"))
    return G.parents(coded)


@query("j23_stop_list", "v_text_place", sql="SELECT id, name FROM v_text_place WHERE name_normalized NOT IN (SELECT name_normalized FROM v_text_place WHERE contains(name, 'an'))")
def stop_list(place):
    stop = place.where(F.contains("name", F.lit("an"))).select("name_normalized")
    return place.join(stop, "name_normalized", "left_anti").select("id", "name")


@query("j24_metadata", "events", sql="SELECT user_id AS metadata_id, count(*) AS n, min(event_type) AS first FROM events GROUP BY user_id")
def metadata(events):
    entries = events.select(F.col("user_id").alias("metadata_id"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"))
    return Q.metadata_lists(entries).select("metadata_id", F.size("entries").cast("long").alias("n"), F.get("entries", F.lit(0))["key"].alias("first"))


@query("j26_update_by_key", "v_place", "v_country", sql="SELECT p.id, CASE WHEN c.id IS NOT NULL THEN 0 ELSE admin_level END AS admin_level, coalesce(c.country_code, name) AS name FROM v_place p LEFT JOIN v_country c ON p.id = c.id")
def update_by_key(place, country):
    changes = country.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("admin_level"), F.col("country_code").alias("name"))
    return G.update_by_key(place, changes, "id").select("id", "admin_level", "name")


# --- counts -----------------------------------------------------------------------------------------------------------


@query("a01_popularity", "v_featureplace", "v_feature", sql="SELECT place_id, CAST(count(*) FILTER (WHERE correct) - count(*) FILTER (WHERE NOT correct) AS BIGINT) AS popularity FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id WHERE verified GROUP BY place_id")
def popularity(featureplace, feature):
    return A.popularity(featureplace, feature)


@query("a02_country_ranking", "v_place", sql=f"SELECT country_code, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, country_code) AS INT) AS ccrank FROM v_place WHERE name IN ({ASKED}) GROUP BY country_code")
def country_ranking(place):
    """A02, W01."""
    return R.country_ranking(asked(place), place)


@query("a03_country_ranks", "v_place", "v_feature", "v_featureplace", sql="""SELECT order_id, country_code, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY order_id ORDER BY count(*) DESC) - 1 AS INT) AS rank FROM v_featureplace fp JOIN v_feature f ON fp.feature_id = f.id JOIN v_place p ON p.id = fp.place_id WHERE correct GROUP BY 1, 2""")
def country_ranks(place, feature, featureplace):
    """A03, W02."""
    linked = featureplace.where("correct").join(feature.select(F.col("id").alias("feature_id"), "order_id"), "feature_id").join(place.select(F.col("id").alias("place_id"), "country_code"), "place_id")
    return A.country_ranks(linked)


@query("a04_ids_by_name", "v_place", sql="SELECT name_normalized, count(*) AS n, min(id) AS first, max(id) AS last FROM v_place GROUP BY 1")
def ids_by_name(place):
    return place.groupBy("name_normalized").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("a06_cooccurrence", "v_featureplace", "v_place", sql="WITH n AS (SELECT DISTINCT feature_id, name FROM v_featureplace fp JOIN v_place p ON p.id = fp.place_id) SELECT a.name AS a, b.name AS b, count(*) AS count FROM n a JOIN n b ON a.feature_id = b.feature_id AND a.name < b.name GROUP BY 1, 2")
def cooccurrence(featureplace, place):
    return A.cooccurrences(featureplace.join(place.select(F.col("id").alias("place_id"), "name"), "place_id"), "feature_id", "name")


@query("a07_top_cooccurrence", "v_featureplace", "v_place", sql="WITH n AS (SELECT DISTINCT feature_id, name FROM v_featureplace fp JOIN v_place p ON p.id = fp.place_id) SELECT a.name AS a, b.name AS b, count(*) AS count FROM n a JOIN n b ON a.feature_id = b.feature_id AND a.name < b.name GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def top_cooccurrence(featureplace, place):
    return A.cooccurrences(featureplace.join(place.select(F.col("id").alias("place_id"), "name"), "place_id"), "feature_id", "name", top=100)


@query("a08_frequency", "v_feature", "v_featureplace", "v_place", sql="""WITH c AS (SELECT feature_id, min_by(place_id, id) AS place_id FROM v_featureplace WHERE correct GROUP BY 1), s AS (SELECT admin_level, place_id, CAST(sum(CASE WHEN coalesce(cnt, 0) = 0 THEN 1 ELSE cnt END) AS BIGINT) AS count FROM c JOIN v_feature f ON f.id = c.feature_id JOIN v_place p ON p.id = c.place_id GROUP BY 1, 2)
 SELECT *, round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY admin_level), 6) AS frequency FROM s""")
def frequency(feature, featureplace, place):
    """A08, W08."""
    from ..sources import sinks

    return A.frequency(sinks.chosen(feature, featureplace, place).select("place_id", "admin_level", "cnt"))


@query("a09_values_per_column", "part", "v_place", sql="SELECT 0 AS column, count(*) AS n FROM part WHERE p_name IN (SELECT name FROM v_place)")
def values_per_column(part, place):
    cells = part.select(F.posexplode(F.array("p_name", "p_brand")).alias("column", "name"))
    return cells.join(place.select("name").distinct(), "name", "left_semi").groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("a10_per_day", "v_feature", sql="SELECT date_trunc('day', start_ts) AS day, count(*) AS n FROM v_feature GROUP BY 1")
def per_day(feature):
    return A.per_day(feature, "start_ts").select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("a13_majority", "v_featureplace", "v_feature", sql="WITH c AS (SELECT place_id, cnt, count(*) AS n FROM v_featureplace fp JOIN v_feature f ON f.id = fp.feature_id WHERE correct GROUP BY 1, 2) SELECT place_id, CAST(min(cnt) AS INT) AS cnt FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.place_id = c.place_id) GROUP BY 1")
def majority(featureplace, feature):
    linked = featureplace.where("correct").join(feature.select(F.col("id").alias("feature_id"), "cnt"), "feature_id")
    return A.majority(linked, "place_id", "cnt")


@query("a14_profile", "v_place", sql="""SELECT 'population' AS field, round(CAST(count(*) FILTER (WHERE population <> 0) AS DOUBLE) / count(*), 6) AS completeness, round(CAST(count(DISTINCT population) + 1 AS DOUBLE) / count(*), 6) AS uniqueness, CAST(median(population) AS DOUBLE) AS median FROM v_place
 UNION ALL SELECT 'name', round(CAST(count(*) FILTER (WHERE name <> '') AS DOUBLE) / count(*), 6), round(CAST(count(DISTINCT name) AS DOUBLE) / count(*), 6), NULL FROM v_place""")
def profile(place):
    return A.profile(place.select("population", "name"))


@query("a15_best_score", "v_featureplace", sql="SELECT id, feature_id, confidence, confidence = max(confidence) OVER (PARTITION BY feature_id) AS correct FROM v_featureplace")
def best_score(featureplace):
    """Equal best ones are all correct."""
    return R.mark_correct(featureplace.select("id", "feature_id", "confidence"), "feature_id", score="confidence")


@query("a16_accuracy", "v_place", sql="SELECT count(*) AS n, round(avg(CASE WHEN a.lon = b.lon AND a.lat = b.lat THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_place a JOIN (SELECT name, min_by(lon, id) AS lon, min_by(lat, id) AS lat FROM v_place GROUP BY name) b USING (name)")
def accuracy(place):
    """A16, J20."""
    expected = place.groupBy("name").agg(F.min_by("lon", "id").alias("x"), F.min_by("lat", "id").alias("y"))
    return A.accuracy(place.select("name", F.col("lon").alias("x"), F.col("lat").alias("y")), expected)


@query("a17_any_time", "v_feature", sql="SELECT order_id, bool_or(start_ts IS NOT NULL) AS has_times FROM v_feature GROUP BY 1")
def any_time(feature):
    return feature.groupBy("order_id").agg(F.bool_or(F.col("start_ts").isNotNull()).alias("has_times"))


@query("a18_one_country", "v_place", sql="SELECT country_code FROM v_place GROUP BY 1 HAVING min(admin_level) = 0 UNION ALL SELECT min(country_code) FROM v_place HAVING count(DISTINCT country_code) = 1")
def one_country(place):
    """Countries with a place of level 0, each told from a sample of its own places; a sample of all places tells none."""
    codes = place.where("admin_level = 0").select("country_code").distinct()
    each = place.withColumn("dataset", F.col("country_code")).join(codes, "country_code", "left_semi")
    return A.one_country(place).unionByName(A.country_of_each(each, "dataset").select("country_code"))


@query("a21_durations", "v_feature", sql="SELECT order_id AS id, true AS complete, CAST(epoch(max(start_ts)) - epoch(min(start_ts)) AS BIGINT) AS duration FROM v_feature GROUP BY 1")
def durations(feature):
    """A21, D16."""
    by = feature.groupBy("order_id").agg(F.min("start_ts").cast("timestamp").alias("start"), F.max("start_ts").cast("timestamp").alias("end"))
    return Q.finish(by.select(F.col("order_id").alias("id"), "start"), by).select("id", "complete", "duration")


# --- ranks, sorts, sets ------------------------------------------------------------------------------------------------


@query("w04_labels", "v_feature", sql="SELECT id AS feature_id, order_id AS mapstyle_id, row_number() OVER (PARTITION BY order_id ORDER BY id) <= 10 AS label FROM v_feature")
def labels(feature):
    """W04, X16."""
    return Q.style(feature)


@query("t01_top_population", "v_place", sql="SELECT id, population FROM v_place WHERE population IS NOT NULL ORDER BY population DESC, id LIMIT 10")
def top_population(place):
    return A.top(place, "population").select("id", "population")


@query("t01_bottom_population", "v_place", sql="SELECT id, population FROM v_place WHERE population IS NOT NULL ORDER BY population, id LIMIT 10")
def bottom_population(place):
    return A.top(place, "population", falling=False).select("id", "population")


@query("t02_top_notable", "v_place", "v_wikipedia", sql="SELECT id, charcount FROM v_place JOIN v_wikipedia ON id = place_id ORDER BY charcount DESC, id LIMIT 10")
def top_notable(place, wikipedia):
    return A.top(place.join(wikipedia, F.col("id") == F.col("place_id")), "charcount").select("id", "charcount")


@query("t03_latest_days", "v_feature", sql="SELECT date_trunc('day', start_ts) AS day, count(*) AS n FROM v_feature GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def latest_days(feature):
    return A.latest_days(feature, "start_ts", 7).select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("t04_typeahead", "v_place", sql="SELECT DISTINCT name FROM v_place WHERE starts_with(name, 'r') ORDER BY name LIMIT 5")
def typeahead(place):
    return A.typeahead(place, "r")


@query("t06_page", "v_place", sql="SELECT id, name FROM v_place ORDER BY id LIMIT 10 OFFSET 20")
def page(place):
    return A.page(place, offset=20).select("id", "name")


@query("u03_distinct_union", "v_place", "v_alias", sql="SELECT id AS place_id, name FROM v_place UNION SELECT place_id, alias FROM v_alias")
def distinct_union(place, alias):
    return place.select(F.col("id").alias("place_id"), "name").unionByName(alias.select("place_id", F.col("alias").alias("name"))).distinct()


@query("u05_both_values", "v_place", sql="SELECT country_code, list_contains(list(DISTINCT name), 'red plate') AND list_contains(list(DISTINCT name), 'hot ring') AS both_there FROM v_place GROUP BY 1")
def both_values(place):
    seen = place.groupBy("country_code").agg(F.bool_or(F.col("name") == "red plate").alias("a"), F.bool_or(F.col("name") == "hot ring").alias("b"))
    return seen.select("country_code", (F.col("a") & F.col("b")).alias("both_there"))

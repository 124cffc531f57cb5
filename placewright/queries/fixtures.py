"""The engine's tables as views of the driver's: the same SQL for Spark and DuckDB but for unnesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LETTERS, NAME

VIEWS = {
    "v_place": """SELECT p_partkey AS id, p_name AS name, lower(p_name) AS name_normalized, p_brand AS country_code, p_type AS feature_code,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END AS population,
        CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE CAST(p_partkey % 6 AS INT) END AS admin_level,
        p_retailprice AS importance,
        CAST((p_partkey * 37) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - 180 AS lon,
        CAST((p_partkey * 53) % 1700 AS DOUBLE) / CAST(10 AS DOUBLE) - 85 AS lat FROM part""",
    "v_wikipedia": "SELECT p_partkey AS place_id, CAST(p_size AS INT) * 100 AS charcount FROM part WHERE p_partkey % 3 = 0",
    "v_alias": "SELECT p_type AS alias, p_partkey AS place_id FROM part",
    "v_feature": """SELECT o_orderkey AS id, o_custkey AS order_id, CAST(o_orderkey % 4 AS INT) AS cnt,
        o_orderdate AS start_ts, o_orderstatus = 'F' AS verified FROM orders""",
    "v_featureplace": """SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS id,
        l_orderkey AS feature_id, l_partkey AS place_id, l_discount AS confidence,
        CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false ELSE NULL END AS correct FROM lineitem""",
    "v_country": """SELECT n_nationkey AS id, n_name AS country_code,
        CAST((n_nationkey % 5) * 72 - 180 AS DOUBLE) AS west, CAST((n_nationkey % 5) * 72 - 108 AS DOUBLE) AS east,
        CAST(CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) AS INT) * 34 - 85 AS DOUBLE) AS south,
        CAST(CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) AS INT) * 34 - 51 AS DOUBLE) AS north FROM nation""",
}
_TEXT = "SELECT row_number() OVER (ORDER BY name) AS id, name, lower(name) AS name_normalized FROM (SELECT DISTINCT name FROM (SELECT {unnest}(regexp_extract_all(text, {rx}, 1)) AS name FROM benchmark) m WHERE length(name) > 3) d"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Names that are asked for: of all places of level 0; and with a letter missing, of all places.
ASKED = "SELECT name FROM v_place WHERE admin_level = 0"
MISSPELT = "SELECT DISTINCT substr(name, 1, 2) || substr(name, 4) AS target FROM v_place"


def asked(place: DataFrame) -> DataFrame:
    return place.where("admin_level = 0").select("name").distinct()


def misspelt(place: DataFrame) -> DataFrame:
    return place.select(F.expr("substr(name, 1, 2) || substr(name, 4)").alias("name")).distinct()


def pcoded() -> Column:
    """A code of each place: six digits or, of larger ids, all; cut to six they'd be no codes, as many places would share one."""
    digits = F.col("id").cast("string")
    return F.concat(F.lit("xy"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def fold_sql(column: str) -> str:
    """Folding in DuckDB: its own removal of accents, then the letters that have no base letter."""
    out = f"strip_accents(lower({column}))"
    for letter, latin in LETTERS.items():
        out = f"replace({out}, '{letter}', '{latin.replace(chr(39), chr(39) * 2)}')"
    return out


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views or tables."""
    out = []
    for name in names:
        if name in TABLES:
            out.append(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            continue
        if name == "v_text_place":
            found = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("name")).where(F.length("name") > 3).distinct()
            out.append(found.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.lower("name").alias("name_normalized")))
            continue
        base = VIEWS[name].rsplit("FROM ", 1)[1].split()[0]
        out.append(spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")}))
    return out


def with_views(select: str) -> str:
    """DuckDB SQL of a select, with the views it names before it."""
    known = VIEWS | {"v_text_place": _TEXT.format(unnest="unnest", rx=f"'{NAME}'")}
    used = [n for n in known if n in select]
    ctes = ", ".join(f"{n} AS ({known[n]})" for n in used)
    select = select.strip()
    if not ctes:
        return select
    if select[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {select[15:]}"
    return f"WITH {ctes}, {select[5:]}" if select[:5].upper() == "WITH " else f"WITH {ctes} {select}"

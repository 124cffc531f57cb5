"""Counts, shares, ranks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def popularity(featureplace: DataFrame, feature: DataFrame) -> DataFrame:
    """(place_id, popularity): correct minus incorrect links, over verified features; unknown flags count 0."""
    linked = featureplace.join(feature.where("verified").select(F.col("id").alias("_f")), F.col("feature_id") == F.col("_f"))
    return linked.groupBy("place_id").agg(F.sum(F.when(F.col("correct"), 1).when(~F.col("correct"), -1).otherwise(0)).alias("popularity"))


def update_popularity(places: DataFrame, featureplace: DataFrame, feature: DataFrame, order_id: int | None = None) -> DataFrame:
    """places with new popularity where a verified feature links them; order_id: only places linked in that order."""
    new = popularity(featureplace, feature)
    if order_id is not None:
        mine = featureplace.join(feature.where((F.col("order_id") == order_id) & F.col("verified")).select(F.col("id").alias("_f")), F.col("feature_id") == F.col("_f"), "left_semi")
        new = new.join(mine.select("place_id").distinct(), "place_id", "left_semi")
    old = F.col("_old") if "popularity" in places.columns else F.lit(None).cast("long")
    base = places.withColumnRenamed("popularity", "_old") if "popularity" in places.columns else places
    return base.join(new, F.col("id") == F.col("place_id"), "left").withColumn("popularity", F.coalesce("popularity", old)).drop("place_id", "_old")


def country_ranks(linked: DataFrame) -> DataFrame:
    """(order_id, country_code, n, rank): countries of an order by falling count, dense ranks from 0; null is a country too."""
    counts = linked.groupBy("order_id", "country_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.dense_rank().over(Window.partitionBy("order_id").orderBy(F.desc("n"))) - 1)


def corpus_popularity(titles: DataFrame, places: DataFrame, as_written: bool = False) -> DataFrame:
    """(place_id, popularity): each mention (title) gives its place 1 and takes 1 from others of the same name; as_written takes it from the place itself.

    What a place loses is the total of its name less its own mentions, so no pairs of places are made.
    """
    p = places.groupBy("enwiki_title").agg(F.max_by(F.struct("id", "name_normalized"), F.struct("name", "id")).alias("_p"))
    hits = titles.join(p, F.col("title") == F.col("enwiki_title")).groupBy("_p").agg(F.count(F.lit(1)).alias("n")).select("_p.id", "_p.name_normalized", "n")
    same = places.select(F.col("id").alias("place_id"), F.col("name_normalized").alias("_nn"))
    if as_written:
        others = hits.join(same.groupBy("_nn").agg((F.count(F.lit(1)) - 1).alias("_k")), F.col("name_normalized") == F.col("_nn"))
        return others.groupBy(F.col("id").alias("place_id")).agg(F.sum(F.col("n") - F.col("n") * F.col("_k")).alias("popularity"))
    totals = hits.groupBy("name_normalized").agg(F.sum("n").alias("_all"))
    own = hits.select(F.col("id").alias("_id"), F.col("n").alias("_own"))
    named = same.join(totals, F.col("_nn") == F.col("name_normalized")).join(own, F.col("place_id") == F.col("_id"), "left")
    return named.select("place_id", (2 * F.coalesce("_own", F.lit(0)) - F.col("_all")).alias("popularity"))


def cooccurrences(mentions: DataFrame, group: str, name: str, top: int | None = None) -> DataFrame:
    """(a, b, count) of pairs of a group's distinct names, a before b; top: only the most frequent.

    Pairs are made within a row, from the group's sorted names, and counted before the shuffle.
    """
    lists = mentions.groupBy(group).agg(F.array_sort(F.collect_set(name)).alias("_n"))
    firsts = lists.select(F.posexplode("_n").alias("_i", "a"), "_n")
    pairs = firsts.select("a", F.explode(F.slice("_n", F.col("_i") + 2, F.size("_n"))).alias("b"))
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    return out if top is None else out.orderBy(F.desc("count"), "a", "b").limit(top)


def frequency(links: DataFrame, level: str = "admin_level") -> DataFrame:
    """(level, place_id, count, frequency): counts of links (place_id, cnt), at least 1 each, and their share of the level."""
    out = links.groupBy(level, "place_id").agg(F.sum(F.when(F.coalesce("cnt", F.lit(0)) == 0, 1).otherwise(F.col("cnt"))).alias("count"))
    return share(out, "count", level, "frequency").withColumn("frequency", F.round("frequency", 6))


def share(df: DataFrame, value: str, by: str, column: str) -> DataFrame:
    """df with a column of value's share of its sum over the rows of a group. Sums are an aggregate, so a few large groups don't meet in a few tasks."""
    sums = df.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias("_sum"))
    return df.join(sums, F.col(by).eqNullSafe(F.col("_by"))).withColumn(column, F.col(value) / F.col("_sum")).drop("_by", "_sum")


def per_day(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.date_trunc("day", time).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def latest_days(df: DataFrame, time: str, days: int) -> DataFrame:
    return per_day(df, time).orderBy(F.desc("day")).limit(days)


def top(df: DataFrame, by: str, n: int = 10, falling: bool = True, tie: str = "id") -> DataFrame:
    """The first or last rows by a column that isn't null; a top-k, not a sort of all."""
    return df.where(F.col(by).isNotNull()).orderBy(F.desc(by) if falling else F.asc(by), tie).limit(n)


def typeahead(places: DataFrame, start: str, n: int = 5) -> DataFrame:
    return places.where(F.col("name").startswith(start)).select("name").distinct().orderBy("name").limit(n)


def page(df: DataFrame, order: str = "id", offset: int = 0, limit: int = 10) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def repeated_tokens(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, count) of those that occur more than once in all."""
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def majority(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equal ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(value))


def accuracy(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the share of predicted (name, x, y) whose coordinates equal the expected ones of that name. Empty input is an error at run time."""
    joined = predicted.join(expected.select("name", F.col("x").alias("_x"), F.col("y").alias("_y")), "name")
    hits = F.avg(F.when((F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), 1.0).otherwise(0.0))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.round(hits, 6).alias("accuracy")).withColumn("accuracy", F.when(F.col("n") == 0, F.raise_error(F.lit("no features to test"))).otherwise(F.col("accuracy")))


def labels(features: DataFrame, n: int = 10) -> DataFrame:
    """features with label: the first n of each order."""
    return features.withColumn("label", F.row_number().over(Window.partitionBy("order_id").orderBy("id")) <= n)


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, median): the exact medians of numeric columns.

    A sketch names a range of about two hundredths of the rows that holds the middle; those below are counted, and only values
    within are put in order.
    """
    value = lambda c: F.col(f"`{c}`").cast("double")
    if not columns:
        return df.sparkSession.createDataFrame([], "field string, median double")
    near = df.agg(*[F.percentile_approx(value(c), [0.49, 0.51], 10_000).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    known = [(c, near[i]) for i, c in enumerate(columns) if near[i]]
    if not known:
        return df.sparkSession.createDataFrame([], "field string, median double")
    sums = df.agg(*[F.count_if(value(c) < r[0]).alias(f"b{i}") for i, (c, r) in enumerate(known)], *[F.count(value(c)).alias(f"n{i}") for i, (c, _) in enumerate(known)]).first()
    cells = F.array(*[F.when(value(c).between(r[0], r[1]), F.struct(F.lit(c).alias("field"), value(c).alias("value"), F.lit(sums[f"b{i}"]).cast("long").alias("below"), F.lit(sums[f"n{i}"]).cast("long").alias("n"))) for i, (c, r) in enumerate(known)])
    inside = df.select(F.inline(F.array_compact(cells))).groupBy("field", "below", "n", "value").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.col("below") + F.sum("_k").over(Window.partitionBy("field").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = lambda at: F.min(F.when(F.col("_upto") > at, F.col("value")))
    found = inside.withColumn("_upto", upto).groupBy("field", "n").agg(middle(F.floor((F.col("n") - 1) / 2)).alias("_a"), middle(F.floor(F.col("n") / 2)).alias("_b"))
    return found.select("field", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def profile(df: DataFrame) -> DataFrame:
    """(field, completeness, uniqueness, median): of each column the shares of true and of distinct values, and the exact median of numbers."""
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        truthy = col.isNotNull() & ((col != 0) if c in numeric else (col.cast("string") != ""))
        aggs += [F.count_if(truthy).alias(f"c{i}"), (F.count_distinct(col) + F.max(col.isNull().cast("int"))).alias(f"u{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.round(F.col(f"c{i}") / F.col("_n"), 6).alias("completeness"), F.round(F.col(f"u{i}") / F.col("_n"), 6).alias("uniqueness")) for i, c in enumerate(df.columns)])
    #: A row a column.
    return one.where("_n > 0").select(F.inline(rows)).join(F.broadcast(medians(df, numeric)), "field", "left")


def one_country(features: DataFrame, seed: int = 0, n: int = 20) -> DataFrame:
    """The country of a sample of n features, if there is exactly one."""
    sample = features.orderBy(F.rand(seed)).limit(n)
    return sample.agg(F.collect_set("country_code").alias("_c")).where(F.size("_c") == 1).select(F.get("_c", F.lit(0)).alias("country_code"))


def country_of_each(features: DataFrame, by: str, seed: int = 0, n: int = 20) -> DataFrame:
    """(by, country_code): the same for each dataset of a table, in one plan. Spark keeps n rows a task and dataset before it shuffles."""
    drawn = features.select(by, "country_code").withColumn("_draw", F.rand(seed))
    sample = drawn.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy("_draw"))).where(F.col("_nth") <= n)
    return sample.groupBy(by).agg(F.collect_set("country_code").alias("_c")).where(F.size("_c") == 1).select(by, F.get("_c", F.lit(0)).alias("country_code"))
"""Locations in texts, tables and web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T

#: Fixed: headers that name a column of locations.
HEADERS = ["city", "community", "country", "neighborhood", "loc", "location", "locations", "place", "province"]


def names_of(text: Column, case_insensitive: bool = False) -> Column:
    """Distinct names of a text: by pattern, its words (texts under 100,000 letters) and word pairs (under 500), longer than 3."""
    words = T.words(text)
    none = F.array().cast("array<string>")
    single = F.when(F.length(text) < T.LONG_TEXT, F.transform(words, lambda w: T.bare(F.trim(w)))).otherwise(none)
    pairs = F.when(F.length(text) < T.SHORT_TEXT, F.transform(T.ngrams(words), lambda w: T.bare(F.trim(w)))).otherwise(none)
    return F.array_distinct(F.filter(F.concat(T.pattern_names(text, case_insensitive), single, pairs), lambda n: F.length(n) > 3))


def names_in_text(docs: DataFrame, key: str, stop: DataFrame | None = None, case_insensitive: bool = False, pattern_only: bool = False) -> DataFrame:
    """(key, name): distinct names of each text without the stop list."""
    names = F.array_distinct(T.pattern_names(F.col("text"), case_insensitive)) if pattern_only else names_of(F.col("text"), case_insensitive)
    return _without(docs.where(F.col("text").isNotNull()).select(F.col(key), F.explode(names).alias("name")), stop)


def _without(each: DataFrame, stop: DataFrame | None) -> DataFrame:
    if stop is None:
        return each
    columns = each.columns
    return each.join(stop.select(F.lower("name").alias("_stop")).distinct(), F.lower("name") == F.col("_stop"), "left_anti").select(*columns)


#: Names that are longer are looked for one by one, and as many names with blanks in them as FEW.
LONG_NAME, FEW = 64, 500
#: Texts whose names leave Python in one batch.
TEXTS = 64
_SENTENCE, _BLANK = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n"), re.compile(r"[ \t\n\x0b\f\r]")


def _held(names: set[str], parts: dict[str, tuple[int, int]], found: dict[str, list[int]]) -> None:
    """Adds to found (name: count, first sentence) what the parts (part: times, first sentence) hold of the names, without overlaps.

    Windows as long as some name are looked up, so the cost is that of the parts by the lengths of names, however many there are.
    """
    sizes = sorted({len(n) for n in names})
    for part, (times, sentence) in parts.items():
        for size in sizes:
            if size > len(part):
                break
            ends: dict[str, int] = {}
            for at in range(len(part) - size + 1):
                name = part[at : at + size]
                if name in names and at >= ends.get(name, 0):
                    ends[name] = at + size
                    found.setdefault(name, [0, sentence])[0] += times


def counted_names(text: str, names: list[str]) -> list[tuple[int, str | None]]:
    """How often each name stands in a text (without overlaps, 1 at least), and the first sentence with it.

    A name without blanks lies within a word, so it is looked for in the text's different words.
    """
    sentences = _SENTENCE.split(text)
    words: dict[str, tuple[int, int]] = {}
    for i, sentence in enumerate(sentences):
        for word in _BLANK.split(sentence):
            times, first = words.get(word, (0, i))
            words[word] = times + 1, first
    spaced = {n for n in names if len(n) <= LONG_NAME and _BLANK.search(n)}
    found: dict[str, list[int]] = {}
    _held({n for n in names if len(n) <= LONG_NAME and n not in spaced}, words, found)
    if len(spaced) > FEW:
        #: Only short texts have pairs of words, which may lie astride sentences; other names with blanks don't.
        parts: dict[str, tuple[int, int]] = {}
        for i, sentence in enumerate(sentences):
            times, first = parts.get(sentence, (0, i))
            parts[sentence] = times + 1, first
        _held(spaced, parts, found)
    out = []
    for name in names:
        if name in found:
            out.append((found[name][0], sentences[found[name][1]]))
        else:
            out.append((max(1, text.count(name)), next((s for s in sentences if name in s), None)))
    return out


def locations_in_text(docs: DataFrame, key: str, stop: DataFrame | None = None, case_insensitive: bool = False, pattern_only: bool = False, context: bool = True) -> DataFrame:
    """(key, name, count, and, unless it isn't wanted, context): names of each text without the stop list; count is how often the name stands there, context the first sentence with it."""
    names = F.array_distinct(T.pattern_names(F.col("text"), case_insensitive)) if pattern_only else names_of(F.col("text"), case_insensitive)
    rows = docs.where(F.col("text").isNotNull()).select(F.col(key), "text", names.alias("_names"))
    more = [types.StructField("context", types.StringType())] if context else []
    form = types.StructType([rows.schema[key], types.StructField("name", types.StringType()), types.StructField("count", types.IntegerType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                lists = batch.column(2).to_pylist()
                found = [f for text, listed in zip(batch.column(1).to_pylist(), lists, strict=True) for f in counted_names(text, listed)]
                rows_of = pa.array([i for i, listed in enumerate(lists) for _ in listed], pa.int64())
                columns = [batch.column(0).take(rows_of), pa.array([n for listed in lists for n in listed], pa.string()), pa.array([f[0] for f in found], pa.int32())]
                columns += [pa.array([f[1] for f in found], pa.string())] if context else []
                yield pa.RecordBatch.from_arrays(columns, names=form.names)

    return _without(rows.mapInArrow(run, form), stop)


def header_column(headers: list[str]) -> int | None:
    """The last column whose header names locations; the first column counts too."""
    found = [i for i, h in enumerate(headers) if (h or "").strip().lower() in HEADERS]
    return found[-1] if found else None


def gazetteer_column(rows: DataFrame, width: int, places: DataFrame) -> int | None:
    """The column (of `cells`) with the most values that are place names; the last of equal ones."""
    cells = rows.select(F.posexplode("cells").alias("column", "value")).where(F.length(F.trim("value")) > 2).select("column", F.trim("value").alias("name"))
    hits = cells.join(places.select("name").distinct(), "name", "left_semi").groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    top = hits.orderBy(F.desc("n"), F.desc("column")).first()
    return None if top is None or top["column"] >= width else top["column"]


def locations_in_table(rows: DataFrame, headers: list[str], places: DataFrame) -> DataFrame:
    """(name, fields): a row for each row of a table (cells: array) with a location; fields maps headers to values. The header row isn't one."""
    at = header_column(headers)
    if at is None:
        at = gazetteer_column(rows, len(headers), places)
    if at is None:
        return rows.sparkSession.createDataFrame([], "name string, fields map<string,string>")
    named = F.map_from_arrays(F.array(*[F.lit(h) for h in headers]), F.transform(F.sequence(F.lit(0), F.lit(len(headers) - 1)), lambda i: F.get("cells", i)))
    found = rows.select(F.trim(F.get("cells", F.lit(at))).alias("name"), named.alias("fields"))
    return found.where((F.col("name") != "") & (F.lower("name") != (headers[at] or "").lower()))


def table_cells(text: Column, separator: str) -> Column:
    """The lines of a text that aren't empty as arrays of cells; cells in quotes may hold separators, line ends and doubled quotes."""
    lines = F.regexp_extract_all(text, F.lit(r'((?:"(?:[^"]|"")*+"|[^\r\n])++)'), F.lit(1))

    def cells(line: Column) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f'{separator}("(?:[^"]|"")*+"|[^{separator}]*+)'), F.lit(1))
        return F.transform(found, lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))

    return F.transform(F.filter(lines, lambda line: F.trim(line) != ""), cells)


def locations_in_tables(rows: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(key, name, count) of tables (key, row from 0, cells), each with its own header in row 0.

    A table's locations stand in the last column whose header says so, else in the one with the most place names (the last of equal ones).
    """
    headed = rows.where("row = 0").select(key, F.posexplode("cells").alias("at", "header")).where(F.lower(F.trim("header")).isin(HEADERS)).groupBy(key).agg(F.max("at").alias("at"))
    cells = rows.join(headed.select(key), key, "left_anti").select(key, F.posexplode("cells").alias("at", "value"))
    cells = cells.select(key, "at", F.trim("value").alias("name")).where(F.length("name") > 2)
    hits = cells.join(places.select("name").distinct(), "name", "left_semi").groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    guessed = hits.groupBy(key).agg(F.max(F.struct("n", "at")).alias("_m")).select(key, F.col("_m.at").alias("at"))
    at = headed.unionByName(guessed)
    header = rows.where("row = 0").select(key, F.col("cells").alias("_header"))
    found = rows.where("row > 0").join(at, key).join(header, key).select(key, F.trim(F.get("cells", F.col("at"))).alias("name"), F.get("_header", F.col("at")).alias("_title"))
    found = found.where((F.col("name") != "") & (F.lower("name") != F.lower(F.coalesce("_title", F.lit("")))))
    return found.groupBy(key, "name").agg(F.count(F.lit(1)).cast("int").alias("count"))


def page_text(html: Column) -> Column:
    """The text of a page: its article if that is longer than 500, else all of the body, without tags."""

    def clean(h: Column) -> Column:
        h = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
        h = F.regexp_replace(h, r"<[^>]*>", " ")
        for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            h = F.replace(h, F.lit(name), F.lit(mark))
        return F.trim(F.regexp_replace(h, r"\s+", " "))

    article = clean(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1))
    return F.when(F.length(article) > 500, article).otherwise(clean(html))


def page_tables(pages: DataFrame, key: str) -> DataFrame:
    """(key, table, row, cells) of the tables in pages."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table", "_t"))
    rows = tables.select(key, "table", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return rows.select(key, "table", "row", cells.alias("cells"))


def locations_in_pages(pages: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(key, name, origin): values of table cells that are place names first, then names of the text that weren't in tables."""
    cells = page_tables(pages, key).select(key, F.explode("cells").alias("name")).where(F.length("name") > 2).distinct()
    tabled = cells.join(places.select("name").distinct(), "name", "left_semi").select(key, "name", F.lit("table").alias("origin"))
    texts = pages.select(key, page_text(F.col("html")).alias("text"))
    said = names_in_text(texts, key, pattern_only=True).join(tabled.select(key, "name"), [key, "name"], "left_anti")
    return tabled.unionByName(said.withColumn("origin", F.lit("text")))


def zip_links(pages: DataFrame) -> DataFrame:
    """(page, link): links to zip files, relative ones made absolute."""
    found = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a[^>]*href="([^"]*\.zip)"'), F.lit(1))).alias("href"))
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace("url", r"[^/]*$", "")
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    return found.select("page_id", link.alias("link"))

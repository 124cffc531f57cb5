"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are found by pattern and validated. They are the seeds, and with them keys: tokens of 32
or more hexadecimal digits or of a service's known format. Every seed, and every other token that could be an identifier, stands between words; each
neighbourhood is a lexical pattern: the two words before, one before and one after, or one before with a mark such as `=`.
Patterns and instances form a graph, which is scored until nothing changes: a pattern's confidence is the score of its
distinct identifiers (seeds, and instances with ENOUGH score) over the number of its instances, of which those that aren't known
to be identifiers count UNKNOWN; an instance's score is that of at least one of its confident patterns being right, for those
without a digit times the share of their patterns that are confident, as common words stand in many patterns. Scores only rise,
so this ends. Seeds and other tokens with ENOUGH score become spans of kind `id`.

Tokens that could be identifiers have three digits and SHORTEST characters, or stand after a mark or with an `@` before
them and have four. Neighbouring words are whole, however long; they may lie in the matches beside.

Places come from the texts between the matches, whose lengths are summed up by document after the match itself: only matches
and their neighbouring words are shuffled, never texts.

Defined results: null text is empty; base spans of each kind are leftmost, don't overlap, and failing ones are dropped without
a retry; added spans never overlap base ones; rows are told apart by doc_id and text, repeated rows get the same result each; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fence, settled, table

KINDS = ("email", "ip", "card", "phone", "id")
#: Matching is possessive and begins at the edge of a run (or where the last match ended), which gives the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?:(?<![^\x20\x09-\x0D=:])[^\x20\x09-\x0D=:0-9]*+[0-9]|(?<![^\x20\x09-\x0D])@|(?<=[=:]\x20)[^\x20\x09-\x0D])[^\x20\x09-\x0D]*+",
}
#: Keys, which are seeds too: hexadecimal ones, and formats that services are known for.
KEY = r"^(?:(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})$"
#: Characters that an unknown token needs at least, away from marks and beside them.
SHORTEST, SHORT = 6, 4
#: A pattern is confident from SUPPORT known instances and a confidence of TRUST on; SMOOTH counts against it, and so does a part of each unknown instance. ENOUGH makes an identifier.
UNKNOWN, SMOOTH, SUPPORT, TRUST, ENOUGH = 0.25, 1.0, 3.0, 0.6, 0.8
#: Scores and confident patterns of a round up to so many rows are broadcast, about 200 bytes each; more are joined by shuffle.
BROADCAST_SCORES = 50_000
_WORD, _REST = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]"


def _tests(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is an entity."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) < 3
        big = lambda p: (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")
        return F.forall(F.split(match, r"\."), lambda p: part(p) | big(p))
    if kind == "card":
        twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        digit = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
        return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _tail(gap: Column) -> Column:
    """The end of a text from its last two words on."""
    return F.reverse(F.regexp_extract(F.reverse(gap), f"^{_REST}*+(?:{_WORD}(?:{_REST}++{_WORD})?+)?+{_REST}*+", 0))


def matches(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and found, an array of (kind, nth, gap, match, two, one, mark, next), of a table of keys and text.

    gap: code points between the last match and this one; two and one: the words before, mark: what stands between, next: the word after.
    """
    df = docs.select(*keys, F.coalesce("text", F.lit("")).alias("_t"))
    some = {"email": F.contains("_t", F.lit("@")), "phone": F.contains("_t", F.lit("+")), "id": F.col("_t").rlike("[0-9@=:]")}
    digit = F.col("_t").rlike("[0-9]")
    df = df.withColumn("_digit", digit)
    none = F.array().cast("array<string>")
    for kind in KINDS:
        when = some.get(kind, F.col("_digit"))
        df = df.withColumn(f"_m_{kind}", F.when(when, F.regexp_extract_all("_t", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
        df = df.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_t", PATTERNS[kind], -1)).otherwise(none))
    df = df.drop("_t", "_digit")

    def rows(kind: str) -> Column:
        found, gaps = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        text = lambda c: F.coalesce(c, F.lit(""))

        def row(m: Column, k: Column) -> Column:
            #: Read from the match to the left; the two matches before are looked into where the gap has too few words.
            at = lambda i: F.greatest(k - i, F.lit(0))
            first = F.when(k > 1, F.get(found, at(2)))
            last = F.when(k > 0, F.concat(text(first), _tail(F.get(gaps, at(1))), F.get(found, at(1))))
            back = F.reverse(F.concat(text(last), _tail(F.get(gaps, k))))
            ahead = F.concat(F.regexp_extract(F.get(gaps, k + 1), f"^{_REST}*+(?:{_WORD})?+{_REST}?+", 0), text(F.get(found, k + 1)))
            said = lambda s, p: F.regexp_extract(s, p, 1)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                k.cast("int").alias("nth"),
                F.length(F.get(gaps, k)).alias("gap"),
                m.alias("match"),
                F.lower(F.reverse(said(back, f"^{_REST}*+{_WORD}{_REST}++({_WORD})"))).alias("two"),
                F.lower(F.reverse(said(back, f"^{_REST}*+({_WORD})"))).alias("one"),
                said(back, r"^[^\p{L}\p{N}=:]*+([=:])").alias("mark"),
                F.lower(said(ahead, f"^{_REST}*+({_WORD})")).alias("next"),
            )

        return F.transform(found, row)

    df = df.withColumn("found", F.concat(*[rows(kind) for kind in KINDS]))
    return fence(df.select(*keys, "found"), "found")


def placed(found: DataFrame, *keys: str) -> DataFrame:
    """One row a valid base entity and a token that may be an identifier: keys, kind, start, end, match, two, one, mark and next."""
    each = found.select(*keys, F.inline("found"))
    run = Window.partitionBy(*keys, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("_upto", F.sum(F.col("gap") + F.length("match")).over(run))
    each = each.withColumn("end", F.col("_upto").cast("long")).withColumn("start", (F.col("_upto") - F.length("match")).cast("long"))
    good = F.lit(False)
    for i, kind in enumerate(KINDS):
        good = F.when(F.col("kind") == i, _tests(kind, F.col("match"))).otherwise(good)
    each = each.where(good)
    #: A token gives up its punctuation, and overlaps no base entity: the furthest end so far, and the next start, are looked at.
    bare = F.regexp_extract("match", r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*+", 0)
    tail = F.length(F.regexp_extract("match", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*$", 0))
    token = F.col("kind") == KINDS.index("id")
    head = F.when(token, F.length(bare)).otherwise(0)
    marked = (F.col("mark") != "") | F.startswith("match", F.lit("@"))
    each = each.withColumn("_marked", marked)
    each = each.withColumn("_head", head).withColumn("_tail", F.when(token, tail).otherwise(0))
    each = each.withColumn("match", F.when(token, F.substr("match", F.col("_head") + 1, F.greatest(F.lit(0), F.length("match") - F.col("_head") - F.col("_tail")))).otherwise(F.col("match")))
    each = each.withColumn("start", F.col("start") + F.col("_head")).withColumn("end", F.col("end") - F.col("_tail"))
    by = Window.partitionBy(*keys).orderBy("start", "kind", "nth")
    base = lambda c: F.when(~token, c)
    before = F.max(base(F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base(F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    each = each.withColumn("_before", before).withColumn("_after", after)
    free = (F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    long = (F.length("match") >= SHORTEST) & (F.length(F.regexp_replace("match", "[^0-9]", "")) >= 3) | F.col("_marked") & (F.length("match") >= SHORT)
    return each.where(~token | (free & long)).select(*keys, "kind", "start", "end", "match", "two", "one", "mark", "next")


def _patterns() -> Column:
    """The lexical patterns around a match, from the words beside it."""
    two, one, mark, next_ = F.col("two"), F.col("one"), F.col("mark"), F.col("next")
    has = lambda *words: F.least(*[F.length(w) for w in words]) > 0
    said = [
        F.when(has(two, one), F.concat(F.lit("L:"), two, F.lit(" "), one)),
        F.when(has(one, next_), F.concat(F.lit("M:"), one, F.lit(" _ "), next_)),
        F.when(has(one, mark), F.concat(F.lit("K:"), one, F.lit(" "), mark)),
    ]
    return F.array_compact(F.array(*said))


def graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seeds (instance), and the edges (pattern, instance, seed, n, patterns) of patterns with SUPPORT distinct instances, n of them. patterns: those of an instance without a digit, else null. rows: placed()."""
    instance = F.lower(F.col("match")).alias("instance")
    seed = (F.col("kind") != KINDS.index("id")) | F.col("match").rlike(KEY)
    seeds = settled(rows.where(seed).select(instance).distinct(), "seeds")
    pairs = settled(rows.select(F.explode(_patterns()).alias("pattern"), instance).distinct(), "pairs")
    lively = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    edges = pairs.join(lively.select(F.col("pattern").alias("_p"), "n"), F.col("pattern") == F.col("_p")).drop("_p")
    flags = seeds.select(F.col("instance").alias("_i"))
    edges = edges.join(flags, F.col("instance") == F.col("_i"), "left").withColumn("seed", F.col("_i").isNotNull()).drop("_i")
    edges = settled(edges, "edges")
    plain = edges.where(~F.col("instance").rlike("[0-9]")).groupBy("instance").agg(F.count(F.lit(1)).alias("patterns"))
    return seeds, settled(edges.join(plain, "instance", "left"), "weighed")


def discovered(rows: DataFrame) -> DataFrame:
    """(instance, score) of the identifiers that confident patterns name, and of the seeds. rows: placed()."""
    seeds, edges = graph(rows)
    #: What seeds give a pattern stays; in a round only edges of unknown instances with a score, and of confident patterns, are summed up.
    given = settled(edges.where("seed").groupBy("pattern", "n").agg(F.count(F.lit(1)).cast("double").alias("sum")), "given")
    unknown = edges.where(~F.col("seed")).select("pattern", "n", "instance", "patterns")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_SCORES else df
    found, state = seeds.limit(0).withColumn("score", F.lit(0.0)), None
    while True:
        scored = unknown.join(few(found.where(F.col("score") >= ENOUGH).select(F.col("instance").alias("_i"), F.col("score").alias("sum"))), F.col("instance") == F.col("_i"))
        sums = given.unionByName(scored.groupBy("pattern", "n").agg(F.sum("sum").alias("sum"))).groupBy("pattern", "n").agg(F.round(F.sum("sum"), 4).alias("sum"))
        confidence = F.col("sum") / (F.col("sum") + UNKNOWN * (F.col("n") - F.col("sum")) + SMOOTH)
        confident = sums.where(F.col("sum") >= SUPPORT).select(F.col("pattern").alias("_p"), confidence.alias("conf")).where(F.col("conf") >= TRUST)
        named = unknown.join(few(settled(confident, "confident")), F.col("pattern") == F.col("_p")).groupBy("instance", "patterns").agg(F.sum(F.ln(1 - F.col("conf"))).alias("miss"), F.count(F.lit(1)).alias("hits"))
        share = F.coalesce(F.col("hits") / F.col("patterns"), F.lit(1.0))
        found = settled(named.select("instance", F.round((1 - F.exp("miss")) * share, 4).alias("score")), "scores")
        before, state = state, tuple(found.agg(F.count(F.lit(1)), F.sum(F.round(F.col("score") * 10_000).cast("long"))).first())
        if state == before:
            return seeds.withColumn("score", F.lit(1.0)).unionByName(found.where(F.col("score") >= ENOUGH))


def report(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, base and spans (arrays of start, kind, end) of each row of a table of keys and text."""
    found = settled(matches(docs, *keys), "matches")
    rows = settled(placed(found.where(F.size("found") > 0).distinct(), *keys), "entities")
    new = discovered(rows).select(F.col("instance").alias("_i"))
    token = F.col("kind") == KINDS.index("id")
    added = rows.where(token).join(new, F.lower("match") == F.col("_i"), "left_semi")
    spans = rows.where(~token).unionByName(added).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "spans")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = found.select(*keys).join(spans, same, "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(*keys, F.filter("spans", lambda s: s["kind"] != KINDS.index("id")).alias("base"), "spans")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("_text_key"), "text")
    out = report(docs, "doc_id", "_text_key")
    n_id = (F.size("spans") - F.size("base")).cast("long").alias("n_id")
    return out.select("doc_id", *_counts(), F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), n_id, F.size("spans").cast("long").alias("n_spans"))


def _counts() -> list[Column]:
    def of(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return [of(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]

"""Text: names in texts, folding, tokens, small string rules. All are column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of capitalised names.
NAME = r"((?:[A-Z][a-zí]{1,15} )*(?:de )?[A-Z][a-zí]{1,15})"
#: Fixed: letters that have no base letter, and how they are written in Latin ones.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y",
    "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dzh",
}
#: Blocks of letters with marks: Latin, Greek, Cyrillic; and of marks that stand alone.
BLOCKS, MARKS = [(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)], [(0x300, 0x370)]


def _bare_letters() -> tuple[str, str]:
    """Lower-case letters with marks and their base letters, as Unicode takes them apart; then marks, for which nothing stands."""
    found = {}
    for first, last in BLOCKS:
        for c in map(chr, range(first, last)):
            parts = [p for p in unicodedata.normalize("NFD", c) if not unicodedata.combining(p)]
            if c == c.lower() and len(parts) == 1 and parts[0] != c and parts[0].isalpha():
                found[c] = parts[0]
    marks = "".join(chr(c) for first, last in MARKS for c in range(first, last))
    return "".join(found) + marks, "".join(found.values())


ACCENTS = _bare_letters()
LONG_TEXT, SHORT_TEXT = 100_000, 500


def fold(name: Column) -> Column:
    """Lower case in Latin letters without accents; letters of other scripts than Greek and Cyrillic stay. The same function serves both sides of a match."""
    out = F.translate(F.lower(name), *ACCENTS)
    for letter, latin in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(latin)) if len(latin) > 1 else out
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    return F.when(name.rlike(r"[^\x00-\x7F]"), out).otherwise(F.lower(name))


def normalize(name: Column) -> Column:
    """The folded name if it is longer than 3, else the lower-cased one."""
    return F.when(F.length(fold(name)) > 3, fold(name)).otherwise(F.lower(name))


def without_prefix(name: Column, prefix: str = "de ") -> Column:
    """Takes the prefix off; a word that begins with the same letters stays whole."""
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)


def pattern_names(text: Column, case_insensitive: bool = False) -> Column:
    """Names by the pattern, longer than 3."""
    found = F.regexp_extract_all(text, F.lit(("(?i)" if case_insensitive else "") + NAME), F.lit(1))
    return F.transform(F.filter(found, lambda n: F.length(n) > 3), lambda n: without_prefix(n))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def bare(word: Column) -> Column:
    """Without commas, then semicolons, then points at both ends."""
    for mark in ",;.":
        word = F.btrim(word, F.lit(mark))
    return word


def ngrams(items: Column, n: int = 2) -> Column:
    """Runs of n items joined by a space."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.concat_ws(" ", *[F.get(items, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def hygienic(name: Column) -> Column:
    """Whether a stripped name may be looked up: not blank, none of the forbidden marks."""
    return (F.trim(name) != "") & ~name.rlike("[,()?'\"{}]")


def tokenize(text: Column, stop: Iterable[str] = (), longest: int | None = 15) -> Column:
    """Topic tokens: marks become spaces, then words between 3 and `longest` letters that aren't stop words."""
    split = F.array_remove(F.split(F.translate(F.lower(text), "#_()/:.", "       "), r"\s+"), "")
    stop = sorted(stop)

    def keep(w: Column) -> Column:
        ok = F.length(w) > 3
        if longest is not None:
            ok = ok & (F.length(w) < longest)
        return ok & ~w.isin(stop) if stop else ok

    return F.filter(split, keep)


def prettify_topic(shown: Column) -> Column:
    """The quoted terms without digits, the first three joined as `a, b and c`."""
    terms = F.regexp_extract_all(shown, F.lit(r'"([^"\d]+)"'), F.lit(1))
    n = F.size(terms)
    first, second, third = (F.get(terms, i) for i in range(3))
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" and "), second)).when(n >= 3, F.concat(first, F.lit(", "), second, F.lit(" and "), third))


def file_name(name: Column) -> Column:
    """Marks and blanks become underscores, two of them (before blanks count) one; 1000 characters at most."""
    marked = F.regexp_replace(name, r"""[/\\'".:]""", "_")
    return F.left(F.replace(F.replace(marked, F.lit("__"), F.lit("_")), F.lit(" "), F.lit("_")), F.lit(1000))


def dataset_name(path: Column) -> Column:
    """A name for a dataset of its address: points, slashes, dashes and colons become underscores, then three of them one, and two of them."""
    out = F.translate(path, "./-:", "____")
    for run in ("___", "__"):
        out = F.replace(out, F.lit(run), F.lit("_"))
    return out


def fixed_url(url: Column) -> Column:
    """Quotes go, redirects of a search engine are unwrapped, and a scheme is put before."""
    bare_url = F.btrim(F.trim(url), F.lit("\"'"))
    inner = F.regexp_extract(bare_url, "[?&]url=([^&]{10,})", 1)
    bare_url = F.when(bare_url.startswith("https://www.google.com/url?") & (inner != ""), F.url_decode(inner)).otherwise(bare_url)
    return F.when(bare_url.startswith("http"), bare_url).otherwise(F.concat(F.lit("http://"), bare_url))


def extension(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


#: Fixed: keywords of admin levels, looked for in this order.
LEVELS = {1: ["admin 1", "admin1", "adm1", "shabiya"], 2: ["admin 2", "admin2", "adm2"], 3: ["admin 3", "admin3", "adm3"], 4: ["admin 4", "admin4", "adm4"], 5: ["admin 5", "admin5", "adm5", "vill", "village", "hay"]}


def admin_level(name: Column) -> Column:
    out = None
    for level, keys in LEVELS.items():
        hit = F.lower(name).rlike("|".join(keys))
        out = (F if out is None else out).when(hit, F.lit(level))
    return out


def short_date(time: Column) -> Column:
    """Two-digit year, month and day."""
    return F.date_format(time, "yy-MM-dd")


def is_pcode(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z]{2}\d{2,}")


def is_digits(value: Column) -> Column:
    return value.rlike(r"^\d+$")


def all_names(*columns: str, listed: str = "other_names") -> Column:
    """Distinct names of a place: the name columns and the comma list, without nulls."""
    return F.array_compact(F.array_distinct(F.concat(F.array(*columns), F.coalesce(F.split(listed, ","), F.array().cast("array<string>")))))


def random_token(length: int = 25) -> Column:
    if length < 0:
        raise ValueError("a token can't have a negative length")
    return F.randstr(F.lit(length))

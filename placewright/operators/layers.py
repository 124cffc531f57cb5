"""What the columns of an unknown layer mean, from their names and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEVELS, is_digits, is_pcode
from . import analytics


def level_of(text: str | None) -> int | None:
    """The admin level that a name speaks of."""
    low = (text or "").lower()
    return next((level for level, keys in LEVELS.items() if any(k in low for k in keys)), None)


def name_share(df: DataFrame) -> DataFrame:
    """(field, share): of each text column the share of distinct values that could be names, no code and no number."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in texts])).alias("_f")).select("_f.*").where("value IS NOT NULL").distinct()
    ok = ~is_pcode(F.col("value")) & ~is_digits(F.col("value"))
    return each.groupBy("field").agg(F.avg(ok.cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def parse_layer(df: DataFrame, layer: str, completeness: float = 0.8, uniqueness: float = 0.8) -> dict:
    """name, aliases, pcode, parent_pcode, area_sqkm and admin_level of a layer, as far as they can be told.

    Only the profile (a row a column) comes to the driver.
    """
    about = {r.field: r for r in analytics.profile(df).collect()}
    kinds = dict(df.dtypes)
    texts = [c for c, k in kinds.items() if k == "string"]
    shares = {r.field: r for r in name_share(df).collect()} if texts else {}
    out: dict = {"admin_level": level_of(layer)}

    def names(c: float, u: float) -> list[str]:
        ok = [f for f in texts if "pc" not in f.lower() and about[f].completeness > c and about[f].uniqueness > u and f in shares and shares[f].n > 10 and shares[f].share > 0.7]
        return sorted(ok, key=lambda f: -about[f].uniqueness)

    found = names(completeness, uniqueness) or names(0.4, 0.4)
    if not found:
        found = [f for f in ("NOMBRE", "name") if f in df.columns][:1]
    english = [f for f in found if not f.lower().endswith("ar")] or found
    out["name"] = english[0] if english else None
    out["aliases"] = [f for f in found if f != out["name"]]
    codes = []
    for f in df.columns:
        low = f.lower()
        if "objectid" in low or "leng" in low:
            continue
        if "pcode" in low or low.endswith("_pc"):
            if about[f].completeness > 0.9 and about[f].uniqueness > about[f].completeness - 0.05:
                out["pcode"] = f
            else:
                codes.append(f)
    if codes:
        out["parent_pcode"] = max(codes, key=lambda f: about[f].uniqueness)
    for f in texts:
        if about[f].completeness > 0 and shares.get(f) is not None and shares[f].n <= 2:
            if {r[0] for r in df.select(F.lower(f"`{f}`")).distinct().limit(3).collect()} >= {"region", "state"}:
                out["admin_level"] = 1
    areas = [f for f, k in kinds.items() if k != "string" and ("area" in f.lower() or any(m in f.lower() for m in ("km2", "sqkm", "sq_km"))) and about[f].completeness > completeness]
    if areas:
        areas = sorted(areas, key=lambda f: -(about[f].median or 0))
        square = [f for f in areas if any(m in f.lower() for m in ("km2", "sqkm", "sq_km"))]
        out["area_sqkm"] = (square or areas)[0]
    if out["admin_level"] is None:
        out["admin_level"] = level_of(out["name"])
    return out


def load_layer(df: DataFrame, layer: str, country_code: str | None = None) -> DataFrame:
    """A layer as places to match and insert: name, names, pcode, parent_pcode, area, level; names of 2 letters or less are left out."""
    about = parse_layer(df, layer)
    of = lambda k, kind="string": F.col(f"`{about[k]}`").cast(kind) if about.get(k) else F.lit(None).cast(kind)
    rows = df.select(
        of("name").alias("name"),
        F.array(*[F.col(f"`{a}`").cast("string") for a in about["aliases"]]).cast("array<string>").alias("aliases"),
        of("pcode").alias("pcode"),
        of("parent_pcode").alias("parent_pcode"),
        of("area_sqkm", "double").alias("area_sqkm"),
        F.lit(about["admin_level"]).cast("int").alias("admin_level"),
        F.lit(country_code).cast("string").alias("country_code"),
        *[c for c in ("lon", "lat", "mpoly") if c in df.columns],
    )
    return rows.where(F.length("name") > 2).distinct()

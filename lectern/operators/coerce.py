"""Untrusted JSON of figures and tables, read as VARIANT and brought into form: texts, limits, safe addresses; broken rows stand aside.

What isn't of the kind that is asked for counts as missing: a number isn't a text, an object no list. Texts of a list or an object are joined
by semicolons (an object's in the order of its keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, once
from ..functions.narrative import points
from ..functions.predicates import image_data_url
from ..functions.text import collapse, strip, text_of

# How much of a list and a text is kept, and what stands for a missing one.
ASSETS_KEPT, ROWS_KEPT, CELLS_KEPT, PART = 6, 20, 24, 180
FIGURE_SOURCE, TABLE_SOURCE = "Original paper figure placeholder", "Original paper artwork"


def parsed(df: DataFrame, json: str, name: str = "v") -> tuple[DataFrame, DataFrame]:
    """Rows whose column is JSON, with it as VARIANT, and the others as they are."""
    both = once(df, name, F.try_parse_json(F.col(json)))
    return both.filter(F.col(name).isNotNull()), both.filter(F.col(name).isNull()).drop(name)


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _list(v: Column) -> Column:
    """The items of a list; none of anything else."""
    return F.coalesce(F.when(_kind(v) == "ARRAY", _as(v, "array<variant>")), F.array().cast("array<variant>"))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _cut(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def text(v: Column, missing: Column | str = "", most: int = 500, deep: int = 1) -> Column:
    """A text of at most so many characters; lists and objects of texts are joined."""
    fallback = F.lit(missing) if isinstance(missing, str) else missing
    raw = F.when(_kind(v) == "STRING", _as(v, "string"))
    if deep:
        joined = lambda items: F.array_join(F.filter(F.transform(items, lambda i: text(i, "", PART, deep - 1)), lambda t: t != ""), "; ")
        raw = raw.when(_kind(v) == "ARRAY", joined(_list(v))).when(_kind(v) == "OBJECT", joined(F.coalesce(F.map_values(_as(v, "map<string,variant>")), F.array().cast("array<variant>"))))
    return bound(collapse(F.coalesce(F.nullif(raw, F.lit("")), fallback)), lambda x: _cut(x, most))


def asset_url(v: Column) -> Column:
    """Inline images as they are, other addresses up to 500 characters."""
    x = strip(F.coalesce(_as(v, "string"), F.lit("")))
    return bound(x, lambda u: F.when(image_data_url(u), u).otherwise(_cut(collapse(u), 500)))


def caption(v: Column, most: int = 500) -> Column:
    return bound(text(v, "", max(most * 4, 2400)), lambda x: F.when(F.length(x) <= most, x).otherwise(bound(F.array_join(points(x, 4, most), " "), lambda p: F.when(p != "", p).otherwise(strip(F.substring(x, 1, most))))))


def _image(v: Column, kind: str = "") -> Column:
    return F.struct(asset_url(_get(v, "$.url")).alias("url"), text(_get(v, "$.type"), kind, 80).alias("type"), text(_get(v, "$.path"), "", 240).alias("path"))


def figures(v: Column, limit: int) -> Column:
    """array<struct<name, source, caption, assets>> of a list of names or objects."""

    def one(x: Column, i: Column) -> Column:
        number = F.concat(F.lit("Figure "), (i + 1).cast("string"))
        plain = _kind(x) == "STRING"
        found = F.filter(F.transform(F.slice(_list(_get(x, "$.assets")), 1, ASSETS_KEPT), lambda a: _image(a)), lambda a: a["url"] != "")
        return F.struct(
            F.when(plain, text(x, number, 160)).otherwise(text(_get(x, "$.name"), number, 160)).alias("name"),
            F.when(plain, FIGURE_SOURCE).otherwise(text(_get(x, "$.source"), FIGURE_SOURCE, 240)).alias("source"),
            F.when(~plain, caption(_get(x, "$.caption"))).alias("caption"),
            found.alias("assets"),
        )

    return F.transform(F.slice(_list(v), 1, limit), one)


def tables(v: Column, limit: int) -> Column:
    """array<struct<name, caption, source, image, pdf_crop, rows>> of a list of objects."""

    def one(x: Column, i: Column) -> Column:
        name = text(_get(x, "$.name"), F.concat(F.lit("Table "), (i + 1).cast("string")), 120)
        crop_url = text(_get(x, "$.pdfCrop.url"), "", 500)
        told = F.nullif(_as(_get(x, "$.pdfCrop.tableNumber"), "double"), F.lit(0.0))
        named = F.nullif(F.regexp_extract(text_of(_as(_get(x, "$.name"), "string")), r"(?i)Table\s*(\d+)", 1), F.lit("")).try_cast("double")
        crop = F.struct(crop_url.alias("url"), text(_get(x, "$.pdfCrop.fallbackUrl"), "", 500).alias("fallback_url"), F.coalesce(told, named, (i + 1).cast("double")).alias("table_number"))
        rows = F.transform(F.slice(_list(_get(x, "$.rows")), 1, ROWS_KEPT), lambda r: F.transform(F.slice(_list(r), 1, CELLS_KEPT), lambda c: text(c, "", 160)))
        return F.struct(
            name.alias("name"), caption(_get(x, "$.caption")).alias("caption"), text(_get(x, "$.source"), TABLE_SOURCE, 300).alias("source"),
            F.when(asset_url(_get(x, "$.image.url")) != "", _image(_get(x, "$.image"), "image/png")).alias("image"), F.when(crop_url != "", crop).alias("pdf_crop"), rows.alias("rows"),
        )

    return F.transform(F.slice(_list(v), 1, limit), one)

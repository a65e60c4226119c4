"""Panels of a report page: their heights by width, how badly a place suits them, and the best arrangement in two columns.

A paper's panels stand in its row (doc_id, panels array<struct<id, weight, aspect, min_width, min_height, has_table,
samples array<struct<width, height>>>>), in reading order. Sizes are shares of the page's width. Nothing is shuffled;
a paper has seven panels at most, so the candidates are bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.arrays import bound, once

# The page's width in pixels, the shares of the left column, and the page shapes that are tried.
CANVAS = 1600
RATIOS = [0.38, 0.4, 0.42, 0.44, 0.46, 0.48, 0.5, 0.52, 0.54, 0.56, 0.58, 0.6, 0.62]
ASPECTS = [0.78, 0.9, 1.0, 1.1, 1.15, 1.25, 1.35, 1.45, 1.55, 1.65, 1.7, 1.72, 1.78, 1.84, 1.9]
# The shape that is liked best, what costs how much in an arrangement, and what is left over without harm.
LIKED_ASPECT, SHAPE_COST, UNEVEN_COST, UNUSED_COST, OFF_CENTER_COST, SWITCH_COST, SLACK = 1.55, 3, 24_000, 1_000, 2, 0.8, 0.002


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def height_at(samples: Column, width: Column) -> Column:
    """Height of a panel at a width, by its measured sizes: linear between two, by powers outside; 0 without any.

    Sizes that aren't above 0 don't count; of two at one width either may.
    """
    return bound(_points(samples), lambda p: _height(p, width))


def _points(samples: Column) -> Column:
    """The measured sizes that count, by width."""
    number = lambda s: F.struct(s["width"].cast("double").alias("width"), s["height"].cast("double").alias("height"))
    return F.array_sort(F.transform(F.filter(F.coalesce(samples, F.array().cast("array<struct<width:double,height:double>>")), lambda s: (s["width"] > 0) & (s["height"] > 0)), number))


def _height(p: Column, width: Column) -> Column:
    """height_at of a panel's _points."""

    def among(upper: Column) -> Column:  # place of the first size that isn't narrower
        first, last = F.get(p, F.lit(0)), F.try_element_at(p, F.lit(-1))
        a, b = F.get(p, upper - 1), F.get(p, upper)
        between = a["height"] + (b["height"] - a["height"]) * (width - a["width"]) / (b["width"] - a["width"])
        narrow = first["height"] * F.pow(first["width"] / F.greatest(width, F.lit(80.0)), F.lit(0.7))
        wide = F.greatest(last["height"] * 0.95, last["height"] * F.pow(last["width"] / width, F.lit(0.2)))
        return F.when(F.size(p) == 0, 0.0).when(width <= first["width"], narrow).when(width >= last["width"], wide).otherwise(between)

    return bound(F.size(F.filter(p, lambda s: s["width"] < width)), among)


def aspect_at(samples: Column, width: Column, fallback: Column) -> Column:
    """Width by height of a panel at a width; the fallback for one without sizes."""
    return bound(height_at(samples, width), lambda h: F.when(h > 0, _clamp(width / h, 0.75, 6.8)).otherwise(fallback))


def figure_floor(groups: Column, width: Column) -> Column:
    """Least height at which groups of figures (array<array<double>> of aspects) can be read: two a line at most, and room for each group's caption."""
    usable = F.greatest(F.lit(120.0), width - 24)

    def group(g: Column) -> Column:
        def lines(a: Column) -> Column:
            columns = F.least(F.lit(2), F.size(a))
            each = (usable - (columns - 1) * 8) / columns
            heights = F.transform(a, lambda x: F.when(x < 1.15, _clamp(each / x, 180.0, 520.0)).otherwise(_clamp(each / x, 110.0, 620.0)))
            tallest = lambda h: F.filter(F.transform(h, lambda v, i: F.when(i % columns == 0, F.greatest(v, F.coalesce(F.when(columns == 2, F.get(h, i + 1)), v)))), lambda v: v.isNotNull())
            return F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(bound(heights, tallest), F.lit(0.0), lambda s, v: s + v) + 78)

        return bound(F.filter(F.coalesce(g, F.array().cast("array<double>")), lambda x: x > 0), lines)

    total = F.aggregate(F.transform(F.coalesce(groups, F.array().cast("array<array<double>>")), group), F.lit(0.0), lambda s, v: s + v)
    return F.when(width > 0, total).otherwise(0.0)


#: Widths of the columns by side and ratio, and how many arrangements' papers are worked on at once.
_WIDTHS = np.array([RATIOS, [1 - r for r in RATIOS]])
_AT_ONCE = 256


def panel_heights(tall: np.ndarray, table: np.ndarray, least_height: np.ndarray) -> np.ndarray:
    """Heights, as shares of the page's width, that panels need where their content is so tall (in pixels; 0: not measured)."""
    needs = np.where(tall > 0, (tall + np.where(table > 0, 24, 18)) / CANVAS, 0.13)
    return np.maximum(np.where(least_height > 0, least_height, 0.09), needs)


def panel_losses(weight: np.ndarray, aspect: np.ndarray, least_width: np.ndarray, least_height: np.ndarray, tall: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How badly places of a width and height suit panels: their shape, their least sizes, cut content and blank room."""
    positive = lambda x: np.maximum(0.0, x)
    shape = np.maximum(w / np.maximum(h, 0.001), 0.05)
    narrow = positive(np.where(least_width > 0.16, least_width, 0.16) - w)
    low = positive(np.maximum(0.075, np.where(least_height > 0, least_height, 0.13)) - h)
    portrait = positive(0.62 - shape)
    broken = narrow + low + portrait
    loss = np.abs(np.log(shape / aspect)) * weight + np.where(broken > 0, 100_000 + broken * weight * 100_000, 0.0)
    loss = loss + (positive(0.18 - w) * 24 + positive(0.14 - h) * 24 + portrait * weight * 20)
    loss = loss + np.where((h > 0.42) & (w < 0.24), (0.24 - w + h - 0.42) * weight * 30, 0.0)
    loss = loss + np.where(aspect >= 2.4, positive(1.45 - shape) * weight * 18, 0.0)
    has = np.maximum(80.0, h * CANVAS - 8)
    cut = np.where(tall > has, 250_000 + (tall - has) * weight * 2_500, 0.0)
    return loss + np.where(tall > 0, cut + positive(has / np.where(tall > 0, tall, 1.0) - 1.18) * weight * 48, 0.0)


def _best(facts: np.ndarray, ids: np.ndarray, aspects: list[float]) -> dict[str, np.ndarray]:
    """The best arrangements of papers with one number of panels: facts by paper, panel and figure (see two_columns)."""
    n, of = facts.shape[1], np.arange(len(facts))
    weight, aspect, least_width, least_height, table = (facts[..., j, None, None] for j in range(5))
    tall = facts[..., 5:].reshape(*facts.shape[:2], *_WIDTHS.shape)
    h = panel_heights(tall, table, least_height)
    loss = panel_losses(weight, aspect, least_width, least_height, tall, _WIDTHS, h)
    fits = np.broadcast_to(_WIDTHS >= np.where(np.isnan(least_width) | (least_width == 0), 0.16, least_width), h.shape)
    h, loss, fits = (x.transpose(0, 1, 3, 2) for x in (h, loss, fits))  # by paper, panel, ratio and side
    masks = np.arange(1, 2**n - 1, 2)
    left = (masks >> np.arange(n)[:, None]) & 1 > 0
    shape = (len(facts), len(RATIOS), len(masks))
    l, r, total, ok = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.ones(shape, bool)
    marks = {m: np.full(shape, np.nan) for m in ("theory", "results", "contribution")}
    for i in range(n):
        side = 1 - left[i].astype(int)
        own, y = h[:, i][:, :, side], np.where(left[i], l, r)
        marks = {m: np.where((ids[:, i] == m)[:, None, None], y, v) for m, v in marks.items()}
        l, r = np.where(left[i], l + own, l), np.where(left[i], r, r + own)
        total, ok = total + loss[:, i][:, :, side], ok & fits[:, i][:, :, side]
    switches = (left[1:] != left[:-1]).sum(axis=0)
    total = total + np.abs(l - r) * UNEVEN_COST + (np.abs(np.array(RATIOS) - 0.5) * OFF_CENTER_COST)[:, None] + np.maximum(0, switches - 2) * SWITCH_COST
    ok &= ~(marks["theory"] > marks["results"] + SLACK) & ~(marks["contribution"] < marks["results"] - SLACK) & ~np.isnan(total)
    total, l, r = (x.reshape(len(facts), -1) for x in (np.where(ok, total, np.inf), l, r))
    bottom, best = np.maximum(l, r), np.full(len(facts), np.inf)
    out = {k: np.zeros(len(facts), np.int32) for k in ("n", "at")} | {k: np.zeros(len(facts)) for k in ("loss", "bottom")}
    for j, a in enumerate(aspects):
        high = 1.0 / a
        cost = total + (np.maximum(0.0, high - l) + np.maximum(0.0, high - r)) * UNUSED_COST
        adjusted = np.where(bottom <= high + SLACK, cost + np.abs(np.log(a / LIKED_ASPECT)) * SHAPE_COST, np.inf)
        at = adjusted.argmin(axis=1)
        better = adjusted[of, at] < best
        best = np.where(better, adjusted[of, at], best)
        for k, v in (("n", j), ("at", at), ("loss", cost[of, at]), ("bottom", bottom[of, at])):
            out[k] = np.where(better, v, out[k])
    ratio, m = np.divmod(out.pop("at"), len(masks))
    sides = 1 - left[:, m].T.astype(int)
    heights = h[of[:, None], np.arange(n), ratio[:, None], sides]
    return out | {"k": ratio, "mask": masks[m], "heights": heights, "found": np.isfinite(best)}


def _searched(aspects: list[float]):
    """Batches of (doc_id, ids, facts) to the best arrangement of each paper that has one."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(first, _AT_ONCE)
                sizes = pc.list_value_length(part.column("ids")).to_numpy()
                starts = np.cumsum(sizes) - sizes
                facts = part.column("facts").flatten().flatten().to_numpy(zero_copy_only=False).reshape(int(sizes.sum()), -1)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    places = starts[rows][:, None] + np.arange(size)
                    best = _best(facts[places], ids[places], aspects)
                    found = np.flatnonzero(best["found"])
                    columns = [pa.array(best[c][found].astype(np.int32)) for c in ("n", "k", "mask")] + [pa.array(best[c][found]) for c in ("loss", "bottom")]
                    heights = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * size), pa.array(best["heights"][found].ravel()))
                    own = part.take(pa.array(rows[found]))
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("ids"), *columns, heights], names=["doc_id", "ids", "n", "k", "mask", "loss", "bottom", "heights"])

    return run


def two_columns(papers: DataFrame, aspects: list[float] = ASPECTS) -> DataFrame:
    """doc_id, aspect, ratio, mask, loss, panels array<struct<id, x, y, w, h>> of the best arrangement in two columns.

    All assignments of panels to columns (bit i of the mask is set if panel i stands left; the first one does) are
    tried at all ratios and shapes. As a panel's height depends on its column's width only, heights are made once a
    ratio and side in the row; the assignments of some hundred papers are then added up together, in arrays. Theory may not stand below results, nor a contribution above them; no
    panel may be narrower than it must. Ties go to the first shape, ratio and mask. Papers of fewer than three or more
    than seven panels, with sizes of fewer than half of them, or without any arrangement that fits, have no row.
    """
    measured = F.size(F.filter("panels", lambda p: F.size(F.coalesce(p["samples"], F.array().cast("array<struct<width:double,height:double>>"))) > 0))
    rows = papers.filter(F.size("panels").between(3, 7) & (measured * 2 >= F.size("panels"))).select("doc_id", "panels")
    widths = F.array(*[F.lit(float(w * CANVAS - 8)) for w in _WIDTHS.ravel()])
    own = lambda p: F.array(*[p[c].cast("double") for c in ("weight", "aspect", "min_width", "min_height", "has_table")])
    fact = lambda p: bound(_points(p["samples"]), lambda s: F.concat(own(p), F.transform(widths, lambda w: _height(s, w))))
    asked = rows.select("doc_id", F.col("panels.id").cast("array<string>").alias("ids"), F.transform("panels", fact).alias("facts"))
    schema = StructType([asked.schema["doc_id"], *StructType.fromDDL("ids array<string>, n int, k int, mask int, loss double, bottom double, heights array<double>")])
    best = asked.mapInArrow(_searched(aspects), schema)
    ratio = F.get(F.array(*[F.lit(r) for r in RATIOS]), F.col("k"))

    def placed(name: Column, i: Column) -> Column:
        side = lambda j: F.expr("mask").bitwiseAND(F.pow(F.lit(2), j).cast("int")) != 0
        y = F.aggregate(F.filter(F.transform("heights", lambda h, j: F.struct(h.alias("h"), j.alias("j"))), lambda q: (q["j"] < i) & (side(q["j"]) == side(i))), F.lit(0.0), lambda s, q: s + q["h"])
        return F.struct(name.alias("id"), F.when(side(i), 0.0).otherwise(ratio).alias("x"), y.alias("y"), F.when(side(i), ratio).otherwise(1 - ratio).alias("w"), F.get("heights", i).alias("h"))

    tried = F.get(F.array(*[F.lit(float(a)) for a in aspects]), F.col("n"))
    aspect = F.least(F.lit(2.1), F.greatest(tried, 1 / F.greatest(F.col("bottom"), F.lit(0.001))))
    return best.select("doc_id", aspect.alias("aspect"), ratio.alias("ratio"), "mask", "loss", F.transform("ids", placed).alias("panels"))


# How much each section counts and its usual shape, and what its content adds.
SECTIONS = {"problem": (0.95, 1.35), "motivation": (0.9, 1.35), "method": (1.35, 1.75), "theory": (1.15, 1.05), "visuals": (1.55, 2.25), "results": (1.2, 1.05), "contribution": (0.78, 4.2)}
OTHER_SECTION = (1.0, 1.35)
PRIORITIES = {"high": 1.16, "supporting": 0.82}
MEDIA_WEIGHTS = {"n_images": 1.45, "n_drawings": 0.9, "n_diagrams": 0.85, "n_figures": 0.55, "n_formulas": 0.65, "n_table_figures": 1.15}


def panel_features(rows: DataFrame) -> DataFrame:
    """Panels by their content with weight, aspect, min_width, min_height, has_table and samples, as two_columns takes them.

    rows: (…, id, priority, text_chars, image_aspects and drawing_aspects array<double>, groups array<array<double>> of figures' shapes,
    n_diagrams, n_figures, n_formulas, n_table_rows, n_table_figures, n_table_images, n_multi, samples). Missing numbers count as 0;
    a measured height is never below what its figures need to be read.
    """
    counts = ["text_chars", "n_diagrams", "n_figures", "n_formulas", "n_table_rows", "n_table_figures", "n_table_images", "n_multi"]
    listed = lambda n: F.coalesce(F.filter(n, lambda a: a > 0), F.array().cast("array<double>"))
    df = rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {n: listed(n) for n in ("image_aspects", "drawing_aspects")})
    df = df.withColumns({"n_images": F.size("image_aspects"), "n_drawings": F.size("drawing_aspects")})
    df = once(df, "_media", F.concat("image_aspects", "drawing_aspects"))
    floored = F.transform("samples", lambda s: F.struct(s["width"].cast("double").alias("width"), F.greatest(s["height"].cast("double"), figure_floor(F.col("groups"), s["width"])).alias("height")))
    df = once(df, "_sizes", floored).drop("samples").withColumnRenamed("_sizes", "samples")
    bias = lambda k: F.coalesce(*[F.when(F.col("id") == n, F.lit(v[k])) for n, v in SECTIONS.items()], F.lit(OTHER_SECTION[k]))
    df = once(df, "_at", F.struct(*[height_at(F.col("samples"), F.lit(float(w))).alias(n) for n, w in (("text", 560), ("diagram", 1120), ("compact", CANVAS - 40))], aspect_at(F.col("samples"), F.lit(560.0), bias(1)).alias("shape")))
    c, at = F.col, lambda n: F.col(f"_at.{n}")
    table = (c("n_table_figures") > 0) | (c("n_table_rows") > 0)
    rich = (c("n_images") > 0) | (c("n_drawings") > 0) | (c("n_formulas") > 1)
    factor = F.coalesce(*[F.when(c("priority") == k, F.lit(v)) for k, v in PRIORITIES.items()], F.lit(1.0))
    media = sum((c(n) * v for n, v in MEDIA_WEIGHTS.items()), F.least(c("n_table_rows"), F.lit(10)) * 0.12)
    measured = F.when(at("text") > 0, _clamp(at("text") / 210, 0.75, 3.8)).otherwise(1.0)
    weight = _clamp((0.55 + _clamp(c("text_chars") / 260, 0.45, 2.8) + media + measured) * bias(0) * factor, 0.75, 9.5)
    mean = F.aggregate("_media", F.lit(0.0), lambda s, a: s + a) / F.nullif(F.size("_media"), F.lit(0))
    grouped = F.coalesce(mean, bias(1)) * F.when(F.size("_media") > 1, 1.35).otherwise(1.0)
    shape = F.when((c("n_multi") > 0) | (c("n_figures") > 1), F.greatest(grouped, F.lit(1.35))).otherwise(grouped)
    alone = F.when(F.size("_media") > 0, shape).otherwise(at("shape") * 0.82 + bias(1) * 0.18)
    shown = F.aggregate(F.coalesce("groups", F.array().cast("array<array<double>>")), F.lit(0), lambda s, g: s + F.size(g))
    width = (
        F.when(c("id") == "contribution", 0.28).when(c("id") == "problem", 0.26)
        .when(table, F.when((c("n_table_figures") > 1) | (c("n_table_images") > 1), 0.46).otherwise(0.36))
        .when((shown > 1) | ((shown > 0) & F.exists("_media", lambda a: a < 2.2)), 0.46)
        .when((c("n_multi") > 0) & (c("n_figures") > 1), 0.42)
        .when(F.exists("_media", lambda a: a >= 1.45) | (c("n_images") > 0) | (c("n_formulas") > 0), 0.4)
        .when(rich, 0.3).otherwise(0.16)
    )
    content = _clamp(0.13 + c("text_chars") / 6000, 0.13, 0.19)
    text = F.when(at("text") > 0, _clamp((at("text") + 18) / CANVAS, 0.085, 0.19)).otherwise(content)
    diagram = F.when(~rich & (at("diagram") > 0), _clamp((at("diagram") + 18) / CANVAS, 0.095, 0.16)).otherwise(text)
    summary = F.least(F.when(c("id") == "problem", 0.16).otherwise(0.145), F.greatest(F.lit(0.075), (at("compact") + 14) / CANVAS))
    height = (
        F.when(c("id").isin("problem", "contribution") & (at("compact") > 0), summary)
        .when(table, _clamp(0.215 + F.least(c("n_table_rows"), F.lit(12)) * 0.004, 0.215, 0.255))
        .when(rich, F.greatest(F.lit(0.2), content)).when(c("n_diagrams") > 0, diagram).otherwise(text)
    )
    made = {"weight": F.when(table, _clamp(weight * 1.22, 0.75, 9.5)).otherwise(weight), "aspect": F.when(table, _clamp((shape + 1.45) / 2, 1.45, 2.45)).otherwise(_clamp(alone, 0.75, 6.8)), "min_width": width, "min_height": height, "has_table": table}
    return df.withColumns(made).drop("_media", "_at")

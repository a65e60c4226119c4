"""Queries of panels, which each document gets by its id: four to seven of them, some without measured sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels
from .base import query, spread, table

_IDS = ["problem", "motivation", "method", "theory", "visuals", "results", "contribution"]


def _papers(spark, d):
    """doc_id, panels."""
    doc = F.col("doc_id")

    def panel(i):
        tall = 120 + 40 * ((doc * 3 + i * 5) % 9)
        sizes = F.array(*[F.struct(F.lit(float(w)).alias("width"), (tall * share).cast("double").alias("height")) for w, share in ((280, 1.0), (560, 0.5), (1120, 0.25))])
        return F.struct(
            F.element_at(F.array(*[F.lit(n) for n in _IDS]), i + 1).alias("id"), (1 + (doc * 7 + i * 3) % 5).cast("double").alias("weight"), (0.75 + (doc + i * 2) % 6 * 0.5).cast("double").alias("aspect"),
            (0.16 + (doc + i) % 4 * 0.08).cast("double").alias("min_width"), (0.08 + (doc + i) % 3 * 0.02).cast("double").alias("min_height"), ((doc + i) % 6 == 0).alias("has_table"),
            F.when((doc + i) % 5 == 0, F.slice(sizes, 1, 0)).otherwise(sizes).alias("samples"),
        )

    return spread(table(spark, d, "documents")).select("doc_id", F.transform(F.sequence(F.lit(0), (3 + doc % 4).cast("int")), panel).alias("panels"))


#: A panel's height at a width in pixels, by its three sizes (t, t / 2 and t / 4 at 280, 560 and 1120) or none.
_TALL = "CASE WHEN none THEN 0 WHEN {w} <= 280 THEN t * pow(280 / greatest({w}, 80), 0.7) WHEN {w} >= 1120 THEN greatest(t / 4 * 0.95, t / 4 * pow(1120 / {w}, 0.2)) WHEN {w} <= 560 THEN t - t / 2 * ({w} - 280) / 280 ELSE t / 2 - t / 4 * ({w} - 560) / 560 END"
_PANELS = "p AS (SELECT doc_id, i, 4 + doc_id % 4 AS n, 1 + (doc_id * 7 + i * 3) % 5 AS g, 0.75::DOUBLE + (doc_id + i * 2) % 6 * 0.5::DOUBLE AS a, 0.16::DOUBLE + (doc_id + i) % 4 * 0.08::DOUBLE AS mw, 0.08::DOUBLE + (doc_id + i) % 3 * 0.02::DOUBLE AS mh, (doc_id + i) % 6 = 0 AS tab, (doc_id + i) % 5 = 0 AS none, (120 + 40 * ((doc_id * 3 + i * 5) % 9))::DOUBLE AS t FROM (SELECT doc_id, unnest(range(0, 4 + doc_id % 4)) AS i FROM documents))"


@query(f"""WITH {_PANELS}, w AS (SELECT *, unnest([100, 280, 420, 700, 1120, 1592])::DOUBLE AS w FROM p), h AS (SELECT *, {_TALL.format(w='w')} AS h FROM w)
SELECT doc_id, i::INT AS panel, w AS width, round(h, 6)::DOUBLE AS height, round(CASE WHEN h > 0 THEN least(6.8, greatest(0.75, w / h)) ELSE a END, 6)::DOUBLE AS aspect FROM h""")
def panel_heights(spark, d):
    """Heights and shapes of panels at six widths."""
    widths = F.explode(F.array(*[F.lit(float(w)) for w in (100, 280, 420, 700, 1120, 1592)]))
    each = _papers(spark, d).select("doc_id", F.posexplode("panels").alias("panel", "p")).select("doc_id", "panel", "p", widths.alias("width"))
    at = lambda c: F.round(c, 6)
    return each.select("doc_id", "panel", "width", at(panels.height_at(F.col("p.samples"), F.col("width"))).alias("height"), at(panels.aspect_at(F.col("p.samples"), F.col("width"), F.col("p.aspect"))).alias("aspect"))


@query(f"""WITH {_PANELS}, r AS (SELECT unnest([0.38, 0.4, 0.42, 0.44, 0.46, 0.48, 0.5, 0.52, 0.54, 0.56, 0.58, 0.6, 0.62])::DOUBLE AS r),
s AS (SELECT *, CASE WHEN is_left THEN r ELSE 1 - r END AS w FROM p, r, (SELECT unnest([true, false]) AS is_left)),
h AS (SELECT *, {_TALL.format(w='greatest(160, w * 1600 - 8)')} AS need, {_TALL.format(w='greatest(120, w * 1600 - 8)')} AS needs FROM s),
k AS (SELECT *, greatest(mh, CASE WHEN need > 0 THEN (need + CASE WHEN tab THEN 24 ELSE 18 END) / 1600 ELSE 0.13 END) AS h FROM h),
x AS (SELECT *, greatest(w / greatest(h, 0.001), 0.05) AS shape, greatest(80, h * 1600 - 8) AS has FROM k),
y AS (SELECT *, greatest(0, greatest(0.16, mw) - w) + greatest(0, greatest(0.075, mh) - h) + greatest(0, 0.62 - shape) AS miss FROM x),
c AS (SELECT doc_id, i, n, r, is_left, h, mw, w, abs(ln(shape / a)) * g + CASE WHEN miss > 0 THEN 100000 + miss * g * 100000 ELSE 0 END + greatest(0, 0.18 - w) * 24 + greatest(0, 0.14 - h) * 24 + greatest(0, 0.62 - shape) * g * 20
 + CASE WHEN h > 0.42 AND w < 0.24 THEN (0.24 - w + h - 0.42) * g * 30 ELSE 0 END + CASE WHEN a >= 2.4 THEN greatest(0, 1.45 - shape) * g * 18 ELSE 0 END
 + CASE WHEN needs > 0 THEN CASE WHEN needs > has THEN 250000 + (needs - has) * g * 2500 ELSE 0 END + greatest(0, has / needs - 1.18) * g * 48 ELSE 0 END AS loss FROM y),
m AS (SELECT doc_id, 4 + doc_id % 4 AS n, unnest(range(1, (2 ** (4 + doc_id % 4))::INT - 1, 2))::INT AS mask FROM documents),
j AS (SELECT m.mask, c.*, c.is_left = ((m.mask >> 3) & 1 = 1) AS by_theory, c.is_left = ((m.mask >> 5) & 1 = 1) AS by_results, c.is_left = ((m.mask >> 6) & 1 = 1) AS by_last, (m.mask >> i) & 1 <> (m.mask >> (i + 1)) & 1 AND i < c.n - 1 AS turns FROM m JOIN c ON c.doc_id = m.doc_id AND c.is_left = ((m.mask >> i) & 1 = 1)),
q AS (SELECT doc_id, n, r, mask, sum(loss) + greatest(0, count(*) FILTER (turns) - 2) * 0.8 + abs(r - 0.5) * 2 AS loss, coalesce(sum(h) FILTER (is_left), 0) AS lh, coalesce(sum(h) FILTER (NOT is_left), 0) AS rh, coalesce(sum(h) FILTER (i < 3 AND by_theory), 0) AS theory, coalesce(sum(h) FILTER (i < 5 AND by_results), 0) AS results, coalesce(sum(h) FILTER (i < 6 AND by_last), 0) AS last, bool_and(w >= mw) AS fits FROM j GROUP BY doc_id, n, r, mask),
e AS (SELECT *, unnest([0.78, 0.9, 1, 1.1, 1.15, 1.25, 1.35, 1.45, 1.55, 1.65, 1.7, 1.72, 1.78, 1.84, 1.9])::DOUBLE AS aspect FROM q WHERE fits AND (n < 6 OR theory <= results + 0.002) AND (n < 7 OR last >= results - 0.002)),
f AS (SELECT *, loss + abs(lh - rh) * 24000 + (greatest(0, 1 / aspect - lh) + greatest(0, 1 / aspect - rh)) * 1000 AS total FROM e WHERE greatest(lh, rh) <= 1 / aspect + 0.002),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total + abs(ln(aspect / 1.55)) * 3, aspect, r, mask) = 1)
SELECT doc_id, round(least(2.1, greatest(aspect, 1 / greatest(lh, rh))), 6)::DOUBLE AS aspect, r AS ratio, mask, round(total, 3)::DOUBLE AS loss, round(lh, 6)::DOUBLE AS left_height, round(rh, 6)::DOUBLE AS right_height FROM b""")
def panel_columns(spark, d):
    """The best arrangement of each document's panels in two columns."""
    found = panels.two_columns(_papers(spark, d))
    tall = lambda left: F.round(F.aggregate(F.filter("panels", lambda p: (p["x"] == 0) == F.lit(left)), F.lit(0.0), lambda s, p: s + p["h"]), 6)
    return found.select("doc_id", F.round("aspect", 6).alias("aspect"), "ratio", "mask", F.round("loss", 3).alias("loss"), tall(True).alias("left_height"), tall(False).alias("right_height"))


_CLAMP = "least({2}, greatest({1}, {0}))".format
_FLOOR = "CASE WHEN drawn THEN " + _CLAMP("((greatest(120, {w} - 24) - 8 * (k - 1)) / k / a)", "CASE WHEN a < 1.15 THEN 180 ELSE 110 END", "CASE WHEN a < 1.15 THEN 520 ELSE 620 END") + " + 78 ELSE 0 END"


@query(f"""WITH x AS (SELECT doc_id, ['problem', 'motivation', 'method', 'theory', 'visuals', 'results', 'contribution'][doc_id % 7 + 1] AS id, [0.95, 0.9, 1.35, 1.15, 1.55, 1.2, 0.78][doc_id % 7 + 1]::DOUBLE AS base, [1.35, 1.35, 1.75, 1.05, 2.25, 1.05, 4.2][doc_id % 7 + 1]::DOUBLE AS usual,
 coalesce(n_chars, 0) AS chars, doc_id % 3 AS k, 1 + 0.5::DOUBLE * (doc_id % 5) AS a, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS svg, doc_id % 2 = 0 AND doc_id % 3 > 0 AS drawn, (doc_id % 5 = 0)::INT AS diagrams, doc_id % 4 AS formulas, CASE WHEN doc_id % 6 = 1 THEN 14 ELSE 0 END AS trows, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 0 END AS tfigs, (doc_id % 13 = 0) AS multi,
 doc_id % 9 = 0 AS none, (120 + 40 * (doc_id % 10))::DOUBLE AS t, [1.16, 0.82, 1][doc_id // 7 % 3 + 1]::DOUBLE AS factor FROM documents),
h AS (SELECT *, CASE WHEN none THEN 0 ELSE greatest(t / 2, {_FLOOR.format(w=560)}) END AS h2, CASE WHEN none THEN 0 ELSE greatest(t / 4, {_FLOOR.format(w=1120)}) END AS h3, k + svg AS media, tfigs + trows > 0 AS tab, k + svg > 0 OR formulas > 1 AS rich FROM x),
m AS (SELECT *, h3 * greatest(0.95, pow(1120 / 1560, 0.2)) AS h4, CASE WHEN h2 > 0 THEN {_CLAMP('560 / h2', 0.75, 6.8)} ELSE usual END AS seen, (CASE WHEN media > 0 THEN (k * a + svg * 2.4) / media ELSE usual END) * CASE WHEN media > 1 THEN 1.35 ELSE 1 END AS grouped FROM h),
s AS (SELECT *, CASE WHEN multi OR k > 1 THEN greatest(grouped, 1.35) ELSE grouped END AS shape, {_CLAMP('0.13 + chars / 6000', 0.13, 0.19)} AS content,
 {_CLAMP(f"(0.55 + {_CLAMP('chars / 260', 0.45, 2.8)} + k * 1.45 + svg * 0.9 + diagrams * 0.85 + k * 0.55 + formulas * 0.65 + tfigs * 1.15 + least(trows, 10) * 0.12 + CASE WHEN h2 > 0 THEN {_CLAMP('h2 / 210', 0.75, 3.8)} ELSE 1 END) * base * factor", 0.75, 9.5)} AS weight FROM m),
l AS (SELECT *, CASE WHEN h2 > 0 THEN {_CLAMP('(h2 + 18) / 1600', 0.085, 0.19)} ELSE content END AS low FROM s)
SELECT doc_id, id, round(CASE WHEN tab THEN {_CLAMP('weight * 1.22', 0.75, 9.5)} ELSE weight END, 6)::DOUBLE AS weight, round(CASE WHEN tab THEN {_CLAMP('(shape + 1.45) / 2', 1.45, 2.45)} ELSE {_CLAMP('CASE WHEN media > 0 THEN shape ELSE seen * 0.82 + usual * 0.18 END', 0.75, 6.8)} END, 6)::DOUBLE AS aspect,
 (CASE WHEN id = 'contribution' THEN 0.28 WHEN id = 'problem' THEN 0.26 WHEN tab THEN CASE WHEN tfigs > 1 THEN 0.46 ELSE 0.36 END WHEN drawn AND (k > 1 OR a < 2.2 OR svg > 0 AND 2.4 < 2.2) THEN 0.46 WHEN multi AND k > 1 THEN 0.42 WHEN k > 0 OR svg > 0 OR formulas > 0 THEN 0.4 ELSE 0.16 END)::DOUBLE AS min_width,
 round(CASE WHEN id IN ('problem', 'contribution') AND h4 > 0 THEN {_CLAMP('(h4 + 14) / 1600', 0.075, "CASE WHEN id = 'problem' THEN 0.16 ELSE 0.145 END")} WHEN tab THEN {_CLAMP('0.215 + least(trows, 12) * 0.004', 0.215, 0.255)} WHEN rich THEN greatest(0.2, content) WHEN diagrams > 0 AND h3 > 0 THEN {_CLAMP('(h3 + 18) / 1600', 0.095, 0.16)} ELSE low END, 6)::DOUBLE AS min_height FROM l""")
def panel_features(spark, d):
    """Weight, shape and least sizes of a panel a document, by what its id puts there."""
    i = F.col("doc_id")
    flag = lambda n: (i % n == 0).cast("int")
    images = F.array_repeat(1 + (i % 5) * 0.5, (i % 3).cast("int"))
    tall = 120 + 40 * (i % 10)
    sizes = F.array(*[F.struct(F.lit(float(w)).alias("width"), (tall * share).cast("double").alias("height")) for w, share in ((280, 1.0), (560, 0.5), (1120, 0.25))])
    columns = {
        "id": F.element_at(F.array(*[F.lit(n) for n in _IDS]), (i % 7 + 1).cast("int")), "priority": F.element_at(F.array(F.lit("high"), F.lit("supporting"), F.lit("")), (F.floor(i / 7) % 3 + 1).cast("int")), "text_chars": F.col("n_chars"),
        "image_aspects": images, "drawing_aspects": F.when(i % 4 == 0, F.array(F.lit(2.4))), "groups": F.when(i % 2 == 0, F.array(images)), "n_diagrams": flag(5), "n_figures": i % 3, "n_formulas": i % 4, "n_table_rows": F.when(i % 6 == 1, 14),
        "n_table_figures": flag(11) * 2, "n_table_images": flag(11), "n_multi": flag(13), "samples": F.when(i % 9 == 0, F.slice(sizes, 1, 0)).otherwise(sizes),
    }
    made = panels.panel_features(table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in columns.items()]))
    return made.select("doc_id", "id", F.round("weight", 6).alias("weight"), F.round("aspect", 6).alias("aspect"), F.col("min_width").cast("double").alias("min_width"), F.round("min_height", 6).alias("min_height"))

"""Queries of pages, crops and captions' places, around each benchmark item or event."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import geometry
from .base import query, table

#: Items of a page with a wrapped title, its authors and two columns: (seq, text, x, y, width, height), in which @ stands for the item's number.
_PAGE = (
    [(0, "A Long Study @ of", 100.0, 60.0, 300.0, 20.0), (1, "Sparse Attention", 100.0, 84.0, 300.0, 20.0), (2, "Ada B, Carl D, Eve F", 150.0, 112.0, 200.0, 17.5)]
    + [(3 + k, f"left {k}", 40.0, 200.0 + 20 * k, 200.0, 10.0) for k in range(4)]
    + [(7 + k, f"right {k}", 330.0, 200.0 + 20 * k, 200.0, 10.0) for k in range(4)]
)


def page_items(spark, d):
    """doc_id, page, seq, text, x, y, width, height of each benchmark item's page."""
    one = F.array(*[F.struct(F.lit(1).alias("page"), F.lit(s).alias("seq"), F.replace(F.lit(t), F.lit("@"), F.col("item_id").cast("string")).alias("text"), *[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), rest, strict=True)]) for s, t, *rest in _PAGE])
    return table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("doc_id"), F.explode(one).alias("i")).select("doc_id", "i.*")


_ORDER = ["'A Long Study ' || item_id || ' of'", "'Sparse Attention'", "'Ada B, Carl D, Eve F'", *[f"'{side} {k}'" for side in ("left", "right") for k in range(4)]]


@query(f"SELECT 'd' || item_id AS doc_id, 1 AS page, unnest(range(1, 12))::INT AS order_no, unnest([{', '.join(_ORDER)}]) AS text FROM benchmark")
def page_lines(spark, d):
    return geometry.reading_order(geometry.lines(page_items(spark, d))).select("doc_id", "page", F.col("order_no").cast("int").alias("order_no"), "text")


@query("SELECT 'd' || item_id AS doc_id, 'A Long Study ' || item_id || ' of|Sparse Attention' AS title_lines FROM benchmark")
def page_titles(spark, d):
    return geometry.title_lines(geometry.lines(page_items(spark, d))).select("doc_id", F.array_join("title_lines", "|").alias("title_lines"))


_BOX = "{{'left': ({i} % 7) / 10.0, 'top': ({i} % 5) / 10.0 - 0.1, 'right': ({i} % 7) / 10.0 + ({i} % 4) / 5.0, 'bottom': ({i} % 5) / 10.0 + ({i} % 9) / 10.0}}"


def _box(i):
    return F.struct(((i % 7) / 10.0).alias("left"), ((i % 5) / 10.0 - 0.1).alias("top"), ((i % 7) / 10.0 + (i % 4) / 5.0).alias("right"), ((i % 5) / 10.0 + (i % 9) / 10.0).alias("bottom"))


def _normal(box: str, fallback: str) -> str:
    side = lambda n: f"least(1.0, greatest(0.0, ({box}).{n}))"
    return f"CASE WHEN {side('right')} - {side('left')} < 0.02 OR {side('bottom')} - {side('top')} < 0.02 THEN {fallback} ELSE {{'left': {side('left')}::DOUBLE, 'top': {side('top')}::DOUBLE, 'right': {side('right')}::DOUBLE, 'bottom': {side('bottom')}::DOUBLE}} END"


_WHOLE = "{'left': 0.0::DOUBLE, 'top': 0.0::DOUBLE, 'right': 1.0::DOUBLE, 'bottom': 1.0::DOUBLE}"
_AREA = "(greatest(0, {b}.right - {b}.left) * greatest(0, {b}.bottom - {b}.top))"
_FITS = lambda s: f"n.right - n.left >= {s[0]} AND n.bottom - n.top >= {s[1]} AND (n.right - n.left) / greatest(n.bottom - n.top, 0.001) <= {s[2]}"


@query(f"""WITH e AS (SELECT event_id, event_id % 11 AS a, event_id // 3 AS b, CASE event_id % 3 WHEN 0 THEN 'formula' WHEN 1 THEN 'table' ELSE 'figure' END AS kind, event_id % 10 <> 0 AS found, event_id % 13 <> 0 AS complete, (event_id % 20) / 15.0::DOUBLE AS confidence, CASE WHEN event_id % 17 = 0 THEN ['left'] ELSE ['odd'] END AS clipped FROM events),
o AS (SELECT *, {_normal(_BOX.format(i="(event_id + 3)"), _WHOLE)} AS o FROM e), n AS (SELECT *, {_normal(_BOX.format(i="event_id"), "o")} AS n FROM o),
k AS (SELECT *, found AND complete AND NOT list_has_any(clipped, ['top', 'right', 'bottom', 'left']) AND least(1.0, confidence) >= 0.55 AND {_AREA.format(b="n")} >= 0.01 AND CASE kind WHEN 'formula' THEN {_FITS(geometry.SHAPES["formula"])} WHEN 'table' THEN {_FITS(geometry.SHAPES["table"])} ELSE {_FITS(geometry.SHAPES["figure"])} END
 AND greatest(0, least(n.right, o.right) - greatest(n.left, o.left)) * greatest(0, least(n.bottom, o.bottom) - greatest(n.top, o.top)) >= least({_AREA.format(b="n")}, {_AREA.format(b="o")}) * 0.18 AS ok FROM n)
SELECT event_id, ok AS applied, round(CASE WHEN ok THEN n.left ELSE o.left END, 6)::DOUBLE AS x0, round(CASE WHEN ok THEN n.bottom ELSE o.bottom END, 6)::DOUBLE AS y1, least(1.0, confidence)::DOUBLE AS confidence FROM k""")
def crop_inspections(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "formula").when(i % 3 == 1, "table").otherwise("figure")
    crop = geometry.accepted_crop(i % 10 != 0, i % 13 != 0, (i % 20) / 15.0, F.when(i % 17 == 0, F.array(F.lit("left"))).otherwise(F.array(F.lit("odd"))), _box(i), _box(i + 3), kind)
    return table(spark, d, "events").select("event_id", crop.alias("c")).select("event_id", "c.applied", F.round("c.box.left", 6).alias("x0"), F.round("c.box.bottom", 6).alias("y1"), "c.confidence")


@query("""WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (event_id % 40) / 40.0::DOUBLE AS c, ((event_id * 7) % 23)::DOUBLE AS a FROM events),
r AS (SELECT user_id, k, k AS attempt, c, a FROM t WHERE k = 1 UNION ALL SELECT r.user_id, t.k, CASE WHEN better THEN t.k ELSE r.attempt END, CASE WHEN better THEN t.c ELSE r.c END, CASE WHEN better THEN t.a ELSE r.a END FROM (SELECT r.*, x.c > r.c + 0.02 OR (abs(x.c - r.c) <= 0.02 AND x.a < r.a) AS better FROM r JOIN t x ON x.user_id = r.user_id AND x.k = r.k + 1) r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1)
SELECT user_id, arg_max(attempt, k)::INT AS attempt, arg_max(c, k) AS confidence, arg_max(a, k) AS area FROM r GROUP BY 1""")
def best_crops(spark, d):
    from pyspark.sql import Window

    i = F.col("event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("attempt"), ((i % 40) / 40.0).alias("confidence"), ((i * 7) % 23).cast("double").alias("area"))
    best = e.groupBy("user_id").agg(geometry.best_crop(F.collect_list(F.struct("attempt", "confidence", "area"))).alias("b"))
    return best.select("user_id", "b.attempt", "b.confidence", "b.area")


@query("SELECT event_id, greatest(0, least(3, 6 - 3 * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)))::INT AS tries FROM events")
def crop_quotas(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("ord"), "event_id")
    return geometry.crop_quota(e).select("event_id", F.col("tries").cast("int").alias("tries"))


_LINES = ["'Table 2: scores of ' || item_id", "'see Table 2: not a caption'", "'Table'", "' 2 '", "'. Results'", "'table 12: other'", "'Table'", "'3: no'"]


@query("SELECT item_id AS doc_id, unnest([1, 3]) AS line_no FROM benchmark")
def table_markers(spark, d):
    lines = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.array(*[F.expr(x) for x in _LINES])).alias("k", "text"), "item_id").select("doc_id", "page", (F.col("k") + 1).alias("line_no"), "text")
    return geometry.table_markers(lines, F.lit(2)).select("doc_id", "line_no")


@query("SELECT doc_id, idx, coalesce(crop_url, 'up.pdf') AS crop_url, CASE WHEN crop_url IS NULL THEN '' ELSE 'up.pdf' END AS fallback_url, coalesce(TRY_CAST(nullif(regexp_extract(name, '(?i)Table\\s*(\\d+)', 1), '') AS INT), idx + 1)::INT AS table_number FROM (SELECT doc_id, (doc_id % 4)::INT AS idx, CASE WHEN doc_id % 3 = 0 THEN 'table ' || doc_id ELSE 'Results' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id END AS crop_url FROM documents)")
def attached_crops(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", (i % 4).cast("int").alias("idx"), F.when(i % 3 == 0, F.concat(F.lit("table "), i)).otherwise("Results").alias("name"), F.when(i % 2 == 0, F.concat(F.lit("c"), i)).alias("crop_url"))
    return geometry.with_crops(t, F.lit("up.pdf")).select("doc_id", "idx", "crop_url", "fallback_url", "table_number")


@query("SELECT event_id, CASE WHEN w / h < 1.15 THEN 'portrait' WHEN w / h < 3.6 THEN 'landscape' ELSE 'ultrawide' END AS shape, regexp_matches(u, '(?i)^(?:https?://|/api/)') AS safe FROM (SELECT event_id, (1 + event_id % 50)::DOUBLE AS w, (1 + event_id % 9)::DOUBLE AS h, CASE event_id % 4 WHEN 0 THEN 'https://a' WHEN 1 THEN '/api/x' WHEN 2 THEN 'javascript:x' ELSE 'HTTP://b' END AS u FROM events)")
def image_shapes(spark, d):
    i = F.col("event_id")
    url = F.when(i % 4 == 0, "https://a").when(i % 4 == 1, "/api/x").when(i % 4 == 2, "javascript:x").otherwise("HTTP://b")
    return table(spark, d, "events").select("event_id", P.image_shape((1 + i % 50).cast("double"), (1 + i % 9).cast("double")).alias("shape"), P.safe_url(url).alias("safe"))


#: Lines of a page by doc_id % 7 (text, x, y, width, height; @ stands for the document's number), and the formulas there: line, text, number, confidence, x, y, width, height.
_FORMULA_PAGES = [
    [("x@ = y + z", 80, 120, 100, 10), ("w_i = exp(s_i) / sum_j exp(s_j) + @ (4)", 80, 160, 210, 10)],
    [("We treat the retrieved document @ as a latent variable and marginalize it to define the probability.", 42, 120, 245, 10), ("p_RAG(y|x) ≈ sum_z p_@(z|x) p_theta(y|x,z)", 65, 152, 220, 11), ("The generator then produces the complete sequence.", 42, 181, 235, 10)],
    [("w_i = exp(s_i) / sum_j exp(s_@)", 55, 160, 195, 10), ("(4)", 270, 160, 16, 10)],
    [("The transmittance T(t) = O + td is formulated as a sigmoid function while the grids @ use three planes", 42, 210, 510, 10), ("Figure 2 = (a) + (b) (1)", 42, 240, 200, 10)],
    [("E = a^2 + b_@", 100, 300, 120, 12), ("+ c^2 - d", 110, 318, 90, 12), ("[12a]", 390, 318, 25, 12), ("other column = x + y", 330, 600, 90, 10)],
    [("Formally, the objective of @ is", 42, 400, 240, 10), ("L = sum log p(x)", 60, 420, 150, 10), ("+ lambda R(x)", 70, 434, 120, 10), ("7", 75, 446, 6, 8), ("where x is a sample of the data @.", 42, 470, 240, 10)],
    [],
]
_FORMULAS = [
    [(1, "w_i = exp(s_i) / sum_j exp(s_j) + @ (4)", "4", "numbered-equation", 80, 160, 210, 10)],
    [(1, "p_RAG(y|x) ≈ sum_z p_@(z|x) p_theta(y|x,z)", "", "core-unnumbered-equation", 65, 152, 220, 11)],
    [(1, "w_i = exp(s_i) / sum_j exp(s_@) (4)", "4", "numbered-equation", 55, 160, 231, 10)],
    [],
    [(2, "E = a^2 + b_@ + c^2 - d [12a]", "12a", "numbered-equation", 100, 300, 315, 30)],
    [(1, "L = sum log p(x) + lambda R(x) 7", "", "core-unnumbered-equation", 60, 420, 150, 34)],
    [],
]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS line_no, replace('{t}', '@', doc_id::VARCHAR) AS text, '{e}' AS equation_number, '{c}' AS confidence, {x}::DOUBLE AS x, {y}::DOUBLE AS y, {w}::DOUBLE AS width, {h}::DOUBLE AS height FROM documents WHERE doc_id % 7 = {k}"
    for k, page in enumerate(_FORMULAS) for n, t, e, c, x, y, w, h in page
)


@query(_FOUND)
def formula_candidates(spark, d):
    """Numbered and core formulas of a page a document, merged from their parts."""
    line = lambda t, *box: F.struct(F.replace(F.lit(t), F.lit("@"), F.col("doc_id").cast("string")).alias("text"), *[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "width", "height"), box, strict=True)])
    kind = "array<struct<text:string,x:double,y:double,width:double,height:double>>"
    page = F.element_at(F.array(*[F.array(*[line(*x) for x in lines]).cast(kind) for lines in _FORMULA_PAGES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return geometry.formula_candidates(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), page.alias("lines"))).drop("page")


def _page_lines(pages: list, shift=None):
    """Lines of the page that doc_id chooses; @ stands for the document's number, and all may stand lower by a shift."""
    moved = lambda n, v: F.lit(float(v)) + (shift if shift is not None and n == "y" else F.lit(0.0))
    line = lambda t, *box: F.struct(F.replace(F.lit(t), F.lit("@"), F.col("doc_id").cast("string")).alias("text"), *[moved(n, v).alias(n) for n, v in zip(("x", "y", "width", "height"), box, strict=True)])
    kind = "array<struct<text:string,x:double,y:double,width:double,height:double>>"
    return F.element_at(F.array(*[F.array(*[line(*x) for x in lines]).cast(kind) for lines in pages]), (F.col("doc_id") % len(pages) + 1).cast("int"))


_BOXES = " UNION ALL ".join(f"SELECT doc_id, {k} AS page, {n} AS line_no, replace('{t}', '@', doc_id::VARCHAR) AS text, {x}::DOUBLE AS x, {y}::DOUBLE AS y, {w}::DOUBLE AS w, {h}::DOUBLE AS h FROM documents WHERE doc_id % 7 = {k}" for k, page in enumerate(_FORMULA_PAGES) for n, (t, x, y, w, h) in enumerate(page))


@query(f"""WITH f AS ({_FOUND}), l AS ({_BOXES}),
b AS (SELECT *, x < 612 * 0.46 AND x + width > 612 * 0.54 OR width >= 612 * 0.62 AS wide, x + width / 2 < 306 AS at_left, greatest(7, height * 0.65) AS side, greatest(4, least(7, height * 0.24)) AS around FROM f),
s AS (SELECT *, CASE WHEN wide OR at_left THEN 612 * 0.045 ELSE 306 + 612 * 0.025 END AS lo, CASE WHEN wide OR NOT at_left THEN 612 * 0.955 ELSE 306 - 612 * 0.025 END AS hi FROM b),
n AS (SELECT s.doc_id, s.line_no, arg_min(l.y - l.h, l.y) AS stop FROM s JOIN l ON l.doc_id = s.doc_id AND l.y > s.y + s.height + 1 AND l.x + l.w / 2 BETWEEN s.lo AND s.hi GROUP BY ALL)
SELECT doc_id, line_no, equation_number, round(greatest(lo, x - side), 6)::DOUBLE AS x, round(greatest(792 * 0.025, y - around), 6)::DOUBLE AS y, round(least(hi - greatest(lo, x - side), x + width - greatest(lo, x - side) + side), 6)::DOUBLE AS width,
 round(greatest(height + around, least(y + height + around, coalesce(stop - 3, y + height + around)) - greatest(792 * 0.025, y - around)), 6)::DOUBLE AS height FROM s LEFT JOIN n USING (doc_id, line_no)""")
def formula_regions(spark, d):
    """The padded boxes of formula_candidates."""
    found = geometry.formula_regions(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), _page_lines(_FORMULA_PAGES).alias("lines")))
    return found.select("doc_id", "line_no", "equation_number", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


#: Pages by doc_id % 6, all lower by doc_id % 32; and the regions there: line, kind, number, caption, x, y, width, height, whether recovered.
_CAPTION_PAGES = [
    [("Figure 1: Overall system of @", 105, 430, 402, 10), ("architecture across both columns.", 120, 443, 300, 10), ("body text of the left column here.", 42, 456, 250, 10)],
    [("we keep the parameters of the model fixed while we train the adapters.", 42, 200, 245, 10), ("x", 330, 210, 20, 10), ("Figure 2: Left part of @.", 42, 500, 200, 10), ("Fig. 3 - Right part.", 330, 500, 200, 10)],
    [("Table 1: Scores of @.", 42, 150, 240, 10), ("Model A", 42, 172, 60, 10), ("91.2", 150, 172, 20, 10), ("Model B", 42, 186, 60, 10), ("88.1", 150, 186, 20, 10), ("Figure 4: Below the table.", 42, 420, 220, 10)],
    [("Method", 60, 300, 40, 10), ("Accuracy", 300, 300, 50, 10), ("Model A", 60, 314, 40, 10), ("91.2", 300, 314, 30, 10), ("Model @", 60, 328, 40, 10), ("84.0", 300, 328, 30, 10), ("Table 7: Scores of all, e.g.", 42, 350, 240, 10), ("those of both columns go on", 42, 363, 240, 10)],
    [("Table 5: there is none", 42, 300, 240, 10), ("the text goes on in long sentences of prose without any table here.", 42, 330, 245, 10)],
    [("running head of the paper", 42, 0, 200, 10), ("def f(x): return x and then we go on with many words here too.", 330, 300, 240, 10), ("Figure 6a: Code of @", 330, 480, 200, 10), ("that is hyphen-", 330, 493, 200, 10), ("ated here", 330, 506, 200, 10)],
]
_REGIONS = [
    [(0, "figure", "1", "Overall system of @ architecture across both columns.", 21.42, 113.04, 569.16, 300.96, False)],
    [(2, "figure", "2", "Left part of @.", 27.54, 217.0, 263.16, 267.0, False), (3, "figure", "3", "Right part.", 321.3, 183.04, 263.16, 300.96, False)],
    [(0, "table", "1", "Scores of @.", 34.656, 102.4, 142.688, 99.6, True), (5, "figure", "4", "Below the table.", 27.54, 209.0, 263.16, 195.0, False)],
    [(6, "table", "7", "Scores of all, e.g. those of both columns go on", 15.3, 210.8, 581.4, 133.2, True)],
    [],
    [(2, "figure", "6a", "Code of @ that is hyphenated here", 321.3, 163.04, 263.16, 300.96, False)],
]
_AT = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS line_no, '{kind}' AS kind, '{number}' AS number, replace('{t}', '@', doc_id::VARCHAR) AS caption, {x}::DOUBLE AS x, round({y} + doc_id % 32, 6)::DOUBLE AS y, {w}::DOUBLE AS width, {h}::DOUBLE AS height, {r} AS recovered FROM documents WHERE doc_id % 6 = {k}"
    for k, page in enumerate(_REGIONS) for n, kind, number, t, x, y, w, h, r in page
)


@query(_AT)
def caption_regions(spark, d):
    """What the captions of a page a document stand for."""
    shift = (F.col("doc_id") % 32).cast("double")
    found = geometry.caption_regions(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), _page_lines(_CAPTION_PAGES, shift).alias("lines")))
    return found.select("doc_id", "line_no", "kind", "number", "caption", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")], "recovered")

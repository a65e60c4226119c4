"""Positioned text: lines, reading order, tables, titles and regions of pages.

The engine starts from a table of text items (doc_id, page, seq, text, x, y, width, height), y growing
downwards. Whatever is gathered is one page, or the lines of one first page, never a document; all is
built-in expressions. Lines are (doc_id, page, line_no, text, x, y, width, height, n_items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, once
from ..functions.text import arxiv_id, collapse, doi, text_of

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0

# What marks a line as no title, a title as unusable, and a region as telling.
NO_TITLE = r"(?i)^(?:arxiv|doi|published|proceedings|conference|journal)\b|@|\b(?:university|institute|laboratory|department)\b"
AFFILIATION = r"(?i)@|\b(?:university|institute|laboratory|department|school of|college|correspondence|equal contribution)\b"
TEMPLATE_TITLE = r"(?i)\b(?:formatting instructions?|conference submissions?|submission template|sample paper|author guidelines?)\b"
UNUSABLE_TITLE = r"(?i)^(?:untitled|microsoft word|document|arxiv(?::|\s))"
TELLING = r"(?i)\b(?:result|performance|evaluation|comparison|ablation|distribution|frequency|proportion|prevalence|mitigation|before[- ]and[- ]after|accuracy|pass@\d+|taxonomy|architecture|framework|pipeline|overview)\b"
MATH_WORDS = "alpha|gamma|delta|epsilon|lambda|sigma|theta|omega|softmax|sigmoid|attention|projection|embedding|feature"
NUMBER_CELL = r"^[+\-]?(?:\d+(?:\.\d+)?|\.\d+)%?(?:\s*[†‡*])?$"
GROUP_LABEL = r"(?i)\b(?:LLMs?|models?|methods?|approaches?|agents?|datasets?|backbones?|zero[- ]shot|optimi[sz]ation)\b"


def clustered(items: DataFrame) -> DataFrame:
    """Items with `row_no`, the text row of their page.

    Read from the top, an item joins the first row whose top is within its tolerance, or opens one. Rows
    open in the order of their tops, so that the row is the number of rows too far above.
    """
    placed = F.struct("y", "x", "seq", F.trim("text").alias("text"), F.greatest("width", F.lit(1.0)).alias("width"), F.greatest("height", F.lit(5.0)).alias("height"))
    pages = items.filter(F.trim(text_of(F.col("text"))) != "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(placed)).alias("all"))
    start = F.expr("named_struct('tops', cast(array() as array<double>), 'at', cast(array() as array<int>))")

    def step(a: Column, i: Column) -> Column:
        above = F.size(F.filter(a["tops"], lambda t: t < i["y"] - F.greatest(F.lit(3.0), i["height"] * 0.45)))
        tops = F.when(above == F.size(a["tops"]), F.array_append(a["tops"], i["y"])).otherwise(a["tops"])
        return F.struct(tops.alias("tops"), F.array_append(a["at"], above).alias("at"))

    rows = pages.withColumn("at", F.aggregate("all", start, step)["at"])
    return rows.select("doc_id", "page", F.inline(F.arrays_zip("at", F.col("all").alias("i")))).select("doc_id", "page", F.col("at").alias("row_no"), "i.*")


def lines(items: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """The lines of each page: text rows cut at wide gaps and at the gutter of two columns."""
    row = Window.partitionBy("doc_id", "page", "row_no").orderBy("x", "seq")
    right = F.lag(F.col("x") + F.col("width")).over(row)
    gap = F.col("x") - right
    half, slack = page_width / 2, page_width * 0.004
    cut = (gap > max(16.0, page_width * 0.028)) | ((right < half - slack) & (F.col("x") > half + slack))
    scale = F.greatest(F.lit(5.0), F.col("height"), F.lag("height").over(row))
    glue = F.when(gap > F.greatest(F.lit(1.2), scale * 0.16), " ").otherwise("")
    marked = clustered(items).select("*", F.coalesce(cut, F.lit(True)).cast("int").alias("cut"), F.coalesce(glue, F.lit("")).alias("glue"))
    parts = marked.withColumn("part", F.sum("cut").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "glue", "text"))), lambda i: F.concat(i["glue"], i["text"])), "")
    made = parts.groupBy("doc_id", "page", "row_no", "part").agg(
        collapse(text).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.max("height").alias("height"), F.count("*").alias("n_items")
    )
    return made.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row_no", "part"))).drop("row_no", "part")


def reading_order(page_lines: DataFrame, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """Lines with `order_no`: on pages of two columns first what spans both at the top, then left, right, and the rest."""
    page = Window.partitionBy("doc_id", "page")
    end = F.col("x") + F.col("width")
    spans = (F.col("width") >= page_width * 0.58) | ((F.col("x") < page_width * 0.34) & (end > page_width * 0.66))
    side = F.when(spans, "both").when(F.col("x") + F.col("width") / 2 < page_width / 2, "left").otherwise("right")
    told = page_lines.withColumn("side", side)
    n = lambda s: F.sum((F.col("side") == s).cast("int")).over(page)
    first = F.min(F.when(F.col("side") != "both", F.col("y"))).over(page)
    bucket = F.when((n("left") < 4) | (n("right") < 4), 0).when(F.col("side") == "left", 1).when(F.col("side") == "right", 2).when(F.col("y") <= first + page_height * 0.035, 0).otherwise(3)
    told = told.withColumn("bucket", bucket)
    return told.withColumn("order_no", F.row_number().over(page.orderBy("bucket", "y", "x", "line_no"))).drop("bucket", "side")


def column_bounds(x: Column, width: Column, page_width: float = PAGE_WIDTH) -> Column:
    """left and right of the column that a line stands in."""
    margin, gutter = page_width * 0.045, page_width * 0.025
    bounds = lambda a, b: F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"))
    return F.when(width >= page_width * 0.62, bounds(margin, page_width - margin)).when(x + width / 2 < page_width / 2, bounds(margin, page_width / 2 - gutter)).otherwise(bounds(page_width / 2 + gutter, page_width - margin))


def is_formula_line(text: Column, width: Column, numbered: bool = True, page_width: float = PAGE_WIDTH) -> Column:
    """Whether a line is a display formula: marks of mathematics, few words of prose, and a number where one is asked for."""
    x = F.trim(text_of(text))
    prose = F.regexp_count(x, F.lit("[A-Za-z]{5,}")) - F.regexp_count(x, F.lit(f"(?i)(?<![A-Za-z])(?:{MATH_WORDS})(?![A-Za-z])"))
    good = F.length(x).between(5, 240) & x.rlike("[=≈≃≤≥∑∏√∂∇]") & (width <= page_width * 0.94) & (F.regexp_count(x, F.lit(r"[=+\-*/^_(){}\[\]∑∏√∂∇≤≥]")) >= 2) & (prose <= 4)
    fragment = x.rlike(r"(?i)^[a-z]{3,}\s") & ~x.rlike(r"(?i)^(?:arg|min|max|log|exp|softmax|sigmoid|relu)\b")
    good = good & ~fragment & ~x.rlike(r"(?i)[.!?]\s*(?:\(\d+[a-z]?\))?$") & ~x.rlike("(?i)https?:|copyright|figure|table")
    return good & x.rlike(r"(?i)[(\[]\d+[a-z]?[)\]]\s*$") if numbered else good


# ------------------------------------------------------------------ formulas

# Signs that make a line an equation, marks that make it a part of one, its number, and words that introduce a definition.
EQUALS = "[=≈≃≤≥∑∏√∂∇]"
PART_OF_EQUATION = r"[=+\-*/^_(){}\[\]∑∏√∂∇≤≥]"
EQUATION_NUMBER = r"(?i)[(\[](\d+[a-z]?)[)\]]\s*$"
CORE_SIGN, CORE_SHAPE = "[=≈≃∝≤≥]", r"(?i)[()|∑∏]|\b(?:log|exp|arg|min|max|softmax)\b"
CORE_PART = r"[=≈≃∝+\-*/^_(){}\[\]|∑∏√∂∇≤≥]"
FORMAL_CUE = r"(?i)\b(?:formally|we define|concretely|marginali[sz]|probability|likelihood|objective|distribution|latent variable|transition probability)\b"


def _right(line: Column) -> Column:
    return line["x"] + line["width"]


def _center(line: Column) -> Column:
    return line["x"] + line["width"] / 2


def _words(line: Column, least: int) -> Column:
    return F.regexp_count(line["text"], F.lit(f"[A-Za-z]{{{least},}}"))


def _joined(lines: Column) -> Column:
    return collapse(F.array_join(F.transform(lines, lambda l: l["text"]), " "))


def _by(lines: Column, *keys) -> Column:
    """Lines in the order of some keys; equal ones stay as they are."""
    keyed = F.array_sort(F.transform(lines, lambda l, i: F.struct(*[k(l).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), l.alias("l"))))
    return F.transform(keyed, lambda x: x["l"])


def _candidate(text: Column, chosen: Column, number: Column, confidence: str, numbered: bool, page_width: float) -> Column:
    """The box around some lines with their text, if that is a formula; else null."""
    edge = lambda f, of: f(F.transform(chosen, of))
    box = F.struct(edge(F.array_min, lambda l: l["x"]).alias("x"), edge(F.array_min, lambda l: l["y"]).alias("y"), edge(F.array_max, _right).alias("right"), edge(F.array_max, lambda l: l["y"] + l["height"]).alias("bottom"))

    def made(b: Column) -> Column:
        width = b["right"] - b["x"]
        out = F.struct(text.alias("text"), number.alias("equation_number"), F.lit(confidence).alias("confidence"), b["x"].alias("x"), b["y"].alias("y"), width.alias("width"), (b["bottom"] - b["y"]).alias("height"))
        return F.when(is_formula_line(text, width, numbered, page_width), out)

    return bound(box, made)


def _numbered(lines: Column, m: Column, page_width: float) -> Column:
    """The equation that a line with a number at its end closes: its own row, else the equation before it, and the parts around both."""
    far = lambda l, least, factor: F.abs(l["y"] - m["y"]) <= F.greatest(F.lit(least), m["height"] * factor)
    over_gutter = lambda l: (m["x"] > page_width * 0.8) & (l["x"] < page_width * 0.5) & (_right(l) > page_width * 0.42)
    beside = lambda l: (l["no"] != m["no"]) & ((m["width"] >= page_width * 0.58) | (F.abs(_center(l) - _center(m)) < page_width * 0.42) | over_gutter(l))
    row = _by(F.concat(F.array(m), F.filter(lines, lambda l: beside(l) & (l["x"] < m["x"]) & far(l, 5.0, 0.8))), lambda l: l["x"])

    def with_previous(row: Column) -> Column:
        before = F.filter(lines, lambda l: beside(l) & (l["y"] < m["y"]) & (m["y"] - l["y"] <= F.greatest(F.lit(30.0), m["height"] * 3)) & l["text"].rlike(EQUALS))
        return F.when(_joined(row).rlike(EQUALS) | (F.size(before) == 0), row).otherwise(F.concat(F.slice(before, -1, 1), F.array(m)))

    def with_parts(chosen: Column) -> Column:
        left, right = F.array_min(F.transform(chosen, lambda l: l["x"])), F.array_max(F.transform(chosen, _right))

        def is_part(l: Column) -> Column:
            marked = l["text"].rlike(PART_OF_EQUATION) | (l["text"].rlike(r"\d") & (F.length(l["text"]) <= 36))
            near = (l["x"] < m["x"]) & (_right(l) >= left - 24) & (l["x"] <= right + 24)
            return beside(l) & ~F.exists(chosen, lambda c: c["no"] == l["no"]) & far(l, 28.0, 2.8) & marked & near & (_words(l, 4) <= 4) & ~l["text"].rlike(r"[.!?]$")

        grown = F.concat(chosen, F.filter(lines, is_part))
        in_order = lambda g: F.concat(_by(F.filter(g, lambda l: l["no"] != m["no"]), lambda l: l["y"], lambda l: l["x"]), F.array(m))
        return F.when(_joined(chosen).rlike(EQUALS), bound(grown, in_order)).otherwise(chosen)

    number = F.regexp_extract(m["text"], EQUATION_NUMBER, 1)
    chosen = bound(bound(row, with_previous), with_parts)
    return F.when(number != "", bound(chosen, lambda c: _candidate(_joined(c), c, number, "numbered-equation", True, page_width)))


def _core(lines: Column, a: Column, page_width: float) -> Column:
    """An equation without a number that the lines before it introduce formally, with the parts that follow it in its column."""
    wanted = (a["text"] != "") & ~a["text"].rlike(EQUATION_NUMBER) & a["text"].rlike(CORE_SIGN) & a["text"].rlike(CORE_SHAPE)

    def in_column(b: Column) -> Column:
        inside = lambda l: _center(l).between(b["left"], b["right"])
        before = F.filter(lines, lambda l: (l["y"] < a["y"]) & (a["y"] - (l["y"] + l["height"]) <= 88) & inside(l))
        cue = _joined(F.slice(_by(before, lambda l: -l["y"]), 1, 4)).rlike(FORMAL_CUE)
        after = _by(F.filter(lines, lambda l: l["y"] > a["y"]), lambda l: l["y"], lambda l: l["x"])
        start = F.struct((a["y"] + a["height"]).alias("bottom"), F.lit(False).alias("over"), F.array(a).alias("chosen"))

        def step(s: Column, l: Column) -> Column:
            part = (l["text"].rlike(CORE_PART) | l["text"].rlike(r"^\d{1,3}$")) & (_words(l, 4) <= 5) & ~l["text"].rlike(r"[.!?]$")
            stopped = F.struct(s["bottom"].alias("bottom"), F.lit(True).alias("over"), s["chosen"].alias("chosen"))
            grown = F.struct(F.greatest(s["bottom"], l["y"] + l["height"]).alias("bottom"), F.lit(False).alias("over"), F.array_append(s["chosen"], l).alias("chosen"))
            far = l["y"] - s["bottom"] > F.greatest(F.lit(20.0), a["height"] * 2.2)
            return F.when(s["over"] | far, stopped).when(~inside(l), s).when(part, grown).otherwise(stopped)

        return F.when(cue, bound(F.aggregate(after, start, step)["chosen"], lambda c: _candidate(_joined(c), c, F.lit(""), "core-unnumbered-equation", False, page_width)))

    return F.when(wanted, bound(column_bounds(a["x"], a["width"], page_width), in_column))


def formula_candidates(pages: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """The display formulas of pages (doc_id, page, lines array<struct<text, x, y, width, height>>), from the lines that number or begin them.

    doc_id, page, line_no, text, equation_number, confidence, x, y, width, height. All within a page's row.
    """
    return _found_formulas(pages, page_width).select("doc_id", "page", F.explode("found").alias("f")).select("doc_id", "page", "f.line_no", "f.c.*")


def _found_formulas(pages: DataFrame, page_width: float) -> DataFrame:
    clean = F.transform("lines", lambda l, i: F.struct(i.alias("no"), collapse(l["text"]).alias("text"), *[l[n].cast("double").alias(n) for n in ("x", "y", "width", "height")]))
    rows = once(pages.select("doc_id", "page", "lines"), "l", clean)
    of = lambda m: F.struct(m["no"].alias("line_no"), F.coalesce(_numbered(F.col("l"), m, page_width), _core(F.col("l"), m, page_width)).alias("c"))
    return once(rows, "found", F.filter(F.transform("l", of), lambda x: x["c"].isNotNull()))


def formula_regions(pages: DataFrame, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """The candidates of formula_candidates with the padded box to show of each: within its column, or the page where it crosses the gutter, and above the next line there."""

    def padded(lines: Column, f: Column) -> Column:
        right = f["x"] + f["width"]
        crosses = (f["x"] < page_width * 0.46) & (right > page_width * 0.54)
        whole = F.struct(F.lit(page_width * 0.045).alias("left"), F.lit(page_width * 0.955).alias("right"))

        def within(b: Column) -> Column:
            side, around = F.greatest(F.lit(7.0), f["height"] * 0.65), F.greatest(F.lit(4.0), F.least(F.lit(7.0), f["height"] * 0.24))
            below = F.filter(lines, lambda l: (l["y"] > f["y"] + f["height"] + 1) & _center(l).between(b["left"], b["right"]))
            after = F.get(_by(below, lambda l: l["y"]), F.lit(0))
            top, natural = F.greatest(F.lit(page_height * 0.025), f["y"] - around), f["y"] + f["height"] + around
            bottom = F.least(natural, F.coalesce(after["y"] - after["height"] - 3, natural))
            x = F.greatest(b["left"], f["x"] - side)
            return F.struct(x.alias("x"), top.alias("y"), F.least(b["right"] - x, right - x + side).alias("width"), F.greatest(f["height"] + around, bottom - top).alias("height"))

        return bound(F.when(crosses, whole).otherwise(column_bounds(f["x"], f["width"], page_width)), within)

    rows = _found_formulas(pages, page_width).select("doc_id", "page", "l", F.explode("found").alias("f"))
    return rows.select("doc_id", "page", "f.line_no", "f.c.text", "f.c.equation_number", "f.c.confidence", padded(F.col("l"), F.col("f.c")).alias("r")).select("*", "r.*").drop("r")


# ------------------------------------------------------------------ tables


def table_rows(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, page, row_no, y, height, n_lines, text, cells) with `is_data`, `is_header` and `is_label`.

    cells: array<struct<text, x, width>> from left to right.
    """
    marks = _table_marks(F.filter("cells", lambda c: F.trim(c["text"]) != ""), text_of(F.col("text")), F.col("height"), F.col("n_lines"))
    return rows.select("*", *[c.alias(f"is_{n}") for n, c in marks.items()])


def _table_marks(cells: Column, text: Column, height: Column, n_lines: Column) -> dict[str, Column]:
    """Whether a row of cells from left to right is a table's data, header or label of a group."""
    n, numeric = F.size(cells), F.size(F.filter(cells, lambda c: F.trim(c["text"]).rlike(NUMBER_CELL)))
    compact = F.size(F.filter(cells, lambda c: F.length(F.trim(c["text"])) <= 34)) / F.greatest(n, F.lit(1))
    ends = F.transform(cells, lambda c: c["x"] + c["width"])
    wide = F.exists(F.arrays_zip(F.slice(F.transform(cells, lambda c: c["x"]), 2, 10_000).alias("x"), F.slice(ends, 1, F.greatest(n - 1, F.lit(0))).alias("e")), lambda p: p["x"] - p["e"] > F.greatest(F.lit(9.0), height * 0.9))
    apart = (n_lines >= 2) | F.coalesce(wide, F.lit(False))
    values = F.regexp_count(text, F.lit(r"(?:^|\s)[+\-]?(?:\d+(?:\.\d+)?|\.\d+)%?(?=\s|$)"))
    section = text.rlike(r"^\d+(?:\.\d+)+\.?\s+[A-Za-z]")
    prose = ~apart & (F.regexp_count(text, F.lit("[A-Za-z]{3,}")) >= 7) & (text.rlike(r"[.!?)]$") | (F.length(text) >= 72))
    data = ~section & ~prose & ((numeric >= 2) | (values >= 2) | ((numeric >= 1) & apart & (compact >= 0.5)) | ((values >= 1) & apart & (F.length(text) < 100)))
    header = ~section & apart & (n >= 2) & (compact >= 0.65) & (F.length(text) < 120) & ~text.rlike("[.!?]$")
    label = ~section & ~prose & ~data & ~header & (F.length(text) <= 72) & (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) <= 9) & text.rlike(GROUP_LABEL)
    return {"data": data, "header": header, "label": label}


def table_blocks(rows: DataFrame, captions: DataFrame, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """doc_id, page, number, direction, top, bottom, n_rows of the table next to each caption (doc_id, page, number, y, bottom).

    Runs of table rows without a wide gap are islands; of those above the caption the lowest, of those
    below the highest, if it has a data row and another row, or three headers.
    """
    kept = table_rows(rows).filter("is_data or is_header or is_label")
    c = captions.select("doc_id", "page", "number", F.col("y").alias("c_top"), F.col("bottom").alias("c_bottom"))
    before = F.col("y").between(F.greatest(F.lit(0.0), F.col("c_top") - page_height * 0.32), F.col("c_top") - 2)
    after = F.col("y").between(F.col("c_bottom"), F.least(F.lit(page_height), F.col("c_bottom") + page_height * 0.28))
    near = kept.join(c, ["doc_id", "page"]).withColumn("direction", F.when(before, "before").when(after, "after")).filter("direction is not null")
    order = Window.partitionBy("doc_id", "page", "number", "direction").orderBy("y", "row_no")
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(order)
    new = F.coalesce(gap > F.greatest(F.lit(18.0), F.col("height") * 1.9), F.lit(True)).cast("int")
    runs = near.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = runs.groupBy("doc_id", "page", "number", "direction", "run").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.max("y").alias("last"), F.count("*").alias("n_rows"), F.count_if("is_data").alias("n_data"), F.count_if("is_header").alias("n_header"))
    good = made.filter("(n_data >= 1 and n_rows >= 2) or n_header >= 3")
    best = Window.partitionBy("doc_id", "page", "number", "direction").orderBy(F.when(F.col("direction") == "before", -F.col("last")).otherwise(F.col("top")))
    return good.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("doc_id", "page", "number", "direction", "top", "bottom", "n_rows")


# ------------------------------------------------------------------ captions

# How captions begin, where they can't go on, what ends them, and what shows that a line is code drawn in a figure.
FIGURE_CAPTION = r"(?i)^(?:figure|fig\.)\s*(\d+[a-z]?)\s*[:.\-]\s*(.*)"
TABLE_CAPTION = r"(?i)^table\s*(\d+[a-z]?)\s*[:.\-]\s*(.*)"
SECTION_START, NUMBER_AT_END = r"^\d+(?:\.\d+)*\.?\s+[A-Z]", r"(?i)[(\[]\d+[a-z]?[)\]]\s*$"
OPEN_ABBREVIATION = r"(?i)\b(?:w\.r\.t|e\.g|i\.e)\.$"
CODE_HINT = r"(?i)(?:>>>|\bdef\s+|\breturn\b|\bfor\s+\w+\s+in\b|\bimport\b|assert\s+|==|\[[^\]]*\]|\w+\([^)]*\)\s*(?:->|:))"
CODE_LINE = r"(?i)(?:>>>|\bdef\s+|\breturn\b|\bfor\s+\w+\s+in\b|assert\s+)"
# Shares of a page's height that a figure takes at most above its caption (usual, low and across the page) and at least (usual, across).
FIGURE_SPAN, LOW_FIGURE_SPAN, FIGURE_FLOOR, WIDE_FIGURE_FLOOR = 0.38, 0.62, 0.15, 0.22


def _is_caption(text: Column) -> Column:
    return text.rlike(FIGURE_CAPTION) | text.rlike(TABLE_CAPTION)


def _span(left, right) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(left).alias("left"), as_column(right).alias("right"))


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def _across(line: Column, page_width: float) -> Column:
    """Whether a caption stands in the middle of the page, across both columns."""
    return (line["width"] >= page_width * 0.3) & (F.abs(_center(line) - page_width / 2) <= page_width * 0.12)


def _with_rows(pages: DataFrame) -> DataFrame:
    """Pages with `l`, their lines, and `r`, the rows of lines on one height with what marks them as a table's."""
    items = "items" in pages.schema["lines"].dataType.elementType.fieldNames()
    nothing = F.array().cast("array<struct<text:string,x:double,width:double>>")

    def line(l: Column, i: Column) -> Column:
        cell = lambda c: F.struct(F.trim(text_of(c["text"])).alias("text"), c["x"].cast("double").alias("x"), c["width"].cast("double").alias("width"))
        cells = F.coalesce(F.filter(F.transform(l["items"], cell), lambda c: c["text"] != ""), nothing) if items else nothing
        return F.struct(i.alias("no"), collapse(l["text"]).alias("text"), *[l[n].cast("double").alias(n) for n in ("x", "y", "width", "height")], _by(cells, lambda c: c["x"]).alias("cells"))

    def signal(l: Column) -> Column:
        c, numbers = l["cells"], F.regexp_count(l["text"], F.lit(r"(?:^|\s)[+-]?(?:\d+\.?\d*|\.\d+)%?"))
        wide = F.filter(F.transform(c, lambda x, i: F.when(i > 0, x["x"] - F.get(c, i - 1)["x"] - F.get(c, i - 1)["width"])), lambda g: g > F.greatest(F.lit(8.0), l["height"] * 0.9))
        compact = (F.size(c) >= 3) & (F.size(wide) >= 2) & (F.size(F.filter(c, lambda x: F.length(x["text"]) <= 24)) >= F.ceil(F.size(c) * 0.7))
        return (numbers >= 2) | ((numbers >= 1) & compact) | (compact & (F.length(l["text"]) < 90))

    told = lambda l: F.struct(*[l[n].alias(n) for n in ("no", "text", "x", "y", "width", "height", "cells")], signal(l).alias("signal"))
    df = once(once(pages.select("doc_id", "page", "lines"), "raw", F.transform("lines", line)), "l", F.transform("raw", told))
    df = once(df, "down", _by(F.col("l"), lambda l: l["y"], lambda l: l["x"]))
    start = F.expr("named_struct('tops', cast(array() as array<double>), 'at', cast(array() as array<int>))")

    def step(a: Column, l: Column) -> Column:
        above = F.size(F.filter(a["tops"], lambda t: t < l["y"] - F.greatest(F.lit(3.0), l["height"] * 0.55)))
        tops = F.when(above == F.size(a["tops"]), F.array_append(a["tops"], l["y"])).otherwise(a["tops"])
        return F.struct(tops.alias("tops"), F.array_append(a["at"], above).alias("at"))

    df = once(df, "placed", F.aggregate("down", start, step))
    mine = lambda k: _by(F.filter(F.col("down"), lambda l, i: F.get(F.col("placed.at"), i) == k), lambda l: l["x"])

    def row(t: Column, ls: Column) -> Column:
        own = lambda l: F.when(F.size(l["cells"]) > 0, l["cells"]).when(l["text"] != "", F.array(F.struct(l["text"].alias("text"), l["x"].alias("x"), l["width"].alias("width")))).otherwise(nothing)
        edge = lambda f, of: f(F.transform(ls, of))
        return F.struct(
            t.alias("y"), edge(F.array_max, lambda l: l["height"]).alias("height"), edge(F.array_min, lambda l: l["x"]).alias("x"), edge(F.array_max, _right).alias("right"),
            _joined(ls).alias("text"), F.size(ls).alias("n_lines"), _by(F.flatten(F.transform(ls, own)), lambda c: c["x"]).alias("cells"), F.transform(ls, _center).alias("centers"),
        )

    df = once(df, "plain", F.transform(F.col("placed.tops"), lambda t, k: bound(mine(k), lambda ls: row(t, ls))))
    kept = ("y", "height", "x", "right", "text", "n_lines", "centers")
    marked = lambda r: F.struct(*[r[n].alias(n) for n in kept], *[F.coalesce(c, F.lit(False)).alias(n) for n, c in _table_marks(r["cells"], r["text"], r["height"], r["n_lines"]).items()])
    return once(df, "r", F.transform("plain", marked)).select("doc_id", "page", "l", "r")


def _of_table(r: Column) -> Column:
    return r["data"] | r["header"] | r["label"]


def _whole_caption(lines: Column, c: Column, page_width: float) -> Column:
    """struct<text, bottom> of a caption with the at most three lines that go on with it in its column."""
    across = _across(c, page_width)
    start = F.struct(F.array(F.when(c["begin"] == "", c["text"]).otherwise(c["begin"])).alias("parts"), (c["y"] + c["height"]).alias("bottom"), F.lit(False).alias("over"))

    def step(s: Column, l: Column) -> Column:
        last, off = F.element_at(s["parts"], -1), F.abs(_center(l) - _center(c))
        complete = last.rlike(r"[.!?]$") & ~last.rlike(OPEN_ABBREVIATION)
        beside = (off > page_width * 0.3) | (across & (l["width"] < page_width * 0.43) & (off > page_width * 0.16))
        other = _is_caption(l["text"]) | l["text"].rlike(SECTION_START) | l["text"].rlike(NUMBER_AT_END) | (_words(l, 2) < 2)
        ends = s["over"] | complete | (l["y"] - s["bottom"] > F.greatest(F.lit(18.0), c["height"] * 1.8)) | beside | other
        held = F.struct(s["parts"].alias("parts"), s["bottom"].alias("bottom"), F.lit(True).alias("over"))
        grown = F.struct(F.array_append(s["parts"], l["text"]).alias("parts"), (l["y"] + l["height"]).alias("bottom"), (F.size(s["parts"]) >= 3).alias("over"))
        return F.when(ends, held).otherwise(grown)

    def within(b: Column) -> Column:
        below = F.filter(lines, lambda l: (l["no"] != c["no"]) & (l["y"] > c["y"]) & _center(l).between(b["left"], b["right"]))
        folded = F.aggregate(F.slice(_by(below, lambda l: l["y"], lambda l: l["x"]), 1, 8), start, step)
        text = lambda s: collapse(F.regexp_replace(F.array_join(s["parts"], " "), r"([A-Za-z])-\s+([a-z])", "$1$2"))
        return bound(folded, lambda s: F.struct(text(s).alias("text"), s["bottom"].alias("bottom")))

    return bound(F.when(across, _span(page_width * 0.045, page_width * 0.955)).otherwise(column_bounds(c["x"], c["width"], page_width)), within)


def _table_block(rows: Column, low: Column, high: Column, first: bool) -> Column:
    """The first, or last, run of table rows without a wide gap that makes a table, of those whose top is in a range; else null."""
    near = F.filter(rows, lambda r: r["y"].between(low, high) & _of_table(r))

    def runs(k: Column) -> Column:
        opens = lambda r, i: F.when((i == 0) | (r["y"] - F.get(k, i - 1)["y"] - F.get(k, i - 1)["height"] > F.greatest(F.lit(18.0), r["height"] * 1.9)), i)
        cut = lambda cuts: F.transform(cuts, lambda at, j: F.slice(k, at + 1, F.coalesce(F.get(cuts, j + 1), F.size(k)) - at))
        return bound(F.filter(F.transform(k, opens), lambda i: i.isNotNull()), cut)

    count = lambda run, kind: F.size(F.filter(run, lambda r: r[kind]))
    good = F.filter(bound(near, runs), lambda run: ((count(run, "data") >= 1) & (F.size(run) >= 2)) | (count(run, "header") >= 3))
    return F.try_element_at(good, F.lit(1 if first else -1))


def _table_region(lines: Column, rows: Column, c: Column, page_width: float, page_height: float) -> Column:
    """The padded box of the table above a caption, else below it; null without one."""
    near = F.filter(lines, lambda l: (F.abs(l["y"] - c["y"]) < page_height * 0.32) & l["signal"])

    def shared(n: Column) -> Column:
        right = F.filter(n, lambda l: _center(l) > page_width / 2)
        facing = lambda r: F.size(F.filter(n, lambda l: (_center(l) < page_width / 2) & F.exists(r, lambda o: F.abs(l["y"] - o["y"]) <= F.greatest(F.lit(4.0), l["height"] * 0.7))))
        return F.exists(n, lambda l: l["width"] >= page_width * 0.58) | (bound(right, facing) >= 2)

    def goes_on(s: Column, r: Column) -> Column:
        ends = s["over"] | (r["y"] - s["bottom"] > 18) | _of_table(r) | (_words(r, 2) == 0) | (r["n_lines"] > 2)
        return F.struct(F.when(ends, s["bottom"]).otherwise(r["y"] + r["height"]).alias("bottom"), ends.alias("over"))

    def around(b: Column, block: Column) -> Column:
        edge = lambda f, of: f(F.transform(block, of))
        h, top, bottom = F.get(block, F.lit(0))["height"], edge(F.array_min, lambda r: r["y"]), edge(F.array_max, lambda r: r["y"] + r["height"])
        rival = F.exists(lines, lambda l: (l["no"] != c["no"]) & l["text"].rlike(TABLE_CAPTION) & (F.abs(l["y"] - c["y"]) <= F.greatest(F.lit(16.0), c["height"] * 1.5)))
        across = F.exists(block, lambda r: (r["x"] < page_width * 0.45) & (r["right"] > page_width * 0.55)) & ~rival
        pad, padded = max(7.0, page_width * 0.012), bottom + F.greatest(F.lit(6.0), h * 0.6)
        x = F.when(across, page_width * 0.025).otherwise(F.greatest(b["left"], edge(F.array_min, lambda r: r["x"]) - pad))
        right = F.when(across, page_width * 0.975).otherwise(F.least(b["right"], edge(F.array_max, lambda r: r["right"]) + pad))
        y = F.greatest(F.lit(page_height * 0.02), top - F.greatest(F.lit(11.0), h * 1.15))
        end = F.when(bottom <= c["y"], F.least(padded, c["y"] - F.greatest(F.lit(2.0), h * 0.18))).otherwise(padded)
        return _box(x, y, F.greatest(F.lit(40.0), right - x), F.greatest(F.lit(24.0), end - y))

    def within(b: Column) -> Column:
        mine = F.filter(rows, lambda r: F.exists(r["centers"], lambda m: m.between(b["left"], b["right"])))

        def beside(mine: Column) -> Column:
            start = F.struct((c["y"] + c["height"]).alias("bottom"), F.lit(False).alias("over"))
            after = F.aggregate(F.slice(F.filter(mine, lambda r: r["y"] > c["y"]), 1, 6), start, goes_on)["bottom"] + 2
            above = _table_block(mine, F.greatest(F.lit(0.0), c["y"] - page_height * 0.32), c["y"] - 2, False)
            below = bound(after, lambda a: _table_block(mine, a, F.least(F.lit(page_height), a + page_height * 0.28), True))
            return bound(F.coalesce(above, below), lambda block: F.when(block.isNotNull(), around(b, block)))

        return bound(mine, beside)

    wide = _span(page_width * 0.035, page_width * 0.965)
    return bound(F.when(bound(near, shared), wide).otherwise(column_bounds(c["x"], c["width"], page_width)), within)


def _figure_region(lines: Column, captions: Column, c: Column, page_width: float, page_height: float) -> Column:
    """The box above a figure's caption: down from the header, prose or earlier caption there, within its column or the page."""
    across = _across(c, page_width)
    end = F.greatest(F.lit(1.0), c["y"] - c["height"] - 6)

    def start_of(b: Column, mine: Column) -> Column:
        before = F.filter(captions, lambda o: _center(o).between(b["left"], b["right"]) & (o["y"] < c["y"] - F.greatest(F.lit(18.0), c["height"] * 1.8)))
        gap = lambda o: F.greatest(F.lit(7.0), o["height"] * 0.65)
        under = lambda o: F.greatest(o["whole"]["bottom"], F.coalesce(o["table"]["y"] + o["table"]["height"], o["whole"]["bottom"])) + gap(o)
        held = F.coalesce(bound(F.get(_by(before, lambda o: -o["y"]), F.lit(0)), under), F.lit(0.0))
        code = lambda l: l["text"].rlike(CODE_LINE) | (F.size(F.filter(mine, lambda o: (F.abs(o["y"] - l["y"]) <= F.greatest(F.lit(34.0), l["height"] * 3.5)) & o["text"].rlike(CODE_HINT))) >= 2)
        prose = F.filter(mine, lambda l: (l["y"] < end - 55) & (l["y"] >= end - page_height * 0.48) & (_words(l, 2) >= 8) & l["text"].rlike(r"[.!?)]$") & ~code(l))
        header = F.filter(mine, lambda l: (l["y"] < page_height * 0.045) & (l["y"] < end - 30))
        below_last = lambda ls: bound(F.try_element_at(ls, F.lit(-1)), lambda l: l["y"] + l["height"] + 7)
        span = F.when(across & (c["y"] >= page_height * 0.7), LOW_FIGURE_SPAN).otherwise(FIGURE_SPAN)
        inferred = F.coalesce(below_last(header), below_last(prose), end - page_height * span)
        floor = end - page_height * F.when(across, WIDE_FIGURE_FLOOR).otherwise(FIGURE_FLOOR)
        return F.greatest(F.lit(page_height * 0.05), F.least(inferred, floor), held)

    def within(b: Column) -> Column:
        mine = F.filter(lines, lambda l: _center(l).between(b["left"], b["right"]))
        return bound(bound(mine, lambda m: start_of(b, m)), lambda y: _box(b["left"], y, b["right"] - b["left"], F.greatest(F.lit(40.0), end - y)))

    return bound(F.when(across, _span(page_width * 0.035, page_width * 0.965)).otherwise(column_bounds(c["x"], c["width"], page_width)), within)


def steady_region(region: Column, kind: Column, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> Column:
    """struct<x, y, width, height, recovered>: a region that is too flat for its kind grows upwards from its bottom."""
    table, width, height = kind == "table", F.greatest(F.lit(1.0), region["width"]), F.greatest(F.lit(1.0), region["height"])
    least = F.when(table, page_height * 0.075).otherwise(F.greatest(F.lit(page_height * 0.11), width / 6.5))
    kept = (height >= least) & (width / height <= F.when(table, 9.0).otherwise(7.5))
    bottom = F.least(F.lit(page_height * 0.975), region["y"] + height)
    y = F.greatest(F.lit(page_height * 0.035), bottom - F.least(page_height * F.when(table, 0.3).otherwise(0.38), F.greatest(least, height * 2.4)))
    grown = (F.greatest(F.lit(page_width * 0.02), region["x"]), y, F.least(F.lit(page_width * 0.96), width), bottom - y)
    return F.struct(*[F.when(kept, region[n]).otherwise(g).alias(n) for n, g in zip(("x", "y", "width", "height"), grown, strict=True)], (~kept).alias("recovered"))


def caption_regions(pages: DataFrame, page_width: float = PAGE_WIDTH, page_height: float = PAGE_HEIGHT) -> DataFrame:
    """What figure and table captions of pages (doc_id, page, lines array<struct<text, x, y, width, height[, items]>>) stand for.

    doc_id, page, line_no, kind, number, caption, x, y, width, height, recovered. A table's caption without
    table rows near it gives none; a figure's always gives one. All within a page's row, and without a shuffle.
    """
    df = _with_rows(pages)
    kind = lambda l: F.when(l["text"].rlike(FIGURE_CAPTION), "figure").otherwise("table")
    part = lambda l, n: F.when(l["text"].rlike(FIGURE_CAPTION), F.regexp_extract(l["text"], FIGURE_CAPTION, n)).otherwise(F.regexp_extract(l["text"], TABLE_CAPTION, n))
    fields = ("no", "text", "x", "y", "width", "height")
    opened = F.transform(F.filter("l", lambda l: _is_caption(l["text"])), lambda l: F.struct(*[l[n].alias(n) for n in fields], kind(l).alias("kind"), part(l, 1).alias("number"), part(l, 2).alias("begin")))
    df = once(df, "o", opened)
    table = lambda c: F.when(c["kind"] == "table", _table_region(F.col("l"), F.col("r"), c, page_width, page_height))
    df = once(df, "c", F.transform("o", lambda c: F.struct(*[c[n].alias(n) for n in (*fields, "kind", "number")], _whole_caption(F.col("l"), c, page_width).alias("whole"), table(c).alias("table"))))
    region = lambda c: F.when(c["kind"] == "table", c["table"]).otherwise(_figure_region(F.col("l"), F.col("c"), c, page_width, page_height))
    found = F.transform("c", lambda c: F.struct(c["no"].alias("line_no"), c["kind"].alias("kind"), c["number"].alias("number"), c["whole"]["text"].alias("caption"), region(c).alias("region")))
    each = df.select("doc_id", "page", F.inline(F.filter(found, lambda f: f["region"].isNotNull())))
    return each.withColumn("region", steady_region(F.col("region"), F.col("kind"), page_width, page_height)).select("doc_id", "page", "line_no", "kind", "number", "caption", "region.*")


# ------------------------------------------------------------------ titles


def clean_title(c: Column) -> Column:
    """Without control characters and a section word at the end."""
    x = collapse(F.regexp_replace(text_of(c), r"[\x00-\x1f]+", " "))
    return F.trim(F.regexp_replace(x, r"(?i)(?:^|\s+)(?:abstract|introduction|keywords?)\s*$", ""))


def usable_title(c: Column) -> Column:
    return (F.length(F.trim(text_of(c))) >= 5) & ~F.trim(text_of(c)).rlike(UNUSABLE_TITLE)


def is_author_line(c: Column) -> Column:
    """Whether a line names authors or where they work rather than goes on with a title."""
    x = clean_title(c)
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    listed = (F.size(parts) >= 3) & F.forall(parts, lambda p: F.length(p) <= 42) & ~x.rlike("[:?!]")
    named = F.split(x, r"\s+")
    joined = F.size(named).between(2, 10) & (F.size(F.filter(named, lambda w: w.rlike(r"^[A-Z][a-z]+(?:[A-Z][a-z]+)+\d*$"))) >= 2)
    return (x == "") | x.rlike(AFFILIATION) | listed | joined


def title_lines(page_lines: DataFrame, page_height: float = PAGE_HEIGHT, most: int = 4) -> DataFrame:
    """doc_id, title_lines: the block of the largest type at the top of each first page, up to the authors."""
    text = clean_title(F.col("text"))
    top = page_lines.filter((F.col("page") == 1) & (F.col("y") <= page_height * 0.32)).withColumn("text", text).filter(F.length("text").between(4, 180) & ~F.col("text").rlike(NO_TITLE))
    one = F.struct("y", "line_no", "height", "text", is_author_line(F.col("text")).alias("author"))
    docs = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max("height").alias("largest"))
    start = F.expr("named_struct('over', false, 'y', cast(0 as double), 'height', cast(0 as double), 'kept', cast(array() as array<string>))")

    def step(a: Column, i: Column) -> Column:
        h, gap, n = i["height"], i["y"] - a["y"], F.size(a["kept"])
        style = (h >= F.col("largest") * 0.87) | ((h >= F.col("largest") * 0.8) & F.try_element_at(a["kept"], F.lit(-1)).rlike(r"[:\-]$"))
        goes_on = (n < most) & (gap > 0) & (gap <= F.greatest(F.col("largest") * 1.45, a["height"] * 1.65)) & style & ~i["author"]
        takes = F.when(n == 0, h >= F.col("largest") * 0.94).otherwise(goes_on)
        taken = F.struct(F.lit(False).alias("over"), i["y"].alias("y"), h.alias("height"), F.array_append(a["kept"], i["text"]).alias("kept"))
        left = F.struct((n > 0).alias("over"), a["y"].alias("y"), a["height"].alias("height"), a["kept"].alias("kept"))
        return F.when(a["over"], a).when(takes, taken).otherwise(left)

    return docs.select("doc_id", F.aggregate("all", start, step)["kept"].alias("title_lines"))


def resolved_title(metadata: Column, lines_of_title: Column, file_name: Column) -> Column:
    """The metadata's title unless it is a template's, else the page's, else any of the metadata, else the file's name."""
    meta, page = clean_title(metadata), clean_title(F.array_join(F.coalesce(lines_of_title, F.array().cast("array<string>")), " "))
    name = clean_title(F.regexp_replace(text_of(file_name), r"(?i)\.pdf$", ""))
    return F.when(usable_title(meta) & ~meta.rlike(TEMPLATE_TITLE), meta).when(usable_title(page), page).when(usable_title(meta), meta).when(name != "", name).otherwise("Untitled Paper Poster")


def primary_identity(metadata: Column, file_name: Column, first_page: Column) -> Column:
    """arxiv_id and doi, looked for in metadata, file name and first page only."""
    every = F.concat_ws("\n", metadata, file_name, first_page)
    return F.struct(arxiv_id(file_name, every).alias("arxiv_id"), doi(every).alias("doi"))


# ------------------------------------------------------------------ regions


def selected_regions(regions: DataFrame, limit: int, kind: str) -> DataFrame:
    """At most `limit` regions (doc_id, ord, number, caption) of each document, in their order: of figures the first six, then telling ones."""
    doc = Window.partitionBy("doc_id")
    at = F.row_number().over(doc.orderBy("ord"))
    text = F.concat_ws(" ", "caption", "number")
    late = F.when(at <= min(6, limit), 0).when(text.rlike(TELLING), 1).otherwise(2) if kind == "figure" else F.lit(0)
    ranked = regions.withColumn("_late", late).withColumn("_rank", F.row_number().over(doc.orderBy("_late", "ord")))
    return ranked.filter(F.col("_rank") <= limit).drop("_late", "_rank")


def normal_box(box: Column, fallback: Column | None = None) -> Column:
    """A box (left, top, right, bottom) within the unit square; the fallback, or the whole square, for one that is all but empty."""
    names = ("left", "top", "right", "bottom")
    whole = fallback if fallback is not None else F.struct(*[F.lit(0.0 if n in names[:2] else 1.0).alias(n) for n in names])
    held = F.struct(*[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(box[n], whole[n]))).alias(n) for n in names])
    return bound(held, lambda b: F.when((b["right"] - b["left"] < 0.02) | (b["bottom"] - b["top"] < 0.02), whole).otherwise(b))


# ------------------------------------------------------------------ crops

# How sure a crop must be, how large, and how it may be shaped: (least width, least height, most width for a height) by kind.
LEAST_CONFIDENCE, LEAST_AREA, LEAST_OVERLAP, SURER = 0.55, 0.01, 0.18, 0.02
SHAPES = {"formula": (0.08, 0.025, 24.0), "table": (0.18, 0.08, 10.0), "figure": (0.12, 0.08, 8.0)}
EDGES = ["top", "right", "bottom", "left"]


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["right"] - box["left"]) * F.greatest(F.lit(0.0), box["bottom"] - box["top"])


def boxes_meet(a: Column, b: Column, share: float = LEAST_OVERLAP) -> Column:
    """Whether two boxes (left, top, right, bottom) share that part of the smaller one."""
    w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    return w * h >= F.least(box_area(a), box_area(b)) * share


def plausible_shape(box: Column, kind: Column) -> Column:
    w, h = F.greatest(F.lit(0.0), box["right"] - box["left"]), F.greatest(F.lit(0.0), box["bottom"] - box["top"])
    fits = lambda s: (w >= s[0]) & (h >= s[1]) & (w / F.greatest(h, F.lit(0.001)) <= s[2])
    return F.when(kind == "formula", fits(SHAPES["formula"])).when(kind == "table", fits(SHAPES["table"])).otherwise(fits(SHAPES["figure"]))


def accepted_crop(found: Column, complete: Column, confidence: Column, clipped: Column, box: Column, fallback: Column, kind: Column) -> Column:
    """struct<applied, box, confidence> of an inspected crop: its box if it is whole, sure, plausible and lies over the candidate, else the candidate."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    cut = F.size(F.array_intersect(F.coalesce(clipped, F.array().cast("array<string>")), F.array(*[F.lit(e) for e in EDGES]))) > 0
    told = F.coalesce(found & complete, F.lit(False)) & ~cut & (sure >= LEAST_CONFIDENCE)

    def judged(old: Column, new: Column) -> Column:
        ok = told & (box_area(new) >= LEAST_AREA) & plausible_shape(new, kind) & boxes_meet(new, old)
        return F.struct(ok.alias("applied"), F.when(ok, new).otherwise(old).alias("box"), sure.alias("confidence"))

    return bound(normal_box(fallback), lambda old: bound(normal_box(box, old), lambda new: judged(old, new)))


def best_crop(tries: Column) -> Column:
    """Of tries (attempt, confidence, area) in order the one to take: a surer one by a margin, or a smaller one as sure; null without any."""
    none = F.expr("cast(null as struct<attempt:int,confidence:double,area:double>)")
    one = lambda t: F.struct(t["attempt"].cast("int").alias("attempt"), t["confidence"].cast("double").alias("confidence"), t["area"].cast("double").alias("area"))
    better = lambda b, t: b.isNull() | (t["confidence"] > b["confidence"] + SURER) | ((F.abs(t["confidence"] - b["confidence"]) <= SURER) & (t["area"] < b["area"]))
    return F.aggregate(F.array_sort(tries), none, lambda b, t: F.when(better(b, t), one(t)).otherwise(b))


def crop_quota(regions: DataFrame, most: int = 6, tries: int = 3) -> DataFrame:
    """Regions (doc_id, kind, ord, …) with how often each may be inspected: three times, six for all of a kind."""
    before = (F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")) - 1) * tries
    return regions.withColumn("tries", F.greatest(F.lit(0), F.least(F.lit(tries), F.lit(most) - before)))


def table_markers(lines_of: DataFrame, number: Column) -> DataFrame:
    """The lines (doc_id, page, line_no, text) that begin a numbered table's caption, alone or with the three that follow."""
    follows = Window.partitionBy("doc_id", "page").orderBy("line_no")
    near = F.concat_ws(" ", *[F.trim(F.coalesce(F.lead("text", k).over(follows) if k else F.col("text"), F.lit(""))) for k in range(4)])
    opens = F.concat(F.lit(r"(?i)^Table\s*"), number.cast("string"), F.lit(r"\s*[:.\-]"))
    told = lines_of.withColumns({"_near": near, "_opens": opens})
    return told.filter(F.expr("trim(text) rlike _opens or (trim(text) rlike '(?i)^Table$' and _near rlike _opens)")).drop("_near", "_opens")


def with_crops(tables: DataFrame, url: Column) -> DataFrame:
    """Tables (doc_id, idx, name, crop_url, …) with the page's file to crop from, what stands in for it, and the table's number."""
    named = F.regexp_extract(F.coalesce("name", F.lit("")), r"(?i)Table\s*(\d+)", 1).try_cast("int")
    return tables.withColumns({"fallback_url": F.when(F.col("crop_url").isNotNull(), url).otherwise(F.lit("")), "table_number": F.coalesce(named, F.col("idx") + 1), "crop_url": F.coalesce("crop_url", url)})

"""Regions of captions and formulas against plain loops over the lines of a page."""

import random
import re

import pytest

from lectern.operators import geometry

W, H = 612.0, 792.0
FIGURE = re.compile(r"(?:figure|fig\.)\s*(\d+[a-z]?)\s*[:.\-]\s*(.*)", re.I)
TABLE = re.compile(r"table\s*(\d+[a-z]?)\s*[:.\-]\s*(.*)", re.I)
LINES = "array<struct<text:string,x:double,y:double,width:double,height:double,items:array<struct<text:string,x:double,width:double>>>>"


def mid(o):
    return o["x"] + o["width"] / 2


def n_words(t, least=2):
    return len(re.findall(r"[A-Za-z]{%d,}" % least, t))


def column(o):
    if o["width"] >= 0.62 * W:
        return 0.045 * W, 0.955 * W
    return (0.045 * W, W / 2 - 0.025 * W) if mid(o) < W / 2 else (W / 2 + 0.025 * W, 0.955 * W)


def central(o):
    return o["width"] >= 0.3 * W and abs(mid(o) - W / 2) <= 0.12 * W


def whole(page, c):
    parts, bottom = [(FIGURE.match(c["text"]) or TABLE.match(c["text"]))[2] or c["text"]], c["y"] + c["height"]
    lo, hi = (0.045 * W, 0.955 * W) if central(c) else column(c)
    for o in sorted((o for o in page if o is not c and o["y"] > c["y"] and lo <= mid(o) <= hi), key=lambda o: (o["y"], o["x"]))[:8]:
        t, off = o["text"], abs(mid(o) - mid(c))
        done = len(parts) == 4 or (parts[-1][-1:] in ".!?" and parts[-1] and not re.search(r"\b(w\.r\.t|e\.g|i\.e)\.$", parts[-1], re.I))
        foreign = FIGURE.match(t) or TABLE.match(t) or re.match(r"\d+(\.\d+)*\.?\s+[A-Z]", t) or re.search(r"[(\[]\d+[a-z]?[)\]]\s*$", t, re.I) or n_words(t) < 2
        if done or foreign or o["y"] - bottom > max(18, 1.8 * c["height"]) or off > 0.3 * W or (central(c) and o["width"] < 0.43 * W and off > 0.16 * W):
            break
        parts.append(t)
        bottom = o["y"] + o["height"]
    return re.sub(r"([A-Za-z])-\s+([a-z])", r"\1\2", " ".join(parts)), bottom


def row_kind(r):
    t, cells, h = r["text"], r["cells"], r["height"]
    if re.match(r"\d+(\.\d+)+\.?\s+[A-Za-z]", t):
        return ""
    apart = len(r["lines"]) > 1 or any(b["x"] - a["x"] - a["width"] > max(9, 0.9 * h) for a, b in zip(cells, cells[1:], strict=False))
    short = sum(len(c["text"]) <= 34 for c in cells) / max(1, len(cells))
    numeric = sum(bool(re.fullmatch(r"[+\-]?(\d+(\.\d+)?|\.\d+)%?(\s*[†‡*])?", c["text"])) for c in cells)
    values = len(re.findall(r"(?:^|\s)[+\-]?(?:\d+(?:\.\d+)?|\.\d+)%?(?=\s|$)", t))
    prose = not apart and n_words(t, 3) >= 7 and (t[-1:] in ".!?)" or len(t) >= 72)
    if not prose and (numeric >= 2 or values >= 2 or (numeric and apart and short >= 0.5) or (values and apart and len(t) < 100)):
        return "data+" if apart and len(cells) >= 2 and short >= 0.65 and len(t) < 120 and t[-1:] not in ".!?" else "data"
    if apart and len(cells) >= 2 and short >= 0.65 and len(t) < 120 and t[-1:] not in ".!?":
        return "header"
    label = re.search(r"\b(LLMs?|models?|methods?|approaches?|agents?|datasets?|backbones?|zero[- ]shot|optimi[sz]ation)\b", t, re.I)
    return "label" if not prose and len(t) <= 72 and n_words(t) <= 9 and label else ""


def rows_of(page):
    rows = []
    for o in sorted(page, key=lambda o: (o["y"], o["x"])):
        fit = [r for r in rows if abs(r["y"] - o["y"]) <= max(3, 0.55 * o["height"])]
        if fit:
            fit[0]["lines"].append(o)
        else:
            rows.append({"y": o["y"], "lines": [o]})
    for r in rows:
        r["lines"].sort(key=lambda o: o["x"])
        r |= {"height": max(o["height"] for o in r["lines"]), "x": min(o["x"] for o in r["lines"]), "right": max(o["x"] + o["width"] for o in r["lines"]), "text": " ".join(o["text"] for o in r["lines"]).strip()}
        r["cells"] = sorted((c for o in r["lines"] for c in ([i for i in o["items"] or [] if i["text"].strip()] or [o]) if c["text"].strip()), key=lambda c: c["x"])
        r["kind"] = row_kind(r)
    return rows


def signals(o):
    items = sorted((i for i in o["items"] or [] if i["text"].strip()), key=lambda i: i["x"])
    wide = sum(b["x"] - a["x"] - a["width"] > max(8, 0.9 * o["height"]) for a, b in zip(items, items[1:], strict=False))
    compact = len(items) >= 3 and wide >= 2 and sum(len(i["text"].strip()) <= 24 for i in items) >= -(-len(items) * 7 // 10)
    numbers = len(re.findall(r"(?:^|\s)[+-]?(?:\d+\.?\d*|\.\d+)%?", o["text"]))
    return numbers >= 2 or (compact and (numbers >= 1 or len(o["text"]) < 90))


def table_box(page, c):
    near = [o for o in page if abs(o["y"] - c["y"]) < 0.32 * H and signals(o)]
    facing = [a for a in near if mid(a) < W / 2 and any(mid(b) > W / 2 and abs(a["y"] - b["y"]) <= max(4, 0.7 * a["height"]) for b in near)]
    lo, hi = (0.035 * W, 0.965 * W) if len(facing) >= 2 or any(o["width"] >= 0.58 * W for o in near) else column(c)
    rows = [r for r in rows_of(page) if any(lo <= mid(o) <= hi for o in r["lines"])]
    bottom = c["y"] + c["height"]
    for r in [r for r in rows if r["y"] > c["y"]][:6]:
        if r["y"] - bottom > 18 or r["kind"] or not n_words(r["text"]) or len(r["lines"]) > 2:
            break
        bottom = r["y"] + r["height"]
    bottom += 2
    block = None
    for low, high, which in ((max(0, c["y"] - 0.32 * H), c["y"] - 2, -1), (bottom, min(H, bottom + 0.28 * H), 0)):
        runs = []
        for r in rows:
            if r["kind"] and low <= r["y"] <= high:
                if runs and r["y"] - runs[-1][-1]["y"] - runs[-1][-1]["height"] <= max(18, 1.9 * r["height"]):
                    runs[-1].append(r)
                else:
                    runs.append([r])
        good = [run for run in runs if (any(r["kind"][:4] == "data" for r in run) and len(run) > 1) or sum(r["kind"] in ("header", "data+") for r in run) >= 3]
        if good and not block:
            block = good[which]
    if not block:
        return None
    rival = any(o is not c and TABLE.match(o["text"]) and abs(o["y"] - c["y"]) <= max(16, 1.5 * c["height"]) for o in page)
    top, end, h = min(r["y"] for r in block), max(r["y"] + r["height"] for r in block), block[0]["height"]
    x, right = max(lo, min(r["x"] for r in block) - max(7, 0.012 * W)), min(hi, max(r["right"] for r in block) + max(7, 0.012 * W))
    if not rival and any(r["x"] < 0.45 * W and r["right"] > 0.55 * W for r in block):
        x, right = 0.025 * W, 0.975 * W
    y, low = max(0.02 * H, top - max(11, 1.15 * h)), end + max(6, 0.6 * h)
    if end <= c["y"]:
        low = min(low, c["y"] - max(2, 0.18 * h))
    return x, y, max(40, right - x), max(24, low - y)


def figure_box(page, c):
    lo, hi = (0.035 * W, 0.965 * W) if central(c) else column(c)
    mine, end = [o for o in page if lo <= mid(o) <= hi], max(1, c["y"] - c["height"] - 6)
    hint = r">>>|\bdef\s+|\breturn\b|\bfor\s+\w+\s+in\b|\bimport\b|assert\s+|==|\[[^\]]*\]|\w+\([^)]*\)\s*(?:->|:)"
    held = 0
    before = sorted((o for o in mine if o["y"] < c["y"] - max(18, 1.8 * c["height"]) and (FIGURE.match(o["text"]) or TABLE.match(o["text"]))), key=lambda o: -o["y"])
    if before:
        o = before[0]
        box = table_box(page, o) if TABLE.match(o["text"]) else None
        held = max(whole(page, o)[1], box[1] + box[3] if box else 0) + max(7, 0.65 * o["height"])
    start = end - H * (0.62 if central(c) and c["y"] >= 0.7 * H else 0.38)
    for o in mine:  # the last one counts
        code = re.search(r">>>|\bdef\s+|\breturn\b|\bfor\s+\w+\s+in\b|assert\s+", o["text"], re.I) or sum(abs(p["y"] - o["y"]) <= max(34, 3.5 * o["height"]) and bool(re.search(hint, p["text"], re.I)) for p in mine) >= 2
        if end - 0.48 * H <= o["y"] < end - 55 and n_words(o["text"]) >= 8 and o["text"][-1] in ".!?)" and not code:
            start = o["y"] + o["height"] + 7
    for o in mine:
        if o["y"] < 0.045 * H and o["y"] < end - 30:
            start = o["y"] + o["height"] + 7
    y = max(0.05 * H, min(start, end - H * (0.22 if central(c) else 0.15)), held)
    return lo, y, hi - lo, max(40, end - y)


def regions_of(page):
    out = []
    for i, c in enumerate(page):
        kind = "figure" if FIGURE.match(c["text"]) else "table" if TABLE.match(c["text"]) else None
        box = kind and (figure_box(page, c) if kind == "figure" else table_box(page, c))
        if box:
            (x, y, w, h), table = box, kind == "table"
            least = 0.075 * H if table else max(0.11 * H, w / 6.5)
            flat = h < least or w / h > (9 if table else 7.5)
            if flat:
                end = min(0.975 * H, y + h)
                y = max(0.035 * H, end - min((0.3 if table else 0.38) * H, max(least, 2.4 * h)))
                x, w, h = max(0.02 * W, x), min(0.96 * W, w), end - y
            out.append((i, kind, (FIGURE.match(c["text"]) or TABLE.match(c["text"]))[1], whole(page, c)[0], *[round(v, 6) for v in (x, y, w, h)], flat))
    return out


def as_line(text, x, y, width, height=10.0, items=None):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width), "height": float(height), "items": items}


def cells(y, *texts, x=60, step=80, width=30):
    return as_line(" ".join(texts), x, y, step * (len(texts) - 1) + width, 10, [{"text": t, "x": float(x + step * k), "width": float(width)} for k, t in enumerate(texts)])


PROSE = ["the model keeps all of its parameters fixed while we train the adapter layers.", "import os and return x == y", "def f(x): return x", "in the sense of w.r.t.", "which shows that the scores go on over hyphen-", "ated lines of the caption", "3.1 Setup of the study", "as equation says (3)", "short one", "Zero-shot models", "Results of methods on datasets", ""]


def random_page(rng):
    page, y = [], rng.uniform(10, 60)
    while y < 770:
        two = rng.random() < 0.6
        for x in (42, 330) if two else (rng.choice([42, 105, 180]),):
            width = rng.choice([90, 200, 245]) if two else rng.choice([200, 402, 520])
            kind = rng.random()
            if kind < 0.12:
                text = f"{rng.choice(['Figure', 'Fig.', 'Table', 'TABLE'])} {rng.randint(1, 9)}{rng.choice([':', '.', ' -'])} {rng.choice(['', 'Overview of the whole system', 'Scores of all models.', 'what we see, e.g.'])}".strip()
                page.append(as_line(text, x, y, width, rng.choice([8, 10, 12])))
            elif kind < 0.45:
                page.append(cells(y + rng.uniform(-2, 2), *[rng.choice(["91.2", "Model A", "77%", "B", "a long cell of text that has many letters", ".5"]) for _ in range(rng.randint(1, 4))], x=x, step=rng.choice([35, 60, 80])))
            else:
                page.append(as_line(rng.choice(PROSE[:-1]), x, y + rng.choice([0, 0, 3, 5]), width, rng.choice([8, 10, 12])))
        y += rng.choice([12, 14, 18, 40, 90])
    return page


def test_caption_regions_equal_loops(spark):
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(120)] + [[], [as_line("Table 1: alone", 42, 300, 200)], [as_line("Figure 1:", 42, 5, 200)]]
    df = spark.createDataFrame([(i, 1, p) for i, p in enumerate(pages)], f"doc_id int, page int, lines {LINES}")
    got = {}
    for r in geometry.caption_regions(df).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.kind, r.number, r.caption, *[round(v, 6) for v in (r.x, r.y, r.width, r.height)], r.recovered))
    want = {i: w for i, p in enumerate(pages) if (w := regions_of(p))}
    assert {i: sorted(v) for i, v in got.items()} == want
    every = [x for v in want.values() for x in v]
    assert len(every) > 300 and {x[1] for x in every} == {"figure", "table"} and {x[-1] for x in every} == {True, False}


def test_captions_by_cases(spark):
    """A caption over two lines, columns kept apart, a table across the page, and a caption without its table."""
    pages = [
        [as_line("Figure 1: Overall system", 105, 430, 402), as_line("architecture across both columns.", 120, 443, 300), as_line("body text of the left column here.", 42, 456, 250)],
        [as_line("Figure 2: Left part.", 42, 400, 200), as_line("Figure 3: Right part.", 330, 400, 200)],
        [cells(300, "Model", "Accuracy", "Recall"), cells(314, "A", "91.2", "88.0"), as_line("Table 4: Scores of all.", 42, 340, 240)],
        [as_line("Table 5: there is none", 42, 300, 240), as_line("the text of the paper goes on in long sentences of prose without any table here.", 42, 330, 245)],
        [as_line("table of contents", 42, 300, 240), as_line("see Figure 2: not one", 42, 330, 245)],
    ]
    got = {}
    for r in geometry.caption_regions(spark.createDataFrame([(i, 3, p) for i, p in enumerate(pages)], f"doc_id int, page int, lines {LINES}")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.caption, r.page) for r in got[0]] == [("Overall system architecture across both columns.", 3)] and got[0][0].width > 0.9 * W
    left, right = sorted(got[1], key=lambda r: r.x)
    assert left.x + left.width <= W / 2 <= right.x and (left.number, right.number) == ("2", "3")
    assert got[2][0].y + got[2][0].height <= 340 and got[2][0].kind == "table"
    assert sorted(got) == [0, 1, 2]


def test_formula_regions(spark):
    """Candidates are padded within their column and stop above the next line there; what crosses the gutter has the page."""
    pages = [
        [as_line("w_i = exp(s_i) / sum_j exp(s_j) (4)", 80, 160, 200), as_line("the next line of the text", 60, 172, 200)],
        [as_line("w_i = exp(s_i) / sum_j exp(s_j) (4)", 200, 160, 210)],
    ]
    got = {r.doc_id: r for r in geometry.formula_regions(spark.createDataFrame([(i, 1, p) for i, p in enumerate(pages)], f"doc_id int, page int, lines {LINES}")).collect()}
    assert (got[0].x, got[0].y, got[0].width) == (73.0, 156.0, 214.0) and got[0].height == pytest.approx(14.0)  # 172 - 10 - 3 lies above 170, so the least height holds
    assert (got[1].x, got[1].y, got[1].width, got[1].height) == (193.0, 156.0, 224.0, 18.0)

"""Arrangements of panels against plain loops over all of them."""

import random
from itertools import product
from math import log

import pytest
from pyspark.sql import functions as F

from lectern.operators import panels as P

IDS = ["problem", "motivation", "method", "theory", "visuals", "results", "contribution"]
PANEL = "struct<id:string,weight:double,aspect:double,min_width:double,min_height:double,has_table:boolean,samples:array<struct<width:double,height:double>>>"


def tall(samples, w):
    pts = sorted((a, b) for a, b in samples if a > 0 and b > 0)
    if not pts:
        return 0.0
    if w <= pts[0][0]:
        return pts[0][1] * (pts[0][0] / max(w, 80)) ** 0.7
    for (a, p), (b, q) in zip(pts, pts[1:], strict=False):
        if w < b:
            return p + (q - p) * (w - a) / (b - a)
    return pts[-1][1] * max(0.95, (pts[-1][0] / w) ** 0.2)


def loss_of(p, w, h):
    shape, g = max(w / max(h, 0.001), 0.05), p["weight"]
    miss = [max(0, max(0.16, p["min_width"]) - w), max(0, max(0.075, p["min_height"]) - h), max(0, 0.62 - shape)]
    out = abs(log(shape / p["aspect"])) * g + (100000 * (1 + sum(miss) * g) if any(miss) else 0)
    out += 24 * (max(0, 0.18 - w) + max(0, 0.14 - h)) + miss[2] * g * 20
    out += g * 30 * (0.24 - w + h - 0.42) if h > 0.42 and w < 0.24 else 0
    out += g * 18 * (1.45 - shape) if p["aspect"] >= 2.4 and shape < 1.45 else 0
    need, has = tall(p["samples"], max(120, w * 1600 - 8)), max(80, h * 1600 - 8)
    if need:
        out += (250000 + (need - has) * g * 2500 if need > has else 0) + max(0, has / need - 1.18) * g * 48
    return out


def best_of(panels):
    found = []
    for (n, aspect), ratio, mask in product(enumerate(P.ASPECTS), P.RATIOS, range(1, 2 ** len(panels) - 1, 2)):
        at, y, loss, sides = {}, [0.0, 0.0], 0.0, []
        for i, p in enumerate(panels):
            s = 0 if mask >> i & 1 else 1
            w = (ratio, 1 - ratio)[s]
            need = tall(p["samples"], max(160, w * 1600 - 8))
            h = max(p["min_height"], (need + (24 if p["has_table"] else 18)) / 1600 if need else 0.13)
            if w < p["min_width"]:
                loss = float("inf")
            at[p["id"]], sides = y[s], [*sides, s]
            y[s] += h
            loss += loss_of(p, w, h)
        wrong = ("theory" in at and "results" in at and at["theory"] > at["results"] + 0.002) or ("contribution" in at and "results" in at and at["contribution"] < at["results"] - 0.002)
        if wrong or max(y) > 1 / aspect + 0.002 or loss == float("inf"):
            continue
        loss += abs(y[0] - y[1]) * 24000 + sum(max(0, 1 / aspect - v) for v in y) * 1000 + abs(ratio - 0.5) * 2
        loss += max(0, sum(a != b for a, b in zip(sides, sides[1:], strict=False)) - 2) * 0.8
        found.append((loss + abs(log(aspect / 1.55)) * 3, loss, min(2.1, max(aspect, 1 / max(y)))))
    return min(found, default=None)


def random_panels(rng):
    n = rng.randint(3, 7)
    size = lambda: [(w, rng.uniform(60, 500) * (280 / w) ** 0.6) for w in rng.sample([280, 420, 560, 760, 1120, 1560], rng.randint(1, 4))]
    return [{"id": i, "weight": rng.uniform(0.5, 5), "aspect": rng.uniform(0.75, 4), "min_width": rng.choice([0.16, 0.28, 0.4]), "min_height": rng.choice([0.09, 0.14]), "has_table": rng.random() < 0.3, "samples": size() if rng.random() < 0.85 else []} for i in sorted(rng.sample(IDS, n), key=IDS.index)]


def test_two_columns_equal_loops(spark):
    rng = random.Random(11)
    papers = [random_panels(rng) for _ in range(14)]
    for p in papers:  # sizes of at least half of them
        for q in p[: (len(p) + 1) // 2]:
            q["samples"] = q["samples"] or [(560, 200.0)]
    odd = [papers[0][:2], [], [{**q, "samples": []} for q in papers[0]], [{**q, "min_width": 0.7} for q in papers[0]]]
    rows = [(i, [{**q, "samples": [{"width": float(a), "height": float(b)} for a, b in q["samples"]]} for q in p]) for i, p in enumerate(papers + odd)]
    got = {r.doc_id: r for r in P.two_columns(spark.createDataFrame(rows, f"doc_id int, panels array<{PANEL}>")).collect()}
    want = {i: b for i, p in enumerate(papers) if (b := best_of(p))}
    assert set(got) == set(want) and len(want) > 5
    for i, (_, loss, aspect) in want.items():
        assert got[i].loss == pytest.approx(loss, rel=1e-9) and got[i].aspect == pytest.approx(aspect, rel=1e-9)
        left, right = ([q for q in got[i].panels if (q.x == 0) == s] for s in (True, False))
        for column in (left, right):  # no gaps and no overlaps
            for a, b in zip(column, column[1:], strict=False):
                assert b.y == pytest.approx(a.y + a.h)
        assert all(q.w == got[i].ratio for q in left) and all(q.x + q.w == pytest.approx(1) for q in right)
        assert [q.id for q in got[i].panels] == [q["id"] for q in papers[i]]


def test_figure_floor(spark):
    """One figure a line or two, by the least and the most height of their shapes; groups without figures take no room."""
    rows = [(1, [[1.0]], 560.0), (2, [[2.0, 0.5, 8.0]], 560.0), (3, [[], [0.0]], 560.0), (4, None, 560.0), (5, [[1.0], [2.0]], 0.0)]
    df = spark.createDataFrame(rows, "id int, g array<array<double>>, w double")
    got = {r.id: r.f for r in df.select("id", P.figure_floor(F.col("g"), F.col("w")).alias("f")).collect()}
    assert got == {1: 520 + 78, 2: 520 + 110 + 78, 3: 0, 4: 0, 5: 0}


def features_of(p):
    """Weight, aspect and least sizes of one panel, step by step."""
    sections = dict(problem=(0.95, 1.35), motivation=(0.9, 1.35), method=(1.35, 1.75), theory=(1.15, 1.05), visuals=(1.55, 2.25), results=(1.2, 1.05), contribution=(0.78, 4.2))
    base, usual = sections.get(p["id"], (1.0, 1.35))
    hold = lambda v, a, b: min(b, max(a, v))

    def floor(w):
        out = 0
        for g in filter(None, p["groups"]):
            per = min(2, len(g))
            each = (max(120, w - 24) - 8 * (per - 1)) / per
            tops = [hold(each / a, *((180, 520) if a < 1.15 else (110, 620))) for a in g]
            out += 78 + sum(max(tops[k : k + per]) for k in range(0, len(g), per))
        return out

    sizes = [(w, max(h, floor(w))) for w, h in p["samples"]]
    at = lambda w: tall(sizes, w)
    media, text = p["image_aspects"] + p["drawing_aspects"], p["text_chars"]
    table, rich = p["n_table_figures"] + p["n_table_rows"] > 0, bool(media) or p["n_formulas"] > 1
    w = 0.55 + hold(text / 260, 0.45, 2.8) + (hold(at(560) / 210, 0.75, 3.8) if at(560) else 1)
    w += len(p["image_aspects"]) * 1.45 + len(p["drawing_aspects"]) * 0.9 + p["n_diagrams"] * 0.85 + p["n_figures"] * 0.55 + p["n_formulas"] * 0.65 + min(p["n_table_rows"], 10) * 0.12 + p["n_table_figures"] * 1.15
    w = hold(w * base * {"high": 1.16, "supporting": 0.82}.get(p["priority"], 1), 0.75, 9.5)
    shape = (sum(media) / len(media) if media else usual) * (1.35 if len(media) > 1 else 1)
    if p["n_multi"] or p["n_figures"] > 1:
        shape = max(shape, 1.35)
    aspect = hold((shape + 1.45) / 2, 1.45, 2.45) if table else hold(shape if media else 0.82 * (hold(560 / at(560), 0.75, 6.8) if at(560) else usual) + 0.18 * usual, 0.75, 6.8)
    shown = sum(map(len, p["groups"]))
    rules = [(p["id"] == "contribution", 0.28), (p["id"] == "problem", 0.26), (table, 0.46 if p["n_table_figures"] > 1 or p["n_table_images"] > 1 else 0.36), (shown > 1 or (shown and any(a < 2.2 for a in media)), 0.46), (p["n_multi"] and p["n_figures"] > 1, 0.42), (any(a >= 1.45 for a in media) or p["image_aspects"] or p["n_formulas"], 0.4), (rich, 0.3), (True, 0.16)]
    content = hold(0.13 + text / 6000, 0.13, 0.19)
    low = hold((at(560) + 18) / 1600, 0.085, 0.19) if at(560) else content
    drawn = hold((at(1120) + 18) / 1600, 0.095, 0.16) if at(1120) and not rich else low
    if p["id"] in ("problem", "contribution") and at(1560):
        height = hold((at(1560) + 14) / 1600, 0.075, 0.16 if p["id"] == "problem" else 0.145)
    else:
        height = hold(0.215 + min(p["n_table_rows"], 12) * 0.004, 0.215, 0.255) if table else max(0.2, content) if rich else drawn if p["n_diagrams"] else low
    return hold(w * 1.22, 0.75, 9.5) if table else w, aspect, next(v for on, v in rules if on), height


def test_panel_features_equal_loops(spark):
    rng = random.Random(2)
    some = lambda most: [rng.choice([0.6, 1.0, 1.5, 2.4, 5.0]) for _ in range(rng.randint(0, most))]
    rows = []
    for k in range(300):
        p = {"k": k, "id": rng.choice([*IDS, "quality"]), "priority": rng.choice(["high", "supporting", "", None]), "text_chars": rng.choice([0, 90, 400, 2000]), "image_aspects": some(2) if k % 2 else [], "drawing_aspects": some(2) if k % 3 else [], "groups": [some(3) for _ in range(rng.randint(0, 2))]}
        p |= {n: rng.choice([0, 0, 0, 1, 2]) for n in ("n_diagrams", "n_figures", "n_formulas", "n_table_figures", "n_table_images", "n_multi")} | {"n_table_rows": rng.choice([0, 0, 5, 20])}
        rows.append(p | {"samples": [(float(w), rng.uniform(50, 700)) for w in sorted(rng.sample([280, 420, 560, 1120, 1560], rng.randint(0, 4)))]})
    kind = "k int, id string, priority string, text_chars int, image_aspects array<double>, drawing_aspects array<double>, groups array<array<double>>, n_diagrams int, n_figures int, n_formulas int, n_table_figures int, n_table_images int, n_multi int, n_table_rows int, samples array<struct<width:double,height:double>>"
    df = spark.createDataFrame([tuple(p[c.split(" ")[0]] for c in kind.split(", ")) for p in rows], kind)
    got = {r.k: (r.weight, r.aspect, r.min_width, r.min_height) for r in P.panel_features(df).select("k", "weight", "aspect", "min_width", "min_height").collect()}
    assert len(got) == 300
    for p in rows:
        assert got[p["k"]] == pytest.approx(features_of(p)), p


def test_two_columns_adds_up_assignments_in_arrays(spark):
    one = [(n, 1.0, 1.2, 0.2, 0.1, False, [(560.0, 300.0)]) for n in IDS[:4]]
    rows = [(i, one) for i in range(300)] + [(300, one[:2]), (301, [(*p[:6], None) for p in one])]  # more than are worked on at once, of two kinds that have no row
    found = P.two_columns(spark.createDataFrame(rows, f"doc_id long, panels array<{PANEL}>"))
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = found.collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and len({str(r[1:]) for r in got}) == 1

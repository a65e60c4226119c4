import random
import re

from pyspark.sql import functions as F

from lectern.functions import spans
from lectern.operators import geometry, revise


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_inline_math_and_emphasis(spark):
    text = "The cost is O(n log n) and \\(a+b\\); L_task falls, P(x|y) holds."
    r = one(spark, spans.inline_math(F.lit(text)), spans.inline_math(F.lit(None).cast("string")), spans.preserves_math(F.lit(text), F.lit("O(n log n) \\( a + b \\) L_task P(x|y)")), spans.preserves_math(F.lit(text), F.lit("none")))
    assert [s.text for s in r.c0] == ["O(n log n)", "\\(a+b\\)", "L_task", "P(x|y)"] and r.c1 == [] and r.c2 and not r.c3
    assert all(text[s.start : s.end] == s.text for s in r.c0)
    told = one(spark, spans.emphasis(F.lit("A sparse self-attention model gains 28.4 BLEU over Transformer and Baseline.")), spans.inline_math(F.lit("We take argmin_x f(x) = (a+b)*(c-d)^2 / e. Then it ends.")))
    assert [(s.text, s.kind) for s in told.c0] == [("sparse self-attention model", "term"), ("28.4 BLEU", "metric"), ("Transformer", "term")]
    assert [(s.start, s.text) for s in told.c1] == [(8, "argmin_x f(x) = (a+b)*(c-d)^2 / e")]


def plain_spans(text, most=3):
    """Emphasis by its definition: metrics, then terms, from left to right, longer first, none over another."""
    found = [(rank, m.start(), -m.end(), m[0], kind) for rank, kind, patterns in ((0, "metric", [spans.METRIC]), (1, "term", [spans.TERM, spans.NAME])) for p in patterns for m in re.finditer(p, text, re.A)]
    kept = []
    for _, a, b, t, kind in sorted(found):
        if len(kept) < most and all(-b <= x or y <= a for x, y, *_ in kept):
            kept.append((a, -b, t, kind))
    return sorted(kept)


def test_spans_equal_plain_loops(spark):
    rnd = random.Random(5)
    words = ["self-attention", "model", "The", "Transformer", "28.4", "BLEU", "3 days", "multi-head-cross mechanism", "x", "BERT2", "Method", "12 %", "é", "self-", "F1", "scaled dot-product attention"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.emphasis(F.col("t")).alias("s")).collect()
    assert all([tuple(s) for s in r.s] == plain_spans(r.t) for r in got)


def test_repairs(spark):
    formulas = F.array(F.lit("$x=1$"), F.lit("\\mathcal{O}(N^{2} + M)"), F.lit("O(K)"))
    r = one(spark, spans.repaired_math(F.lit("It has complexity where N is the length."), formulas), spans.repaired_math(F.lit("Nothing to say."), formulas), spans.plain_math(F.lit("$a^{2} \\leq b$")))
    assert r.c0 == "It has complexity \\(O(N^{2} + M)\\), where N is the length." and r.c1 == "Nothing to say." and r.c2 == "a² ≤b"
    source = "Phase I: Collect data. More.\nPhase II: Train\nPhase 3 - Evaluate it."
    r = one(spark, spans.ordered_phases(F.lit(source)), spans.ordered_phases(F.lit("Phase 1: A b\nPhase 3: C d\nPhase 4: E f")), spans.repaired_phases(F.lit("A two-phase method. The pipeline runs in two phases: collect."), F.lit(source)))
    assert r.c0 == ["Collect data", "Train", "Evaluate it"] and r.c1 == []
    assert r.c2 == "A three-phase method. The pipeline runs in three phases: Collect data, Train, and Evaluate it."


def test_formulas_for_display(spark):
    given = ["argmin_x f(x) ~ p_data", "min_{theta} E_{x|y} log p_g", "\\begin{align*} a &= \\bm{b} \\end{align*}", "\\begin{equation}x \\in \\dmodel\\end{equation}", "$ \\bmx + \\dkey $"]
    want = ["\\argmin_{x} f(x) \\sim  p_{\\mathrm{data}}", "\\min_{theta} \\mathbb{E}_{x\\mid y} \\log p_{g}", "\\begin{aligned}\na &= \\mathbf{b}\n\\end{aligned}", "x \\in {d_{\\mathrm{model}}}", "\\mathbf{x} + {d_k}"]
    assert list(one(spark, *[spans.block_display(F.lit(g)) for g in given])) == want


def test_split_title(spark):
    r = one(spark, *[spans.split_title(F.lit(t)) for t in ("Short", "", "Sparse attention for long inputs: a study of memory and cost in practice")])
    assert r.c0 == ["Short"] and r.c1 == [] and r.c2 == ["Sparse attention for long inputs:", "a study of memory and cost in practice"]


def test_gates(spark):
    sources = spark.createDataFrame([(1, "We gain 28.4 points with sparse attention on long inputs.")], "k int, text string")
    proposed = spark.createDataFrame([(1, "a", "Sparse attention gains 28.4 points."), (1, "b", "It gains 8 points."), (1, "c", "Quantum turtles dance gladly under moonlight"), (1, "d", " "), (2, "e", "No source 5")], "k int, field string, text string")
    got = {r.field: r.accepted for r in revise.gate_corrections(proposed, sources, "k").collect()}
    assert got == {"a": True, "b": False, "c": False, "e": False}
    rows = [("ok", "Old text O(n).", "New text O(n).", 2, ""), ("math", "Old text O(n).", "New text.", 2, ""), ("number", "Old.", "Now 7.", 2, "about 77"), ("long", "A.", "A. B. C. D.", 2, ""), ("grown", "Old.", "x" * 190, 2, ""), ("none", "Old.", None, 2, "")]
    got = {r.id: r.reason for r in revise.gate_revisions(spark.createDataFrame(rows, "id string, original string, revision string, max_sentences int, source string")).collect()}
    assert set(got) == {"ok", "math", "number", "long", "grown"} and got["ok"] is None and all(got[k] for k in ("math", "number", "long", "grown"))


def test_recall(spark):
    memory = spark.createDataFrame([("p", {"method": "uses attention"}, ["old note", "attention note", "new note"], None)], "paper_id string, sections map<string,string>, annotations array<string>, questions array<string>")
    tasks = spark.createDataFrame([("method", ["model"]), ("results", ["score"])], "task_id string, keywords array<string>")
    got = {r.task_id: r for r in revise.recalled(memory, tasks).collect()}
    assert got["method"].annotations == ["attention note", "new note", "old note"] and got["method"].recalled_items == 4
    assert got["results"].prior_section is None and got["results"].annotations[0] == "new note" and got["results"].questions == []


def test_fair_shares_equal_a_plain_loop(spark):
    """Against a sequential version on random chunks."""
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "model", "gain", "table", "of", "seven", "7"])
    chunks = [(d, "t", i, f"S1C{i}", "Head", i, " ".join(" ".join(word() for _ in range(rnd.randint(3, 30))) + "." for _ in range(rnd.randint(1, 12)))) for d in range(6) for i in range(rnd.randint(1, 6))]

    def plain(of, limit):
        left, out = limit - len("[GSSC CONTEXT | task=t | goal=t]") - 2, []
        for k, (*_, i, cid, head, part, text) in enumerate(of):
            if left < 220:
                break
            label = f"[SOURCE {cid} | {head} | part {part}]"
            share = max(180, (left - len(label) - 2) // (len(of) - k))
            if len(text) > share:
                units = [s.strip() for s in text.split(".") if s.strip()]
                units = [s + "." for s in units]
                score = lambda j, s: (3 if j == 0 else 0) + 4 * ("model" in s) + 2 * ("7" in s or "table" in s)
                used, kept = 0, []
                for j, s in sorted(enumerate(units), key=lambda p: (-score(*p), p[0])):
                    cost = len(s) + (1 if kept else 0)
                    if used + cost <= share:
                        used += cost
                        kept.append((j, s))
                text = "\n".join(s for _, s in sorted(kept))
            if text and len(label) + 1 + len(text) <= left:
                out.append((cid, text))
                left -= len(label) + 1 + len(text) + 2
        return out

    tasks = spark.createDataFrame([("t", ["model"])], "task_id string, keywords array<string>")
    selected = spark.createDataFrame(chunks, "doc_id int, task_id string, idx int, chunk_id string, heading string, part int, text string")
    for limit in (700, 1500):
        got = revise.fair_shares(selected, tasks, limit).orderBy("doc_id", "pos").collect()
        for d in range(6):
            assert [(r.chunk_id, r.text) for r in got if r.doc_id == d] == plain([c for c in chunks if c[0] == d], limit)


def test_pages(spark):
    items = [("d", 1, 0, "Sm", 10.0, 50.0, 20.0, 10.0), ("d", 1, 1, "all", 30.5, 51.0, 20.0, 10.0), ("d", 1, 2, "caps", 55.0, 50.0, 20.0, 10.0), ("d", 1, 3, "far", 200.0, 50.0, 20.0, 10.0), ("d", 1, 4, " ", 1.0, 50.0, 2.0, 10.0)]
    got = geometry.lines(spark.createDataFrame(items, "doc_id string, page int, seq int, text string, x double, y double, width double, height double")).orderBy("line_no").collect()
    assert [r.text for r in got] == ["Small caps", "far"]
    r = one(spark, geometry.is_formula_line(F.lit("y = f(x) + b  (3)"), F.lit(200.0)), geometry.is_formula_line(F.lit("we see that this equals = something"), F.lit(200.0)), geometry.resolved_title(F.lit("Formatting Instructions"), F.array(F.lit("A Real"), F.lit("Title")), F.lit("x.pdf")))
    assert r.c0 and not r.c1 and r.c2 == "A Real Title"


def test_tables_and_regions(spark):
    cells = lambda *t: [(x, 50.0 + 100 * i, 30.0) for i, x in enumerate(t)]
    rows = [("d", 1, 0, 100.0, 10.0, 1, "Model Score", cells("Model", "Score")), ("d", 1, 1, 115.0, 10.0, 1, "Ours 28.4", cells("Ours", "28.4")), ("d", 1, 2, 300.0, 10.0, 1, "This is a long sentence of plain prose without any value here.", [("This is a long sentence of plain prose without any value here.", 50.0, 400.0)])]
    table = spark.createDataFrame(rows, "doc_id string, page int, row_no int, y double, height double, n_lines int, text string, cells array<struct<text:string,x:double,width:double>>")
    captions = spark.createDataFrame([("d", 1, "1", 140.0, 150.0)], "doc_id string, page int, number string, y double, bottom double")
    assert [tuple(r) for r in geometry.table_blocks(table, captions).collect()] == [("d", 1, "1", "before", 100.0, 125.0, 2)]
    regions = spark.createDataFrame([("d", i, str(i), "Result" if i == 9 else "Photo") for i in range(1, 11)], "doc_id string, ord int, number string, caption string")
    assert sorted(r.ord for r in geometry.selected_regions(regions, 7, "figure").collect()) == [1, 2, 3, 4, 5, 6, 9]
    assert sorted(r.ord for r in geometry.selected_regions(regions, 7, "table").collect()) == [1, 2, 3, 4, 5, 6, 7]

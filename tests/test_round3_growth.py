"""Findings of round 3 on growth: what was made anew for each sentence, asset or round, and that the results are those of plain loops."""

import re

from pyspark.sql import functions as F

from lectern.functions import evidence, text
from lectern.operators import agent, analysis, assets, retrieve

_SAID = [
    "", ".", "a", "a.b..c!\n? d。e！？f", "... The end", "x" * 40_000 + ".\n" + "y" * 70_000, "\U0001f600. İ? no。", " \n ", "No stop\nat all",
]


def test_stretches_without_a_negated_class(spark):
    made = spark.createDataFrame(list(enumerate(_SAID)), "i int, t string").select("i", text.stretches(F.col("t")).alias("s"))
    assert [r.s for r in made.orderBy("i").collect()] == [re.findall("[^.!?。！？]+[.!?。！？]?", t) for t in _SAID]
    plan = spark.createDataFrame([("",)], "t string").select(evidence.source_sentences(F.col("t")), evidence.section_query(F.col("t"), F.array("t")))
    assert "[^.!?。！？]+" not in plan._jdf.queryExecution().toString()  # before: in both


def test_only_sentences_that_are_asked_for_get_tokens(spark):
    said = "## Page 1\nThe Sparse-attention model reaches accuracy here. Nothing of that kind was ever said by anyone. Accuracy, of sparse ATTENTION and more words. sparse attention! The references give sparse attention and accuracy."
    asked = F.array(F.array(F.lit("sparse"), F.lit("attention"), F.lit("accuracy")), F.array(F.lit("kind")))
    row = spark.createDataFrame([(said,)], "t string").select(evidence.source_sentences(F.col("t")).alias("all"), evidence.source_sentences(F.col("t"), asked).alias("some"), asked.alias("asked"))
    best = lambda s: F.transform("asked", lambda w: evidence.excerpts(evidence.with_tokens(F.col(s)), w))
    got = row.select("all", "some", best("all").alias("of_all"), best("some").alias("of_some")).first()
    assert [s.quote[:8] for s in got.all] == ["The Spar", "Nothing ", "Accuracy"] and [s.quote[:8] for s in got.some] == ["The Spar", "Accuracy"]
    assert got.of_all == got.of_some and len(got.of_some[0]) == 2


_LINES = "$$\na\n\nb = 1\n$$ \nx $p = q$ y $r = s$\n\\begin{align}\nc = d\n$e$\n\\end{align} z\n\\begin{equation}f = g\\end{equation}\nno mark\n$$\nnever = closed\n\\begin{align}"


def test_formulas_of_marked_lines_only(spark):
    got = spark.createDataFrame([(_LINES,), ("\n".join(f"$x_{i} = {i}$" for i in range(12)),), (None,)], "t string").select(analysis._scanned(F.col("t")).alias("f"), analysis.text_formulas(F.col("t")).alias("t"))
    rows = got.collect()
    assert rows[0].f == ["a\n\nb = 1", "p = q", "\\begin{align}\nc = d\n$e$\n\\end{align} z", "\\begin{equation}f = g\\end{equation}"]
    assert rows[1].f == [f"x_{i} = {i}" for i in range(8)] and rows[2].t == []


def test_figures_of_lines_that_can_state_one(spark):
    said = ["TABLE 3: [A b] Source: x", "![](y.png)", "FIG. curve of it", "如图: 方法流程图示", "Table 4 is none", "a [b] c", "figures"]
    got = spark.createDataFrame([("\n".join(said),)], "t string").select(analysis.text_figures(F.col("t")).alias("f")).first().f
    assert [tuple(f) for f in got] == [("A b", "x"), ("Figure 2", "y.png"), ("curve of it", analysis.PLACEHOLDER), ("方法流程图示", analysis.PLACEHOLDER)]


def test_local_analysis_looks_at_a_sentence_once_for_all_fields(spark):
    words = {"summary": ["abstract"], "problem": ["Problem", "limited"], "motivation": [], "method": ["model"], "results": ["accuracy"], "contributions": ["novel"]}
    said = "An ABSTRACT model. Limited by 3.5 problems! The model\nnovel accuracy? Model three.\nMore accuracy"
    made = analysis.local_analysis(spark.createDataFrame([(said,), (None,)], "text string"), F.lit("t"), words)
    a, b = made.collect()
    assert (a.summary, a.problem, a.method) == ("An ABSTRACT model.", "Limited by 3.5 problems!", "An ABSTRACT model. The model")
    assert a.results == a.experiments == "novel accuracy? More accuracy" and a.contributions == "novel accuracy?" and a.motivation == analysis.DEFAULTS["motivation"]
    assert b.summary == "" and b.method == analysis.DEFAULTS["method"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 3 and plan.count("(?<=[。！？.!?])") == 1  # before: in lower case for each word of each field; now once for all fields, and twice for figures


def test_assets_are_ranked_within_their_row(spark):
    from lectern.plans import catalogue

    plan = catalogue.queries()["asset_ranking"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("FileScan") == 1  # before: a join and four windows, whose sorts hold a task's rows


def test_ranked_of_tables_keeps_families_places_and_terms(spark):
    rows = [(1, "table", 5, "Table 2", "Ablation without it", "", True, 0), (1, "table", 1, "Table 1", "Main results", "", True, 0), (1, "formula", 2, "", "L = q + 1", "", False, 0), (1, "formula", 0, "", "L = sum", "", False, 0), (1, "formula", 3, "", "O(n)", "", False, 0), (1, "figure", 0, "Figure 1", "Curve", "", False, 1), (2, "figure", None, "Figure 9", None, None, True, 2)]
    of = spark.createDataFrame(rows, "doc_id int, type string, idx int, name string, caption string, source string, artwork boolean, n_assets int")
    recs = "array<struct<type:string,reference:string,section:string,purpose:string,insight:string>>"
    about = spark.createDataFrame([(1, "", "main thing", "", "", "", "", [("Table", "table 2", "theory", "", "")]), (2, None, None, None, None, None, None, None), (3, "", "", "", "", "", "", [])], f"doc_id int, title string, summary string, method string, theory string, results string, experiments string, recommendations {recs}")
    got = {(r.doc_id, r.type, r.idx): r for r in assets.ranked(of, about).collect()}
    assert {k: (r.place, r["rank"], r.recommended, r.has_main) for k, r in got.items()} == {
        (1, "table", 1): (0, 1, False, True), (1, "table", 5): (1, 2, True, True), (1, "formula", 0): (0, 1, False, False), (2, "figure", None): (0, 1, False, False),
    }
    late = got[1, "table", 5]
    # 4 for being named by the recommendation, 4 for a word, 5 for a table, 12 for its place, less 18 for an ablation beside the main one and 0.01 for its place
    assert (late.recommendation, late.importance, late.ablation, late.placement, late.score) == (4.0, 4.0, -18.0, "theory", 6.99)
    assert got[1, "table", 1].main_result == 24.0 and got[1, "table", 1].context == 4.0 and got[2, "figure", None].provenance == 5.0


def test_rounds_within_a_row_equal_those_of_windows(spark):
    said = "# Method\n" + "The model trains. " * 150 + "early words\n\n" + "Results of it. " * 120 + "\n# Results\n" + "accuracy score " * 140 + "late words\n# Other\n" + "nothing. " * 700 + "last words"
    asked = ["early words", "late words", "last words", "absent", "The model", None, "accuracy"]
    docs = spark.createDataFrame([(1, said), (2, None), (3, "early words"), (4, said[2000:] * 3)], "doc_id long, text string")
    quotes = F.array(*[F.struct(F.lit(i).alias("quote_id"), F.lit(q).cast("string").alias("quote")) for i, q in enumerate(asked)])
    plan = [(t, ws) for t, ws in retrieve.task_list() if t in ("method", "results", "overview")]
    options = agent.Options(evidence_chars=3000, evidence_chunks=3, rounds=4)
    got = agent.grounding_in_rows(docs.withColumn("quotes", quotes), plan, options, size=700, normal=False)
    scores = retrieve.evidence_scored(retrieve.chunks(docs, 700, normal=False), retrieve.tasks(spark).filter("task_id in ('method', 'results', 'overview')"))
    each = docs.select("doc_id", F.explode(F.array(*[F.lit(t) for t, _ in plan])).alias("task_id")).select("doc_id", "task_id", F.inline(quotes))
    key = lambda df: sorted(((r.doc_id, r.task_id, r.quote_id, r["round"]) for r in df.collect()), key=str)
    assert key(got) == key(agent.grounding_round(scores, each, options)) and {r["round"] for r in got.collect()} >= {1, 2, None}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_query_of_rounds_neither_joins_nor_sorts(spark):
    from lectern.plans import catalogue

    plan = catalogue.queries()["grounding_rounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("FileScan") == 1  # before: two windows and joins, and texts shuffled twice

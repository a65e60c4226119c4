import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import evidence
from lectern.operators import assets, classify, evaluate, ground, identity, latex, monitor, retrieve, sets
from lectern.operators.registry import Operator, Registry
from lectern.plans import catalogue
from lectern.sources import files

PAPER = "# Paper\n# Abstract\nWe propose sparse attention.\n# Method\nOur method is sparse attention training.\n# Experiments\nDataset Alpha is the baseline.\n# References\nmethod method method"


def test_retrieval_selects_sections_and_never_references(spark):
    docs = spark.createDataFrame([(1, PAPER)], "doc_id long, text string")
    top = retrieve.top_chunks(retrieve.scored(retrieve.chunks(docs), retrieve.tasks(spark)), 2).collect()
    assert all(r.heading != "References" for r in top) and {r.task_id for r in top} == set(retrieve.TASK_KEYWORDS)
    assert "sparse attention" in next(r.text for r in top if r.task_id == "method" and r["rank"] == 1)
    assert "Dataset Alpha" in next(r.text for r in top if r.task_id == "experiments" and r["rank"] == 1)


def test_forced_sections_come_first(spark):
    parts = [f"# Part {i}\ncontribution novel innovation limitation" for i in range(9)] + ["# Conclusion\nIt ends."]
    docs = spark.createDataFrame([(1, "\n".join(parts))], "doc_id long, text string")
    top = retrieve.top_chunks(retrieve.scored(retrieve.chunks(docs), retrieve.tasks(spark))).filter("task_id = 'contribution'").orderBy("rank").collect()
    assert [r.heading for r in top] == ["Conclusion", "Part 0", "Part 1", "Part 2", "Part 3"] and len(top) == 5
    wide = retrieve.top_chunks(retrieve.scored(retrieve.chunks(docs), retrieve.tasks(spark)), expanded=True).filter("task_id = 'contribution'")
    assert wide.count() == 7


def plain_cuts(text, size):
    """The cuts by a plain loop."""
    out, rest = [], text.strip()
    while rest:
        if len(rest) <= size:
            out.append(rest)
            break
        ends = [rest.rfind(m, 0, size + len(m)) for m in ("\n\n", "\n", ". ")]
        ends[2] += 1
        at = next((e for e in ends if e > 300), size)
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in out if x]


def test_size_cuts_equal_a_plain_loop(spark):
    texts = ["\n".join(f"Line {i} with some words. And more of them." for i in range(200)), "x" * 2500, "a. " * 900, "\n\n".join("word " * 40 for _ in range(30)), "", "short", "é" * 301 + "\n" + "b" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size in (400, 1800):
        got = {r.i: r.c for r in df.select("i", retrieve.size_cuts(F.col("t"), size).alias("c")).collect()}
        assert all(got[i] == plain_cuts(t, size) and all(len(c) <= size + 1 for c in got[i]) for i, t in enumerate(texts))


def test_budget_cuts_the_last_chunk(spark):
    rows = [(1, "t", i, 10 - i, f"C{i}", "h", "x" * 300) for i in range(1, 5)]
    got = retrieve.within_budget(spark.createDataFrame(rows, "doc_id long, task_id string, idx int, score int, chunk_id string, heading string, text string"), 600).orderBy("evidence_id").collect()
    assert [(r.evidence_id, len(r.text)) for r in got] == [("E1", 300), ("E2", 259)]


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "Intro. Sparse attention reduces the cost of long inputs by half in practice. End."), (2, None)], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, "attention reduces the cost of long inputs"), (8, "nothing of the kind is said"), (9, ""), (10, "Intro.")], "item_id long, text string")
    assert sorted(tuple(r) for r in ground.quotes_in_corpus(quotes, docs).collect()) == [(7, 1), (10, 1)]
    assert ground.quotes_in_corpus(quotes.limit(0), docs).columns == ["item_id", "doc_id"]
    own = ground.grounded(spark.createDataFrame([(1, "tion reduces the"), (1, "no"), (1, "Foreign"), (2, "x")], "doc_id long, quote string"), docs, "doc_id").collect()
    assert [(r.doc_id, r.grounded, r.total, r.score) for r in sorted(own)] == [(1, 1, 3, 33.3), (2, 0, 1, 0.0)]
    claims = spark.createDataFrame([(1, "gain of 99.9"), (1, "and 84.2")], "k long, text string")
    source = spark.createDataFrame([(1, "gain of 84.2%")], "k long, text string")
    assert sorted(r.number for r in ground.unsupported_numbers(claims, source, "k").collect()) == ["84.2", "99.9"]


def test_evidence_gets_its_page_and_sentence(spark):
    paper = "## Page 2\nIntro of it. Sparse attention reduces the cost of long inputs by half, e. g. in practice.\n## Page 4\nThe fusion of both encoders is what makes the model robust to noise in all of our twelve test settings."
    quotes = [("attention reduces the cost of long inputs", "paper context"), ("The fusion of two encoders is what makes a model robust to noise in all of our twelve settings", "Method"), ("V.", "x"), ("unheard of", "retrieved source")]
    df = spark.createDataFrame([(paper, *q) for q in quotes], "text string, quote string, place string")
    keyed = df.withColumn("k", evidence.evidence_key(F.col("quote"))).withColumn("f", evidence.find_sentence(F.col("k"), evidence.keyed_sentences(F.col("text"))))
    got = [r.e for r in keyed.select(evidence.located(F.col("quote"), F.col("place"), F.col("f")).alias("e")).collect()]
    assert got[0].location == "Uploaded PDF, page 2" and got[0].quote.endswith("e.g. in practice.")
    assert got[1].location == "Method, page 4" and got[2] is None and (got[3].quote, got[3].location) == ("unheard of", "retrieved source")
    assert [r.x for r in spark.sql("select 'ﬁne “Ａ”' as t").select(evidence.evidence_key(F.col("t")).alias("x")).collect()] == ["fine a"]


def test_set_scores(spark):
    a = spark.createDataFrame([("c", 1), ("c", 2)], "k string, x int")
    e = spark.createDataFrame([("c", 2), ("c", 3)], "k string, x int")
    r = evaluate.set_scores(a, e, "k", "x").first()
    assert (r.precision, r.recall, r.f1) == (50.0, 50.0, 50.0)


def test_classify(spark):
    docs = spark.createDataFrame([(1, "A survey: taxonomy of methods, systematic review"), (2, "nothing"), (3, "We propose a new framework.\n## Method\nx\n## References\nsurvey survey survey"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in classify.classify(classify.type_scores(docs)).collect()}
    assert {i: r.paper_type for i, r in got.items()} == {1: "survey", 2: "method", 3: "method", 4: "method"}
    assert got[2].confidence == 0.35 and got[3].confidence == 0.96
    row = spark.range(1).select(classify.placement(F.lit("accuracy comparison"), F.lit("figure")).alias("a"), classify.placement(F.lit("x"), F.lit("table")).alias("b")).first()
    assert (row.a, row.b) == ("results", "results")


def test_figures_by_role(spark):
    """The overview comes first in a method paper, then what shows results; details and doubles stay out."""
    figures = [(0, "Figure 1", "Prompt template of one agent"), (1, "Figure 2", "Overview of the pipeline architecture"), (2, "Figure 2", "The same architecture again"), (3, "Figure 3", "Accuracy curve")]
    rows = spark.createDataFrame([(1, "figure", i, n, c, "", True, 1) for i, n, c in figures], "doc_id int, type string, idx int, name string, caption string, source string, artwork boolean, n_assets int")
    empty = "array<struct<type:string,reference:string,section:string,purpose:string,insight:string>>"
    about = spark.createDataFrame([(1, "", "", "", "", "", "", [])], f"doc_id int, title string, summary string, method string, theory string, results string, experiments string, recommendations {empty}")
    ranked = assets.ranked(rows, about)
    pick = lambda kind, has_table, n=2: [r.place for r in assets.selected_figures(ranked, spark.createDataFrame([(1, kind, has_table)], "doc_id int, paper_type string, has_table boolean"), n).orderBy("pos").collect()]
    assert pick("method", False) == [1, 3] and pick("method", True) == [1] and pick("survey", True, 3) == [3, 1]
    told = {r.idx: (r.purpose, r.insight) for r in assets.annotated(ranked).collect()}
    assert told[3] == ("Original-paper evidence for Accuracy curve", "This figure directly illustrates Accuracy curve.")


def test_sets(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    assert sorted(tuple(r) for r in sets.upsert(t, c, "id").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    have = spark.createDataFrame([(1, "Why?")], "id int, q string")
    new = spark.createDataFrame([(1, "why?"), (1, "How?")], "id int, q string")
    assert sorted((r.q, r.added) for r in sets.merge_unseen(have, new, "q", "id").collect()) == [("How?", True), ("Why?", False)]


def test_identity_conflicts(spark):
    docs = spark.createDataFrame([(1, "# Sparse Attention\ndoi 10.1145/1.2")], "doc_id long, text string")
    profile = spark.createDataFrame([(1, "Another Title", "10.1145/9.9", None)], "doc_id long, title string, doi string, arxiv_id string")
    r = identity.conflicts(profile, identity.identify(docs)).first()
    assert r.conflicts == ["title", "doi"] and not r.consistent


def test_monitor(spark):
    e = spark.createDataFrame([(1, "r", 3, "done"), (2, "r", 1, "run"), (3, "r", 2, "run")], "event_id int, run string, seq int, status string")
    r = monitor.latest_state(e, ["run"], "seq", ["status"]).first()
    assert (r.n_events, r.status) == (3, "done")


def test_latex(spark):
    files = [("p1", 0, "main.tex", "\\documentclass{article}\\title{A \\textbf{Method}}\\newcommand{\\loss}[1]{L_{#1}}\\begin{document}% note\n\\input{body}\\end{document}"), ("p1", 1, "body.tex", "\\begin{equation}\\loss{task}=\\frac{a}{b}\\end{equation}\n" + "\\[ words only \\]\n" * 20 + "\\[ x = 1 \\]\n\\begin{figure}\\includegraphics{figures/model}\\caption{The {nested} model}\\end{figure}\\begin{table}\\caption{S}\\begin{tabular}{ll}A & B\\\\ \\multicolumn{2}{c}{wide}\\end{tabular}\\end{table}")]
    tex = latex.combined(spark.createDataFrame(files, "paper_id string, seq int, path string, content string"))
    # what is no formula doesn't count towards the limit
    assert [(r.ord, r.formula) for r in latex.formulas(tex).collect()] == [(1, "L_{task}=\\frac{a}{b}"), (2, "x = 1")]
    assert latex.tables(tex).first().rows == [["A", "B"], ["wide", ""]]
    assert latex.figures(tex).first().caption == "The {nested} model"
    assert latex.titles(tex).first().title == "A Method"
    assert latex.command_argument("\\title{A {B} C}", "title") == "A {B} C"


def test_registry_rejects_a_taken_name(spark):
    r = Registry()
    r.register(Operator("a", "s", lambda: None, ("arxiv",)))
    with pytest.raises(ValueError):
        r.register(Operator("a", "s", lambda: None))
    assert [x.selected for x in r.plan(spark, "pdf").collect()] == [False]


def test_sources(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, body in (("main.tex", b"\\documentclass{a}"), ("f.png", b"\x89PNG")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "p1.tar.gz").write_bytes(buffer.getvalue())
    (tmp_path / "p2.tar.gz").write_bytes(gzip.compress(b"\\documentclass{b}"))
    got = sorted((r.paper_id, r.path) for r in files.archives(spark, str(tmp_path)).collect())
    assert got == [("p1", "f.png"), ("p1", "main.tex"), ("p2", "source.tex")]
    feed = spark.createDataFrame([("<feed xmlns='x' ><entry><id>http://x/abs/2401.00001v1</id><title>A\n B</title></entry></feed>".replace("'", '"'),)], "xml string")
    assert tuple(files.atom_entries(feed).first()) == ("2401.00001", "A B")

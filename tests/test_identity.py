"""Identity of papers, evidence in all its forms, and ranking within rows against ranking by windows."""

import random

from pyspark.sql import functions as F

from lectern.operators import assets, classify, ground, identity, retrieve, revise

PROFILE = "struct<" + ", ".join(f"{n}: {'array<string>' if n == 'title_lines' else 'string'}" for n in identity.PROFILE) + ">"


def profile(**given):
    return tuple(given.get(n) for n in identity.PROFILE)


def papers(spark, *rows):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], f"doc_id int, profile {PROFILE}, text string")


def test_profiles_are_repaired_from_the_first_page(spark):
    long = "Code Optimization Chain-of-Thought: Structured Understanding and Self-Checking"
    df = papers(
        spark,
        (profile(source_type="pdf", title=long, doi="10.1145/3690407.3690479"), f"# {long}\n\n## Page 1\nhttps://doi.org/10.1145/3690407.3690479"),
        (profile(source_type="pdf", title="Formatting Instructions for ICLR 2024 Conference Submissions", doi="10.1145/3690407.3690479"), f"# {long}\n\n## Page 1\nhttps://doi.org/10.1145/3690407.3690479"),
        (profile(source_type="pdf", title="Current Paper", doi="10.1000/stale"), "# Current Paper\n\n## Page 1\nhttps://doi.org/10.1000/current"),
        (profile(source_type="pdf", title="A Paper"), "# A Paper\n## Page 1\nNo DOI here.\n## Page 2\nReference https://doi.org/10.1000/reference-only"),
        (profile(source_type="arxiv", arxiv_id="2401.01234", title="A Paper"), "# A Paper\nIntroduction cites https://doi.org/10.1000/another-paper."),
        (profile(source_type="pdf", title="CodeCoR", detected_arxiv_id="2501.07811v1", doi="10.1145/nnnnnnn.nnnnnnn"), "# CodeCoR\n\n## Page 1\nhttps://doi.org/10.1145/nnnnnnn.nnnnnnn"),
        (profile(title_lines=["A Paper", "on  Two Lines"], title="A Paper on Two Lines"), None),
    )
    got = identity.reconcile(df).orderBy("doc_id").collect()
    assert [r.repaired_fields for r in got] == [[], ["title"], ["doi"], [], [], [], []] and all(r.consistent for r in got)
    assert got[1].title == long and got[2].paper_url == "https://doi.org/10.1000/current" and got[2].repaired
    assert got[3].doi == "" and got[3].key.startswith("text:") and got[4].paper_url == "https://arxiv.org/abs/2401.01234" and got[5].key == "arxiv:2501.07811v1"
    assert got[6].title_lines == ["A Paper", "on Two Lines"] and got[6].source_type == "text" and got[6].content_hash == "811c9dc5:0"
    accepted, rejected = identity.quarantined(identity.create(df))
    assert {r.doc_id for r in accepted.collect()} == {0, 3, 4, 5, 6}
    assert {r.doc_id: r.reason.split(". ")[1].split(" metadata")[0] for r in rejected.collect()} == {1: "Conflicting title", 2: "Conflicting doi"}


def test_matches_and_enrichment(spark):
    p = profile(title="Paper A", doi="10.1145/3690407.3690479")
    made = identity.create(papers(spark, (p, "# Paper A\nFirst paper content."), (p, "# Paper A\nEntirely different paper content."), (p, "# Paper A\nFirst  paper content.")))
    it = made.select("doc_id", F.struct("key", "content_hash", "title", "paper_url").alias("it"))
    pairs = it.alias("a").join(it.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), identity.matched(F.col("a.it"), F.col("b.it")).alias("m"))
    assert {(r.x, r.y) for r in pairs.collect() if r.m} == {(0, 0), (1, 1), (2, 2), (0, 2)}
    df = papers(spark, (profile(title="Pix2Vox: Context-aware ３D Reconstruction", detected_arxiv_id="1901.11153v2"), ""))
    offers = [("Pix2Vox: Context-Aware 3D reconstruction.", "1901.11153"), ("Formatting Instructions", "1901.11153v2"), ("Pix2Vox: Context-aware 3D Reconstruction", "2401.00001"), (None, None)]
    cols = [identity.enrichment_matches(F.col("profile"), F.lit(t), F.lit(i), F.col("text")).alias(f"c{k}") for k, (t, i) in enumerate(offers)]
    assert list(df.select(*cols).first()) == [True, False, False, True]
    titles = spark.createDataFrame([("ICLR 2024Conference Submissions",), ("Pix2Vox: a  Title Introduction",), (None,)], "t string")
    assert [r[0] for r in titles.select(identity.clean_title(F.col("t"))).collect()] == ["ICLR 2024 Conference Submissions", "Pix2Vox: a Title", ""]


def test_hash_counts_utf16_units(spark):
    from lectern.functions.text import fnv1a

    text = "a\U0001f600é" * 3

    def plain(x):
        h, units = 2166136261, x.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}:{len(units) // 2}"

    assert spark.createDataFrame([(text,)], "t string").select(fnv1a(F.col("t"))).first()[0] == plain(text)


def test_evidence_in_all_forms(spark):
    sources = spark.createDataFrame([(1, "The atten-\ntion ｍodel ﬁts."), (2, None), (3, "the")], "k int, text string")
    quotes = spark.createDataFrame([(1, "attention model fits"), (1, "atten tion"), (1, "ntion mod"), (1, "fit"), (1, "nothing else"), (2, "attention"), (3, "the"), (4, "no source"), (1, None)], "k int, quote string")
    got = {(r.k, r.quote): r.held for r in ground.validated(quotes, sources, "k").collect()}
    assert {k for k, v in got.items() if v} == {(1, "attention model fits"), (1, "atten tion"), (1, "ntion mod")} and len(got) == 9


def test_found_anywhere_is_whole(spark):
    """Against a plain search of all quotes in all texts."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "de", "epsilon", "zeta1", "eta"]
    texts = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(30)]
    asked = [t[i : i + rnd.choice((4, 5, 7, 12, 30, 60))] for t in texts[:10] for i in (0, 3, 11, 50)] + ["absent words of no text", "zz", ""]
    norm = lambda x: " ".join(x.split())
    got = {tuple(r) for r in ground.found_anywhere(spark.createDataFrame(list(enumerate(asked)), "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {(i, d) for i, q in enumerate(asked) if len(norm(q)) >= 4 for d, t in enumerate(texts) if norm(q) in norm(t)}


def test_page_map_and_placement(spark):
    rows = [(1, 1, "figure", "2", 5, "A caption"), (1, 2, "figure", "2", 0, ""), (1, 3, "figure", "", 7, "x"), (1, 4, "table", "A", None, None)]
    got = {(r.type, r.number): (r.page, r.caption) for r in assets.page_map(spark.createDataFrame(rows, "doc_id int, seq int, type string, number string, page int, caption string")).collect()}
    assert got == {("figure", "2"): (5, "A caption"), ("table", "a"): (None, None)}
    df = spark.createDataFrame([("theorem and proof", "figure", None), ("attention map", "figure", None), ("rate distortion", "figure", ""), ("x", "table", "theory"), ("x", "figure", "Results")], "t string, k string, told string")
    assert [r[0] for r in df.select(classify.placement(F.col("t"), F.col("k"), F.col("told"))).collect()] == ["method", "theory", "results", "results", "results"]


def test_ranking_in_rows_equals_windows(spark):
    rnd = random.Random(9)
    line = lambda: " ".join(rnd.choice(["model", "method", "accuracy", "dataset", "loss", "the", "figures extracted"]) for _ in range(rnd.randint(3, 25))) + "."
    heads = ["# Abstract", "## 1. Introduction", "## 2 Method", "## Results", "## References", "## Conclusion", "plain"]
    docs = spark.createDataFrame([(d, "\n".join(x for h in rnd.sample(heads, rnd.randint(0, 7)) for x in [h, *[line() for _ in range(rnd.randint(0, 9))]])) for d in range(12)] + [(12, None), (13, "")], "doc_id int, text string")
    by_window = retrieve.top_chunks(retrieve.scored(retrieve.chunks(docs, 400), retrieve.tasks(spark)))
    cols = ["doc_id", "task_id", "rank", "idx", "score", "chunk_id", "heading", "part", "text"]
    want = sorted(map(tuple, by_window.select(*cols).collect()))
    assert sorted(map(tuple, retrieve.top_in_rows(docs, 400).select(*cols).collect())) == want and want
    plan = retrieve.top_in_rows(docs, 400)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    cols = ["doc_id", "task_id", "pos", "chunk_id", "text", "original_chars"]
    shares = revise.fair_shares_in_rows(retrieve.selected_in_rows(docs, 400), retrieve.task_list(), 900)
    assert sorted(map(tuple, shares.select(*cols).collect())) == sorted(map(tuple, revise.fair_shares(by_window, retrieve.tasks(spark), 900).select(*cols).collect()))


def test_formula_candidates(spark):
    from lectern.operators import geometry

    lines = "array<struct<text:string,x:double,y:double,width:double,height:double>>"
    body = [("E = a + b", 100.0, 300.0, 120.0, 12.0), (None, 1.0, 300.0, 5.0, 5.0), ("(3)", 390.0, 301.0, 16.0, 12.0)]
    pages = [(1, 1, body), (2, 1, []), (3, 1, None), (4, 1, [("(3)", 390.0, 301.0, 16.0, 12.0)]), (5, 1, [("See https://a.b = c + d (3)", 10.0, 10.0, 90.0, 9.0)])]
    got = geometry.formula_candidates(spark.createDataFrame(pages, f"doc_id int, page int, lines {lines}")).collect()
    assert [(r.doc_id, r.text, r.equation_number, r.x, r.width) for r in got] == [(1, "E = a + b (3)", "3", 100.0, 306.0)]
    # a line of the other column, and one after a line that isn't part of an equation, stay out
    core = [("We define the objective of it", 42.0, 100.0, 240.0, 10.0), ("L = log p(x)", 60.0, 120.0, 150.0, 10.0), ("M = n(o)", 340.0, 128.0, 90.0, 10.0), ("and so on.", 60.0, 134.0, 100.0, 10.0), ("+ R(x)", 60.0, 148.0, 80.0, 10.0)]
    got = geometry.formula_candidates(spark.createDataFrame([(1, 1, core)], f"doc_id int, page int, lines {lines}")).collect()
    assert [(r.text, r.confidence, r.height) for r in got] == [("L = log p(x)", "core-unnumbered-equation", 10.0)]


def test_report_says_whether_all_passed(spark, tmp_path):
    import json

    from lectern.sources import files

    cases = spark.createDataFrame([("a", True), ("b", False)], "name string, passed boolean")
    of = lambda n: spark.createDataFrame([(2, n)], "n_cases long, n_passed long")
    assert not files.write_report(cases, of(1), str(tmp_path / "r")) and files.write_report(cases, of(2), str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r" / "cases").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((x["name"], x["passed"]) for x in lines) == [("a", True), ("b", False)]


def test_untrusted_json(spark):
    """Nulls, other kinds, long texts and too long lists; broken rows stand aside with their other columns."""
    import json

    from lectern.functions import predicates
    from lectern.operators import coerce

    long = "A sentence of some length that says a thing. " * 80
    rows = [(1, json.dumps([{"name": "n" * 200, "caption": long, "assets": [{"url": f"u{i}", "path": "p" * 300} for i in range(9)]}] * 4)), (2, "null"), (3, None), (4, "[1"), (5, "[[]]"), (6, '"text"')]
    good, bad = coerce.parsed(spark.createDataFrame(rows, "id int, json string"), "json")
    got = {r.id: r.f for r in good.select("id", coerce.figures(F.col("v"), 3).alias("f")).collect()}
    assert {r.id for r in bad.collect()} == {3, 4} and bad.columns == ["id", "json"]
    assert len(got[1]) == 3 and got[1][0].name == "n" * 160 + "..." and len(got[1][0].assets) == 6 and len(got[1][0].assets[0].path) == 243 and 0 < len(got[1][0].caption) < len(long)
    assert got[2] == [] and got[6] == [] and [x.name for x in got[5]] == ["Figure 1"]
    urls = spark.createDataFrame([(" https://doi.org/10.1/x ",), ("http://doi.org/x",), ("HTTPS://arXiv.org/abs/1",), (None,), ("data:image/svg+xml;base64,AA",), ("DATA:image/webp;base64,AA",)], "u string")
    assert [tuple(r) for r in urls.select(predicates.paper_url(F.col("u")), predicates.image_data_url(F.col("u"))).collect()] == [("https://doi.org/10.1/x", False), ("", False), ("HTTPS://arXiv.org/abs/1", False), ("", False), ("", False), ("", True)]

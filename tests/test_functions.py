from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.functions import text as T
from lectern.operators import evaluate, retrieve


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_sentences_keep_decimals_and_abbreviations(spark):
    got = one(spark, T.sentences(F.col("t")), t="We get 28.4 points. It works et al. too.")
    assert got == ["We get 28.4 points.", "It works et al. too."]


def test_numbers_keep_percent(spark):
    assert one(spark, T.numbers(F.col("t")), t="84.2% of 12 and x9") == ["84.2%", "12"]


def test_identity_parts(spark):
    assert one(spark, T.doi(F.col("t")), t="see 10.1145/12345.678.") == "10.1145/12345.678"
    assert one(spark, T.doi(F.col("t")), t="10.1145/nnnnnnn.nnnnnnn") is None
    assert one(spark, T.arxiv_id(F.lit("2401.01234v2.pdf"), F.col("t")), t="") == "2401.01234v2"
    assert one(spark, T.arxiv_id(F.lit(""), F.col("t")), t="v1" + "arXiv: 2401.01234"[::-1]) == "2401.01234"
    assert one(spark, T.arxiv_id(F.lit(""), F.col("t")), t="costs 2401.01234 a year") is None
    assert one(spark, T.fnv1a(F.col("t")), t="a") == "e40c292c:1"
    assert one(spark, T.titles_agree(F.lit("Sparse Attention"), F.col("t")), t="sparse  attention!") is True
    assert one(spark, T.titles_agree(F.lit("Sparse Attention for All"), F.col("t")), t="Other") is False


def test_headings(spark):
    for line, want in (("# Method", "Method"), ("1 Introduction", "1 Introduction"), ("2 Method", "2 Method"), ("3) method", "3) method"), ("2 our method", "2 our method"), ("Abstract:", "Abstract"), ("Root causes.", "Root causes"), ("Method text.", ""), ("2 apples", ""), ("x" * 150, "")):
        assert one(spark, P.heading(F.col("t")), t=line) == want, line


def test_empty_sets_and_quirks(spark):
    assert one(spark, P.percent(F.lit(0), F.col("n")), n=0) == 100.0
    assert one(spark, P.f1(F.lit(0.0), F.col("r")), r=0.0) == 100.0
    assert one(spark, P.f1_strict(F.lit(0.0), F.col("r")), r=0.0) == 0.0
    loose, exact = evaluate.asset_recall(F.col("a"), F.array(F.lit("figure 1")))
    row = spark.range(1).select(F.array(F.lit("figure 10")).alias("a")).select(loose.alias("l"), exact.alias("e")).first()
    assert (row.l, row.e) == (100.0, 0.0)


def test_json_and_cleaning(spark):
    assert one(spark, T.lenient_json(F.col("t"), "a int"), t='```json\n{"a": 3}\n```').a == 3
    assert one(spark, T.lenient_json(F.col("t"), "a int"), t='answer: {"a": 4} thanks').a == 4
    assert one(spark, T.escape_html(F.col("t")), t="<a&\"'>") == "&lt;a&amp;&quot;&#039;&gt;"
    assert one(spark, T.unescape_xml(F.col("t")), t="&lt;a&gt;") == "<a>"
    assert one(spark, T.redacted(F.col("t")), t="key sk-abc123 used") == "key [redacted] used"
    assert one(spark, T.archive_path(F.col("t")), t="./a/../b\\c.png") == "a/b/c.png"
    assert one(spark, T.page_of(F.col("t")), t="Uploaded PDF, page 4") == 4


def test_field_issues(spark):
    assert one(spark, P.field_issues(F.lit("method"), F.col("t")), t="") == ["method is missing"]
    assert one(spark, P.field_issues(F.lit("method"), F.col("t")), t="Figure 3 shows the overall design.") == ["method is a caption, not a conclusion"]
    assert "method trails off" in one(spark, P.field_issues(F.lit("method"), F.col("t")), t="We train a model that is compared with")


def test_compressed_is_a_subsequence_within_budget(spark):
    text = "Alpha one. The best sentence here. Gamma three is rather long and dull. The end."
    got = one(spark, retrieve.compressed(F.col("t"), F.array(F.lit("the")), 45), t=text)
    assert len(got) <= 45 and got == "Alpha one.\nThe best sentence here.\nThe end."  # the long one is skipped, what follows isn't
    assert one(spark, retrieve.compressed(F.col("t"), F.array(F.lit("the")), 100), t=f" {text} ") == text


def test_round_budgets(spark):
    assert one(spark, P.round_budget(F.lit(6500), F.col("r")), r=6) == 29000
    assert one(spark, P.round_chunks(F.lit(5), F.col("r")), r=6) == 18


def test_readable_math(spark):
    """Indices never nest, what stands under an expectation is escaped only, and text without a formula is escaped."""
    from lectern.functions import spans

    forms = {
        "min_G E_{x~p_data(x)}[D(x|y)]": '<span class="math-operator">min</span><sub>G</sub> <span class="math-expectation">𝔼</span><sub>x∼p_data(x)</sub>[D(x∣y)]',
        "X_fake = G(c, z)": "X_fake <wbr>= G(c, z)".replace("X_fake", "X<sub>fake</sub>"),
        "x^{2} + y^10": "x<sup>2</sup> <wbr>+ y<sup>10</sup>",
        "<b> 'q'": "&lt;b&gt; &#039;q&#039;",
        "": "",
    }
    df = spark.createDataFrame([*forms.items(), (None, "")], "x string, html string")
    assert [r for r in df.select("html", spans.readable_math(df.x).alias("got")).collect() if r.html != r.got] == []

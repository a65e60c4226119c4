"""Queries of what is read from and written to other programs: feeds, event lines, documents of papers, LaTeX as running text, first-page ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assets as A
from ..operators import coerce, geometry
from ..sources import files
from .base import query, table

_WORDS = "trim(regexp_replace({}(coalesce(text, ''), 1, 400), '[^A-Za-z]+', ' '{}))"
_SQL_WORDS, _SPARK_WORDS = _WORDS.format("substr", ", 'g'"), _WORDS.format("substr", "")


@query("""SELECT '24' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.0000' || k AS arxiv_id, CASE k WHEN 1 THEN 'Title of ' || doc_id || ' in parts' ELSE 'Other: a & b' END AS title FROM documents, range(1, 3) r(k)""")
def atom_feed(spark, d):
    """Two entries of a feed a document, with name spaces, versions and wrapped titles."""
    i = F.col("doc_id").cast("string")
    stem = F.concat(F.lit("<id>http://arxiv.org/abs/24"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(".0000"))
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://arxiv.org/schemas/atom"><title>All</title><entry>'), stem, F.lit("1v3</id><title>Title of "), i, F.lit("\n   in parts</title></entry><entry>"),
        stem, F.lit("2</id><title> Other: a &amp; b </title></entry></feed>"),
    )
    return files.atom_entries(table(spark, d, "documents").select(xml.alias("xml")))


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def event_json(spark, d):
    """An event a line."""
    return files.event_lines(table(spark, d, "events").select("event_id", "event_type"))


@query("""SELECT doc_id::VARCHAR AS paper_id, '# Paper ' || doc_id || CASE WHEN doc_id % 3 > 0 THEN chr(10) || chr(10) || '## Reliable formulas' || chr(10) || '- a = b' || CASE WHEN doc_id % 3 = 2 THEN chr(10) || '- c' ELSE '' END ELSE '' END
|| CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Tables extracted' || chr(10) || '- T ' || doc_id ELSE '' END || CASE WHEN text IS NOT NULL THEN chr(10) || chr(10) || text ELSE '' END AS text FROM documents""")
def paper_documents(spark, d):
    """Papers as one Markdown text each; lists that are empty leave no heading."""
    i, none = F.col("doc_id").cast("string"), F.array().cast("array<string>")
    made = table(spark, d, "documents").select(
        i.alias("paper_id"), F.concat(F.lit("Paper "), i).alias("title"), F.slice(F.array(F.lit("a = b"), F.lit("c")), 1, (F.col("doc_id") % 3).cast("int")).alias("formulas"), none.alias("figures"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("T "), i))).otherwise(none).alias("tables"), F.col("text").alias("body"),
    )
    return files.paper_document(made)


_TEX = r"""concat('\\documentclass{a} left out\n\\begin{document}\n\\section{Intro ', doc_id, '}\nSome \\textbf{bold} 100\\% text % note\n\\begin{figure*}x\\end{figure*}\nmore \\cite{k}', {words}, '.\n\\subsection*{Deep}\nEnd {group}.')"""


@query(f"SELECT doc_id, '## Intro ' || doc_id || chr(10) || chr(10) || 'Some bold 100' || chr(92) || '% text % note' || chr(10) || chr(10) || 'more k' || {_SQL_WORDS} || '.' || chr(10) || chr(10) || '## Deep' || chr(10) || chr(10) || 'End group.' AS plain, trim('Some bold word~here ' || {_SQL_WORDS}) AS inline FROM documents")
def tex_text(spark, d):
    """LaTeX around each document's first words as running text, and a line of it."""
    tex = _TEX.replace("{words}", _SPARK_WORDS).replace("doc_id", "cast(doc_id as string)")
    inline = "concat('Some \\\\textbf{bold} word~here\\\\cite{a,b} ', " + _SPARK_WORDS + ")"
    return table(spark, d, "documents").select("doc_id", T.tex_plain(F.expr(tex)).alias("plain"), T.tex_inline(F.expr(inline)).alias("inline"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') WHEN 1 THEN '2402.01234v2' END AS arxiv_id, CASE doc_id % 4 WHEN 0 THEN '10.1234/meta.' || doc_id WHEN 2 THEN '10.1234/page.' || doc_id END AS doi FROM documents""")
def first_page_ids(spark, d):
    """Ids from file names, metadata and first pages: a file's name before all, metadata's DOI before the page's, never a placeholder."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("x-2401."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit(".pdf"))).otherwise("paper.pdf")
    metadata = F.when(k == 0, F.concat(F.lit("doi:10.1234/Meta."), i)).when(k == 3, "doi 10.5555/nnnnnnn.nnnnnnn")
    page = F.when(k == 2, F.concat(F.lit("see https://doi.org/10.1234/page."), i, F.lit("."))).when(k == 0, "arXiv:2312.00001 10.1234/other").when(k == 1, "arXiv:2402.01234v2 [cs]").otherwise("nothing")
    made = table(spark, d, "documents").select("doc_id", geometry.primary_identity(metadata, name, page).alias("p"))
    return made.select("doc_id", "p.arxiv_id", "p.doi")


@query("SELECT doc_id, doc_id % 4 <> 0 AS needed FROM documents")
def figure_backfill(spark, d):
    """Whether a text speaks of figures that weren't parsed, or one has no artwork."""
    k = F.col("doc_id") % 4
    spoken = F.concat(F.coalesce(F.regexp_replace("text", "(?i)fig", "f"), F.lit("")), F.when(k == 1, " as Figure 3a and fig. 2 show").otherwise(" as FIGURE 1 and Fig. 2B show"))
    numbers = F.when(k == 2, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2b"), F.lit("2")))
    return table(spark, d, "documents").select("doc_id", A.needs_backfill(spoken, numbers, k == 3).alias("needed"))


#: JSON of figures and tables by doc_id % 6 (@: the document's number), and what must come of it: name, source, caption, number of assets and first address; null where it isn't JSON.
_FIGURE_JSON = [
    '["Fig @", "", 7]',
    '[{"name": " A  figure @ ", "source": ["x", " y ", ""], "caption": "What it shows.", "assets": [{"url": " https://a.b/@ "}, {"url": ""}, {"type": "t"}, "no"]}]',
    '[{"name": 5, "caption": {"a": "one", "b": "two"}, "assets": {"url": "u"}}]',
    '{"name": "no list"}',
    'not JSON @ [',
    '[{"assets": [{"url": "data:image/png;base64,AA  @"}, {"url": "1"}, {"url": "2"}, {"url": "3"}, {"url": "4"}, {"url": "5"}, {"url": "6"}]}, null, "third", "fourth"]',
]
_FIGURE_ROWS = [
    [("Fig @", "Original paper figure placeholder", None, 0, None), ("Figure 2", "Original paper figure placeholder", None, 0, None), ("Figure 3", "Original paper figure placeholder", "", 0, None)],
    [("A figure @", "x; y", "What it shows.", 1, "https://a.b/@")],
    [("Figure 1", "Original paper figure placeholder", "one; two", 0, None)],
    [],
    [],
    [("Figure 1", "Original paper figure placeholder", "", 6, "data:image/png;base64,AA  @"), ("Figure 2", "Original paper figure placeholder", "", 0, None), ("third", "Original paper figure placeholder", None, 0, None)],
]


def _text_sql(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else "replace('" + x.replace("'", "''") + "', '@', doc_id::VARCHAR)"


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, {i} AS idx, {_text_sql(n)} AS name, {_text_sql(s)} AS source, {_text_sql(c)} AS caption, {k} AS n_assets, {_text_sql(u)} AS url FROM documents WHERE doc_id % 6 = {case}"
        for case, rows in enumerate(_FIGURE_ROWS) for i, (n, s, c, k, u) in enumerate(rows)
    )
)
def coerced_figures(spark, d):
    """Untrusted JSON of figures, three of each list at most."""
    json = F.replace(F.element_at(F.array(*[F.lit(x) for x in _FIGURE_JSON]), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("@"), F.col("doc_id").cast("string"))
    good, _ = coerce.parsed(table(spark, d, "documents").select("doc_id", json.alias("json")), "json")
    made = good.select("doc_id", F.posexplode(coerce.figures(F.col("v"), 3)).alias("idx", "f"))
    return made.select("doc_id", "idx", "f.name", "f.source", "f.caption", F.size("f.assets").alias("n_assets"), F.get("f.assets", F.lit(0))["url"].alias("url"))


_TABLE_JSON = """[{"name": "Table 12: x@", "caption": "C", "rows": [["a", 1, "b"], "no", [" c  d "]], "image": {"url": "i@"}, "pdfCrop": {"url": "p", "tableNumber": 0}}, {"pdfCrop": {"url": "q", "tableNumber": "7"}}, {"source": "s", "image": {"path": "x"}}]"""
_TABLE_ROWS = [("Table 12: x@", "Original paper artwork", "i@", "image/png", 12, "a,,b||c d"), ("Table 2", "Original paper artwork", None, None, 7, ""), ("Table 3", "s", None, None, None, "")]


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, {i} AS idx, {_text_sql(n)} AS name, {_text_sql(s)} AS source, {_text_sql(u)} AS url, {_text_sql(t)} AS type, {'NULL' if k is None else k}::DOUBLE AS table_number, {_text_sql(r)} AS cells FROM documents WHERE doc_id % 2 = 0"
        for i, (n, s, u, t, k, r) in enumerate(_TABLE_ROWS)
    )
    + " UNION ALL SELECT doc_id, -1, 'broken', NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 2 = 1"
)
def coerced_tables(spark, d):
    """Untrusted JSON of tables, beside the rows that aren't JSON."""
    json = F.when(F.col("doc_id") % 2 == 0, F.replace(F.lit(_TABLE_JSON), F.lit("@"), F.col("doc_id").cast("string"))).otherwise("{broken")
    good, bad = coerce.parsed(table(spark, d, "documents").select("doc_id", json.alias("json")), "json")
    made = good.select("doc_id", F.posexplode(coerce.tables(F.col("v"), 5)).alias("idx", "t"))
    cells = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), "|")
    none = F.lit(None).cast("string")
    aside = bad.select("doc_id", F.lit(-1).alias("idx"), F.lit("broken").alias("name"), none.alias("source"), none.alias("url"), none.alias("type"), F.lit(None).cast("double").alias("table_number"), none.alias("cells"))
    return made.select("doc_id", "idx", "t.name", "t.source", "t.image.url", "t.image.type", "t.pdf_crop.table_number", cells.alias("cells")).union(aside)

"""Queries of pages, quotes and evidence, over the papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..functions.arrays import once
from ..operators import ground
from .base import PAPERS, collapse_sql, export_sentences_sql, key_sql, md5, papers, query, spread, strip_sql, table

_X = "replace(text, chr(13), '')"
PAGES = f"""pages AS (SELECT doc_id, unnest(CASE WHEN len(n) = 0 THEN [{{'page': NULL::INT, 'k': 0, 'text': {_X}}}] ELSE list_transform(range(1, len(n) + 1), lambda i: {{'page': n[i]::INT, 'k': i, 'text': p[i + 1]}}) END, recursive := true)
 FROM (SELECT doc_id, text, regexp_extract_all({_X}, '{E.PAGE_MARK}', 1) AS n, regexp_split_to_array({_X}, '{E.PAGE_MARK}') AS p FROM papers))"""
_ENDED = "'[^.!?。！？]+[.!?。！？]?'"
_WORDS = "'" + "','".join(T.STOP_WORDS) + "'"


def tokens_sql(key: str) -> str:
    return f"list_distinct(list_filter(string_split({key}, ' '), lambda t: length(t) >= 4 AND t NOT IN ({_WORDS})))"


SOURCE = f"""{PAPERS}, {PAGES},
stretches AS (SELECT doc_id, page, k, unnest(list_transform(regexp_extract_all({collapse_sql("regexp_replace(text, '(?m)^#{1,6}\\s+.*$', ' ', 'g')")}, {_ENDED}), lambda s: {strip_sql("s")})) AS quote, generate_subscripts(regexp_extract_all({collapse_sql("regexp_replace(text, '(?m)^#{1,6}\\s+.*$', ' ', 'g')")}, {_ENDED}), 1) AS i FROM pages),
source AS (SELECT doc_id, page, quote, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS pos FROM stretches WHERE length(quote) BETWEEN 36 AND 700 AND NOT regexp_matches(quote, '{E.MERGED}') AND NOT regexp_matches(quote, '{E.CAPTION}') AND NOT regexp_matches(quote, '(?i)\\b(?:references|bibliography)\\b'))"""


@query(f"WITH {PAPERS}, {PAGES} SELECT doc_id, page, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM pages UNION ALL SELECT doc_id, NULL, length(text)::INT, md5(text) FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13), '') AS text FROM documents)")
def paper_pages(spark, d):
    both = papers(spark, d).select("doc_id", "text").unionByName(table(spark, d, "documents").select("doc_id", "text"))  # with marks, and without
    return both.select("doc_id", F.explode(E.pages(F.col("text"))).alias("p")).select("doc_id", "p.page", F.length("p.text").alias("n_chars"), md5(F.col("p.text")).alias("text_md5"))


@query(f"WITH {SOURCE} SELECT doc_id, page, md5(quote) AS quote_md5 FROM source")
def source_sentences(spark, d):
    return papers(spark, d).select("doc_id", F.explode(E.source_sentences(F.col("text"))).alias("s")).select("doc_id", "s.page", md5(F.col("s.quote")).alias("quote_md5"))


#: Quotes around each benchmark item: with leaked headers, fragments, merged sections, broken words and locations of all kinds.
_QUOTES = [
    ("'https://doi.org/10.1234/ab.c-' || item_id || ' ' || text", "'page 3'"),
    ("'org/10.55555/x_y(' || item_id || ') ' || text", "'Method, p. 7'"),
    ("'arXiv:2401.0' || item_id || 'v2 [cs.CL] 12 Jan 2024 ' || text", "''"),
    ("'V.'", "'page 1'"),
    ("'Test cases.'", "'paper context'"),
    ("text || ', shown. Introduction We see'", "'Results'"),
    ("'the three ment of ' || text", "'x'"),
    ("text", "'  task-relevant   retrieved source '"),
    ("'short one'", "'page'"),
    ("'  ' || text || '  '", "'Uploaded PDF page: 12'"),
]
_QUOTED = " UNION ALL ".join(f"SELECT item_id, {i} AS n, {q} AS quote, {w} AS location FROM benchmark" for i, (q, w) in enumerate(_QUOTES))


def _clean_sql(x: str) -> str:
    x = collapse_sql(x)
    for pattern in E.HEADERS:
        x = f"regexp_replace({x}, '{pattern}', '')"
    return strip_sql(x)


_USABLE = "(x <> '' AND " + " AND ".join(f"NOT regexp_matches(x, '{p}')" for p in (*E.FRAGMENTS, E.MERGED)) + ")"
_PAGE = "TRY_CAST(nullif(regexp_extract({}, '(?i)(?:page|p\\.?)[\\s:#-]*(\\d+)', 1), '') AS INT)"
_SHOWN = f"""v AS (SELECT item_id, n, {_clean_sql("quote")} AS x, coalesce(nullif({collapse_sql("location")}, ''), 'Paper context') AS place FROM q),
shown AS (SELECT item_id, n, x AS quote, place AS location, {_PAGE.format("place")} AS page FROM v WHERE NOT regexp_matches(x, '{E.FRAGMENTS[0]}') AND NOT regexp_matches(x, '{E.MERGED}') AND NOT (x <> '' AND (length(x) < 22 OR len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')) < 3)) AND NOT regexp_matches(x, '{E.BROKEN_WORD}'))"""


def _quotes(spark, d):
    items = table(spark, d, "benchmark")
    return items.select("item_id", F.posexplode(F.array(*[F.struct(F.expr(q).alias("quote"), F.expr(w).alias("location")) for q, w in _QUOTES])).alias("n", "q")).select("item_id", "n", "q.quote", "q.location")


@query(f"WITH q AS ({_QUOTED}), c AS (SELECT item_id, n, {_clean_sql('quote')} AS x FROM q) SELECT item_id, n, md5(x) AS clean_md5, {_USABLE} AS usable FROM c")
def quote_cleanup(spark, d):
    x = E.clean_quote(F.col("quote"))
    return _quotes(spark, d).select("item_id", "n", md5(x).alias("clean_md5"), E.usable_quote(x).alias("usable"))


@query(f"WITH q AS ({_QUOTED}), {_SHOWN} SELECT item_id, n, md5(quote) AS quote_md5, location, page FROM shown")
def viewer_items(spark, d):
    v = _quotes(spark, d).select("item_id", "n", E.viewer_item(F.col("quote"), F.col("location")).alias("v")).filter("v is not null")
    return v.select("item_id", "n", md5(F.col("v.quote")).alias("quote_md5"), "v.location", "v.page")


@query(f"""WITH q AS ({_QUOTED} UNION ALL SELECT item_id, n + 10, quote, location FROM ({_QUOTED})), {_SHOWN},
f AS (SELECT item_id, min(n) AS n, lower(quote || '|' || location) AS sign FROM shown GROUP BY item_id, sign), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n) AS rn FROM f)
SELECT item_id, n, md5(sign) AS sign_md5 FROM r WHERE rn <= 4""")
def section_items(spark, d):
    grouped = _quotes(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n", "quote", "location"))).alias("q"))  # ten an item
    kept = grouped.select("item_id", E.section_items(F.concat("q", "q")).alias("kept"), "q")
    numbered = kept.select("item_id", F.explode("kept").alias("k"), "q").withColumn("n", F.get(F.filter("q", lambda i: E.viewer_item(i["quote"], i["location"]) == F.col("k")), F.lit(0))["n"])
    return numbered.select("item_id", "n", md5(F.lower(F.concat_ws("|", "k.quote", "k.location"))).alias("sign_md5"))


# Each paper is asked for two passages: what its method section's first lines are about, and its results.
_ASKED = ["'The architecture introduces a novel training objective and improves accuracy of ' || coalesce(source, '')", "'accuracy on the main dataset: the baseline model reaches results of ' || coalesce(lang, '')"]


@query(f"""WITH {SOURCE}, a AS (SELECT doc_id, unnest([{", ".join(_ASKED)}]) AS query, unnest([0, 1]) AS q FROM papers),
t AS (SELECT doc_id, q, {tokens_sql(key_sql("query"))} AS wanted FROM a),
j AS (SELECT s.doc_id, q, page, quote, pos, {key_sql("quote")} AS key, wanted FROM source s JOIN t USING (doc_id)),
k AS (SELECT *, len(list_intersect(wanted, {tokens_sql("key")})) AS shared, 3 * len(list_intersect(wanted, {tokens_sql("key")})) + CASE WHEN len(list_filter(wanted, lambda t: length(t) >= 8 AND contains(key, t))) > 0 THEN 2 ELSE 0 END AS score FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q, key ORDER BY score DESC, length(quote), pos) AS first FROM k WHERE shared >= 2 AND score >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q ORDER BY score DESC, length(quote), pos) AS rank FROM f WHERE first = 1)
SELECT doc_id, q, rank::INT AS rank, score::INT AS score, page, md5(quote) AS quote_md5 FROM r WHERE rank <= 3""")
def grounded_excerpts(spark, d):
    s = once(papers(spark, d), "asked", F.array(*[E.tokens(F.expr(a)) for a in _ASKED]))
    s = once(s, "s", E.with_tokens(E.source_sentences(F.col("text"), F.col("asked"))))
    found = once(s, "found", F.transform("asked", lambda wanted: E.excerpts(F.col("s"), wanted))).select("doc_id", F.posexplode("found").alias("q", "e"))
    found = found.select("doc_id", "q", F.posexplode("e").alias("rank", "e"))
    return found.select("doc_id", "q", (F.col("rank") + 1).alias("rank"), "e.score", "e.page", md5(F.col("e.quote")).alias("quote_md5"))


#: Quotes of a paper with locations: part of a sentence, one with words changed, one that goes on, one from nowhere.
_ITEMS = [
    ("'introduces a novel training objective for ' || coalesce(source, '')", "'paper context'"),
    ("'The accuracy of the ' || coalesce(lang, '') || ' model was ' || doc_id || '.5% on the main dataset; however, one baseline reaches 84.2%'", "'Results section'"),
    ("'existing models cannot scale, because their memory is limited w.r.t. the input and so on'", "'Intro, page 9'"),
    ("'Nothing of the kind is said in this paper at all, whatever its source'", "'retrieved source'"),
    ("'V.'", "'x'"),
]
_KEYED = f"""{PAPERS}, {PAGES}, u AS (SELECT doc_id, page, k, unnest({export_sentences_sql("text")}) AS sentence, generate_subscripts({export_sentences_sql("text")}, 1) AS i FROM pages),
keyed AS (SELECT doc_id, page, sentence, {key_sql("sentence")} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS pos FROM u WHERE {key_sql("sentence")} <> '')"""
_GIVEN = " UNION ALL ".join(f"SELECT doc_id, {i} AS n, {q} AS quote, {w} AS location FROM papers" for i, (q, w) in enumerate(_ITEMS))
_2PLUS = "list_distinct(regexp_extract_all({}, '[a-z0-9]{{2,}}'))"
_FOUND = f"""g AS (SELECT doc_id, n, {_clean_sql("quote")} AS quote, location, {key_sql(_clean_sql("quote"))} AS q_key FROM ({_GIVEN})),
b AS (SELECT g.*, page, sentence, pos, key, contains(key, q_key) OR strpos(q_key, key) BETWEEN 1 AND 33 AS exact, abs(length(key) - length(q_key)) AS off, len(list_intersect({_2PLUS.format("key")}, {_2PLUS.format("q_key")})) AS shared,
 greatest(1, least(len({_2PLUS.format("key")}), len({_2PLUS.format("q_key")}))) AS smaller, len(list_filter(range(1, 128), lambda i: i <= least(length(key), length(q_key)) AND left(key, i) = left(q_key, i))) AS prefix FROM g JOIN keyed USING (doc_id) WHERE length(q_key) >= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY exact DESC, CASE WHEN exact THEN off END, CASE WHEN NOT exact THEN shared / smaller * 100 + least(20.0, prefix / 6) END DESC, CASE WHEN NOT exact THEN shared END DESC, pos) AS rn FROM b WHERE exact OR (shared >= 8 AND (shared / smaller >= 0.58 OR prefix >= 64))),
found AS (SELECT g.doc_id, g.n, g.quote, g.location, o.page, o.sentence FROM g LEFT JOIN o ON o.doc_id = g.doc_id AND o.n = g.n AND o.rn = 1)"""


def _found(spark, d):
    """All quotes of each paper with the sentence found, within the row."""
    # the keys need an Arrow function, so they are made before anything goes through the sentences
    item = lambda i, q, w: F.struct(F.lit(i).alias("n"), E.clean_quote(F.expr(q)).alias("quote"), F.expr(w).alias("location"), E.evidence_key(E.clean_quote(F.expr(q))).alias("key"))
    made = once(papers(spark, d).withColumn("items", F.array(*[item(i, q, w) for i, (q, w) in enumerate(_ITEMS)])), "s", E.keyed_sentences(F.col("text")))
    told = lambda i: F.struct(i["n"].alias("n"), i["quote"].alias("quote"), i["location"].alias("location"), E.find_sentence(i["key"], F.col("s")).alias("found"))
    return made.select("doc_id", F.inline(F.transform("items", told)))


@query(f"WITH {_KEYED}, {_FOUND} SELECT doc_id, n, page, md5(sentence) AS sentence_md5 FROM found WHERE sentence IS NOT NULL")
def fuzzy_align(spark, d):
    return _found(spark, d).filter("found is not null").select("doc_id", "n", "found.page", md5(F.col("found.sentence")).alias("sentence_md5"))


@query(f"""WITH {_KEYED}, {_FOUND}, l AS (SELECT doc_id, n, quote AS x, {strip_sql("coalesce(sentence, quote)")} AS y, {collapse_sql("location")} AS raw, page FROM found)
SELECT doc_id, n, md5(left(y, 520)) AS quote_md5, left(CASE WHEN page IS NULL THEN raw WHEN regexp_matches(raw, '{E.GENERIC_LOCATION}') THEN 'Uploaded PDF, page ' || page WHEN {_PAGE.format("raw")} IS NOT NULL THEN raw ELSE raw || ', page ' || page END, 160) AS location FROM l WHERE {_USABLE} AND NOT regexp_matches(y, '{E.MERGED}')""")
def located_evidence(spark, d):
    v = _found(spark, d).select("doc_id", "n", E.located(F.col("quote"), F.col("location"), F.col("found")).alias("e")).filter("e is not null")
    return v.select("doc_id", "n", md5(F.col("e.quote")).alias("quote_md5"), "e.location")


@query(f"""SELECT conv_id, turn, md5(left(CASE WHEN length(core) >= 80 THEN core ELSE coalesce(text, '') || ' ' || role END, 900)) AS query_md5 FROM (SELECT *, {strip_sql(f"array_to_string((CASE WHEN len(regexp_extract_all({collapse_sql('text')}, {_ENDED})) > 0 THEN regexp_extract_all({collapse_sql('text')}, {_ENDED}) ELSE [{collapse_sql('text')}] END)[1:2], ' ')")} AS core FROM conversations)""")
def section_queries(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", md5(E.section_query(F.col("text"), F.array("text", "role"))).alias("query_md5"))


#: Broken words, wide and joined letters after each document's text; and quotes of all kinds with whether they are held.
_BROKEN = "concat(coalesce(text, ''), chr(10), 'The atten-', chr(10), 'tion mecha- nism of doc', doc_id, ' has \uff46\uff55\uff4c\uff4c \ufb01ne forms, co-', chr(10), 'Author notes.')"
_CHECKED = [
    ("'attention mechanism of'", True), ("'Atten- tion mecha-'", True), ("'ion mechanism of doc'", True), ("'full fine forms'", True), ("'\uff26ull'", True), ("'coauthor notes'", False), ("'co author'", True), ("concat('doc', doc_id, ' has')", True),
    ("concat('doc', doc_id + 1, ' has')", False), ("'atten mechanism'", False), ("'of'", False), ("null", False), ("'\u201cforms\u201d'", True),
]


@query("SELECT doc_id, n, CASE n " + " ".join(f"WHEN {i} THEN {str(held).lower()}" for i, (_, held) in enumerate(_CHECKED)) + f" END AS held FROM documents, range({len(_CHECKED)}) r(n)")
def evidence_validated(spark, d):
    """Quotes against their own paper, in all forms of both."""
    docs = table(spark, d, "documents")
    quotes = docs.select("doc_id", F.posexplode(F.array(*[F.expr(x).cast("string") for x, _ in _CHECKED])).alias("n", "quote"))
    got = ground.validated(quotes, docs.select("doc_id", F.expr(_BROKEN.replace("doc_id", "cast(doc_id as string)")).alias("text")), "doc_id")
    return got.select("doc_id", F.col("n").cast("long").alias("n"), "held")


_WHERE = ["concat('ion mechanism of doc', doc_id, ' h')", "concat('doc', doc_id)", "concat('of doc', doc_id, ' ha')", "concat('octo', doc_id, ' has full fine for')"]


@query("""WITH q AS (SELECT doc_id * 4 + n AS item_id, doc_id, n FROM documents, range(4) r(n) WHERE doc_id % 100 = 0)
SELECT q.item_id, d.doc_id FROM q JOIN documents d ON d.doc_id = q.doc_id OR n = 1 AND starts_with(d.doc_id::VARCHAR, q.doc_id::VARCHAR) WHERE n < 3""")
def evidence_anywhere(spark, d):
    """Quotes of every hundredth paper looked for in all papers, broken words and parts of words included."""
    docs = spread(table(spark, d, "documents"))
    asked = table(spark, d, "documents").filter("doc_id % 100 = 0").select("doc_id", F.posexplode(F.array(*[F.expr(x.replace("doc_id", "cast(doc_id as string)")) for x in _WHERE])).alias("n", "text")).select((F.col("doc_id") * 4 + F.col("n")).alias("item_id"), "text")
    return ground.found_anywhere(asked, docs.select("doc_id", F.expr(_BROKEN.replace("doc_id", "cast(doc_id as string)")).alias("text")))

"""Queries of sections, chunks, ranking and budgets, over the papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.predicates import HEADING_TERMS, HEADINGS
from ..operators import retrieve
from .base import PAPERS, export_sentences_sql, fallback_sentences_sql, md5, papers, query, sentences_sql, strip_sql

_N = "\\d+(?:\\.\\d+)*[.)]?\\s+"
_HEADING = f"""CASE WHEN length(x) > 140 THEN '' WHEN regexp_matches(x, '^#{{1,6}}\\s+.') THEN {strip_sql("regexp_extract(x, '^#{1,6}\\s+(.+)', 1)")}
 WHEN regexp_matches(x, '(?i)^(?:{_N})?(?:{HEADINGS})\\s*[:.]?$') THEN regexp_replace(x, '[:.]$', '')
 WHEN regexp_extract(x, '^{_N}(.+)$', 1) <> '' AND regexp_matches(regexp_extract(x, '^{_N}(.+)$', 1), '(?i){HEADING_TERMS}') THEN x ELSE '' END"""
_NORMAL = f"""{strip_sql("regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g')")}"""


def sections_sql(text: str) -> str:
    return f"""{PAPERS},
l AS (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM papers),
h AS (SELECT doc_id, i, line, {_HEADING} AS h FROM (SELECT *, {strip_sql("line")} AS x FROM l)),
n AS (SELECT *, sum((h <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
b AS (SELECT doc_id, s, coalesce(max(h) FILTER (h <> ''), 'Paper overview') AS heading, {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h = ''), '')")} AS text FROM n GROUP BY ALL),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section_idx, heading, text FROM b WHERE text <> '')"""


def _last_sql(mark: str, size: int) -> str:
    w = f"left(rest, {size + len(mark)})"
    m = "chr(10)" if mark == "\n" else "chr(10) || chr(10)" if mark == "\n\n" else f"'{mark[::-1]}'"
    return f"(CASE WHEN strpos(reverse({w}), {m}) = 0 THEN -1 ELSE length({w}) - {len(mark)} - strpos(reverse({w}), {m}) + 1 END)"


def chunks_sql(size: int, text: str = _NORMAL) -> str:
    ends = f"list_filter([{_last_sql(chr(10) * 2, size)}, {_last_sql(chr(10), size)}, {_last_sql('. ', size)} + 1], lambda e: e > 300)[1]"
    return f"""WITH RECURSIVE {sections_sql(text)},
r AS (SELECT doc_id, section_idx, heading, 0 AS part, '' AS piece, text AS rest FROM sections
 UNION ALL SELECT doc_id, section_idx, heading, part + 1, {strip_sql("left(rest, cut)")}, {strip_sql("substr(rest, cut + 1)")} FROM (SELECT *, (CASE WHEN length(rest) <= {size} THEN length(rest) ELSE coalesce({ends}, {size}) END)::INT AS cut FROM r WHERE rest <> '')),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_idx, part) - 1)::INT AS idx, 'S' || (section_idx + 1) || 'C' || part AS chunk_id, section_idx::INT AS section_idx, heading, part::INT AS part, piece AS text FROM r WHERE part > 0 AND piece <> '')"""


_KEYWORDS = ", ".join(f"('{t}', {list(dict.fromkeys(retrieve.TASK_KEYWORDS[t] + retrieve.task_words(label, goal)))!r})" for t, label, goal, *_ in retrieve.READING_PLAN)
_TASKS = f"tasks(task_id, keywords) AS (VALUES {_KEYWORDS})"
_REFERENCES = "regexp_matches(heading, '(?i)references|bibliography')"


def _points_sql(points: list) -> str:
    return " + ".join(f"CASE WHEN task_id = '{t}' AND regexp_matches(lower(heading), '{p}') THEN {n} ELSE 0 END" for t, p, n in points)


def _score_sql(first: str, in_heading: int, points: list, references: int) -> str:
    return f"({first} + {in_heading} * len(list_filter(keywords, lambda k: contains(lower(heading), k))) + 2 * len(list_filter(keywords, lambda k: contains(lower(text), k))) + {_points_sql(points)} - CASE WHEN {_REFERENCES} THEN {references} ELSE 0 END)"


SIZE = 500
_FORCED = " OR ".join(f"(task_id = '{t}' AND regexp_matches(heading, '{p}'))" for t, p in retrieve.FORCED.items())
TOP = f"""{chunks_sql(SIZE)}, {_TASKS},
scored AS (SELECT *, ({_score_sql("CASE WHEN idx < 2 THEN 3 - idx ELSE 0 END", 10, retrieve.SECTION_POINTS, 40)} + CASE WHEN regexp_matches(lower(heading || chr(10) || text), '{retrieve.EVIDENCE_LISTS}') THEN 8 ELSE 0 END)::INT AS score FROM chunks, tasks),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, task_id ORDER BY score DESC, idx) AS place, {_FORCED} AS forced FROM scored),
turned AS (SELECT *, CASE WHEN place = 1 THEN 0 WHEN forced AND row_number() OVER (PARTITION BY doc_id, task_id, forced ORDER BY place) = 1 THEN 1 ELSE 2 END AS turn FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, task_id ORDER BY turn, place)::INT AS rank FROM turned WHERE NOT {_REFERENCES}),
top AS (SELECT * FROM ranked WHERE rank <= 5)"""


@query(f"WITH {sections_sql(_NORMAL)} SELECT doc_id, section_idx::INT AS section_idx, heading, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM sections")
def paper_sections(spark, d):
    made = papers(spark, d).select("doc_id", F.posexplode(retrieve.sections(T.paper_text(F.col("text")))).alias("section_idx", "s"))
    return made.select("doc_id", "section_idx", "s.heading", F.length("s.text").alias("n_chars"), md5(F.col("s.text")).alias("text_md5"))


@query(f"{chunks_sql(SIZE)} SELECT doc_id, idx, chunk_id, heading, part, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM chunks")
def chunk_index(spark, d):
    return retrieve.chunks(papers(spark, d), SIZE).select("doc_id", "idx", "chunk_id", "heading", "part", F.length("text").alias("n_chars"), md5(F.col("text")).alias("text_md5"))


def top(spark, d, expanded: bool = False):
    return retrieve.top_in_rows(papers(spark, d), SIZE, expanded)


@query(f"{TOP} SELECT doc_id, task_id, rank, chunk_id, score FROM top")
def retrieve_topk(spark, d):
    return top(spark, d).select("doc_id", "task_id", "rank", "chunk_id", "score")


@query(f"{TOP} SELECT doc_id, task_id, rank, chunk_id, score FROM ranked WHERE rank <= 7")
def retrieve_expanded(spark, d):
    return top(spark, d, True).select("doc_id", "task_id", "rank", "chunk_id", "score")


@query(f"{TOP} SELECT doc_id, chunk_id, max(score)::INT AS score, min(idx)::INT AS idx, count(*) AS n_tasks FROM top GROUP BY ALL")
def best_chunk_global(spark, d):
    return retrieve.best_of_tasks(top(spark, d))


@query(f"{TOP}, z AS (SELECT doc_id, task_id, count(*) AS n_chunks, sum(length(text)) AS n_chars, sum(least(length(text), 200)) AS kept FROM top GROUP BY ALL) SELECT task_id, sum(n_chunks)::BIGINT AS n_chunks, sum(n_chars)::BIGINT AS n_chars, round(sum(kept) / sum(n_chars), 3) AS ratio FROM z GROUP BY 1")
def context_stats(spark, d):
    kept = F.least(F.length("text"), F.lit(200))
    return top(spark, d).groupBy("task_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), retrieve.ratio(F.sum(kept), F.sum(F.length("text"))).alias("ratio"))


@query(f"""{chunks_sql(1800, "text")}, {_TASKS},
scored AS (SELECT *, {_score_sql("CASE WHEN idx < 2 THEN 2 ELSE 0 END", 8, retrieve.EVIDENCE_POINTS, 20)} AS score FROM chunks, tasks),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, task_id ORDER BY score DESC, idx) AS place FROM scored),
e AS (SELECT doc_id, task_id, 0::BIGINT AS place, '' AS chunk_id, '' AS text, 0::BIGINT AS used FROM placed WHERE place = 1
 UNION ALL SELECT e.doc_id, e.task_id, p.place, p.chunk_id, left(p.text, 2000 - e.used), e.used + length(left(p.text, 2000 - e.used)) + length(p.heading) + 40 FROM e JOIN placed p ON p.doc_id = e.doc_id AND p.task_id = e.task_id AND p.place = e.place + 1 WHERE p.place <= 4 AND 2000 - e.used >= 200)
SELECT doc_id, task_id, 'E' || place AS evidence_id, chunk_id, md5(text) AS text_md5 FROM e WHERE place > 0""")
def evidence_budget(spark, d):
    return retrieve.budget_in_rows(papers(spark, d), 2000, size=1800, normal=False).select("doc_id", "task_id", "evidence_id", "chunk_id", md5(F.col("text")).alias("text_md5"))


@query(f"""WITH RECURSIVE {PAPERS}, x AS (SELECT doc_id, {strip_sql("text")} AS text FROM papers), s AS (SELECT doc_id, text, {sentences_sql("text")} AS s FROM x),
u AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i = 0 THEN 3 ELSE 0 END + 4 * (contains(lower(s), 'model')::INT + contains(lower(s), 'the')::INT) + CASE WHEN regexp_matches(s, '(?i)\\d|=|\\\\begin|\\\\end|figure|table|dataset|baseline') THEN 2 ELSE 0 END DESC, i) AS place FROM u),
r AS (SELECT doc_id, 0::BIGINT AS place, 0::BIGINT AS used, 0 AS n, false AS kept, 0::BIGINT AS i, '' AS s FROM x
 UNION ALL SELECT r.doc_id, w.place, CASE WHEN fits THEN r.used + cost ELSE r.used END, r.n + fits::INT, fits, w.i, w.s FROM (SELECT r.*, w.place AS p2, w.i AS i2, w.s AS s2, length(w.s) + CASE WHEN r.n > 0 THEN 1 ELSE 0 END AS cost, r.used + length(w.s) + CASE WHEN r.n > 0 THEN 1 ELSE 0 END <= 300 AS fits FROM r JOIN w ON w.doc_id = r.doc_id AND w.place = r.place + 1) r JOIN w ON w.doc_id = r.doc_id AND w.place = r.p2),
k AS (SELECT doc_id, {strip_sql("coalesce(string_agg(s, chr(10) ORDER BY i), '')")} AS text FROM r WHERE kept GROUP BY 1)
SELECT x.doc_id, md5(CASE WHEN length(x.text) <= 300 THEN x.text ELSE coalesce(k.text, '') END) AS text_md5 FROM x LEFT JOIN k USING (doc_id)""")
def compressed_papers(spark, d):
    return papers(spark, d).select("doc_id", md5(retrieve.compressed(F.col("text"), F.array(F.lit("model"), F.lit("the")), 300)).alias("text_md5"))


_FLAVOURS = {"plain": sentences_sql("text"), "export": export_sentences_sql("text"), "fallback": fallback_sentences_sql("text")}


@query(f"WITH {PAPERS} SELECT doc_id, " + ", ".join(f"len({x})::INT AS n_{n}, md5(array_to_string({x}, '|')) AS {n}_md5" for n, x in _FLAVOURS.items()) + " FROM papers")
def sentence_flavours(spark, d):
    of = {"plain": T.sentences, "export": T.export_sentences, "fallback": T.fallback_sentences}
    made = papers(spark, d).select("doc_id", *[f(F.col("text")).alias(n) for n, f in of.items()])
    return made.select("doc_id", *[c for n in of for c in (F.size(n).alias(f"n_{n}"), md5(F.array_join(n, "|")).alias(f"{n}_md5"))])


@query(f"SELECT conv_id, turn, array_to_string(list_filter({sentences_sql('text')}, lambda s: contains(lower(s), 'the') OR contains(lower(s), 'der'))[1:2], ' ') AS summary FROM conversations")
def keyword_sentences(spark, d):
    from .base import table

    return table(spark, d, "conversations").select("conv_id", "turn", retrieve.keyword_sentences(T.sentences(F.col("text")), ["the", "der"]).alias("summary"))

"""Queries of field rules, formulas and figures in texts, local analysis, extractive answers and paper types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import analysis as A
from ..operators import classify as C
from ..operators import retrieve
from .base import PAPERS, collapse_sql, fallback_sentences_sql, key_sql, md5, papers, query, sentences_sql, strip_sql, table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ rules

#: Answers around each benchmark item that break each of the rules, and some that break none.
_ANSWERS = [
    ("problem", "text"),
    ("problem", "''"),
    ("motivation", "'No clear motivation ' || text"),
    ("method", "'Figure ' || item_id || ' shows ' || text"),
    ("theory", "'It is bounded as in ' || text || ' by Ada et al.'"),
    ("results", "'Results of ' || text || ' are compared with'"),
    ("results", "'The model is better than ' || text || ' compared with.'"),
    ("experiments", "'Experiments on ' || text || ' using'"),
    ("experiments", "'Runs are made, and for the ' || item_id || ' cases.'"),
    ("innovation", "'The work is new if accepted.'"),
    ("logicReview", "'and then ' || text || '.'"),
    ("logicReview", "'iPhone users ' || text || '.'"),
    ("contributions", "'Accuracy rises to ' || item_id || '.5% there in all cases.'"),
    ("contributions", "'All there was and will be there, whatever it is.'"),
    ("contributions", "'We propose a new method for ' || text || '.'"),
    ("title", "'of'"),
    ("method", "'x' || item_id || ':'"),
]


def _answer_sql(field: str, x: str) -> str:
    def rule(r) -> str:
        wrong, excused, what = r
        return f"CASE WHEN regexp_matches(x, {_lit(wrong)})" + (f" AND NOT regexp_matches(x, {_lit(excused)})" if excused else "") + f" THEN field || {_lit(' ' + what)} END"

    unsaid = f"CASE WHEN field = 'contributions' AND NOT regexp_matches(x, {_lit(P.NOVELTY)}) THEN CASE WHEN regexp_matches(x, {_lit(P.RESULT)}) THEN 'contributions reports an experimental result instead of the paper''s novelty' ELSE 'contributions does not state what the paper introduces' END END"
    short = f"CASE WHEN length(x) < CASE WHEN field IN ({', '.join(map(_lit, P.LONG_FIELDS))}) THEN 32 ELSE 18 END THEN field || ' is too short' END"
    return f"CASE WHEN field = 'title' THEN [] WHEN x = '' OR regexp_matches(x, {_lit(P.NO_ANSWER)}) THEN [field || ' is missing'] ELSE list_filter([{short}, {', '.join(rule(r) for r in P.RULES)}, {unsaid}], lambda v: v IS NOT NULL) END"


_ASKED = " UNION ALL ".join(f"SELECT item_id, {i} AS n, '{f}' AS field, {collapse_sql(x)} AS x FROM benchmark" for i, (f, x) in enumerate(_ANSWERS))


@query(f"SELECT item_id, n, len(i)::INT AS n_issues, array_to_string(i, '; ') AS issues FROM (SELECT item_id, n, {_answer_sql('field', 'x')} AS i FROM ({_ASKED}))")
def field_rules(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(x).alias("x")) for f, x in _ANSWERS])).alias("n", "a"))
    i = P.field_issues(F.col("a.field"), F.col("a.x"))
    return asked.select("item_id", "n", F.size(i).alias("n_issues"), F.array_join(i, "; ").alias("issues"))


#: Formulas and what is none, around each item's number.
_FORMULAS = ["'x_' || item_id || ' = y'", "'\\\\author{A' || item_id || '}'", "'only words, here'", "'O(n)'", "'  Θ( n log n ) '", "'O(n) + ' || item_id", "'\\\\frac{a}{b}'", "'f(x, y)'", "'ab'", "'p (x|y)'", "''", "'L' || item_id || ' ≈ 3'"]
_FORMULA_ROWS = " UNION ALL ".join(f"SELECT item_id, {i} AS n, {strip_sql(x)} AS x FROM benchmark" for i, x in enumerate(f.replace("\\\\", "\\") for f in _FORMULAS))


@query(f"SELECT item_id, n, length(x) >= 3 AND NOT regexp_matches(x, {_lit(P.METADATA)}) AND NOT regexp_matches(x, {_lit(P.WORDS_ONLY)}) AND regexp_matches(x, {_lit(P.FORMULA_SIGNS)}) AS plausible, regexp_matches(x, '^(?i:[OΘΩ])\\s*\\([^)]*\\)$') AS complexity, x = '' OR regexp_matches(x, '{P.MISSING}') AS missing FROM ({_FORMULA_ROWS})")
def formula_predicates(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array(*[F.expr(x) for x in _FORMULAS])).alias("n", "x"))
    x = F.col("x")
    return rows.select("item_id", "n", P.plausible_formula(x).alias("plausible"), P.complexity_only(x).alias("complexity"), P.is_missing(x).alias("missing"))


# ------------------------------------------------------------------ formulas, figures, local analysis

_PLAUSIBLE = f"length(f) >= 3 AND NOT regexp_matches(f, {_lit(P.METADATA)}) AND NOT regexp_matches(f, {_lit(P.WORDS_ONLY)}) AND regexp_matches(f, {_lit(P.FORMULA_SIGNS)})"


def formulas_sql(most: int) -> str:
    """formulas(doc_id, f list): what stands between marks, lines with an environment, and inline formulas."""
    lines = f"string_split(left(text, {most}), chr(10))"
    return f"""fl AS (SELECT doc_id, unnest({lines}) AS x, generate_subscripts({lines}, 1) AS i FROM papers), fm AS (SELECT *, {strip_sql("x")} = '$$' AS mark FROM fl),
fc AS (SELECT *, sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM fm),
ff AS (SELECT doc_id, i, {strip_sql(f"CASE WHEN regexp_matches(x, {_lit(A.ENVIRONMENT)}) THEN x ELSE regexp_extract(x, {_lit(A.INLINE)}, 1) END")} AS f FROM fc WHERE NOT mark AND c % 2 = 0 AND (regexp_matches(x, {_lit(A.ENVIRONMENT)}) OR regexp_extract(x, {_lit(A.INLINE)}, 1) <> '')
 UNION ALL SELECT o.doc_id, e.i, {strip_sql("coalesce(string_agg(o.x, chr(10) ORDER BY o.i), '')")} FROM fc o JOIN fc e ON e.doc_id = o.doc_id AND e.mark AND e.c = o.c + 1 WHERE o.c % 2 = 1 AND NOT o.mark GROUP BY o.doc_id, o.c, e.i),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ff), fd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {collapse_sql("f")} ORDER BY k) AS first FROM fk WHERE k <= 8 AND {_PLAUSIBLE}),
formulas AS (SELECT doc_id, list(f ORDER BY k) AS f FROM fd WHERE first = 1 GROUP BY 1)"""


@query(f"WITH {PAPERS}, {formulas_sql(16000)} SELECT doc_id, coalesce(len(f), 0)::INT AS n, md5(coalesce(array_to_string(f, '|'), '')) AS formulas_md5 FROM papers LEFT JOIN formulas USING (doc_id)")
def text_formulas(spark, d):
    f = papers(spark, d).select("doc_id", A.text_formulas(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").alias("n"), md5(F.array_join("f", "|")).alias("formulas_md5"))


_FIGURE = f"""CASE WHEN regexp_matches(x, {_lit(A.ASSET_LINE)}) THEN {{'name': trim(regexp_extract(x, {_lit(A.ASSET_LINE)}, 1)), 'source': trim(regexp_extract(x, {_lit(A.ASSET_LINE)}, 2))}}
 WHEN regexp_matches(x, {_lit(A.MARKDOWN_FIGURE)}) THEN {{'name': regexp_extract(x, {_lit(A.MARKDOWN_FIGURE)}, 1), 'source': regexp_extract(x, {_lit(A.MARKDOWN_FIGURE)}, 2)}}
 WHEN regexp_matches(x, {_lit(A.PLAIN_FIGURE)}) THEN {{'name': trim(regexp_extract(x, {_lit(A.PLAIN_FIGURE)}, 1)), 'source': '{A.PLACEHOLDER}'}} END"""


@query(f"""WITH {PAPERS}, l AS (SELECT doc_id, unnest(string_split(left(text, 16000), chr(10))) AS x, generate_subscripts(string_split(left(text, 16000), chr(10)), 1) AS i FROM papers), f AS (SELECT doc_id, i, {_FIGURE} AS f FROM l),
n AS (SELECT doc_id, f.name AS name, f.source AS source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE f IS NOT NULL), u AS (SELECT doc_id, CASE WHEN name = '' THEN 'Figure ' || k ELSE name END AS name, source, k FROM n WHERE k <= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name || '|' || source) ORDER BY k) AS first FROM u) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, name, source FROM o WHERE first = 1""")
def text_figures(spark, d):
    return papers(spark, d).select("doc_id", F.posexplode(A.text_figures(F.col("text"))).alias("pos", "f")).select("doc_id", "pos", "f.name", "f.source")


#: Words by which a field's sentences are found.
_WORDS = {"summary": ["abstract"], "problem": ["problem", "limited"], "motivation": ["because", "important"], "method": ["model", "architecture"], "results": ["accuracy", "baseline"], "contributions": ["contribution", "novel"]}


def _picked(field: str, other: str) -> str:
    held = " OR ".join(f"contains(lower(s), '{w}')" for w in _WORDS[field])
    return f"coalesce(nullif(array_to_string(list_filter(s, lambda s: {held})[1:2], ' '), ''), {other})"


_TITLE = "trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1))"
_LOCAL = f"""local AS (SELECT doc_id, {_TITLE} AS title, EXISTS (SELECT 1 FROM formulas q WHERE q.doc_id = p.doc_id) AS has_formula, regexp_matches(left(text, 12000), 'Overview of the pipeline\\] Source: .') OR regexp_matches(left(text, 12000), {_lit(A.PLAIN_FIGURE)}) OR regexp_matches(left(text, 12000), {_lit(A.MARKDOWN_FIGURE)}) AS has_figure, {_picked("summary", "array_to_string(s[1:2], ' ')")} AS summary,
 {", ".join(f"{_picked(f, _lit(A.DEFAULTS[f]))} AS {f}" for f in ("problem", "motivation", "method", "results", "contributions"))}, {_picked("results", "''")} AS experiments
 FROM (SELECT *, {fallback_sentences_sql("left(text, 12000)")} AS s FROM papers) p)"""
_FILLED = " + ".join(f"(NOT ({f} = '' OR regexp_matches({f}, '^No |^Needs ')))::INT" for f in ("problem", "motivation", "method", "results", "contributions"))


@query(f"WITH {PAPERS}, {formulas_sql(12000)}, {_LOCAL} SELECT doc_id, title, " + ", ".join(f"md5({f}) AS {f}_md5" for f in ("summary", "problem", "motivation", "method", "experiments", "results", "contributions")) + f", floor(({_FILLED} + has_formula::INT + has_figure::INT) * 100 / 8 + 0.5)::INT AS score FROM local")
def local_analysis(spark, d):
    made = A.local_analysis(papers(spark, d), T.title_of(F.col("text")), _WORDS)
    return made.select("doc_id", "title", *[md5(F.col(f)).alias(f"{f}_md5") for f in ("summary", "problem", "motivation", "method", "experiments", "results", "contributions")], "score")


# ------------------------------------------------------------------ extractive answers


def _task_sql(task: tuple, k: int) -> str:
    task_id, _, goal, fields, _ = task
    words = ", ".join(_lit(w) for w in A.goal_words(goal))
    return f"""u{k} AS (SELECT doc_id, i, x, 5 * len(list_filter([{words}], lambda w: contains(lower(x), w))) + CASE WHEN regexp_matches(x, {_lit(A.SIGNAL)}) THEN 2 ELSE 0 END AS score, {key_sql("x")} AS key FROM fit),
d{k} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, length(x) DESC, i) AS first FROM u{k} WHERE score >= 2 AND key <> ''),
r{k} AS (SELECT doc_id, '{task_id}' AS task_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(x) DESC, i) AS rank FROM d{k} WHERE first = 1),
b{k} AS (SELECT doc_id, list(x ORDER BY rank) AS b FROM r{k} WHERE rank <= {max(6, 3 * len(fields))} GROUP BY 1)"""


def _fields_sql(task: tuple, k: int) -> str:
    task_id, _, _, fields, _ = task
    title = f"coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda l: {strip_sql("regexp_replace(l, '^#+\\s*', '')")}), lambda l: length(l) BETWEEN 5 AND 180 AND NOT regexp_matches(l, '(?i)^\\[?(?:source|evidence)'))[1], b[1])"
    chosen = lambda f, i: title if f == "title" else f"coalesce({f'list_filter(b, lambda s: regexp_matches(s, {_lit(A.FIELD_SIGNALS[f])}))[1]' if f in A.FIELD_SIGNALS else 'b[1]'}, b[least({i + 1}, len(b))])"
    return " UNION ALL ".join(f"SELECT doc_id, '{task_id}' AS task_id, '{f}' AS field, md5({chosen(f, i)}) AS value_md5 FROM b{k} JOIN papers USING (doc_id)" for i, f in enumerate(fields)) + f" UNION ALL SELECT doc_id, '{task_id}', 'evidence', md5(array_to_string(b[1:3], '|')) FROM b{k}"


_FIT = f"""{PAPERS}, s AS (SELECT doc_id, {sentences_sql("text")} AS s FROM papers), f AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM s), g AS (SELECT doc_id, i, {collapse_sql("regexp_replace(s, '^#+\\s*', '')")} AS x FROM f),
fit AS (SELECT * FROM g WHERE length(x) BETWEEN 32 AND 420 AND NOT regexp_matches(x, {_lit(A.NOT_EVIDENCE)}) AND NOT regexp_matches(x, '^[a-z]{{2,}}\\s') AND NOT regexp_matches(x, {_lit(A.CUT_OFF)}))"""


@query(f"WITH {_FIT}, " + ", ".join(_task_sql(t, k) for k, t in enumerate(retrieve.READING_PLAN)) + " " + " UNION ALL ".join(_fields_sql(t, k) for k, t in enumerate(retrieve.READING_PLAN)))
def extractive_answers(spark, d):
    made = A.extractive_answers(papers(spark, d))
    fields = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    listed = F.concat(fields, F.array(F.struct(F.lit("evidence").alias("field"), F.array_join("evidence", "|").alias("value"))))
    return made.select("doc_id", "task_id", F.explode(listed).alias("f")).select("doc_id", "task_id", "f.field", md5(F.col("f.value")).alias("value_md5"))


# ------------------------------------------------------------------ paper types

#: What makes papers of each type, by the remainder of the id.
_KINDS = ["''", "'We review a taxonomy of methods in this survey.'", "'We conduct an empirical study. We evaluate pass@10 on research questions. Table 3 shows it.'", "'Theorem 1 and its proof give an upper bound. \\\\begin{theorem}'", "'Throughput and latency of the deployment.'", "'We introduce a benchmark suite and a new dataset by data collection.'", "'Formatting instructions: page limits.'", "'To address this we propose it. Our main contributions are as follows.'"]
_KIND = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(k.replace("\\\\", "\\") for k in _KINDS)) + " END"


def _said(rule: tuple[str, str]) -> str:
    return f"regexp_matches({rule[0]}, {_lit(rule[1])})"


_COUNTED = {t: " + ".join(f"least(5, len(regexp_extract_all(body, {_lit(p)})))" for p in ps) for t, ps in C.TYPE_SIGNALS.items()}
_BASE = {t: f"({_COUNTED[t]}" + "".join(f" + CASE WHEN {_said(r)} THEN {n} ELSE 0 END" for kind, n, r in C.BONUSES if kind == t) + ")" for t in C.TYPE_SIGNALS}


@query(f"""WITH {PAPERS}, x AS (SELECT doc_id, source, regexp_replace({_KIND} || chr(10) || CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '' END, {_lit(C.REFERENCES_ON)}, '') AS body FROM papers),
y AS (SELECT *, left(body, {C.TITLE_CHARS}) AS title, left(body, {C.OPENING_CHARS}) AS opening FROM x), z AS (SELECT *, {_said(C.SURVEY_TITLE)} OR {_said(C.SURVEY_CLAIM)} AS is_survey, {_said(C.METHOD_CLAIM)} OR {_said(C.ADDRESS_CLAIM)} AS claim, {", ".join(f"{b} AS s_{t}" for t, b in _BASE.items())} FROM y),
w AS (SELECT * REPLACE (s_method + CASE WHEN claim THEN 12 + CASE WHEN {_said(C.CONTRIBUTION_CLAIM)} THEN 4 ELSE 0 END ELSE 0 END AS s_method, CASE WHEN is_survey THEN s_survey ELSE least(s_survey, 2) END AS s_survey) FROM z),
v AS (SELECT * REPLACE (CASE WHEN claim AND NOT is_survey THEN greatest(s_method, s_survey + 8) ELSE s_method END + CASE WHEN source = 'web' THEN 0.25 ELSE 0 END AS s_method) FROM w),
u AS (SELECT doc_id, unnest([{", ".join(f"{{'t': '{t}', 'i': {i}, 's': s_{t}::DOUBLE}}" for i, t in enumerate(C.TYPE_SIGNALS))}]) AS r FROM v),
q AS (SELECT doc_id, r.t AS t, r.s AS s, row_number() OVER (PARTITION BY doc_id ORDER BY r.s DESC, r.i) AS rn FROM u),
k AS (SELECT doc_id, max(t) FILTER (rn = 1) AS t1, max(s) FILTER (rn = 1) AS s1, max(t) FILTER (rn = 2) AS second, max(s) FILTER (rn = 2) AS s2, max(t) FILTER (rn = 3) AS third FROM q GROUP BY 1)
SELECT doc_id, CASE WHEN s1 > 0 THEN t1 ELSE 'method' END AS paper_type, s1 AS score, s1 - s2 AS margin, CASE WHEN s1 > 0 THEN least(0.96, round((0.5::DOUBLE + (s1 - s2) * 0.06::DOUBLE + s1 * 0.02::DOUBLE), 2)) ELSE 0.35 END::DOUBLE AS confidence, second, third FROM k""")
def type_classify(spark, d):
    kind = F.get(F.array(*[F.expr(k) for k in _KINDS]), (F.col("doc_id") % 8).cast("int"))
    text = F.concat(kind, F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(""))
    docs = papers(spark, d).select("doc_id", text.alias("text"), F.when(F.col("source") == "web", "arxiv").otherwise("text").alias("kind"))
    return C.classify(C.type_scores(docs, source_type=F.col("kind")))

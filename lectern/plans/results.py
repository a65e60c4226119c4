"""Queries of panel texts, plans by paper type, and results that are shaped, merged and counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import narrative as N
from ..functions import spans as S
from ..functions import text as T
from ..operators import planning as G
from ..operators import results as R
from ..operators.retrieve import READING_PLAN
from .base import PAPERS, collapse_sql, export_sentences_sql, key_sql, md5, papers, query, strip_sql, table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ panel texts


def _finished_sql(x: str) -> str:
    y = strip_sql(f"regexp_replace({x}, '[\\s,，;；:：-]+$', '')")
    return f"CASE WHEN {y} = '' OR regexp_matches({y}, '[.!?。！？]$') THEN {y} ELSE {y} || CASE WHEN regexp_matches({y}, '[\\x{{3400}}-\\x{{9fff}}]') THEN '。' ELSE '.' END END"


_PANEL_OF = "CASE turn % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'results' WHEN 2 THEN 'summary' ELSE 'other' END"
_BUDGET = "CASE panel " + " ".join(f"WHEN '{p}' THEN [{a}, {b}]" for p, (a, b) in N.PANEL_BUDGETS.items()) + " ELSE [3, 520] END"


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, {_PANEL_OF} AS panel, text || ' ' || coalesce(text, '') || ' We get 0.5 vs. 1.5,' AS x FROM conversations), b AS (SELECT *, {_BUDGET} AS budget, {export_sentences_sql("x")} AS s FROM c),
u AS (SELECT conv_id, turn, budget, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(s) ORDER BY i) AS first FROM u),
n AS (SELECT conv_id, turn, budget, {_finished_sql("s")} AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM d WHERE first = 1),
r AS (SELECT conv_id, turn, k, p, budget, length(p) AS used FROM n WHERE k = 1 UNION ALL SELECT r.conv_id, r.turn, n.k, n.p, r.budget, r.used + length(n.p) FROM r JOIN n ON n.conv_id = r.conv_id AND n.turn = r.turn AND n.k = r.k + 1 WHERE r.k < r.budget[1] AND r.used < r.budget[2])
SELECT b.conv_id, b.turn, count(r.k)::INT AS n_points, md5(coalesce(string_agg(r.p, '|' ORDER BY r.k), '')) AS points_md5 FROM b LEFT JOIN r ON r.conv_id = b.conv_id AND r.turn = b.turn GROUP BY 1, 2""")
def panel_points(spark, d):
    x = F.concat(F.col("text"), F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" We get 0.5 vs. 1.5,"))
    p = table(spark, d, "conversations").select("conv_id", "turn", N.panel_points(F.expr(_PANEL_OF), x).alias("p"))
    return p.select("conv_id", "turn", F.size("p").alias("n_points"), md5(F.array_join("p", "|")).alias("points_md5"))


_NAR = "list_filter(list_transform([text, role, upper(role), text || '.', '', role || ': ' || text], lambda v: {c}), lambda v: {k} <> '')".format(c=collapse_sql("v"), k="regexp_replace(lower(v), '[^\\p{L}\\p{N}]+', '', 'g')")


@query(f"""WITH n AS (SELECT conv_id, turn, unnest({_NAR}) AS v, generate_subscripts({_NAR}, 1) AS i FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}]+', '', 'g') ORDER BY i) AS first FROM n)
SELECT c.conv_id, c.turn, md5(coalesce(string_agg(f.v, ' ' ORDER BY f.i), '')) AS joined_md5 FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn AND f.first = 1 GROUP BY 1, 2""")
def joined_fields(spark, d):
    t, r = F.col("text"), F.col("role")
    return table(spark, d, "conversations").select("conv_id", "turn", md5(N.joined(t, r, F.upper(r), F.concat(t, F.lit(".")), F.lit(""), F.concat(r, F.lit(": "), t))).alias("joined_md5"))


#: Theory and method texts around each benchmark item.
_THEORY = "'We propose a model, e.g. a network with loss 0.5 for ' || text || '. The model encodes the input so that it fits; then it ranks the passages by score: and generates an answer with. RAG retrieves documents for ' || item_id"
_METHOD = "CASE item_id % 3 WHEN 0 THEN text || ', then selects the best candidates, which updates the long memory of it' WHEN 1 THEN 'It improves accuracy. The decoder samples tokens; the encoder attends to them. We train both parts jointly' ELSE 'short' END"


def _unled_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(regexp_replace({x}, {_lit(N.LEADS[0])}, ''), {_lit(N.LEADS[1])}, '')")


def _clause_sql(x: str, limit: int) -> str:
    head = f"regexp_extract(left({x}, {limit + 1}), '(?s)^(.*)[,;:]\\s+', 1)"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN length({head}) >= {limit * N.CLAUSE_SHARE} AND NOT regexp_matches({strip_sql(head)}, {_lit(N.CONNECTOR)}) THEN {strip_sql(head)} ELSE '' END"


def phrases_sql(x: str) -> str:
    held = f"regexp_replace(regexp_replace(regexp_replace({collapse_sql(x)}, '(?i)e\\.g\\.', 'e' || chr(1) || 'g' || chr(1), 'g'), '(?i)i\\.e\\.', 'i' || chr(1) || 'e' || chr(1), 'g'), '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g')"
    turns = N.PHRASE_TURNS.replace("(?=(", "((").replace("\\b)", "\\b)")  # no lookahead in RE2: a mark is put before what follows
    by_turn = f"string_split(regexp_replace({held}, {_lit(turns)}, chr(2) || '\\1', 'g'), chr(2))"
    parts = f"(CASE WHEN len(regexp_split_to_array({held}, '[.;:]\\s*')) >= 3 THEN regexp_split_to_array({held}, '[.;:]\\s*') ELSE {by_turn} END)"
    clean = f"list_transform({parts}, lambda p: {_unled_sql(collapse_sql('replace(p, chr(1), chr(46))'))})"
    cut = f"list_transform(list_filter({clean}, lambda p: length(p) >= {N.PHRASE_LEAST}), lambda p: {_clause_sql('p', N.PHRASE_MOST)})"
    return f"list_filter({cut}, lambda p: p <> '' AND NOT regexp_matches(p, {_lit(N.CONNECTOR)}))"


_UNIQUE = "regexp_replace(lower(p), '[^\\p{L}\\p{N}]+', '', 'g')"


def _distinct_sql(name: str, items: str) -> str:
    return f"{name}_u AS (SELECT item_id, unnest({items}) AS p, generate_subscripts({items}, 1) AS i FROM ph), {name}_f AS (SELECT *, row_number() OVER (PARTITION BY item_id, {_UNIQUE} ORDER BY i) AS first FROM {name}_u WHERE {_UNIQUE} <> ''), {name} AS (SELECT item_id, list(p ORDER BY i) AS l FROM {name}_f WHERE first = 1 GROUP BY 1)"


_WORDS3 = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}-]{{2,}}'))"
_SIM = f"CASE WHEN len({_WORDS3.format('th')}) = 0 OR len({_WORDS3.format('me')}) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS3.format('th')}, {_WORDS3.format('me')})) / least(len({_WORDS3.format('th')}), len({_WORDS3.format('me')})) END"
_BARE = strip_sql(f"regexp_replace(regexp_replace({_unled_sql('p')}, {_lit(N.PHRASE_LEADS)}, ''), {_lit(N.PHRASE_AIMS)}, '')")


@query(f"""WITH x AS (SELECT item_id, {collapse_sql(_THEORY)} AS th, {collapse_sql(_METHOD)} AS me FROM benchmark), ph AS (SELECT *, {phrases_sql("th")} AS pt, {phrases_sql("me")} AS pm FROM x),
{_distinct_sql("dt", "pt")}, {_distinct_sql("da", "list_concat(pt, pm)")}, {_distinct_sql("dm", "pm")}, {_distinct_sql("dx", "list_concat(pm, pt)")},
k AS (SELECT ph.item_id, {_SIM} AS sim, (CASE WHEN coalesce(len(dt.l), 0) >= 3 THEN dt.l ELSE coalesce(da.l, []) END)[1:5] AS ideas, coalesce(dm.l, [])[1:5] AS steps, list_filter(list_transform(list_filter(coalesce(dx.l, []), lambda p: regexp_matches(p, {_lit(N.MECHANISM_WORDS)}) AND NOT regexp_matches(p, {_lit(N.RESULT_WORDS)})), lambda p: {_BARE}), lambda p: p <> '' AND length(p) <= 120)[1:4] AS flow
 FROM ph LEFT JOIN dt USING (item_id) LEFT JOIN da USING (item_id) LEFT JOIN dm USING (item_id) LEFT JOIN dx USING (item_id))
SELECT item_id, round(sim, 6)::DOUBLE AS similarity, CASE WHEN len(ideas) >= 3 AND sim < 0.68 THEN md5(array_to_string(ideas, '|')) END AS ideas_md5, CASE WHEN len(steps) >= 3 THEN md5(array_to_string(steps, '|')) END AS steps_md5, CASE WHEN len(flow) >= 3 THEN md5(array_to_string(flow, '|')) END AS flow_md5 FROM k""")
def key_phrases(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.expr(_THEORY).alias("t"), F.expr(_METHOD).alias("m"))
    t, m = F.col("t"), F.col("m")
    told = b.select("item_id", F.round(N.similarity(t, m), 6).alias("similarity"), N.key_ideas(t, m).alias("ideas"), N.method_flow(m).alias("steps"), N.mechanism_flow(t, m).alias("flow"))
    return told.select("item_id", "similarity", *[F.when(F.col(c).isNotNull(), md5(F.array_join(c, "|"))).alias(f"{c}_md5") for c in ("ideas", "steps", "flow")])


_CLEAN_TITLE = strip_sql(f"regexp_replace(regexp_replace({collapse_sql('x')}, '\\b((?:19|20)\\d{{2}})([A-Z][a-z]{{2,}})', '\\1 \\2', 'g'), '(?i)\\s+(?:abstract|introduction|keywords?)\\s*$', '')")
_CANDIDATES = ["CASE item_id % 3 WHEN 0 THEN 'Untitled' WHEN 1 THEN 'page 3' ELSE '2024Sparse attention: ' || text || ' Abstract' END", "CASE item_id % 2 WHEN 0 THEN 'abc' ELSE '  A study of 1999Things Keywords ' END", "'Model title ' || item_id"]


@query(f"""WITH t AS (SELECT item_id, list_transform([{", ".join(_CANDIDATES)}], lambda x: {_CLEAN_TITLE}) AS c FROM benchmark)
SELECT item_id, md5(coalesce(list_filter(c, lambda t: length(t) >= 5 AND NOT regexp_matches(t, '(?i)^(?:untitled|page\\s+\\d+|main source file)$'))[1], 'Untitled Paper Poster')) AS title_md5 FROM t""")
def resolved_titles(spark, d):
    return table(spark, d, "benchmark").select("item_id", md5(S.resolved_title(*[F.expr(c) for c in _CANDIDATES])).alias("title_md5"))


_CUTS = "list_filter(list_transform(range(floor(n * 0.3)::INT, ceil(n * 0.7)::INT + 1), lambda i: {'i': i, 'l': trim(left(t, i)), 'r': trim(substr(t, i + 1)), 'ok': substr(t, i + 1, 1) = ' ' OR regexp_matches(substr(t, i, 1), '[:：–—]')}), lambda c: c.ok AND c.l <> '' AND c.r <> '')"
_BEST = f"list_sort(list_transform({_CUTS}, lambda c: {{'s': abs(length(c.l) - length(c.r)) - CASE WHEN regexp_matches(c.l, '[:：–—]$') THEN 10 ELSE 0 END, 'i': c.i, 'l': c.l, 'r': c.r}}))[1]"


@query(f"""WITH t AS (SELECT item_id, {_CLEAN_TITLE.replace("coalesce(x, '')", "coalesce(text, '')")} AS t FROM benchmark), n AS (SELECT *, length(t) AS n FROM t), b AS (SELECT *, {_BEST} AS best FROM n)
SELECT item_id, md5(array_to_string(CASE WHEN n = 0 THEN [] WHEN n <= 55 OR best IS NULL THEN [t] ELSE [best.l, best.r] END, '|')) AS lines_md5 FROM b""")
def split_titles(spark, d):
    return table(spark, d, "benchmark").select("item_id", md5(F.array_join(S.split_title(F.col("text")), "|")).alias("lines_md5"))


# ------------------------------------------------------------------ plans

_TYPES = list(G.FOCUS) + ["other"]
_TYPE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def _typed(spark, d):
    return papers(spark, d).select("doc_id", F.expr(_TYPE).alias("paper_type"), F.when(F.col("doc_id") % 3 == 0, F.coalesce("lang", F.lit(""))).otherwise(F.col("text")).alias("text"))


_PLAN_GOALS = {t: goal for t, _, goal, *_ in READING_PLAN}
_PLAN_ROWS = ", ".join(f"('{k}', '{task}', {i + 1}, {order.index(task) + 1}, '{'high' if task in high else 'supporting'}', {len(G.TARGETS.get(k, G.TARGETS['any'])[task])}, {2 if task == 'overview' else 3}, {_lit(G.SECTION_LABELS[task])}, {_lit(G.GOALS.get(k, {}).get(task, _PLAN_GOALS[task]) + ' ' + G.FOCUS_GOAL % k)})" for k, (high, order) in G.FOCUS.items() for i, task in enumerate(G.SECTION_LABELS))


@query(f"""WITH p(paper_type, task_id, task_order, section_order, priority, n_evidence, max_sentences, label, goal) AS (VALUES {_PLAN_ROWS}), t AS (SELECT doc_id, CASE WHEN {_TYPE} = 'other' THEN 'method' ELSE {_TYPE} END AS paper_type FROM documents)
SELECT doc_id, task_id, task_order, section_order, priority, n_evidence, max_sentences, label, md5(goal) AS goal_md5, CASE WHEN priority = 'high' OR task_id IN ('method', 'theory', 'results') THEN 'wide' ELSE 'standard' END AS span FROM t JOIN p USING (paper_type)""")
def reading_plans(spark, d):
    return G.sections(G.planned(_typed(spark, d).select("doc_id", "paper_type"))).select("doc_id", "task_id", "task_order", "section_order", "priority", F.size("required_evidence").alias("n_evidence"), "max_sentences", "label", md5(F.col("goal")).alias("goal_md5"), "span")


_TYPED = f"{PAPERS}, t AS (SELECT doc_id, {_TYPE} AS paper_type, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') ELSE text END AS text FROM papers)"
_SLOTS = ", ".join(f"('{t}', {i}, '{k}')" for t, ks in [*G.VISUALS.items(), ("other", G.VISUALS["method"])] for i, k in enumerate(ks))
_NEAR = "CASE WHEN contains(kind, 'formula') OR kind IN ('theorem', 'proof-map') THEN 'theory' WHEN contains(kind, 'result') OR kind IN ('performance', 'scaling', 'benchmark') THEN 'results' WHEN kind IN ('ablation', 'uncertainty', 'subgroup') THEN 'experiments' ELSE 'method' END"
SLOTS = f"""{_TYPED}, v(paper_type, pos, kind) AS (VALUES {_SLOTS}), n AS (SELECT *, regexp_matches(text, {_lit(G.FORMULA_SIGNAL)}) AS f, regexp_matches(text, {_lit(G.FIGURE_SIGNAL)}) AS g, regexp_matches(text, {_lit(G.TABLE_SIGNAL)}) AS b FROM t),
slots AS (SELECT doc_id, pos, kind, CASE WHEN contains(kind, 'formula') OR kind = 'theorem' THEN f WHEN contains(kind, 'table') OR contains(kind, 'results') OR kind IN ('ablation', 'benchmark') THEN b OR g ELSE g END AS available FROM n JOIN v USING (paper_type))"""


@query(f"""WITH {SLOTS} SELECT doc_id, pos, kind, CASE WHEN pos < 2 THEN 'high' ELSE 'supporting' END AS priority, CASE WHEN contains(kind, 'formula') OR kind = 'theorem' THEN 'exact-latex' ELSE 'original-paper-asset' END AS preference,
CASE WHEN contains(kind, 'table') OR contains(kind, 'results') OR kind = 'ablation' THEN 'crop-relevant-region-with-headers' ELSE 'preserve-original' END AS operation, available, {_NEAR} AS section FROM slots""")
def visual_slots(spark, d):
    return G.visual_slots(_typed(spark, d))


_LIMIT = lambda i: "CASE paper_type " + " ".join(f"WHEN '{t}' THEN {v[i]}" for t, v in G.ASSET_LIMITS.items()) + f" ELSE {G.ASSET_LIMITS['method'][i]} END"


@query(f"WITH {_TYPED} SELECT doc_id, {_LIMIT(0)} AS max_formulas, {_LIMIT(1)} AS max_figures, {_LIMIT(2)} AS max_tables, NOT regexp_matches(text, {_lit(G.TABLE_SIGNAL)}) AND regexp_matches(text, {_lit(G.FIGURE_SIGNAL)}) AS reserve_figure, regexp_matches(text, {_lit(G.FORMULA_SIGNAL)}) AND paper_type IN ('method', 'theory', 'system') AND regexp_matches(text, {_lit(G.MECHANISM_SIGNAL)}) AS require_formula FROM t")
def selection_policies(spark, d):
    return G.selection_policy(_typed(spark, d))


@query(f"WITH {SLOTS}, a AS (SELECT doc_id, count(*) FILTER (available)::INT AS n_available FROM slots GROUP BY 1) SELECT doc_id, n_available, CASE WHEN n_available >= 3 THEN 'visual' WHEN paper_type = 'theory' THEN 'compact' ELSE 'balanced' END AS density FROM a JOIN t USING (doc_id)")
def poster_density(spark, d):
    return G.density(G.visual_slots(_typed(spark, d)), _typed(spark, d))


_TOLD = {"title": "CASE doc_id % 5 WHEN 0 THEN 'A survey of models' ELSE 'A study' END", "summary": "CASE doc_id % 3 WHEN 0 THEN 'This work presents a unified framework for it' WHEN 1 THEN 'The model of the network is trained' ELSE 'We look into research questions' END", "method": "CASE doc_id % 7 WHEN 0 THEN 'A theorem' WHEN 1 THEN 'a taxonomy of root causes' WHEN 2 THEN 'mitigation by retrieval' ELSE 'words' END"}
_ALL = " || ' ' || ".join(f"({v})" for v in _TOLD.values())


def _has(p: str, x: str = "x") -> str:
    return f"regexp_matches({x}, {_lit(p)})"


_HEADING_SQL = {p: "CASE paper_type " + " ".join(f"WHEN '{t}' THEN {_lit(names[p])}" for t, names in G.TYPE_HEADINGS.items() if p in names and not (t == "empirical" and p in ("method", "theory", "results")) and not (t == "theory" and p == "method")) for p in G.HEADINGS}
_HEADING_SQL["method"] += f" WHEN 'theory' THEN CASE WHEN {_has(G.EXPLAINS_METHOD, 'method')} THEN 'Method Overview' ELSE 'Definitions and Assumptions' END WHEN 'empirical' THEN CASE WHEN {_has(G.TAXONOMY_WORDS, 'method')} THEN 'Study Design & Taxonomy' ELSE 'Study Design' END"
_HEADING_SQL["theory"] += f" WHEN 'empirical' THEN CASE WHEN {_has(G.TAXONOMY_WORDS, 'method')} THEN 'Mechanism & Root Causes' ELSE 'Variables and Measures' END"
_HEADING_SQL["results"] += f" WHEN 'empirical' THEN CASE WHEN {_has(G.MITIGATION_WORDS, 'method')} THEN 'Mitigation Results' ELSE 'Results and Validity' END"
_HEADINGS_OF = ", ".join(f"{_HEADING_SQL[p]} WHEN '' THEN '' ELSE {'CASE WHEN doc_id % 2 = 0 THEN ' + _lit(G.FORMULA_HEADING) + ' ELSE ' + _lit(G.HEADINGS[p]) + ' END' if p == 'theory' else _lit(G.HEADINGS[p])} END AS {p}" for p in G.HEADINGS)


@query(f"""WITH t AS (SELECT doc_id, {_TYPE} AS paper_type, {_TOLD["method"]} AS method, {_ALL} AS x FROM documents)
SELECT doc_id, CASE WHEN paper_type = 'theory' AND len(regexp_extract_all(x, {_lit(G.METHOD_WORDS)})) >= 2 AND NOT {_has(G.THEORY_WORDS)} OR paper_type = 'empirical' AND ({_has(G.FRAMEWORK[0])} OR {_has(G.FRAMEWORK[1])}) AND NOT {_has(G.STUDY)} OR paper_type = 'survey' AND ({_has(G.PROPOSED[0])} OR {_has(G.PROPOSED[1])}) AND NOT {_has(G.SURVEY_WORDS)} THEN 'method' ELSE paper_type END AS resolved, {_HEADINGS_OF} FROM t""")
def panel_headings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_TYPE).alias("paper_type"), *[F.expr(v).alias(k) for k, v in _TOLD.items()])
    kind, method = F.col("paper_type"), F.col("method")
    made = docs.select("doc_id", G.resolved_type(kind, F.col("title"), F.col("summary"), method).alias("resolved"), G.panel_headings(kind, F.col("doc_id") % 2 == 0, method, F.lit(""), F.lit(None).cast("string")).alias("h"))
    return made.select("doc_id", "resolved", "h.*")


# ------------------------------------------------------------------ results


@query("""WITH v AS (SELECT user_id, list(CASE user_id % 3 WHEN 0 THEN value / 1000 WHEN 1 THEN value / 100 ELSE value END ORDER BY event_id) AS s, event_id // 50 AS block, user_id % 12 AS overall FROM events GROUP BY user_id, event_id // 50),
m AS (SELECT *, list_filter(s, lambda x: x > 0) AS p FROM v), b AS (SELECT *, CASE WHEN len(p) < 3 THEN 1 WHEN list_max(p) <= 1 THEN 100 WHEN list_max(p) <= 10 THEN 10 ELSE 1 END AS times FROM m)
SELECT user_id, block, times::INT AS multiplier, coalesce(list_median(list_transform(p, lambda x: x * times)), 0)::DOUBLE AS median, floor(greatest(0, least(100, overall * CASE WHEN times > 1 THEN times WHEN overall > 0 AND overall <= 10 AND coalesce(list_median(list_transform(p, lambda x: x * times)), 0) >= 40 THEN 10 ELSE 1 END)) + 0.5)::INT AS overall,
CASE WHEN user_id % 2 = 0 AND user_id % 5 <> 0 THEN 'pass' ELSE 'revise' END AS verdict, list_sum(list_transform(s, lambda x: floor(greatest(0, least(100, x * times)) + 0.5)))::BIGINT AS total FROM b""")
def score_scale(spark, d):
    events = table(spark, d, "events").withColumn("block", F.expr("event_id div 50"))  # so that a review has 50 scores at most
    value = F.when(F.col("user_id") % 3 == 0, F.col("value") / 1000).when(F.col("user_id") % 3 == 1, F.col("value") / 100).otherwise(F.col("value"))
    s = events.groupBy("user_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", value.alias("v")))), lambda x: x["v"]).alias("s"))
    by = R.score_multiplier(F.col("s"))
    r = R.review(F.col("s"), (F.col("user_id") % 12).cast("double"), F.when(F.col("user_id") % 2 == 0, "PASS").otherwise("fail"), F.when(F.col("user_id") % 5 == 0, F.array(F.lit("high"))).otherwise(F.array(F.lit("low"))))
    middle = R.median(F.filter(F.transform("s", lambda x: x * by), lambda x: x > 0))
    told = s.select("user_id", "block", by.alias("multiplier"), middle.alias("median"), r.alias("r"))
    return told.select("user_id", "block", "multiplier", "median", "r.overall", "r.verdict", F.aggregate("r.scores", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_PANEL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate([*R.PANELS, "margin"])) + " END"


@query(f"""WITH RECURSIVE h AS (SELECT user_id, {_PANEL} AS panel, event_id AS seq, 0.7 + (event_id % 9) / 10.0 AS area, (event_id % 5) - 1.0 AS width, 1.0 AS height, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id ELSE '' END AS reason FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, panel ORDER BY seq) AS k FROM h WHERE panel <> 'margin'),
r AS (SELECT user_id, panel, 0::BIGINT AS k, 1.0::DOUBLE AS area, 1.0::DOUBLE AS width, '' AS reason FROM (SELECT DISTINCT user_id, panel FROM k)
 UNION ALL SELECT r.user_id, r.panel, k.k, greatest(0.8, least(1.35, r.area * CASE WHEN k.area > 0 THEN k.area ELSE 1 END))::DOUBLE, greatest(0.8, least(1.35, r.width * CASE WHEN k.width > 0 THEN k.width ELSE 1 END))::DOUBLE, coalesce(nullif(k.reason, ''), r.reason) FROM r JOIN k ON k.user_id = r.user_id AND k.panel = r.panel AND k.k = r.k + 1)
SELECT user_id, panel, round(arg_max(area, k), 6) AS area, round(arg_max(width, k), 6) AS width, 1.0::DOUBLE AS height, arg_max(reason, k) AS reason FROM r GROUP BY 1, 2""")
def merged_hints(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr(_PANEL).alias("panel"), F.col("event_id").alias("seq"), (0.7 + (F.col("event_id") % 9) / 10.0).alias("area"), ((F.col("event_id") % 5) - 1.0).alias("width"), F.lit(1.0).alias("height"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("r"), "event_id")).otherwise("").alias("reason"))
    return R.merged_hints(e, ["user_id"]).select("user_id", "panel", F.round("area", 6).alias("area"), F.round("width", 6).alias("width"), "height", "reason")


_TOOL = "CASE event_id % 4 WHEN 0 THEN 'llm.analyze' WHEN 1 THEN 'llm.verify' ELSE 'text.figures' END"


@query(f"""WITH t AS (SELECT user_id, count(*) AS tasks, count(*) FILTER (event_id % 5 < 3) AS completed, count(*) FILTER (event_id % 5 = 3) AS insufficient, count(*) FILTER (event_id % 5 = 4) AS failed, sum(greatest(0, event_id % 6 - 1))::BIGINT AS retries, sum(event_id % 3)::BIGINT AS recalled FROM events GROUP BY 1),
u AS (SELECT user_id, count(*) AS tool_calls, count(*) FILTER (event_id % 2 = 0) AS completed_tools, coalesce(sum(event_id % 1000) FILTER (event_id % 4 < 2), 0)::BIGINT AS input_tokens, coalesce(sum(event_id % 100) FILTER (event_id % 4 < 2), 0)::BIGINT AS output_tokens, coalesce(sum(event_id % 1000 + event_id % 100) FILTER (event_id % 4 < 2), 0)::BIGINT AS total_tokens, coalesce(bool_or(event_id % 4 < 2 AND event_id % 50 = 0), false) AS token_estimate FROM events GROUP BY 1),
e AS (SELECT user_id, count(*) AS evidence_items, count(DISTINCT event_type) AS evidence_groups FROM events WHERE event_id % 9 = 0 GROUP BY 1)
SELECT user_id, tasks, completed, insufficient, failed, retries, recalled, tool_calls, completed_tools, input_tokens, output_tokens, total_tokens, token_estimate, coalesce(evidence_items, 0) AS evidence_items, coalesce(evidence_groups, 0) AS evidence_groups,
floor(100.0 * completed / tasks + 0.5)::INT AS task_completion, floor(100.0 * (completed + insufficient) / tasks + 0.5)::INT AS task_finished, floor(100.0 * coalesce(evidence_groups, 0) / 7 + 0.5)::INT AS evidence_coverage, round((input_tokens * 2.0::DOUBLE + output_tokens * 8.0::DOUBLE) / 1000000, 6)::DOUBLE AS cost FROM t JOIN u USING (user_id) LEFT JOIN e USING (user_id)""")
def run_metrics(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    tasks = e.select("user_id", F.when(i % 5 < 3, "completed").when(i % 5 == 3, "insufficient").otherwise("failed").alias("status"), (i % 6).alias("attempts"), (i % 3).alias("memory_hits"))
    tools = e.select("user_id", F.expr(_TOOL).alias("name"), F.when(i % 2 == 0, "completed").otherwise("failed").alias("status"), (i % 1000).alias("input_tokens"), (i % 100).alias("output_tokens"), (i % 1000 + i % 100).alias("total_tokens"), (i % 50 == 0).alias("token_estimate"))
    evidence = e.filter(i % 9 == 0).select("user_id", F.col("event_type").alias("section"))
    return R.run_metrics(tasks, tools, evidence, "user_id", 7, 2.0, 8.0)


@query("SELECT event_id, greatest(0, value - 50)::DOUBLE AS duration_ms, greatest(0, event_id % 7 - 3)::DOUBLE AS model_calls, 0.0::DOUBLE AS total_tokens, CASE WHEN event_id % 3 <> 0 THEN greatest(0, value - 20) END::DOUBLE AS cost FROM events")
def run_efficiency(spark, d):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select("event_id", R.efficiency(v - 50, i % 7 - 3, F.lit(None).cast("long"), F.when(i % 3 != 0, v - 20)).alias("x")).select("event_id", "x.*")


@query("SELECT user_id, event_id FROM events QUALIFY event_id // 100 = max(event_id // 100) OVER (PARTITION BY user_id)")
def latest_results(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.expr("event_id div 100").alias("revision"))
    return R.latest_revision(e, "user_id").select("user_id", "event_id")


_CHECKS = "[{'id': CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE '' END, 'name': CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, 'severity': CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'odd' END}]"


@query(f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'revise' ELSE 'pass' END AS verdict, CASE WHEN event_id % 7 = 0 THEN 'Verification completed.' ELSE event_type END AS summary, greatest(0, least(1, value / 50 - 0.2))::DOUBLE AS confidence, (event_id % 11 % 9)::INT AS n_checks,
CASE WHEN event_id % 11 % 9 > 0 THEN coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE '' END, ''), nullif(CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, ''), 'check') END AS first_id, CASE WHEN event_id % 11 % 9 > 0 THEN CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END END AS first_severity, least(10, event_id % 14)::INT AS n_missing FROM events""")
def verifications(spark, d):
    i = F.col("event_id")
    check = F.struct(F.when(i % 2 == 0, F.concat(F.lit("c"), "event_id")).otherwise("").alias("id"), F.when(i % 3 == 0, F.col("event_type")).otherwise("").alias("name"), F.lit(None).cast("boolean").alias("ok"), F.when(i % 4 == 0, "high").when(i % 4 == 1, "low").otherwise("odd").alias("severity"), F.lit("").alias("detail"), F.array().cast("array<string>").alias("fields"))
    many = lambda x, n: F.array_repeat(x, n.cast("int"))
    v = F.struct(F.when(i % 5 == 0, "revise").otherwise("fine").alias("verdict"), F.when(i % 7 == 0, "").otherwise(F.col("event_type")).alias("summary"), (F.col("value") / 50 - 0.2).alias("confidence"), many(check, i % 11 % 9).alias("checks"), many(F.lit("m"), i % 14).alias("missing"), F.lit(None).cast("array<string>").alias("unsupported"))
    r = table(spark, d, "events").select("event_id", R.verification(v).alias("r"))
    first = F.get("r.checks", F.lit(0))
    return r.select("event_id", "r.verdict", "r.summary", "r.confidence", F.size("r.checks").alias("n_checks"), first["id"].alias("first_id"), first["severity"].alias("first_severity"), F.size("r.missing").alias("n_missing"))


_FIELDS = ["title", "summary", "problem", "method"]
_FIELD = "CASE turn % 5 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FIELDS)) + " ELSE 'other' END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_FIELD} AS field, nullif({strip_sql("CASE WHEN turn % 3 = 2 THEN '  ' ELSE coalesce(text, '') END")}, '') AS v FROM conversations)
SELECT conv_id, {", ".join(f"md5(coalesce(arg_max(v, turn) FILTER (field = '{f}' AND v IS NOT NULL), '{R.MISSING_TITLE if f == 'title' else R.MISSING_FIELD}')) AS {f}_md5" for f in _FIELDS)} FROM r GROUP BY 1""")
def merged_fields(spark, d):
    value = F.when(F.col("turn") % 3 == 2, "  ").otherwise(F.col("text"))
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.expr(_FIELD).alias("field"), value.alias("value"))
    return R.merged_fields(c, _FIELDS, "conv_id").select("conv_id", *[md5(F.col(f)).alias(f"{f}_md5") for f in _FIELDS])


_ITEMS = [("'FIGURE'", "source", "'results'", 0), ("'table'", "'Table 1'", "''", 1), ("'formula'", "lang", "'odd'", 2), ("'figure'", "source", "'theory'", 3), ("'photo'", "lang", "''", 0), ("'table'", "'nothing of it'", "''", 1), ("'Table'", "' table 1 '", "''", 0), ("'table'", "lang", "''", 1), ("'figure'", "'Overview of the pipeline'", "''", 0)]
_RECS = "[" + ", ".join(f"{{'place': {p}, 'type': lower({t}), 'reference': left({strip_sql(f'coalesce({r}, {_lit(str())})')}, 80), 'section': lower({s})}}" for t, r, s, p in _ITEMS) + "]"


@query(f"""WITH {PAPERS}, r AS (SELECT doc_id, text, unnest({_RECS}) AS r, generate_subscripts({_RECS}, 1) AS i FROM papers), f AS (SELECT doc_id, i, r.type AS type, r.reference AS reference, r.section AS section FROM r WHERE r.place < 3 AND r.type IN ('formula', 'figure', 'table') AND r.reference <> '' AND contains({key_sql("text")}, {key_sql("r.reference")})),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(type || '|' || reference) ORDER BY i) AS first FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE first = 1)
SELECT doc_id, (k - 1)::INT AS pos, type, reference, CASE WHEN section IN ('method', 'theory', 'results') THEN section WHEN type = 'table' THEN 'results' WHEN type = 'formula' THEN 'theory' ELSE 'method' END AS section FROM k WHERE k <= 6""")
def asset_recommendations(spark, d):
    items = F.array(*[F.struct(F.lit(p).alias("place"), F.expr(t).alias("type"), F.expr(r).alias("reference"), F.expr(s).alias("section"), F.lit("").alias("purpose"), F.lit("").alias("insight")) for t, r, s, p in _ITEMS])
    made = papers(spark, d).select("doc_id", F.posexplode(R.recommendations(items, F.col("text"))).alias("pos", "r"))
    return made.select("doc_id", "pos", "r.type", "r.reference", "r.section")


@query(f"""WITH a AS (SELECT conv_id, max(text) FILTER (turn % 2 = 0) AS summary, max(text) FILTER (turn % 2 = 1) AS contributions, max(role) AS innovation FROM conversations GROUP BY 1),
n AS (SELECT conv_id, 'overview' AS section, left({collapse_sql("summary")}, 1000) AS summary FROM a UNION ALL SELECT conv_id, 'contribution', concat_ws(' ', nullif(left({collapse_sql("contributions")}, 1000), ''), nullif(left({collapse_sql("innovation")}, 1000), '')) FROM a UNION ALL SELECT conv_id, unnest(['problem', 'method', 'theory', 'experiments', 'results']), '' FROM a),
l AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'overview' ELSE 'contribution' END AS section, left({collapse_sql("role || ' ' || turn % 3")}, 160) AS location, min(turn) AS seq FROM conversations GROUP BY ALL),
g AS (SELECT conv_id, section, string_agg(location, '|' ORDER BY seq) AS locations FROM l GROUP BY 1, 2)
SELECT conv_id, section, md5(n.summary) AS summary_md5, coalesce(locations, '') AS locations FROM n LEFT JOIN g USING (conv_id, section)""")
def section_notes(spark, d):
    c = table(spark, d, "conversations")
    at = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.col("text")))
    analysis = c.groupBy("conv_id").agg(at(0).alias("summary"), at(1).alias("contributions"), F.max("role").alias("innovation"))
    evidence = c.select("conv_id", F.when(F.col("turn") % 2 == 0, "summary").otherwise("contributions").alias("section"), F.col("turn").alias("seq"), F.concat_ws(" ", "role", (F.col("turn") % 3).cast("string")).alias("location"))
    return R.section_notes(analysis, evidence, "conv_id").select("conv_id", "section", md5(F.col("summary")).alias("summary_md5"), F.array_join("locations", "|").alias("locations"))


#: Formulas by doc_id % 6, with @ for the document's number, and their HTML.
_READABLE = [
    ("min_G max_D V(D,G) = E_x[log D(x)] + @", '<span class="math-operator">min</span><sub>G</sub> <span class="math-operator">max</span><sub>D</sub> V(D,G) <wbr>= E<sub>x</sub>[log D(x)] <wbr>+ @'),
    ("\\mathbb{E}_{x~p_data(x)}[\\log D(x|y_@)]", '<span class="math-expectation">𝔼</span><sub>x∼p_data(x)</sub>[log D(x∣y<sub>@</sub>)]'),
    ("$x^2 ≤ y^{n+@} - \\mathbf{w}_1$", "x<sup>2</sup> ≤y<sup>n+@</sup> <wbr>- w<sub>1</sub>"),
    ("a < b & 'c' > @", "a &lt; b &amp; &#039;c&#039; &gt; @"),
    ("\\left( E_{a} + E_{b<@} \\right)", '( <span class="math-expectation">𝔼</span><sub>a</sub> <wbr>+ <span class="math-expectation">𝔼</span><sub>b&lt;@</sub> )'),
    ("", ""),
]
_HTML = "[" + ", ".join("'" + h.replace("'", "''") + "'" for _, h in _READABLE) + "]"


@query(f"SELECT doc_id, replace(({_HTML})[doc_id % 6 + 1], '@', doc_id::VARCHAR) AS html FROM documents")
def readable_formulas(spark, d):
    """A formula a document as HTML."""
    one = F.element_at(F.array(*[F.lit(x) for x, _ in _READABLE]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", S.readable_math(F.replace(one, F.lit("@"), F.col("doc_id").cast("string"))).alias("html"))


# ------------------------------------------------------------------ scalar forms

#: Texts with what the scalar functions look for, around each benchmark item.
_FORMS = [
    ("tex_comments", "'a % note ' || item_id || chr(10) || 'b 5\\\\% c'", "regexp_replace(x, '(?m)(^|[^\\\\])%.*$', '\\1', 'g')", T.strip_tex_comments),
    ("xml", "'&lt;b&gt; &amp;amp; ' || item_id || ' &quot;x&quot; &#39;'", "replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')", T.unescape_xml),
    ("path", "'./a/../b' || chr(92) || 'c ' || item_id || '.png'", "array_to_string(list_filter(string_split(replace(x, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.', '..')), '/')", T.archive_path),
    ("redacted", "'key sk-ab_c-' || item_id || ' in ' || text", "left(regexp_replace(x, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g'), 240)", T.redacted),
    ("collapsed", "'  ' || text || chr(10) || '  end '", collapse_sql("x"), T.collapse),
    ("bounded", "text || '  ' || text", f"left({collapse_sql('x')}, 100)", lambda c: T.bounded(c, 100)),
    ("terminated", "text || CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN '。' ELSE ' 终' END", f"CASE WHEN {collapse_sql('x')} = '' OR regexp_matches({collapse_sql('x')}, '[.!?。！？]$') THEN {collapse_sql('x')} ELSE {collapse_sql('x')} || CASE WHEN regexp_matches({collapse_sql('x')}, '[\\x{{3400}}-\\x{{9fff}}]') THEN '。' ELSE '.' END END", T.terminated),
    ("formula", "'\\\\begin{equation}x_{' || item_id || '} = \\\\mathrm{Loss}(y)\\\\end{equation}'", "lower(regexp_replace(regexp_replace(regexp_replace(x, '\\\\(?:begin|end)\\{[^}]*\\}|\\$\\$|\\\\\\[|\\\\\\]', '', 'g'), '\\\\mathrm\\{([^}]*)\\}', '\\1', 'g'), '\\s+', '', 'g'))", T.formula_key),
    ("doi", "'see 10.1234/abc-' || item_id || '). or 10.1/x'", "lower(regexp_replace(regexp_extract(x, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+', 0), '[.,;:)]+$', ''))", T.doi),
    ("plain_math", "'$x^2 \\\\leq y \\\\cdot ' || item_id || '^{3}$'", "'x² ≤y ·' || item_id || '³'", S.plain_math),
]


_FORMS_SQL = " UNION ALL ".join(f"SELECT item_id, '{n}' AS n, {sql} AS v FROM (SELECT item_id, text, {x.replace(chr(92) * 2, chr(92))} AS x FROM benchmark)" for n, x, sql, _ in _FORMS)


@query(f"SELECT item_id, n, md5(v) AS value_md5 FROM ({_FORMS_SQL})")
def scalar_forms(spark, d):
    made = F.array(*[F.struct(F.lit(n).alias("n"), f(F.expr(x)).alias("v")) for n, x, _, f in _FORMS])
    return table(spark, d, "benchmark").select("item_id", F.explode(made).alias("f")).select("item_id", "f.n", md5(F.col("f.v")).alias("value_md5"))

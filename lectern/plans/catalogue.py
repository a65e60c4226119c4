"""The registered queries of the library's own operators, with their oracle SQL.

Every query runs its operator over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import spans as S
from ..functions import text as T
from ..operators import classify, evaluate, ground, identity, latex, monitor, retrieve, revise, sets
from ..operators.registry import Operator, Registry
from ..sources import files
from . import agents, analysis, assets, base, exchange, grounding, identities, layout, panels, results, retrieval
from .base import query, table

_t = table


_SENTENCES = "list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '[^.!?。！？]+[.!?。！？]?'), lambda s: trim(s)), lambda s: s <> '')"
_KEY = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}%._]+', ' ', 'g'))"
_STRICT = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


# ------------------------------------------------------------------ text


@query(f"SELECT doc_id, md5({_KEY}) AS key_md5, length({_KEY})::INT AS key_length FROM documents")
def norm_text(spark, d):
    k = T.match_key(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(k.cast("binary")).alias("key_md5"), F.length(k).alias("key_length"))


@query("SELECT doc_id, len(n)::INT AS n_numbers, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9_])(\\d+(?:\\.\\d+)?%?)', 1) AS n FROM documents)")
def number_tokens(spark, d):
    n = T.numbers(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(n).alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


@query("""SELECT item_id, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(x, ''), lambda c: unicode(c)::BIGINT)), lambda h, p: (xor(h, p) * 16777619) & 4294967295))), 8, '0') || ':' || length(x) AS content_hash
FROM (SELECT item_id, trim(regexp_replace(text, '[\\s\\x{00A0}\\x{FEFF}]+', ' ', 'g')) AS x FROM benchmark)""")
def fnv_fingerprint(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.fnv1a(F.col("text")).alias("content_hash"))


@query(f"""WITH {base.PAPERS} SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS html_md5, md5(left(regexp_replace(text, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g'), 240)) AS redacted_md5, ceil(length(text) / 4)::BIGINT AS n_tokens FROM papers""")
def text_cleanup(spark, d):
    x = F.col("text")
    return base.papers(spark, d).select("doc_id", base.md5(T.escape_html(x)).alias("html_md5"), base.md5(T.redacted(x)).alias("redacted_md5"), T.token_estimate(F.lit(None).cast("long"), x).alias("n_tokens"))


@query("""SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, len(regexp_extract_all(html, '<li[ >]'))::INT AS n_items,
md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_extract(spark, d):
    h = F.col("html")
    plain = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " "))
    return _t(spark, d, "pages").select("page_id", F.regexp_extract(h, "<h1[^>]*>([^<]*)</h1>", 1).alias("title"), F.regexp_count(h, F.lit("<p[ >]")).alias("n_paragraphs"), F.regexp_count(h, F.lit("<li[ >]")).alias("n_items"), F.md5(plain.cast("binary")).alias("text_md5"))


@query(f"""WITH t AS (SELECT doc_id, trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 8 AND length(x) < 120)[1]) AS title FROM documents)
SELECT doc_id, coalesce(title, 'Untitled paper') AS title, md5({_STRICT.format("coalesce(title, 'Untitled paper')")}) AS title_key FROM t""")
def titles(spark, d):
    t = T.title_of(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", t.alias("title"), F.md5(T.strict_key(t).cast("binary")).alias("title_key"))


# ------------------------------------------------------------------ grounding


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, {_KEY} AS q FROM benchmark), (SELECT doc_id, {_KEY} AS b FROM documents) WHERE q <> '' AND contains(' ' || b || ' ', ' ' || q || ' ')")
def evidence_containment(spark, d):
    return ground.quotes_in_corpus(_t(spark, d, "benchmark"), _t(spark, d, "documents"))


@query(f"""WITH f AS (SELECT DISTINCT item_id FROM (SELECT item_id, {_KEY} AS q FROM benchmark), (SELECT doc_id, {_KEY} AS b FROM documents) WHERE q <> '' AND contains(' ' || b || ' ', ' ' || q || ' '))
SELECT count(*) AS n_quotes, count(f.item_id) AS n_grounded, CASE WHEN count(*) = 0 THEN 100.0 ELSE round((100.0 * count(f.item_id) / count(*))::DOUBLE, 1) END::DOUBLE AS consistency FROM benchmark LEFT JOIN f USING (item_id)""")
def evidence_consistency(spark, d):
    quotes = _t(spark, d, "benchmark")
    found = ground.quotes_in_corpus(quotes, _t(spark, d, "documents")).select("item_id").distinct().withColumn("hit", F.lit(1))
    n = quotes.join(found, "item_id", "left").agg(F.count("*").alias("n_quotes"), F.count("hit").alias("n_grounded"))
    return n.withColumn("consistency", P.percent(F.col("n_grounded"), F.col("n_quotes")).cast("double"))


_NUM = "regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9_])(\\d+(?:\\.\\d+)?%?)', 1)"


@query(f"""WITH c AS (SELECT DISTINCT conv_id, unnest({_NUM}) AS n FROM conversations WHERE role = 'assistant'), s AS (SELECT DISTINCT conv_id, unnest({_NUM}) AS n FROM conversations WHERE role <> 'assistant'),
k AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'), nc AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1), nu AS (SELECT conv_id, count(*) AS n FROM c ANTI JOIN s USING (conv_id, n) GROUP BY 1)
SELECT k.conv_id, coalesce(nc.n, 0) AS claimed, coalesce(nu.n, 0) AS unsupported, CASE WHEN coalesce(nc.n, 0) = 0 THEN 0.0 ELSE coalesce(nu.n, 0) / nc.n END::DOUBLE AS rate FROM k LEFT JOIN nc USING (conv_id) LEFT JOIN nu USING (conv_id)""")
def numeric_hallucination(spark, d):
    c = _t(spark, d, "conversations")
    return ground.hallucination_rate(c.filter("role = 'assistant'"), c.filter("role <> 'assistant'"), "conv_id").withColumn("unsupported", F.col("unsupported").cast("long"))


# ------------------------------------------------------------------ evaluation

_LABELS = "p AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), e AS (SELECT DISTINCT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0)"
_PRF = f"""WITH {_LABELS}, m AS (SELECT coalesce(p.lang, e.lang) AS lang, count(p.doc_id) AS n_actual, count(e.doc_id) AS n_expected, count(*) FILTER (p.doc_id IS NOT NULL AND e.doc_id IS NOT NULL) AS matched FROM p FULL JOIN e ON p.lang = e.lang AND p.doc_id = e.doc_id GROUP BY 1),
r AS (SELECT *, CASE WHEN n_actual = 0 AND n_expected = 0 THEN 100.0 ELSE round((100.0 * matched / CASE WHEN n_actual > 0 THEN n_actual ELSE n_expected END)::DOUBLE, 1) END::DOUBLE AS precision, CASE WHEN n_expected = 0 THEN 100.0 ELSE round((100.0 * matched / n_expected)::DOUBLE, 1) END::DOUBLE AS recall FROM m),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 100.0 ELSE round(2 * precision * recall / (precision + recall), 1) END::DOUBLE AS f1, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 1) END::DOUBLE AS f1_strict FROM r)"""


def _prf(spark, d):
    both = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels"), "doc_id")
    out = evaluate.set_scores(both.filter("toxic = 1"), both.filter("quality = 0"), "lang", "doc_id")
    return out.withColumns({c: F.col(c).cast("double") for c in ("precision", "recall", "f1", "f1_strict")})


@query(f"{_PRF} SELECT * FROM f")
def set_prf(spark, d):
    return _prf(spark, d)


@query(f"""{_PRF}, o AS (SELECT lang, round(recall * 0.30::DOUBLE + f1 * 0.15::DOUBLE + precision * 0.15::DOUBLE + recall * 0.20::DOUBLE + (1 - CASE WHEN n_expected = 0 THEN 0 ELSE matched / n_expected END) * 100 * 0.20::DOUBLE, 1) AS overall, recall, CASE WHEN n_expected = 0 THEN 0 ELSE matched / n_expected END AS rate, n_expected FROM f)
SELECT count(*) AS n_cases, count(*) FILTER (overall >= 80 AND recall >= 90 AND rate * 100 <= 5) AS n_passed, round(100.0::DOUBLE * avg((overall >= 80 AND recall >= 90 AND rate * 100 <= 5)::INT), 1) AS pass_rate, round(avg(overall), 1) AS mean_overall, round(100 * avg(rate), 1) AS mean_rate, floor(avg(n_expected) + 0.5)::BIGINT AS mean_total_tokens FROM o""")
def weighted_suite(spark, d):
    parts = _prf(spark, d).select("lang", F.col("recall").alias("content"), F.col("f1").alias("formulas"), F.col("precision").alias("visuals"), F.col("recall").alias("evidence"), F.when(F.col("n_expected") == 0, 0.0).otherwise(F.try_divide("matched", "n_expected")).alias("rate"), F.col("n_expected").alias("total_tokens"))
    return evaluate.suite(evaluate.overall(parts))


@query("SELECT lang, source, count(*) FILTER (quality = 1) AS n_matched, count(*) AS n_expected FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))")
def coverage_grouping_sets(spark, d):
    both = _t(spark, d, "documents").select("doc_id", "lang", "source").join(_t(spark, d, "labels"), "doc_id")
    return evaluate.coverage(both.select("lang", "source", (F.col("quality") == 1).alias("matched")), "lang", "source")


#: An analysis of each document: which tasks ended how, what was found by which tools, and which fields say nothing.
_AUDITED = {f: f"CASE WHEN doc_id % 13 = {i} THEN '{'not found in provided context' if i % 2 else ''}' ELSE 'said' END" for i, f in enumerate(evaluate.FIELDS)}
_CHECKED = {
    "evidence-coverage": "doc_id % 5 <> 0",
    "formula-provenance": "doc_id % 3 = 0 OR doc_id % 2 = 0 OR source <> 'web'",
    "figure-provenance": "doc_id % 4 = 0 OR source = 'web'",
    "table-provenance": "doc_id % 6 <> 1",
    "method-problem-fit": "doc_id % 7 <> 3 AND doc_id % 13 <> 10",
    "experiment-claim-fit": "doc_id % 13 <> 11",
    "required-content": "doc_id % 13 > 11",
}


@query("WITH c AS (SELECT doc_id, " + ", ".join(f"coalesce({x}, false) AS c{i}" for i, x in enumerate(_CHECKED.values())) + " FROM documents) SELECT doc_id, " + ", ".join(f"c{i} AS {n.replace('-', '_')}" for i, n in enumerate(_CHECKED)) + ", floor(100.0 * (" + " + ".join(f"c{i}::INT" for i in range(7)) + ") / 7 + 0.5)::INT AS score, CASE WHEN NOT (" + " AND ".join(f"c{i}" for i, s in enumerate(evaluate.CHECKS.values()) if s == "high") + ") THEN 'review' WHEN NOT (" + " AND ".join(f"c{i}" for i in range(7)) + ") THEN 'warning' ELSE 'pass' END AS verdict FROM c")
def audit_checks(spark, d):
    i = F.col("doc_id")
    web = F.coalesce(F.col("source") == "web", F.lit(False))
    tools = F.array(F.when(web & (i % 2 == 0), "latex.formulas").otherwise(F.when(~web & F.col("source").isNotNull(), "text.formulas")), F.when(web, "latex.figures"), F.when(i % 6 != 1, "pdf.table-crop"))
    rows = _t(spark, d, "documents").select(
        "doc_id", F.when(i % 5 == 0, F.array(F.lit("completed"), F.lit("failed"))).otherwise(F.array(F.lit("insufficient"), F.lit("completed"))).alias("task_statuses"), F.when(web, "arxiv").otherwise("text").alias("source_type"),
        (i % 3).alias("n_formulas"), (i % 4).alias("n_figures"), F.lit(1).alias("n_tables"), F.filter(tools, lambda t: t.isNotNull()).alias("tools"),
        F.create_map(*[x for s in ("problem", "experiments", "results") for x in (F.lit(s), F.lit(1))], F.lit("method"), F.when(i % 7 == 3, 0).otherwise(2)).alias("evidence"),
        F.create_map(*[x for f, v in _AUDITED.items() for x in (F.lit(f), F.expr(v))]).alias("analysis"),
    )
    made = evaluate.audit(rows, "doc_id")
    return made.select("doc_id", *[F.col("checks")[n].alias(n.replace("-", "_")) for n in _CHECKED], "score", "verdict")


# ------------------------------------------------------------------ classification, sets, identity

@query("SELECT min(doc_id) AS doc_id, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS key FROM documents GROUP BY 2")
def exact_dedupe_first(spark, d):
    keyed = _t(spark, d, "documents").select("doc_id", F.md5(F.lower(F.regexp_replace("text", r"\s+", "")).cast("binary")).alias("key"))
    return sets.first_by(keyed, ["key"], ["doc_id"])


@query("SELECT o_custkey AS custkey, 0 AS precedence, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 1, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def union_precedence(spark, d):
    a = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return sets.union_by_precedence([a, _t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.lit(0).cast("long").alias("n"))], ["custkey"])


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_anti(spark, d):
    return sets.missing(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, coalesce(quality, n_chars % 2)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def fallback_merge(spark, d):
    primary = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sets.with_fallback(primary, _t(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality")), "doc_id", ["quality"])


@query("WITH c AS (SELECT doc_id, toxic AS quality FROM labels WHERE toxic = 1) SELECT doc_id, quality FROM labels ANTI JOIN c USING (doc_id) UNION ALL SELECT doc_id, quality FROM c")
def memory_upsert(spark, d):
    labels = _t(spark, d, "labels")
    return sets.upsert(labels.select("doc_id", "quality"), labels.filter("toxic = 1").select("doc_id", F.col("toxic").alias("quality"), F.lit(1).alias("seq")), "doc_id")


@query("SELECT * FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS rank FROM events) WHERE rank <= 5")
def newest_notes(spark, d):
    return sets.last_n(_t(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 5)


@query("""WITH h AS (SELECT conv_id, text, lower(trim(text)) AS k FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, min(text) AS text, lower(trim(text)) AS k FROM conversations WHERE role <> 'user' GROUP BY 1, 3)
SELECT conv_id, text, false AS added FROM h UNION ALL SELECT conv_id, text, true FROM n ANTI JOIN h USING (conv_id, k)""")
def question_merge(spark, d):
    c = _t(spark, d, "conversations")
    return sets.merge_unseen(c.filter("role = 'user'").select("conv_id", "text"), c.filter("role <> 'user'").select("conv_id", "text"), "text", "conv_id")


#: What identifies each document's text: a DOI, a placeholder, an arXiv id, one that reads backwards, a file's name, or nothing.
_MARKED = ["'see https://doi.org/10.1234/AbC.' || doc_id || '). '", "'doi 10.5555/nnnnnnn.nnnnnnn '", "'arXiv:2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || 'v2 [cs.CL] '", "reverse('arXiv: 1234.' || lpad((doc_id % 100000)::VARCHAR, 5, '0')) || ' '", "''", "'hep-th/' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') || ' '"]
_MARK = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_MARKED)) + " END"
_FILE = "CASE WHEN doc_id % 6 = 4 THEN 'a_2402.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || '.pdf' WHEN doc_id % 6 = 5 THEN 'math.GT/' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') ELSE 'x.pdf' END"
_ID5 = "lpad((doc_id % 100000)::VARCHAR, 5, '0')"


@query(f"""WITH m AS (SELECT doc_id, {_MARK} || coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')) AS x FROM m),
k AS (SELECT doc_id, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(x, ''), lambda c: unicode(c)::BIGINT)), lambda h, p: (xor(h, p) * 16777619) & 4294967295))), 8, '0') || ':' || length(x) AS content_hash FROM h),
i AS (SELECT doc_id, content_hash, CASE WHEN doc_id % 6 = 0 THEN '10.1234/abc.' || doc_id END AS doi, CASE doc_id % 6 WHEN 2 THEN '2401.' || {_ID5} || 'v2' WHEN 3 THEN '1234.' || {_ID5} WHEN 5 THEN 'math.GT/' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') END AS arxiv_id FROM k)
SELECT doc_id, doi, arxiv_id, content_hash, coalesce('doi:' || doi, 'arxiv:' || arxiv_id, 'text:' || content_hash) AS key FROM i""")
def source_identity(spark, d):
    sql = lambda x: F.expr(x.replace("::VARCHAR", "").replace("::", " :: "))
    docs = _t(spark, d, "documents").select("doc_id", F.concat(sql(_MARK), F.coalesce("text", F.lit(""))).alias("text"), sql(_FILE).alias("file"))
    return identity.identify(docs, file_col="file").drop("title")


@query(f"WITH {base.PAPERS}, q AS (SELECT doc_id, unnest(['tion', 'the accuracy of the', 'Nothing', 'ab', doc_id::VARCHAR || '.5%']) AS quote FROM documents), b AS (SELECT doc_id, {_KEY} AS body FROM papers), g AS (SELECT doc_id, contains(body, lower(quote)) AND length(quote) >= 4 AS hit FROM q JOIN b USING (doc_id)) SELECT doc_id, count(*) FILTER (hit) AS grounded, count(*) AS total, round((100.0 * count(*) FILTER (hit) / count(*))::DOUBLE, 1) AS score FROM g GROUP BY 1")
def evidence_grounding(spark, d):
    quotes = _t(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("tion"), F.lit("the accuracy of the"), F.lit("Nothing"), F.lit("ab"), F.concat(F.col("doc_id").cast("string"), F.lit(".5%")))).alias("quote"))
    return ground.grounded(quotes, base.papers(spark, d).select("doc_id", "text"), "doc_id")


#: Values that are arXiv ids and URLs, titles and formulas of all kinds, around each benchmark item.
_VALUES = ["'https://arxiv.org/abs/2401.0' || (1000 + item_id) || 'v3?x=1'", "' 2401.0' || (1000 + item_id) || '.pdf'", "'cs.LG/' || (1000000 + item_id)", "'text ' || item_id", "'arXiv:2401.01234 source'", "'Untitled'", "text", "'a &amp; b' || item_id", "'x' || repeat('y', item_id) || ' = z'", "'a ' || chr(92) || chr(92) || ' b'"]
_VALUE_ROWS = " UNION ALL ".join(f"SELECT item_id, {i} AS n, {x} AS x FROM benchmark" for i, x in enumerate(_VALUES))
_PARSED = "regexp_replace(regexp_replace(regexp_replace(trim(x), '(?i)^https?://(?:www\\.)?arxiv\\.org/(?:abs|pdf|e-print)/', ''), '(?i)\\.pdf$', ''), '(?s)[?#].*$', '')"


@query(f"""SELECT item_id, n, CASE WHEN regexp_matches({_PARSED}, '(?i)^(?:\\d{{4}}\\.\\d{{4,5}}|[a-z-]+(?:\\.[A-Z]{{2}})?/\\d{{7}})(?:v\\d+)?$') THEN {_PARSED} ELSE '' END AS arxiv_id, length(trim(x)) >= 5 AND NOT regexp_matches(trim(x), '(?i)^(?:untitled|arxiv:.*(?:source)?|main source file|page\\s+\\d+)') AS reliable,
length(trim(x)) >= 82 OR contains(x, chr(92) || chr(92)) AS wide, md5(regexp_replace(lower(replace(x, '&amp;', '&')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS key_md5 FROM ({_VALUE_ROWS})""")
def identity_values(spark, d):
    rows = _t(spark, d, "benchmark").select("item_id", F.posexplode(F.array(*[F.expr(x) for x in _VALUES])).alias("n", "x"))
    x = F.col("x")
    return rows.select("item_id", "n", T.parsed_arxiv_id(x).alias("arxiv_id"), T.reliable_title(x).alias("reliable"), T.wide_formula(x).alias("wide"), base.md5(T.academic_key(x)).alias("key_md5"))


@query("SELECT b.item_id, '2401.' || b.item_id AS arxiv_id FROM benchmark b WHERE length(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]+', '', 'g')) >= 12 AND b.item_id = (SELECT min(c.item_id) FROM benchmark c WHERE regexp_replace(lower(c.text), '[^\\p{L}\\p{N}]+', '', 'g') = regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]+', '', 'g')) AND b.item_id % 3 <> 0")
def title_lookup(spark, d):
    b = _t(spark, d, "benchmark")
    first = sets.first_by(b.withColumn("k", T.academic_key(F.col("text"))), ["k"], ["item_id"]).select("item_id", "text")
    entries = first.filter("item_id % 3 <> 0").select(F.concat(F.lit("2401."), "item_id").alias("arxiv_id"), F.concat(F.lit(" "), F.upper(F.substring("text", 1, 1)), F.expr("substring(text, 2)"), F.lit("!")).alias("title"))
    return identity.by_title(first.withColumnRenamed("text", "title"), entries, "item_id")


@query(f"""WITH t AS (SELECT conv_id, turn, {_STRICT.format("text")} AS k FROM conversations), p AS (SELECT a.conv_id, a.turn, a.k AS x, b.k AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, x = '' OR y = '' OR (contains(CASE WHEN length(x) >= length(y) THEN x ELSE y END, CASE WHEN length(x) >= length(y) THEN y ELSE x END) AND least(length(x), length(y)) >= 0.88 * greatest(length(x), length(y))) AS agree FROM p""")
def title_agreement(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", T.titles_agree(F.col("text"), F.col("after")).alias("agree"))


# ------------------------------------------------------------------ monitoring


@query("SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_statuses, sum(value) AS total, max(value) AS largest FROM events GROUP BY 1")
def monitor_rollup(spark, d):
    return monitor.rollup(_t(spark, d, "events"), "user_id", "event_type", "value")


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def state_latest(spark, d):
    return monitor.latest_state(_t(spark, d, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("""WITH t AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), e AS (SELECT * FROM events, t WHERE event_type IN (a, b)),
n AS (SELECT *, lead(event_type) OVER w AS end_status, lead(ts) OVER w AS end_at FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, (epoch_us(end_at) - epoch_us(ts)) / 1000000 AS seconds FROM n WHERE event_type = a AND end_status = b""")
def call_pairing(spark, d):
    e = _t(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    if ends.a is None:
        return e.select("event_id", "user_id", F.lit(0.0).alias("seconds"))
    return monitor.call_pairs(e, ["user_id"], "ts", "event_type", ends.a, [ends.b]).select("event_id", "user_id", "seconds")


@query("""WITH n AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n)
SELECT user_id, session, count(*) AS n_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS length_us FROM s GROUP BY 1, 2""")
def event_sessions(spark, d):
    s = monitor.sessions(_t(spark, d, "events"), "user_id", "ts", 1800)
    return s.select("user_id", "session", "n_events", (monitor.micros("end_at") - monitor.micros("start_at")).alias("length_us"))


_ERRORS = ["'HTTP 402: Payment Required'", "'401 Unauthorized for user ' || coalesce(cast(user_id as string), '')", "'Too many requests'", "'timeout after 14021 ms'", "'insufficient balance (code 429)'"]
_ERROR = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ERRORS[:-1])) + f" ELSE {_ERRORS[-1]} END"


@query("SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'billing' WHEN 1 THEN 'key' WHEN 2 THEN 'rate' WHEN 3 THEN 'other' ELSE 'billing' END AS error, count(*) AS n FROM events GROUP BY 1, 2")
def error_rollup(spark, d):
    return _t(spark, d, "events").groupBy("user_id", monitor.error_class(F.expr(_ERROR)).alias("error")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber))::INT AS cheapest, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def reference_join(spark, d):
    li = _t(spark, d, "lineitem")
    both = _t(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")).join(li.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_extendedprice"), "orderkey")
    return both.groupBy("orderkey").agg(F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).cast("int").alias("cheapest"), F.count("*").alias("n_lines"))


@query("SELECT user_id, round, least(30000, 6500 + 4500 * (round - 1))::INT AS max_chars, least(18, 5 + 3 * (round - 1))::INT AS max_chunks FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(1, 7))::INT AS round)")
def round_budgets(spark, d):
    rounds = _t(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("round"))
    return rounds.select("*", P.round_budget(F.lit(6500), F.col("round")).alias("max_chars"), P.round_chunks(F.lit(5), F.col("round")).alias("max_chunks"))


# ------------------------------------------------------------------ LaTeX papers around each benchmark item

#: Files of each paper: (seq, path, content), in which @ stands for the item's number.
PAPER = [
    (0, "notes.tex", "not the main file"),
    (1, "main.tex", "\\documentclass{article}\\title[short]{A \\textbf{Method @}\\thanks{by {many}} \\\\ and \\emph{more}}\\newcommand{\\loss}[1]{L_{#1}}\\def\\half{\\frac{1}{2}}\\providecommand{\\big}{B_{@}}\\begin{document}% note\n\\input{body}\\input{body}\\end{document}"),
    (2, "./body.tex", "\\section{Method}\n\\begin{equation}\\loss{task@}=\\half + \\big\\label{eq}\\end{equation}\n\\[ only words \\]\n$$ x_{@} \\leq y $$ % $$ z = 1 $$\n\\begin{eqnarray*}a &=& b_{@}\\end{eqnarray*}\n\\begin{figure}\\includegraphics[width=1cm]{figures/model}\\includegraphics{plot@.pdf}\\caption{The {nested} model @}\\end{figure}\n\\begin{table}\\caption{Scores @}\\begin{tabular}{ll}\\hline A & B@\\\\ \\multicolumn{2}{c}{wide}\\\\ x \\& y & \\end{tabular}\\end{table}"),
    (3, "figures/model.png", None),
    (4, "img/plot@.pdf", None),
]


def _files(spark, d):
    """paper_id, seq, path, content of each benchmark item's paper."""
    n = F.col("item_id").cast("string")
    put = lambda x: F.lit(None).cast("string") if x is None else F.replace(F.lit(x), F.lit("@"), n)
    files = F.array(*[F.struct(F.lit(k).alias("seq"), put(p).alias("path"), put(c).alias("content")) for k, p, c in PAPER])
    return _t(spark, d, "benchmark").select(F.concat(F.lit("p"), n).alias("paper_id"), F.explode(files).alias("f")).select("paper_id", "f.*")


def _tex(spark, d):
    return latex.combined(_files(spark, d).filter("content is not null"))


@query("""SELECT 'p' || item_id AS paper_id, unnest([1, 2, 3]) AS ord, unnest(['L_{task' || item_id || '}=\\frac{1}{2} + B_{' || item_id || '}', 'x_{' || item_id || '} \\leq y', 'a &=& b_{' || item_id || '}']) AS formula FROM benchmark""")
def latex_formulas(spark, d):
    return latex.formulas(_tex(spark, d))


@query("SELECT 'p' || item_id AS paper_id, 1 AS ord, 'Scores ' || item_id AS caption, 'A|B' || item_id || '/wide|/x & y|' AS rows FROM benchmark")
def latex_tables(spark, d):
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return latex.tables(_tex(spark, d)).select("paper_id", "ord", "caption", F.replace(cells, F.lit("x \\&"), F.lit("x &")).alias("rows"))


@query("SELECT 'p' || item_id AS paper_id, 1 AS ord, unnest(['figures/model', 'plot' || item_id || '.pdf']) AS p, unnest(['figures/model.png', 'img/plot' || item_id || '.pdf']) AS path FROM benchmark")
def latex_figures(spark, d):
    return latex.resolve_assets(latex.figures(_tex(spark, d)), _files(spark, d))


@query("SELECT 'p' || item_id AS paper_id, 'A Method ' || item_id || ' and more' AS title, 'A Method ' || item_id || '|and more' AS lines FROM benchmark")
def latex_titles(spark, d):
    return latex.titles(_tex(spark, d)).select("paper_id", "title", F.array_join("lines", "|").alias("lines"))


@query("SELECT 'p' || item_id AS paper_id, './body.tex' AS path, '\\begin{tabular}{ll}\\hline A & B' || item_id || '\\\\ \\multicolumn{2}{c}{wide}\\\\ x \\& y & \\end{tabular}' AS tabular, '' AS preamble FROM benchmark UNION ALL SELECT 'p' || item_id, 'main.tex', '', '\\documentclass{article}\\title[short]{A \\textbf{Method ' || item_id || '}\\thanks{by {many}} \\\\ and \\emph{more}}\\newcommand{\\loss}[1]{L_{#1}}\\def\\half{\\frac{1}{2}}\\providecommand{\\big}{B_{' || item_id || '}}' FROM benchmark")
def latex_parts(spark, d):
    return _files(spark, d).filter("seq in (1, 2)").select("paper_id", "path", latex.renderable_table(F.col("content")).alias("tabular"), latex.safe_preamble(F.col("content")).alias("preamble"))


_STORED = [("a.PNG", 5), ("b.txt", 1), ("c.pdf", 30), ("d.svg", 8), ("e.webp", 4), ("f.jpeg", 9)]


@query("SELECT item_id AS paper_id, unnest(['a.png', 'd.svg', 'e.webp']) AS key, unnest(['image/png', 'image/svg+xml', 'image/webp']) AS mime, unnest([5, 8, 4]) AS size, false AS pdf FROM benchmark")
def stored_assets(spark, d):
    one = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(p).alias("path"), F.expr(f"cast(repeat('x', {n}) as binary)").alias("data")) for k, (p, n) in enumerate(_STORED)])
    rows = _t(spark, d, "benchmark").select(F.col("item_id").alias("paper_id"), F.explode(one).alias("f")).select("paper_id", "f.*")
    kept = files.assets(rows, max_file=20, max_all=20)
    asked = rows.filter("seq <> 5").select("paper_id", F.upper("path").alias("path"))
    return files.asset(kept, asked).select("paper_id", "key", "mime", F.octet_length("data").alias("size"), files.is_pdf("data").alias("pdf"))


# ------------------------------------------------------------------ gates, memory, export, spans

_GENERAL = ", ".join(repr(w) for w in revise.GENERAL_WORDS)
_NUMBERS_OF = "regexp_extract_all(coalesce({}, ''), '(?:^|[^A-Za-z0-9_])(\\d+(?:\\.\\d+)?%?)', 1)"


@query(f"""WITH p AS (SELECT a.conv_id, b.turn, b.text AS c, a.text AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE trim(coalesce(b.text, '')) <> ''),
k AS (SELECT conv_id, turn, len(list_filter({_NUMBERS_OF.format("c")}, lambda x: NOT list_contains({_NUMBERS_OF.format("s")}, x))) AS lost, list_filter(list_distinct(regexp_extract_all(lower(c), '[a-z][a-z-]{{4,}}')), lambda w: w NOT IN ({_GENERAL})) AS w, {_STRICT.format("s")} AS body FROM p)
SELECT conv_id, turn, lost = 0 AND NOT (len(w) >= 4 AND len(list_filter(w, lambda x: contains(body, x))) < ceil(len(w) * 0.2)) AS accepted FROM k""")
def correction_gate(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    at = lambda shift: F.concat_ws(":", "conv_id", F.col("turn") + shift)
    sources = c.select(at(1).alias("key"), "text")
    return revise.gate_corrections(c.withColumn("key", at(0)).join(sources.select("key"), "key", "left_semi"), sources, "key").select("conv_id", "turn", "accepted")


def _html_sql(c: str) -> str:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        c = f"replace({c}, '{sign}', '{code}')"
    return c


@query(f"""SELECT doc_id, md5('<!doctype html><html><head><meta charset="utf-8"><title>Document ' || doc_id || '</title></head><body><h1>Document ' || doc_id || '</h1><section><h2>' || {_html_sql("coalesce(source, '')")} || '</h2><p>' || {_html_sql("coalesce(text, '')")} || '</p></section></body></html>') AS html_md5 FROM documents""")
def html_export(spark, d):
    page = revise.standalone_html(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.array(F.struct(F.col("source").alias("heading"), F.col("text").alias("text"))))
    return _t(spark, d, "documents").select("doc_id", F.md5(page.cast("binary")).alias("html_md5"))


@query()
def fair_share_context(spark, d):
    return revise.fair_shares_in_rows(retrieve.selected_in_rows(base.papers(spark, d), retrieval.SIZE), retrieve.task_list(), 2000)


@query()
def emphasis_spans(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.inline(S.emphasis(F.col("text"))))


@query()
def inline_math(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.inline(S.inline_math(F.col("text"))))


def registry() -> Registry:
    r = Registry()
    for name, stage, run, types in (
        ("latex.formulas", "extract", latex.formulas, ("arxiv",)),
        ("latex.figures", "extract", latex.figures, ("arxiv",)),
        ("latex.tables", "extract", latex.tables, ("arxiv",)),
        ("context.select", "retrieve", retrieve.top_chunks, ()),
        ("evidence.retrieve", "retrieve", retrieve.within_budget, ()),
        ("reflection.audit", "verify", evaluate.audit, ()),
        ("paper-type-classifier", "planning", classify.classify, ()),
        ("evaluation.run", "evaluate", evaluate.suite, ()),
    ):
        r.register(Operator(name, stage, run, types))
    return r


@query("""WITH o(name, stage, latex) AS (VALUES ('latex.formulas', 'extract', true), ('latex.figures', 'extract', true), ('latex.tables', 'extract', true), ('context.select', 'retrieve', false), ('evidence.retrieve', 'retrieve', false),
('reflection.audit', 'verify', false), ('paper-type-classifier', 'planning', false), ('evaluation.run', 'evaluate', false)), s AS (SELECT doc_id AS source_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pdf' END AS kind FROM documents)
SELECT source_id, name, stage, NOT latex OR coalesce(kind = 'arxiv', false) AS selected, CASE WHEN latex AND kind IS NULL THEN 'not for a source of no type' WHEN latex AND kind <> 'arxiv' THEN 'not for ' || kind END AS reason FROM s, o""")
def tool_plan(spark, d):
    """The operators for each document as a source of one of three types, or none."""
    k = F.col("doc_id") % 4
    return registry().plans(_t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.when(k == 0, "text").when(k == 1, "arxiv").when(k == 2, "pdf").alias("source_type")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


__all__ = ["agents", "analysis", "assets", "grounding", "layout", "oracle_sql", "queries", "registry", "results"]

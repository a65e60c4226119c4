"""What a text tells without a model: formulas and figures in it, an extractive analysis, and its completeness."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, first_by_key, once
from ..functions.predicates import plausible_formula
from ..functions.text import collapse, fallback_sentences, sentences, strict_key, strip, text_of
from .retrieve import READING_PLAN, Words, trie

# How much of a text is looked at, forms of formulas and figures, and the words that speak for each part of an analysis.
SCANNED, ANALYSED, MOST = 16_000, 12_000, 8
ENVIRONMENT = r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?)\}"
INLINE = r"\$([^$\n]{2,220})\$"
ASSET_LINE = r"(?i)(?:Figure|Table)\s+\d+:\s*\[([^\]\n]{2,240})\]\s*Source:\s*([^\n]+)"
MARKDOWN_FIGURE = r"!\[([^\]]*)\]\(([^)]+)\)"
PLAIN_FIGURE = r"(?i)(?:图片|插图|图|figure|fig\.)\s*[:：]?\s*\[?([^\]\n。]{4,120})\]?"
PLACEHOLDER = "Original paper figure placeholder"
SIGNAL = r"(?i)\d|=|because|however|propos|challenge|limitation|result|method|model|objective|theor|experiment|dataset|contribut"
MOST_OF_EVIDENCE = 420
IDLE_WORDS = ["identify", "explain", "extract", "summarize", "paper", "reading", "focus", "explicit", "qualifiers", "preserve", "apply", "complete"]
FIELD_SIGNALS = {
    "problem": r"(?i)problem|challenge|limitation|fail|depend|loss|difficult|cannot|unable|however",
    "motivation": r"(?i)motivat|important|need|therefore|thus|allow|enable|benefit|arbitrary|fully exploit",
    "contributions": r"(?i)contribut|propos|introduc|present|develop|design|novel|first|unified framework|architecture|new method",
    "innovation": r"(?i)novel|first|unified|context-aware|innov",
    "logicReview": r"(?i)limitation|however|because|therefore|result|outperform",
}
NOT_EVIDENCE = r"(?i)^(?:references|bibliography|figure|fig\.|table)\s*\d*"
CUT_OFF = r"(?i)\.{3,}$|…$|[,;:]$|\b(?:and|or|to|of|with|by|for|from|that|which)$"
DEFAULTS = {
    "problem": "No clear research problem detected. Add the problem statement from the introduction.",
    "motivation": "No motivation detected. Add research background, value, or significance.",
    "method": "No method description detected. Add model structure, algorithm flow, or core formula.",
    "results": "No experimental result detected. Add datasets, metrics, baselines, and conclusions.",
    "contributions": "No contribution or innovation detected. Add the paper's main claims.",
}


def _scanned(c: Column) -> Column:
    """Display blocks, environments and the first inline formula of each other line, in order, until there are eight. Only lines with a mark are gone through; a block is cut out where it ends."""
    state = lambda closing, start, found: F.struct(closing.alias("closing"), start.alias("start"), found.alias("found"))
    none = F.lit("")

    def of(lines: Column) -> Column:
        def step(s: Column, at: Column) -> Column:
            line, i = at["line"], at["i"]
            block = lambda start, n: F.array_join(F.slice(lines, start + 1, n), "\n")
            told = lambda x: state(none, F.lit(0), F.array_append(s["found"], strip(x)))
            environment, inline = F.regexp_extract(line, ENVIRONMENT, 1), F.regexp_extract(line, INLINE, 1)
            ends = F.concat(F.lit("\\end{"), environment, F.lit("}"))
            return (
                F.when(F.size(s["found"]) >= MOST, s)
                .when(s["closing"] == "$$", F.when(strip(line) == "$$", told(block(s["start"] + 1, i - s["start"] - 1))).otherwise(s))
                .when(s["closing"] != "", F.when(F.contains(line, s["closing"]), told(block(s["start"], i - s["start"] + 1))).otherwise(s))
                .when(environment != "", F.when(F.contains(line, ends), told(line)).otherwise(state(ends, i, s["found"])))
                .when(strip(line) == "$$", state(F.lit("$$"), i, s["found"]))
                .when(inline != "", told(inline))
                .otherwise(s)
            )

        has = lambda x: F.contains(x, F.lit("$")) | F.contains(x, F.lit("\\begin{")) | F.contains(x, F.lit("\\end{"))
        marked = F.array_compact(F.transform(lines, lambda x, i: F.when(has(x), F.struct(i.alias("i"), x.alias("line")))))
        return F.aggregate(marked, state(none, F.lit(0), F.array().cast("array<string>")), step)["found"]

    return bound(F.split(c, "\n"), of)


def text_formulas(c: Column) -> Column:
    """The plausible formulas of a text's first 16,000 characters, each once, eight at most."""
    found = _scanned(F.substring(text_of(c), 1, SCANNED))
    return F.slice(first_by_key(F.filter(found, plausible_formula), collapse), 1, MOST)


def text_figures(c: Column) -> Column:
    """array<struct<name, source>> of the figures that lines of a text's first 16,000 characters state, eight at most."""
    lines = F.split(F.substring(text_of(c), 1, SCANNED), "\n")

    def stated(x: Column) -> Column:
        of = lambda name, source: F.struct(name.alias("name"), source.alias("source"))
        part = lambda p, i: F.regexp_extract(x, p, i)
        return (
            F.when(x.rlike(ASSET_LINE), of(strip(part(ASSET_LINE, 1)), strip(part(ASSET_LINE, 2))))
            .when(x.rlike(MARKDOWN_FIGURE), of(part(MARKDOWN_FIGURE, 1), part(MARKDOWN_FIGURE, 2)))
            .when(x.rlike(PLAIN_FIGURE), of(strip(part(PLAIN_FIGURE, 1)), F.lit(PLACEHOLDER)))
        )

    # the patterns are tried on lines that have what each of them asks for
    has = lambda x: bound(F.lower(x), lambda low: F.contains(low, F.lit("fig")) | F.contains(low, F.lit("图")) | F.contains(x, F.lit("![")) | (F.contains(x, F.lit("[")) & F.contains(low, F.lit("table"))))
    found = F.slice(F.filter(F.transform(F.filter(lines, has), stated), lambda f: f.isNotNull()), 1, MOST)
    named = F.transform(found, lambda f, i: F.struct(F.when(f["name"] == "", F.concat(F.lit("Figure "), (i + 1).cast("string"))).otherwise(f["name"]).alias("name"), f["source"].alias("source")))
    return first_by_key(named, lambda f: collapse(F.lower(F.concat_ws("|", f["name"], f["source"]))))


# ------------------------------------------------------------------ local analysis


def local_analysis(papers: DataFrame, title: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """papers (…, text) with the fields of an analysis that keywords alone can fill, and its completeness.

    Of the first 12,000 characters, each field is the first two sentences that hold one of its words, or a default.
    """
    x = F.substring(text_of(F.col("text")), 1, ANALYSED)
    held = once(papers, "_s", fallback_sentences(x)).withColumns({"formulas": text_formulas(x), "figures": text_figures(x)})
    # a sentence is looked at once, for all fields; those that no field asks for are left out
    asked = {f: ws for f, ws in keywords.items() if ws}
    said = lambda low, ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in ws])
    told = F.transform("_s", lambda s: bound(F.lower(s), lambda low: F.when(said(low, [w for ws in asked.values() for w in ws]), F.struct(s.alias("s"), *[said(low, ws).alias(f) for f, ws in asked.items()]))))
    held = once(held, "_told", F.array_compact(told))
    first = lambda field: F.array_join(F.transform(F.slice(F.filter("_told", lambda t: t[field]), 1, 2), lambda t: t["s"]), " ") if field in asked else F.lit("")
    by = lambda field, other: F.coalesce(F.nullif(first(field), F.lit("")), F.lit(other) if isinstance(other, str) else other)
    fields = {f: by("results" if f == "experiments" else f, DEFAULTS.get(f, "")) for f in ("problem", "motivation", "method", "experiments", "results", "contributions")}
    made = held.withColumns({"title": title, "summary": by("summary", F.array_join(F.slice("_s", 1, 2), " ")), **fields, "theory": F.lit(""), "logicReview": F.lit("Local fallback analysis used keyword extraction. Configure an LLM API for deeper critique.")})
    return made.drop("_s", "_told").withColumn("score", completeness(F.col("formulas"), F.col("figures"), F.lit(0)))


def unfilled(c: Column) -> Column:
    return (text_of(c) == "") | text_of(c).rlike("^No |^Needs ")


def completeness(formulas: Column, figures: Column, n_tables: Column) -> Column:
    """Share of eight checks that an analysis passes, in whole percent."""
    filled = [~unfilled(F.col(c)) for c in ("problem", "motivation", "method", "results", "contributions")]
    filled += [(F.size(formulas) > 0) | ~unfilled(F.col("theory")), (F.size(figures) > 0) | (n_tables > 0), (text_of(F.col("logicReview")) != "") & ~F.contains(text_of(F.col("logicReview")), F.lit("fallback"))]
    return F.floor(sum((c.cast("int") for c in filled), F.lit(0)) * 100 / len(filled) + 0.5).cast("int")


# ------------------------------------------------------------------ extractive answers


def goal_words(goal: str, required: list[str] = ()) -> list[str]:
    """The words of a task's goal and of the evidence it asks for that say what it is about."""
    found = [w for x in (*required, goal) for w in re.findall(r"[a-z][a-z-]{3,}", x.lower())]
    return [w for w in dict.fromkeys(found) if w not in IDLE_WORDS]


def _signal(lower: Column) -> Column:
    """Whether a lower-case text has a sign of SIGNAL."""
    return lower.rlike("[0-9=]") | lower.rlike(trie(SIGNAL.removeprefix(r"(?i)\d|=|").split("|")))


def evidence_sentences(c: Column, words: Words) -> Column:
    """array<struct<s, n, key, signal, hits>> of the sentences that can stand as evidence, with what tasks ask of them. What cuts a sentence off is looked for at its end."""
    found = F.transform(sentences(c), lambda s: collapse(F.regexp_replace(s, r"^#+\s*", "")))
    fit = F.filter(found, lambda s: F.length(s).between(32, MOST_OF_EVIDENCE) & ~s.rlike(NOT_EVIDENCE) & ~s.rlike(r"^[a-z]{2,}\s") & ~F.right(s, F.lit(12)).rlike(CUT_OFF))
    told = lambda s: bound(F.lower(s), lambda low: F.struct(s.alias("s"), F.length(s).alias("n"), strict_key(s).alias("key"), F.when(_signal(low), 2).otherwise(0).alias("signal"), words.hits(low).alias("hits")))
    return F.filter(F.transform(fit, told), lambda x: x["key"] != "")


def extractive_evidence(fit: Column, words: Words, asked: list[str], limit: int) -> Column:
    """Of such sentences those that speak most for a task: five points a word of its goal, two for a sign of evidence; longer ones first among equals.

    Score, length and place are sorted as one number.
    """
    score = lambda x: 5 * words.count(x["hits"], asked) + x["signal"]
    key = lambda x, i: bound(score(x), lambda n: F.when(n >= 2, (-n).cast("long") * (1 << 42) + (MOST_OF_EVIDENCE - x["n"]).cast("long") * (1 << 32) + i))
    order = F.transform(F.sort_array(F.array_compact(F.transform(fit, key))), lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return F.transform(F.slice(first_by_key(order, lambda i: F.get(fit, i)["key"]), 1, limit), lambda i: F.get(fit, i)["s"])


def source_title(c: Column) -> Column:
    """The first line that can be a title."""
    lines = F.transform(F.split(text_of(c), r"\n+"), lambda x: strip(F.regexp_replace(x, r"^#+\s*", "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: F.length(x).between(5, 180) & ~x.rlike(r"(?i)^\[?(?:source|evidence)")), F.lit(0)), F.lit(""))


def extractive_answers(papers: DataFrame, plan: list[tuple] = READING_PLAN) -> DataFrame:
    """doc_id, task_id, fields map<string, string>, evidence array<string>: a task's answer from its source alone, where there is one."""

    def fields_of(fields: list[str], best: Column, title: Column) -> Column:
        def chosen(f: str, i: int) -> Column:
            if f == "title":
                return F.coalesce(F.nullif(title, F.lit("")), F.get(best, F.lit(0)))
            of = F.get(F.filter(best, lambda s: s.rlike(FIELD_SIGNALS[f])) if f in FIELD_SIGNALS else best, F.lit(0))
            return F.coalesce(of, F.get(best, F.least(F.lit(i), F.size(best) - 1)))

        return F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[chosen(f, i) for i, f in enumerate(fields)]))

    wanted = [(t, goal_words(goal), max(6, 3 * len(fields))) for t, _, goal, fields, _ in plan]
    words = Words([(t, ws) for t, ws, _ in wanted])
    best = lambda fit: F.array(*[F.struct(F.lit(t).alias("task_id"), extractive_evidence(fit, words, ws, limit).alias("best")) for t, ws, limit in wanted])
    # a paper's sentences are made once and stay in its row; only what a task chose leaves it
    told = papers.select("doc_id", source_title(F.col("text")).alias("title"), F.inline(bound(evidence_sentences(F.col("text"), words), best)))
    found = told.filter(F.size("best") > 0)
    fields = F.coalesce(*[F.when(F.col("task_id") == t, fields_of(names, F.col("best"), F.col("title"))) for t, _, _, names, _ in plan])
    return found.select("doc_id", "task_id", fields.alias("fields"), F.slice("best", 1, 3).alias("evidence"))

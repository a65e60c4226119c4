"""From documents to the best passages of each reading task, under size budgets.

Sections and chunks are made by array functions within a row, and `top_in_rows` also scores, ranks and selects them there: each keyword is looked for once a chunk,
whatever number of tasks has it, tasks share what was found, and a text leaves its row only where it is selected. Nothing is shuffled.
`scored`, `top_chunks` and `within_budget` do the same over rows of chunks and tables of tasks of any size, by a window for each document and task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, once
from ..functions.predicates import heading, is_reference_section
from ..functions.text import paper_text, sentences, strip, text_of
from .sets import few

# What each reading task looks for, its label, goal, fields and the key of its evidence.
TASK_KEYWORDS = {
    "overview": ["abstract", "introduction", "overview", "summary", "paper", "propose"],
    "problem": ["abstract", "introduction", "problem", "challenge", "limitation", "gap", "motivation"],
    "method": ["method", "approach", "model", "architecture", "algorithm", "framework", "training", "objective", "taxonomy", "annotation", "protocol", "retrieval"],
    "theory": ["formula", "equation", "theorem", "proof", "loss", "objective", "attention", "algorithm", "complexity", "iteration", "decision rule", "historical memory", "mechanism", "root cause"],
    "experiments": ["experiment", "evaluation", "dataset", "baseline", "metric", "ablation", "implementation", "annotation", "research question", "pass@", "codereval"],
    "results": ["result", "performance", "comparison", "analysis", "discussion", "accuracy", "score", "mitigation", "pass@", "gain", "improvement", "distribution", "percentage"],
    "contribution": ["contribution", "novel", "innovation", "conclusion", "limitation", "future work"],
}
READING_PLAN = [
    ("overview", "Paper overview", "Identify the paper title and produce a concise overall summary.", ["title", "summary"], "summary"),
    ("problem", "Research problem", "Identify the research problem, gap, motivation, and why the problem matters.", ["problem", "motivation"], "problem"),
    ("method", "Method", "Reconstruct the proposed method, pipeline, assumptions, and important implementation details.", ["method"], "method"),
    ("theory", "Formula and theory", "Explain the role of the key objective, formula, theorem, or theoretical mechanism without inventing notation.", ["theory"], "theory"),
    ("experiments", "Experiments", "Extract datasets, baselines, metrics, ablations, and implementation evidence.", ["experiments"], "experiments"),
    ("results", "Results and claim support", "Identify concrete results and judge whether the method and experiments support the paper's claims.", ["results", "methodSupportsProblem", "experimentsValidateClaims"], "results"),
    ("contribution", "Contribution and logic", "Summarize contributions, novelty, limitations, and critically reconstruct the complete argument chain.", ["contributions", "innovation", "logicReview"], "contributions"),
]
# Section headings that raise or lower a task's score (task, pattern, points), for contexts and for direct evidence.
SECTION_POINTS = [
    ("overview", "abstract|introduction", 20),
    ("problem", "abstract|introduction|motivation|problem statement", 22),
    ("problem", "related work|experiment|evaluation|result", -14),
    ("method", "methodology|method|approach|proposed framework|system design|architecture", 34),
    ("method", "abstract|introduction", 4),
    ("method", "related work|experiment|evaluation|result|conclusion", -20),
    ("results", "experiment|evaluation|result|ablation|analysis", 30),
    ("results", "related work|introduction|methodology|method", -12),
    ("contribution", "conclusion|discussion", 20),
]
EVIDENCE_POINTS = [
    ("overview", "abstract|introduction", 16),
    ("contribution", "conclusion|discussion", 16),
    ("method", r"methodology|(?:^|\s)method(?:\s|$)|proposed approach|our approach|framework|architecture", 24),
    ("method", "related work|background|literature review", -14),
    ("experiments", "experiment|evaluation|results?|ablation|research question", 18),
    ("experiments", "related work|background", -10),
    ("results", "experiment|evaluation|results?|ablation|research question", 18),
    ("results", "related work|background", -10),
]
EVIDENCE_LISTS = "reliable formulas|figures extracted|tables extracted"
#: Sections from which a task always gets its best chunk.
FORCED = {"overview": "(?i)abstract|introduction", "contribution": "(?i)conclusion|discussion"}
#: Least and most characters of a chunk.
LEAST_CUT, CHUNK = 300, 2200


def task_words(label: str, goal: str) -> list[str]:
    return re.findall(r"[a-z][a-z-]{3,}", f"{label} {goal}".lower())


def task_list(plan: list[tuple] = READING_PLAN, keywords: dict[str, list[str]] = TASK_KEYWORDS) -> list[tuple[str, list[str]]]:
    """Each task's keywords: its own, and the words of its label and goal."""
    return [(t, list(dict.fromkeys(keywords.get(t, []) + task_words(label, goal)))) for t, label, goal, *_ in plan]


def tasks(spark: SparkSession, plan: list[tuple] = READING_PLAN, keywords: dict[str, list[str]] = TASK_KEYWORDS) -> DataFrame:
    """task_id, label, goal, fields, evidence_key, keywords: a task's own, and the words of its label and goal."""
    words = dict(task_list(plan, keywords))
    rows = [(t, label, goal, fields, key, words[t]) for t, label, goal, fields, key in plan]
    return spark.createDataFrame(rows, "task_id string, label string, goal string, fields array<string>, evidence_key string, keywords array<string>")


def sections(text: Column) -> Column:
    """array<struct<heading, text>>: what stands below each heading line, if anything; before the first is the overview."""

    def cut(both: Column) -> Column:
        lines, named = both["lines"], both["named"]
        starts = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(named, i) != ""))
        body = lambda s, e: strip(F.array_join(F.slice(lines, s + 2, F.greatest(e - s - 1, F.lit(0))), "\n"))
        made = bound(starts, lambda at: F.transform(at, lambda s, j: F.struct(F.when(s < 0, "Paper overview").otherwise(F.get(named, s)).alias("heading"), body(s, F.coalesce(F.get(at, j + 1), F.size(lines))).alias("text"))))
        return F.filter(made, lambda x: x["text"] != "")

    return bound(bound(F.split(text_of(text), "\n"), lambda x: F.struct(x.alias("lines"), F.transform(x, heading).alias("named"))), cut)


def _piece(size: int) -> str:
    """A pattern whose matches, one after the other, are the pieces of a stripped text, and white space after each."""
    least = LEAST_CUT + 1
    ends = [rf".{{{least},{size}}}(?=\n\n)", rf".{{{least},{size}}}(?=\n)"] if size >= least else []
    ends += [rf".{{{LEAST_CUT},{size}}}\.(?= )"] if size >= LEAST_CUT else []
    return rf"(?s)(.{{1,{size}}}+\z|{'|'.join([*ends, f'.{{{size}}}'])})[ \t\n\x0B\f\r\x{{00A0}}\x{{FEFF}}]*+"


def size_cuts(text: Column, size: int = CHUNK) -> Column:
    """array<string>: pieces of a text that is longer than size, cut at the last paragraph, line or sentence end that leaves enough.

    One pattern goes along the text, so a text's pieces are found in a single pass.
    """
    whole = lambda x: F.when(F.length(x) > size, F.transform(F.regexp_extract_all(x, F.lit(_piece(size)), F.lit(1)), strip)).otherwise(F.array(x))
    return F.filter(bound(strip(text), whole), lambda p: p != "")


def chunks_in_rows(docs: DataFrame, size: int = CHUNK, id_col: str = "doc_id", normal: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to keep, and chunks, array<struct<section_idx, heading, part, text>>: the pieces of all sections, in order."""
    text = paper_text(F.col("text")) if normal else text_of(F.col("text"))
    of = lambda s, i: F.transform(size_cuts(s["text"], size), lambda t, k: F.struct(i.alias("section_idx"), s["heading"].alias("heading"), (k + 1).alias("part"), t.alias("text")))
    return once(docs.select(F.col(id_col).alias("doc_id"), "text", *keep), "chunks", F.flatten(F.transform(sections(text), of))).select("doc_id", *keep, "chunks")


def chunks(docs: DataFrame, size: int = CHUNK, id_col: str = "doc_id", normal: bool = True) -> DataFrame:
    """doc_id, idx, chunk_id, section_idx, heading, part, text: the pieces of all sections, in order."""
    made = chunks_in_rows(docs, size, id_col, normal).select("doc_id", F.posexplode("chunks").alias("idx", "c"))
    return made.select("doc_id", "idx", F.format_string("S%dC%d", F.col("c.section_idx") + 1, F.col("c.part")).alias("chunk_id"), "c.section_idx", "c.heading", "c.part", "c.text")


def _scored(parts: DataFrame, task_table: DataFrame, first: Column, in_heading: int, points: list[tuple[str, str, int]], references: int) -> DataFrame:
    """Each chunk with each task and its score. The tasks are broadcast if they are few."""
    lower = parts.withColumns({"_heading": F.lower("heading"), "_text": F.lower("text")})  # once a chunk, not for each task and keyword
    both = lower.crossJoin(few(task_table.select("task_id", "keywords")))
    h, t = F.col("_heading"), F.col("_text")
    held = lambda x, n: F.aggregate("keywords", F.lit(0), lambda s, k: s + F.when(F.contains(x, k), n).otherwise(0))
    score = first + held(h, in_heading) + held(t, 2)
    for task, pattern, n in points:
        score = score + F.when((F.col("task_id") == task) & h.rlike(pattern), n).otherwise(0)
    return both.withColumn("score", score - F.when(is_reference_section(F.col("heading")), references).otherwise(0)).drop("keywords", "_heading", "_text")


def scored(parts: DataFrame, task_table: DataFrame) -> DataFrame:
    """Scores for contexts: keywords in heading and text, the task's sections, evidence lists, and the first two chunks."""
    out = _scored(parts, task_table, F.when(F.col("idx") < 2, 3 - F.col("idx")).otherwise(0), 10, SECTION_POINTS, 40)
    listed = F.lower(F.concat("heading", F.lit("\n"), "text")).rlike(EVIDENCE_LISTS)
    return out.withColumn("score", F.col("score") + F.when(listed, 8).otherwise(0))


def evidence_scored(parts: DataFrame, task_table: DataFrame) -> DataFrame:
    """Scores for direct evidence."""
    return _scored(parts, task_table, F.when(F.col("idx") < 2, 2).otherwise(0), 8, EVIDENCE_POINTS, 20)


def top_chunks(scores: DataFrame, k: int | None = None, expanded: bool = False) -> DataFrame:
    """The k best chunks (5, or 7 if expanded) of each document and task; references never.

    The best one comes first, then the best from the sections that a task must see.
    """
    best = Window.partitionBy("doc_id", "task_id").orderBy(F.desc("score"), "idx")
    forced = F.lit(False)
    for task, pattern in FORCED.items():
        forced = forced | ((F.col("task_id") == task) & F.col("heading").rlike(pattern))
    ranked = scores.withColumn("place", F.row_number().over(best)).withColumn("forced", forced)
    first = F.row_number().over(Window.partitionBy("doc_id", "task_id", "forced").orderBy("place")) == 1
    ranked = ranked.withColumn("turn", F.when(F.col("place") == 1, 0).when(F.col("forced") & first, 1).otherwise(2)).filter(~is_reference_section(F.col("heading")))
    w = Window.partitionBy("doc_id", "task_id").orderBy("turn", "place")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (k or (7 if expanded else 5))).drop("place", "forced", "turn")


#: Words whose hits share a number.
_BITS = 62


def trie(words: list[str]) -> str:
    """A pattern of the longest of some words that begins at a place; words that begin alike share what they begin with."""
    if not any(words):
        return ""
    heads = list(dict.fromkeys(w[0] for w in words if w))
    one = lambda c: re.sub(r"([^\w\s])", r"\\\1", c) + trie([w[1:] for w in words if w and w[0] == c])
    # a class of signs is asked before its signs are, one by one
    few = [heads[i : i + 4] for i in range(0, len(heads), 4)] if len(heads) > 6 else [heads]
    inner = "|".join(f"(?=[{''.join(map(re.escape, g))}])(?:{'|'.join(map(one, g))})" if len(few) > 1 else "|".join(map(one, g)) for g in few)
    return f"(?:{inner})?" if "" in words else f"(?:{inner})" if len(heads) > 1 else inner


class Words:
    """The keywords of several tasks, all looked for in one pass over a text; a text's hits are bits of a few numbers, of which each task counts its own."""

    def __init__(self, plan: list[tuple[str, list[str]]]):
        self.plan, self.words = plan, list(dict.fromkeys(k for _, ks in plan for k in ks if k))

    def hits(self, lower: Column) -> Column:
        """struct of numbers: which words a lower-case text holds. At a place only the longest is found; the others that begin there begin it, so they are told by it."""
        every = F.array(*[F.lit(k) for k in self.words])

        def bits(places: Column, at: int) -> Column:
            group = self.words[at : at + _BITS]
            told = F.array(*[F.lit(sum(1 << i for i, k in enumerate(group) if w.startswith(k))).cast("long") for w in self.words])
            return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.get(told, i)))

        found = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"(?=({trie(self.words)}))"), F.lit(1)))
        places = F.transform(found, lambda w: F.array_position(every, w).cast("int") - 1)
        return bound(places, lambda p: F.struct(*[bits(p, at).alias(f"b{at // _BITS}") for at in range(0, len(self.words), _BITS)]))

    def count(self, hits: Column, keywords: list[str]) -> Column:
        """How many of a task's keywords are among a text's hits."""
        own, n = set(keywords), F.lit(int("" in keywords))
        for j in range(0, len(self.words), _BITS):
            mask = sum(1 << i for i, k in enumerate(self.words[j : j + _BITS]) if k in own)
            n = n + F.bit_count(hits[f"b{j // _BITS}"].bitwiseAND(F.lit(mask).cast("long"))) if mask else n
        return n


def _weighed(chunks: Column, plan: list[tuple[str, list[str]]], in_heading: int, points: list[tuple[str, str, int]], references: int, opening: tuple[int, int], listed: int) -> Column:
    """array<struct<scores, reference, forced>> of a row's chunks: a score for each task, and whether its section is one of FORCED. A heading is looked at once a row."""
    words = Words(plan)
    lists = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in EVIDENCE_LISTS.split("|")])

    def of_heading(h: Column) -> Column:
        def told(low: Column) -> Column:
            said = lambda task: sum((F.when(low.rlike(p), n).otherwise(0) for t, p, n in points if t == task), F.lit(0))
            base = lambda hits, reference: F.array(*[in_heading * words.count(hits, ks) + said(t) - F.when(reference, references).otherwise(0) for t, ks in plan])
            both = F.struct(words.hits(low).alias("hits"), is_reference_section(h).alias("reference"))
            forced = [h.rlike(FORCED[t]) if t in FORCED else F.lit(False) for t, _ in plan]
            return bound(both, lambda x: F.struct(base(x["hits"], x["reference"]).alias("base"), x["reference"].alias("reference"), lists(low).alias("listed"), F.array(*forced).alias("forced")))

        return bound(F.lower(h), told)

    def of_chunk(c: Column, i: Column, h: Column) -> Column:
        first = F.when(i == 0, opening[0]).when(i == 1, opening[1]).otherwise(0)

        def made(low: Column) -> Column:
            both = F.struct(words.hits(low).alias("hits"), (first + (F.when(h["listed"] | lists(low), listed).otherwise(0) if listed else F.lit(0))).alias("more"))
            return bound(both, lambda x: F.struct(F.array(*[F.get(h["base"], F.lit(j)) + 2 * words.count(x["hits"], ks) + x["more"] for j, (_, ks) in enumerate(plan)]).alias("scores"), h["reference"].alias("reference"), h["forced"].alias("forced")))

        return bound(F.lower(c["text"]), made)

    def of_row(names: Column) -> Column:
        place = lambda c: F.array_position(names, c["heading"]).cast("int") - 1
        return bound(F.transform(names, of_heading), lambda heads: F.transform(chunks, lambda c, i: bound(F.get(heads, place(c)), lambda h: of_chunk(c, i, h))))

    return bound(F.array_distinct(F.transform(chunks, lambda c: c["heading"])), of_row)


def _best_first(weighed: Column, task: int) -> Column:
    """array<int>: the places of a row's chunks, by descending score of a task and then by place; score and place are sorted as one number."""
    key = lambda w, i: (-F.get(w["scores"], F.lit(task))).cast("long") * (1 << 32) + i
    return F.transform(F.sort_array(F.transform(weighed, key)), lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))


def _picks(weighed: Column, plan: list[tuple[str, list[str]]], k: int, of: Callable[[Column], list[Column]]) -> Column:
    """array<struct<task_id, rank, idx, score, …>>: the k best chunks of each task, as top_chunks has them, with more of each by its place."""

    def task(j: int, name: str) -> Column:
        forced = lambda o: F.slice(F.filter(o, lambda i: F.get(F.get(weighed, i)["forced"], F.lit(j))), 1, 1)
        order = _best_first(weighed, j)
        turns = bound(order, lambda o: F.array_distinct(F.concat(F.slice(o, 1, 1), forced(o), o))) if name in FORCED else order
        kept = F.slice(F.filter(turns, lambda i: ~F.get(weighed, i)["reference"]), 1, k)
        return F.transform(kept, lambda i, r: F.struct(F.lit(name).alias("task_id"), (r + 1).alias("rank"), i.alias("idx"), F.get(F.get(weighed, i)["scores"], F.lit(j)).alias("score"), *of(i)))

    return F.concat(*[task(j, t) for j, (t, _) in enumerate(plan)])


def _picked(plan: list[tuple[str, list[str]]], k: int, of: Callable[[Column], list[Column]]) -> Column:
    return bound(_weighed(F.col("chunks"), plan, 10, SECTION_POINTS, 40, (3, 2), 8), lambda w: _picks(w, plan, k, of))


def selected_in_rows(docs: DataFrame, size: int = CHUNK, k: int = 5, plan: list[tuple[str, list[str]]] | None = None, id_col: str = "doc_id", normal: bool = True) -> DataFrame:
    """doc_id, chunks and picked, array<struct<task_id, rank, idx, score>>: the k best chunks of each task, as top_chunks has them."""
    rows = chunks_in_rows(docs, size, id_col, normal)
    return once(rows, "picked", _picked(plan or task_list(), k, lambda i: []))


def top_in_rows(docs: DataFrame, size: int = CHUNK, expanded: bool = False, plan: list[tuple[str, list[str]]] | None = None, **more) -> DataFrame:
    """doc_id, task_id, rank, idx, score and the chunk's columns: what top_chunks gives for the reading plan, without a shuffle."""
    rows, c = chunks_in_rows(docs, size, **more), lambda i, n: F.get("chunks", i)[n].alias(n)
    made = rows.select("doc_id", F.inline(_picked(plan or task_list(), 7 if expanded else 5, lambda i: [c(i, n) for n in ("section_idx", "heading", "part", "text")])))
    return made.select("doc_id", "task_id", "rank", "idx", "score", F.format_string("S%dC%d", F.col("section_idx") + 1, F.col("part")).alias("chunk_id"), "section_idx", "heading", "part", "text")


def best_of_tasks(selected: DataFrame) -> DataFrame:
    """Each selected chunk once, with its best score."""
    return selected.groupBy("doc_id", "chunk_id").agg(F.max("score").alias("score"), F.min("idx").alias("idx"), F.count("*").cast("long").alias("n_tasks"))


def within_budget(scores: DataFrame, max_chars: int = 6000, max_chunks: int = 4, overhead: int = 40, least: int = 200) -> DataFrame:
    """Evidence of each (doc_id, task_id) in rank order: a chunk is cut to what is left, and the rest stops below `least`."""
    best = Window.partitionBy("doc_id", "task_id").orderBy(F.desc("score"), "idx")
    few = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_chunks)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "heading", "text")))  # max_chunks at most
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<chunk_id:string,text:string>>)").alias("kept"))

    def step(a, c):
        left = F.lit(max_chars) - a["used"]
        text = F.substring(c["text"], F.lit(1), left)
        grown = F.struct((a["used"] + F.length(text) + F.length(c["heading"]) + overhead).alias("used"), F.array_append(a["kept"], F.struct(c["chunk_id"].alias("chunk_id"), text.alias("text"))).alias("kept"))
        return F.when(left < least, a).otherwise(grown)  # what is used only grows, so nothing follows

    made = few.groupBy("doc_id", "task_id").agg(F.aggregate(ranked, start, step)["kept"].alias("kept"))
    return made.select("doc_id", "task_id", F.posexplode("kept").alias("pos", "e")).select("doc_id", "task_id", F.concat(F.lit("E"), F.col("pos") + 1).alias("evidence_id"), "e.chunk_id", "e.text")


def budget_in_rows(docs: DataFrame, max_chars: int = 6000, max_chunks: int = 4, overhead: int = 40, least: int = 200, plan: list[tuple[str, list[str]]] | None = None, **more) -> DataFrame:
    """doc_id, task_id, evidence_id, chunk_id, text: what within_budget gives of evidence_scored for the reading plan, without a shuffle."""
    rows, plan = chunks_in_rows(docs, **more), plan or task_list()
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<idx:int,text:string>>)").alias("kept"))

    def step(a: Column, i: Column) -> Column:
        left, c = F.lit(max_chars) - a["used"], F.get("chunks", i)
        grown = lambda t: F.struct((a["used"] + F.length(t) + F.length(c["heading"]) + overhead).alias("used"), F.array_append(a["kept"], F.struct(i.alias("idx"), t.alias("text"))).alias("kept"))
        return F.when(left < least, a).otherwise(bound(F.substring(c["text"], F.lit(1), left), grown))  # what is used only grows, so nothing follows

    def of(weighed: Column) -> Column:
        kept = lambda j: F.aggregate(F.slice(_best_first(weighed, j), 1, max_chunks), start, step)["kept"]
        told = lambda t: lambda e, k: F.struct(F.lit(t).alias("task_id"), (k + 1).alias("place"), F.get("chunks", e["idx"])["section_idx"].alias("section_idx"), F.get("chunks", e["idx"])["part"].alias("part"), e["text"].alias("text"))
        return F.concat(*[F.transform(kept(j), told(t)) for j, (t, _) in enumerate(plan)])

    made = rows.select("doc_id", F.inline(bound(_weighed(F.col("chunks"), plan, 8, EVIDENCE_POINTS, 20, (2, 2), 0), of)))
    return made.select("doc_id", "task_id", F.concat(F.lit("E"), F.col("place")).alias("evidence_id"), F.format_string("S%dC%d", F.col("section_idx") + 1, F.col("part")).alias("chunk_id"), "text")


def evidence_in_rows(docs: DataFrame, n: int, plan: list[tuple[str, list[str]]] | None = None, **more) -> DataFrame:
    """doc_id, chunks and best, array<array<int>>: for each task of the plan the places of its n best chunks by evidence_scored, the best first."""
    plan = plan or task_list()
    best = lambda w: F.array(*[F.slice(_best_first(w, j), 1, n) for j in range(len(plan))])
    return once(chunks_in_rows(docs, **more), "best", bound(_weighed(F.col("chunks"), plan, 8, EVIDENCE_POINTS, 20, (2, 2), 0), best))


def units(text: Column, keywords: Column) -> Column:
    """Sentences from the best on, as (low, i, s): the first, those with keywords, and those that hold evidence count."""
    evidence = r"(?i)\d|=|\\begin|\\end|figure|table|dataset|baseline"

    def unit(s: Column, i: Column) -> Column:
        score = F.when(i == 0, 3).otherwise(0) + 4 * F.size(F.filter(keywords, lambda k: F.contains(F.lower(s), k))) + F.when(s.rlike(evidence), 2).otherwise(0)
        return F.struct((-score).alias("low"), i.alias("i"), s.alias("s"))

    return F.array_sort(F.transform(sentences(text), unit))


def packed(ranked: Column, budget: Column) -> Column:
    """The units that fit, each too long one skipped, in the order of the text."""
    start = F.expr("named_struct('used', 0, 'kept', cast(array() as array<struct<i:int,s:string>>))")

    def step(a: Column, u: Column) -> Column:
        used = a["used"] + F.length(u["s"]) + F.when(F.size(a["kept"]) > 0, 1).otherwise(0)
        return F.when(used > budget, a).otherwise(F.struct(used.alias("used"), F.array_append(a["kept"], F.struct(u["i"].alias("i"), u["s"].alias("s"))).alias("kept")))

    return strip(F.array_join(F.transform(F.array_sort(F.aggregate(ranked, start, step)["kept"]), lambda u: u["s"]), "\n"))


def told_units(text: Column, words: Words) -> Column:
    """array<struct<s, n, base, hits>>: a text's sentences with what their scores need, for all tasks of some words."""
    marks = [r"[0-9=]", r"\\begin", r"\\end", "figure", "table", "dataset", "baseline"]

    def told(s: Column, i: Column) -> Column:
        evidence = lambda low: reduce(lambda a, b: a | b, [low.rlike(m) for m in marks])
        base = lambda low: F.when(i == 0, 3).otherwise(0) + F.when(evidence(low), 2).otherwise(0)
        return bound(F.lower(s), lambda low: F.struct(s.alias("s"), F.length(s).alias("n"), base(low).alias("base"), words.hits(low).alias("hits")))

    return F.transform(sentences(text), told)


def packed_told(told: Column, words: Words, keywords: list[str], budget: Column) -> Column:
    """As packed(units(text, keywords), budget), from the text's told_units; score and place are sorted as one number."""
    key = lambda u, i: (-(u["base"] + 4 * words.count(u["hits"], keywords))).cast("long") * (1 << 32) + i
    start = F.expr("named_struct('used', 0, 'kept', cast(array() as array<int>))")

    def step(a: Column, k: Column) -> Column:
        i = k.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        used = a["used"] + F.get(told, i)["n"] + F.when(F.size(a["kept"]) > 0, 1).otherwise(0)
        return bound(used, lambda n: F.when(n > budget, a).otherwise(F.struct(n.alias("used"), F.array_append(a["kept"], i).alias("kept"))))

    kept = F.sort_array(F.aggregate(F.sort_array(F.transform(told, key)), start, step)["kept"])
    return strip(F.array_join(F.transform(kept, lambda i: F.get(told, i)["s"]), "\n"))


def compressed(text: Column, keywords: Column, budget: int) -> Column:
    """A text within a budget: itself if it fits, else its best sentences."""
    x = strip(text_of(text))
    return F.when(F.length(x) <= budget, x).otherwise(packed(units(x, keywords), F.lit(budget)))


def ratio(kept: Column, given: Column) -> Column:
    """Share kept, to three places; 1 of nothing."""
    return F.when(given == 0, F.lit(1.0)).otherwise(F.round(kept / given, 3))


def keyword_sentences(found: Column, keywords: list[str], n: int = 2) -> Column:
    """The first n of some sentences that hold a keyword, joined."""
    hit = lambda s: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(s), k))
    return F.array_join(F.slice(F.filter(found, hit), 1, n), " ")

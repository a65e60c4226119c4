"""Which corrections and revisions may stand, what memory recalls for a task, and fair shares of a context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.spans import math_keys
from ..functions.text import bounded, escape_html, numbers, strict_key, text_of
from .retrieve import Words, packed, packed_told, told_units, units
from .sets import few

# Words that support nothing.
GENERAL_WORDS = ["which", "their", "about", "these", "those", "paper", "context"]


def _plain_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z][a-z-]{4,}"), F.lit(0)))


def missing_numbers(claim: Column, source: Column) -> Column:
    """Number tokens of a claim that its source doesn't have as whole tokens."""
    return F.array_except(numbers(claim), numbers(source))


def correction_issue(correction: Column, source: Column) -> Column:
    """Why a correction isn't grounded in its source; null if it is.

    Its numbers must be tokens of the source; of four or more words at least a fifth must occur there.
    """
    lost = missing_numbers(correction, source)
    words = F.filter(_plain_words(correction), lambda w: ~w.isin(GENERAL_WORDS))
    body = strict_key(source)
    known = F.size(F.filter(words, lambda w: F.contains(body, w)))
    thin = (F.size(words) >= 4) & (known < F.ceil(F.size(words) * 0.2))
    return F.when(F.size(lost) > 0, F.concat(F.lit("numbers absent from the source: "), F.array_join(lost, ", "))).when(thin, F.lit("too little lexical support in the source"))


def gate_corrections(corrections: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """corrections (key, field, text) with `accepted` and `reason`; sources: (key, text), one row for each key."""
    source = sources.select(key, F.col("text").alias("_source"))
    judged = corrections.filter(F.trim(text_of(F.col("text"))) != "").join(source, key, "left").withColumn("reason", correction_issue(F.col("text"), F.col("_source")))
    return judged.withColumn("accepted", F.col("reason").isNull()).drop("_source")


def sentence_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text_of(c), r"(?<=[.!?。！？])\s*"), lambda s: F.trim(s) != ""))


def gate_revisions(revisions: DataFrame, source: str = "source") -> DataFrame:
    """revisions (…, original, revision, max_sentences, source) with `accepted` and `reason`, the first rule that fails.

    Formulas stay, numbers are the source's, one sentence over the limit is allowed, and a text grows by
    45 % or 180 characters at most.
    """
    old, new = bounded(F.col("original"), 1200), bounded(F.col("revision"), 900)
    given = F.concat_ws(" ", F.col(source), F.col("original"))
    keyed = revisions.withColumns({"_old": math_keys(old), "_new": math_keys(new)})  # once each: Arrow functions
    lost = missing_numbers(new, given)
    reason = (
        F.when(F.size(F.array_except("_old", "_new")) > 0, F.lit("removes or changes mathematical notation"))
        .when(F.size(lost) > 0, F.concat(F.lit("unsupported numbers: "), F.array_join(lost, ", ")))
        .when(sentence_count(new) > F.col("max_sentences") + 1, F.lit("too many sentences"))
        .when((old != "") & (F.length(new) > F.greatest(F.length(old) * 1.45, F.length(old) + 180.0)), F.lit("expands the text instead of refining it"))
    )
    return keyed.filter(new != "").withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_old", "_new")


# ------------------------------------------------------------------ memory


def _latest(items: Column, most: int, length: int) -> Column:
    """The last `most` texts, collapsed and bounded."""
    items = F.coalesce(items, F.array().cast("array<string>"))
    tail = F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), most)
    return F.filter(F.transform(tail, lambda t: bounded(t, length)), lambda t: t != "")


def _ranked(items: Column, keywords: Column, limit: int) -> Column:
    """The texts that hold most keywords, newer ones first among equals."""
    scored = F.transform(items, lambda t, i: F.struct((-F.size(F.filter(keywords, lambda k: F.contains(F.lower(t), k)))).alias("low"), (-i).alias("late"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(scored), 1, limit), lambda s: s["t"])


def recalled(memory: DataFrame, task_table: DataFrame, limit: int = 5) -> DataFrame:
    """paper_id, task_id, prior_section, annotations, questions, recalled_items for each memory and task.

    memory: (paper_id, sections map<string, string>, annotations, questions array<string>); the tasks are
    broadcast if they are few.
    """
    both = memory.crossJoin(few(task_table))
    notes, asked = _latest(F.col("annotations"), 20, 2000), _latest(F.col("questions"), 20, 1000)
    prior = F.nullif(bounded(F.try_element_at("sections", F.col("task_id")), 1800), F.lit(""))
    words = F.array_distinct(F.concat("keywords", _plain_words(prior), _plain_words(F.array_join(asked, " "))))
    made = both.select("paper_id", "task_id", prior.alias("prior_section"), _ranked(notes, words, limit).alias("annotations"), _ranked(asked, words, limit).alias("questions"))
    return made.withColumn("recalled_items", F.size("annotations") + F.size("questions") + F.col("prior_section").isNotNull().cast("int"))


# ------------------------------------------------------------------ fair shares


#: The least share of a context that a chunk gets.
LEAST_SHARE = 180


def _source(idx: Column, c: Column, told: Column) -> Column:
    """A chunk (section_idx, heading, part, text) as an entry of a context: its id, its label's length, and what is told of its sentences."""
    name = F.format_string("S%dC%d", c["section_idx"] + 1, c["part"])
    label = F.length(F.concat(F.lit("[SOURCE "), name, F.lit(" | "), c["heading"], F.lit(" | part "), c["part"].cast("string"), F.lit("]")))
    return F.struct(idx.alias("idx"), name.alias("chunk_id"), label.alias("label"), F.trim(c["text"]).alias("text"), told.alias("units"))


def _shares(entries: Column, task: Column, max_chars: int, pack: Callable[[Column, Column], Column] = packed) -> Column:
    """array<struct<chunk_id, text, original_chars>>: what of some entries, in order, goes into a context; pack puts an entry's units into a share."""
    head = F.length(task) * 2 + F.lit(len("[GSSC CONTEXT | task= | goal=]") + 2)
    start = F.struct((F.lit(max_chars) - head).cast("int").alias("left"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<chunk_id:string,text:string,original_chars:int>>)").alias("kept"))

    def step(a: Column, c: Column) -> Column:
        share = F.greatest(F.lit(LEAST_SHARE), F.floor((a["left"] - c["label"] - 2) / (F.size(entries) - a["k"])).cast("int"))
        text = F.when(a["left"] < 220, F.lit("")).when(F.length(c["text"]) <= share, c["text"]).otherwise(pack(c["units"], share))

        def put(t: Column) -> Column:
            size = c["label"] + 1 + F.length(t)
            entry = F.struct(c["chunk_id"].alias("chunk_id"), t.alias("text"), F.length(c["text"]).alias("original_chars"))
            fits = (t != "") & (size <= a["left"])
            return F.struct(F.when(fits, a["left"] - size - 2).otherwise(a["left"]).alias("left"), (a["k"] + 1).alias("k"), F.when(fits, F.array_append(a["kept"], entry)).otherwise(a["kept"]).alias("kept"))

        return bound(text, put)

    return F.aggregate(entries, start, step)["kept"]


def fair_shares(selected: DataFrame, task_table: DataFrame, max_chars: int = 5000) -> DataFrame:
    """The context of each (doc_id, task_id): doc_id, task_id, pos, chunk_id, text, original_chars.

    In text order each chunk gets what is left, divided by the chunks to come, and is compressed to it; a
    chunk that doesn't fit is skipped, and nothing follows when fewer than 220 characters are left.
    selected: rows of retrieve.top_chunks. Gathered are the selected chunks of one document and task only.
    """
    label = F.concat(F.lit("[SOURCE "), "chunk_id", F.lit(" | "), "heading", F.lit(" | part "), F.col("part").cast("string"), F.lit("]"))
    rows = selected.join(few(task_table), "task_id")
    one = F.struct("idx", "chunk_id", F.length(label).alias("label"), F.trim("text").alias("text"), units(F.col("text"), F.col("keywords")).alias("units"))
    groups = rows.groupBy("doc_id", "task_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    made = groups.select("doc_id", "task_id", F.posexplode(_shares(F.col("all"), F.col("task_id"), max_chars)).alias("pos", "e"))
    return made.select("doc_id", "task_id", (F.col("pos") + 1).alias("pos"), "e.chunk_id", "e.text", "e.original_chars")


def fair_shares_in_rows(selected: DataFrame, plan: list[tuple[str, list[str]]], max_chars: int = 5000) -> DataFrame:
    """As fair_shares, from the rows of retrieve.selected_in_rows and the tasks they were selected for; nothing is shuffled."""

    words = Words(plan)

    def of(task: str, keywords: list[str], told: Column) -> Column:
        places = F.sort_array(F.transform(F.filter("picked", lambda p: p["task_id"] == task), lambda p: p["idx"]))
        entries = F.transform(places, lambda i: bound(F.get("chunks", i), lambda c: _source(i, c, F.get(told, i))))
        kept = bound(entries, lambda e: _shares(e, F.lit(task), max_chars, lambda units, share: packed_told(units, words, keywords, share)))
        return F.transform(kept, lambda e, k: F.struct(F.lit(task).alias("task_id"), (k + 1).alias("pos"), e["chunk_id"].alias("chunk_id"), e["text"].alias("text"), e["original_chars"].alias("original_chars")))

    # the sentences of a chunk are found once, whatever number of tasks has it, and only if it can be longer than a share
    long = lambda x: F.length(F.trim(x)) > LEAST_SHARE
    told = bound(F.array_distinct(F.transform("picked", lambda p: p["idx"])), lambda used: F.transform("chunks", lambda c, i: F.when(F.array_contains(used, i) & long(c["text"]), told_units(c["text"], words))))
    return selected.select("doc_id", F.inline(bound(told, lambda x: F.concat(*[of(t, ks, x) for t, ks in plan]))))


# ------------------------------------------------------------------ export


def standalone_html(title: Column, sections: Column) -> Column:
    """One page of HTML without outside references; sections: array<struct<heading, text>>."""
    parts = F.transform(sections, lambda s: F.concat(F.lit("<section><h2>"), escape_html(s["heading"]), F.lit("</h2><p>"), escape_html(s["text"]), F.lit("</p></section>")))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escape_html(title), F.lit("</title></head><body><h1>"), escape_html(title), F.lit("</h1>"), F.array_join(parts, ""), F.lit("</body></html>"))


"""Tasks that are answered by a model, or without one, from evidence that grows until it holds the answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, first_by_key
from ..functions.predicates import round_budget, round_chunks
from ..functions.text import collapse, stretches, text_of
from . import retrieve


@dataclass(frozen=True)
class Options:
    """What a run may use; values outside their bounds are brought to them."""

    evidence_chars: int = 6500
    evidence_chunks: int = 5
    rounds: int = 6
    context_chars: int = 26_000

    # Least and most of each.
    BOUNDS = {"evidence_chars": (3000, 12_000), "evidence_chunks": (3, 8), "rounds": (2, 8), "context_chars": (1, 10**9)}

    @classmethod
    def of(cls, **given: object) -> Options:
        """From settings of any kind: what is no number is the default."""

        def whole(name: str, value: object) -> int:
            try:
                number = int(float(str(value)))
            except ValueError:
                number = getattr(cls, name)
            low, high = cls.BOUNDS[name]
            return max(low, min(high, number))

        return cls(**{n: whole(n, v) for n, v in given.items() if n in cls.BOUNDS})


def grounding_round(scores: DataFrame, quotes: DataFrame, options: Options = Options(), overhead: int = 40, least: int = 200) -> DataFrame:
    """doc_id, task_id, quote_id, round: the first round whose evidence holds a quote; null if none does.

    scores: rows of retrieve.evidence_scored; quotes: (doc_id, task_id, quote_id, quote). Each round allows more chunks and characters of
    the same ranking, so one running sum tells what every round sees, and no round is run again for what an earlier one has settled.
    """
    w = Window.partitionBy("doc_id", "task_id").orderBy(F.desc("score"), "idx")
    size = F.length("text") + F.length("heading") + overhead
    placed = scores.select("doc_id", "task_id", "text", F.row_number().over(w).alias("place"), (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    most = options.evidence_chunks + 3 * (options.rounds - 1)
    seen = placed.filter(F.col("place") <= min(18, most)).withColumn("before", F.coalesce("before", F.lit(0)))
    hit = quotes.join(seen, ["doc_id", "task_id"]).withColumn("ends", F.expr("instr(text, quote)") + F.length("quote") - 1).filter(F.expr("instr(text, quote)") > 0)
    rounds = hit.select("*", F.explode(F.sequence(F.lit(1), F.lit(options.rounds))).alias("round"))
    left = round_budget(F.lit(options.evidence_chars), F.col("round")) - F.col("before")
    holds = (F.col("place") <= round_chunks(F.lit(options.evidence_chunks), F.col("round"))) & (left >= least) & (F.col("ends") <= left)
    first = rounds.filter(holds).groupBy("doc_id", "task_id", "quote_id").agg(F.min("round").alias("round"))
    return quotes.select("doc_id", "task_id", "quote_id").join(first, ["doc_id", "task_id", "quote_id"], "left")


def grounding_in_rows(docs: DataFrame, plan: list[tuple[str, list[str]]], options: Options = Options(), overhead: int = 40, least: int = 200, **more) -> DataFrame:
    """doc_id, task_id, quote_id, round: what grounding_round gives of evidence_scored for the tasks of a plan, of docs (doc_id, text, quotes array<struct<quote_id, quote>>), without a shuffle.

    Every task is asked for all quotes of its document. Only chunks that some round can see are gone through.
    """
    most = min(18, options.evidence_chunks + 3 * (options.rounds - 1))
    rows = retrieve.evidence_in_rows(docs, most, plan, keep=("quotes",), **more)
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<before:int,text:string>>)").alias("seen"))

    def step(a: Column, i: Column) -> Column:
        grown = lambda c: F.struct((a["used"] + F.length(c["text"]) + F.length(c["heading"]) + overhead).alias("used"), F.array_append(a["seen"], F.struct(a["used"].alias("before"), c["text"].alias("text"))).alias("seen"))
        return bound(F.get("chunks", i), grown)

    def first_round(c: Column, place: Column, quote: Column) -> Column:
        def told(at: Column) -> Column:
            left = lambda r: round_budget(F.lit(options.evidence_chars), F.lit(r)) - c["before"]
            holds = lambda r: (place < round_chunks(F.lit(options.evidence_chunks), F.lit(r))) & (left(r) >= least) & (at + F.length(quote) - 1 <= left(r))
            return F.when(at > 0, F.coalesce(*[F.when(holds(r), F.lit(r)) for r in range(1, options.rounds + 1)]))

        return bound(F.instr(c["text"], quote), told)

    def of(task: str, j: int) -> Column:
        earliest = lambda seen, q: F.array_min(F.transform(seen, lambda c, place: first_round(c, place, q["quote"])))
        told = lambda seen: F.transform("quotes", lambda q: F.struct(F.lit(task).alias("task_id"), q["quote_id"].alias("quote_id"), earliest(seen, q).alias("round")))
        return bound(F.aggregate(F.get("best", F.lit(j)), start, step)["seen"], told)

    return rows.select("doc_id", F.inline(F.concat(*[of(t, j) for j, (t, _) in enumerate(plan)])))


def prompts(tasks: DataFrame) -> DataFrame:
    """Tasks (…, label, goal, fields, context) with the text that a model is asked."""
    asked = F.format_string("Task: %s\nGoal: %s\nAnswer with JSON that has the fields %s and an array `evidence` of exact quotes. Use only the evidence below; leave a field empty that it doesn't support.\n\n%s", text_of(F.col("label")), text_of(F.col("goal")), F.array_join("fields", ", "), text_of(F.col("context")))
    return tasks.withColumn("prompt", asked)


def answered(tasks: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Tasks (…, prompt, context) with the model's answer for each prompt, batch by batch; without a model, the first sentences of the context.

    The model is any function from prompts to answers that can be sent to the executors; nothing here reaches a network.
    """
    if model is None:
        return tasks.withColumn("answer", F.array_join(F.slice(stretches(collapse(F.col("context"))), 1, 2), ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=model(pdf.prompt.tolist()))

    return tasks.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tasks.schema)}, answer string")


# ------------------------------------------------------------------ state of tasks and traces


def task_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, attempts, steps of tasks from events (keys, seq, status, attempts, detail): the last status, most attempts, and the steps in order."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "detail"))), lambda s: s["detail"])  # the events of one task
    return events.groupBy(*keys).agg(F.max_by("status", "seq").alias("status"), F.max("attempts").alias("attempts"), steps.alias("steps"))


def trace(tools: DataFrame, most: int = 30, metrics: int = 20) -> DataFrame:
    """The last traces (run_id, seq, name, status, duration_ms, metrics map) of each run, durations never below 0, with the first metrics that have a value."""
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    kept = F.map_from_entries(F.slice(F.array_sort(F.filter(F.map_entries("metrics"), lambda e: e["value"].isNotNull())), 1, metrics))
    return tools.withColumn("_newest", newest).filter(F.col("_newest") <= most).drop("_newest").withColumns({"duration_ms": F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0))), "metrics": kept})


def memory_record(saved: DataFrame, profile: DataFrame, key: str = "id") -> DataFrame:
    """A record for each profile (key, title, source_type, …): what was saved under its key (key, sections, annotations, questions), or an empty one."""
    none = F.array().cast("array<string>")
    both = profile.join(saved, key, "left")
    filled = {"sections": F.coalesce("sections", F.expr("cast(map() as map<string,string>)")), "annotations": F.coalesce("annotations", none), "questions": F.coalesce("questions", none), "version": F.lit(1), "source_type": F.coalesce(F.nullif("source_type", F.lit("")), F.lit("text"))}
    return both.withColumns(filled)


def distinct_notes(items: Column, most: int = 12, length: int = 600) -> Column:
    """The last distinct notes, collapsed and bounded, by their text without case."""
    clean = F.filter(F.transform(items, lambda t: F.substring(collapse(t), 1, length)), lambda t: t != "")
    once = first_by_key(clean, F.lower)
    return F.slice(once, F.greatest(F.size(once) - most + 1, F.lit(1)), F.lit(most))

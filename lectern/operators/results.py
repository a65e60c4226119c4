"""Results of tasks, reviews and runs: untrusted values brought into shape, merged, and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_by_key
from ..functions.text import collapse, strict_key, strip, text_of

# What is allowed, how much is kept, and what stands where nothing is given.
SEVERITIES, FIELDS_KEPT, CHECKS_KEPT, LISTED = ["low", "medium", "high"], 8, 8, 10
ASSET_TYPES, ASSET_SECTIONS = ["formula", "figure", "table"], ["method", "theory", "results"]
TASK_RECOMMENDATIONS, ALL_RECOMMENDATIONS = 3, 6
MISSING_TITLE, MISSING_FIELD = "Untitled paper", "not found in provided context"
PANELS = ["problem", "motivation", "method", "theory", "visuals", "results", "contribution"]
LEAST_SCALE, MOST_SCALE = 0.8, 1.35
LEAST_STYLE, MOST_STYLE = 0.9, 1.25
MODEL_TOOLS = ["llm.analyze", "llm.verify"]
SECTION_FIELDS = {"overview": ["title", "summary"], "problem": ["problem", "motivation"], "method": ["method"], "theory": ["theory"], "experiments": ["experiments"], "results": ["results"], "contribution": ["contributions", "innovation", "logicReview"]}


def bounded(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def rounded(c: Column) -> Column:
    """To whole numbers, halves up."""
    return F.floor(c + 0.5).cast("int")


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# ------------------------------------------------------------------ verification and review


def verification(v: Column) -> Column:
    """A verification struct (verdict, summary, confidence, checks, missing, unsupported) with allowed values only.

    checks: array of (id, name, ok, severity, detail, fields).
    """
    check = lambda c: F.struct(
        F.coalesce(F.nullif(c["id"], F.lit("")), F.nullif(c["name"], F.lit("")), F.lit("check")).alias("id"),
        F.coalesce(F.nullif(c["name"], F.lit("")), F.lit("check")).alias("name"),
        F.coalesce(c["ok"], F.lit(False)).alias("ok"),
        F.when(c["severity"].isin(SEVERITIES), c["severity"]).otherwise("medium").alias("severity"),
        text_of(c["detail"]).alias("detail"),
        F.slice(F.coalesce(c["fields"], F.array().cast("array<string>")), 1, FIELDS_KEPT).alias("fields"),
    )
    listed = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, LISTED)
    return F.struct(
        F.when(v["verdict"] == "revise", "revise").otherwise("pass").alias("verdict"),
        F.coalesce(F.nullif(v["summary"], F.lit("")), F.lit("Verification completed.")).alias("summary"),
        clamped(F.coalesce(v["confidence"], F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        F.transform(F.slice(F.coalesce(v["checks"], F.array().cast("array<struct<id:string,name:string,ok:boolean,severity:string,detail:string,fields:array<string>>>")), 1, CHECKS_KEPT), check).alias("checks"),
        listed(v["missing"]).alias("missing"),
        listed(v["unsupported"]).alias("unsupported"),
    )


def score_multiplier(scores: Column) -> Column:
    """100 for scores on 0 to 1, 10 for 0 to 10, if three or more are positive; else 1."""
    positive = F.filter(scores, lambda s: s > 0)
    return F.when(F.size(positive) < 3, 1).when(F.array_max(positive) <= 1, 100).when(F.array_max(positive) <= 10, 10).otherwise(1)


def median(values: Column) -> Column:
    """The middle of the values, or the mean of the two in the middle; 0 of none."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((low + high) / 2)


def review(scores: Column, overall: Column, verdict: Column, severities: Column) -> Column:
    """struct<scores, overall, verdict> of a review on 0 to 100, whatever scale it was given on; a high issue asks for revision."""
    by = score_multiplier(scores)
    middle = median(F.filter(F.transform(scores, lambda s: s * by), lambda s: s > 0))
    given = F.coalesce(overall, F.lit(0.0))
    times = F.when(by > 1, by).when((given > 0) & (given <= 10) & (middle >= 40), 10).otherwise(1)
    whole = lambda c: rounded(clamped(c, 0.0, 100.0))
    passes = (F.lower(text_of(verdict)) == "pass") & ~F.array_contains(severities, "high")
    return F.struct(F.transform(scores, lambda s: whole(s * by)).alias("scores"), whole(given * times).alias("overall"), F.when(passes, "pass").otherwise("revise").alias("verdict"))


def _scale(c: Column, low: float, high: float) -> Column:
    return clamped(F.when(F.coalesce(c, F.lit(0.0)) > 0, c).otherwise(1.0), low, high)


def merged_hints(hints: DataFrame, keys: list[str]) -> DataFrame:
    """Hints (…keys, panel, seq, area, width, height, reason) as one for each panel: scales are multiplied in order and clamped at each step.

    The first of a panel's hints counts as given; unknown panels are left out; the last reason that says something holds.
    """
    one = F.struct("seq", "area", "width", "height", "reason")
    grouped = hints.filter(F.col("panel").isin(PANELS)).groupBy(*keys, "panel").agg(F.array_sort(F.collect_list(one)).alias("h"))  # the hints of one panel
    number = lambda c: F.when(F.coalesce(c, F.lit(0.0)) > 0, c).otherwise(1.0)
    over = lambda n: F.aggregate("h", F.lit(1.0), lambda s, h: _scale(s * number(h[n]), LEAST_SCALE, MOST_SCALE))
    reasons = F.filter(F.transform("h", lambda h: F.substring(text_of(h["reason"]), 1, 180)), lambda r: r != "")
    return grouped.select(*keys, "panel", *[over(n).alias(n) for n in ("area", "width", "height")], F.coalesce(F.try_element_at(reasons, F.lit(-1)), F.lit("")).alias("reason"))


def style_scale(scales: Column) -> Column:
    """A style's scale after adjustments in order, clamped at each step."""
    return F.aggregate(scales, F.lit(1.0), lambda s, x: clamped(s * F.when(F.coalesce(x, F.lit(0.0)) > 0, x).otherwise(1.0), LEAST_STYLE, MOST_STYLE))


# ------------------------------------------------------------------ merging task results


def merged_fields(results: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """key and a column for each field from results (key, seq, field, value): the last value that says something, or a default."""
    said = F.nullif(strip(text_of(F.col("value"))), F.lit(""))
    last = lambda f: F.max_by(F.when(F.col("field") == f, said), F.when((F.col("field") == f) & said.isNotNull(), F.col("seq")))
    return results.groupBy(key).agg(*[F.coalesce(last(f), F.lit(MISSING_TITLE if f == "title" else MISSING_FIELD)).alias(f) for f in fields])


def recommendations(items: Column, source: Column) -> Column:
    """The first six distinct recommendations (task, type, reference, section, purpose, insight) that the source names, three a task at most.

    items: in order of task and place, with `place` from 0 within the task.
    """
    key = strict_key(source)
    shaped = F.transform(
        F.filter(items, lambda r: r["place"] < TASK_RECOMMENDATIONS),
        lambda r: F.struct(F.lower(text_of(r["type"])).alias("type"), F.substring(strip(text_of(r["reference"])), 1, 80).alias("reference"), F.lower(text_of(r["section"])).alias("section"), text_of(r["purpose"]).alias("purpose"), text_of(r["insight"]).alias("insight")),
    )
    fit = F.filter(shaped, lambda r: r["type"].isin(ASSET_TYPES) & (r["reference"] != "") & F.contains(key, strict_key(r["reference"])))
    once = F.slice(first_by_key(fit, lambda r: F.lower(F.concat_ws("|", r["type"], r["reference"]))), 1, ALL_RECOMMENDATIONS)
    placed = lambda r: F.when(r["section"].isin(ASSET_SECTIONS), r["section"]).when(r["type"] == "table", "results").when(r["type"] == "formula", "theory").otherwise("method")
    return F.transform(once, lambda r: F.struct(r["type"].alias("type"), r["reference"].alias("reference"), placed(r).alias("section"), F.substring(strip(F.coalesce(F.nullif(r["purpose"], F.lit("")), F.lit("Key paper evidence"))), 1, 180).alias("purpose"), F.substring(strip(r["insight"]), 1, 320).alias("insight")))


def section_notes(analysis: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, summary, locations: what memory keeps of each section.

    analysis: (key, fields…); evidence: (key, section, seq, location), whose sections are evidence keys. The contribution's evidence has the
    key `contributions`.
    """
    clean = lambda f: F.nullif(bounded(F.col(f), 1000), F.lit(""))
    made = F.array(*[F.struct(F.lit(s).alias("section"), F.concat_ws(" ", *[clean(f) for f in fields if f in analysis.columns]).alias("summary")) for s, fields in SECTION_FIELDS.items()])
    notes = analysis.select(key, F.inline(made))
    of = F.when(F.col("section") == "summary", "overview").when(F.col("section") == "contributions", "contribution").otherwise(F.col("section"))
    at = evidence.select(key, of.alias("section"), "seq", bounded(F.col("location"), 160).alias("location")).filter("location <> ''")
    first = at.groupBy(key, "section", "location").agg(F.min("seq").alias("seq")).groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "location"))), lambda x: x["location"]).alias("locations"))
    return notes.join(first, [key, "section"], "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))


# ------------------------------------------------------------------ runs


def run_metrics(tasks: DataFrame, tools: DataFrame, evidence: DataFrame, key: str, groups: int, input_rate: float = 0.0, output_rate: float = 0.0) -> DataFrame:
    """One row a run: tokens and cost of the model's tools, tasks by status, evidence and its coverage, retries.

    tasks: (key, status, attempts, memory_hits); tools: (key, name, status, input_tokens, output_tokens, total_tokens,
    token_estimate); evidence: (key, section), a row an item. The cost is null without rates.
    """
    count = lambda cond: F.count(F.when(cond, 1))
    status = F.col("status")
    t = tasks.groupBy(key).agg(F.count("*").alias("tasks"), count(status == "completed").alias("completed"), count(status == "insufficient").alias("insufficient"), count(status == "failed").alias("failed"), F.sum(F.greatest(F.lit(0), F.coalesce("attempts", F.lit(0)) - 1)).alias("retries"), F.sum(F.coalesce("memory_hits", F.lit(0))).alias("recalled"))
    by_model = F.col("name").isin(MODEL_TOOLS)
    total = lambda c: F.sum(F.when(by_model, F.coalesce(c, F.lit(0))).otherwise(0)).alias(c)
    u = tools.groupBy(key).agg(F.count("*").alias("tool_calls"), count(status == "completed").alias("completed_tools"), total("input_tokens"), total("output_tokens"), total("total_tokens"), F.coalesce(F.bool_or(by_model & F.col("token_estimate")), F.lit(False)).alias("token_estimate"))
    e = evidence.groupBy(key).agg(F.count("*").alias("evidence_items"), F.countDistinct("section").alias("evidence_groups"))
    both = t.join(u, key, "left").join(e, key, "left").fillna(0, ["tool_calls", "completed_tools", "input_tokens", "output_tokens", "total_tokens", "evidence_items", "evidence_groups"]).fillna(False, ["token_estimate"])
    share = lambda a, b: rounded(100.0 * a / b)
    cost = F.round((F.col("input_tokens") * input_rate + F.col("output_tokens") * output_rate) / 1_000_000, 6) if input_rate or output_rate else F.lit(None).cast("double")
    return both.withColumns({"task_completion": share(F.col("completed"), F.col("tasks")), "task_finished": share(F.col("completed") + F.col("insufficient"), F.col("tasks")), "evidence_coverage": share(F.col("evidence_groups"), F.lit(groups)), "cost": cost})


def efficiency(duration: Column, calls: Column, tokens: Column, cost: Column) -> Column:
    """What a run reports, never below 0; an unknown cost stays unknown."""
    floor = lambda c: F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0)))
    return F.struct(floor(duration).alias("duration_ms"), floor(calls).alias("model_calls"), floor(tokens).alias("total_tokens"), F.when(cost.isNotNull(), floor(cost)).alias("cost"))


def latest_revision(results: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Of each key's results those of its latest revision; earlier ones are stale."""
    last = results.groupBy(key).agg(F.max(revision).alias(revision))
    return results.join(last, [key, revision], "left_semi")

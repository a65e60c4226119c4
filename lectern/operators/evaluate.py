"""Scores of results against what is expected: coverage, precision and recall, consistency, weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import f1, f1_strict, is_missing, percent

#: Parts of the overall score, and the thresholds of a pass.
WEIGHTS = {"content": 0.30, "formulas": 0.15, "visuals": 0.15, "evidence": 0.20, "faithful": 0.20}
THRESHOLDS = {"overall": 80.0, "evidence": 90.0, "hallucination": 5.0}


def set_scores(actual: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """Precision, recall and F1 of each key; both tables: distinct (key, item) rows."""
    a = actual.select(key, item).distinct().withColumn("a", F.lit(1))
    e = expected.select(key, item).distinct().withColumn("e", F.lit(1))
    n = a.join(e, [key, item], "full").groupBy(key).agg(F.count("a").alias("n_actual"), F.count("e").alias("n_expected"), F.count(F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), 1)).alias("matched"))
    actual_or = F.when(F.col("n_actual") > 0, F.col("n_actual")).otherwise(F.col("n_expected"))  # nothing found of what is expected is no precision
    p, r = percent(F.col("matched"), actual_or), percent(F.col("matched"), F.col("n_expected"))
    return n.select("*", p.alias("precision"), r.alias("recall")).select("*", f1(F.col("precision"), F.col("recall")).alias("f1"), f1_strict(F.col("precision"), F.col("recall")).alias("f1_strict"))


def asset_recall(actual: str, expected: str):
    """Share of expected names that contain an actual one, or are contained; and of exact ones."""
    loose = F.filter(expected, lambda e: F.exists(actual, lambda a: F.contains(a, e) | F.contains(e, a)))
    exact = F.filter(expected, lambda e: F.array_contains(actual, e))
    return percent(F.size(loose), F.size(expected)), percent(F.size(exact), F.size(expected))


def coverage(concepts: DataFrame, key: str, field: str) -> DataFrame:
    """Matched and expected concepts, by key and by key and field: rows (key, field, matched boolean)."""
    return concepts.groupingSets([[key], [key, field]], key, field).agg(F.count(F.when(F.col("matched"), 1)).alias("n_matched"), F.count("*").alias("n_expected"))


def overall(parts: DataFrame) -> DataFrame:
    """The weighted score, to one place, and whether the thresholds are met; parts has content, formulas, visuals, evidence (0-100) and rate (0-1)."""
    w = WEIGHTS
    score = F.col("content") * w["content"] + F.col("formulas") * w["formulas"] + F.col("visuals") * w["visuals"] + F.col("evidence") * w["evidence"] + (1 - F.col("rate")) * 100 * w["faithful"]
    ok = (F.col("overall") >= THRESHOLDS["overall"]) & (F.col("evidence") >= THRESHOLDS["evidence"]) & (F.col("rate") * 100 <= THRESHOLDS["hallucination"])
    return parts.withColumn("overall", F.round(score, 1)).withColumn("passed", ok)


def suite(cases: DataFrame) -> DataFrame:
    """One row: cases, passes, and means in percent to one place; of durations and tokens, if the cases have them, to whole numbers."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    of = {"pass_rate": F.round(100 * mean(F.col("passed").cast("int")), 1), "mean_overall": F.round(mean("overall"), 1), "mean_rate": F.round(100 * mean("rate"), 1)}
    of |= {f"mean_{c}": F.floor(mean(c) + 0.5).cast("long") for c in ("duration_ms", "total_tokens") if c in cases.columns}
    return cases.agg(F.count("*").alias("n_cases"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), *[c.alias(n) for n, c in of.items()])


#: The checks of an analysis, and how bad it is to fail one.
CHECKS = {"evidence-coverage": "high", "formula-provenance": "high", "figure-provenance": "high", "table-provenance": "medium", "method-problem-fit": "high", "experiment-claim-fit": "high", "required-content": "medium"}
FIELDS = ["summary", "problem", "motivation", "method", "theory", "experiments", "results", "contributions", "innovation", "logicReview", "methodSupportsProblem", "experimentsValidateClaims"]


def audit(rows: DataFrame, key: str) -> DataFrame:
    """key, checks map<string, boolean>, score, verdict of analyses.

    rows: key, task_statuses array<string>, source_type, n_formulas, n_figures, n_tables, tools array<string> (those that were completed),
    evidence map<string, int> (items by section), analysis map<string, string>.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    ran = lambda *names: F.arrays_overlap(F.coalesce("tools", F.array().cast("array<string>")), F.array(*[n if isinstance(n, Column) else F.lit(n) for n in names]))
    by_source = lambda kind: F.when(F.col("source_type") == "arxiv", f"latex.{kind}").otherwise(f"text.{kind}")
    has = lambda s: F.coalesce(F.try_element_at("evidence", F.lit(s)), F.lit(0)) > 0
    said = lambda f: ~is_missing(F.try_element_at("analysis", F.lit(f)))
    filled = F.lit(True)
    for f in FIELDS:
        filled = filled & said(f)
    checks = {
        "evidence-coverage": F.forall(F.coalesce("task_statuses", F.array().cast("array<string>")), lambda s: s.isin("completed", "insufficient")),
        "formula-provenance": none("n_formulas") | ran(by_source("formulas")),
        "figure-provenance": none("n_figures") | ran(by_source("figures")),
        "table-provenance": none("n_tables") | ran("latex.tables", "pdf.table-crop"),
        "method-problem-fit": has("problem") & has("method") & said("methodSupportsProblem"),
        "experiment-claim-fit": has("experiments") & has("results") & said("experimentsValidateClaims"),
        "required-content": filled,
    }
    made = rows.select(key, F.create_map(*[x for n, c in checks.items() for x in (F.lit(n), c)]).alias("checks"))
    failed = F.map_keys(F.map_filter("checks", lambda _, ok: ~ok))
    severe = F.array(*[F.lit(n) for n, s in CHECKS.items() if s == "high"])
    score = F.floor(100.0 * (len(CHECKS) - F.size(failed)) / len(CHECKS) + 0.5).cast("int")
    return made.select(key, "checks", score.alias("score"), F.when(F.arrays_overlap(failed, severe), "review").when(F.size(failed) > 0, "warning").otherwise("pass").alias("verdict"))

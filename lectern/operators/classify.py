"""Weighted-signal classification of papers and placement of assets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.text import strict_key, text_of

# Signals of the paper types, in the order that decides ties; what raises a type's score beyond them; and where references begin.
TYPE_SIGNALS = {
    "method": [
        r"(?i)\b(?:we\s+)?propos(?:e|ed)\b",
        r"(?i)(?:proposed|new|parallel) (?:method|model|approach|algorithm|architecture|framework|pipeline|system)",
        r"(?i)our (?:method|framework|pipeline|system|architecture)",
        r"(?i)\bwe (?:design|develop|introduce|present) (?:[A-Za-z0-9_-]+:\s*)?(?:a |an )?(?:novel )?(?:multi-agent |agentic |unified )?(?:prompting )?(?:method|model|approach|algorithm|architecture|framework|pipeline|system)",
        r"本文提出",
        r"我们(?:设计|开发|提出).{0,8}(?:模型|算法|架构|框架|流程|系统)",
    ],
    "theory": [r"(?i)theorem|lemma|proof|proposition|corollary", r"(?i)formal guarantee|upper bound|lower bound", r"定理|引理|证明|理论保证"],
    "empirical": [r"(?i)empirical study|controlled experiment|we investigate|we observe|we evaluate", r"(?i)research questions?|manual(?:ly)? annotat|annotation protocol|pass@\d+|codereval|coder?eval", r"实证|对照实验|观察到|统计分析|研究问题|人工标注"],
    "survey": [r"(?i)\b(?:survey|systematic review|meta-analysis)\b", r"(?i)\b(?:we|this (?:paper|work)) (?:review|survey|categorize|summarize)\b", r"(?i)\b(?:taxonomy of|research landscape)\b", r"综述|系统性回顾|分类体系|元分析"],
    "system": [r"(?i)throughput|latency|deployment|distributed system|scalability", r"吞吐|延迟|部署|分布式系统|可扩展"],
    "dataset": [r"(?i)new dataset|introduce (?:a )?(?:dataset|benchmark)|benchmark suite|annotation protocol|data collection", r"新数据集|提出.{0,6}基准|标注流程|数据采集"],
    "guideline": [r"(?i)formatting instructions?|submission guidelines?|author guidelines?|camera-ready instructions?", r"(?i)must be prepared according to|strict upper limit of \d+ pages|page limits?|style requirements?", r"投稿指南|格式要求|作者须知|页数限制"],
}
REFERENCES_ON = r"(?is)(?:^|\n)\s*(?:#{1,4}\s*)?(?:references|bibliography)\s*(?:\n|\z).*"
BODY, TITLE, OPENING = "body", "title", "opening"
SURVEY_TITLE = (TITLE, r"(?im)^(?:#\s*)?.{0,180}\b(?:survey|systematic review|meta-analysis)\b")
SURVEY_CLAIM = (OPENING, r"(?i)\b(?:we|this (?:paper|work)) (?:review|survey)\b")
METHOD_CLAIM = (OPENING, r"(?i)\b(?:we|this (?:paper|work))\s+(?:introduce|propose|present|develop|design)\b.{0,180}\b(?:framework|pipeline|system|method|model|architecture|algorithm|approach|solution)\b")
ADDRESS_CLAIM = (OPENING, r"(?i)\bto address\b.{0,180}\bwe propose\b")
METHOD_SECTION = (BODY, r"(?im)(?:^|\n)\s*(?:#{1,4}\s*)?(?:\d+(?:\.\d+)*\s+)?(?:methodology|method|proposed approach|our approach|framework|architecture)\s*(?:\n|$)")
CONTRIBUTION_CLAIM = (OPENING, r"(?i)\bour main contributions? are as follows\b|\bwe make the following contributions?\b")
BONUSES = [
    ("theory", 2, (BODY, r"(?i)\\begin\{(?:equation|align|theorem|proof)")),
    ("method", 2, (BODY, r"(?i)\\begin\{algorithm|algorithm\s*\d+")),
    ("empirical", 1, (BODY, r"(?i)table\s*\d+|表\s*\d+")),
    ("survey", 14, (TITLE, r"(?im)^(?:#\s*)?.{0,180}\b(?:survey|review|meta-analysis)\b")),
    ("survey", 14, (TITLE, r"(?m)^(?:#\s*)?.{0,120}(?:综述|系统性回顾|分类体系|元分析)")),
    ("empirical", 8, (TITLE, r"(?i)\bwe conduct an empirical study\b|\bempirical (?:study|analysis)\b")),
    ("method", 8, (TITLE, r"(?i)\b(?:we|this (?:paper|work)) (?:introduce|propose|present|develop|design) (?:[A-Za-z0-9_-]+:\s*)?(?:a |an )?(?:novel )?(?:multi-agent |agentic |unified )?(?:prompting )?(?:framework|pipeline|system|method|model|architecture|algorithm|approach)\b")),
    ("method", 5, METHOD_SECTION),
]
TITLE_CHARS, OPENING_CHARS = 1200, 7000
# Words that place a figure, by the part of a poster.
METHOD_TERMS = [
    "method", "overview", "architecture", "framework", "pipeline", "workflow", "algorithm", "model", "mechanism", "design", "system", "component", "module", "training", "inference", "方法", "架构", "框架", "流程", "模型", "机制", "系统",
]
RESULT_TERMS = [
    "result", "experiment", "performance", "comparison", "ablation", "evaluation", "benchmark", "accuracy", "bleu", "latency", "throughput", "scaling", "analysis", "finding", "curve", "plot", "bitrate", "rate-distortion", "psnr", "ssim",
    "结果", "实验", "性能", "对比", "消融", "评估", "指标", "曲线",
]
THEORY_TERMS = ["key idea", "principle", "concept", "theory", "objective", "attention map", "feature alignment", "representation alignment", "latent space", "encoding principle", "核心思想", "原理", "理论", "目标函数", "特征对齐", "表征对齐"]
PARTS = ("method", "theory", "results")


def type_scores(docs: DataFrame, signals: dict[str, list[str]] = TYPE_SIGNALS, most: int = 5, id_col: str = "doc_id", source_type: Column | None = None) -> DataFrame:
    """doc_id, type, ord, score: matches of each type's patterns, `most` a pattern at most, and bonuses; references don't count.

    Without an explicit review claim a survey has two points at most; with a method claim and without a survey's, the
    method leads it by eight. Papers from arXiv lean a quarter towards methods.
    """
    body = F.regexp_replace(text_of(F.col("text")), REFERENCES_ON, "")
    made = docs.select(F.col(id_col).alias("doc_id"), body.alias(BODY), (source_type if source_type is not None else F.lit("text")).alias("_source"))
    made = made.withColumns({TITLE: F.substring(BODY, 1, TITLE_CHARS), OPENING: F.substring(BODY, 1, OPENING_CHARS)})
    said = lambda rule: F.col(rule[0]).rlike(rule[1])
    counted = lambda ps: sum((F.least(F.lit(most), F.regexp_count(BODY, F.lit(p))) for p in ps), F.lit(0))
    made = made.withColumns({"_survey": said(SURVEY_TITLE) | said(SURVEY_CLAIM), "_claim": said(METHOD_CLAIM) | said(ADDRESS_CLAIM), **{f"_{t}_score": counted(ps) for t, ps in signals.items()}})
    score = {t: F.col(f"_{t}_score") + sum((F.when(said(rule), n).otherwise(0) for kind, n, rule in BONUSES if kind == t), F.lit(0)) for t in signals}
    if "method" in score and "survey" in score:
        score["method"] = score["method"] + F.when(F.col("_claim"), 12 + F.when(said(CONTRIBUTION_CLAIM), 4).otherwise(0)).otherwise(0)
        score["survey"] = F.when(F.col("_survey"), score["survey"]).otherwise(F.least(score["survey"], F.lit(2)))
        score["method"] = F.when(F.col("_claim") & ~F.col("_survey"), F.greatest(score["method"], score["survey"] + 8)).otherwise(score["method"]) + F.when(F.col("_source") == "arxiv", 0.25).otherwise(0.0)
    each = [F.struct(F.lit(t).alias("type"), F.lit(i).alias("ord"), score[t].cast("double").alias("score")) for i, t in enumerate(signals)]
    return made.select("doc_id", F.inline(F.array(*each)))


def classify(scores: DataFrame, fallback: str = "method") -> DataFrame:
    """The best type of each document, its margin, a confidence, and the next two."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "ord", "type")))  # as many as there are types
    r = scores.groupBy("doc_id").agg(ranked.alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    best, margin = -at(0)["low"], F.greatest(F.lit(0.0), at(1)["low"] - at(0)["low"])
    sure = F.when(best > 0, F.least(F.lit(0.96), F.round(0.5 + margin * 0.06 + best * 0.02, 2))).otherwise(0.35)
    return r.select("doc_id", F.when(best > 0, at(0)["type"]).otherwise(fallback).alias("paper_type"), best.alias("score"), margin.alias("margin"), sure.alias("confidence"), at(1)["type"].alias("second"), at(2)["type"].alias("third"))


def placement(text: Column, kind: Column, told: Column | None = None) -> Column:
    """Where an asset goes: tables to the results, others where an analysis told, else by how many terms of each part occur in their words."""
    terms = lambda ts: F.array(*[F.lit(re.sub(r"[^\w]+|_", " ", t)) for t in ts])
    hits = lambda x, ts: F.size(F.filter(terms(ts), lambda t: F.contains(x, t)))
    counted = bound(strict_key(text), lambda x: F.struct(hits(x, METHOD_TERMS).alias("method"), hits(x, THEORY_TERMS).alias("theory"), hits(x, RESULT_TERMS).alias("results")))
    by_words = bound(counted, lambda n: F.when((n["theory"] > n["method"]) & (n["theory"] > n["results"]), "theory").when(n["results"] > n["method"], "results").otherwise("method"))
    said = F.lower(text_of(told if told is not None else F.lit("")))
    return F.when(kind == "table", "results").when(said.isin(*PARTS), said).otherwise(by_words)


def placed(assets: DataFrame) -> DataFrame:
    """Assets (doc_id, type, name, caption, source, purpose, insight, told) with their part of the poster."""
    words = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "caption", "source", "purpose", "insight")])
    return assets.withColumn("part", placement(words, F.col("type"), F.col("told")))

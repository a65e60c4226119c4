"""Plans by paper type: reading tasks with priorities, visual slots and where they stand, sections and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .assets import FRAMEWORK, STUDY
from .retrieve import READING_PLAN

# Fixed values, by paper type: tasks of high priority and the order of sections; what evidence a task asks for; its goal, where it isn't the plan's; what each type shows, and how many
# of each asset; and the labels of sections.
FOCUS = {
    "method": (["problem", "method", "theory", "experiments", "results"], ["overview", "problem", "method", "theory", "experiments", "results", "contribution"]),
    "theory": (["problem", "theory", "contribution"], ["overview", "problem", "theory", "method", "results", "contribution", "experiments"]),
    "empirical": (["problem", "experiments", "results", "contribution"], ["overview", "problem", "experiments", "results", "method", "contribution", "theory"]),
    "survey": (["overview", "problem", "method", "contribution"], ["overview", "problem", "method", "results", "contribution", "experiments", "theory"]),
    "system": (["problem", "method", "experiments", "results"], ["overview", "problem", "method", "experiments", "results", "contribution", "theory"]),
    "dataset": (["problem", "method", "experiments", "results"], ["overview", "problem", "method", "experiments", "results", "contribution", "theory"]),
    "guideline": (["overview", "problem", "method", "results"], ["overview", "problem", "method", "theory", "results", "contribution", "experiments"]),
}
TARGETS = {
    "any": {
        "overview": ["abstract claim", "paper objective"],
        "problem": ["stated gap", "failure of prior work", "importance"],
        "method": ["pipeline", "module roles", "implementation choices"],
        "theory": ["exact formula or theorem", "assumptions", "notation meaning"],
        "experiments": ["datasets", "baselines", "metrics", "ablations"],
        "results": ["numerical result", "comparison", "claim qualifier"],
        "contribution": ["claimed novelty", "supported contribution", "limitation"],
    },
    "survey": {
        "overview": ["survey scope", "organizing thesis", "field coverage"],
        "problem": ["fragmentation", "comparison gap", "open challenge"],
        "method": ["taxonomy dimensions", "scope or selection process", "comparison framework"],
        "theory": ["concept definition", "organizing principle", "theoretical distinction"],
        "experiments": ["datasets across studies", "benchmarks", "evaluation metrics"],
        "results": ["cross-method comparison", "trend", "trade-off"],
        "contribution": ["survey synthesis", "research gap", "future direction"],
    },
    "guideline": {
        "overview": ["audience", "scope", "mandatory rule"],
        "problem": ["common error", "consistency need", "compliance risk"],
        "method": ["submission workflow", "required format", "anonymization"],
        "theory": ["page limit", "font size", "margin", "file requirement"],
        "experiments": ["compliance check", "example", "exception"],
        "results": ["must", "must not", "strict limit"],
        "contribution": ["author takeaway", "exception", "verification item"],
    },
}
GOALS = {
    "survey": {
        "overview": "Identify the survey scope, field boundaries, organizing thesis, and concise overall takeaway.",
        "problem": "Identify why the field needs synthesis, which fragmentation or comparison gaps motivate the survey, and why they matter.",
        "method": "Reconstruct the survey taxonomy, organizing dimensions, scope or selection process, and comparison framework.",
        "theory": "Explain the key conceptual definitions or theoretical principles used to organize the field; do not require a new formula when none is proposed.",
        "experiments": "Extract recurring datasets, benchmarks, metrics, and evaluation practices across the surveyed studies without implying the survey ran new experiments.",
        "results": "Summarize cross-method comparisons, field-wide trends, trade-offs, and conclusions supported by the survey's tables or discussion.",
        "contribution": "Summarize the survey's synthesis, taxonomy, identified gaps, limitations, future directions, and complete organizing logic.",
    },
    "guideline": {
        "overview": "Identify the document's audience, scope, purpose, and the most consequential mandatory rule.",
        "problem": "Explain which submission or compliance errors the instructions are intended to prevent and why consistency matters.",
        "method": "Organize mandatory submission requirements into a concise workflow covering preparation, formatting, anonymization, and submission.",
        "theory": "Extract exact layout, typography, length, file, and presentation rules; do not invent a scientific mechanism or formula.",
        "experiments": "Identify checks, examples, exceptions, or validation procedures; do not describe sample figures and tables as experiments.",
        "results": "Produce a compliance checklist of the most important enforceable requirements and consequences of violations.",
        "contribution": "Summarize the practical value of the instructions, notable exceptions, and remaining items authors must verify.",
    },
}
FOCUS_GOAL = "Apply the %s-document reading focus and preserve explicit qualifiers."
VISUALS = {
    "method": ["method-diagram", "key-formula", "main-results", "ablation"],
    "theory": ["key-formula", "theorem", "proof-map", "example"],
    "empirical": ["study-design", "main-results", "uncertainty", "subgroup"],
    "survey": ["taxonomy", "comparison-table", "timeline", "gap-map"],
    "system": ["system-architecture", "performance", "scaling", "breakdown"],
    "dataset": ["collection-pipeline", "statistics", "examples", "benchmark"],
    "guideline": ["compliance-flow", "rule-checklist", "page-layout", "exceptions"],
}
ASSET_LIMITS = {"method": (2, 2, 1), "theory": (3, 1, 1), "empirical": (1, 2, 2), "survey": (0, 2, 2), "system": (1, 2, 2), "dataset": (1, 2, 2), "guideline": (0, 1, 1)}
FORMULA_SIGNAL = r"(?i)\$\$|\\begin\{(?:equation|align)"
FIGURE_SIGNAL, TABLE_SIGNAL = r"(?i)(?:figure|fig\.|图)\s*\d+", r"(?i)(?:table|表)\s*\d+"
MECHANISM_SIGNAL = r"(?i)\b(?:objective|likelihood|probability|distribution|marginali[sz]|latent variable|loss|posterior|optimization|update rule|attention|projection|entropy)\b|目标函数|概率|分布|边缘化|隐变量|损失|后验|优化|更新规则|注意力|投影|熵"
SECTION_LABELS = {"overview": "Overview", "problem": "Problem and Motivation", "method": "Method", "theory": "Formula and Theory", "experiments": "Experimental Design", "results": "Results and Claim Support", "contribution": "Contribution, Limitations, and Logic Review"}
WIDE_SECTIONS = ["method", "theory", "results"]
METHOD_WORDS = r"(?i)\b(?:method|model|architecture|framework|pipeline|generator|discriminator|encoder|decoder|module|training|inference|algorithm|network)\b"
THEORY_WORDS = r"(?i)\b(?:theorem|lemma|proof|proposition|corollary|formal guarantee)\b"
SURVEY_WORDS = r"(?i)\b(?:survey|systematic review|meta-analysis)\b|\b(?:we|this (?:paper|work)) (?:review|survey)\b"
PROPOSED = (r"(?i)\b(?:introduces?|proposes?|presents?|develops?|designs?)\b.{0,160}\b(?:multi-agent |agentic |unified )?(?:framework|pipeline|architecture|method|model|system|algorithm|solution)\b", r"(?i)\b(?:framework|pipeline|architecture)\b.{0,140}\b(?:consists? of|comprises?|agents?|modules?|workflow|iteration)\b")
TAXONOMY_WORDS = r"(?i)\b(?:taxonomy|categor(?:y|ies|ization)|annotation|root causes?)\b"
MITIGATION_WORDS = r"(?i)\b(?:mitigation|intervention|before[- ]and[- ]after|retrieval augmented)\b"
EXPLAINS_METHOD = r"(?i)\b(?:method|model|architecture|framework|pipeline|generator|discriminator|encoder|decoder|module|training|inference|algorithm)\b"
HEADINGS = {"problem": "Research Problem", "motivation": "Motivation", "method": "Method Overview", "theory": "Key Mechanism", "visuals": "Selected Visual Evidence", "results": "Main Experimental Results", "contribution": "Contributions"}
TYPE_HEADINGS = {
    "theory": {"method": "Definitions and Assumptions", "theory": "Central Theory", "visuals": "Proof Map / Examples", "results": "Implications and Validation"},
    "empirical": {"method": "Study Design", "theory": "Variables and Measures", "visuals": "Key Findings", "results": "Results and Validity"},
    "survey": {"method": "Scope and Taxonomy", "theory": "Comparison Framework", "visuals": "Taxonomy and Comparisons", "results": "Gaps and Trends"},
    "system": {"method": "System Architecture", "theory": "Design Principle", "visuals": "Architecture and Scaling", "results": "Performance Results"},
    "dataset": {"method": "Collection and Annotation", "theory": "Task and Evaluation Protocol", "visuals": "Dataset and Benchmark Evidence", "results": "Benchmark Results"},
    "guideline": {"problem": "Purpose & Scope", "method": "Submission Requirements", "theory": "Formatting Rules", "visuals": "Reference Examples", "results": "Compliance Checklist"},
}
FORMULA_HEADING, TAXONOMY_HEADINGS, MITIGATION_HEADING = "Key Idea / Formula", {"method": "Study Design & Taxonomy", "theory": "Mechanism & Root Causes"}, "Mitigation Results"


def reading_plans(spark: SparkSession) -> DataFrame:
    """paper_type, task_id, task_order, section_order, priority, goal, required_evidence, max_sentences: a few rows a type, for a broadcast join."""
    rows = []
    for kind, (high, order) in FOCUS.items():
        for i, (task, _, goal, *_) in enumerate(READING_PLAN):
            goal = f"{GOALS.get(kind, {}).get(task, goal)} {FOCUS_GOAL % kind}"
            rows.append((kind, task, i + 1, order.index(task) + 1, "high" if task in high else "supporting", goal, TARGETS.get(kind, TARGETS["any"])[task], 2 if task == "overview" else 3))
    return spark.createDataFrame(rows, "paper_type string, task_id string, task_order int, section_order int, priority string, goal string, required_evidence array<string>, max_sentences int")


def planned(papers: DataFrame) -> DataFrame:
    """Each paper (…, paper_type) with the tasks of its type; an unknown type is read like a method paper."""
    known = F.when(F.col("paper_type").isin(list(FOCUS)), F.col("paper_type")).otherwise("method")
    return papers.withColumn("paper_type", known).join(F.broadcast(reading_plans(papers.sparkSession)), "paper_type")


def sections(plans: DataFrame) -> DataFrame:
    """Planned rows with a section's label and span."""
    label = F.coalesce(*[F.when(F.col("task_id") == t, F.lit(v)) for t, v in SECTION_LABELS.items()])
    return plans.withColumns({"label": label, "span": F.when((F.col("priority") == "high") | F.col("task_id").isin(WIDE_SECTIONS), "wide").otherwise("standard")})


def _any(kind: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(kind, F.lit(p))
    return out


def near_section(kind: Column) -> Column:
    """The section that a visual stands by."""
    return (
        F.when(_any(kind, "formula") | kind.isin("theorem", "proof-map"), "theory")
        .when(_any(kind, "result") | kind.isin("performance", "scaling", "benchmark"), "results")
        .when(kind.isin("ablation", "uncertainty", "subgroup"), "experiments")
        .otherwise("method")
    )


def visual_slots(papers: DataFrame) -> DataFrame:
    """doc_id, pos, kind, priority, preference, operation, available, section: what papers (doc_id, paper_type, text) of a type show.

    A slot is available if the text has formulas, tables or figures of the sort it needs.
    """
    n = {"formulas": FORMULA_SIGNAL, "figures": FIGURE_SIGNAL, "tables": TABLE_SIGNAL}
    counted = papers.select("doc_id", "paper_type", *[F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).alias(c) for c, p in n.items()])
    kinds = F.coalesce(*[F.when(F.col("paper_type") == t, F.array(*[F.lit(k) for k in ks])) for t, ks in VISUALS.items()], F.array(*[F.lit(k) for k in VISUALS["method"]]))
    slots = counted.select("*", F.posexplode(kinds).alias("pos", "kind"))
    kind = F.col("kind")
    exact = _any(kind, "formula") | (kind == "theorem")
    tabular = _any(kind, "table", "results") | (kind == "ablation")
    available = F.when(exact, F.col("formulas") > 0).when(tabular | (kind == "benchmark"), (F.col("tables") > 0) | (F.col("figures") > 0)).otherwise(F.col("figures") > 0)
    return slots.select(
        "doc_id", "pos", "kind", F.when(F.col("pos") < 2, "high").otherwise("supporting").alias("priority"), F.when(exact, "exact-latex").otherwise("original-paper-asset").alias("preference"),
        F.when(tabular, "crop-relevant-region-with-headers").otherwise("preserve-original").alias("operation"), available.alias("available"), near_section(kind).alias("section"),
    )


def selection_policy(papers: DataFrame) -> DataFrame:
    """doc_id, max_formulas, max_figures, max_tables, reserve_figure, require_formula of papers (doc_id, paper_type, text)."""
    x, kind = F.coalesce("text", F.lit("")), F.col("paper_type")
    limit = lambda i: F.coalesce(*[F.when(kind == t, F.lit(v[i])) for t, v in ASSET_LIMITS.items()], F.lit(ASSET_LIMITS["method"][i]))
    required = x.rlike(FORMULA_SIGNAL) & kind.isin("method", "theory", "system") & x.rlike(MECHANISM_SIGNAL)
    return papers.select("doc_id", *[limit(i).alias(c) for i, c in enumerate(("max_formulas", "max_figures", "max_tables"))], (~x.rlike(TABLE_SIGNAL) & x.rlike(FIGURE_SIGNAL)).alias("reserve_figure"), required.alias("require_formula"))


def density(slots: DataFrame, papers: DataFrame) -> DataFrame:
    """doc_id, n_available, density: how a poster is filled, by its available visuals."""
    n = slots.filter("available").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_available"))
    both = papers.select("doc_id", "paper_type").join(n, "doc_id", "left").withColumn("n_available", F.coalesce("n_available", F.lit(0)))
    return both.select("doc_id", "n_available", F.when(F.col("n_available") >= 3, "visual").when(F.col("paper_type") == "theory", "compact").otherwise("balanced").alias("density"))


def resolved_type(kind: Column, title: Column, summary: Column, method: Column) -> Column:
    """The type by which a poster is laid out: theory, studies and surveys that present a method are method papers."""
    x = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, summary, method)])
    is_method = (
        F.when(kind == "theory", (F.regexp_count(x, F.lit(METHOD_WORDS)) >= 2) & ~x.rlike(THEORY_WORDS))
        .when(kind == "empirical", (x.rlike(FRAMEWORK[0]) | x.rlike(FRAMEWORK[1])) & ~x.rlike(STUDY))
        .when(kind == "survey", (x.rlike(PROPOSED[0]) | x.rlike(PROPOSED[1])) & ~x.rlike(SURVEY_WORDS))
        .otherwise(False)
    )
    return F.when(is_method, "method").otherwise(kind)


def panel_headings(kind: Column, has_formula: Column, method: Column, theory: Column, results: Column) -> Column:
    """A struct with the heading of each panel, by the paper's type and what it speaks of."""
    said = lambda c: F.coalesce(c, F.lit(""))
    study = F.concat_ws(" ", said(method), said(theory), said(results))

    def heading(panel: str) -> Column:
        plain = F.when(has_formula, FORMULA_HEADING).otherwise(HEADINGS[panel]) if panel == "theory" else F.lit(HEADINGS[panel])
        for t, names in TYPE_HEADINGS.items():
            if panel in names:
                own = F.lit(names[panel])
                if t == "theory" and panel == "method":
                    own = F.when(said(method).rlike(EXPLAINS_METHOD), HEADINGS["method"]).otherwise(own)
                if t == "empirical" and panel in TAXONOMY_HEADINGS:
                    own = F.when(study.rlike(TAXONOMY_WORDS), TAXONOMY_HEADINGS[panel]).otherwise(own)
                if t == "empirical" and panel == "results":
                    own = F.when(study.rlike(MITIGATION_WORDS), MITIGATION_HEADING).otherwise(own)
                plain = F.when(kind == t, own).otherwise(plain)
        return plain.alias(panel)

    return F.struct(*[heading(p) for p in HEADINGS])

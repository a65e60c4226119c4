"""Predicates and score helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound
from .text import collapse, strip, text_of

# Words of section headings, whole headings, and what counts as a missing answer.
HEADING_TERMS = "abstract|introduction|background|related work|method|methodology|approach|model|architecture|experiment|evaluation|result|discussion|conclusion|limitation|future work|appendix|references|bibliography|dataset|taxonomy|annotation|research question|hallucination statistics|mitigation|root causes?"
HEADINGS = "abstract|introduction|background|related work|method(?:ology)?|approach|experiments?|evaluation|results?|discussion|conclusion|limitations?|future work|appendix|references|bibliography|datasets?|taxonomy|annotation(?: protocol)?|research questions?|hallucination statistics|mitigation(?: approach)?|rag-based mitigation|root causes?"
MISSING = r"(?i)not found in provided context|untitled paper"
_NUMBER = r"\d+(?:\.\d+)*[.)]?\s+"


def heading(line: Column) -> Column:
    """The heading that a line of 140 characters at most states, or the empty string.

    Marked lines are headings; so are whole headings, numbered or not, whose last colon or stop is dropped, and numbered
    lines with a word of headings.
    """

    def stated(x: Column) -> Column:
        numbered = F.regexp_extract(x, f"^{_NUMBER}(.+)$", 1)
        return (
            F.when(F.length(x) > 140, "")
            .when(x.rlike(r"^#{1,6}\s+."), strip(F.regexp_extract(x, r"^#{1,6}\s+(.+)", 1)))
            .when(x.rlike(rf"(?i)^(?:{_NUMBER})?(?:{HEADINGS})\s*[:.]?$"), F.regexp_replace(x, "[:.]$", ""))
            .when(x.rlike(f"(?i)^{_NUMBER}.*(?:{HEADING_TERMS})") & (numbered != "") & numbered.rlike(f"(?i){HEADING_TERMS}"), x)
            .otherwise("")
        )

    return bound(strip(text_of(line)), stated)


def is_reference_section(h: Column) -> Column:
    return h.rlike("(?i)references|bibliography")


def is_missing(c: Column) -> Column:
    return (F.trim(text_of(c)) == "") | text_of(c).rlike(MISSING)


# What makes a formula, and what is none.
FORMULA_SIGNS = r"[=<>≈≃∝±×÷+*/^_|]|(?i:\\(?:sum|prod|int|frac|sqrt|min|max|log|exp|argmin|argmax|mathbb|mathbf|mathrm|operatorname)\b)|[A-Za-z]_[{A-Za-z0-9]|[A-Za-z]\s*\([^)]*[|,][^)]*\)"
METADATA = r"(?i)\\(?:author|affiliation|institution|email|orcid|thanks)\b"
WORDS_ONLY = r"^[,;:'`.\s\p{L}-]+$"


def plausible_formula(c: Column) -> Column:
    """Three characters or more, with a sign of mathematics, and neither words alone nor an author's data."""
    x = strip(text_of(c))
    return (F.length(x) >= 3) & ~x.rlike(METADATA) & ~x.rlike(WORDS_ONLY) & x.rlike(FORMULA_SIGNS)


def complexity_only(c: Column) -> Column:
    return strip(text_of(c)).rlike(r"^(?i:[OΘΩ])\s*\([^)]*\)$")


def image_data_url(c: Column) -> Column:
    """Whether an address holds an image itself, of a kind that is shown."""
    return text_of(c).rlike(r"(?i)^data:image/(?:png|jpeg|webp);base64,")


def paper_url(c: Column) -> Column:
    """An address of a paper's own page; empty for any other."""
    x = strip(text_of(c))
    return F.when(x.rlike(r"(?i)^https://(?:doi\.org|arxiv\.org)/"), x).otherwise("")


def safe_url(c: Column) -> Column:
    return text_of(c).rlike(r"(?i)^(?:https?://|/api/)")


# The rules for an answer's text, as (pattern that is wrong, pattern that excuses it, what is said), and the words
# by which contributions are told from results.
LONG_FIELDS = ["problem", "motivation", "contributions", "innovation", "logicReview"]
NO_ANSWER = r"(?i)^(?:not found|no (?:clear |reliable )?)"
RULES = [
    (r"(?i)^(?:figure|fig\.|table)\s*\d+", None, "is a caption, not a conclusion"),
    (r"(?i)\b(?:e\.\s*g|i\.\s*e|et\s+al)\.$", None, "ends at an abbreviation"),
    (r"(?i)\.{3,}$|…$|[,;:]$|\b(?:and|or|to|of|with|by|for|from|that|which)$", None, "trails off"),
    (r"(?i)\b(?:a|an|the|this|these|those|using|including|their|our|its|is|are|was|were|thei)$", r"[.!?。！？)\]]$", "ends with an incomplete source fragment"),
    (r"(?i)\bcompared(?:\s+(?:with|to))?[.!?]$", None, "omits the comparison target"),
    (r"(?i)[,;]\s*(?:and|or|but)\s+(?:for|with|in|on|of|to|by)\s+(?:the|a|an)?\s*[A-Za-z0-9_-]+(?:\s+[A-Za-z0-9_-]+){0,4}[.!?]$", None, "ends with a dangling clause"),
    (r"(?i)\bif accepted[.!?]$", None, "ends with an incomplete acceptance condition"),
    (r"^[a-z]{2,}\s", r"^(?:iPhone|eBay)\b", "starts mid-sentence"),
]
NOVELTY = r"(?i)\b(?:propos(?:e|es|ed|ing)|introduc(?:e|es|ed|ing)|present(?:s|ed|ing)?|develop(?:s|ed|ing)?|design(?:s|ed|ing)?|new|novel|first|framework|architecture|method|approach|objective|mechanism|formulation|training scheme|based entirely|unified)\b"
RESULT = r"(?i)\b(?:achiev(?:e|es|ed|ing)|outperform(?:s|ed|ing)?|improv(?:e|es|ed|ing)|accuracy|score|bleu|state-of-the-art|twice|higher|lower|increase|decrease|drop|gain)\b|\b\d+(?:\.\d+)?%?"


def contribution_issue(c: Column) -> Column:
    """Why a text of contributions states no novelty; null if it does."""
    x = collapse(c)
    unsaid = F.when(x.rlike(RESULT), "contributions reports an experimental result instead of the paper's novelty").otherwise("contributions does not state what the paper introduces")
    return F.when(x == "", "contributions is missing").when(~x.rlike(NOVELTY), unsaid)


def field_issues(field: Column, c: Column) -> Column:
    """What is wrong with the answer for a field, as a list; a title is never wrong."""
    x = collapse(c)
    said = lambda what: F.concat(field, F.lit(f" {what}"))
    found = [F.when(F.length(x) < F.when(field.isin(LONG_FIELDS), 32).otherwise(18), said("is too short"))]
    for wrong, excused, what in RULES:
        found.append(F.when(x.rlike(wrong) & (~x.rlike(excused) if excused else F.lit(True)), said(what)))
    found.append(F.when(field == "contributions", contribution_issue(x)))
    issues = F.array_distinct(F.filter(F.array(*found), lambda i: i.isNotNull()))
    return F.when(field == "title", F.array().cast("array<string>")).when((x == "") | x.rlike(NO_ANSWER), F.array(said("is missing"))).otherwise(issues)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one place; nothing expected counts as complete."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.round(100.0 * part / whole, 1))


def f1(precision: Column, recall: Column) -> Column:
    """100 where both are 0, as the scores have it; f1_strict says 0."""
    return F.when(precision + recall == 0, F.lit(100.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 1))


def f1_strict(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 1))


def round_budget(base: Column, round_no: Column) -> Column:
    """Characters of evidence in a round."""
    return F.least(F.lit(30_000), base + 4_500 * (round_no - 1))


def round_chunks(base: Column, round_no: Column) -> Column:
    return F.least(F.lit(18), base + 3 * (round_no - 1))


def image_shape(width: Column, height: Column) -> Column:
    r = width / height
    return F.when(r < 1.15, "portrait").when(r < 3.6, "landscape").otherwise("ultrawide")


def boxes_overlap(a: Column, b: Column, share: float = 0.18) -> Column:
    """Whether two boxes (x, y, w, h) share that part of the smaller one."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return w * h >= share * F.least(a["w"] * a["h"], b["w"] * b["h"])

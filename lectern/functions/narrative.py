"""Texts for panels: points within a budget, fields joined without repeats, key phrases and flows. All within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, first_by_key
from .text import collapse, export_sentences, strip, text_of

# Budgets of the panels as (sentences, characters), what opens and ends a phrase, and the words of mechanisms and results.
PANEL_BUDGETS = {"problem": (2, 330), "motivation": (3, 2000), "method": (3, 560), "results": (4, 720), "contributions": (4, 680), "summary": (2, 300), "theory": (2, 360)}
MERGED_PANELS = {"motivation": "problem"}
PHRASE_TURNS = r"(?i),\s+(?=(?:then|and then|which|while|whereas|but|executes?|generates?|uses?|applies?|feeds?|updates?|refines?|produces?|retrieves?|selects?|encodes?|decodes?)\b)"
PHRASE_LEADS = r"(?i)^(?:the model|the method|the system|rag)\s+"
PHRASE_AIMS = r"(?i)\s+(?:in order to|so that)\s+.*$"
RESULT_WORDS = r"(?i)\b(?:improv(?:e|es|ed|ing)|outperform|state[- ]of[- ]the[- ]art|benchmark|accuracy|performance|result|limitation|addresses?|enables? strong|achieves?)\b|性能|结果|提升|优于|局限"
MECHANISM_WORDS = r"(?i)\b(?:retrieve|select|rank|encode|condition|marginali[sz]|generate|decode|attend|update|optimi[sz]|combine|fuse|route|sample|predict|train)[A-Za-z0-9_]*\b|检索|选择|排序|编码|条件|边缘化|生成|解码|更新|优化|融合|训练"
LEADS = (r"(?i)^(?:the paper|this paper|the authors|we)\s+(?:introduces?|proposes?|presents?|develops?|shows?)\s+", r"(?i)^(?:and|which|while|whereas|then|thereby)\s+")
CONNECTOR = r"(?i)\b(?:and|or|with|without|that|which|to|for|from|into|by|through|then|thereby|yielding|enabling|generates?|executes?|uses?|applies?|feeds?|updates?|refines?|produces?|retrieves?|selects?|encodes?|decodes?)$"
PHRASE_LEAST, PHRASE_MOST, CLAUSE_SHARE = 12, 180, 0.55
SIMILAR = 0.68


def finished(c: Column) -> Column:
    """A point without what trails, closed by a stop of its script."""
    x = strip(F.regexp_replace(text_of(c), r"[\s,，;；:：-]+$", ""))
    stop = F.when(x.rlike(r"[\x{3400}-\x{9fff}]"), F.lit("。")).otherwise(F.lit("."))
    return F.when((x == "") | x.rlike(r"[.!?。！？]$"), x).otherwise(F.concat(x, stop))


def points(c: Column, most: Column | int = 3, budget: Column | int = 520) -> Column:
    """Whole sentences, each once, until there are enough or the budget of characters is used up; the last may pass it."""
    most, budget = (F.lit(v) if isinstance(v, int) else v for v in (most, budget))
    each = F.transform(first_by_key(export_sentences(c), lambda s: F.lower(s)), finished)
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["kept"]) >= most) | ((F.size(s["kept"]) > 0) & (s["used"] >= budget))
        return F.when(full, s).otherwise(F.struct((s["used"] + F.length(p)).alias("used"), F.array_append(s["kept"], p).alias("kept")))

    return F.aggregate(each, start, step)["kept"]


def joined(*fields: Column) -> Column:
    """Fields one after the other, without those that are empty or say the same in letters and digits."""
    listed = F.transform(F.array(*[text_of(f) for f in fields]), collapse)
    key = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    return F.array_join(first_by_key(F.filter(listed, lambda x: key(x) != ""), key), " ")


def panel_points(panel: Column, c: Column) -> Column:
    """A panel's text as points within its budget."""
    of = lambda i: F.coalesce(*[F.when(panel == p, F.lit(b[i])) for p, b in PANEL_BUDGETS.items()], F.lit((3, 520)[i]))
    return points(c, of(0), of(1))


def similarity(a: Column, b: Column) -> Column:
    """Tokens of three characters or more that two texts share, over the smaller number of them."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(collapse(c)), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}-]{2,}"), F.lit(0)))
    share = lambda w: F.size(F.array_intersect(w["a"], w["b"])) / F.least(F.size(w["a"]), F.size(w["b"]))
    return bound(F.struct(words(a).alias("a"), words(b).alias("b")), lambda w: F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0), 0.0).otherwise(share(w)))


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(collapse(c)), r"[^\p{L}\p{N}]+", "")


def _unled(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, LEADS[0], ""), LEADS[1], ""))


def whole_clause(c: Column, limit: int) -> Column:
    """A text within a limit, or what stands before its last comma, semicolon or colon there; empty if that is little or breaks off."""
    x = collapse(c)
    head = F.regexp_extract(F.substring(x, 1, limit + 1), r"(?s)^(.*)[,;:]\s+", 1)
    fits = (F.length(head) >= limit * CLAUSE_SHARE) & ~strip(head).rlike(CONNECTOR)
    return F.when(F.length(x) <= limit, x).when(fits, strip(head)).otherwise(F.lit(""))


def phrases(c: Column) -> Column:
    """Clauses of some length that don't end on a connecting word: by stops, or where a sentence turns if there are few."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(collapse(c), r"(?i)e\.g\.", "e\u0001g\u0001"), r"(?i)i\.e\.", "i\u0001e\u0001"), r"(\d)\.(\d)", "$1\u0001$2")
    by_stop = F.split(x, r"[.;:]\s*")
    parts = F.when(F.size(by_stop) >= 3, by_stop).otherwise(F.split(x, PHRASE_TURNS))
    clean = F.transform(parts, lambda p: _unled(collapse(F.replace(p, F.lit("\u0001"), F.lit(".")))))
    cut = F.transform(F.filter(clean, lambda p: F.length(p) >= PHRASE_LEAST), lambda p: whole_clause(p, PHRASE_MOST))
    return F.filter(cut, lambda p: (p != "") & ~p.rlike(CONNECTOR))


def _distinct(items: Column) -> Column:
    return first_by_key(F.filter(items, lambda p: _key(p) != ""), _key)


def key_ideas(theory: Column, method: Column) -> Column:
    """array of up to five phrases, the first in the centre; null with fewer than three, or if both texts say the same."""
    own = _distinct(phrases(theory))
    all_of = bound(own, lambda p: F.slice(F.when(F.size(p) >= 3, p).otherwise(_distinct(F.concat(p, phrases(method)))), 1, 5))
    same = (collapse(theory) != "") & (collapse(method) != "") & (similarity(theory, method) >= SIMILAR)
    return bound(all_of, lambda p: F.when(~same & (F.size(p) >= 3), p))


def method_flow(method: Column) -> Column:
    """Up to five steps; null with fewer than three."""
    return bound(F.slice(_distinct(phrases(method)), 1, 5), lambda p: F.when(F.size(p) >= 3, p))


def mechanism_flow(theory: Column, method: Column) -> Column:
    """Up to four steps that tell what is done, and no results; null with fewer than three."""
    told = F.filter(_distinct(F.concat(phrases(method), phrases(theory))), lambda p: p.rlike(MECHANISM_WORDS) & ~p.rlike(RESULT_WORDS))
    bare = F.transform(told, lambda p: strip(F.regexp_replace(F.regexp_replace(_unled(collapse(p)), PHRASE_LEADS, ""), PHRASE_AIMS, "")))
    short = F.filter(F.transform(bare, lambda p: whole_clause(p, 120)), lambda p: p != "")
    return bound(F.slice(short, 1, 4), lambda p: F.when(F.size(p) >= 3, p))

"""Pages of a paper, quotes that can stand as evidence, and where in the paper they come from. All within a row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import bound, first_by_key
from .text import collapse, export_sentences, page_of, similarity_tokens, strict_key, stretches, strip, text_of, tokens

# Page marks, what leaks into quotes from page headers, fragments that aren't evidence, and sections that ran together.
PAGE_MARK = r"(?im)^##\s*Page\s+(\d+)\s*$"
HEADERS = (
    r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/10\.\d{4,9}/[A-Za-z0-9_.()/:;-]+\s*",
    r"(?i)^org/10\.\d{4,9}/[A-Za-z0-9_.()/:;-]+\s*",
    r"(?i)^(?:arxiv:\S+\s*)?(?:\[[^\]]{1,12}\]|[A-Za-z.]{1,8}\])\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s*",
)
FRAGMENTS = (r"^(?:[A-Za-z][A-Za-z0-9_-]{0,12}|\d{1,3})[.)]$", r"(?i)^(?:test cases?|results?|methods?|figures?|tables?)\.?$")
MERGED = r"(?i)[a-z0-9,)]\s+(?:In recent years|Recently,|Abstract\b|Introduction\b|Related Work\b|Methodology\b|Experiments?\b)\s+(?:In |We |The |Recent)"
BROKEN_WORD = r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|\d+)\s+(?:tion|ment|ness|ity)\b"
GENERIC_LOCATION = r"(?i)^(?:task-relevant retrieved source|retrieved source|paper context)$"
CAPTION = r"(?i)^(?:figure|fig\.|table)\s*\d+"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which SQL lacks; texts of ASCII alone are left as they are."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def evidence_key(c: Column) -> Column:
    """The form in which quotes are compared with their source."""
    return strict_key(nfkc(c))


def pages(c: Column) -> Column:
    """array<struct<page, text>>: what follows each page mark; one page without a number if there is none."""

    def cut(both: Column) -> Column:
        marked = F.transform(both["numbers"], lambda n, i: F.struct(n.try_cast("int").alias("page"), F.get(both["parts"], i + 1).alias("text")))
        return F.when(F.size(both["numbers"]) > 0, marked).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("page"), F.get(both["parts"], F.lit(0)).alias("text"))))

    # a text is searched once, whatever its number of pages; without a mark there is one part
    found = lambda x: F.struct(F.regexp_extract_all(x, F.lit(PAGE_MARK), F.lit(1)).alias("numbers"), F.split(x, PAGE_MARK).alias("parts"))
    return bound(bound(F.replace(text_of(c), F.lit("\r"), F.lit("")), found), cut)


def clean_quote(c: Column) -> Column:
    """A quote without the page headers that run into it."""
    x = collapse(c)
    for pattern in HEADERS:
        x = F.regexp_replace(x, pattern, "")
    return strip(x)


def usable_quote(c: Column) -> Column:
    x = strip(text_of(c))
    bad = F.lit(False)
    for pattern in (*FRAGMENTS, MERGED):
        bad = bad | x.rlike(pattern)
    return (x != "") & ~bad


def viewer_item(quote: Column, location: Column) -> Column:
    """struct<quote, location, page> of evidence fit to be shown, else null: three words and 22 characters at least."""
    x, at = clean_quote(F.substring(collapse(quote), 1, 1800)), F.coalesce(F.nullif(F.substring(collapse(location), 1, 300), F.lit("")), F.lit("Paper context"))
    n_words = F.regexp_count(x, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'-]*"))
    bad = x.rlike(FRAGMENTS[0]) | x.rlike(MERGED) | ((x != "") & ((F.length(x) < 22) | (n_words < 3))) | x.rlike(BROKEN_WORD)
    return F.when(~bad, F.struct(x.alias("quote"), at.alias("location"), page_of(at).alias("page")))


def section_items(items: Column, most: int = 4) -> Column:
    """The first distinct items (quote, location) of some lists that can be shown."""
    shown = F.filter(F.transform(items, lambda i: viewer_item(i["quote"], i["location"])), lambda v: v.isNotNull())
    return F.slice(first_by_key(shown, lambda v: F.lower(F.concat_ws("|", v["quote"], v["location"]))), 1, most)


def _asked_for(s: Column, asked: Column) -> Column:
    """Whether a sentence may share two tokens with one of some queries: its tokens stand in its lower-case text as they are."""
    return bound(F.lower(s), lambda low: F.exists(asked, lambda wanted: F.size(F.filter(wanted, lambda t: F.contains(low, t))) >= 2))


def source_sentences(c: Column, asked: Column | None = None) -> Column:
    """array<struct<page, quote>>: sentences of 36 to 700 characters that can be linked to, without headings, captions and references.

    With the tokens of some queries (array<array<string>>), only sentences that can be an excerpt for one of them; that is looked at first.
    """

    def of(page: Column) -> Column:
        x = collapse(F.regexp_replace(page["text"], r"(?m)^#{1,6}\s+.*$", " "))
        found = F.transform(stretches(x), strip)
        near = lambda s: F.length(s).between(36, 700) if asked is None else F.length(s).between(36, 700) & _asked_for(s, asked)
        kept = F.filter(found, lambda s: near(s) & ~s.rlike(MERGED) & ~s.rlike(CAPTION) & ~s.rlike(r"(?i)\b(?:references|bibliography)\b"))
        return F.transform(kept, lambda s: F.struct(page["page"].alias("page"), s.alias("quote")))

    return F.flatten(F.transform(pages(c), of))


def section_query(primary: Column, fields: Column) -> Column:
    """What a section is about: the first two sentences of its main field, or all fields if that is short."""
    x = collapse(primary)
    found = stretches(x)
    core = strip(F.array_join(F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(x)), 1, 2), " "))
    return F.substring(F.when(F.length(core) >= 80, core).otherwise(F.array_join(F.transform(fields, text_of), " ")), 1, 900)


def with_tokens(sentences: Column) -> Column:
    """array<struct<page, quote, key, tokens>> of sentences (page, quote): what every query compares, made once."""
    return F.transform(sentences, lambda s: bound(strict_key(s["quote"]), lambda k: F.struct(s["page"].alias("page"), s["quote"].alias("quote"), k.alias("key"), tokens(k).alias("tokens"))))


def excerpts(sentences: Column, wanted: Column, limit: int = 3) -> Column:
    """array<struct<score, quote, page>>: the sentences (of with_tokens) that share most tokens of weight with a query's, each text once.

    Three points a shared token, and two if a long one of the query occurs; two tokens and six points are asked for.
    """

    def ranked(mine: Column) -> Column:
        long = F.filter(mine, lambda t: F.length(t) >= 8)

        def judged(s: Column, i: Column) -> Column:
            def points(shared: Column) -> Column:
                score = 3 * shared + F.when(F.exists(long, lambda t: F.contains(s["key"], t)), 2).otherwise(0)
                return F.when((shared >= 2) & (score >= 6), F.struct((-score).alias("low"), F.length(s["quote"]).alias("n"), i.alias("i"), s["key"].alias("key"), s.alias("s")))

            return bound(F.size(F.array_intersect(mine, s["tokens"])), points)

        return F.array_sort(F.filter(F.transform(sentences, judged), lambda x: x.isNotNull()))

    return F.transform(F.slice(first_by_key(bound(wanted, ranked), lambda x: x["key"]), 1, limit), lambda x: F.struct((-x["low"]).alias("score"), x["s"]["quote"].alias("quote"), x["s"]["page"].alias("page")))


def _alike(a: Column, b: Column) -> Column:
    """Length of the common prefix, up to 127."""
    same = lambda n: (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)) & (n <= F.least(F.length(a), F.length(b)))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(6, -1, -1)]), F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))


def find_sentence(quote_key: Column, sentences: Column) -> Column:
    """struct<page, sentence> of the sentence (page, sentence, key, tokens) that a quote comes from, or null.

    One that holds the quote, or stands at its beginning, with the least difference in length; else the one most alike: eight
    shared tokens, and 58 % of the smaller set or a common beginning of 64 characters. The second is looked for only without the first.
    """
    # sentences that are made here are bound, as each use of them within a function of another takes the analyzer rounds of its own, of which it has 100
    return bound(sentences, lambda s: _sentence_of(quote_key, s))


def _sentence_of(quote_key: Column, sentences: Column) -> Column:
    holds = lambda s: F.contains(s["key"], quote_key) | F.instr(quote_key, s["key"]).between(1, 33)
    exact = F.array_min(F.transform(sentences, lambda s, i: F.when(holds(s), F.struct(F.abs(F.length(s["key"]) - F.length(quote_key)).alias("off"), i.alias("i")))))

    def alike(mine: Column) -> Column:
        sharing = F.filter(F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(s["tokens"], mine)).alias("shared"), i.alias("i"))), lambda x: x["shared"] >= 8)

        def judged(x: Column) -> Column:
            s = F.get(sentences, x["i"])
            cover = x["shared"] / F.greatest(F.lit(1), F.least(F.size(s["tokens"]), F.size(mine)))
            of = lambda p: F.when((cover >= 0.58) | (p >= 64), F.struct((-(cover * 100 + F.least(F.lit(20.0), p / 6))).alias("low"), (-x["shared"]).alias("few"), x["i"].alias("i")))
            return bound(_alike(s["key"], quote_key), of)

        return F.array_min(F.transform(sharing, judged))["i"]

    place = bound(exact, lambda e: F.when(e.isNotNull(), e["i"]).otherwise(bound(similarity_tokens(quote_key), alike)))
    return F.when(F.length(quote_key) >= 8, bound(place, lambda i: F.when(i.isNotNull(), F.struct(F.get(sentences, i)["page"].alias("page"), F.get(sentences, i)["sentence"].alias("sentence")))))


def keyed_sentences(c: Column) -> Column:
    """array<struct<page, sentence, key, tokens>> of a paged text."""
    made = lambda p, s: bound(strict_key(s), lambda k: F.struct(p["page"].alias("page"), s.alias("sentence"), k.alias("key"), similarity_tokens(k).alias("tokens")))
    return F.filter(F.flatten(F.transform(pages(c), lambda p: F.transform(export_sentences(p["text"]), lambda s: made(p, s)))), lambda s: s["key"] != "")


def located(quote: Column, location: Column, found: Column) -> Column:
    """struct<quote, location> of a quote and the sentence found for it; null if it can't stand as evidence."""
    raw = F.coalesce(F.nullif(collapse(location), F.lit("")), F.lit("paper context"))
    page = found["page"].cast("string")
    at = F.when(page.isNull(), raw).when(raw.rlike(GENERIC_LOCATION), F.concat(F.lit("Uploaded PDF, page "), page)).when(page_of(raw).isNotNull(), raw).otherwise(F.concat(raw, F.lit(", page "), page))
    x = strip(F.coalesce(found["sentence"], quote))
    return F.when(usable_quote(quote) & ~x.rlike(MERGED), F.struct(F.substring(x, 1, 520).alias("quote"), F.substring(at, 1, 160).alias("location")))

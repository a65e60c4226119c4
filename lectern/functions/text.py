"""Scalar text functions: Column -> Column, all but one hash inside code generation."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import bound

SPACES = r"[\s\x{00A0}\x{FEFF}]+"
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
# Words without weight in token overlap, and the id and link forms that are recognised.
STOP_WORDS = ["the", "and", "with", "from", "this", "that", "which", "into", "using", "figure", "table"]
ARXIV = r"((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)"
ARXIV_NAME = rf"(?i)(?:^|[^A-Za-z0-9_]){ARXIV}(?:[^A-Za-z0-9_]|$)"
ARXIV_TEXT = rf"(?i)arxiv\s*(?::|\.org/(?:abs|pdf)/)?\s*{ARXIV}"
ARXIV_BACK = rf"(?i)arxiv\s*:\s*{ARXIV}"
ARXIV_URL = r"(?i)^https?://(?:www\.)?arxiv\.org/(?:abs|pdf|e-print)/"
DOI = r"(?i)(?:https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[A-Z0-9][A-Z0-9._;()/:+-]*)"
PLACEHOLDER_DOI = r"(?:^|[._/()-])(?:n{4,}|x{4,}|tbd|todo|placeholder)(?:$|[._/()-])|n{6,}|x{6,}"
SECRET = r"sk-[A-Za-z0-9_-]+"
_STOP = "\ue000"
_STOPS = ".!?。！？"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text_of(c), SPACES, " "))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.trim(c, F.lit(BLANKS))


def bounded(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def paper_text(c: Column) -> Column:
    """Paper normalisation: no carriage returns, single blanks, two empty lines at most."""
    x = F.replace(text_of(c), F.lit("\r"), F.lit(""))
    x = F.regexp_replace(x, "[ \t]{2,}|\t", " ")
    return F.trim(F.regexp_replace(x, "\n{4,}", "\n\n\n"))


def match_key(c: Column) -> Column:
    """Lower-case letters, digits and % . _ with single spaces: the form in which scores compare texts."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}%._]+", " "))


def strict_key(c: Column) -> Column:
    """Lower-case letters and digits only, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), r"[^\p{L}\p{N}]+", " "))


def quote_variants(c: Column) -> Column:
    """Keys of a quote with and without hyphens at line ends."""
    joined = F.regexp_replace(text_of(c), r"([\p{L}\p{N}])-\s+([\p{Ll}\p{N}])", "$1$2")
    return F.array_distinct(F.array(strict_key(c), strict_key(joined)))


def tokens(c: Column, least: int = 4) -> Column:
    """Distinct tokens of weight."""
    return F.array_distinct(F.filter(F.split(strict_key(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS)))


def similarity_tokens(key: Column) -> Column:
    """Distinct ASCII tokens of two characters or more of a key."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit("[a-z0-9]{2,}"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set."""
    x, y = tokens(a, 1), tokens(b, 1)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))


def _held(c: Column, export: bool) -> Column:
    """With the stops of decimals and common abbreviations set aside.

    A text is searched for an abbreviation only if it has a mark of it, and what stands before one is looked at last.
    """
    held = [(r"(\d)\.(\d)", f"$1{_STOP}$2", ""), (r"(?i)(e)\.(?<![A-Za-z0-9_]e\.)\s*(g)\.", f"$1{_STOP}$2{_STOP}", "g."), (r"(?i)(i)\.(?<![A-Za-z0-9_]i\.)\s*(e)\.", f"$1{_STOP}$2{_STOP}", "i."), (r"(?i)(et)(?<![A-Za-z0-9_]et)\s+(al)\.", f"$1 $2{_STOP}", "al.")]
    if export:
        held += [(r"(?i)(v)\.(?<![A-Za-z0-9_]v\.)\s*(s)\.", f"$1{_STOP}$2{_STOP}", "v."), (r"(?i)vs\.(?<![A-Za-z0-9_]vs\.)", f"vs{_STOP}", "vs."), (r"(?i)w\.r\.t\.(?<![A-Za-z0-9_]w\.r\.t\.)", f"w{_STOP}r{_STOP}t{_STOP}", "w.r.t.")]
    cases = lambda m: dict.fromkeys(map("".join, product(*((x, x.upper()) for x in m))))
    has = lambda x, m: reduce(lambda a, b: a | b, [F.contains(x, F.lit(v)) for v in cases(m)])

    def replaced(x: Column, rule: tuple[str, str, str]) -> Column:
        pattern, new, mark = rule
        return F.regexp_replace(x, pattern, new) if not mark else bound(x, lambda y: F.when(has(y, mark), F.regexp_replace(y, pattern, new)).otherwise(y))

    return reduce(replaced, held, text_of(c))


def _freed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(_STOP), F.lit(".")))), lambda s: s != "")


def stretches(c: Column) -> Column:
    """array<string>: what stands before each stop, with it, and what follows the last; a stop with nothing before it is left out.

    A class of stops is looked for at each place: Java takes some six times as long to match `[^.!?。！？]+`, a negated class with signs beyond Latin-1.
    """
    return F.regexp_extract_all(c, F.lit(rf"(?s)[^{_STOPS}].*?(?:[{_STOPS}]|\z)"), F.lit(0))


def _ended(x: Column) -> Column:
    """What ends with a stop each, or the text itself if it is of stops only."""
    found = lambda y: bound(F.regexp_extract_all(y, F.lit("[^.!?。！？]+[.!?。！？]?"), F.lit(0)), lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(y)))
    return bound(x, found)


def sentences(c: Column) -> Column:
    """Sentences, line by line, with decimals and common abbreviations kept whole; a line of stops only stays."""
    per_line = F.transform(F.filter(F.transform(F.split(text_of(c), "\n+"), strip), lambda x: x != ""), lambda x: _ended(_held(x, False)))
    return _freed(F.flatten(per_line))


def export_sentences(c: Column) -> Column:
    """Sentences of a text as one paragraph, with v.s., vs. and w.r.t. kept whole as well."""
    return _freed(_ended(_held(collapse(c), True)))


def fallback_sentences(c: Column) -> Column:
    """Sentences that end before white space or a line's end; stops within words don't count."""
    # white space is asked for first, so that few places are looked at backwards
    return _freed(F.split(_held(F.replace(text_of(c), F.lit("\r"), F.lit("")), False), r"(?=\s)(?:(?<=[。！？.!?])\s+|\n+)"))


def numbers(c: Column) -> Column:
    """Number tokens; a percent sign belongs to its number."""
    return F.regexp_extract_all(text_of(c), F.lit(r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?%?"), F.lit(0))


def formula_key(c: Column) -> Column:
    x = F.regexp_replace(text_of(c), r"\\(?:begin|end)\{[^}]*\}|\$\$|\\\[|\\\]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\\mathrm\{([^}]*)\}", "$1"), r"\s+", ""))


#: UTF-16 units that are hashed at once, texts from which on they go unit by unit together, and units of a single text that are a list at a time.
_UNITS, _TOGETHER, _LISTED = 4_000_000, 48, 1_000_000


def _fnv1a(texts: list[np.ndarray]) -> np.ndarray:
    """32-bit FNV-1a of arrays of units, longest first: a unit of all of them at a time, and the last few one by one."""
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    flat, starts, size = np.concatenate([texts[i] for i in order]).astype(np.uint32), np.r_[0, np.cumsum(size[order])[:-1]], size[order]
    h, prime, at = np.full(len(texts), 2166136261, np.uint32), np.uint32(16777619), 0
    n = len(texts)
    while True:
        n = int(np.searchsorted(-size[:n], -at, "left"))  # texts that go on
        if n < _TOGETHER:
            break
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * prime
        at += 1
    for i in range(n):
        x, end = int(h[i]), starts[i] + size[i]
        for part in range(starts[i] + at, end, _LISTED):
            for u in flat[part : min(part + _LISTED, end)].tolist():
                x = ((x ^ u) * 16777619) & 0xFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def _fnv1a_of(most: int | None):
    @F.pandas_udf(StringType())
    def hashed(texts: pd.Series) -> pd.Series:
        out, held, n = [], [], 0

        def told() -> list[str]:
            return [f"{h:08x}:{len(t)}" for h, t in zip(_fnv1a(held).tolist(), held)]

        for t in texts:
            held.append(np.frombuffer(t.encode("utf-16-be"), ">u2")[:most])
            n += len(held[-1])
            if n >= _UNITS:
                out, held, n = out + told(), [], 0
        return pd.Series(out + told() if held else out, dtype=object)

    return hashed


def fnv1a(c: Column, most: int | None = None) -> Column:
    """32-bit FNV-1a of the collapsed text's UTF-16 units (the first `most`, if given), with their number. An Arrow function, as each step needs the one before."""
    x = collapse(c)
    return _fnv1a_of(most)(x if most is None else F.substring(x, 1, most))


def arxiv_id(file_name: Column, text: Column) -> Column:
    """From the file name, else from what the text says, else from the text backwards, as a rotated mark is read; null without any."""
    first = lambda c, p: F.nullif(F.regexp_extract(text_of(c), p, 1), F.lit(""))
    return F.coalesce(first(file_name, ARXIV_NAME), first(text, ARXIV_TEXT), first(F.reverse(text_of(text)), ARXIV_BACK))


def parsed_arxiv_id(c: Column) -> Column:
    """The id that a value or a URL is; empty if it is none."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(text_of(c)), ARXIV_URL, ""), r"(?i)\.pdf$", ""), r"(?s)[?#].*$", ""))
    return F.when(x.rlike(f"(?i)^{ARXIV}$"), x).otherwise("")


def doi(c: Column) -> Column:
    """The first DOI, in lower case, without what closes a sentence; null for none or a placeholder."""
    x = F.lower(F.regexp_replace(F.regexp_extract(text_of(c), DOI, 1), r"[.,;:)}\]]+$", ""))
    suffix = F.regexp_extract(x, r"^[^/]*/(.*)$", 1)
    return F.when((suffix != "") & ~suffix.rlike(PLACEHOLDER_DOI), x)


def academic_key(c: Column) -> Column:
    """A title's letters and digits, which two sources of one paper have in common."""
    return F.regexp_replace(F.lower(unescape_xml(c)), r"[^\p{L}\p{N}]+", "")


def reliable_title(c: Column) -> Column:
    x = strip(text_of(c))
    return (F.length(x) >= 5) & ~x.rlike(r"(?i)^(?:untitled|arxiv:.*(?:source)?|main source file|page\s+\d+)")


def wide_formula(c: Column) -> Column:
    """Whether a formula takes a line of its own."""
    x = collapse(c)
    return (F.length(x) >= 82) | x.rlike(r"\\begin\{(?:align|gather|multline|eqnarray)\*?\}") | x.rlike(r"\\\\")


def titles_agree(a: Column, b: Column, ratio: float = 0.88) -> Column:
    """Equal, or one within the other at nearly its length; an unknown title agrees with any."""
    x, y = strict_key(a), strict_key(b)
    longer, shorter = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
    return (x == "") | (y == "") | (F.contains(longer, shorter) & (F.length(shorter) >= ratio * F.length(longer)))


def title_of(c: Column) -> Column:
    """The first Markdown heading, else the first line of 9 to 119 characters."""
    lines = F.transform(F.split(text_of(c), "\n"), lambda x: F.trim(x))
    plain = F.get(F.filter(lines, lambda x: (F.length(x) > 8) & (F.length(x) < 120)), F.lit(0))
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text_of(c), r"(?m)^#\s+(.+)$", 1)), F.lit("")), plain, F.lit("Untitled paper"))


def redacted(c: Column, most: int = 240) -> Column:
    return F.substring(F.regexp_replace(text_of(c), SECRET, "[redacted]"), 1, most)


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")], text_of(c))


def unescape_xml(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")], text_of(c))


def archive_path(c: Column) -> Column:
    """Forward slashes, without empty, . and .. parts."""
    return F.array_join(F.filter(F.split(F.replace(text_of(c), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def token_estimate(reported: Column, c: Column) -> Column:
    return F.coalesce(reported, F.ceil(F.length(text_of(c)) / 4))


def page_of(location: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(location), r"(?i)(?:page|p\.?)[\s:#-]*(\d+)", 1), F.lit("")).try_cast("int")


def terminated(c: Column) -> Column:
    """With a full stop of the text's script, unless it ends with a mark."""
    x = collapse(c)
    stop = F.when(x.rlike(r"[\x{3400}-\x{9fff}]"), F.lit("。")).otherwise(F.lit("."))
    return F.when((x == "") | x.rlike(r"[.!?。！？]$"), x).otherwise(F.concat(x, stop))


def strip_tex_comments(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?m)(^|[^\\])%.*$", "$1")


# What LaTeX commands become in a line and in running text, in this order, and the environments that running text leaves out.
TEX_FLOATS = r"(?:equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|figure\*?|table\*?|tabular\*?)"
TEX_INLINE = [(r"\\cite[tpa]?\{[^}]*\}|\\label\{[^}]*\}", ""), (r"\\ref\{([^}]*)\}", "$1"), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1"), (r"[{}]", "")]
TEX_PLAIN = [
    (rf"(?s)\\begin\{{{TEX_FLOATS}\}}.*?\\end\{{{TEX_FLOATS}\}}", "\n"),
    (r"\\(?:section|subsection|subsubsection)\*?\{([^}]*)\}", "\n## $1\n"),
    (r"\\(?:title|author|date)\{([^}]*)\}", "\n$1\n"),
    (r"\\begin\{abstract\}", "\n## Abstract\n"),
    (r"\\end\{abstract\}|\\(?:input|include)\{[^}]+\}", "\n"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{([^{}]*)\})?", "$1"),
    (r"[{}]", ""),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]


def _replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def tex_inline(c: Column) -> Column:
    """Plain words of a line of LaTeX."""
    return collapse(_replaced(text_of(c), TEX_INLINE))


def tex_plain(c: Column, most: int = 30_000) -> Column:
    """Running text of a LaTeX document's body: headings as Markdown, floats and display math left out."""
    body = F.nullif(F.get(F.split(text_of(c), r"\\begin\{document\}"), F.lit(1)), F.lit(""))
    return F.substring(strip(_replaced(F.coalesce(body, text_of(c)), TEX_PLAIN)), 1, most)


def lenient_json(c: Column, schema: str) -> Column:
    """A JSON object, also inside a code fence or other text; null where there's none."""
    x = F.regexp_replace(text_of(c), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(parsed(x), parsed(F.regexp_extract(x, r"(?s)\{.*\}", 0)))

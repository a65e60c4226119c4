"""What LaTeX sources hold: main file, includes, macros, formulas, figures and tables.

Balanced braces, macros and includes aren't regular; those parts run as Arrow functions over rows of one
paper each, and a paper is one row, so nothing is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_by_key
from ..functions.predicates import plausible_formula
from ..functions.text import archive_path, strip_tex_comments


def group_at(text: str, start: int) -> tuple[str, int] | None:
    """The content of the brace group that opens at start, and where it ends."""
    if start >= len(text) or text[start] != "{":
        return None
    depth = 0
    for i in range(start, len(text)):
        if text[i] in "{}" and (i == 0 or text[i - 1] != "\\"):
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return text[start + 1 : i], i + 1
    return None


def command_argument(text: str, command: str) -> str | None:
    """The balanced argument of the first use of a command."""
    m = re.search(r"\\" + command + r"\*?(?:\[[^\]]*\])?\s*(?=\{)", text)
    found = group_at(text, m.end()) if m else None
    return found[0] if found else None


def macros(text: str) -> dict[str, tuple[int, str]]:
    """Commands that a text defines: how many arguments they take, and what they stand for."""
    out = {}
    for m in re.finditer(r"\\(?:(?:re)?newcommand|providecommand)\*?\s*\{?\\([A-Za-z]+)\}?\s*(?:\[(\d)\])?\s*(?=\{)|\\def\s*\\([A-Za-z]+)\s*((?:#\d)*)\s*(?=\{)", text):
        if body := group_at(text, m.end()):
            out[m[1] or m[3]] = (int(m[2] or 0) if m[1] else len(m[4]) // 2, body[0])
    return out


def expand(text: str, known: dict[str, tuple[int, str]], passes: int = 5) -> str:
    for _ in range(passes):
        new, at = [], 0
        for m in re.finditer(r"\\([A-Za-z]+)(?![A-Za-z])", text):
            if m.start() < at or m[1] not in known:
                continue
            n, body = known[m[1]]
            args, end = [], m.end()
            while len(args) < n and (g := group_at(text, end)):
                args.append(g[0])
                end = g[1]
            if len(args) < n:
                continue
            for i, a in enumerate(args):
                body = body.replace(f"#{i + 1}", a)
            new += [text[at : m.start()], body]
            at = end
        if not new:
            break
        text = "".join(new) + text[at:]
    return text


def include_all(main: str, files: dict[str, str], depth: int = 4, seen: set[str] | None = None) -> str:
    """The main text with each included file put in, once."""
    seen = set() if seen is None else seen

    def put(m: re.Match) -> str:
        name = m[1].strip()
        path = next((p for p in (name, f"{name}.tex", name.rsplit("/", 1)[-1], name.rsplit("/", 1)[-1] + ".tex") if p in files), None)
        if depth == 0 or path is None or path in seen:
            return ""
        seen.add(path)
        return include_all(files[path], files, depth - 1, seen)

    return re.sub(r"\\(?:input|include)\{([^}]+)\}", put, main)


def table_rows(body: str, max_rows: int = 20, max_cols: int = 24) -> list[list[str]]:
    """Cells of a tabular, spans repeated as empty cells, all rows equally long."""
    rows = []
    for line in re.split(r"\\\\(?:\[[^\]]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", body)):
        cells = []
        for cell in re.split(r"(?<!\\)&", line):
            m = re.search(r"\\multicolumn\{(\d+)\}\{[^}]*\}\s*(?=\{)", cell)
            span, text = (int(m[1]), (group_at(cell, m.end()) or ("", 0))[0]) if m else (1, cell)
            text = re.sub(r"\s+", " ", re.sub(r"\\[A-Za-z]+\*?|[{}$]", " ", text)).strip()
            cells += [text] + [""] * (span - 1)
        if any(cells):
            rows.append(cells[:max_cols])
    rows = rows[:max_rows]
    width = max((len(r) for r in rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def main_file(files: DataFrame) -> DataFrame:
    """The file of each paper that most looks like the main one; ties go to the first."""
    c = F.coalesce(F.col("content"), F.lit(""))
    score = F.when(c.rlike(r"\\documentclass"), 8.0).otherwise(0) + F.when(c.rlike(r"\\begin\{document\}"), 8.0).otherwise(0) + F.when(c.rlike(r"\\title"), 3.0).otherwise(0) + F.when(F.lower("path").rlike("main|paper"), 3.0).otherwise(0) + F.least(F.length(c) / 10_000, F.lit(5.0))
    tex = files.filter(F.lower("path").endswith(".tex"))
    return tex.groupBy("paper_id").agg(F.max_by(F.struct("path", "content"), F.struct(score, -F.col("seq"))).alias("m")).select("paper_id", "m.path", "m.content")


def combined(files: DataFrame) -> DataFrame:
    """paper_id, tex: the main file with its includes and without comments. One paper is one group."""
    cleaned = files.withColumn("path", archive_path(F.col("path"))).withColumn("content", strip_tex_comments(F.col("content")))
    other = cleaned.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"paper_id": pdf.paper_id, "tex": [include_all(c, dict(f), seen={p}) for c, f, p in zip(pdf.content, pdf.files, pdf.path, strict=True)]})

    return main_file(cleaned).join(other, "paper_id").mapInPandas(run, "paper_id string, tex string")


def formulas(tex: DataFrame, most: int = 12) -> DataFrame:
    """paper_id, ord, formula: the first plausible display formulas of each paper, macros expanded, each once."""

    def of(text: str) -> list[str]:
        known = macros(text)
        found = re.finditer(r"(?s)\\begin\{(equation|align|gather|multline|eqnarray)\*?\}(.*?)\\end\{\1\*?\}|\\\[(.*?)\\\]|\$\$(.*?)\$\$", text)
        return [re.sub(r"\s+", " ", re.sub(r"\\(?:label|tag)\{[^}]*\}|\\nonumber", "", expand(m[2] or m[3] or m[4] or "", known))).strip() for m in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"paper_id": pdf.paper_id, "found": [of(t) for t in pdf.tex]})

    found = tex.mapInPandas(run, "paper_id string, found array<string>")
    kept = F.slice(first_by_key(F.filter("found", plausible_formula), lambda x: F.regexp_replace(x, r"\s+", "")), 1, most)
    return found.select("paper_id", F.posexplode(kept).alias("ord", "formula")).select("paper_id", (F.col("ord") + 1).alias("ord"), "formula")


# ------------------------------------------------------------------ titles


def _without(text: str, command: str) -> str:
    """A text without the uses of a command and their arguments."""
    while m := re.search(r"\\" + command + r"\s*(?=\{)", text):
        if (g := group_at(text, m.end())) is None:
            break
        text = text[: m.start()] + text[g[1] :]
    return text


def _plain_title(text: str) -> str:
    for _ in range(4):
        text = re.sub(r"\\(?:textbf|textit|emph|textrm|textsf|texttt|mbox)\s*\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " ", re.sub(r"\\([&%#_$])", r"\1", text.replace("\\\\", " ")))
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", text)).strip()


def titles(tex: DataFrame) -> DataFrame:
    """paper_id, title, lines: the title without notes and commands, and its lines if it is broken into several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [_without(command_argument(t, "title") or "", "thanks") for t in pdf.tex]
            lines = [[x for x in map(_plain_title, r.split("\\\\")) if x] if "\\\\" in r else [] for r in raw]
            yield pd.DataFrame({"paper_id": pdf.paper_id, "title": [_plain_title(r) for r in raw], "lines": lines})

    return tex.mapInPandas(run, "paper_id string, title string, lines array<string>")


UNSAFE = r"(?im)^.*\\(?:write18|openout|immediate|input\s*\|).*$"


def renderable_table(c: Column) -> Column:
    """The tabular environment of a table's source, or the empty string."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\\begin\{tabular[*x]?\}.*?\\end\{tabular[*x]?\}", 0)


def safe_preamble(c: Column) -> Column:
    """What stands before the document, without commands that reach outside."""
    head = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^(.*?)\\begin\{document\}", 1)
    return F.trim(F.regexp_replace(head, UNSAFE, ""))


def _environments(name: str, body: str) -> Iterator[str]:
    for m in re.finditer(r"(?s)\\begin\{(" + name + r")\*?\}(.*?)\\end\{\1\*?\}", body):
        yield m[2]


def figures(tex: DataFrame, most: int = 12) -> DataFrame:
    """paper_id, ord, caption, paths of each figure environment."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k + 1, command_argument(e, "caption") or "", re.findall(r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}", e)) for i, t in zip(pdf.paper_id, pdf.tex, strict=True) for k, e in enumerate(_environments("figure", t)) if k < most]
            yield pd.DataFrame(rows, columns=["paper_id", "ord", "caption", "paths"])

    return tex.mapInPandas(run, "paper_id string, ord int, caption string, paths array<string>")


def tables(tex: DataFrame, most: int = 12) -> DataFrame:
    """paper_id, ord, caption, rows of each table environment."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf.paper_id, pdf.tex, strict=True):
                for k, e in enumerate(_environments("table", t)):
                    m = re.search(r"(?s)\\begin\{tabular[*x]?\}\s*(?:\{[^}]*\}\s*)?(?=\{)", e)
                    g = group_at(e, m.end()) if m else None
                    body = e[g[1] : e.find(r"\end{tabular", g[1])] if g else ""
                    if k < most:
                        rows.append((i, k + 1, command_argument(e, "caption") or "", table_rows(body)))
            yield pd.DataFrame(rows, columns=["paper_id", "ord", "caption", "rows"])

    return tex.mapInPandas(run, "paper_id string, ord int, caption string, rows array<array<string>>")


def resolve_assets(figs: DataFrame, files: DataFrame) -> DataFrame:
    """Each figure's file: the exact path, else one with an image extension, else the same base name."""
    want = figs.select("paper_id", "ord", F.explode("paths").alias("p")).withColumn("p", archive_path(F.col("p")))
    have = files.select("paper_id", archive_path(F.col("path")).alias("path"))
    stem: Column = F.regexp_replace("path", r"(?i)\.(png|jpe?g|pdf|svg|eps|webp)$", "")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    keys = have.select("paper_id", "path", F.inline(F.array(F.struct(F.col("path").alias("key"), F.lit(0).alias("how")), F.struct(stem.alias("key"), F.lit(1).alias("how")), F.struct(base(F.col("path")).alias("key"), F.lit(2).alias("how")), F.struct(base(stem).alias("key"), F.lit(2).alias("how")))))
    asked = want.select("paper_id", "ord", "p", F.inline(F.array(F.struct(F.col("p").alias("key"), F.lit(0).alias("by")), F.struct(base(F.col("p")).alias("key"), F.lit(2).alias("by")))))
    both = asked.join(keys, ["paper_id", "key"])
    return both.groupBy("paper_id", "ord", "p").agg(F.min_by("path", F.struct(F.greatest("by", "how"), "path")).alias("path"))

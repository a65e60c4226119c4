"""The register of queries and their oracle SQL, and the papers that several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, in small parts: a file is read by as many tasks as it has row groups, however many parts it is cut into, and one of DuckDB's holds 122,880 rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, 4 * df.rdd.getNumPartitions()))


#: A paper around each document, in parts that are text or (column, text after it): headings of all forms, pages, decimals,
#: abbreviations, keys, formulas, figures, tables and references, which the invented prose lacks. Each line is a list of parts.
_PAPER: list[list[str | tuple[str]]] = [
    ["# A Study of Sparse Attention, part ", ("doc_id",)],
    ["## Page 1"],
    ["Abstract:"],
    [("text",)],
    ["2 Our Method"],
    ["We propose a model, e. g. a network whose loss is 0.5 vs. 84.2% as Ada et al. said, i.e. with key sk-", ("doc_id",), "abc."],
    [""],
    ["The architecture introduces a novel training objective for ", ("source",), " and improves accuracy by ", ("doc_id",), ".5%."],
    ["Problem: existing models cannot scale, because their memory is limited w.r.t. the input."],
    ["## Page 2"],
    ["3) Results"],
    ["The accuracy of the ", ("lang",), " model is ", ("doc_id",), ".5% on the main dataset; however, the baseline reaches 84.2%."],
    ["Figure 2: [Overview of the pipeline] Source: figures/", ("doc_id",), ".png"],
    ["![Accuracy curve ", ("lang",), "](plots/", ("source",), ".png)"],
    ["Fig. 3: accuracy comparison of ", ("source",), " models"],
    ["$$"],
    ["E_{", ("lang",), "} = \\sum_i x_i^2"],
    ["$$"],
    ["The score $p(x|y) = q_", ("lang",), "$ is used, and \\begin{equation}a = b_", ("n_chars",), "\\end{equation}"],
    ["Conclusion."],
    ["Therefore the dataset of ", ("n_chars",), " characters supports the main contribution of the framework."],
    ["## References"],
    ["method method method."],
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAPERS = "papers AS (SELECT doc_id, lang, source, n_chars, " + " || chr(10) || ".join(" || ".join(f"coalesce({p[0]}::VARCHAR, '')" if isinstance(p, tuple) else _quoted(p) for p in line) for line in _PAPER) + " AS text FROM documents)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, text of all documents' papers."""
    part = lambda p: F.coalesce(F.col(p[0]).cast("string"), F.lit("")) if isinstance(p, tuple) else F.lit(p)
    line = lambda parts: F.concat(*[part(p) for p in parts])
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "n_chars", F.concat_ws("\n", *[line(x) for x in _PAPER]).alias("text"))


# ------------------------------------------------------------------ SQL of what several oracles need

_WS = "[\\s\\x{00A0}\\x{FEFF}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def key_sql(x: str, more: str = "") -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}{more}]+', ' ', 'g'))"


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


_HELD = [("(\\d)\\.(\\d)", "\\1@\\2", "g"), ("\\b(e)\\.\\s*(g)\\.", "\\1@\\2@", "gi"), ("\\b(i)\\.\\s*(e)\\.", "\\1@\\2@", "gi"), ("\\b(et)\\s+(al)\\.", "\\1 \\2@", "gi")]
_EXPORT = [("\\b(v)\\.\\s*(s)\\.", "\\1@\\2@", "gi"), ("\\bvs\\.", "vs@", "gi"), ("\\bw\\.r\\.t\\.", "w@r@t@", "gi")]


def held_sql(x: str, export: bool = False) -> str:
    for pattern, new, flags in _HELD + (_EXPORT if export else []):
        x = f"regexp_replace({x}, '{pattern}', '{new}', '{flags}')".replace("@", "")
    return x


def freed_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql(f'replace(s, {_quoted(chr(0xE000))}, {_quoted(chr(46))})')}), lambda s: s <> '')"


_ENDED = "'[^.!?。！？]+[.!?。！？]?'"


def sentences_sql(x: str) -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\n+'), lambda l: {held_sql(strip_sql('l'))}), lambda l: l <> '')"
    found = f"list_transform({lines}, lambda l: CASE WHEN len(regexp_extract_all(l, {_ENDED})) > 0 THEN regexp_extract_all(l, {_ENDED}) ELSE [l] END)"
    return freed_sql(f"flatten({found})")


def export_sentences_sql(x: str) -> str:
    y = held_sql(collapse_sql(x), True)
    return freed_sql(f"CASE WHEN len(regexp_extract_all({y}, {_ENDED})) > 0 THEN regexp_extract_all({y}, {_ENDED}) ELSE [{y}] END")


def fallback_sentences_sql(x: str) -> str:
    y = held_sql(f"replace(coalesce({x}, ''), chr(13), '')")
    marked = f"regexp_replace({y}, '([。！？.!?])\\s+|\\n+', '\\1' || chr(1), 'g')"
    return freed_sql(f"string_split({marked}, chr(1))")

"""Sources and sinks: text, LaTeX archives, fixtures, Atom results; event lines, reports, paper texts."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = """id string, title string, paperText string,
expected struct<requiredFields: map<string, array<string>>, formulas: array<string>, figures: array<string>, tables: array<string>>,
candidate struct<analysis: map<string, string>, formulas: array<string>, figures: array<struct<name: string>>, tables: array<struct<name: string>>,
  agent: struct<evidence: map<string, array<struct<quote: string, location: string>>>, metrics: struct<durationMs: bigint, modelCalls: bigint, totalTokens: bigint, tokenEstimate: boolean>>>,
thresholds struct<overallScore: double, evidenceConsistency: double, hallucinationRate: double>"""


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def archives(spark: SparkSession, path: str, max_file: int = 30_000_000, max_all: int = 120_000_000) -> DataFrame:
    """paper_id, seq, path, content, data of the files in gzipped tars; a gzipped text alone is source.tex.

    Files over max_file, or that would take an archive beyond max_all, are skipped, not what follows them.
    """

    def unpack(raw: bytes) -> Iterator[tuple[str, bytes]]:
        body = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        try:
            with tarfile.open(fileobj=io.BytesIO(body)) as tar:
                used = 0
                for m in tar:
                    if m.isfile() and m.size <= max_file and used + m.size <= max_all:
                        used += m.size
                        yield m.name, tar.extractfile(m).read()
        except tarfile.ReadError:
            if b"\\documentclass" in body or b"\\begin{document}" in body:
                yield "source.tex", body

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1].split(".tar")[0], k, n, d.decode("utf-8", "replace") if n.endswith((".tex", ".bbl", ".bib")) else None, d) for p, raw in zip(pdf.path, pdf.content, strict=True) for k, (n, d) in enumerate(unpack(raw))]
            yield pd.DataFrame(rows, columns=["paper_id", "seq", "path", "content", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "paper_id string, seq int, path string, content string, data binary")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """arxiv_id and title of each entry of Atom feeds."""
    plain = F.regexp_replace(xml, r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    ids, titles = F.xpath(plain, F.lit("//entry/id/text()")), F.xpath(plain, F.lit("//entry/title/text()"))
    both = feeds.select(F.explode(F.arrays_zip(ids.alias("id"), titles.alias("title"))).alias("e"))
    return both.select(F.regexp_extract("e.id", r"abs/([^v\s]+)", 1).alias("arxiv_id"), F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"))


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each event."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def write_report(cases: DataFrame, summary: DataFrame, path: str) -> bool:
    """Cases and summary as JSON; whether all passed."""
    cases.write.mode("overwrite").json(f"{path}/cases")
    summary.write.mode("overwrite").json(f"{path}/summary")
    row = summary.first()
    return row.n_cases == row.n_passed


def paper_document(papers: DataFrame) -> DataFrame:
    """paper_id and one Markdown text of title, formulas, figures, tables and body."""
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    parts = [F.concat(F.lit("# "), F.col("title")), listed("Reliable formulas", F.col("formulas")), listed("Figures extracted", F.col("figures")), listed("Tables extracted", F.col("tables")), F.col("body")]
    return papers.select("paper_id", F.concat_ws("\n\n", *parts).alias("text"))


# Kinds of figure files by their extension, and what a PDF begins with.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf"}
PDF_MAGIC, PDF_MOST = b"%PDF-", 80_000_000


def assets(files: DataFrame, max_file: int = 30_000_000, max_all: int = 120_000_000) -> DataFrame:
    """paper_id, key, path, mime, data of the files (paper_id, seq, path, data) that are figures, by lower-case path.

    A file over max_file, or that would take its paper beyond max_all, is skipped, and what follows isn't.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(*[F.when(extension == e, m) for e, m in MIME.items()])
    sized = files.withColumns({"mime": mime, "size": F.octet_length("data")}).filter(F.col("mime").isNotNull() & (F.col("size") <= max_file))
    one = F.array_sort(F.collect_list(F.struct("seq", "size")))  # the files of one paper, without their bytes
    start = F.expr("named_struct('used', 0L, 'kept', cast(array() as array<int>))")
    step = lambda a, f: F.when(a["used"] + f["size"] > max_all, a).otherwise(F.struct((a["used"] + f["size"]).alias("used"), F.array_append(a["kept"], f["seq"]).alias("kept")))
    kept = sized.groupBy("paper_id").agg(F.aggregate(one, start, step)["kept"].alias("kept")).select("paper_id", F.explode("kept").alias("seq"))
    return sized.join(kept, ["paper_id", "seq"], "left_semi").select("paper_id", "seq", F.lower("path").alias("key"), "path", "mime", "data")


def asset(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """The assets that wanted (paper_id, path) asks for, whatever the case of the path."""
    return wanted.select("paper_id", F.lower("path").alias("key")).distinct().join(cached, ["paper_id", "key"])


def is_pdf(data: str = "content") -> Column:
    """Whether bytes are a PDF of a size that is taken."""
    return (F.substring(F.col(data), 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC)) & (F.octet_length(data) <= PDF_MOST)

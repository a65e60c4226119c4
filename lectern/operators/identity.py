"""Which paper a text is: what a profile and the text itself say, their conflicts and repair, and what must not be mixed.

A profile is a struct of what a source claims (PROFILE's fields, any of them null). What a text says of itself is read once (`facts`): its heading, the DOI on its
first page and a hash. Everything else compares these few values, so the second pass of a repair costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.evidence import nfkc
from ..functions.text import academic_key, arxiv_id, collapse, doi, fnv1a, strip, text_of, title_of, titles_agree

PROFILE = ("source_type", "title", "title_lines", "doi", "paper_url", "arxiv_id", "detected_arxiv_id", "file_name")

# Years that ran into a word, words that ran into a title, marks of the first two pages, what of a profile's text is hashed, and how a DOI and a placeholder look.
YEAR_JOINED = r"\b((?:19|20)\d{2})([A-Z][a-z]{2,})"
TITLE_TAIL = r"(?i)\s+(?:abstract|introduction|keywords?)\s*\z"
PAGE_ONE, PAGE_TWO = r"(?i)##\s+Page\s+1\s*", r"(?i)\n##\s+Page\s+2\b"
PLAIN_START = 12_000
HASHED = 50_000
DOI_VALUE = r"(?i)(?:https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[A-Z0-9][A-Z0-9._;()/:+-]*)"
DOI_TAIL = r"[.,;:)}\]]+\z"
DOI_PLACEHOLDER = r"(?i)(?:^|[._/()-])(?:n{4,}|x{4,}|tbd|todo|placeholder)(?:\z|[._/()-])|n{6,}|x{6,}"
TITLE_RATIO = 0.88


def clean_title(c: Column) -> Column:
    """A title on one line, without the year or heading that ran into it."""
    return strip(F.regexp_replace(F.regexp_replace(collapse(c), YEAR_JOINED, "$1 $2"), TITLE_TAIL, ""))


def same_title(a: Column, b: Column) -> Column:
    """Equal letters and digits, or one within the other at nearly its length; an unknown title agrees with any."""
    x, y = (F.regexp_replace(F.lower(nfkc(clean_title(t))), r"[^\p{L}\p{N}]+", "") for t in (a, b))
    longer, shorter = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
    return (x == "") | (y == "") | (F.contains(longer, shorter) & (F.length(shorter) >= TITLE_RATIO * F.length(longer)))


def heading(c: Column) -> Column:
    """The first Markdown heading of the first level, cleaned; empty if there is none."""
    return clean_title(F.regexp_extract(text_of(c), r"(?m)^[\s&&[^\n]]*#[\s&&[^\n]]+(\S.*)$", 1))


def first_page(c: Column) -> Column:
    """What stands between the marks of pages 1 and 2, or the start of a text without marks."""
    x = text_of(c)
    after = F.get(F.split(x, PAGE_ONE, 2), F.lit(1))
    return F.coalesce(F.get(F.split(after, PAGE_TWO, 2), F.lit(0)), F.substring(x, 1, PLAIN_START))


def clean_doi(c: Column) -> Column:
    """The first DOI in its own letters, without what closes a sentence; empty for none or a placeholder."""
    x = F.regexp_replace(F.regexp_extract(text_of(c), DOI_VALUE, 1), DOI_TAIL, "")
    suffix = F.regexp_extract(x, r"(?s)^[^/]*/(.*)$", 1)
    return F.when((suffix != "") & ~suffix.rlike(DOI_PLACEHOLDER), x).otherwise("")


def bare_arxiv_id(c: Column) -> Column:
    return F.regexp_replace(strip(text_of(c)), r"(?i)^arxiv:\s*", "")


def canonical_text(preferred: Column, fallback: Column) -> Column:
    return F.when(strip(text_of(preferred)) != "", preferred).otherwise(text_of(fallback))


def facts(text: Column) -> Column:
    """struct<title, doi, hash> of what a text says of itself; the hash is of its first HASHED characters."""
    return F.struct(heading(text).alias("title"), clean_doi(first_page(text)).alias("doi"), fnv1a(text, HASHED).alias("hash"))


def _or(a: Column, b: Column) -> Column:
    return F.when(text_of(a) != "", a).otherwise(text_of(b))


def created(p: Column, said: Column) -> Column:
    """The identity of a profile and the facts of its text; conflicts lists what they disagree on."""
    kind = F.coalesce(F.nullif(p["source_type"], F.lit("")), F.lit("text"))
    title, own_doi = clean_title(p["title"]), clean_doi(_or(p["doi"], p["paper_url"]))
    page_doi = F.when(kind == "pdf", said["doi"]).otherwise("")
    arxiv = bare_arxiv_id(_or(p["arxiv_id"], p["detected_arxiv_id"]))
    listed = F.array_compact(F.array(F.when(~same_title(title, said["title"]), "title"), F.when((own_doi != "") & (page_doi != "") & (F.lower(own_doi) != F.lower(page_doi)), "doi")))
    name, number = _or(title, said["title"]), _or(page_doi, own_doi)
    lines = F.filter(F.transform(F.coalesce(p["title_lines"], F.array().cast("array<string>")), clean_title), lambda x: x != "")
    return F.struct(
        F.when(number != "", F.concat(F.lit("doi:"), F.lower(number))).when(arxiv != "", F.concat(F.lit("arxiv:"), F.lower(arxiv))).otherwise(F.concat(F.lit("text:"), said["hash"])).alias("key"),
        said["hash"].alias("content_hash"),
        name.alias("title"),
        F.when((F.size(lines) > 1) & (F.regexp_replace(F.array_join(lines, " "), r"\s+", " ") == name), lines).otherwise(F.array().cast("array<string>")).alias("title_lines"),
        number.alias("doi"),
        F.when(number != "", F.concat(F.lit("https://doi.org/"), number)).when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).otherwise("").alias("paper_url"),
        arxiv.alias("arxiv_id"),
        text_of(p["file_name"]).alias("file_name"),
        kind.alias("source_type"),
        (F.size(listed) == 0).alias("consistent"),
        listed.alias("conflicts"),
    )


def _first_pass(papers: DataFrame, id_col: str) -> DataFrame:
    said = once(papers.select(id_col, "profile", "text"), "said", facts(F.col("text"))).drop("text")
    return once(said, "first", created(F.col("profile"), F.col("said")))


def create(papers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and the identity's columns of papers (id_col, profile, text)."""
    return _first_pass(papers, id_col).select(id_col, "first.*")


def reconcile(papers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As create; where profile and text conflict, the text's title, and a PDF's first-page DOI, replace the profile's in a second pass.

    Adds repaired, repaired_fields and found, the conflicts of the first pass.
    """
    first = _first_pass(papers, id_col)
    hit = lambda name: F.array_contains("first.conflicts", name)
    p, said = F.col("profile"), F.col("said")
    mended = F.struct(
        p["source_type"].alias("source_type"),
        F.when(hit("title"), said["title"]).otherwise(p["title"]).alias("title"),
        F.when(hit("title"), F.array().cast("array<string>")).otherwise(p["title_lines"]).alias("title_lines"),
        F.when(hit("doi"), said["doi"]).otherwise(p["doi"]).alias("doi"),
        F.when(hit("doi"), F.concat(F.lit("https://doi.org/"), said["doi"])).otherwise(p["paper_url"]).alias("paper_url"),
        *[p[n].alias(n) for n in ("arxiv_id", "detected_arxiv_id", "file_name")],
    )
    second = once(once(first, "mended", mended), "second", created(F.col("mended"), F.col("said")))
    fields = F.col("first.conflicts")
    return second.select(id_col, "second.*", (F.col("second.consistent") & (F.size(fields) > 0)).alias("repaired"), fields.alias("repaired_fields"))


def judged(identities: DataFrame, message: str = "Paper identity is inconsistent.") -> DataFrame:
    """identities with `accepted` and, of the others, the reason; no row is lost and none stops the job."""
    detail = F.when(F.size("conflicts") > 0, F.array_join("conflicts", " and ")).otherwise("source")
    reason = F.concat(F.lit(f"{message} Conflicting "), detail, F.lit(" metadata was detected; reload the PDF before generating."))
    ok = F.coalesce(F.col("consistent"), F.lit(False))
    return identities.withColumns({"accepted": ok, "reason": F.when(~ok, reason)})


def quarantined(identities: DataFrame, message: str = "Paper identity is inconsistent.") -> tuple[DataFrame, DataFrame]:
    """The consistent rows, and beside them the others with the reason. Each table reads the identities; `judged` has both in one reading."""
    both = judged(identities, message)
    return both.filter("accepted").drop("accepted", "reason"), both.filter("not accepted").drop("accepted")


def enrichment_matches(p: Column, title: Column, arxiv: Column, text: Column) -> Column:
    """Whether fetched metadata (title, else the text's heading, and arXiv id) may enrich a profile."""
    unversioned = lambda x: F.regexp_replace(F.lower(bare_arxiv_id(x)), r"v\d+\z", "")
    mine, other = unversioned(_or(p["arxiv_id"], p["detected_arxiv_id"])), unversioned(arxiv)
    return same_title(p["title"], _or(clean_title(title), heading(text))) & ((mine == "") | (other == "") | (mine == other))


def matched(a: Column, b: Column) -> Column:
    """Whether two identities are one paper in one text: a DOI in common isn't enough."""
    same = (a["key"] == b["key"]) & (a["content_hash"] == b["content_hash"]) & (F.coalesce(a["paper_url"], F.lit("")) == F.coalesce(b["paper_url"], F.lit("")))
    return F.coalesce(same & same_title(a["title"], b["title"]), F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", file_col: str | None = None) -> DataFrame:
    """doc_id, title, doi, arxiv_id, content_hash (of the whole text) and the key (DOI of the first page, else arXiv id, else hash) of texts without a profile."""
    name = F.col(file_col) if file_col else F.lit("")
    text = F.col("text")
    made = docs.select(F.col(id_col).alias("doc_id"), title_of(text).alias("title"), doi(first_page(text)).alias("doi"), arxiv_id(name, text).alias("arxiv_id"), F.explode(F.array(fnv1a(text))).alias("content_hash"))
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("arxiv:"), "arxiv_id"), F.concat(F.lit("text:"), "content_hash"))
    return made.withColumn("key", key)


def by_title(titles: DataFrame, entries: DataFrame, id_col: str = "doc_id", least: int = 12) -> DataFrame:
    """id_col and arxiv_id of titles (id_col, title) that an entry (arxiv_id, title) has in all letters and digits; short ones prove nothing."""
    t = titles.select(id_col, academic_key(F.col("title")).alias("key")).filter(F.length("key") >= least)
    first = entries.groupBy(academic_key(F.col("title")).alias("key")).agg(F.min("arxiv_id").alias("arxiv_id"))
    return t.join(first, "key").select(id_col, "arxiv_id")


def conflicts(profile: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Where a profile's title, DOI or arXiv id contradicts what the text says."""
    both = profile.select(id_col, *[F.col(c).alias(f"p_{c}") for c in ("title", "doi", "arxiv_id")]).join(found, id_col)
    differ = lambda c: F.when(F.col(f"p_{c}") != F.col(c), c)
    listed = F.filter(F.array(F.when(~titles_agree(F.col("p_title"), F.col("title")), "title"), differ("doi"), differ("arxiv_id")), lambda x: x.isNotNull())
    return both.select(id_col, "key", listed.alias("conflicts"), (F.size(listed) == 0).alias("consistent"))

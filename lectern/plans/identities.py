"""Queries of papers' identities: a profile of one of eight kinds around each document, right, stale or mixed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from .base import query, spread, table

# parts of the profiles and texts, in words that Spark and DuckDB share
_TITLE = "concat('Study of ', coalesce(source, 'no source'), ' part ', doc_id)"
_DOI = "concat('10.1234/Ab.', doc_id)"
_ARXIV = "concat('2401.', lpad(cast(doc_id % 100000 as varchar(20)), 5, '0'))"
_CASES = {
    "source_type": ["'pdf'", "'pdf'", "'pdf'", "'pdf'", "'arxiv'", "'pdf'", "null", "'pdf'"],
    "title": [_TITLE, "'Formatting Instructions for ICLR 2024Conference Submissions'", f"concat('  ', {_TITLE}, '  Abstract ')", _TITLE, f"upper({_TITLE})", _TITLE, "null", "'Another Paper'"],
    "doi": [_DOI, _DOI, "'10.1000/stale'", "null", "null", "'10.1145/nnnnnnn.nnnnnnn'", "null", "'https://doi.org/10.1000/stale).'"],
    "arxiv_id": ["null", "null", "null", "null", f"concat('arXiv: ', {_ARXIV})", "null", "null", "null"],
    "detected_arxiv_id": ["null", f"concat({_ARXIV}, 'v2')", "null", "null", "null", f"concat({_ARXIV}, 'v1')", "null", "null"],
}
_PAGED = f"concat('# ', {_TITLE}, chr(10), chr(10), '## Page 1', chr(10), 'see https://doi.org/', {_DOI}, '.', chr(10), '## Page 2', chr(10), 'cites 10.1000/other', chr(10), coalesce(text, ''))"
_CITING = f"concat('# ', {_TITLE}, chr(10), '## Page 1', chr(10), 'No DOI here.', chr(10), '## Page 2', chr(10), 'Reference https://doi.org/10.1000/reference-only', chr(10), coalesce(text, ''))"
_TEXTS = [
    _PAGED, _PAGED, _PAGED, _CITING,
    f"concat('# ', {_TITLE}, chr(10), 'Introduction cites https://doi.org/10.1000/another.', chr(10), coalesce(text, ''))",
    f"concat('# ', {_TITLE}, chr(10), '## Page 1', chr(10), 'https://doi.org/10.1145/nnnnnnn.nnnnnnn', chr(10), coalesce(text, ''))",
    f"concat('No heading', chr(10), ' # ', {_TITLE}, ' keywords', chr(10), coalesce(text, ''))",
    _PAGED,
]


def _case(of: list[str]) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(of)) + " END"


def papers(spark, d):
    """doc_id, profile, text."""
    fields = [F.expr(_case(_CASES[n])).cast("string").alias(n) if n in _CASES else F.lit(None).cast("array<string>" if n == "title_lines" else "string").alias(n) for n in identity.PROFILE]
    return spread(table(spark, d, "documents")).select("doc_id", F.struct(*fields).alias("profile"), F.expr(_case(_TEXTS)).alias("text"))


#: What must come out, case by case; only the hash is computed.
_HASH = """m AS (SELECT doc_id, source, {text} AS text FROM documents), h AS (SELECT doc_id, source, left(trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')), 50000) AS x FROM m),
k AS (SELECT doc_id, source, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(x, ''), lambda c: unicode(c)::BIGINT)), lambda h, p: (xor(h, p) * 16777619) & 4294967295))), 8, '0') || ':' || length(x) AS content_hash FROM h)""".format(text=_case(_TEXTS))
_HAS_DOI, _HAS_ARXIV = "doc_id % 8 IN (0, 1, 2, 7)", "doc_id % 8 IN (4, 5)"
_ID = f"CASE doc_id % 8 WHEN 1 THEN {_ARXIV} || 'v2' WHEN 4 THEN {_ARXIV} WHEN 5 THEN {_ARXIV} || 'v1' ELSE '' END"
_URL = f"CASE WHEN {_HAS_DOI} THEN 'https://doi.org/' || {_DOI} WHEN {_HAS_ARXIV} THEN 'https://arxiv.org/abs/' || {_ID} ELSE '' END"
_KEY = f"CASE WHEN {_HAS_DOI} THEN 'doi:' || lower({_DOI}) WHEN {_HAS_ARXIV} THEN 'arxiv:' || {_ID} ELSE 'text:' || content_hash END"


@query(f"""WITH {_HASH} SELECT doc_id, {_KEY} AS key, content_hash, CASE doc_id % 8 WHEN 4 THEN upper({_TITLE}) ELSE {_TITLE} END AS title, CASE WHEN {_HAS_DOI} THEN {_DOI} ELSE '' END AS doi, {_URL} AS paper_url, {_ID} AS arxiv_id,
true AS consistent, doc_id % 8 IN (1, 2, 7) AS repaired, CASE doc_id % 8 WHEN 1 THEN 'title' WHEN 2 THEN 'doi' WHEN 7 THEN 'title,doi' ELSE '' END AS repaired_fields FROM k""")
def identity_reconciled(spark, d):
    """Stale titles and DOIs give way to the paper's own first page; cited DOIs and placeholders never count."""
    return identity.reconcile(papers(spark, d)).select("doc_id", "key", "content_hash", "title", "doi", "paper_url", "arxiv_id", "consistent", "repaired", F.array_join("repaired_fields", ",").alias("repaired_fields"))


@query("""SELECT doc_id, doc_id % 8 NOT IN (1, 2, 7) AS accepted, CASE doc_id % 8 WHEN 1 THEN 'Paper identity is inconsistent. Conflicting title metadata was detected; reload the PDF before generating.' WHEN 2 THEN 'Paper identity is inconsistent. Conflicting doi metadata was detected; reload the PDF before generating.'
WHEN 7 THEN 'Paper identity is inconsistent. Conflicting title and doi metadata was detected; reload the PDF before generating.' END AS reason FROM documents""")
def identity_quarantine(spark, d):
    """Without a repair, papers in conflict are told apart, with the reason."""
    return identity.judged(identity.create(papers(spark, d))).select("doc_id", "accepted", "reason")


@query(f"""WITH {_HASH}, i AS (SELECT doc_id, {_KEY} AS key, content_hash, coalesce(source, '') AS source, {_URL} AS url FROM k)
SELECT a.doc_id, b.doc_id AS other, a.doc_id = b.doc_id AS matches FROM i a JOIN i b ON b.doc_id IN (a.doc_id, a.doc_id + 8)""")
def identity_matches(spark, d):
    """A paper matches itself, and not the next of its kind; both sides are reconciled on their own."""
    made = identity.reconcile(papers(spark, d)).select("doc_id", F.struct("key", "content_hash", "title", "paper_url").alias("it"))
    sides = made.select("doc_id", F.explode(F.array("doc_id", F.col("doc_id") + 8)).alias("other"), "it")
    return sides.join(made.select(F.col("doc_id").alias("other"), F.col("it").alias("theirs")), "other").select("doc_id", "other", identity.matched(F.col("it"), F.col("theirs")).alias("matches"))


@query("""SELECT doc_id, n, CASE n WHEN 0 THEN true WHEN 1 THEN doc_id % 8 IN (6) WHEN 2 THEN doc_id % 8 NOT IN (1, 4, 5) ELSE doc_id % 8 NOT IN (1, 7) END AS enriches FROM documents, range(4) r(n)""")
def identity_enrichment(spark, d):
    """Metadata of the same title in other forms, of another title, of another arXiv id, and of none but the text's heading."""
    p = F.col("profile")
    offers = F.array(
        F.struct(F.lower(p["title"]).alias("title"), F.upper(F.coalesce(p["arxiv_id"], p["detected_arxiv_id"])).alias("id")),
        F.struct(F.lit("A Paper of Other People").alias("title"), F.lit(None).cast("string").alias("id")),
        F.struct(p["title"].alias("title"), F.lit("arXiv:9901.00001v3").alias("id")),
        F.struct(F.lit("").alias("title"), F.lit("").alias("id")),
    )
    rows = papers(spark, d).select("doc_id", "profile", "text", F.posexplode(offers).alias("n", "offer"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), identity.enrichment_matches(p, F.col("offer.title"), F.col("offer.id"), F.col("text")).alias("enriches"))

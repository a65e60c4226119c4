"""Line dedup: content-defined chunks of lines; chunks that repeat anywhere are removed but for the first.

A rolling hash over the hashes of the last WINDOW lines ends a chunk where it is divisible by DIVISOR, so
boundaries depend on the lines near them only, and text put in before a passage doesn't move those inside
it. Chunks of two lines or more are grouped by digest over the whole corpus; the first occurrence, by
doc_id and place, stays. The others go if their bytes equal those of the first.

Digests are counted with map-side sums, so a chunk that a third of all documents share is one row from
each task. All chunks are shuffled once, by digest and a salt, to meet the first occurrence; those that repeat
are compared with its text, by digest and salt again, and each document takes back the list of what it loses,
which is no longer than its chunks.

Defined results: a null text stays null, and an empty text empty. Rows with the same doc_id count as one
document, and so do those without one: where they hold the first occurrence, all keep it. Chunks of white space only stay. A text
with nothing removed is unchanged, byte for byte. Extra columns are carried along; any that are called
like the two counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import checkpointed

WINDOW = 2
DIVISOR = 3
#: A chunk that many documents share is joined in so many parts.
SALT = 8
_BASE = 131


def _bound(x: Column, f) -> Column:
    """f of an expression that is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """The chunks of a text, as an array of arrays of lines."""
    line_hash = lambda x: F.conv(F.substr(F.md5(x.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")

    def cut(both: Column) -> Column:
        lines, hashes = both["lines"], both["hashes"]

        def ends(i: Column) -> Column:  # whether a chunk ends after line i
            rolled = sum((F.coalesce(F.get(hashes, i - F.lit(k)), F.lit(0)) * F.lit(_BASE**k) for k in range(window)), F.lit(0))
            return rolled % F.lit(divisor) == 0

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | ends(i - 1))
        return _bound(starts, lambda s: F.transform(s, lambda a, j: F.slice(lines, a + 1, F.coalesce(F.get(s, j + 1), F.size(lines)) - a)))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return _bound(_bound(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, line_hash).alias("hashes"))), cut)


def repeated(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, place (of a chunk in its document) and digest of each chunk that goes."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    cut = docs.select("doc_id", F.posexplode(chunks(F.col("text"), window, divisor)).alias("place", "lines")).filter(F.size("lines") >= 2)
    chunk = F.array_join("lines", "\n")
    occurs = cut.select("doc_id", "place", chunk.alias("chunk")).filter(F.trim(F.regexp_replace("chunk", "[\\x09-\\x0D]", " ")) != "").withColumn("digest", F.md5(F.col("chunk").cast("binary")))
    first = occurs.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).filter(F.col("n") > 1).select("digest", "first", salts)
    salted = occurs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALT)).cast("int"))
    again = checkpointed(salted.join(first, ["digest", "salt"]).select("doc_id", "place", "digest", "salt", "chunk", F.col("first").eqNullSafe(F.struct("doc_id", "place")).alias("kept")))
    kept = again.filter("kept").groupBy("digest").agg(F.min("chunk").alias("kept_chunk")).select("digest", "kept_chunk", salts)
    return again.filter(~F.col("kept")).join(kept, ["digest", "salt"]).filter(F.col("chunk") == F.col("kept_chunk")).select("doc_id", "place", "digest")


def deduplicated(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """All rows and columns of docs, text without what repeats; n_chunks_removed and n_lines_removed are added."""
    gone = repeated(docs, window, divisor).groupBy("doc_id").agg(F.collect_set(F.struct("place", "digest")).alias("gone"))  # no more than a document's chunks
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = docs.select(row).join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left")

    def kept(all_chunks: Column) -> Column:
        marked = F.transform(all_chunks, lambda x, i: F.struct(x.alias("lines"), F.struct(i.alias("place"), F.md5(F.array_join(x, "\n").cast("binary")).alias("digest")).alias("is")))
        return F.transform(F.filter(marked, lambda x: ~F.array_contains(F.col("gone"), x["is"])), lambda x: x["lines"])

    cut = chunks(F.col("row.text"), window, divisor)
    result = _bound(cut, lambda c: _bound(kept(c), lambda k: F.struct(F.array_join(F.flatten(k), "\n").alias("text"), (F.size(c) - F.size(k)).alias("chunks"), (F.size(F.flatten(c)) - F.size(F.flatten(k))).alias("lines"))))
    untouched = F.struct(F.col("row.text").alias("text"), F.lit(0).alias("chunks"), F.lit(0).alias("lines"))
    done = both.select("row", F.when(F.col("gone").isNull() | F.col("row.text").isNull(), untouched).otherwise(result).alias("new"))
    return done.select(*[F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_chunks_removed", "n_lines_removed")], F.col("new.chunks").alias("n_chunks_removed"), F.col("new.lines").alias("n_lines_removed"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM l),
m AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM h),
e AS (SELECT *, (h + 131 * coalesce(lag(h) OVER w, 0)) % 3 = 0 AS ends FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
c AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS k FROM p GROUP BY ALL),
r AS (SELECT *, k >= 2 AND trim(regexp_replace(chunk, '[\\t-\\r]', ' ', 'g')) <> '' AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM c)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
  count(*) FILTER (gone)::INT AS n_chunks_removed, coalesce(sum(k) FILTER (gone), 0)::INT AS n_lines_removed
FROM r GROUP BY doc_id
"""

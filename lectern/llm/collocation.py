"""Phrase collocations: hashed and pruned counting of word n-grams, pass by pass, then scores of their weakest cuts.

Pass k reads the texts once. It counts the phrases of k words exactly and, in the same reading, adds the phrases of k + 1 words to
saturating counters, one for each of 2^BITS buckets (PCY); only those are hashed whose two parts of k words can still be frequent (DHP). The buckets that reach
the least count become a bitmap, and so do the hashes of the phrases found frequent. The next pass counts a phrase exactly only if its bucket is set and both its
parts, but for their first or last word, are frequent (Apriori). Both bitmaps have 2^BITS bits whatever the input, so they are broadcast; they let too
much through at worst, never too little, as the exact counts decide.

A task adds up its own counts in blocks before anything is shuffled; counters of all tasks meet by range of buckets and are added one after another.

Defined results: a null text is empty, a null lang is `und`. Texts are worked on in blocks of half a MB that share a few words at each cut, so their length
has no bound. Repeated rows and ids count as often as they occur. Ties in a rank go to the higher count, then to the smaller phrase in byte order. An empty table gives no row. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import BLOCK, checkpointed, mix, row_blocks, runs, shared_folder, shuffle_parts, span_hashes, utf8

LONGEST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
BITS = 24
#: Bytes of text that are worked on at once.
_BLOCK = BLOCK // 2
#: Buckets whose counters, or bits, make one row.
_PART = 15
#: Counts that a task holds before it passes them on.
_HELD = 600_000
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])
_DDL = "lang string, phrase string, n long, part int, cells binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~(_BLANK | _CUT)


class Words:
    """The words of a block of text of one language: their bytes, hashes, and which follow each other within a piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, seed: int, fresh: int = 0):
        raw = _LOWER[raw]
        self.starts, ends = runs(raw, offsets, _WORD)
        n = len(self.starts)
        cuts = np.cumsum(_CUT[raw])
        piece = np.searchsorted(offsets, self.starts, "right") + (cuts[self.starts] if n else 0)
        self.follows = piece[1:] == piece[:-1]  # a word and its predecessor
        self.fresh = self.starts >= fresh  # words that no earlier block had
        self.hashes = [mix(span_hashes(raw, self.starts, ends) ^ np.uint64(seed))]
        size = ends - self.starts
        self.at = np.r_[0, np.cumsum(size + 1)]  # places in the text of all words, with a space after each
        self.text = np.full(int(self.at[-1]), 0x20, np.uint8)
        self.text[_places(self.at[:-1], size)] = raw[_places(self.starts, size)]

    def hashed(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, whether within a piece or not."""
        while len(self.hashes) < k:
            h, w = self.hashes[-1], self.hashes[0]
            j = len(self.hashes)
            self.hashes.append(mix(h[: max(0, len(w) - j)] * np.uint64(0x9E3779B97F4A7C15) + w[j:]))
        return self.hashes[k - 1]

    def whole(self, k: int) -> np.ndarray:
        """Runs of k words that lie within a piece."""
        n = max(0, len(self.starts) - k + 1)
        return np.logical_and.reduce([self.follows[j : j + n] for j in range(k - 1)]) if k > 1 and n else np.ones(n, bool)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        size = self.at[at + k] - 1 - self.at[at]
        ends = np.cumsum(size)
        data = self.text[_places(self.at[at], size)]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)])


def _places(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of these spans, one after another."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _blocks(raw: np.ndarray, offsets: np.ndarray, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Parts of the texts with their row offsets and the place from which their words are new; a long text's parts share words."""
    for i, j in row_blocks(offsets, _BLOCK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j - i > 1 or hi - lo <= _BLOCK:
            yield raw[lo:hi], offsets[i : j + 1] - lo, 0
            continue
        carried, at = b"", lo
        while at < hi:
            end = min(at + _BLOCK, hi)
            while end < hi and _WORD[raw[end]]:  # on to the end of a word
                gap = np.flatnonzero(~_WORD[raw[end : end + _BLOCK]])
                end = end + int(gap[0]) if len(gap) else min(end + _BLOCK, hi)
            part = np.concatenate([np.frombuffer(carried, np.uint8), raw[at:end]])
            yield part, np.array([0, len(part)]), len(carried)
            carried, at = _tail(part, shared), end


def _tail(part: np.ndarray, words: int) -> bytes:
    """The last words, each with a byte that says whether a piece ends after it."""
    starts, ends = runs(part, np.array([0, len(part)]), _WORD)
    starts, ends = starts[-words:], ends[-words:]
    after = [*starts[1:], len(part)]
    return b"".join(part[s:e].tobytes() + (b"\n" if _CUT[part[e:n]].any() else b" ") for s, e, n in zip(starts, ends, after))


def _bit(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    b = h & np.uint64((1 << bits) - 1)
    return (bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _pass(k: int, longest: int, least: int, bits: int, buckets, frequent):
    """Exact counts of possible phrases of k words, and at the end of a task its counters of those of k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint8) if k < longest else None
        held: dict[str, list[pa.Table]] = {}
        rows = 0

        def added(x: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(x).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).select(["phrase", "n_sum"]).rename_columns(["phrase", "n"])

        def out(lang: str, x: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in x.to_batches(25_000):
                size = len(part)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), part.column(0).cast(pa.string()), part.column(1), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=_SCHEMA)

        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                for raw, offsets, fresh in _blocks(*utf8(batch.column("text").filter(pc.equal(langs, lang))), max(1, longest - 1)):
                    words = Words(raw, offsets, _seed(lang), fresh)
                    alive = words.whole(k)
                    if k > 1:
                        part = _bit(frequent.value, words.hashed(k - 1), bits)
                        alive = alive & part[: len(alive)] & part[1 : len(alive) + 1] & _bit(buckets.value, words.hashed(k), bits)
                    at = np.flatnonzero(alive & words.fresh[k - 1 :])
                    if len(at):
                        counts = pc.value_counts(words.phrases(at, k))
                        held.setdefault(lang, []).append(pa.table({"phrase": counts.field("values"), "n": counts.field("counts")}))
                        rows += len(counts)
                    if cells is not None:
                        longer = words.whole(k + 1)
                        longer = longer & alive[: len(longer)] & alive[1 : len(longer) + 1] & words.fresh[k:]
                        bucket, n = np.unique(words.hashed(k + 1)[longer] & np.uint64((1 << bits) - 1), return_counts=True)
                        cells[bucket.astype(np.int64)] = np.minimum(cells[bucket.astype(np.int64)] + n, least)
                    if rows > _HELD:
                        for own in held:  # one language after another, so that little stands beside what is held
                            held[own] = [added(held[own])]
                        rows = sum(len(x[0]) for x in held.values())
                        while rows > _HELD // 2:  # the languages with most counts
                            own = max(held, key=lambda k: len(held[k][0]))
                            rows -= len(held[own][0])
                            yield from out(own, held.pop(own)[0])
                        pa.default_memory_pool().release_unused()
        while held:
            own, parts = held.popitem()
            yield from out(own, added(parts))
        if cells is not None:
            for part in range(len(cells) >> _PART):
                own = cells[part << _PART : (part + 1) << _PART]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], schema=_SCHEMA)

    return run


def _full(least: int):
    """Counters by part, in order of parts, to a part's bits of the buckets that reach the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])})

        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells")):
                if part != now:
                    if sums is not None:
                        yield told()
                    now, sums = part, np.zeros(1 << _PART, np.int64)
                sums += np.frombuffer(zlib.decompress(cells.as_py()), np.uint8)
        if sums is not None:
            yield told()

    return run


def _marks(k: int, bits: int):
    """Bits of the hashes of these phrases, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                raw, offsets = utf8(batch.column("phrase").filter(pc.equal(langs, lang)))
                for i, j in row_blocks(offsets, BLOCK):
                    words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _seed(lang))
                    first = np.searchsorted(words.starts, offsets[i:j] - offsets[i])
                    seen[(words.hashed(k)[first] & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        for part in range(len(seen) >> _PART):
            own = seen[part << _PART : (part + 1) << _PART]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    return run


def _bitmap(parts: DataFrame, bits: int):
    """A broadcast bitmap of 2^bits bits from its parts, of which there are a fixed number."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.collect():
        whole[r["part"] << (_PART - 3) : (r["part"] + 1) << (_PART - 3)] = np.frombuffer(r["bits"], np.uint8)
    return parts.sparkSession.sparkContext.broadcast(whole)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """For each length up to `longest` the phrases (lang, phrase, n) that occur `least` times or oftener, and the number of words by lang."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    found: list[DataFrame] = []
    buckets = seen = totals = None
    for k in range(1, longest + 1):
        texts.mapInArrow(_pass(k, longest, least, bits, buckets, seen), _DDL).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        made = spark.read.schema(_DDL).parquet(f"{folder}/{k}")
        counts = made.filter("cells is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found.append(checkpointed(counts.filter(F.col("n") >= least)))
        if k == 1:
            totals = checkpointed(made.filter("cells is null").groupBy("lang").agg(F.sum("n").alias("n")))
        if k < longest:
            cells, parts = made.filter("cells is not null").select("part", "cells"), shuffle_parts(spark)
            dealt = cells.repartitionById(parts, (F.col("part") % parts).cast("int")).sortWithinPartitions("part")
            buckets = _bitmap(dealt.mapInArrow(_full(least), "part int, bits binary"), bits)
            seen = _bitmap(found[-1].mapInArrow(_marks(k, bits), "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")), bits)
        _remove(spark, f"{folder}/{k}")
    return found, totals


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 words or more."""
    found, totals = frequent_phrases(docs, longest, least, bits)
    known = reduce(DataFrame.union, found[: longest - 1])
    words = F.split("phrase", " ")
    phrases = reduce(DataFrame.union, found[1:]).withColumnRenamed("n", "a")
    cut = phrases.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    exact = "(cast(1000000 as decimal(8, 0)) * (cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    scored = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).withColumn("score", F.expr(exact))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    if longest > 2:
        longer = reduce(DataFrame.union, found[2:]).withColumn("w", words)
        parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda j: F.transform(F.sequence(F.lit(1), F.size("w") - j + 1), lambda i: _joined(F.col("w"), i, j))))
        holds = longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("held"))
        best = best.join(holds, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * inside)).drop("held")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # a language may hold most of the phrases: the first of each share, then the first of these
    share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_parts(docs.sparkSession)))
    few = flat.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
pieces AS (SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS pn FROM texts),
split AS (SELECT d, lang, pn, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT d, lang, pn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split),
led AS (SELECT lang, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM words WINDOW x AS (PARTITION BY d, pn ORDER BY i)),
grams AS (SELECT lang, 1 AS k, w AS phrase FROM led UNION ALL SELECT lang, 2, w || ' ' || w2 FROM led WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM led WHERE w3 IS NOT NULL),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, unnest(range(1, k)) AS j FROM candidates c),
scored AS (SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN counts r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.w[c.j + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.f IS NULL OR 100 * h.f < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

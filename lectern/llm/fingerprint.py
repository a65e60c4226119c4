"""Order MinHash fingerprints, whose likeness follows the edit distance and not the shared set alone.

A text's tokens are its words, of whatever number; a run of more than LONGEST characters without white space is cut into
words of as many. Its k-mers (K tokens, with K - 1 marks put before and after the text, so that each edit changes K of them at
most) are numbered by occurrence, so repeats count. Each numbered k-mer's hash falls into one of 2 * TUPLES bins;
the smallest of each bin is selected (one permutation instead of many), and the minima of two
bins, put in the order of their places in the text, are hashed to one component of the signature. Two
texts share a component if they share both k-mers and their order.

All is done within a row by array functions, sorting packed integers (hash above, place below); nothing
is exploded. The next document's text comes from a window over id ranges with cuts at sampled quantiles, FINER for
each shuffle partition; each range also gets a copy of the row that follows its last one, so only one row a range is
sent twice.

Defined results: a null text is an empty one. An empty text has no components; it has likeness 1 to an
empty text and 0 to others; texts of one word are like others only if equal. Places have 30 bits, which no text exceeds
(a string's bytes are fewer than 2^31, and a word needs two). Ids that repeat are put in order of a hash of the text; null ids come last.
The only document of a table is its own next one. Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import shuffle_parts

K = 3
TUPLES = 32
LONGEST = 16
#: Ranges for each shuffle partition, so that few of them get much more than others; and of all.
FINER, MOST_RANGES = 16, 1 << 15
_PLACE = 30  # bits of a place
_MARK = 0x6D61726B


def _bound(x: Column, f) -> Column:
    """f of an expression that is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def signature(text: Column, k: int = K, tuples: int = TUPLES) -> Column:
    """Array of `tuples` components; null where both bins are empty."""
    low = F.lit((1 << _PLACE) - 1)
    high = F.lit(~((1 << _PLACE) - 1))
    bits = (2 * tuples).bit_length() - 1
    if 1 << bits != 2 * tuples:
        raise ValueError("tuples must be a power of 2")
    hashed = lambda x: F.shiftright(x, _PLACE)

    def numbered(s: Column) -> Column:  # s: (hash, place) of all k-mers, sorted
        steps = F.array(*[F.lit(1 << b) for b in range(_PLACE - 1, -1, -1)])
        same = lambda i, h: F.coalesce(hashed(F.get(s, i)) == h, F.lit(False))
        first = lambda i, h: F.aggregate(steps, i, lambda at, step: F.when((at >= step) & same(at - step, h), at - step).otherwise(at))
        occurrence = lambda v, i: F.when((i == 0) | ~same(i - F.lit(1), hashed(v)), F.lit(0)).otherwise(i - first(i, hashed(v)))
        # top bit cleared: the bin is in the highest of the remaining bits
        return F.transform(s, lambda v, i: F.xxhash64(hashed(v), occurrence(v, i)).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseAND(high).bitwiseOR(v.bitwiseAND(low)))

    def minima(s: Column) -> Column:  # s: sorted by bin, hash, place
        return F.filter(s, lambda v, i: (i == 0) | (F.shiftright(v, 63 - bits) != F.shiftright(F.get(s, i - F.lit(1)), 63 - bits)))

    def component(pair: Column) -> Column:
        a, b = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        return (
            F.when(F.size(pair) == 0, F.lit(None).cast("long"))
            .when(F.size(pair) == 1, F.xxhash64(hashed(a)))
            .when(a.bitwiseAND(low) <= b.bitwiseAND(low), F.xxhash64(hashed(a), hashed(b)))
            .otherwise(F.xxhash64(hashed(b), hashed(a)))
        )

    def kmers(tokens: Column) -> Column:
        hashes = F.transform(tokens, lambda x: F.xxhash64(x))
        at = lambda h, i: F.coalesce(F.get(h, i), F.lit(_MARK).cast("long"))
        ends = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(1 - k), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        pack = lambda h: F.transform(ends(h), lambda i: F.xxhash64(*[at(h, i + F.lit(j)) for j in range(k)]).bitwiseAND(high).bitwiseOR((i + F.lit(k - 1)).cast("long")))
        return _bound(hashes, pack)

    tokens = F.regexp_extract_all(text, F.lit(f"[^\\x09-\\x0D\\x20]{{1,{LONGEST}}}"), F.lit(0))
    least = _bound(F.sort_array(_bound(F.sort_array(kmers(tokens)), numbered)), minima)
    of = lambda m: F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), lambda j: _bound(F.filter(m, lambda v: F.shiftright(v, 64 - bits) == j), component))
    return _bound(least, of)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each component, dots for a missing one."""
    return F.array_join(F.transform(signature, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("........"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components, of those that either has."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    share = lambda p: F.when(
        F.exists(p, lambda x: x["a"].isNotNull() | x["b"].isNotNull()), F.size(F.filter(p, lambda x: x["a"] == x["b"])) / F.size(F.filter(p, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    ).otherwise(F.lit(1.0))
    return _bound(pairs, share)


def _constants(values: list, kind: str) -> Column:
    """A literal array, however long, as one value in the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _place(cuts: list[int], x: Column) -> Column:
    """How many of the sorted cuts are less than x, by halving; 0 for a null."""
    if not cuts:
        return F.lit(0)
    array = _constants(cuts, "long")
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - F.lit(1)) < x), at + step).otherwise(at))


def with_next(docs: DataFrame, cols: dict[str, Column], parts: int) -> DataFrame:
    """doc_id, the given columns of (doc_id, text), and next_<name> of each from the next row by descending doc_id."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    quantiles = base.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts)).alias("q")).first().q or []
    base = base.select("*", _place(sorted(set(quantiles)), F.col("doc_id")).alias("part"), F.xxhash64("text").alias("tie"))
    # the first row of each range, in the order of ids falling; a row a range
    tops = base.groupBy("part").agg(F.max(F.struct(F.col("doc_id"), (-F.shiftright(F.col("tie"), 1)).alias("low"))).alias("top")).orderBy(F.desc("part")).collect()
    if not tops:
        return base.select("doc_id", *[x.alias(n) for n, x in cols.items()], *[x.alias(f"next_{n}") for n, x in cols.items()])
    at = {r.part: (r.top.doc_id, r.top.low, tops[i - 1].part) for i, r in enumerate(tops)}  # the last wraps round to the first
    size = max(at) + 1
    lookup = lambda i, kind: F.get(_constants([at[p][i] if p in at else None for p in range(size)], kind), F.col("part"))
    is_top = F.col("doc_id").eqNullSafe(lookup(0, "long")) & (-F.shiftright(F.col("tie"), 1) == lookup(1, "long"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(lookup(2, "int").alias("part"), F.lit(True).alias("copy"))
    dealt = base.select("doc_id", "tie", *[x.alias(n) for n, x in cols.items()], F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "tie", *cols, F.col("to.part").alias("part"), F.col("to.copy").alias("copy"))
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), "tie")
    return dealt.select("doc_id", *cols, "copy", *[F.lead(n).over(order).alias(f"next_{n}") for n in cols]).filter(~F.col("copy")).drop("copy")


def fingerprints(docs: DataFrame, k: int = K, tuples: int = TUPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    both = with_next(docs, {"text": F.col("text"), "own": signature(F.col("text"), k, tuples)}, min(MOST_RANGES, FINER * shuffle_parts(docs.sparkSession)))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    done = both.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    done = done.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("edited"), k, tuples).alias("other"))
    return done.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))

"""Whether quotes and numbers really occur in their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.evidence import nfkc
from ..functions.predicates import percent
from ..functions.search import quotes_held
from ..functions.text import match_key, numbers, quote_variants


def _runs(words: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(h), lambda h: F.transform(starts, lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + F.lit(j)) for j in range(k)]))), F.lit(0))


def quotes_in_corpus(quotes: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """(item_id, doc_id) of each quote that a document holds as whole words.

    A quote's first words (all of a shorter one's) give a hash, and the documents' runs of as many words are joined on it,
    as ids and hashes alone; only lengths that quotes have are made. The texts are then read again for the pairs found.
    """
    q = quotes.select("item_id", match_key(F.col("text")).alias("quote")).filter("quote <> ''").withColumn("w", F.split("quote", " "))
    q = q.withColumn("k", F.least(F.size("w"), F.lit(words)))
    sizes = sorted(r.k for r in q.select("k").distinct().collect())  # `words` at most
    if not sizes:
        return quotes.select("item_id").limit(0).crossJoin(docs.select("doc_id").limit(0))
    heads = F.coalesce(*[F.when(F.col("k") == k, F.get(_runs(F.slice("w", 1, k), k), F.lit(0))) for k in sizes])
    made = F.flatten(F.array(*[_runs(F.col("w"), k) for k in sizes]))
    body = match_key(F.col("text"))
    runs = docs.select("doc_id", F.split(body, " ").alias("w")).select("doc_id", F.explode(F.array_distinct(made)).alias("head"))
    pairs = runs.join(q.select("item_id", heads.alias("head")), "head").select("item_id", "doc_id").distinct()
    whole = pairs.join(docs.select("doc_id", F.concat(F.lit(" "), body, F.lit(" ")).alias("body")), "doc_id").join(q.select("item_id", "quote"), "item_id")
    return whole.filter(F.contains("body", F.concat(F.lit(" "), "quote", F.lit(" ")))).select("item_id", "doc_id").distinct()


def grounded(quotes: DataFrame, sources: DataFrame, key: str, least: int = 4) -> DataFrame:
    """key, grounded, total, score: how many quotes (key, quote) of four characters or more their own source (key, text) holds, anywhere."""
    q = quotes.select(key, match_key(F.col("quote")).alias("quote"))
    both = q.join(sources.select(key, match_key(F.col("text")).alias("body")), key, "left")
    holds = (F.length("quote") >= least) & F.coalesce(F.contains("body", "quote"), F.lit(False))
    n = both.groupBy(key).agg(F.count(F.when(holds, 1)).alias("grounded"), F.count("*").alias("total"))
    return n.withColumn("score", F.round(percent(F.col("grounded"), F.col("total")), 2))


def _variants(df: DataFrame, text: str) -> DataFrame:
    """df with v, the forms in which a text is compared: composed alike, with and without hyphens at line ends, none of them empty."""
    forms = F.filter(quote_variants(nfkc(F.col(text))), lambda x: x != "")
    return df.select("*", F.explode(F.array(forms)).alias("v"))  # a generator, so that it is computed once


def validated(quotes: DataFrame, sources: DataFrame, key: str, least: int = 4) -> DataFrame:
    """quotes (key, quote, ...) with `held`: whether any form of four characters or more stands anywhere in any form of its own source (key, text).

    The forms of a source are made once for all of its quotes, of which there are as many as one paper's evidence has.
    """
    mine = _variants(quotes.withColumn("_id", F.monotonically_increasing_id()), "quote")
    asked = mine.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c) for c in quotes.columns if c != key], F.filter("v", lambda x: F.length(x) >= least).alias("v"))).alias("q"))
    both = asked.join(_variants(sources.select(key, "text"), "text").select(key, F.col("v").alias("forms")), key, "left")
    holds = lambda q: F.exists(q["v"], lambda x: F.exists(F.coalesce("forms", F.array().cast("array<string>")), lambda s: F.contains(s, x)))
    told = both.select(key, F.explode(F.transform("q", lambda q: F.struct(q.alias("q"), holds(q).alias("held")))).alias("x"))
    return told.select(key, *[F.col(f"x.q.{c}").alias(c) for c in quotes.columns if c != key], F.col("x.held").alias("held"))


def found_anywhere(quotes: DataFrame, docs: DataFrame, least: int = 4, most: int = 32_000_000) -> DataFrame:
    """(item_id, doc_id) of each quote (item_id, text) that a document holds in any form of both, within words too.

    All forms of quotes are looked for together in one pass over a document's forms, within its row (`search.quotes_held`), and only what is found leaves it. The quotes
    go to every task; those of more than `most` characters in all in blocks, each with one more reading of the documents.
    """
    q = _variants(quotes.select("item_id", F.col("text").alias("quote")), "quote").select("item_id", F.explode("v").alias("form")).filter(F.length("form") >= least)
    told = q.select("form").distinct().agg(F.sum(F.length("form") + 50)).first()[0]  # with what a quote takes besides its characters
    if not told:
        return quotes.select("item_id").limit(0).crossJoin(docs.select("doc_id").limit(0))
    blocks = -(-told // most)
    forms = _variants(docs.filter("doc_id is not null").select("doc_id", "text"), "text").select("doc_id", F.array_join("v", "\n").alias("forms"))

    def found(i: int) -> DataFrame:
        wanted = q.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == i) if blocks > 1 else q
        asked = sorted(r.form for r in wanted.select("form").distinct().collect())
        held = once(forms, "held", quotes_held(F.col("forms"), asked)).select("doc_id", F.explode("held").alias("form"))
        return held.join(F.broadcast(wanted), "form").select("item_id", "doc_id")

    return reduce(DataFrame.union, map(found, range(blocks))).distinct()


def unsupported_numbers(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key and each distinct number of its claims that its sources don't have. Both tables: (key, text)."""
    of = lambda df: df.select(key, F.explode(numbers(F.col("text"))).alias("number")).distinct()
    return of(claims).join(of(sources), [key, "number"], "left_anti")


def hallucination_rate(claims: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Claimed and unsupported numbers of each key, and the rate (0 without claims)."""
    claimed = claims.select(key, F.explode_outer(numbers(F.col("text"))).alias("number")).groupBy(key).agg(F.countDistinct("number").alias("claimed"))
    wrong = unsupported_numbers(claims, sources, key).groupBy(key).agg(F.count("*").alias("unsupported"))
    both = claimed.join(wrong, key, "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(0)))
    return both.withColumn("rate", F.when(F.col("claimed") == 0, 0.0).otherwise(F.col("unsupported") / F.col("claimed")))

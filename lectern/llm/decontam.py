"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity to it, so MinHash on whole documents
can't find it. Items are therefore partitioned by size: those of 2^(c-1) < n <= 2^c shingles form class
c. For each class a document's shingle sequence is cut into tiles of 2^c shingles, and windows of two
adjacent tiles are sketched; every span as long as an item lies inside a window, and a window has four
times an item's size at most, which bounds the similarity from below. A sketch is a one-permutation
MinHash: the smallest hash in each of BINS bins. An item is a candidate for a document if any bin of any
window agrees; it is then verified on full sets: the share of the item's distinct shingles that occur in
the document.

With BINS several times an item's shingles nearly each shingle has a bin of its own, so the chance that
an item with 80 % of its shingles present agrees in no bin is below 1e-6 from three shingles on. Items
of one or two shingles, for which that doesn't hold, get windows of one shingle, where every hash is a
minimum: their candidates are exact.

Words are runs of characters other than white space, A-Z in lower case. Items shorter than the shingle
are one shingle of all their words, matched against runs of as many words. The benchmark is cut into
blocks of BLOCK_SHINGLES at most (a longer item stands alone); if there are several, each is broadcast, searched and
removed in turn, so what is broadcast has a bound.

Defined results: null texts, and items or documents without words, match nothing. Repeated rows of
documents or items give repeated results. A null doc_id is reported as null; `clean` decides each row by its
text, so null and repeated ids don't matter. Extra columns are ignored by `contaminated` and kept by `clean`,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import BLOCK, checkpointed, distinct, mix, row_blocks, shingles, utf8, words

SHINGLE = 5
SHARE = 0.8
BINS = 256
BLOCK_SHINGLES = 1_000_000
_SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_found int, containment double"


def _bin_minima(window: np.ndarray, value: np.ndarray, bins: int) -> np.ndarray:
    """Distinct (bin, smallest value) of each window, as one 64-bit value each; the bin is the value's remainder."""
    key_bin = value % np.uint64(bins)
    order = np.lexsort((value, key_bin, window))
    w, b = window[order], key_bin[order]
    first = np.ones(len(order), bool)
    first[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
    return np.unique(value[order][first])


class Block:
    """Some items, indexed for the search. items: (item_id, distinct shingles, words in a shingle)."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], bins: int = BINS):
        self.ids = [i for i, _, _ in items]
        self.sizes = np.array([len(s) for _, s, _ in items])
        self.bins = bins
        self.parts = []  # width of a shingle, size of a tile, sorted minima, which item has each
        by = defaultdict(list)
        for k, (_, s, width) in enumerate(items):
            by[width, 1 << int(len(s) - 1).bit_length() if len(s) > 2 else 0].append(k)
        for (width, tile), own in sorted(by.items()):
            minima = [_bin_minima(np.zeros(len(items[k][1]), np.int64), items[k][1], bins) for k in own]
            key, item = np.concatenate(minima), np.repeat(own, [len(m) for m in minima])
            order = np.argsort(key, kind="stable")
            self.parts.append((width, tile, key[order], item[order]))
        # for verification: every shingle of every item
        key, item = np.concatenate([s for _, s, _ in items]), np.repeat(np.arange(len(items)), self.sizes)
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Row, item and shingles found, for each candidate."""
        row, word = words(raw, offsets)
        out = []
        for width in sorted({p[0] for p in self.parts}):
            at, value = shingles(row, word, width)
            short = np.bincount(row, minlength=len(offsets) - 1) < width
            if short.any():  # fewer words than the shingle: no run of that many words
                at, value = at[keep := ~short[at]], value[keep]
            if len(value) == 0:
                continue
            n = len(offsets) - 1
            first = np.searchsorted(at, np.arange(n))
            place = np.arange(len(at)) - first[at]
            found = []
            for _, tile, key, item in (p for p in self.parts if p[0] == width):
                hit = self._agreeing(at, place, value, tile, key)
                for lo, hi, r in zip(np.searchsorted(key, hit[1], "left"), np.searchsorted(key, hit[1], "right"), hit[0], strict=True):
                    found.append((np.full(hi - lo, r), item[lo:hi]))
            if not found:
                continue
            pairs = np.unique(np.concatenate([r for r, _ in found]) * len(self.ids) + np.concatenate([i for _, i in found]))
            rows = np.unique(pairs // len(self.ids))
            # exact: the distinct shingles of the candidate documents that occur in any item, counted by item
            mine = np.isin(at, rows)
            r, v = distinct(at[mine], value[mine])
            lo, hi = np.searchsorted(self.key, v, "left"), np.searchsorted(self.key, v, "right")
            has = np.flatnonzero(hi > lo)
            count = (hi - lo)[has]
            into = np.repeat(lo[has], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            both, n_found = np.unique(np.repeat(r[has], count) * len(self.ids) + self.item[into], return_counts=True)
            is_pair = np.isin(both, pairs)
            out.append((both[is_pair] // len(self.ids), both[is_pair] % len(self.ids), n_found[is_pair]))
        return out

    def _agreeing(self, at, place, value, tile, key) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of the windows' bin minima that are minima of an item as well."""
        if tile == 0:
            hit = np.isin(value, key)
            return at[hit], value[hit]
        # only values that an item has as a minimum matter, and the bins and windows in which they lie
        wanted = np.flatnonzero(np.isin(value, key))
        if len(wanted) == 0:
            return at[:0], value[:0]
        touched = np.zeros(int(at[-1]) + 1, bool)
        touched[at[wanted]] = True
        near = np.flatnonzero(touched[at])
        r, p, v = at[near], place[near] // tile, value[near]
        r2, w2, v2 = np.concatenate([r, r]), np.concatenate([p, np.maximum(p - 1, 0)]), np.concatenate([v, v])
        b2 = v2 % np.uint64(self.bins)
        order = np.lexsort((v2, b2, w2, r2))
        r2, w2, b2, v2 = r2[order], w2[order], b2[order], v2[order]
        first = np.ones(len(order), bool)
        first[1:] = (r2[1:] != r2[:-1]) | (w2[1:] != w2[:-1]) | (b2[1:] != b2[:-1])
        r2, v2 = r2[first], v2[first]
        hit = np.isin(v2, key)
        return r2[hit], v2[hit]


def item_shingles(ids: list[int], texts: list[str], k: int = SHINGLE) -> list[tuple[int, np.ndarray, int]]:
    """Each item that has words, with its distinct shingles and the words in one."""
    raw, offsets = utf8(pa.array([t or "" for t in texts], pa.string()))
    row, word = words(raw, offsets)
    count = np.bincount(row, minlength=len(ids))
    out = []
    for width in range(1, k + 1):
        some = np.flatnonzero(count >= k if width == k else count == width)
        mine = np.isin(row, some)
        r, v = distinct(*shingles(row[mine], word[mine], width))
        out += [(ids[i], v[r == i], width) for i in some]
    return out


def _blocks(benchmark: DataFrame, k: int, bins: int) -> Iterator[Block]:
    """The items in blocks of BLOCK_SHINGLES at most, unless a single item has more."""

    def items() -> Iterator[tuple[int, np.ndarray, int]]:
        chunk: list = []
        size = 0
        for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():  # one partition at a time
            chunk.append(r)
            size += len(r.text or "") + 1
            if size > BLOCK:
                yield from item_shingles([c[0] for c in chunk], [c[1] for c in chunk], k)
                chunk, size = [], 0
        yield from item_shingles([c[0] for c in chunk], [c[1] for c in chunk], k)

    held: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for item in items():
        if held and size + len(item[1]) > BLOCK_SHINGLES:
            yield Block(held, bins)
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield Block(held, bins)


def _held(block: Block, raw: np.ndarray, offsets: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, item, its size and what was found of it, for each row of the texts that holds an item."""
    for i, j in row_blocks(offsets, BLOCK):
        for row, item, n in block.find(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            size = block.sizes[item]
            keep = n >= share * size - 1e-9
            yield row[keep] + i, item[keep], size[keep], n[keep]


def _searched(docs: DataFrame, shared, share: float) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for row, item, size, n in _held(block, *utf8(batch.column("text")), share):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_key").take(at), batch.column("doc_id").take(at), pa.array([block.ids[x] for x in item], pa.int64()), pa.array(size.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(n / size)],
                    ["text_key", "doc_id", "item_id", "n_item_shingles", "n_found", "containment"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(of, f"text_key long, {_SCHEMA}")


def _found(docs: DataFrame, blocks: Iterator[Block], share: float) -> DataFrame:
    """What all blocks find. A single block is searched lazily; of several each is searched at once, and its broadcast removed."""
    found: list[DataFrame] = []
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found.append(_searched(docs, shared, share))
        if after is not None or len(found) > 1:
            found[-1] = checkpointed(found[-1])
            shared.destroy()
        block = after
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], f"text_key long, {_SCHEMA}")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, k: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_found, containment: a row for each document that holds an item."""
    return _found(docs, _blocks(benchmark, k, bins), share).drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, k: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Each row is decided by its own text, whatever its id."""
    blocks = _blocks(benchmark, k, bins)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    names = docs.columns
    place = names.index("text")
    if second is None:  # nothing is joined
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for row, *_ in _held(shared.value, *utf8(batch.column(place)), share):
                    stays[row] = False
                yield batch.filter(pa.array(stays))

        return docs.mapInArrow(keep, docs.schema)
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    bad = _found(own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), chain((first, second), blocks), share)
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return own.join(bad, F.col(doc_id).cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(text) == F.col("bad_key")), "left_anti").toDF(*names)


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, any_value(n)::INT AS n_item_shingles, count(*)::INT AS n_found, count(*) / any_value(n) AS containment
FROM s JOIN i USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n)
"""

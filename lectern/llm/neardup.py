"""MinHash near-dedup with an LSH forest of sorted signature orders, and an exact search where it is crowded.

1. A document's set is its distinct 4-word shingles, as 64-bit hashes. Documents of equal sets form one
   class, and only classes go on, so a group of exact copies, however large, is one node.
2. Each class has a signature of HASHES MinHash values. Each of TREES trees puts LENGTH of them into an order of
   its own, the first ones in no other tree, and all classes are sorted by it: range partitions over (tree, label),
   sorted, so that classes with a long common prefix are neighbours. Ranges are of equal size, as the class
   itself ends the key; what a cut between two ranges parts is handled like a crowded region.
3. Neighbours in the sorted orders, which have the longest common prefixes, are confirmed first, in FIRST trees, and so are
   the members of each crowded region with its pivot, the member whose labels agree most with what is most frequent. Classes
   that these links connect have one star, and need no further link among themselves.
   The depth of a region depends on how many classes it holds. Where at most CROWD share the first SHALLOW values, all their
   pairs of different stars are candidates; where more do, those that share DEEP values, if they are CROWD at most (a pair of
   similarity 0.8 is missed by all trees with 0.00005 at DEEP, 0.000002 at SHALLOW). Those more crowded yet are left to 4.
4. Crowded regions that hold several stars still are searched exactly, by prefix filtering: with shingles
   in an order of rarity, two sets of the wanted similarity share one that is early in both. So how crowded
   a region is costs no recall, and a group of near copies costs links in proportion to its size.
5. Candidates of different stars whose signatures agree too little for the threshold (by PRUNE standard errors), or
   whose sizes rule it out, are dropped; the others are confirmed on full sets: 100 * intersection >= 80 *
   union. Only documents with candidates are read again; a bitmap of fixed size keeps most others out.
6. Components by stars within partitions of links, and alternating large-star and small-star steps between them.

Defined results: a null text, or one without words, has an empty set and is linked with nothing. Fewer
than four words make one shingle. Rows are linked by their texts, whatever their ids; a component's id is the
smallest doc_id in it, and null if it has none. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import BLOCK, checkpointed, distinct, mix, row_blocks, shingles, shuffle_parts, utf8, words

SHINGLE = 4
SHARE = 0.8
HASHES = 128
CROWD = 16
PRUNE = 8.0
TREES, SHALLOW, DEEP, LENGTH = 25, 4, 5, 8
FIRST = 4
#: Rows of one range of the sorted orders, about.
RANGE = 1 << 20
SALT = 16
#: Links of one partition, about.
EDGES = 1 << 19
#: What is told of sorted ranges.
SOME, NEXT, MANY = range(3)
#: Counters of the exact search's order. Shingles that share one differ in their place only, not in what is found.
COUNTERS = 1 << 20
#: Bits of the bitmap of documents to read again: 4 MB, whatever the input.
BITMAP = 1 << 25

_random = np.random.Generator(np.random.PCG64(5))
_FACTORS = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Which values make a tree's label, in order.
_ORDERS = np.array([[*range(DEEP * t, DEEP * t + DEEP), *(h for h in _random.permutation(HASHES) if not DEEP * t <= h < DEEP * t + DEEP)][:LENGTH] for t in range(TREES)])
_KEY = 1 + 2 * LENGTH + 8  # bytes: tree, label, node


def sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, sorted."""
    return distinct(*shingles(*words(raw, offsets), k))


def _digests(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A digest of each row's set; the rows that have one, and where they start."""
    some = np.flatnonzero(n)
    digest = np.zeros(len(n), np.uint64)
    cut = np.r_[0, np.cumsum(n[some])[:-1]].astype(np.int64)
    if len(some):
        digest[some] = mix(np.add.reduceat(mix(value), cut) ^ np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5)), cut) * np.uint64(3) ^ n[some].astype(np.uint64))
    return digest.view(np.int64), some, cut


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for i, j in row_blocks(offsets, BLOCK):
            row, value = sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.bincount(row, minlength=j - i)
            digest, some, cut = _digests(row, value, n)
            signature = np.zeros((j - i, HASHES), np.uint16)
            for h in range(HASHES if len(some) else 0):
                least = np.minimum.reduceat(((value ^ _MASKS[h]) * _FACTORS[h]) >> np.uint64(16), cut)
                signature[some, h] = mix(least).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_key")), pa.array(n), pa.array(digest), pa.array([x.tobytes() if m else None for x, m in zip(signature, n, strict=True)], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "signature"],
            )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and tree the bytes to sort by: tree, label, node."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            signature = _signatures(part.column("signature"))
            out = np.empty((len(signature), TREES, _KEY), np.uint8)
            out[:, :, 0] = np.arange(TREES)
            out[:, :, 1:-8] = np.ascontiguousarray(signature[:, _ORDERS].astype(">u2")).view(np.uint8)
            out[:, :, -8:] = np.ascontiguousarray(part.column("node").to_numpy().astype(">i8")).view(np.uint8).reshape(-1, 1, 8)
            at = pa.array(np.arange(len(signature) * TREES + 1, dtype=np.int32) * _KEY)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(signature) * TREES, [None, at.buffers()[1], pa.py_buffer(out)])], ["key"])


def _fit(key: np.ndarray, region: np.ndarray) -> np.ndarray:
    """How many values of each key's label are the most frequent ones at their places in its region."""
    fit = np.zeros(len(key), np.int16)
    value = np.ascontiguousarray(key[:, 1:-8]).view(">u2").astype(np.int64)
    for j in range(LENGTH if len(key) else 0):
        order = np.lexsort((value[:, j], region))
        r, v = region[order], value[order, j]
        start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
        count = np.diff(np.r_[start, len(r)])
        first = np.flatnonzero(np.r_[True, r[start][1:] != r[start][:-1]])
        most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.r_[first, len(start)]))
        fit[order] += np.repeat(count == most, count)
    return fit


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one sorted range tells, as (kind, a, b, fit): members (node, region) of regions of a few classes and of crowded ones, and pairs of neighbours."""
    held = []
    for batch in batches:
        column = batch.column("key")
        held.append(np.frombuffer(column.buffers()[2], np.uint8)[column.offset * _KEY : (column.offset + len(column)) * _KEY].reshape(-1, _KEY))
    if not held or not sum(map(len, held)):
        return
    key = np.concatenate(held)
    n = len(key)
    same = np.minimum.accumulate(key[1:, :-8] == key[:-1, :-8], axis=1).sum(axis=1)
    depth = np.r_[0, (same - 1) // 2]  # values that a key shares with the one before it
    node = np.ascontiguousarray(key[:, -8:]).view(">i8").ravel().astype(np.int64)

    def runs(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, depth[1:] < least])
        size = np.diff(np.r_[start, n])
        cut = np.zeros(len(start), bool)
        cut[[0, -1]] = True  # may go on in another range
        return start, size, (size <= CROWD) & ~cut

    def regions(at: np.ndarray, values: int) -> np.ndarray:
        prefix = np.zeros((len(at), 16), np.uint8)
        prefix[:, : 1 + 2 * values] = key[at, : 1 + 2 * values]
        prefix = prefix.view(np.uint64)
        return mix(prefix[:, 0] ^ mix(prefix[:, 1] + np.uint64(values << 32))).view(np.int64)

    start, size, few = runs(SHALLOW)
    done = np.repeat(few, size)
    shallow = np.flatnonzero(np.repeat(few & (size > 1), size))
    start, size, few = runs(DEEP)
    rest = ~done[start]
    deep = np.flatnonzero(np.repeat(rest & few & (size > 1), size))
    crowded = np.flatnonzero(np.repeat(rest & ~few, size))
    next_to = np.flatnonzero((depth >= SHALLOW) & (key[:, 0] < FIRST))
    some = np.r_[shallow, deep]
    fit = _fit(key[crowded], np.repeat(np.arange(len(start)), size)[crowded])
    told = (
        (SOME, node[some], np.r_[regions(shallow, SHALLOW), regions(deep, DEEP)], np.zeros(len(some), np.int16)),
        (NEXT, np.minimum(node[next_to - 1], node[next_to]), np.maximum(node[next_to - 1], node[next_to]), np.zeros(len(next_to), np.int16)),
        (MANY, node[crowded], regions(crowded, DEEP), fit),
    )
    for kind, *columns in told:
        for i in range(0, len(columns[0]), 1 << 16):
            x = [c[i : i + (1 << 16)] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), kind, np.int8)), *map(pa.array, x)], ["kind", "a", "b", "fit"])


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of all sets fall on each counter; one row for each counter that has some."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for x in batch.column("x"):
            np.add.at(n, (np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    for i in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(n[at[i : i + (1 << 16)]])], ["counter", "n"])


def _ordered(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _both(pairs: DataFrame, table: DataFrame, col: str, *more: str) -> DataFrame:
    """pairs (a, b) with col of either node, as xa and xb."""
    left, right = (table.select(F.col("node").alias(c), F.col(col).alias(f"x{c}")) for c in ("a", "b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb")


class Forest:
    """The classes of a table of documents, and confirmation of pairs of them."""

    def __init__(self, docs: DataFrame, share: float = SHARE):
        self.base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.share = share
        text_key = F.xxhash64("text").alias("text_key")
        self.rows = checkpointed(self.base.select("*", text_key).mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, node long, signature binary"))
        # equal sets have equal signatures
        own = self.rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature"))
        self.classes = checkpointed(own)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose sizes and hash values allow a link."""
        least = (self.share - PRUNE * (self.share * (1 - self.share) / HASHES) ** 0.5) * HASHES
        near = F.least("xa.n", "xb.n") * 100 >= F.greatest("xa.n", "xb.n") * round(100 * self.share)
        both = _both(pairs, self.classes.select("node", F.struct("n", "signature").alias("x")), "x").filter(near).select("a", "b", F.col("xa.signature").alias("sa"), F.col("xb.signature").alias("sb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = (_signatures(batch.column("sa")) == _signatures(batch.column("sb"))).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        return both.mapInArrow(run, "a long, b long")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """node and its full set. Texts come from a second scan; a bitmap leaves most other documents out of it."""
        wanted = nodes.join(self.classes.select("node", "first_doc"), "node").select("first_doc").distinct()
        bit = F.pmod(F.xxhash64("first_doc"), F.lit(BITMAP))
        parts = wanted.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()  # BITMAP bits at most
        bits = np.zeros(BITMAP // 8 + 4096, np.uint8)
        for r in parts:  # bit x lies in bucket 1 + (x - 1) div 32768 at position (x - 1) mod 32768; bit 0 in bucket 0
            if r.k >= 1:
                bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
        zero = any(r.k < 1 for r in parts)
        shared = self.base.sparkSession.sparkContext.broadcast((bits, zero))

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, zero = shared.value
            for batch in batches:
                x = batch.column("bit").fill_null(0).to_numpy()
                hit = np.where(x == 0, zero, (bits[np.maximum(x - 1, 0) >> 3] >> (np.maximum(x - 1, 0) & 7).astype(np.uint8)) & 1 > 0)
                batch = batch.filter(pa.array(hit))
                raw, offsets = utf8(batch.column("text"))
                for i, j in row_blocks(offsets, BLOCK):
                    row, value = sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    n = np.bincount(row, minlength=j - i)
                    digest, some, _ = _digests(row, value, n)
                    at = np.r_[0, np.cumsum(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(digest[some]), pa.array([value[at[r] : at[r + 1]].tobytes() for r in some], pa.binary())], ["node", "x"])

        found = self.base.select(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("bit"), "text").mapInArrow(full, "node long, x binary")
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""
        pairs = checkpointed(self.likely(pairs))
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        full = checkpointed(self.sets_of(checkpointed(ends)))  # so that the joins can split a node with many pairs
        numerator = round(100 * self.share)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                    s, t = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    if len(s) > len(t):
                        s, t = t, s
                    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    both = int((t[at] == s).sum())
                    keep.append(100 * both >= numerator * (len(s) + len(t) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return checkpointed(_both(pairs, full, "x").mapInArrow(run, "a long, b long"))

    def exact(self, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of (node, star) with different stars, all similar ones among them, by prefix filtering.

        The order of the shingles is by how many of the nodes have them, as far as the counters tell. A set
        and a larger one share a shingle that is in the first part of the smaller, which leaves 2 * share /
        (1 + share) of it, and in that of the larger, which leaves share; and what follows it in either is
        enough for the similarity. A shingle alone on its counter is in one set only and needs no row.
        """
        numerator = round(100 * self.share)
        full = checkpointed(self.sets_of(nodes.select("node")).join(nodes, "node"))  # read twice
        counted = full.select("x").mapInArrow(_counters, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()  # COUNTERS rows at most
        often = np.zeros(COUNTERS, np.int64)
        often[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
        shared = self.base.sparkSession.sparkContext.broadcast(often)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = shared.value
            for batch in batches:
                for node, star, x in zip(batch.column("node").to_pylist(), batch.column("star").to_pylist(), batch.column("x"), strict=True):
                    value = np.frombuffer(x.as_buffer(), np.uint64)
                    size = len(value)
                    seen = often[(value % np.uint64(COUNTERS)).astype(np.int64)]
                    order = np.lexsort((value, seen))[: size + numerator * size // -100 + 1]
                    at = np.flatnonzero(seen[order])
                    early = at <= size + 2 * numerator * size // -(100 + numerator)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value[order[at]].view(np.int64)), *(pa.array(np.full(len(at), v, np.int64)) for v in (node, star)), pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(early)],
                        ["shingle", "node", "star", "size", "at", "early"],
                    )

        rows = checkpointed(full.mapInArrow(prefixes, "shingle long, node long, star long, size int, at int, early boolean"))
        # Shingles of one star only can't give a pair. Of the others, the star with most of a shingle's rows is compared with the
        # other stars' rows, and these with each other, so that rows of a large star don't meet; the join makes just the pairs that are enough
        by_star = rows.groupBy("shingle", "star").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("star", F.struct("n", "star")).alias("most"), F.count("*").alias("n")).filter("n > 1")
        rows = checkpointed(rows.join(by_star.select("shingle", "most"), "shingle").withColumn("main", F.col("star") == F.col("most")).drop("most"))
        against = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        less = rows.filter("early").select("shingle", F.explode(against).alias("main"), "star", F.col("node").alias("a"), F.col("size").alias("na"), F.col("at").alias("ia"))
        more = rows.select("shingle", "main", F.col("star").alias("other"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("at").alias("ib"))
        enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + numerator) >= numerator * (F.col("na") + F.col("nb"))
        return less.join(more, ["shingle", "main"]).filter((F.col("star") != F.col("other")) & (F.struct("na", "a") < F.struct("nb", "b")) & enough).select(*_ordered("a", "b")).distinct()

    def links(self) -> DataFrame:
        """Confirmed pairs (a, b) of nodes that connect all similar classes."""
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        parts = max(shuffle_parts(self.base.sparkSession), -(-self.classes.count() * TREES // RANGE))
        keys = self.classes.select("node", "signature").mapInArrow(_keys, "key binary")
        told = checkpointed(keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_neighbours, "kind byte, a long, b long, fit short"))
        # the member that is most like all others, by its labels in all crowded regions, is each region's pivot
        many = told.filter(F.col("kind") == MANY).select(F.col("a").alias("node"), F.col("b").alias("region"), "fit")
        central = many.groupBy("node").agg(F.sum("fit").alias("fit"))
        pivots = many.drop("fit").join(central, "node").groupBy("region").agg(F.max_by("node", F.struct("fit", "node")).alias("pivot")).select("region", "pivot", salts)
        by_pivot = many.withColumn("salt", F.pmod("node", F.lit(SALT)).cast("int")).join(pivots, ["region", "salt"]).filter("node <> pivot").select(*_ordered("node", "pivot"))
        linked = self.confirmed(told.filter(F.col("kind") == NEXT).select("a", "b").unionByName(by_pivot).distinct())
        # what these links connect has one star, and needs no further link
        star = checkpointed(components(linked.toDF("u", "v")).withColumnRenamed("component", "star"))
        members = told.filter(F.col("kind") != NEXT).select("kind", F.col("a").alias("node"), F.col("b").alias("region"))
        members = checkpointed(members.join(star, "node", "left").withColumn("star", F.coalesce("star", "node")))
        some = members.filter(F.col("kind") == SOME).groupBy("region").agg(F.min("star").alias("low"), F.max("star").alias("high"), F.sort_array(F.collect_set(F.struct("node", "star"))).alias("all"))  # CROWD at most
        pairs = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda y: y["star"] != x["star"]), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
        near = some.filter("low <> high").select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
        many = members.filter(F.col("kind") == MANY)
        mixed = many.groupBy("region").agg(F.min("star").alias("low"), F.max("star").alias("high")).filter("low <> high")
        # a region may hold a large share of all classes, so its members are dealt out by a salt
        salted = mixed.select("region", salts)
        crowded = checkpointed(many.withColumn("salt", F.pmod("node", F.lit(SALT)).cast("int")).join(salted, ["region", "salt"], "left_semi").select("node", "star").distinct())
        return linked.unionByName(self.confirmed(near if crowded.isEmpty() else near.unionByName(self.exact(crowded)).distinct()))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one partition as stars: each node with the smallest that it reaches by them."""
    held = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches]
    node, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *held], axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    least = np.arange(len(node))
    while True:
        low = np.minimum(least[u], least[v])
        new = least.copy()
        for end in (least[u], least[v], u, v):  # the roots of both ends, and the ends themselves
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    own = np.flatnonzero(least < np.arange(len(node)))
    for i in range(0, len(own), 1 << 16):
        at = own[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[least[at]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each node of (u, v) that isn't the smallest of its own.

    Edges are put into partitions of about EDGES, each of which is made into stars by itself; where there are several, alternating
    large-star and small-star steps connect them, and it begins again, until nothing changes.
    """
    last = None
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = state
        parts = -(-state.n // EDGES)
        edges = edges.coalesce(max(1, parts)).mapInArrow(_contracted, "u long, v long")
        if parts <= 1:  # all of them met
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: neighbours above a node go to the least of its neighbours and itself
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())


def _named(forest: Forest) -> DataFrame:
    """All rows of the forest with their class's first_doc, whether the class is its component's first one, and the component's first doc_id."""
    label = components(forest.links().toDF("u", "v"))
    parts = checkpointed(label.unionByName(label.select(F.col("component").alias("node"), "component").distinct()))
    first = parts.join(forest.classes.select("node", "first_doc"), "node").groupBy("component").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "node")).alias("first"))
    leads = parts.join(first, "component").select("node", F.col("first.first_doc").alias("component_id"), (F.col("node") == F.col("first.node")).alias("leads"), F.lit(True).alias("linked"))
    # of classes without links only those of several rows say more than the rows do
    classes = forest.classes.select("node", "first_doc").join(leads, "node", "left")
    classes = classes.select("node", "first_doc", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_doc")).alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"))
    return forest.rows.select("doc_id", "text_key", "n_shingles", "node").join(classes, "node", "left")


def near_duplicates(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    named = _named(Forest(docs, share)).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return named.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the document with the smallest id.

    Each row is decided by its own id and text, so rows that share an id with one that goes may stay. Where no row of a
    component has an id, one text of it stays, once. Rows without words stay.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    named = _named(Forest(docs, share)).filter("n_shingles > 0")
    least = named.filter("first_doc is null and leads").groupBy("node").agg(F.min("text_key").alias("least_key"))
    named = named.join(least, "node", "left")
    stays = F.col("leads") & F.when(F.col("first_doc").isNull(), F.col("text_key") == F.col("least_key")).otherwise(F.coalesce(F.col("doc_id") == F.col("first_doc"), F.lit(False)))
    gone = named.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    own = own.withColumn("text_key", F.xxhash64(text))
    left = own.join(gone, doc_id.cast("long").eqNullSafe(F.col("gone_id")) & F.col("text_key").eqNullSafe(F.col("gone_key")), "left_anti")
    worded = F.coalesce(text.rlike("[^ \\t-\\r]"), F.lit(False))
    # equal rows without an id have nothing to tell them apart; the scan for them skips what has ids
    once = left.filter(doc_id.isNull() & worded).dropDuplicates(["text_key"])
    return left.filter(doc_id.isNotNull() | ~worded).unionByName(once).drop("text_key").toDF(*names)


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i+3], ' ')) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
i AS (SELECT c, n, unnest(s) AS x FROM c),
e AS (SELECT a.c AS u, b.c AS v FROM i a JOIN i b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT c AS node, c AS reach FROM c UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
k AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON k.node = c.c
"""

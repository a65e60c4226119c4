"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text, with a space put before it as usual, is cut into units: spaces and what follows up to the next
space. No piece of the vocabulary crosses units, so sampling unit by unit is exact. For each distinct
unit of a block the lattice of pieces is built by walking a byte trie from all positions at once;
forward filtering sums the probability of all segmentations up to each position; backward sampling then
draws, for every occurrence, a piece that ends where the last drawn one starts, until the unit's start.
All steps are over arrays; a unit is also cut where no piece of its lattice passes over, and one longer than LONG, which has
no spaces in it, is gone through in windows, byte by byte, with the same draws. The draw at a position is a hash of the seed, the row's key and the position,
so it doesn't depend on how rows are batched, and equal rows are segmented alike.

The model file holds merge ranks and no probabilities; rank r is read as 1 / (r + 2) (Zipf's law),
raised to SHARPNESS. Characters without a piece become byte pieces, so decoding restores each text.

Defined results: a null or empty text has no pieces and decodes to the empty text. Rows repeat as in
the input, whatever other columns there are. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import BYTE, mix, row_blocks, span_hashes, utf8

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
SHARPNESS = 1.0
UNIT_BLOCK = 1 << 18
#: Units of more bytes go through windows of so many.
LONG, WINDOW = 1 << 16, 1 << 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = -1


@dataclass
class Vocabulary:
    """A trie over bytes in an open-addressed table, and what decoding needs. A space stands for the mark."""

    keys: np.ndarray  # node * 256 + byte
    nodes: np.ndarray
    piece: np.ndarray  # of each node, or -1
    log_p: np.ndarray  # of each piece
    byte_ids: np.ndarray
    byte_log_p: float
    blob: np.ndarray  # the bytes of all pieces
    at: np.ndarray

    @property
    def longest(self) -> int:
        return max(4, int(np.diff(self.at).max()))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node, or -1."""
        want = node.astype(np.int64) * 256 + byte
        mask = len(self.keys) - 1
        slot = ((want.astype(np.uint64) * _GOLD) >> np.uint64(40)).astype(np.int64) & mask
        got = self.keys[slot]
        out = np.where(got == want, self.nodes[slot], -1)
        left = np.flatnonzero((got != want) & (got != _EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            got = self.keys[slot[left]]
            hit = got == want[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (got != _EMPTY)]
        return out


def load(path: str = MODEL_PATH, sharpness: float = SHARPNESS) -> Vocabulary:
    """Read a model file on the driver; what is broadcast is bounded by the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    text = {i: sp.id_to_piece(i).replace("▁", " ").encode() for i in normal}
    for x in text.values():
        if b" " in x.lstrip(b" "):
            raise ValueError("a piece crosses words")
    rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
    weight = np.zeros(n)
    weight[normal] = [1 / (rank[i] + 2) for i in normal]
    floor = 1 / (len(normal) + 2)
    total = weight.sum() + 256 * floor
    log_p = np.full(n, -np.inf)
    log_p[normal] = sharpness * np.log(weight[normal] / total)
    children: dict[int, int] = {}
    piece = [-1]
    for i in normal:
        node = 0
        for b in text[i]:
            nxt = children.get(node * 256 + b)
            if nxt is None:
                nxt = children[node * 256 + b] = len(piece)
                piece.append(-1)
            node = nxt
        piece[node] = i
    size = 1 << (4 * len(children) - 1).bit_length()
    keys, nodes = np.full(size, _EMPTY, np.int64), np.zeros(size, np.int32)
    for k, v in children.items():
        slot = ((k * int(_GOLD) & (2**64 - 1)) >> 40) & (size - 1)
        while keys[slot] != _EMPTY:
            slot = (slot + 1) & (size - 1)
        keys[slot], nodes[slot] = k, v
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    out = [text.get(i, b"") for i in range(n)]
    for b in range(256):
        out[byte_ids[b]] = bytes([b])
    return Vocabulary(keys, nodes, np.array(piece, np.int32), log_p, byte_ids, float(sharpness * np.log(floor / total)), np.frombuffer(b"".join(out), np.uint8), np.cumsum([0] + [len(x) for x in out]))


def _lattice(v: Vocabulary, raw: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Edges of the lattices of some units, put end to end: first node, last node, piece (-1: bytes), log p; and the nodes' offset."""
    ends = np.cumsum(length)
    n = int(ends[-1])
    unit = np.repeat(np.arange(len(length)), length)
    offset = np.arange(n) - np.repeat(ends - length, length)
    data = raw[np.repeat(start, length) + offset]
    left = np.repeat(length, length) - offset
    node_of = np.arange(n) + unit  # each unit has one node more than bytes
    active = np.flatnonzero((data & 0xC0) != 0x80)
    char = 1 + (data[active] >= 0xC0).astype(np.int64) + (data[active] >= 0xE0) + (data[active] >= 0xF0)
    char = np.minimum(char, left[active])
    leads, single = active, np.zeros(n, bool)
    char_of = np.zeros(n, np.int64)
    char_of[leads] = char
    state = np.zeros(len(active), np.int64)
    firsts, lasts, pieces = [], [], []
    depth = 0
    while len(active):
        state = v.step(state, data[active + depth])
        depth += 1
        alive = state >= 0
        active, state = active[alive], state[alive]
        p = v.piece[state]
        has = p >= 0
        a = active[has]
        firsts.append(node_of[a])
        lasts.append(node_of[a] + depth)
        pieces.append(p[has])
        single[a[char_of[a] == depth]] = True
        more = left[active] > depth
        active, state = active[more], state[more]
    raw_chars = leads[~single[leads]]
    firsts.append(node_of[raw_chars])
    lasts.append(node_of[raw_chars] + char_of[raw_chars])
    pieces.append(np.full(len(raw_chars), -1, np.int32))
    first, last, piece = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(pieces)
    log_p = np.where(piece >= 0, v.log_p[piece], (last - first) * v.byte_log_p)
    return first, last, piece, log_p, np.r_[0, ends] + np.arange(len(length) + 1)


def _filtered(first: np.ndarray, last: np.ndarray, piece: np.ndarray, log_p: np.ndarray, node_at: np.ndarray):
    """Edges by last node, longer pieces first, each with the cumulated probability of being drawn there; and where a node's start.

    A node that no edge passes over lies on every path, so what stands before it doesn't matter for what follows. Units
    are cut there, and all parts are filtered side by side, one byte further at a time.
    """
    first, last, piece, log_p = (x[::-1] for x in (first, last, piece, log_p))
    n = int(node_at[-1])
    over = np.bincount(first + 1, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1]
    start = np.cumsum(over)[:n] == 0
    since = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    alpha = np.zeros(n)  # of a node that starts a part it is 0, whatever comes before
    depth = last - since[first]
    order = np.argsort(depth * np.int64(n) + last, kind="stable")  # of equal ones the longer piece first
    first, last, piece, log_p, depth = (x[order] for x in (first, last, piece, log_p, depth))
    share = np.empty(len(first))
    cuts = np.r_[np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]), len(depth)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        f, to = first[i:j], last[i:j]
        score = alpha[f] + log_p[i:j]
        group = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        top = np.maximum.reduceat(score, group)
        sizes = np.diff(np.r_[group, j - i])
        e = np.exp(score - np.repeat(np.where(np.isfinite(top), top, 0.0), sizes))
        total = np.add.reduceat(e, group)
        at = to[group]
        alpha[at] = np.where(start[at], 0.0, np.where(total > 0, top + np.log(np.maximum(total, 1e-300)), -np.inf))
        c = np.cumsum(e)
        base = np.r_[0.0, c[group[1:] - 1]]
        part = (c - np.repeat(base, sizes)) / np.repeat(np.maximum(total, 1e-300), sizes)
        part[np.r_[group[1:] - 1, j - i - 1]] = 1.0
        share[i:j] = part
    order = np.argsort(last, kind="stable")
    return first[order], last[order], piece[order], share[order], np.r_[0, np.cumsum(np.bincount(last, minlength=n))[:-1]]


def _window(v: Vocabulary, raw: np.ndarray, lo: int, hi: int, reach: int) -> tuple[list, ...]:
    """Edges of one unit that end in lo + 1..hi (both at characters), by their end: first byte, piece, log p; and where those of each end start."""
    begin = max(0, lo - reach)
    while (raw[begin] & 0xC0) == 0x80:
        begin += 1
    first, last, piece, log_p, _ = _lattice(v, raw, np.array([begin]), np.array([hi - begin]))
    first, last, piece, log_p = (x[::-1][last[::-1] > lo - begin] for x in (first, last, piece, log_p))
    order = np.lexsort((first, last))  # longer pieces first, as in short units
    first, last, piece, log_p = (x[order] for x in (first, last, piece, log_p))
    at = np.searchsorted(last + begin, np.arange(lo + 1, hi + 2))
    return (first + begin).tolist(), piece.tolist(), log_p.tolist(), at.tolist()


def _long_unit(v: Vocabulary, raw: np.ndarray, seed: int, place: int) -> list[tuple[int, int, int]]:
    """(first byte, last byte, piece) of the pieces drawn for one unit, which starts at a place of its row; in text order.

    The unit is gone through in windows, so besides one number a byte only a window's edges are held. Probabilities are
    multiplied as they are, and scaled from time to time.
    """
    n, reach = len(raw), v.longest
    inside = np.flatnonzero((raw & 0xC0) != 0x80)
    cuts = [0, *inside[np.searchsorted(inside, np.arange(WINDOW, n, WINDOW))[: (n - 1) // WINDOW].clip(max=len(inside) - 1)].tolist(), n]
    cuts = sorted(set(cuts))
    log_alpha = np.full(n + 1, -np.inf)
    log_alpha[0] = 0.0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        begin = max(0, lo - reach)
        scale = float(log_alpha[lo])
        alpha = np.exp(log_alpha[begin : lo + 1] - scale).tolist()
        shifts = []
        first, _, log_p, at = _window(v, raw, lo, hi, reach)
        p = np.exp(log_p).tolist()
        shift = scale
        for j in range(hi - lo):
            total = 0.0
            for e in range(at[j], at[j + 1]):
                total += alpha[first[e] - begin] * p[e]
            alpha.append(total)
            shifts.append(shift)
            if 0.0 < total < 1e-100:
                alpha[-reach:] = [x / total for x in alpha[-reach:]]
                shifts[-1] = shift = shift + math.log(total)
                for k in range(max(0, len(shifts) - reach), len(shifts)):
                    shifts[k] = shift
        with np.errstate(divide="ignore"):
            log_alpha[lo + 1 : hi + 1] = np.log(alpha[lo + 1 - begin :]) + shifts
    out = []
    end = n
    for lo, hi in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        if end <= lo:
            continue
        first, piece, log_p, at = _window(v, raw, lo, hi, reach)
        ends = np.arange(lo + 1, hi + 1)
        draws = ((mix(np.uint64(seed) + (ends + place).astype(np.uint64) * _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
        while end > lo:
            i, j = at[end - lo - 1], at[end - lo]
            weight = [float(log_alpha[first[e]]) + log_p[e] for e in range(i, j)]
            top = max(weight)
            weight = [math.exp(w - top) for w in weight]
            left = draws[end - lo - 1] * sum(weight)
            k = 0
            while k < len(weight) - 1 and weight[k] <= left:
                left -= weight[k]
                k += 1
            out.append((first[i + k], end, piece[i + k]))
            end = first[i + k]
    return out[::-1]


def encode(v: Vocabulary, raw: np.ndarray, offsets: np.ndarray, row_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and where each row's start (n + 1). raw holds each non-empty row with a space before it."""
    n = len(raw)
    count = np.zeros(len(offsets), np.int64)
    if n == 0:
        return np.zeros(0, np.int32), count
    space = raw == 32
    begin = np.zeros(n, bool)
    begin[1:] = space[1:] & ~space[:-1]
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begin)
    ends = np.r_[starts[1:], n]
    row = np.searchsorted(offsets, starts, "right") - 1
    out = []
    long = np.r_[np.flatnonzero(ends - starts > LONG), len(starts)]
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > LONG:
            drawn = _long_unit(v, raw[starts[i] : ends[i]], int(row_seed[row[i]]), int(starts[i] - offsets[row[i]]))
            ids = [x for a, b, p in drawn for x in ((p,) if p >= 0 else v.byte_ids[raw[starts[i] + a : starts[i] + b]].tolist())]
            count[row[i]] += len(ids)
            out.append(np.array(ids, np.int32))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + UNIT_BLOCK, "right")))
        j = min(j, int(long[np.searchsorted(long, i)]))
        out.append(_sampled(v, raw, starts[i:j], ends[i:j], row[i:j], offsets, row_seed, count))
        i = j
    return np.concatenate(out), np.cumsum(np.r_[0, count[:-1]])


def _sampled(v, raw, starts, ends, row, offsets, row_seed, count) -> np.ndarray:
    _, which, back = np.unique(span_hashes(raw, starts, ends, BYTE), return_index=True, return_inverse=True)
    length = (ends - starts)[which]
    *edges, node_at = _lattice(v, raw, starts[which], length)
    first, last, piece, drawn, edge_at = _filtered(*edges, node_at)
    base = starts[0]
    chosen = np.full(int(ends[-1] - base) + 1, -2, np.int64)  # by last byte: -2 none, else the edge
    shift = starts - node_at[back]  # from node to byte position
    node = node_at[back] + (ends - starts)
    root = node_at[back]
    seed, zero = row_seed[row], offsets[row]
    while len(node):
        at = node + shift
        u = (mix(seed + (at - zero).astype(np.uint64) * _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = edge_at[node]
        past = np.flatnonzero(drawn[edge] <= u)
        while len(past):
            edge[past] += 1
            past = past[drawn[edge[past]] <= u[past]]
        chosen[at - base] = edge
        node = first[edge]
        on = node > root
        if not on.all():
            node, root, shift, seed, zero = (x[on] for x in (node, root, shift, seed, zero))
    at = np.flatnonzero(chosen >= 0)
    edge = chosen[at]
    size = np.where(piece[edge] >= 0, 1, (last - first)[edge])
    ids = np.repeat(piece[edge], size)
    wide = np.flatnonzero(piece[edge] < 0)
    if len(wide):
        into = np.flatnonzero(ids < 0)
        k = size[wide]
        begin = at[wide] + base - k
        ids[into] = v.byte_ids[raw[np.repeat(begin, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]]
    rows = np.searchsorted(offsets, at + base - 1, "right") - 1
    count += np.bincount(rows, size, len(count)).astype(np.int64)
    return ids.astype(np.int32)


def decode(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts: the pieces' bytes, without the space put before."""
    size = np.diff(v.at)[ids]
    ends = np.r_[0, np.cumsum(size)][at]
    parts = [np.zeros(0, np.uint8)]
    for i in range(0, len(ids), UNIT_BLOCK):
        n = size[i : i + UNIT_BLOCK]
        parts.append(v.blob[np.repeat(v.at[ids[i : i + UNIT_BLOCK]] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    raw = np.concatenate(parts)
    some = np.diff(ends) > 0
    keep = np.ones(len(raw), bool)
    keep[ends[:-1][some]] = False
    return raw[keep], np.r_[0, np.cumsum(np.diff(ends) - some)]


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row that isn't empty with a space before it."""
    some = np.diff(offsets) > 0
    new = offsets + np.r_[0, np.cumsum(some)]
    out = np.full(int(new[-1]), 32, np.uint8)
    put = np.ones(len(out), bool)
    put[new[:-1][some]] = False
    out[put] = raw
    return out, new


def tokenize(docs: DataFrame, model_path: str = MODEL_PATH, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, n_pieces, ids, lossless (whether decoding gives the text back); one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path, sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            raw_all, offsets_all = utf8(batch.column("text"))
            key = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            seeds = mix(mix(key + np.uint64(seed)) + _GOLD)
            for i, j in row_blocks(offsets_all, UNIT_BLOCK):
                raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
                ids, at = encode(v, *spaced(raw, offsets), seeds[i:j])
                back, back_at = decode(v, ids, at)
                same = np.diff(back_at) == np.diff(offsets)
                if not (same.all() and np.array_equal(back, raw)):
                    same &= [back[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(back_at, back_at[1:], offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)],
                    ["doc_id", "n_pieces", "ids", "lossless"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces int, ids array<int>, lossless boolean")


def detokenize(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            at = np.cumsum([0] + [len(x or ()) for x in lists])
            raw, offsets = decode(v, np.array([y for x in lists for y in x or ()], np.int32), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

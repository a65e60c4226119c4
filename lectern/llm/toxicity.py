"""Toxicity: a support vector machine on a subsequence string kernel, with Nystrom landmarks.

The kernel of two words compares their subsequences of three characters that span SPAN characters at
most; each character skipped costs a factor DECAY. It is normalised to 1 for equal words, so inserted, dropped and
changed characters lower it gradually. Marks inside a word, and spaces between single
letters, are dropped before. A sentence is compared with a landmark by its best word, which is how the kernel gets from words to
sentences. The Nystrom map turns a sentence's values for all landmarks into features of a
linear machine; only words near a toxic landmark count.

Toxic landmarks are words that stand in more different contexts in toxic than in clean documents, chosen
at a false-discovery rate; contexts, as copies of one document would count a chance word often. Words of fewer than four bytes
have too few subsequences to be told from others and are no landmarks. A landmark that no common clean word comes near is
specific: it reaches as far as those words allow, so altered insults count like plain ones. Clean
landmarks are the most frequent clean words within the reach of a toxic one.

A document's score is a logistic function of its worst sentence, of what all its sentences tell, as words that clean
documents have once are many in toxic ones, and of its best match with a specific landmark. It is fitted on the training
documents and on virtual ones, each of one altered landmark. The fit is on the driver, from a bounded sample of the labelled
rows, taken by the hash of the id: MAX_ROWS of either class and MAX_TOTAL bytes, of whole texts. Scoring reads every whole
text in blocks; of a block's distinct words only those that an upper bound of the kernel doesn't rule out are compared exactly.

Defined results: null and empty texts have the score of a text with no word near a landmark. Without
labels of both classes, or without landmarks, each score is the share of toxic labels (0 without any).
Repeated rows are scored each; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import BLOCK, BYTE, checkpointed, crc_mod, mix, row_blocks, runs, span_hashes, utf8

#: Labelled rows of either class in the fit, and bytes of all their texts; beyond either a uniform sample is taken, of whole texts.
MAX_ROWS = 1_500
MAX_TOTAL = 12_000_000
LANDMARKS = 160
#: Contexts from which a clean word is common.
COMMON = 3
#: Weight of the virtual documents in the calibration, as a share of the toxic ones.
VIRTUAL = 0.1
#: How much worse than a false alarm it is to miss a toxic document.
CATCH = 3.0
SPAN = 6
DECAY = 0.8
#: Kernel values below a landmark's floor count as 0, and at its full value as 1. A landmark that common clean words don't come
#: near reaches as far as they allow, from LEAST up to MOST, and rises to 1 within RISE. The others rise by POWER from FLOOR.
FLOOR, POWER = 0.5, 4
LEAST, MOST, RISE = 0.4, 0.7, 0.08
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True
_JOINED = _LETTER.copy()
_JOINED[[ord(c) for c in "*@$#_-.'"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the accented capitals of Latin-1 in lower case."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    out[accented] += 32
    return out


def word_list(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words without marks, each word's start and end in them, its row and its sentence."""
    raw = lowered(raw)
    starts, ends = runs(raw, offsets, _JOINED)
    kept = _LETTER[raw]
    before = np.r_[0, np.cumsum(kept)]
    letters = raw[kept]
    s, e = before[starts], before[ends]
    some = e > s
    starts, ends, s, e = starts[some], ends[some], s[some], e[some]
    row = np.searchsorted(offsets, starts, "right") - 1
    sentence = np.r_[0, np.cumsum(_STOP[raw])][starts] if len(raw) else starts
    if len(s):
        # single letters set apart become one word
        single = e - s == 1
        chained = np.zeros(len(s), bool)
        chained[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1]) & (starts[1:] - ends[:-1] <= 2)
        s, last, row, sentence = s[~chained], np.r_[np.flatnonzero(~chained)[1:], len(s)] - 1, row[~chained], sentence[~chained]
        e = e[last]
    return letters, s, e, row, sentence


def subsequences(word: bytes) -> dict[bytes, float]:
    out: dict[bytes, float] = {}
    for i in range(len(word)):
        for j, k in _GAPS:
            if i + k < len(word):
                u = bytes((word[i], word[i + j], word[i + k]))
                out[u] = out.get(u, 0.0) + DECAY ** (k - 2)
    return out


def kernel(a: dict[bytes, float], b: dict[bytes, float]) -> float:
    return sum(x * b.get(u, 0.0) for u, x in a.items())


@dataclass
class Model:
    words: list[bytes]  # the landmarks: the first n_bad ones are toxic, and only words near one of them count
    n_bad: int
    weights: np.ndarray  # of the landmarks' kernel values, the Nystrom map folded in
    bias: float
    slopes: tuple[float, ...]  # of the calibration
    shift: float
    floors: np.ndarray  # of the landmarks
    specific: np.ndarray  # whether no common clean word comes near

    def prepare(self) -> None:
        """Tables for comparing many words with all landmarks at once."""
        phi = [subsequences(w) for w in self.words]
        self.norms = np.array([kernel(p, p) ** 0.5 for p in phi])
        seen = sorted({c for w in self.words for c in w})
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.base = len(seen) + 1
        by: dict[int, list[tuple[int, float]]] = {}
        for m, p in enumerate(phi):
            for u, x in p.items() if m < self.n_bad else ():
                a, b, c = self.code[list(u)]
                by.setdefault(int((a * self.base + b) * self.base + c), []).append((m, x / self.norms[m]))
        keys = sorted(by)
        self.lookup = np.full(self.base**3, -1, np.int32)
        self.lookup[keys] = np.arange(len(keys))
        self.count = np.array([len(by[k]) for k in keys], np.int64)
        self.first = np.r_[0, np.cumsum(self.count)[:-1]].astype(np.int64)
        self.mark = np.array([m for k in keys for m, _ in by[k]], np.int64)
        self.value = np.array([x for k in keys for _, x in by[k]])
        self.most = np.array([max(x for _, x in by[k]) for k in keys])
        self.phi = phi
        self.cache: dict[bytes, np.ndarray | None] = {}

    def risen(self, z: np.ndarray) -> np.ndarray:
        """Kernel values with all landmarks as features from 0 to 1."""
        wide = np.clip((z - self.floors) / RISE + 0.1, 0.0, 1.0)
        return np.where(z >= self.floors, np.where(self.specific, wide, z**POWER), 0.0)

    def near(self, letters: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are near a landmark, and their kernel values with all landmarks."""
        n = e - s
        ok = np.flatnonzero(n >= 3)
        if len(ok) == 0 or not self.words:
            return ok[:0], np.zeros((0, len(self.words)))
        n, s = n[ok], s[ok]
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(ok)), n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        code = self.code[letters[np.repeat(s, n) + place]]
        left = np.repeat(n, n) - place
        bound = np.zeros(len(ok))
        hits = []
        for j, k in _GAPS:
            at = np.flatnonzero(left > k)
            a, b, c = code[at], code[at + j], code[at + k]
            f = self.lookup[(a * self.base + b) * self.base + c]
            f[(a == 0) | (b == 0) | (c == 0)] = -1
            has = f >= 0
            f, w = f[has], owner[at[has]]
            bound += DECAY ** (k - 2) * np.bincount(w, self.most[f], len(ok))
            hits.append((w, f, DECAY ** (k - 2)))
        # a word's norm is the least where all its subsequences differ
        least = np.sqrt(sum(np.maximum(n - k, 0) * DECAY ** (2 * (k - 2)) for _, k in _GAPS))
        maybe = np.flatnonzero(bound >= self.floors.min() * least)
        if len(maybe) == 0:
            return maybe, np.zeros((0, len(self.words)))
        to = np.full(len(ok), -1)
        to[maybe] = np.arange(len(maybe))
        m = self.n_bad
        top = np.zeros(len(maybe) * m)
        for w, f, x in hits:
            w = to[w]
            f, w = f[w >= 0], w[w >= 0]
            count = self.count[f]
            into = np.repeat(self.first[f], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            top += np.bincount(np.repeat(w, count) * m + self.mark[into], x * self.value[into], len(top))
        sure = np.flatnonzero((top.reshape(-1, m) >= self.floors[:m] * least[maybe, None] - 1e-9).any(axis=1))
        found, values = [], []
        for i in maybe[sure].tolist():
            word = letters[s[i] : s[i] + n[i]].tobytes()
            if word not in self.cache:
                if len(self.cache) > 100_000:
                    self.cache.clear()
                p = subsequences(word)
                z = np.array([kernel(q, p) for q in self.phi]) / self.norms / kernel(p, p) ** 0.5
                self.cache[word] = self.risen(z) if (z >= self.floors)[: self.n_bad].any() else None
            if (z := self.cache[word]) is not None:
                found.append(ok[i])
                values.append(z)
        return np.array(found, np.int64), np.array(values).reshape(-1, len(self.words))

    def sentences(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and kernel values of each sentence that has a word near a landmark."""
        letters, s, e, row, sentence = word_list(raw, offsets)
        if len(s) == 0:
            return row, np.zeros((0, len(self.words)))
        _, first, back = np.unique(span_hashes(letters, s, e, BYTE), return_index=True, return_inverse=True)
        which, values = self.near(letters, s[first], e[first])
        into = np.full(len(first), -1)
        into[which] = np.arange(len(which))
        has = np.flatnonzero(into[back] >= 0)
        if len(has) == 0:
            return row[:0], np.zeros((0, len(self.words)))
        cut = np.flatnonzero(np.r_[True, (row[has][1:] != row[has][:-1]) | (sentence[has][1:] != sentence[has][:-1])])
        return row[has[cut]], np.maximum.reduceat(values[into[back[has]]], cut)

    def evidence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each row the decision value of its worst sentence, where beyond the margin, at 1, more doesn't count; how much all
        sentences tell; and the best value for a specific landmark."""
        row, z = self.sentences(raw, offsets)
        f = np.minimum(z @ self.weights + self.bias, 1.0)
        worst, sure = np.full(len(offsets) - 1, min(self.bias, 1.0)), np.zeros(len(offsets) - 1)
        np.maximum.at(worst, row, f)
        np.maximum.at(sure, row, np.where(f > 0, z[:, self.specific].max(axis=1, initial=0.0), 0.0))
        return np.c_[worst, np.log1p(np.bincount(row, np.maximum(0.0, f), len(worst))), sure]

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(raw, offsets) @ np.array(self.slopes) + self.shift, -35, 35)))


def landmarks(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, most: int = LANDMARKS, fdr: float = 0.05, lift: float = 5.0) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Words in more different contexts in toxic than in clean rows, at a false-discovery rate; and their clean neighbours.

    Neighbours are words near a landmark that stand in clean rows: the most frequent ones, half as many at most.
    """
    letters, s, e, row, _ = word_list(raw, offsets)
    if len(s) < 3:
        return [], [], np.zeros(0), np.zeros(0, bool)
    h = span_hashes(letters, s, e, BYTE)
    before, after = np.r_[0, h[:-1]].astype(np.uint64), np.r_[h[1:], 0].astype(np.uint64)
    context = mix(before * np.uint64(3) + mix(after))
    bad = toxic[row].astype(bool)
    words, first, back = np.unique(h, return_index=True, return_inverse=True)
    _, one = np.unique(mix(h + mix(context)), return_index=True)  # each word and context once; by its first row
    t, c = (np.bincount(back[one][bad[one] == x], minlength=len(words)).astype(float) for x in (True, False))
    share = t.sum() / max(1.0, t.sum() + c.sum())
    n = t + c
    rate = t / n
    with np.errstate(divide="ignore", invalid="ignore"):  # Chernoff's bound of the binomial tail
        log_p = -n * (rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0.0))
    lifted = t * (c.sum() + 1) >= lift * (c + 0.5) * (t.sum() + 1)
    log_p[~lifted | (t < 2) | (e[first] - s[first] < 4)] = 0
    order = np.argsort(log_p, kind="stable")
    ranks = np.arange(1, len(order) + 1)
    good = np.flatnonzero(log_p[order] <= np.log(fdr * ranks / len(order)))
    chosen = order[: min(most, good[-1] + 1 if len(good) else 0)]
    bad = [letters[s[first[i]] : e[first[i]]].tobytes() for i in chosen]
    model = Model(bad, len(bad), np.zeros(len(bad)), 0.0, (0.0, 0.0, 0.0), 0.0, np.full(len(bad), LEAST), np.zeros(len(bad), bool))
    model.prepare()
    near, z = model.near(letters, s[first], e[first])
    clean = (c[near] >= 1) & ~lifted[near]
    near, z = near[clean], z[clean] ** (1 / POWER)
    reach = 1.02 * z[c[near] >= COMMON].max(axis=0, initial=0.0)
    specific = reach <= MOST
    floors = np.where(specific, np.maximum(reach, LEAST), FLOOR)
    near = near[(z >= floors).any(axis=1)]
    near = near[np.lexsort((words[near], -c[near]))][: most // 2]
    return bad, [letters[s[first[i]] : e[first[i]]].tobytes() for i in near], floors, specific


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    weight = weight / weight.sum()
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * weight[inside, None]
        hess = a.T @ x1[inside] + ridge * np.eye(len(w))
        new = np.linalg.solve(hess, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def train(raw: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, common: float | None = None) -> Model:
    """A model of labelled rows (toxic: 0 or 1). common: how many clean rows there are for a toxic one, where the rows are a sample by class."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    constant = Model([], 0, np.zeros(0), 0.0, (0.0, 0.0, 0.0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(0), np.zeros(0, bool))
    bad_words, clean_words, floors, specific = landmarks(raw, offsets, toxic) if 0 < share < 1 else ([], [], None, None)
    if not bad_words:
        constant.prepare()
        return constant
    words, m = bad_words + clean_words, len(bad_words)
    model = Model(words, m, np.zeros(len(words)), 0.0, (1.0, 0.0, 0.0), 0.0, np.r_[floors, np.full(len(clean_words), FLOOR)], np.r_[specific, np.zeros(len(clean_words), bool)])
    model.prepare()
    rows, z = [], []
    for i, j in row_blocks(offsets, BLOCK):
        r, v = model.sentences(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rows.append(r + i)
        z.append(v)
    rows, z = np.concatenate(rows), np.concatenate(z)
    phi = model.phi
    gram = np.array([[kernel(a, b) for b in phi] for a in phi]) / model.norms[:, None] / model.norms
    gram = gram**POWER
    val, vec = np.linalg.eigh(gram)
    keep = val > 1e-6 * val[-1]
    root = vec[:, keep] / np.sqrt(val[keep]) @ vec[:, keep].T
    # sentences with a word like a landmark take the document's label; weaker ones of toxic documents are left out
    bad = toxic[rows] == 1
    used = ~bad | (z[:, :m].max(axis=1, initial=0) >= 0.8**POWER)
    # and virtual sentences of one landmark with characters inserted, doubled or dropped
    virtual = np.array([v for w, wide in zip(bad_words, specific, strict=True) for v in altered(w, wide)], object)
    blob = np.frombuffer(b"".join(virtual), np.uint8)
    ends = np.cumsum([0] + [len(w) for w in virtual]).astype(np.int64)
    virtual = model.near(blob, ends[:-1], ends[1:])[1]
    x = np.r_[z[used] @ root, virtual @ root, np.zeros((1, len(words)))]
    y = np.r_[np.where(bad[used], 1.0, -1.0), np.ones(len(virtual)), -1.0]
    weight = np.r_[np.where(bad[used], 1 / max(1, bad[used].sum()), 0.7 / max(1, (~bad[used]).sum())), np.full(len(virtual), 0.5 / max(1, len(virtual))), 0.3]
    w, model.bias = _machine(x, y, weight)
    model.weights = root @ w
    # calibrated on the documents, and on virtual ones of one altered landmark
    f = np.minimum(virtual @ model.weights + model.bias, 1.0)
    alone = np.c_[f, np.log1p(np.maximum(0.0, f)), np.where(f > 0, virtual[:, model.specific].max(axis=1, initial=0.0), 0.0)]
    real = np.concatenate([model.evidence(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_blocks(offsets, BLOCK)])
    weight = np.r_[np.where(toxic == 1, CATCH, 1.0 if common is None else common * toxic.sum() / (1 - toxic).sum()), np.full(len(alone), CATCH * VIRTUAL * toxic.sum() / max(1, len(alone)))]
    *slopes, model.shift = _calibrated(np.r_[real, alone], np.r_[toxic, np.ones(len(alone))], weight)
    model.slopes = tuple(slopes)
    return model


def altered(word: bytes, widely: bool) -> list[bytes]:
    """A word of five ASCII letters or more with a character inserted, doubled or dropped; with two of them if widely."""
    if len(word) < 5 or max(word) >= 128:
        return []
    put = lambda w, i, k: w[:i] + (bytes([97 + (7 * i + 11 * k) % 26]) if k else w[i : i + 1]) + w[i:]
    drop = lambda w, i: w[:i] + w[i + 1 :]
    inside = range(1, len(word))
    out = [put(word, i, k) for i in inside for k in range(3)]
    if widely:
        out += [drop(word, i) for i in inside] + [put(put(word, j, 2), i, 1) for i in inside for j in inside if i <= j]
        out += [drop(drop(word, j), i) for i in inside for j in inside if i < j and len(word) >= 6]
    return sorted(set(out))


def _calibrated(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes, none below 0, and shift of a logistic function, slightly regularised."""
    x = np.c_[f, np.ones(len(f))]
    w = np.r_[np.ones(f.shape[1]), 0.0]
    some = np.ones(len(w), bool)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w[some] -= np.linalg.solve(h[np.ix_(some, some)], g[some])
        if (low := w[:-1] < 0).any():
            some[:-1] &= ~low
            w[:-1][low] = 0.0
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS, max_total: int = MAX_TOTAL) -> Model:
    known = labels.filter((crc_mod("doc_id", folds) != held) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(round((1 << 20) * min(1.0, max_rows / max(1, n.get(1, 0)))))).otherwise(F.lit(round((1 << 20) * min(1.0, max_rows / max(1, n.get(0, 0))))))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    # about max_rows ids of either class, so they can be broadcast; an id that repeats counts once
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id")
    sample = checkpointed(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    total = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    got: pd.DataFrame = sample.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < round((1 << 20) * min(1.0, max_total / max(1, total)))).toPandas()
    got = got.sort_values(["doc_id", "text", "toxic"], kind="stable")
    raw, offsets = utf8(pa.array(got.text, pa.large_string()))
    return train(raw, offsets, got.toxic.to_numpy(np.int64), n[0] / n[1] if n.get(0) and n.get(1) else None)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.n_bad, model.weights, model.bias, model.slopes, model.shift, model.floors, model.specific))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        model.prepare()
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            p = np.zeros(len(offsets) - 1)
            for i, j in row_blocks(offsets, BLOCK):
                p[i:j] = model.scores(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))), fit(docs, labels, folds, held))

"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters and digits, and runs of other visible characters; features are the hashes of
tokens and of pairs of adjacent tokens (a token that repeats gives one common feature), to BUCKETS
buckets. A document's vector has 1 + ln(count) for each feature and length 1. A score is the logistic
function of a sparse dot product.

The model is fitted on the driver from a bounded sample of the labelled rows, taken by the hash of the id: about MAX_ROWS,
with MAX_FEATURES features at most, of whole texts. Scoring reads every whole text, in blocks of rows, without a
shuffle. The driver sends one array of BUCKETS weights.

Defined results: null and empty texts are scored by the bias alone. Without labelled rows each score is
0.5; a single class gives a score near that class. Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import BLOCK, BYTE, SPACE, checkpointed, crc_mod, mix, row_blocks, runs, span_hashes, utf8

BUCKETS = 1 << 18
#: Labelled rows in the fit, and features of all of them; beyond either a uniform sample of the rows is taken.
MAX_ROWS = 5_000
MAX_FEATURES = 8_000_000
THRESHOLD = 0.3
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = ~_WORD & ~SPACE


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature, by row."""
    spans = [runs(raw, offsets, x) for x in (_WORD, _MARK)]
    starts, ends = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    token = span_hashes(raw, starts, ends, BYTE)
    row = np.searchsorted(offsets, starts, "right") - 1
    near = row[1:] == row[:-1]
    pair = np.where(token[1:] == token[:-1], np.uint64(7), mix(token[1:] * np.uint64(31) + token[:-1]))[near]
    key = np.concatenate([row, row[1:][near]]).astype(np.uint64) * np.uint64(buckets) + np.concatenate([token, pair]) % np.uint64(buckets)
    key.sort()
    if len(key) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    value = 1 + np.log(np.diff(np.r_[cut, len(key)]))
    row, bucket = (key[cut] // np.uint64(buckets)).astype(np.int64), (key[cut] % np.uint64(buckets)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    return row, bucket, value / norm[row]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over rows of (bucket, value, label), in the given order."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)  # the last is the bias, without l1
    penalty = np.full(buckets + 1, l1)
    penalty[-1] = 0

    def weight(at):
        w = -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, w)

    for _ in range(epochs):
        for bucket, value, label in rows:
            at, x = np.append(bucket, buckets), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(buckets + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Fit on about max_rows labelled rows outside the held-out fold."""
    known = labels.filter((crc_mod("doc_id", folds) != held) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    # about max_rows ids, so they can be broadcast; an id that repeats counts once
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for i, j in row_blocks(offsets, BLOCK):
                row, bucket, value = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("doc_id", "label")] + lists, ["doc_id", "label", "bucket", "value"])

    made = checkpointed(sample.mapInArrow(vectors, "doc_id long, label int, bucket array<int>, value array<float>"))
    total = made.agg(F.sum(F.size("bucket"))).first()[0] or 0
    got = made.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < round((1 << 20) * min(1.0, max_features / max(1, total)))).toArrow().combine_chunks()
    if got.num_rows == 0:
        return ftrl([], buckets)
    label_of, bucket, value = (got.column(c).chunk(0) for c in ("label", "bucket", "value"))
    ids = got.column("doc_id").to_numpy()
    order = np.lexsort((label_of.to_numpy(), ids, mix(ids.astype(np.int64).view(np.uint64))))
    at, buckets_flat, values_flat = bucket.offsets.to_numpy(), bucket.values.to_numpy(), value.values.to_numpy()
    # views of two flat arrays, so the sample is held once
    return ftrl([(buckets_flat[at[i] : at[i + 1]], values_flat[at[i] : at[i + 1]], label_of[int(i)].as_py()) for i in order], buckets)


def probabilities(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text of a column."""
    raw, offsets = utf8(text)
    total = np.zeros(len(offsets) - 1)
    for i, j in row_blocks(offsets, BLOCK):
        row, bucket, value = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(weights))
        total[i:j] = np.bincount(row, weights[bucket] * value, j - i)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.column("text"), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(place), *shared.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels, folds=folds, held=held)
    return score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))), model)

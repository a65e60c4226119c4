"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, a word's ends marked), most
frequent first; equal counts are put in order of the n-gram. A document's language is the one whose
profile has the smallest out-of-place distance: the sum over the document's n-grams of the difference in
rank, or of the profile size where the language's profile lacks the n-gram.

Counting is vectorised over code points: within a block the letters become dense codes, n-grams become
integers and are counted by sorting, in pieces of PIECE letters. Language profiles are sums over all
training rows: each task sends its counts once, Spark adds them up, and PROFILE rows a language come back.

Defined results: a null text, or one without letters, is `und` with score 0. Equal distances go to the
first language in order of name. With no training rows every document is `und`. Rows repeat as they are
in the input; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import crc_mod, row_blocks, utf8

PROFILE = 300
PIECE = 1 << 20
_BITS = 21
_TWO, _ONE = np.uint64(1 << 63), np.uint64(3 << 62)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense codes of the letters of all texts (0: no letter), where each text starts, and the letters by code."""
    lower = [t.lower() for t in texts]
    starts = np.cumsum([0] + [len(t) for t in lower])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen & _is_letter())
    dense = np.zeros(0x110000, np.uint32)
    dense[alphabet] = np.arange(1, len(alphabet) + 1)
    return dense[points], starts, np.r_[0, alphabet].astype(np.uint64)


def _packed(codes: np.ndarray, first: int, last: int, bits: int, kind: type) -> np.ndarray:
    """N-grams that start in first..last-1 of codes, which is one text with a 0 on either side."""
    x, y, z = (codes[first + i : last + i].astype(kind) for i in range(3))
    b = kind(bits)
    three = y != 0
    two = (x != 0) | (y != 0)
    one = x != 0
    top = kind(3 * bits)
    return np.concatenate([(x[three] << (b + b)) | (y[three] << b) | z[three], (kind(1) << top) | (x[two] << b) | y[two], (kind(2) << top) | x[one]])


def _counts(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one text, in order, with their counts."""
    kind = np.uint32 if 3 * bits + 2 <= 32 else np.uint64
    padded = np.zeros(len(codes) + 3, codes.dtype)
    padded[1:-2] = codes
    parts = []
    for at in range(0, len(codes) + 1, PIECE):
        grams = _packed(padded, at, min(at + PIECE, len(codes) + 1), bits, kind)
        if len(grams) == 0:
            continue
        grams.sort()
        cut = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        parts.append((grams[cut], np.diff(np.r_[cut, len(grams)])))
    if len(parts) == 1:
        return parts[0]
    return _merged(parts, kind)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _global(keys: np.ndarray, bits: int, alphabet: np.ndarray) -> np.ndarray:
    """Keys that mean the same in any block: code points, the length of the n-gram on top."""
    keys = keys.astype(np.uint64)
    size, mask = keys >> np.uint64(3 * bits), np.uint64((1 << bits) - 1)
    x, y, z = (alphabet[(keys >> np.uint64(bits * i)) & mask] for i in (2, 1, 0))
    b = np.uint64(_BITS)
    plain = (y << b) | z
    return np.where(size == 0, (x << (b + b)) | plain, np.where(size == 1, _TWO | plain, _ONE | z))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column("text")
    for i, j in row_blocks(utf8(texts)[1]):
        yield i, j, [t or "" for t in texts.slice(i, j - i).to_pylist()]


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram (a packed n-gram), rank from 0: the most frequent n-grams of each language of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j, texts in _blocks(batch):
                for lang in sorted(set(langs[i:j])):
                    codes, starts, alphabet = _coded([t for t, x in zip(texts, langs[i:j], strict=True) if x == lang])
                    bits = max(1, int(len(alphabet)).bit_length())
                    apart = np.insert(codes, starts[1:-1], 0)  # n-grams don't cross texts
                    keys, n = _counts(apart, bits)
                    held.setdefault(lang, []).append((_global(keys, bits, alphabet), n))
                    if len(held[lang]) >= 16:
                        held[lang] = [_merged(held[lang])]
        for lang, parts in held.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = labelled.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")  # as unsigned, like a document's own
    # the limit goes below the exchange, so each task sends its own first ones of a language
    ranked = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def identify(docs: DataFrame, model: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """lang_pred and score for each row of (doc_id, text, held_out). model: rows of profiles(), size a language."""
    langs = sorted({m[0] for m in model})
    keys = np.unique(np.array([m[1] for m in model], np.int64).view(np.uint64))
    ranks = np.full((len(keys) + 1, len(langs)), -1, np.int32)
    for lang, gram, rank in model:
        ranks[np.searchsorted(keys, np.array(gram, np.int64).view(np.uint64)), langs.index(lang)] = rank
    shared = docs.sparkSession.sparkContext.broadcast((langs, keys, ranks))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, keys, ranks = shared.value
        for batch in batches:
            found, score = [], []
            for _, _, texts in _blocks(batch):
                codes, starts, alphabet = _coded(texts)
                bits = max(1, int(len(alphabet)).bit_length())
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    grams, n = _counts(codes[a:b], bits)
                    if len(grams) == 0 or not langs:
                        found.append("und")
                        score.append(0.0)
                        continue
                    top = _global(grams[np.argsort(-n, kind="stable")[:size]], bits, alphabet)
                    at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
                    at[keys[at] != top] = len(keys)
                    theirs = ranks[at]
                    apart = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
                    best = int(np.argmin(apart))
                    found.append(langs[best])
                    score.append(1.0 - float(apart[best]) / (size * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 3, held: int = 1, size: int = PROFILE) -> DataFrame:
    """Learn from the rows outside the held-out fold, and predict every row."""
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    model = [tuple(r) for r in profiles(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), size).collect()]  # size rows a language
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, size)

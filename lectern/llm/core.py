"""What several training-data operators share: reading tables, cutting lineage, and vectorised word hashing.

The Arrow operators work straight on the UTF-8 buffer of a string column. Words are found with byte
masks and hashed with prefix sums, so no Python object is made for a word. All arrays are bounded by
BLOCK bytes of text (or by one word, if a single word is longer), whatever the length of a document.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    A private folder is used only where that setting is missing and the session is a single process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lectern-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


# ---------------------------------------------------------------- Arrow buffers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK * 4) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashing

_random = np.random.Generator(np.random.PCG64(11))
#: A random 64-bit value for each byte; LOWER gives A-Z the values of a-z.
BYTE = _random.integers(1, 2**64 - 1, 256, dtype=np.uint64)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

#: Separators of words: the space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def runs(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of wanted bytes; no run crosses a row."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = wanted[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        part = values[raw[at : ends[j - 1]]]
        up, down = _power(len(part) + 1)
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lower-cased (A-Z) hash of each word, a run of bytes other than SPACE."""
    starts, ends = runs(raw, offsets, ~SPACE)
    return np.searchsorted(offsets, starts, "right") - 1, span_hashes(raw, starts, ends)


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of k words, in text order; a row of fewer words gives one run of all."""
    if len(word) == 0:
        return row, word
    n = len(word)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    full = np.zeros(n, bool)
    if n >= k:
        full[: n - k + 1] = row[: n - k + 1] == row[k - 1 :]
    at = np.flatnonzero(full)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = (out ^ word[at + i]) * np.uint64(_BASE) + np.uint64(i + 1)
    rows = row[at]
    if (short := np.flatnonzero(count < k)).size:
        sums = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            sums[has] = (sums[has] ^ word[first[short[has]] + i]) * np.uint64(_BASE) + np.uint64(i + 1)
        rows = np.r_[rows, row[first[short]]]
        out = np.r_[out, mix(sums) ^ count[short].astype(np.uint64)]
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, mix(out)


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]

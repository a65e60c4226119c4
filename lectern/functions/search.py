"""Which of many quotes a text holds: all quotes in one pass over a text's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Bytes that are looked at together, and of a quote's beginning those that decide before it is compared as a whole.
_PART, _DECIDE = 1 << 20, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place on, as a number."""
    n = max(0, len(data) - k + 1)
    out = np.empty(n, f"<u{k}")
    for i in range(min(k, n)):
        out[i::k] = data[i : i + (n - i + k - 1) // k * k].view(f"<u{k}")
    return out


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where grams stand in a table of 2^bits."""
    width = 8 * grams.dtype.itemsize
    return (grams * grams.dtype.type(int(_ODD) & (1 << width) - 1)) >> grams.dtype.type(width - bits)


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more.astype(np.uint64)) * _ODD
    return h ^ (h >> np.uint64(29))


def _ends(grams: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number of the size, the first and the last gram of what stands at each place."""
    return _mixed(_mixed(size.astype(np.uint64), grams[at]), grams[at + size - grams.dtype.itemsize])


def _keys(grams: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number of all that stands at each place."""
    h, k, on, step = _ends(grams, at, size), grams.dtype.itemsize, np.arange(len(at)), 1
    while len(on := on[size[on] > (step + 1) * k]):
        h[on] = _mixed(h[on], grams[at[on] + step * k])
        step += 1
    return h


def _index(quotes: list[bytes]) -> list[dict]:
    """What is looked up, for quotes of 1, 2 to 3, 4 to 7, and 8 bytes or more: by their first 1, 2, 4 or 8 bytes, then by these, the last and the size, then by all."""
    made, width = [], np.array([1 << min(3, len(q).bit_length() - 1) for q in quotes])
    for k in (1, 2, 4, 8):
        if not len(ids := np.flatnonzero(width == k)):
            continue
        heads = [quotes[i][:_DECIDE] for i in ids]
        size = np.array([len(h) for h in heads])
        at, grams = np.r_[0, np.cumsum(size)[:-1]], _grams(np.frombuffer(b"".join(heads), np.uint8), k)
        first, keys = grams[at], _keys(grams, at, size)
        order = np.argsort(keys, kind="stable")
        bits = min(8 * k, 26, max(16, len(ids).bit_length() + 4))
        table = np.zeros(1 << bits, bool)
        table[_slots(first, bits)] = True
        pairs = np.unique(np.rec.fromarrays([first, size], names="first,size"))  # the sizes that go with a beginning
        starts, begins = np.unique(pairs["first"], return_index=True)
        made.append({"k": k, "bits": bits, "table": table, "first": starts, "begins": np.r_[begins, len(pairs)], "sizes": np.array(pairs["size"]), "ends": np.unique(_ends(grams, at, size)), "keys": keys[order], "ids": ids[order]})
    return made


def _among(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some values stand in a sorted array, and where."""
    i = np.minimum(np.searchsorted(of, values), len(of) - 1)
    there = np.flatnonzero(of[i] == values)
    return there, i[there]


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, with the number of the range."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[which]


def _looked_up(data: np.ndarray, most: int, x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places (the first `most` are looked at) and the quotes that stand there by their key."""
    grams = _grams(data, x["k"])
    at = np.flatnonzero(x["table"][_slots(grams[:most], x["bits"])])
    there, first = _among(grams[at], x["first"])
    which, pair = _spans(x["begins"][first], x["begins"][first + 1])
    at, size = at[there][which], x["sizes"][pair]
    within = at + size <= len(data)
    at, size = at[within], size[within]
    there, _ = _among(_ends(grams, at, size), x["ends"])
    at, size = at[there], size[there]
    keys = _keys(grams, at, size)
    which, i = _spans(np.searchsorted(x["keys"], keys, "left"), np.searchsorted(x["keys"], keys, "right"))
    return at[which], x["ids"][i]


def _found(data: np.ndarray, offsets: np.ndarray, quotes: list[bytes], index: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The row and the quote of each pair that holds, sorted, once each; rows end with a sign that no quote has."""
    got = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, len(data), _PART):
        for x in index:
            at, ids = _looked_up(data[a : a + _PART + _DECIDE], _PART, x)
            got.append(((np.searchsorted(offsets, a + at, "right") - 1) * len(quotes) + ids, a + at))
    pairs, places = (np.concatenate(x) for x in zip(*got))
    pairs, first = np.unique(pairs, return_index=True)
    rows, ids = np.divmod(pairs, max(1, len(quotes)))
    held = np.zeros(len(pairs), bool)
    for i, (row, q, p) in enumerate(zip(rows.tolist(), ids.tolist(), places[first].tolist())):
        quote = quotes[q]
        held[i] = data[p : p + len(quote)].tobytes() == quote or quote in data[offsets[row] : offsets[row + 1]].tobytes()
    return rows[held], ids[held]


def quotes_held(c: Column, quotes: list[str]) -> Column:
    """array<string>: those of some distinct quotes without line ends, none of them empty, that stand anywhere in a text. An Arrow function: SQL has to look for each of them on its own."""
    plain = [q.encode() for q in quotes]
    index = _index(plain)

    @F.arrow_udf(ArrayType(StringType()))
    def held(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.string()))
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        rows, ids = _found(data, offsets - offsets[0], plain, index)
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(texts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([quotes[i] for i in ids.tolist()], pa.string()))

    return held(F.concat(c, F.lit("\n")))

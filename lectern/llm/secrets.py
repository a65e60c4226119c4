"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Candidates are maximal runs of at least SHORTEST characters of [A-Za-z0-9+/_-]. Two questions are asked:

1. Could it be random? The encoding is inferred from the characters (decimal, hex, letters of one case, base32,
   base36, base64), and three tests are made under uniform draws from its alphabet: chi-squared of the symbol counts,
   the number of runs of one character class (where the alphabet has several), and the serial correlation of the
   symbols' values. Their smallest p-value, times their number, is the battery's.
2. Could it be a natural word, path or name? There, the character class (lower, upper, digit, other) seldom
   changes, and the pairs of characters within a class are common ones. The rate q of changes and the share of
   each pair are measured over all runs of whatever length in the corpus. The first p-value is the binomial tail
   of the changes seen; the second is the Chernoff bound of the tail of the pairs' surprise (the sum of -log of
   their shares). The smaller one, times two, is the run's; runs of one class have the second only to speak for them.
   A corpus of few characters says nothing of pairs, as each of them counts once more than it was seen.

Both p-values go through Benjamini-Hochberg in each stratum of length, over all runs of the corpus in it: a run is
reported if the battery doesn't reject randomness at ALPHA and the tail rejects nature at FDR. So longer runs need
not pay for the many short ones. p-values enter as classes of an eighth of a decade, by their upper ends, so
that what the driver gets is a count for each stratum and class, whatever the corpus; lengths are the true ones.

The texts are read once: the first pass emits spans and candidates, and counts; the second adds the tails to the
checkpointed candidates; the last step is a projection.

Defined results: a null text has no spans. Offsets are code points, ends exclusive. Rows repeat as in
the input; extra columns are ignored. An empty table gives no rows. A text of any length is scanned whole; a run
may be as long as it. Equal p-values are rejected together.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import checkpointed, row_blocks, runs, utf8

SHORTEST = 20
#: Least lengths of the strata, doubling to what a text can hold.
STRATA = (20, 28, 40, *(1 << b for b in range(6, 32)))
ALPHA, FDR = 0.001, 0.01
#: Classes of p-values: CLASSES a decade, down to 10 ** -DECADES.
CLASSES, DECADES = 8, 400
# Fixed patterns of the contract.
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs, so the same matches as of [0-9a-f]+ with 24 characters or more
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")

#: Class of each byte in a candidate: 1 lower, 2 upper, 3 digit, 4 other; 0 isn't in a candidate.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[ord(c) for c in "+/_-"]] = 4
#: Number of a byte among the characters of candidates, and which pairs of these are of one class.
PLACE = np.cumsum(CLASS > 0) - 1
SYMBOLS = int((CLASS > 0).sum())
SAME = np.equal.outer(CLASS[CLASS > 0], CLASS[CLASS > 0]).ravel()
#: Exponents at which the Chernoff bound is taken.
LAMBDAS = np.arange(1, 41) / 40
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = (("decimal", _DIGITS), ("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("letters", _LOWER), ("letters", _UPPER), ("base32", _UPPER + "234567"), ("base36", _LOWER + _DIGITS), ("base36", _UPPER + _DIGITS), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _tables() -> list[tuple[str, np.ndarray, int]]:
    out = []
    for name, alphabet in _ALPHABETS:
        place = np.full(256, -1, np.int16)
        place[list(alphabet.encode())] = np.arange(len(alphabet))
        out.append((name, place, len(alphabet)))
    return out


_TABLES = _tables()


def battery(token: np.ndarray) -> tuple[str, float]:
    """Inferred encoding of a run of bytes, and the Bonferroni-adjusted smallest p-value of the three tests under randomness."""
    present = np.flatnonzero(np.bincount(token, minlength=256))
    for name, place, k in _TABLES:
        if (place[present] >= 0).all():
            break
    else:
        return "none", 0.0
    x, n = place[token].astype(np.int64), len(token)
    # chi-squared, standardised by its exact mean and variance under the multinomial
    chi = k / n * float((np.bincount(x, minlength=k).astype(float) ** 2).sum()) - n
    p = [0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2))]
    shares = np.bincount(CLASS[np.flatnonzero(place >= 0)], minlength=5) / k
    change = 1 - float((shares**2).sum())
    if 0 < change < 1:
        classes = CLASS[token]
        seen = int((classes[1:] != classes[:-1]).sum())
        # variance of the number of changes in independent draws
        var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (float((shares * (1 - shares) ** 2).sum()) - change**2)
        p.append(_tail((seen - (n - 1) * change) / math.sqrt(max(var, 1e-9))))
    c = x - (k - 1) / 2
    p.append(_tail(float((c[1:] * c[:-1]).sum()) / ((k * k - 1) / 12) / math.sqrt(n - 1)))
    return name, min(1.0, len(p) * min(p))


def natural_log_p(n: int, changes: int, q: float) -> float:
    """Log of the probability of as many class changes, or more, in n - 1 steps at rate q; 0 up to the mean."""
    if changes <= (n - 1) * q or changes <= 0:
        return 0.0
    term, total, i = 1.0, 1.0, changes
    while i < n - 1 and term > 1e-17 * total:  # beyond the mean the terms fall
        term *= (n - 1 - i) / (i + 1) * q / (1 - q)
        total += term
        i += 1
    return min(0.0, math.lgamma(n) - math.lgamma(changes + 1) - math.lgamma(n - changes) + changes * math.log(q) + (n - 1 - changes) * math.log1p(-q) + math.log(total))


def pairs_of(token: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of neighbours of one class in a run of bytes."""
    x = PLACE[token].astype(np.int64)
    pairs = x[:-1] * SYMBOLS + x[1:]
    return pairs[SAME[pairs]]


class Pairs:
    """What the corpus tells of pairs of characters of one class: their surprise, and the log of its moments at LAMBDAS."""

    def __init__(self, counts: dict[int, int]):
        n = SAME.astype(float)
        for pair, count in counts.items():
            n[pair] += count
        log_share = np.log(n[SAME] / n.sum())
        self.surprise = np.zeros(len(n))
        self.surprise[SAME] = -log_share
        self.moments = np.array([math.log(float(np.exp(x * log_share).sum())) for x in 1 - LAMBDAS])

    def log_p(self, token: np.ndarray) -> float:
        """Log of a bound of the probability of as much surprise, or more, in as many pairs of the corpus."""
        pairs = pairs_of(token)
        return min(0.0, float((len(pairs) * self.moments - LAMBDAS * self.surprise[pairs].sum()).min()))


def p_class(log_p: float) -> int:
    """The class of a p-value; its upper end is 10 ** (-class / CLASSES)."""
    return int(min(CLASSES * DECADES, -log_p / math.log(10) * CLASSES))


def rejected_from(counts: dict[int, int], fdr: float) -> int:
    """Benjamini-Hochberg: the first class that is rejected, by the number of hypotheses in each class."""
    total, rank, cut = sum(counts.values()), 0, CLASSES * DECADES + 1
    for c in sorted(counts, reverse=True):
        rank += counts[c]
        if 10.0 ** (-c / CLASSES) <= fdr * rank / total:
            cut = c
    return cut


def _stratum(n: int) -> int:
    return bisect.bisect_right(STRATA, n) - 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, offsets_all = utf8(batch.column("text"))
        for i, j in row_blocks(offsets_all):
            raw, offsets = raw_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
            blob = raw.tobytes()
            starts, ends = runs(raw, offsets, CLASS > 0)
            long = ends - starts >= SHORTEST
            starts, ends = starts[long], ends[long]
            rows = np.searchsorted(offsets, starts, "right") - 1
            kind = CLASS[raw]
            step = (kind[1:] > 0) & (kind[:-1] > 0)
            step[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))] - 1] = False
            changed = int((step & (kind[1:] != kind[:-1])).sum())
            # at -1 and -2 the steps without and with a change, at -3 and below the pairs of one class
            counts: dict[int, int] = {-1: int(step.sum()) - changed, -2: changed}
            at = np.flatnonzero(step & (kind[1:] == kind[:-1]))
            seen = np.bincount(PLACE[raw[at]].astype(np.int64) * SYMBOLS + PLACE[raw[at + 1]], minlength=1)
            counts |= {-3 - int(k): int(seen[k]) for k in np.flatnonzero(seen)}
            random: dict[int, list] = {}
            changes = np.r_[0, np.cumsum(kind[1:] != kind[:-1])] if len(kind) else kind
            points = np.cumsum((raw & 0xC0) != 0x80) if len(starts) else starts  # code points up to each byte
            for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
                t = int(changes[e - 1] - changes[s])
                p = battery(raw[s:e])[1]
                at = int(points[s] - points[offsets[r]])
                random.setdefault(r, []).append({"start": at, "end": at + e - s, "changes": t, "stratum": _stratum(e - s), "battery": p_class(math.log(p) if p > 0 else -math.inf), "token": raw[s:e].tobytes()})
            low = blob.lower()
            hexed = runs(raw, offsets, _HEX_BYTE)
            some = set((np.searchsorted(offsets, hexed[0][hexed[1] - hexed[0] >= 24], "right") - 1).tolist())
            for word in (*_KEYWORDS, b"akia"):
                at = low.find(word)
                while at >= 0:
                    r = int(np.searchsorted(offsets, at, "right")) - 1
                    some.add(r)
                    at = low.find(word, max(at + 1, int(offsets[r + 1]) - len(word) + 1))
            base = [base_spans(blob[offsets[r] : offsets[r + 1]].decode("utf-8")) if r in some else [] for r in range(j - i)]
            sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest() for b in base]
            tested = [[{"stratum": n, "runs": c} for n, c in counts.items()]] + [[]] * (j - i - 1)
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(sha), pa.array(spans, _SPANS), pa.array([random.get(r, []) for r in range(j - i)], _RANDOM), pa.array(tested, _TESTED)],
                ["doc_id", "base_sha256", "base", "candidates", "tested"],
            )


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
_INT = pa.int32()
_SPANS = pa.list_(pa.struct([("start", _INT), ("kind", _INT), ("end", _INT)]))
_RANDOM = pa.list_(pa.struct([*[(c, _INT) for c in ("start", "end", "changes", "stratum", "battery")], ("token", pa.binary())]))
_TESTED = pa.list_(pa.struct([("stratum", _INT), ("runs", pa.int64())]))
_SCHEMA = "doc_id long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,changes:int,stratum:int,battery:int,token:binary>>, tested array<struct<stratum:int,runs:long>>"


def secrets(docs: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; one row for each row of docs."""
    seen = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA))
    tested = {r.stratum: r.runs for r in seen.select(F.explode("tested").alias("t")).groupBy("t.stratum").agg(F.sum("t.runs").alias("runs")).collect()}  # a row for each pair of characters at most
    changed = tested.get(-2, 0)
    q = min(0.5, max(1e-4, changed / max(1, changed + tested.get(-1, 0))))
    known = Pairs({-3 - k: n for k, n in tested.items() if k <= -3})

    def nature_class(c: dict) -> int:
        n = c["end"] - c["start"]
        return p_class(min(0.0, math.log(2) + min(natural_log_p(n, c["changes"], q), known.log_p(np.frombuffer(c["token"], np.uint8)))))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("candidates").to_pylist()
            nature = [[nature_class(c) for c in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nature, pa.list_(_INT))], [*batch.schema.names, "nature"])

    kept = seen.drop("tested")
    judged = checkpointed(kept.mapInArrow(tails, _SCHEMA.rpartition(", tested")[0] + ", nature array<int>"))
    each = judged.filter(F.size("candidates") > 0).select(F.explode(F.arrays_zip("candidates", "nature")).alias("c")).select("c.candidates.stratum", "c.candidates.battery", "c.nature")
    held: dict[str, dict[int, dict[int, int]]] = {"battery": {}, "nature": {}}
    for r in each.groupBy("stratum", "battery", "nature").count().collect():  # rows for strata and classes
        for of in held:
            by = held[of].setdefault(r.stratum, {})
            by[r[of]] = by.get(r[of], 0) + r["count"]
    limit = {of: F.array(*[F.lit(rejected_from(by[x], level) if x in by else CLASSES * DECADES + 1) for x in range(len(STRATA))]) for of, by, level in (("battery", held["battery"], alpha), ("nature", held["nature"], fdr))}
    chosen = F.filter(F.arrays_zip("candidates", "nature"), lambda c: (c["candidates"]["battery"] < F.get(limit["battery"], c["candidates"]["stratum"])) & (c["nature"] >= F.get(limit["nature"], c["candidates"]["stratum"])))
    random = F.transform(chosen, lambda c: F.struct(c["candidates"]["start"].alias("start"), F.lit(3).alias("kind"), c["candidates"]["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return judged.withColumn("random", random).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("random").cast("long").alias("n_random"),
        "base_sha256",
        F.array_join(F.transform(F.array_sort(F.concat("base", "random")), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",").alias("spans"),
    )

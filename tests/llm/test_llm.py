"""Each operator against brute force, and on hard tables: nulls, empty and long texts, ties, repeats, clashing names."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.functions import lit

from lectern.llm import decontam, fingerprint, langid, linedup, neardup, pieces, quality, secrets, sharding, toxicity
from lectern.llm.core import checkpointed, distinct, mix, row_blocks, shingles, utf8, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, row string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names operators use."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, long, "en", "s", 9), (4, long, "en", "s", 9), (4, long, "en", "s", 9), (None, "lone text here", None, "s", 1), (5, "a b", "de", "s", 3), (6, "A  B", "de", "s", 3), (7, "▁ café \U0001f600\n\t x", "fr", "s", 3)]
    return checkpointed(spark.createDataFrame([(*r, 0.5, 1, "r") for r in rows], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def tokens(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# ---------------------------------------------------------------- core


def test_words_and_shingles():
    texts = ["The the  THE\tend", "", None, "one", "a b c d e a b c d"]
    raw, offsets = utf8(pa.array(texts))
    row, word = words(raw, offsets)
    assert np.bincount(row, minlength=5).tolist() == [4, 0, 0, 1, 9] and len(set(word[:3])) == 1
    r, v = distinct(*shingles(row, word, 4))
    assert np.bincount(r, minlength=5).tolist() == [len(shingle_set(t, 4)) for t in texts]
    assert list(row_blocks(np.array([0, 5, 6, 30, 31]), 8)) == [(0, 2), (2, 3), (3, 4)]


# ---------------------------------------------------------------- 1 language


def brute_profile(texts, size):
    counts = {}
    for t in texts:
        p = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        for i in range(len(p)):
            for n in (1, 2, 3):
                g = p[i : i + n]
                if len(g) == n and not (n == 1 and g == " ") and not (n == 2 and g == "  ") and not (n == 3 and g[1] == " "):
                    counts[g] = counts.get(g, 0) + 1
    order = sorted(counts, key=lambda g: (-counts[g], -len(g), g.replace(" ", "\0")))
    return {g: r for r, g in enumerate(order[:size])}, counts


def packed(gram):
    code = [0 if c == " " else ord(c) for c in gram]
    v = sum(c << 21 * i for i, c in enumerate(reversed(code))) | {3: 0, 2: 1 << 63, 1: 3 << 62}[len(gram)]
    return v - (1 << 64) if v >> 63 else v


def test_profiles_and_predictions_equal_brute_force(spark, docs):
    texts = ["Hello wörld, hello!", "élan vital 12 élan", "一二 三", "a", "b a"]
    df = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    ranks, counts = brute_profile(texts, 40)
    assert langid.profiles(df, 10_000).count() == len(counts) and len(ranks) == 40
    assert {r.gram: r["rank"] for r in langid.profiles(df, 40).collect()} == {packed(g): r for g, r in ranks.items()}
    # one language's n-grams aren't all sorted in one task
    assert "WindowGroupLimit" in langid.profiles(df, 40)._jdf.queryExecution().executedPlan().toString()
    some = [(r.doc_id, r.text, r.lang) for r in docs.orderBy("doc_id").limit(90).collect()] + [(10_000 + i, t, None) for i, t in enumerate([*texts, "", None, "12 34"])]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    size = 120
    model = {lang: brute_profile([t for i, t, x in some if x == lang and t is not None and not held(i)], size)[0] for lang in {x for i, t, x in some if x and t is not None and not held(i)}}
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(some, "doc_id long, text string, lang string"), size=size).collect()}
    for i, t, _ in some:
        own, _ = brute_profile([t or ""], size)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        apart = {x: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for x, p in model.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - apart[best] / (size * len(own))) and got[i].held_out == held(i)


def test_language_accuracy_and_hard_rows(docs, hard, none):
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    rows = langid.language_id(hard).collect()
    assert len(rows) == 9 and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2))
    assert langid.language_id(none).count() == 0


# ---------------------------------------------------------------- 2 quality


def test_quality(spark, hard, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(big, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and (held[held.quality == 1].predicted == 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    nothing = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.quality(hard, nothing).collect()} == {0.5}
    assert quality.quality(none, labels).count() == 0
    kept = quality.accepted(hard, quality.fit(hard, nothing))
    assert kept.columns == hard.columns and kept.count() == 9


def brute_hash(data):
    """mix of the sum of the bytes' random values times powers of the base."""
    from lectern.llm import core

    return brute_mix(sum(int(core.BYTE[b]) * pow(core._BASE, i, 2**64) for i, b in enumerate(data)))


def brute_mix(x):
    x %= 2**64
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * factor % 2**64
    return x ^ (x >> 33)


def brute_features(text, buckets):
    tokens = [brute_hash(m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())]
    keys = [t % buckets for t in tokens] + [(7 if a == b else brute_mix(b * 31 + a)) % buckets for a, b in zip(tokens, tokens[1:], strict=False)]
    value = {k: 1 + np.log(keys.count(k)) for k in set(keys)}
    norm = sum(v * v for v in value.values()) ** 0.5
    return {k: v / norm for k, v in value.items()}


def test_quality_features_and_weights_equal_brute_force():
    from math import copysign, exp

    texts = ["Good words, good words here. Étude!", "bad bad bad --- ###", "", "one", "good words of note, here"]
    buckets, alpha, beta, l1, l2 = 1 << 12, 2.0, 1.0, 0.02, 0.05
    raw, offsets = utf8(pa.array(texts))
    row, bucket, value = quality.features(raw, offsets, buckets)
    got = [{int(b): v for b, v in zip(bucket[row == i], value[row == i], strict=True)} for i in range(len(texts))]
    want = [brute_features(t, buckets) for t in texts]
    assert all(g.keys() == w.keys() and all(g[k] == pytest.approx(w[k]) for k in w) for g, w in zip(got, want, strict=True))
    labels = [1, 0, 0, 1, 1]
    z, n = {}, {}

    def weight(k):
        if k != "bias" and abs(z.get(k, 0.0)) <= l1:
            return 0.0
        shrink = 0.0 if k == "bias" else copysign(l1, z[k])
        return -(z.get(k, 0.0) - shrink) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)

    for _ in range(5):
        for x, y in zip(want, labels, strict=True):
            x = {**x, "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    rows = [(np.array(sorted(w), np.int64), np.array([w[k] for k in sorted(w)]), y) for w, y in zip(want, labels, strict=True)]
    weights, bias = quality.ftrl(rows, buckets)
    assert bias == pytest.approx(weight("bias")) and all(weights[k] == pytest.approx(weight(k), abs=1e-6) for k in z if k != "bias")
    scores = quality.probabilities(pa.array(texts), weights, bias)
    assert all(s == pytest.approx(1 / (1 + exp(-bias - sum(weight(k) * v for k, v in w.items()))), abs=1e-6) for s, w in zip(scores, want, strict=True))


def test_quality_learns_from_long_texts(spark):
    """A labelled text of any length takes part in the fit, and the bound on features is a sample of rows."""
    long = "sound prose of some length. " * 20_000
    docs = spark.createDataFrame([(i, long if i % 2 else "@@ ## junk " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    assert all(r.predicted == r.doc_id % 2 for r in quality.quality(docs, labels).collect())
    weights, _ = quality.fit(docs, labels, max_features=200)
    assert 0 < np.count_nonzero(weights) < np.count_nonzero(quality.fit(docs, labels)[0]) + 1


# ---------------------------------------------------------------- 3 pieces


def test_pieces_round_trip_and_distribution(spark, hard, none):
    import sentencepiece

    got = pieces.tokenize(hard)
    assert got.filter("not lossless").count() == 0 and got.count() == 9
    back = {r.doc_id: r.text for r in pieces.detokenize(got).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in hard.collect())
    assert pieces.tokenize(none).count() == 0
    v = pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)

    def segmentations(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if (p := sp.piece_to_id(s[:k].replace(" ", "▁"))) != 0:
                yield from ((p, *r) for r in segmentations(s[k:]))

    n = 20_000
    raw, offsets = utf8(pa.array(["hello"] * n))
    ids, at = pieces.encode(v, *pieces.spaced(raw, offsets), mix(np.arange(n, dtype=np.uint64)))
    seen = {}
    for i in range(n):
        k = tuple(ids[at[i] : at[i + 1]].tolist())
        seen[k] = seen.get(k, 0) + 1
    weights = {s: float(np.exp(sum(v.log_p[p] for p in s))) for s in segmentations(" hello")}
    total = sum(weights.values())
    assert all(abs(seen.get(s, 0) / n - w / total) < 0.02 for s, w in weights.items()) and set(seen) <= set(weights)
    again, at2 = pieces.encode(v, *pieces.spaced(*utf8(pa.array(["hello"]))), mix(np.arange(1, dtype=np.uint64)))
    assert again.tolist() == ids[: at[1]].tolist()


def test_long_units_are_drawn_alike(spark, monkeypatch):
    """Windows, and cuts at nodes that every path takes, draw what one lattice draws; and the text comes back."""
    rng = np.random.default_rng(4)
    v = pieces.load()
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3000)), "a" * 2500, "漢字かな" * 400 + "é😀" * 100, "x" * 70 + "=" * 900, "Straße" * 300]
    raw, offsets = pieces.spaced(*utf8(pa.array(texts)))
    seeds = mix(np.arange(len(texts), dtype=np.uint64))
    want = pieces.encode(v, raw, offsets, seeds)
    for long, window in ((200, 64), (1000, 333), (100, 5000)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "WINDOW", window)
        got = pieces.encode(v, raw, offsets, seeds)
        assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    assert pieces.decode(v, *got)[0].tobytes().decode() == "".join(texts)


def test_text_without_spaces_takes_linear_time(spark):
    import time

    v = pieces.load()
    took = []
    for n in (200_000, 800_000):
        raw, offsets = pieces.spaced(*utf8(pa.array(["ab" * (n // 2)])))
        began = time.process_time()
        ids, at = pieces.encode(v, raw, offsets, mix(np.arange(1, dtype=np.uint64)))
        took.append(time.process_time() - began)
        assert pieces.decode(v, ids, at)[0].tobytes() == b"ab" * (n // 2)
    assert took[1] < 8 * max(took[0], 0.2)


# ---------------------------------------------------------------- 4 lines


def brute_lines(rows):
    parts = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        cut, own = [], []
        for k, line in enumerate(lines):
            own.append(line)
            if (h[k] + 131 * (h[k - 1] if k else 0)) % 3 == 0:
                cut.append(own)
                own = []
        parts[i] = cut + [own] if own else cut
    seen, out = set(), {}
    for i in sorted(parts):
        keep = []
        for c in parts[i]:
            t = "\n".join(c)
            if len(c) >= 2 and t.strip(" \t\n\r\x0b\x0c") and t in seen:
                continue
            if len(c) >= 2:
                seen.add(t)
            keep += c
        out[i] = "\n".join(keep)
    return out


def test_line_dedup(docs, hard, none):
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = linedup.deduplicated(docs).collect()
    assert {r.doc_id: r.text for r in got} == want and sum(r.n_chunks_removed for r in got) > 0
    rows = linedup.deduplicated(hard).collect()
    assert len(rows) == 9 and next(r for r in rows if r.doc_id == 1).text is None
    assert linedup.deduplicated(none).count() == 0


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"Shared line number {i} of the passage." for i in range(30))
    df = spark.createDataFrame([(1, "own start\n" + passage + "\nown end"), (2, "other\nlines\nbefore\n" + passage)], "doc_id long, text string")
    lost = next(r for r in linedup.deduplicated(df).collect() if r.doc_id == 2)
    assert lost.n_lines_removed >= 15 and "other" in lost.text


# ---------------------------------------------------------------- 5 decontamination


def test_decontamination(spark, docs, benchmark, hard, none):
    items = {r.item_id: shingle_set(r.text, 5) for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, s in items.items() if s and len(s & shingle_set(r.text, 5)) >= 0.8 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == want and want
    some = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11"), (2, "a b"), (3, None), (4, ""), (5, "café \U0001f600 x")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(hard, some).distinct().collect())
    assert got == [(3, 1), (4, 1), (5, 2), (6, 2), (7, 5)]
    assert decontam.clean(hard, some).columns == hard.columns and decontam.contaminated(none, some).count() == 0
    assert decontam.contaminated(hard, some.limit(0)).count() == 0


def test_clean_decides_each_row_by_its_text(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(6)], "item_id long, text string")
    own = lambda i: "before " + " ".join(f"i{i}w{k}" for k in range(30)) + " after"
    rows = [(None, own(0)), (None, own(1)), (None, "clean text without any item in it"), (1, own(2)), (1, "clean as well, by the same id"), (2, None), (3, ""), (4, own(5))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bad_id long, text_key string")
    want = sorted(((r[0] or 0, r[1] or "") for r in rows if "w29" not in (r[1] or "")))
    for block in (decontam.BLOCK_SHINGLES, 60):  # one block of items, and three
        monkeypatch.setattr(decontam, "BLOCK_SHINGLES", block)
        assert len(list(decontam._blocks(items, 5, 256))) == (1 if block > 60 else 3)
        got = decontam.clean(df, items)
        assert got.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == want
        assert sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(df, items).collect()) == [(0, 0), (0, 1), (1, 2), (4, 5)]


# ---------------------------------------------------------------- 6 secrets


def test_secrets(spark, hard, none):
    hexed = hashlib.sha1(b"x").hexdigest()
    texts = ['API_key : "abcdef9"', "token: token: abcdefgh", f"é {hexed}", "AKIA" + "Q" * 16, None, "paſſword=abcdefgh", f"passwd=abc secret='{hexed}'"]
    plain = [" ".join(f"Word{i} another plainwords." for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secrets(df).collect()}
    for i, t in enumerate(texts + plain):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or "", re.A) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert all(x in got[i].spans.split(",") for x in text.split(",") if x)
    assert got[2].n_random == 1 and got[7].n_random == 0
    assert secrets.secrets(hard).count() == 9 and secrets.secrets(none).count() == 0


def brute_random(texts):
    """Spans by the definitions: exact binomial tails, the three tests from their formulas, step-up control in each stratum."""
    from fractions import Fraction
    from math import comb, erfc, exp, log, log10, sqrt

    kind = lambda c: 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4
    found, steps, changed, pairs = [], 0, 0, {}
    for d, text in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            t = sum(kind(x) != kind(y) for x, y in zip(m[0], m[0][1:], strict=False))
            steps, changed = steps + len(m[0]) - 1, changed + t
            for a, b in zip(m[0], m[0][1:], strict=False):
                if kind(a) == kind(b):
                    pairs[a + b] = pairs.get(a + b, 0) + 1
            if len(m[0]) >= 20:
                found.append((d, m.start(), m.end(), t, m[0]))
    q = Fraction(changed, steps)
    every = [a + b for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-") for a in s for b in s]
    total = sum(pairs.values()) + len(every)
    share = {x: (pairs.get(x, 0) + 1) / total for x in every}
    moments = [(i / 40, sum(v ** (1 - i / 40) for v in share.values())) for i in range(1, 41)]
    judged = {}
    for d, s, e, t, x in found:
        n = e - s
        nature = float(sum(comb(n - 1, i) * q**i * (1 - q) ** (n - 1 - i) for i in range(t, n))) if t > (n - 1) * q else 1.0
        within = [a + b for a, b in zip(x, x[1:], strict=False) if a + b in share]
        seldom = min(len(within) * log(m) - v * sum(-log(share[w]) for w in within) for v, m in moments)
        nature = min(1.0, 2 * min(nature, exp(min(0.0, seldom))))
        alphabet = next((a for _, a in secrets._ALPHABETS if not set(x) - set(a)), None)
        p = 0.0
        if alphabet:
            k = len(alphabet)
            chi = sum((x.count(a) - n / k) ** 2 / (n / k) for a in alphabet)
            tests = [0.5 * erfc((chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) / sqrt(2))]
            shares = [sum(kind(a) == c for a in alphabet) / k for c in (1, 2, 3, 4)]
            rate = 1 - sum(v * v for v in shares)
            if 0 < rate < 1:
                var = (n - 1) * rate * (1 - rate) + 2 * (n - 2) * (sum(v * (1 - v) ** 2 for v in shares) - rate**2)
                tests.append(erfc(abs(t - (n - 1) * rate) / sqrt(var) / sqrt(2)))
            c = [alphabet.index(a) - (k - 1) / 2 for a in x]
            tests.append(erfc(abs(sum(a * b for a, b in zip(c, c[1:], strict=False)) / ((k * k - 1) / 12) / sqrt(n - 1)) / sqrt(2)))
            p = min(1.0, len(tests) * min(tests))
        up = lambda p: 10 ** (-min(3200, int(-8 * log10(p))) / 8) if p > 0 else 1e-400
        judged[d, s, e] = (max(b for b in secrets.STRATA if b <= n), up(p), up(nature))

    @functools.cache
    def rejected(which, level, stratum):
        ps = sorted(v[which] for v in judged.values() if v[0] == stratum)
        return max((p for i, p in enumerate(ps, 1) if p <= level * sum(y <= p for y in ps) / len(ps)), default=-1.0)
    return sorted(k for k, (b, p, nature) in judged.items() if p > rejected(1, secrets.ALPHA, b) and nature <= rejected(2, secrets.FDR, b))


def test_random_spans_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    pick = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    base64, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for i in range(120):
        some = [pick(lower, int(rng.integers(2, 30))) for _ in range(40)] + ["path/to/some_file_name-v2/long", "HelloWorldCamelCaseNames", "x" * 25 + "1"]
        some += [pick(base64, int(rng.integers(20, 700))), "é" * 3 + " " + pick("0123456789abcdef", 40), pick("ab", 30) + "Z9"] if i % 4 == 0 else []
        texts.append(" ".join(rng.permutation(some)))
    got = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = sorted((r.doc_id, *map(int, x.split(":")[1:])) for r in got for x in r.spans.split(",") if x.startswith("random"))
    assert spans == brute_random(texts) and len(spans) > 40
    long = pick(base64, 100_000)  # far longer than any stratum of words, and judged by all of it
    r = secrets.secrets(spark.createDataFrame([(1, f"{texts[1]} {long}"), (2, " ".join(texts[5:20]))], "doc_id long, text string")).filter("doc_id = 1").first()
    assert f"random:{len(texts[1]) + 1}:{len(texts[1]) + 1 + len(long)}" in r.spans


def test_random_runs_of_one_class(spark):
    """Random digits, letters of one case and base32 without digits are found; long words, numbers of few digits and paths of one case aren't."""
    rng = np.random.default_rng(3)
    pick = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    words = "donau dampf schiff fahrts gesellschaft kapitaen versicherung verantwortung anti establish mentarian internation alization under standing counter revolution recht schutz unter suchung".split()
    prose = [" ".join("".join(rng.choice(words, int(rng.integers(1, 5)))) for _ in range(400)) for _ in range(40)]
    natural = ["donaudampfschifffahrtsgesellschaft", "RECHTSSCHUTZVERSICHERUNG".lower(), "internationalizationunderstanding", "0" * 30, "2024" * 8]
    found = [pick("0123456789", 60), pick("abcdefghijklmnopqrstuvwxyz", 60), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 60), pick("abcdefghijklmnopqrstuvwxyz", 24), pick("abcdefghijklmnopqrstuvwxyz0123456789", 40)]
    texts = prose + natural + found
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[len(prose) + i].n_random for i in range(len(natural))] == [0] * len(natural)
    assert [f"random:0:{len(x)}" in got[len(prose) + len(natural) + i].spans.split(",") for i, x in enumerate(found)] == [True] * len(found)
    assert sum(got[i].n_random for i in range(len(prose))) == 0


# ---------------------------------------------------------------- 7 toxicity


def test_toxicity(spark, hard, none):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(["an", "the", "or", "ti", "re", "sh", "ea"], 3)) for _ in range(400)]
    insults = ["worthless", "idiot", "pathetic"]
    rows, marks = [], []
    for i in range(900):
        w = list(rng.choice(base, 40))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(int(rng.integers(1, 39)), str(rng.choice(insults)))
        rows.append((i, " ".join(w[:20]) + ". " + " ".join(w[20:])))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got if r.held_out)
    model = toxicity.fit(docs, labels)
    raw, offsets = utf8(pa.array(["the oran worthless reti", "the oran w.o.r.t.h.l.e.s.s reti", "the oran worth-less reti", "the oran worthlless reti", "the oran reti"]))
    assert (model.scores(raw, offsets) >= 0.5).tolist() == [True, True, True, True, False]
    assert toxicity.toxicity(hard, spark.createDataFrame([], LABELS)).count() == 9 and toxicity.toxicity(none, labels).count() == 0


def brute_kernel(a, b):
    """Sum over all triples of places in either word, by enumeration."""
    from itertools import combinations

    def triples(w):
        return [((w[i], w[j], w[k]), toxicity.DECAY ** (k - i - 2)) for i, j, k in combinations(range(len(w)), 3) if k - i < toxicity.SPAN]

    both = lambda x, y: sum(p * q for u, p in triples(x) for v, q in triples(y) if u == v)
    return both(a, b) / (both(a, a) * both(b, b)) ** 0.5


def test_kernel_by_enumeration_and_its_bound():
    marks = [b"idiot", b"worthless", b"plainwords"]
    floors, specific = np.array([0.45, toxicity.FLOOR, toxicity.FLOOR]), np.array([True, False, False])
    model = toxicity.Model(marks, 2, np.zeros(3), 0.0, (0.0, 0.0, 0.0), 0.0, floors, specific)
    model.prepare()
    seen = 0
    for w in (b"idiot", b"idioot", b"idxiot", b"iidot", b"wortless", b"wxortxhless", b"plainword", b"wordless", b"aaa", b"ab", b"worthlessly"):
        near, values = model.near(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        k = np.array([brute_kernel(w, m) for m in marks]) if len(w) > 2 else np.zeros(3)
        assert len(near) == bool((k >= floors)[:2].any()), w
        if len(near):
            rise = np.clip((k[0] - floors[0]) / toxicity.RISE + 0.1, 0, 1) if k[0] >= floors[0] else 0.0
            assert values[0] == pytest.approx([rise, *(x**toxicity.POWER if x >= toxicity.FLOOR else 0.0 for x in k[1:])])
            seen += 1
    assert seen >= 5


def test_score_equals_its_definition(spark):
    """A model's score of a text, from enumerated kernels of all its words."""
    marks, weights = [b"idiot", b"worthless", b"clean"], np.array([1.4, 1.1, -0.3])
    model = toxicity.Model(marks, 2, weights, -0.5, (1.5, 0.7, 2.0), -1.2, np.array([0.45, 0.5, 0.5]), np.array([True, False, False]))
    model.prepare()
    texts = ["An idiot. You worthless, worthles thing! clean clan idxiot\nplain", "nothing here", "", "i d i o t and W.O.R.T.H.L.E.S.S words."]
    raw, offsets = utf8(pa.array(texts))
    got = model.scores(raw, offsets)
    sentences = [[["an", "idiot"], ["you", "worthless", "worthles", "thing"], ["clean", "clan", "idxiot"], ["plain"]], [["nothing", "here"]], []]
    for text, score in zip(sentences, got, strict=False):
        worst, tells, sure = -0.5, 0.0, 0.0
        for words_of in text:
            z = np.zeros(3)
            for w in words_of:
                k = np.array([brute_kernel(w.encode(), m) for m in marks]) if len(w) > 2 else np.zeros(3)
                if k[0] >= 0.45 or k[1] >= 0.5:
                    z = np.maximum(z, [np.clip((k[0] - 0.45) / toxicity.RISE + 0.1, 0, 1) if k[0] >= 0.45 else 0.0, *(x**toxicity.POWER if x >= 0.5 else 0.0 for x in k[1:])])
            if z.any():
                f = min(1.0, float(z @ weights) - 0.5)
                worst, tells, sure = max(worst, f), tells + max(0.0, f), max(sure, z[0] if f > 0 else 0.0)
        x = 1.5 * worst + 0.7 * np.log1p(tells) + 2.0 * sure - 1.2
        assert score == pytest.approx(1 / (1 + np.exp(-x)))
    assert got[3] > got[1]


def test_altered_insults_and_clean_words_near_them(spark):
    """Labelled documents with plain insults only; then one or two characters put in or dropped, and clean words like them."""
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(["an", "the", "or", "ti", "re", "sh", "ea", "wor", "less"], 3)) for _ in range(300)] + ["worth", "pathos", "idiom", "stumped"]
    insults = ["worthless", "idiot", "pathetic", "stupid"]
    texts = [" ".join([*rng.choice(base, 30), *(rng.choice(insults, 3) if i % 4 == 0 else [])]) for i in range(800)]
    raw, offsets = utf8(pa.array(texts))
    model = toxicity.train(raw, offsets, np.array([i % 4 == 0 for i in range(800)], np.int64))
    said = lambda w: float(model.scores(*utf8(pa.array([f"the oran {w} reti"])))[0])
    letters = list("abcdefghijklmnopqrstuvwxyz")
    put = lambda w: (lambda i: w[:i] + str(rng.choice(letters)) + w[i:])(int(rng.integers(1, len(w))))
    drop = lambda w: (lambda i: w[:i] + w[i + 1 :])(int(rng.integers(1, len(w) - 1)))
    once = [f(w) for w in insults for f in (put, drop) for _ in range(10)]
    assert all(said(w) >= 0.5 for w in insults) and np.mean([said(w) >= 0.5 for w in once]) > 0.85
    assert np.mean([said(put(put(w))) >= 0.5 for w in insults for _ in range(10)]) > 0.4
    assert not any(said(w) >= 0.5 for w in base)


# ---------------------------------------------------------------- 8 near duplicates


def brute_components(rows):
    sets = {i: shingle_set(t, 4) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, hard, none):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    rows = {r.doc_id: r for r in neardup.near_duplicates(hard).collect()}
    assert (rows[1].component_id, rows[2].n_shingles, rows[4].component_id, rows[6].component_id, rows[4].kept) == (1, 0, 3, 5, False)
    assert neardup.near_duplicates(hard).count() == 9 and neardup.near_duplicates(none).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.representatives(hard).collect()) == [0, 1, 2, 3, 5, 7]


def test_crowded_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((1000 - i, " ".join(w)))
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_one_region_in_many_ranges(spark, monkeypatch):
    """Cuts between the sorted ranges lose no link, however small the ranges."""
    monkeypatch.setattr(neardup, "RANGE", 60)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        base = [f"g{g}_{i}" for i in range(60)]
        for i in range(5):
            w = list(base)
            for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
                w[p] = f"x{g}_{i}_{p}"
            rows.append((g * 10 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_sorted_neighbours_by_brute_force():
    """Regions, candidates and members of one sorted range, from the labels themselves."""
    rng = np.random.default_rng(1)
    signature = rng.integers(0, 3, (200, neardup.HASHES), dtype=np.uint16)
    signature[50:90] = signature[50]  # one crowded region in each tree
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), pa.array([x.tobytes() for x in signature])], ["node", "signature"])
    keys = sorted(k for b in neardup._keys(iter([batch])) for k in b.column("key").to_pylist())
    got, fits = {0: set(), 1: set(), 2: set()}, {}
    for b in neardup._neighbours(iter([pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])])):
        for kind, x, y, fit in zip(*(b.column(c).to_pylist() for c in ("kind", "a", "b", "fit")), strict=True):
            got[kind].add((x, y))
            fits[x, y] = fit
    node = lambda k: int.from_bytes(k[-8:], "big", signed=True)
    by = lambda depth, some: [[k for k in some if k[: 1 + 2 * depth] == p] for p in sorted({k[: 1 + 2 * depth] for k in some})]
    edge = lambda part: keys[0] in part or keys[-1] in part
    some, many = [], []
    for shallow in by(neardup.SHALLOW, keys):
        if len(shallow) <= neardup.CROWD and not edge(shallow):
            some.append(shallow)
            continue
        for deep in by(neardup.DEEP, shallow):
            (some if len(deep) <= neardup.CROWD and not edge(deep) else many).append(deep)
    next_to = {tuple(sorted((node(x), node(y)))) for x, y in zip(keys, keys[1:], strict=False) if x[0] < neardup.FIRST and x[: 1 + 2 * neardup.SHALLOW] == y[: 1 + 2 * neardup.SHALLOW]}
    groups = lambda told: sorted(sorted(n for n, r in told if r == region) for region in {r for _, r in told})
    assert got[neardup.NEXT] == next_to and len(next_to) >= 39
    assert groups(got[neardup.SOME]) == sorted(sorted(map(node, p)) for p in some if len(p) > 1)
    assert groups(got[neardup.MANY]) == sorted(sorted(map(node, p)) for p in many)
    for part in many:  # how many of a label's values are the most frequent ones of the region
        at = [[k[1 + 2 * j : 3 + 2 * j] for j in range(neardup.LENGTH)] for k in part]
        most = [max(column.count(v) for v in column) for column in zip(*at, strict=True)]
        want = sorted((node(k), sum([row[j] for row in at].count(label[j]) == most[j] for j in range(neardup.LENGTH))) for k, label in zip(part, at, strict=True))
        regions = [r for r in {r for _, r in got[neardup.MANY]} if sorted(n for n, q in got[neardup.MANY] if q == r) == sorted(map(node, part))]
        assert any(sorted((n, fits[n, r]) for n, q in got[neardup.MANY] if q == r) == want for r in regions)


def test_components_in_one_partition_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [tuple(map(int, rng.integers(2000, 2200, 2))) for _ in range(120)]
    edges = [(int(a), int(b)) for a, b in edges if a != b]
    rank = {}

    def find(x):
        rank.setdefault(x, x)
        while rank[x] != x:
            x = rank[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        rank[y] = x
    want = {n: find(n) for e in edges for n in e if find(n) != n}
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for size in (neardup.EDGES, 16):
        monkeypatch.setattr(neardup, "EDGES", size)
        assert {r.node: r.component for r in neardup.components(df).collect()} == want


def test_rows_without_ids_and_clashing_names(spark):
    """Each row is decided by itself: null ids, repeated ids, and columns that are called like the operator's own."""
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    v, near = " ".join(f"c{i}" for i in range(40)), " ".join([f"c{i}" for i in range(39)] + ["x"])
    rows = [(1, t), (None, t), (None, u), (None, v), (None, near), (None, v), (4, None), (None, ""), (None, None), (7, t), (7, "seven alone it is"), (9, "seven alone it is")]
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], "doc_id long, text string, gone_id long, text_key long, node string")
    got = neardup.representatives(df)
    assert got.columns == df.columns
    left = sorted(((r.doc_id or 0, r.text or "") for r in got.collect()))
    one_of = [x for x in left if x[1] in (v, near)]
    assert len(one_of) == 1 and [x for x in left if x not in one_of] == sorted([(1, t), (0, u), (4, ""), (0, ""), (0, ""), (7, "seven alone it is")])
    every = neardup.near_duplicates(df).collect()
    assert len(every) == len(rows) and {r.component_id for r in every if r.doc_id == 9} == {7}
    assert sorted(r.component_id or 0 for r in every if r.doc_id is None) == [0, 0, 0, 0, 0, 0, 1]


def template_group(n, size, change, pairs, seed):
    """Documents of one template that differ in so many words, and for each of some a copy of similarity 0.8 or a little more."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(size + 3)]
    rows, links = [], []
    for i in range(n):
        w = list(base)
        for p in rng.choice(np.arange(3, size, 4), change, replace=False):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
        if i < pairs:
            # a changed word away from the others costs each set four shingles
            v = list(w)
            for p in rng.choice(np.arange(3, size, 4), size // 36, replace=False):
                v[p] = f"y{i}_{p}"
            if len(shingle_set(" ".join(v), 4) & shingle_set(" ".join(w), 4)) * 100 >= 80 * len(shingle_set(" ".join(v), 4) | shingle_set(" ".join(w), 4)):
                rows.append((n + i, " ".join(v)))
                links.append((i, n + i))
    return rows, links


def test_similar_pairs_in_a_crowded_template_group(spark):
    rows, links = template_group(600, 396, 8, 150, 4)
    sets = [shingle_set(t, 4) for i, t in rows if i < 20]
    like = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a is not b]
    assert len(links) > 100 and 0.7 < np.mean(like) < 0.75
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


# ---------------------------------------------------------------- 9 fingerprints


def test_fingerprints(docs, hard, none):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(text) // 3
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()
    by_text = {}
    for i, text in rows:
        by_text.setdefault(text, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    far = [got[i] for k, (i, t) in enumerate(rows) if rows[(k + 1) % len(rows)][1] != t and len(t) > 500]
    assert sum(r.near_edited for r in far) > 5 * sum(r.near_next for r in far)
    assert fingerprint.fingerprints(hard).count() == 9 and fingerprint.fingerprints(none).count() == 0


def brute_signature(text):
    """Order MinHash by its definition: numbered k-mers, the least of each bin, pairs in text order."""
    import xxhash

    x64 = lambda values, seed=42: [seed := xxhash.xxh64_intdigest(v, seed & (2**64 - 1)) for v in values][-1]
    long = lambda v: int(v % 2**64).to_bytes(8, "little")
    signed = lambda v: v - 2**64 if v >> 63 else v
    k, tuples, bits = fingerprint.K, fingerprint.TUPLES, fingerprint._PLACE
    tokens = [long(x64([w.encode()])) for w in re.findall(f"[^\\x09-\\x0D\\x20]{{1,{fingerprint.LONGEST}}}", text)]
    mark = [long(fingerprint._MARK)] * (k - 1)
    padded = mark + tokens + mark
    grams = [signed(x64(padded[i : i + k])) >> bits for i in range(len(tokens) + k - 1)] if tokens else []
    seen, least = {}, {}
    for place, g in enumerate(grams):
        seen[g] = seen.get(g, -1) + 1
        h = (x64([long(g), seen[g].to_bytes(4, "little")]) & (2**63 - 1)) >> bits
        bin_ = h >> (63 - bits - (2 * tuples).bit_length() + 1)
        least[bin_] = min(least.get(bin_, (h, place)), (h, place))
    out = []
    for j in range(tuples):
        pair = sorted((least[b] for b in (2 * j, 2 * j + 1) if b in least), key=lambda v: v[1])
        out.append(signed(x64([long(h) for h, _ in pair])) if pair else None)
    return out


def test_signature_and_likeness_equal_brute_force(spark, docs):
    some = [r.text for r in docs.limit(30).collect()] + ["", "one", "a b", "a a a a", "x" * 100, "1 2 3 4 5 6 7", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9"]
    df = spark.createDataFrame([(i, t, some[i - 1]) for i, t in enumerate(some)], "i int, t string, u string")
    got = df.select("t", "u", fingerprint.signature(df.t).alias("s"), fingerprint.likeness(fingerprint.signature(df.t), fingerprint.signature(df.u)).alias("x")).collect()
    for r in got:
        s, v = brute_signature(r.t), brute_signature(r.u)
        assert r.s == s
        either = [(a, b) for a, b in zip(s, v, strict=True) if a is not None or b is not None]
        assert r.x == (sum(a == b for a, b in either) / len(either) if either else 1.0)
    # one word more changes little, at any number of words
    assert all(got[-i].x > 0.3 for i in (1, 2))


def test_next_over_ranges(spark):
    rows = [(i, "long words " * 2000 if i % 100 < 5 else "short") for i in range(2000)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {"text": fingerprint.F.col("text")}, 4).collect()
    after = {r.doc_id: r.next_text for r in got}
    assert len(got) == 2000 and all(after[i] == rows[(i - 1) % 2000][1] for i in range(2000))


def test_fingerprint_depends_on_order(spark):
    w = [f"w{i}" for i in range(400)]
    blocks = w[300:] + w[200:300] + w[100:200] + w[:100]
    df = spark.createDataFrame([(" ".join(w), " ".join(blocks))], "a string, b string")
    x = fingerprint.likeness(fingerprint.signature(df.a), fingerprint.signature(df.b))
    y = fingerprint.likeness(fingerprint.signature(df.a), fingerprint.signature(df.a))
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert r.y == 1.0 and r.x < 0.7  # nearly the same set of k-mers in another order


# ---------------------------------------------------------------- 10 shards


def test_shards(docs, hard, none):
    for df, n in ((docs, 40), (hard, 3)):
        rows = sharding.byte_shards(df, n).collect()
        want = sorted(((r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in df.collect()))
        total, at, slots = sum(w[3] for w in want), 0, {}
        expected = []
        for w in want:
            shard = (2 * at + w[3]) * n // (2 * total)
            expected.append((w[1], w[2], w[3], shard, slots.get(shard, 0)))
            slots[shard] = slots.get(shard, 0) + 1
            at += w[3]
        assert sorted((r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot) for r in rows) == sorted(expected)
    assert sharding.byte_shards(none).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, docs, benchmark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "linedup", "neardup", "decontam", "pieces"]
    now = docs
    for name, stage in c.STAGES:
        before, now = now, checkpointed(stage(spark, now, SF))
        if name != "pieces":
            assert now.columns == docs.columns
        if name == "linedup":
            assert {r.doc_id: r.text for r in now.collect()} == brute_lines([(r.doc_id, r.text) for r in before.collect()])
        if name == "neardup":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in now.collect()} == {i for i, (_, comp) in want.items() if comp == i}
    assert now.filter("not lossless").count() == 0
    assert sorted(r.doc_id for r in c.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in now.select("doc_id").collect())


def test_stages_on_hard_tables(spark, hard, none, monkeypatch):
    """Nulls in any column, empty and long texts, repeats, an empty table, and columns called like the stages' own: each row by brute force."""
    import corpus_pipeline as c

    item = "w5 w6 w7 w8 w9 w10 w11"
    line = "a first line of it\nand a second line\nand a third one here\nthe fourth line ends it"
    rows = [(None, line, "x"), (20, "new start\n" + line, None), (None, f"has {item} inside", "x"), (21, "clean words that stand alone here", "x"), (21, "clean words that stand alone here", "x"), (None, None, None)]
    extra = spark.createDataFrame([(i, t, "en", s, None, 7.0, 8, "r") for i, t, s in rows], SCHEMA)
    both = hard.unionByName(extra)
    clash = both.withColumnsRenamed({"score": "n_chunks_removed", "part": "gone", "row": "text_key"}).withColumn("node", lit(5))
    tables = {"labels": spark.createDataFrame([], LABELS), "benchmark": spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")}
    monkeypatch.setattr(c, "table", lambda spark, d, name: tables[name])
    told = lambda df: sorted((str(r.doc_id), r.text or "", r.n_chunks_removed, r.text_key) for r in df.collect())
    start = clash.collect()
    for name, stage in c.STAGES:
        empty = stage(spark, none.withColumnsRenamed({"score": "n_chunks_removed", "row": "text_key"}), "")
        assert empty.count() == 0
        if name == "pieces":
            got = stage(spark, clash, "")
            assert got.count() == len(start) and got.filter("not lossless").count() == 0
            continue
        got = stage(spark, clash, "")
        assert got.columns == clash.columns
        texts = [(r.doc_id, r.text) for r in start]
        if name == "quality":  # without labels all score 0.5, which is accepted
            assert told(got) == told(clash)
        if name == "linedup":
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())[:3] == sorted((i is None, i or 0, t or "") for i, t in texts)[:3]
            assert all(r.n_chunks_removed in (0.5, 7.0) and r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
        if name == "neardup":
            order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
            first = brute_components([(k, t) for k, (_, t) in enumerate(order)])
            same = lambda k, j: order[k][0] is not None and order[k][0] == order[j][0] and shingle_set(order[k][1], 4) == shingle_set(order[j][1], 4)
            want = [(i, shingle_set(t, 4)) for k, (i, t) in enumerate(order) if first[k][1] == k or same(k, first[k][1])]
            got_sets = sorted((str(r.doc_id), len(shingle_set(r.text, 4))) for r in got.collect())
            assert got_sets == sorted((str(i), len(k)) for i, k in want)
        if name == "decontam":
            words_of = shingle_set(item, 5)
            assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t or "") for i, t in texts if len(words_of & shingle_set(t, 5)) < 0.8 * len(words_of))


def test_quality_and_decontamination_stages_by_rows(spark, docs, labels, benchmark):
    import corpus_pipeline as c

    kept = {r.doc_id for r in c.good_quality(spark, docs, SF).collect()}
    scores = quality.score(docs.withColumn("held_out", lit(False)), quality.fit(docs, labels)).collect()
    assert kept == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
    items = [shingle_set(r.text, 5) for r in benchmark.collect()]
    want = {r.doc_id for r in docs.collect() if not any(s and len(s & shingle_set(r.text, 5)) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in c.decontaminated(spark, docs, SF).collect()} == want


def test_run_leaves_one_table_behind(spark):
    import os

    import corpus_pipeline as c
    from lectern.llm.core import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert c.run(spark, SF).count() > 0
    new = [f for f in set(os.listdir(folder)) - before if f.startswith("pipeline-")]
    assert len(new) == 1 and sum(not f.startswith(".") for f in os.listdir(f"{folder}/{new[0]}")) == 1

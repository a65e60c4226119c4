"""Findings of round 4: what failed before, on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import search
from lectern.operators import ground, identity

SF = "/root/testdata/sf0.001"


def test_quotes_anywhere_read_documents_once(spark):
    from lectern.plans import catalogue

    plan = catalogue.queries()["evidence_anywhere"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    # the documents, and the papers that are asked for; no runs of characters or words are made
    assert plan.count("FileScan") == 2 and "regexp_extract_all" not in plan and "xxhash64" not in plan


def test_quotes_anywhere_of_all_lengths_and_in_blocks(spark):
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "日本", "é", "doc12", "mechanism"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((0, 1, 9, 60, 2_000)))) for _ in range(40)]
    cut = lambda t: (lambda i: t[i : i + rnd.choice((4, 5, 7, 8, 9, 16, 40, 300, 5_000))])(rnd.randrange(max(1, len(t))))
    asked = [cut(t) for t in texts for _ in range(5)] + ["abc" + cut(texts[i]) for i in range(9)] + [None, "", "nowhere at all"]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[-1]), (99, None), (0, "repeated id mechanism")], "doc_id int, text string")
    quotes = spark.createDataFrame(list(enumerate(asked)), "item_id int, text string")
    norm = lambda x: " ".join((x or "").split())
    held = [*((d, norm(t)) for d, t in enumerate(texts)), (0, "repeated id mechanism")]
    want = sorted({(i, d) for i, q in enumerate(asked) if len(norm(q)) >= 4 for d, t in held if norm(q) in t})
    assert want and sorted(map(tuple, ground.found_anywhere(quotes, docs).collect())) == want
    blocks = ground.found_anywhere(quotes, docs, most=20_000)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1 and sorted(map(tuple, blocks.collect())) == want


def test_quotes_in_parts_of_a_long_text(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(3_000)) * 1_000
    at = [search._PART - 3, 2 * search._PART - 20, len(text) - 41]
    asked = [f"{text[i : i + 20]}" for i in at] + [text[at[1] : at[1] + 9_000], text[at[1] : at[1] + 9_000] + "9"]
    got = spark.createDataFrame([("x",), (text,)], "t string").select(search.quotes_held(F.col("t"), sorted(set(asked))).alias("h")).collect()
    assert [sorted(r.h) for r in got] == [[], sorted({q for q in asked if q in text})]


def test_identity_hashes_whole_texts(spark, monkeypatch):
    from lectern.functions import text

    def plain(x):
        h = 2166136261
        for c in x:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}:{len(x)}"

    monkeypatch.setattr(text, "_LISTED", 7_000)
    said = ["word " * 12_000 + end for end in ("one", "two")] + ["é" * n for n in (49_999, 50_000, 50_001, 140_000)] + ["short", ""]
    got = identity.identify(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r.content_hash for r in got] == [plain(x) for x in said] and got[0].key != got[1].key
    units = [np.frombuffer(x.encode("utf-16-be"), ">u2") for x in said]
    assert [f"{h:08x}:{len(x)}" for h, x in zip(text._fnv1a(units).tolist(), said)] == [plain(x) for x in said]  # here the last parts are lists of `_LISTED`

"""Erasure, collocations and page extraction against brute force, and on hard tables."""

import datetime
import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import collocation, erasure, mainhtml

SF = "/root/testdata/sf0.001"


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


# ---------------------------------------------------------------- 11 erasure


def in_order(row):
    return tuple((v is not None, 0 if v is None else v.encode() if isinstance(v, str) else v) for v in row)


def brute_erasure(tables, names, n_files, divisor):
    """{(table, file_no): (rows left, rows erased)}, files as lists of rows."""
    buyers = {}
    for s in tables["sales"]:
        if s[0] is not None:
            buyers[s[0]] = min([x for x in (buyers.get(s[0]), s[1]) if x is not None], default=None)
    at = {t: {c: i for i, c in enumerate(names[t])} for t in tables}
    key = {t: (lambda r, t=t: r[at[t]["client_id"]]) for t in ("clients", "clicks", "sales")} | {"sale_lines": lambda r: buyers.get(r[at["sale_lines"]["sale_id"]])}
    clicks = Counter(r[at["clicks"]["client_id"]] for r in tables["clicks"])
    counts = {r[1]: 0 for r in tables["clients"] if r[1] is not None}
    for c, m in {(r[0], r[1]) for r in tables["clients"] if r[0] is not None and r[1] is not None}:
        counts[m] += clicks[c]
    masters = {m for m in counts if crc(m) % divisor == 0} | ({min(counts, key=lambda m: (-counts[m], m))} if counts else set())
    gone = {r[0] for r in tables["clients"] if r[1] in masters} - {None}
    sold = {r[0] for r in tables["sales"] if r[1] in gone} - {None}
    victim = {"clients": lambda r: r[1] in masters, "clicks": lambda r: r[at["clicks"]["client_id"]] in gone, "sales": lambda r: r[1] in gone, "sale_lines": lambda r: r[0] in sold}
    out = {}
    for t, rows in tables.items():
        rows = sorted(rows, key=lambda r: (crc(key[t](r)), in_order(r)))
        size = 1 + len(rows) // n_files
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            left = [r for r in part if not victim[t](r)]
            if left:
                out[t, i // size] = (left, len(part) - len(left))
    return out


def against_files(spark, frames, n_files, divisor):
    names = {t: df.columns for t, df in frames.items()}
    rows = {t: [tuple(r) for r in df.collect()] for t, df in frames.items()}
    want = brute_erasure(rows, names, n_files, divisor)
    got = erasure.erasure(spark, frames, n_files, divisor).collect()
    assert {(r.table_name, r.file_no) for r in got} == set(want) and len(got) == len(want)
    folder = None
    for r in got:
        left, n = want[r.table_name, r.file_no]
        amount = names[r.table_name].index(erasure.AMOUNTS[r.table_name])
        assert (r.n_rows, r.n_erased, r.rewritten, r.columns) == (len(left), n, n > 0, ",".join(names[r.table_name]))
        assert r.cents == sum(math.floor(100 * x[amount] + 0.5) for x in left if x[amount] is not None)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in left).encode()).hexdigest()
        folder = os.path.dirname(os.path.dirname(os.path.dirname(r.path.removeprefix("file:"))))
    for r in got[:: max(1, len(got) // 12)]:
        assert [tuple(x) for x in spark.read.parquet(r.path).collect()] == want[r.table_name, r.file_no][0]
    if folder:
        there = {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}
        assert there == {r.path.removeprefix("file:") for r in got}
    return got


def test_erasure_brute_force(spark):
    got = against_files(spark, {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in erasure.AMOUNTS}, 40, 200)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


def test_erasure_hard_tables(spark):
    """Nulls everywhere, repeated rows and sales, a hot client whose files go wholly, columns called like the operator's own, an empty table."""
    at = datetime.datetime(2024, 1, 1)
    clients = [(i, i // 2 if i % 5 else None, "x", 1.5 * i, i) for i in range(40)] + [(None, 3, None, None, None), (7, 3, "x", 10.5, 7), (7, 3, "x", 10.5, 7)]
    clicks = [(i, 7 if i % 3 == 0 else i % 40, 0.005 * i, at, "p" * 50_000) for i in range(120)] + [(None, None, None, None, None)] * 3
    sales = [(i, 7 if i % 3 == 0 else i % 45 or None, 2.675, 1) for i in range(90)] + [(5, 1, 1.0, 2), (None, 7, 1.0, 2), (8, None, -0.5, None)]
    lines = [(i % 95, 2.0, i) for i in range(200)] + [(6, None, 1)] * 50 + [(None, 1.0, None)] * 2
    frames = {
        "clients": spark.createDataFrame(clients, "client_id long, master_id long, path string, balance double, file_no int"),
        "clicks": spark.createDataFrame(clicks, "click_id long, client_id long, value double, row_index timestamp_ntz, at string"),
        "sales": spark.createDataFrame(sales, "sale_id long, client_id long, total double, crc int"),
        "sale_lines": spark.createDataFrame(lines, "sale_id long, amount double, `c0` int"),
    }
    got = against_files(spark, frames, 30, 4)
    assert len({r.file_no for r in got if r.table_name == "clicks"}) < 25  # emptied files are gone
    against_files(spark, frames | {"clicks": frames["clicks"].limit(0), "sale_lines": frames["sale_lines"].limit(0)}, 30, 1000)
    assert erasure.erasure(spark, {t: df.limit(0) for t, df in frames.items()}).count() == 0


# ---------------------------------------------------------------- 12 collocations


def brute_collocations(rows, longest, least, top, inside):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    held = Counter()
    for g, a in found.items():
        for part in {(g[0], *g[i : i + k]) for k in range(2, len(g) - 1) for i in range(1, len(g) - k + 1)}:
            held[part] = max(held[part], a)
    out = {}
    for g, a in found.items():
        if 100 * held[g] >= inside * a:
            continue
        cut = lambda k: (1_000_000 * a * a // (counts[g[: k + 1]] * counts[g[:1] + g[k + 1 :]]), k, counts[g[: k + 1]], counts[g[:1] + g[k + 1 :]])
        score, _, l, r = min(cut(k) for k in range(1, len(g) - 1))
        out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("bits", [collocation.BITS, 15])
def test_collocations_brute_force(spark, bits, monkeypatch):
    if bits == 15:  # blocks, and counts that a task holds, of the smallest size
        monkeypatch.setattr(collocation, "_HELD", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    got = sorted(tuple(r) for r in collocation.collocations(docs, bits=bits).collect())
    assert got == brute_collocations(docs.collect(), 3, 10, 2000, 50) and got


def test_collocations_hard_tables(spark):
    """Null and empty texts and langs, ties, repeats, a text of many blocks, a word longer than a block, other columns."""
    rows = [(1, None, None), (2, "en", None), (None, "en", ""), (3, None, "A b c. a B c, a\tb  c\na b"), (3, None, "A b c. a B c, a\tb  c\na b"), (4, "en", "x y z " * 200_000 + "q" * 1_500_000 + " x y\x0bz" + " " * 1_200_000 + "x y"), (5, "fr", "é É é É é. x")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, lang string, text string, part int, phrase string")
    for longest, top in ((3, 2000), (4, 2), (2, 5)):
        got = sorted(tuple(r) for r in collocation.collocations(df, longest=longest, least=2, top=top, bits=16).collect())
        assert got == brute_collocations([r[1:] for r in rows], longest, 2, top, 50)
    assert collocation.collocations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 pages


def test_pages_by_their_template(spark):
    """The pages' articles, cut out by the template that all of them follow."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, got in zip(pages.orderBy("page_id").collect(), mainhtml.main_text(pages).orderBy("page_id").collect()):
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got.text == "\n\n".join(x for x in parts if x) and got.n_chars == len(got.text) and got.url == r.url


PAGES = [
    (
        '<body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a> | <a href=y>About</a></nav></header><div class="cookie-notice">We use cookies <button>OK</button></div><main><article><header><h1>The title</h1></header>'
        '<p title="a>b">First&nbsp;para &lt;b&gt; of <em>t</em>ext<br>and more.<script>var x = "</p>";</script></p><aside><p>Related stuff</p></aside><p>Ok.<ul><li>one<li>two</ul><form><label>Mail</label><input></form>'
        '<div class="share">Share it</div><div id="ad-7"><p>Buy this now</p></div><footer>Posted by</footer></article><section id="comments"><h2>Comments</h2><article><p>A long comment with many words in it.</p></article></section></main><footer>&copy; 2024</footer>',
        "The title\n\nFirst para <b> of text and more.\n\nOk.\n\none\n\ntwo",
    ),
    ('<form id=f><div class="entry-content"><h2>Head</h2><p>Some text<p>More &amp text</div><div class="sidebar"><p>Foo bar</p></div></form>', "Head\n\nSome text\n\nMore & text"),
    (
        "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h1>A heading of it</h1><p>" + "word " * 40 + "</p><p>Short one.</p><p>" + "text " * 30 + "</p><p><a href=c>Next</a></p><p><a href=d>Last</a></p>",
        "A heading of it\n\n" + " ".join(["word"] * 40) + "\n\nShort one.\n\n" + " ".join(["text"] * 30),
    ),
    (None, ""),
    ("", ""),
    ("<script>never closed <p>text", ""),
    ("<nav>a</nav><!-- open", ""),
    ("<main>" + "<p>x &lt; y" * 30_000, "\n\n".join(["x < y"] * 30_000)),
    ("<article>" + "<a " * 100_000, "<a " * 99_999 + "<a"),
]


def test_pages_hard_tables(spark):
    rows = [(None if i == 4 else i, None if i == 3 else "u", h, "t", [1]) for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string, blocks array<int>")
    got = mainhtml.main_text(pages).collect()
    assert [r.text for r in got] == [t for _, t in PAGES] + [PAGES[0][1]] and [r.n_chars for r in got] == [len(t) for _, t in PAGES] + [len(PAGES[0][1])]
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in [*rows, rows[0]]]
    assert mainhtml.main_text(pages.limit(0)).count() == 0


def test_tree_agrees_with_its_column(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    model = mainhtml.tree(spark)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in mainhtml.LABELLED], ", ".join(f"{n} double" for n in [*mainhtml.FEATURES, "label"]))
    told = model.transform(VectorAssembler(inputCols=mainhtml.FEATURES, outputCol="features").transform(rows)).select("label", "prediction", mainhtml.as_column(model, [F.col(n) for n in mainhtml.FEATURES]).alias("own")).collect()
    assert all(r.prediction == r.own for r in told) and sum(r.label == r.own for r in told) >= 0.95 * len(told)


def test_collocation_passes_hold_little():
    """A pass gives its counts in small batches, each of one language, whatever it holds."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [" ".join(f"w{i}" for i in range(60_000))] * 2})
    out = [b for b in collocation._pass(1, 1, 10, 16, None, None)(iter([texts]))]
    assert sum(b.num_rows for b in out) == 120_000 and max(b.num_rows for b in out) <= 25_000
    assert all(len(set(b.column("lang").to_pylist())) == 1 for b in out)

"""Main text of web pages: flat text blocks, told apart by a decision tree over their words and links and those of their neighbours.

A page becomes a flat list of blocks in page order (a small tokenizer, a page at a time, in linear time). Each block has its text, its words, those of
them in links, and what the markup says of its place: inside an article, inside a part that isn't one (menus, footers, comments and so on), or neither. Features,
those of the neighbours included, are array expressions within the row; the tree is trained here on the labelled table below and applied as nested CASE WHEN.
Nothing is exploded or shuffled.

Defined results: a null page is empty and an empty page, or one without a main block, has the empty text. Scripts, styles, comments, heads and form controls give no block,
closed or not. A line break is white space. Blocks of one page may repeat; all stay. Pages of any length are read whole; a tag without an end is text. Repeated rows and ids give equal rows, null ids
stay null. An empty table gives no row. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# HTML's elements by what they do to text, and words of class names and roles.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_SKIPPED = "script|style|template|noscript|noembed|noframes|iframe|object|svg|canvas|math|head|title|select|textarea|button|audio|video|map"
_AWAY = frozenset("nav footer aside menu dialog search".split())
_WEAK = frozenset("form header fieldset".split())  # undone by an article inside; a header may be an article's own
_MAIN = frozenset("article main".split())
_ROLES_AWAY = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS_AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond reply replies discussion disqus cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer legal skip".split()
)
_WORDS_WEAK = frozenset("header masthead topbar".split())
_WORDS_MAIN = frozenset("article content post entry story main".split())
_UNSURE = frozenset("has with without no js enabled".split())

#: Tag with its attributes, comment, or an element whose content isn't text. Possessive, so that no input makes it go back.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<skip>{_SKIPPED})(?=[\s/>])(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>(?<!/>).*?(?:</(?P=skip)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

MAIN, NEITHER, AWAY = 1, 0, -1
HEADING, ITEM, OTHER = 1, 2, 0


def _place(tag: str, attrs: str, outer: int, strong: bool) -> tuple[int, bool]:
    """What an element's own markup makes of the place that it is in, and whether no article inside may undo that."""
    if strong and tag != "main":
        return outer, True
    away = tag in _AWAY
    weak = tag in _WEAK and (outer != MAIN or tag != "header")
    main = tag in _MAIN
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "role":
                away |= value.lower() in _ROLES_AWAY
                main |= value.lower() in _MAIN
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                away = True
            elif name in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in _NAME.findall(one)}
                    if not words & _UNSURE:
                        away |= bool(words & _WORDS_AWAY)
                        main |= bool(words & _WORDS_MAIN) and tag not in ("a", "span")
                        weak |= bool(words & _WORDS_WEAK) and outer != MAIN
    if away:
        return AWAY, True
    if main:
        return MAIN, False
    return (AWAY, False) if weak else (outer, strong)


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """Text, words, words in links, place and kind of each block of a page."""
    out: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                names = [x[0] for x in stack[-2:]]
                kind = HEADING if names and names[-1] in ("h1", "h2", "h3", "h4", "h5", "h6") else ITEM if "li" in names else OTHER
                out.append((text, text.count(" ") + 1, min(text.count(" ") + 1, len(html.unescape("".join(linked)).split())), stack[-1][1] if stack else NEITHER, kind))
            parts.clear()
            linked.clear()

    def close(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked.append(page[at : m.start()] + " ")
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if m["end"] else 1
        elif tag in _BLOCKS:
            flush()
            link = link if tag in ("div", "p", "h1", "h2", "h3", "h4", "h5", "h6") and not m["end"] else 0
            if m["end"]:
                close((tag,), () if tag in ("table", "article", "main", "body", "html") else ("table", "td", "th") if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot") else ("table",))
            elif tag != "hr":
                if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
                if tag == "li":
                    close(("li",), ("ul", "ol", "menu", "dir"))
                elif tag in ("dd", "dt"):
                    close(("dd", "dt"), ("dl",))
                elif tag in ("td", "th"):
                    close(("td", "th"), ("table",))
                elif tag == "tr":
                    close(("tr",), ("table",))
                stack.append((tag, *_place(tag, m["attrs"], *(stack[-1][1:] if stack else (NEITHER, False)))))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_BLOCK_DDL = "array<struct<text:string,words:int,linked:int,place:int,kind:int>>"


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("place", pa.int32()), ("kind", pa.int32())]))
    keys = ("text", "words", "linked", "place", "kind")
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            found = [[dict(zip(keys, b)) for b in blocks(x.as_py() or "")] for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, kind)], ["page_id", "url", "blocks"])


#: The labelled table. place and kind as above; words, and the share of them in links, of the block before, the block and the one after (a
#: missing neighbour: 0 words, 0 share); label 1: main text.
FEATURES = ["place", "kind", "words_before", "words", "words_after", "links_before", "links", "links_after"]
LABELLED: list[tuple[int, int, int, int, int, float, float, float, int]] = [
    # in an article
    (1, 1, 1, 8, 60, 1.0, 0.0, 0.0, 1), (1, 1, 12, 1, 3, 0.0, 0.0, 0.0, 1), (1, 1, 30, 4, 80, 0.0, 0.0, 0.1, 1), (1, 1, 0, 6, 25, 0.0, 1.0, 0.0, 1),
    (1, 0, 8, 90, 40, 0.0, 0.0, 0.0, 1), (1, 0, 120, 1, 2, 0.0, 0.0, 0.0, 1), (1, 0, 2, 3, 1, 0.0, 0.0, 0.0, 1), (1, 0, 70, 2, 11, 0.0, 0.0, 0.0, 1),
    (1, 0, 60, 35, 9, 0.1, 0.2, 0.0, 1), (1, 0, 5, 250, 3, 0.0, 0.05, 1.0, 1), (1, 0, 1, 1, 14, 0.0, 0.0, 0.0, 1), (1, 0, 40, 12, 0, 0.0, 0.4, 0.0, 1),
    (1, 2, 30, 5, 6, 0.0, 0.0, 0.0, 1), (1, 2, 5, 4, 5, 0.0, 0.0, 0.0, 1), (1, 2, 6, 9, 50, 0.0, 0.5, 0.0, 1), (1, 2, 7, 6, 8, 0.0, 1.0, 0.0, 1),
    (1, 0, 44, 3, 52, 0.0, 1.0, 0.0, 1), (1, 0, 1, 17, 10, 1.0, 0.0, 0.0, 1), (1, 2, 3, 3, 3, 1.0, 1.0, 1.0, 1), (1, 0, 20, 6, 30, 0.3, 0.8, 0.0, 1),
    # in a part of another kind
    (-1, 2, 0, 1, 1, 0.0, 1.0, 1.0, 0), (-1, 2, 1, 1, 1, 1.0, 1.0, 1.0, 0), (-1, 0, 1, 8, 7, 1.0, 0.0, 0.0, 0), (-1, 0, 80, 14, 0, 0.0, 0.0, 0.0, 0),
    (-1, 0, 60, 40, 30, 0.0, 0.0, 0.0, 0), (-1, 0, 3, 120, 45, 0.0, 0.0, 0.0, 0), (-1, 1, 50, 2, 30, 0.0, 0.0, 0.0, 0), (-1, 2, 20, 25, 18, 0.0, 0.1, 0.0, 0),
    (-1, 0, 0, 22, 5, 0.0, 0.1, 0.0, 0), (-1, 1, 9, 3, 4, 0.0, 0.0, 1.0, 0), (-1, 0, 2, 2, 2, 0.0, 0.0, 0.0, 0), (-1, 0, 200, 260, 90, 0.0, 0.0, 0.0, 0),
    (-1, 2, 4, 5, 4, 1.0, 1.0, 1.0, 0), (-1, 0, 33, 6, 0, 0.0, 0.3, 0.0, 0), (-1, 1, 0, 5, 3, 0.0, 1.0, 1.0, 0), (-1, 0, 10, 18, 90, 0.0, 0.0, 0.0, 0),
    # pages whose markup says nothing: length and links decide, and what stands around a short block
    (0, 0, 2, 60, 40, 1.0, 0.0, 0.0, 1), (0, 0, 60, 45, 70, 0.0, 0.05, 0.0, 1), (0, 0, 40, 90, 3, 0.0, 0.1, 0.0, 1), (0, 0, 35, 22, 28, 0.0, 0.0, 0.0, 1),
    (0, 0, 28, 30, 2, 0.0, 0.0, 1.0, 1), (0, 0, 50, 4, 65, 0.0, 0.0, 0.0, 1), (0, 0, 44, 9, 38, 0.1, 0.0, 0.0, 1), (0, 0, 33, 2, 41, 0.0, 0.0, 0.0, 1),
    (0, 0, 25, 15, 30, 0.0, 0.1, 0.0, 1), (0, 1, 2, 6, 55, 1.0, 0.0, 0.0, 1), (0, 1, 0, 7, 34, 0.0, 0.0, 0.0, 1), (0, 1, 40, 3, 48, 0.0, 0.0, 0.0, 1),
    (0, 1, 5, 9, 21, 0.5, 0.0, 0.0, 1), (0, 2, 40, 14, 12, 0.0, 0.0, 0.0, 1), (0, 2, 12, 11, 13, 0.0, 0.0, 0.0, 1), (0, 2, 13, 25, 30, 0.0, 0.1, 0.0, 1),
    (0, 0, 21, 19, 33, 0.0, 0.2, 0.1, 1), (0, 0, 6, 150, 0, 0.0, 0.0, 0.0, 1), (0, 0, 30, 20, 0, 0.0, 0.0, 0.0, 1), (0, 0, 0, 26, 31, 0.0, 0.0, 0.0, 1),
    (0, 2, 1, 1, 1, 1.0, 1.0, 1.0, 0), (0, 2, 0, 2, 2, 0.0, 1.0, 1.0, 0), (0, 0, 2, 4, 3, 1.0, 1.0, 1.0, 0), (0, 0, 3, 10, 8, 0.9, 0.8, 1.0, 0),
    (0, 0, 50, 5, 2, 0.0, 1.0, 1.0, 0), (0, 0, 3, 3, 60, 1.0, 1.0, 0.0, 0), (0, 0, 0, 4, 1, 0.0, 0.0, 1.0, 0), (0, 0, 2, 5, 0, 1.0, 0.0, 0.0, 0),
    (0, 0, 3, 6, 4, 1.0, 0.2, 1.0, 0), (0, 1, 2, 2, 3, 1.0, 0.0, 1.0, 0), (0, 1, 45, 2, 4, 0.0, 0.0, 1.0, 0), (0, 1, 0, 3, 2, 0.0, 1.0, 1.0, 0),
    (0, 0, 0, 3, 40, 0.0, 1.0, 0.0, 0), (0, 0, 1, 1, 1, 0.0, 1.0, 1.0, 0), (0, 2, 60, 3, 3, 0.0, 1.0, 1.0, 0), (0, 0, 0, 6, 12, 0.0, 0.9, 0.0, 0),
    (0, 2, 1, 2, 40, 1.0, 1.0, 0.0, 0), (0, 0, 1, 8, 1, 1.0, 0.7, 1.0, 0), (0, 0, 1, 20, 1, 0.0, 0.9, 0.0, 0), (0, 0, 12, 9, 25, 0.0, 0.7, 0.0, 0),
    (0, 2, 30, 7, 26, 0.0, 0.9, 0.0, 0), (0, 0, 60, 11, 0, 0.0, 0.8, 0.0, 0), (0, 0, 1, 2, 2, 0.0, 0.0, 0.0, 0), (0, 0, 0, 3, 4, 0.0, 0.0, 0.0, 0),
    (0, 0, 1, 12, 50, 0.0, 0.0, 0.0, 1), (0, 0, 0, 40, 0, 0.0, 0.0, 0.0, 1), (0, 0, 1, 25, 1, 0.0, 0.1, 0.0, 1), (0, 0, 60, 5, 0, 0.0, 0.0, 0.0, 1),
    (0, 0, 2, 18, 30, 0.0, 0.2, 0.0, 1), (0, 2, 2, 16, 14, 0.0, 0.3, 0.0, 1), (0, 1, 1, 3, 30, 0.0, 0.0, 0.0, 1), (0, 0, 0, 23, 0, 0.0, 0.0, 0.0, 1),
    (0, 2, 4, 4, 5, 1.0, 1.0, 0.9, 0), (0, 0, 30, 40, 20, 0.9, 0.8, 1.0, 0), (0, 0, 5, 25, 6, 1.0, 0.7, 1.0, 0), (0, 0, 2, 7, 3, 0.0, 0.0, 0.0, 0),
]


def tree(spark: SparkSession, labelled: list[tuple] = LABELLED, depth: int = 6):
    """The decision tree fitted on the labelled table."""
    rows = spark.createDataFrame([tuple(map(float, r)) for r in labelled], ", ".join(f"{n} double" for n in [*FEATURES, "label"])).coalesce(1)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))


def as_column(model, features: list[Column]) -> Column:
    """The tree as one expression: 1.0 where it tells main text."""

    def of(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction())
        split = node.split()
        return F.when(features[split.featureIndex()] <= F.lit(split.threshold()), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._java_obj.rootNode())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    model = tree(pages.sparkSession)
    flat = pages.select("page_id", "url", "html").mapInArrow(_in_blocks, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, blocks {_BLOCK_DDL}")
    found = F.col("blocks")
    share = lambda b: F.coalesce(b["linked"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))
    count = lambda b: F.coalesce(b["words"], F.lit(0))

    def is_main(b: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(found, i - 1)), F.get(found, i + 1)
        return as_column(model, [b["place"], b["kind"], count(before), b["words"], count(after), share(before), share(b), share(after)]) > 0

    text = F.array_join(F.transform(F.filter(found, is_main), lambda b: b["text"]), "\n\n")
    return flat.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

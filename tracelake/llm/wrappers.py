"""Main text of web pages by union-free wrappers, inferred from all pages of a host.

A page is read as a tree of tags and text slots.  A wrapper is a union-free regular expression over such trees: each
place has a label and may be optional or repeated.  Neighbours of one label, and repeated groups of neighbours, are
aligned with each other and become one repeated place; two wrappers are aligned along the longest common sequence of
their labels, and what only one has becomes optional.  Equal wrappers of a host are counted once before the shuffle;
then groups of about ``GROUP`` wrappers are aligned into one, again and again, until each host has one.

Each page is then matched to its host's wrapper, which tells for every block of text the place that holds it.  A block
is a slot if the pages that have its place differ in it, and part of the template if ``ALWAYS`` of them show the same
text there; it is the template's at all places of the same labels, as an alignment may choose between them.  Templates
(menus, notices, rights, of whatever tag or class) are dropped.  For a place to count, pages with
``LEAST_PAGES`` different texts and ``LEAST_SHARE`` of the host's pages must have it, and if what would be dropped is
over ``MOST_TEMPLATE`` of the host's text, its pages are copies of each other and nothing is dropped for being equal.

Tags, roles and words of class and id are a prior: headers, sidebars, adverts, forms, scripts, styles and comments that
they name are never main, also on hosts with too few pages to tell; of the rest the article is main, or, where no page
of the host has one, the main part or the body.

Edge cases: null or empty html gives an empty text; a null url is a host of its own (the empty one); broken markup is
read as far as it goes (unclosed elements end with their parent, a tag cut off at the end is dropped; a quote that stays
open ends with its tag); a page of a host with articles that has none gives its body; equal pages give equal texts;
pages may be nested to any depth (places below ``DETAIL`` levels share those of the level); nothing is cut short.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.llm.hosts import with_host_and_path
from tracelake.session import materialise

#: Wrappers aligned in one group of a round, about.
GROUP = 64
#: Levels of a wrapper that have places of their own; what is deeper lies side by side at the last one.
DETAIL = 100
#: Longest group of neighbours that is folded when it comes twice in a row.
LONGEST_GROUP = 4
#: Share of the pages of a place that show one text there, which makes it part of the template.
ALWAYS = 0.9
#: Pages of different text, up to 64, and share of the host's pages that a place needs to have template text.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: A host whose template would be more of its text than this has copies, not a template.
MOST_TEMPLATE = 0.5
TEXT = "#"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose content is never main text; the content of the raw ones isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NOISE_TAGS = RAW | frozenset("head nav header footer aside form button select option label input dialog menu object audio video canvas datalist".split())
#: Words of class, id or role that mark what isn't main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments reply replies respond discussion notice notices cookie cookies consent gdpr alert "
    "popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended widget toolbar search "
    "pagination pager contentinfo complementary form hidden".split()
)
#: A start of one of these ends an open element of the second kind.
CLOSES = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_PART = re.compile(r">|(?<=[= \t\n])[\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts before ``at`` ends: at a > outside quotes, or, if a quote stays open, at the first > in it.

    Quotes open after a space or =.  Each look goes on from where the last one ended, so a page is read once.
    """
    while True:
        mark = _TAG_PART.search(page, at)
        if not mark:
            return -1
        if mark.group() == ">":
            return mark.start()
        close = page.find(mark.group()[-1], mark.end())
        if close < 0:
            return page.find(">", mark.end())
        at = close + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start and end tags.  Comments and declarations give none; raw elements give no text."""
    at = 0
    while at < len(page):
        mark = _MARK.search(page, at)
        if not mark:
            yield "text", "", page[at:]
            return
        if mark.start() > at:
            yield "text", "", page[at : mark.start()]
        begin = mark.start()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", begin) if page[begin + 1] in "!?" else _tag_end(page, begin + 1)
        if end < 0:
            return
        at = end + 1
        if page[begin + 1] in "!?":
            continue
        name = _NAME.match(page, begin + 1)
        tag = name.group(1).lower()
        if page[begin + 1] == "/":
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end() : end]
        if tag in RAW and page[end - 1] != "/":
            closing = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = closing.start() if closing else len(page)


@dataclass
class Node:
    """An element (or a text, labelled ``#``) of a page."""

    label: str
    tag: str = ""
    noise: bool = False
    text: str = ""
    children: list[Node] = field(default_factory=list)


def _element(tag: str, rest: str) -> Node:
    """The label of an element is its tag and the marking words of its attributes."""
    words: set[str] = set()
    hidden = False
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
            name = m.group(1).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name != "aria-hidden":
                words.update(re.findall(r"[a-z]+", value))
    marks = sorted(words & NOISE_WORDS) + ["hidden"] * hidden
    if tag == "div" and "main" in words:
        tag_label = "main"
    else:
        tag_label = tag
    noise = tag in NOISE_TAGS or (bool(marks) and tag not in ("body", "html", "article", "main"))
    return Node(".".join([tag_label, *marks]) if noise else tag_label, tag, noise)


def read(page: str) -> Node:
    """The page's tree."""
    root = Node("", "")
    stack = [root]
    for kind, tag, rest in tokens(page):
        if kind == "text":
            if not rest.isspace():
                stack[-1].children.append(Node(TEXT, text=rest))
            elif stack[-1].children:
                stack[-1].children.append(Node("", text=rest))
        elif kind == "start":
            for open_tag, closers in CLOSES.items():
                if tag in closers and len(stack) > 1:
                    depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == open_tag or stack[k].tag in BLOCKS), 0)
                    if depth and stack[depth].tag == open_tag:
                        del stack[depth:]
            node = _element(tag, rest)
            stack[-1].children.append(node)
            if tag not in VOID and not rest.endswith("/"):
                stack.append(node)
        else:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                del stack[depth:]
    return root


# A wrapper's place is [label, places below, optional, repeated].


def _merge(a: list, b: list) -> list:
    return [a[0], _align(a[1], b[1]), a[2] or b[2], a[3] or b[3]]


def _align(a: list, b: list) -> list:
    """Two sequences of places along their longest common sequence of labels; what only one has is optional."""
    if a == b:
        return a
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], a[i][1], True, a[i][3]])
            i += 1
        else:
            out.append([b[j][0], b[j][1], True, b[j][3]])
            j += 1
    return _fold(out)


def _fold(places: list) -> list:
    """Folds neighbours of one label, then groups of up to four neighbours that come twice in a row, into repeated places."""
    out: list = []
    for place in places:
        if out and out[-1][0] == place[0]:
            last = out[-1]
            out[-1] = [last[0], _align(last[1], place[1]), last[2] and place[2], place[0] != TEXT]
        else:
            out.append(place)
        for n in range(2, LONGEST_GROUP + 1):
            if len(out) >= 2 * n and [p[0] for p in out[-n:]] == [p[0] for p in out[-2 * n : -n]]:
                group = [_merge(x, y)[:3] + [True] for x, y in zip(out[-2 * n : -n], out[-n:])]
                del out[-2 * n :]
                out += group
                break
    return out


def shape(node: Node, level: int = 0) -> list:
    """The wrapper of one page."""
    if level < DETAIL:
        return _fold([[c.label, [] if c.noise else shape(c, level + 1), False, False] for c in node.children if c.label])
    labels: list[str] = []
    stack = [node.children[::-1]]
    while stack:
        if not stack[-1]:
            stack.pop()
            continue
        c = stack[-1].pop()
        if c.label:
            labels.append(c.label)
        if not c.noise:
            stack.append(c.children[::-1])
    return _fold([[label, [], False, False] for label in dict.fromkeys(labels)])


def align_all(wrappers: list[list]) -> list:
    whole = wrappers[0]
    for other in wrappers[1:]:
        whole = _align(whole, other)
    return whole


def has_label(places: list, labels: tuple[str, ...]) -> bool:
    return any(p[0] in labels or has_label(p[1], labels) for p in places)


def main_labels(wrapper: list) -> tuple[str, ...]:
    """Labels of the places that hold the main text of this wrapper's pages, () for the whole body."""
    return next((labels for labels in (("article",), ("main",)) if has_label(wrapper, labels)), ())


def _holds(node: Node, labels: tuple[str, ...]) -> bool:
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if c.label in labels:
                return True
            if not c.noise:
                stack.append(c)
    return False


def _number(*parts: object) -> int:
    """A signed 64-bit number of a place or a block."""
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


@dataclass
class _Open:
    """An element that is being matched: what is left of it, the places it may match and the block it belongs to."""

    node: Node
    left: Iterator[Node]
    places: list
    within: bool
    path: tuple[int, int]
    block: tuple[int, int]
    at: int = 0


def match(page: str | None, wrapper: list) -> list[tuple[int, int, str]]:
    """The (place, kind, text) blocks of the page's main part in order.

    The kind is the place by its labels alone: places between which an alignment could choose are of one kind.
    """
    blocks: list[tuple[int, int, str]] = []
    pieces: list[str] = []

    def flush(block: tuple[int, int]) -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            blocks.append((*block, text))

    root = read(page or "")
    labels = main_labels(wrapper)
    if not _holds(root, labels):
        labels = ()
    stack = [_Open(root, iter(root.children), wrapper, not labels, (0, 0), (0, 0))]
    while stack:
        top = stack[-1]
        node = next(top.left, None)
        if node is None:
            stack.pop()
            if top.node.tag in BLOCKS:
                flush(top.block)
            continue
        if not node.tag:
            if top.within:
                pieces.append(html.unescape(node.text))
            continue
        # The place of this element: the next of its label, else an earlier one (repeated groups), else its holder's.
        order = [*range(top.at, len(top.places)), *range(top.at)]
        found = next((k for k in order if top.places[k][0] == node.label), None)
        path, below = top.path, []
        if found is not None:
            top.at, below = found, top.places[found][1]
            path = _number("place", top.path[0], found), _number("kind", top.path[1], node.label)
        if node.tag in BLOCKS:
            flush(top.block)
        elif node.tag == "br" and top.within:
            pieces.append(" ")
        if not node.noise:
            block = path if node.tag in BLOCKS else top.block
            stack.append(_Open(node, iter(node.children), below, top.within or node.label in labels, path, block))
    flush((0, 0))
    return blocks


def main_text(page: str | None, wrapper: list) -> str:
    """The text of the page's main part: blocks in order, one a line."""
    return "\n".join(text for _, _, text in match(page, wrapper))


def infer(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (JSON), one row per host of ``pages`` (host, html)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(shape(read(p.as_py() or ""))) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "wrapper"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        whole = align_all([json.loads(w) for w in sorted(rows["wrapper"])])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    schema = "host string, wrapper string"
    now = materialise(pages.mapInArrow(shapes, schema).distinct())
    while True:
        counts = materialise(now.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return now
        bucket = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP))
        now = materialise(now.join(counts, "host").withColumn("bucket", bucket).groupBy("host", "bucket").applyInPandas(merged, schema))


_MATCHED = "blocks array<struct<slot: long, text: string>>, slots array<struct<place: long, slot: long, n: long>>, n_chars long, content int"


def matched(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, host, html, wrapper) with their blocks, their different slots, their length and a number
    below 64 of their text, in place of html and wrapper."""
    kept = ["page_id", "url", "host"]
    schema = T.StructType([*rows.select(*kept).schema.fields, *T._parse_datatype_string(_MATCHED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        types = to_arrow_schema(schema)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for page, wrapper in zip(batch.column("html"), batch.column("wrapper").to_pylist()):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                blocks = [(place, kind, _number(kind, text), text) for place, kind, text in match(page.as_py(), known[wrapper])]
                slots = {(at, slot): len(text) for *where, slot, text in blocks for at in where}
                slots |= {(at, None): 0 for *where, _, _ in blocks for at in where}
                columns[0].append([{"slot": slot, "text": text} for *_, slot, text in blocks])
                columns[1].append([{"place": at, "slot": slot, "n": n} for (at, slot), n in slots.items()])
                columns[2].append(sum(len(text) for *_, text in blocks))
                columns[3].append(_number(*(slot for *_, slot, _ in blocks)) % 64)
            given = [batch.column(c) for c in kept]
            made = [pa.array(c, types.field(k + len(kept)).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*given, *made], types.names)

    return rows.select(*kept, "html", "wrapper").mapInArrow(run, schema)


def templates(pages: DataFrame) -> DataFrame:
    """``host`` and ``template``, the slots whose text is the template's, of hosts that have any.

    Texts are counted by host and place with partial sums; a template holds no more slots than a page has, but for ``ALWAYS``.
    """
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("n_chars"))
    slots = pages.select("host", "content", F.inline("slots"))
    places = slots.filter(F.col("slot").isNull()).groupBy("host", "place").agg(F.count(F.lit(1)).alias("n_place"))
    texts = slots.filter(F.col("slot").isNotNull()).groupBy("host", "place", "slot").agg(
        F.count(F.lit(1)).alias("n_slot"), F.first("n").alias("n"), F.expr("bit_or(shiftleft(1L, content))").alias("contents")
    )
    anywhere = Window.partitionBy("host", "slot")  # a text of one kind has a row for each place of the kind
    texts = texts.filter(F.bit_count("contents") >= LEAST_PAGES).withColumn("n_anywhere", F.max("n_slot").over(anywhere))
    constant = texts.join(places, ["host", "place"]).filter(F.col("n_slot") >= ALWAYS * F.col("n_place")).join(hosts, "host")
    constant = constant.filter(F.col("n_place") >= LEAST_SHARE * F.col("n_pages"))
    constant = constant.groupBy("host", "n_chars", "slot").agg(F.max(F.col("n_anywhere") * F.col("n")).alias("n"))
    whole = constant.groupBy("host", "n_chars").agg(F.sum("n").alias("n"), F.collect_list("slot").alias("template"))
    return whole.filter(F.col("n") <= MOST_TEMPLATE * F.col("n_chars")).select("host", "template")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = with_host_and_path(pages.select("page_id", "url", "html")).drop("path")
    parts = materialise(matched(rows.join(infer(rows.select("host", "html")), "host")))
    # Written first, so that the size of the templates is known when their join with all texts is planned.
    joined = parts.select("page_id", "url", "host", "blocks").join(materialise(templates(parts)), "host", "left")
    main = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["slot"]), F.lit(False)))
    text = F.array_join(F.transform(main, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

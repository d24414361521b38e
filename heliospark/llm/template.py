"""Main text of web pages: removal of a site's templates.

Every block element of a page is a subtree with a hash of its tags and texts (attributes do not count). In Spark, subtrees
are counted per host: in how many different surroundings (parent subtrees) each one stands. Those that recur in at least
``pages`` surroundings and ``share`` of the host's different pages are the host's templates and are deleted from its
pages. A repeated part of a repeated article always has the same surroundings and therefore is no template.

What no count can show (hosts of few pages, menus and adverts that differ from page to page) goes by role: element names,
``role``, and the words of ``class`` and ``id``. Where a page marks its main part (``article``, ``main``, else a usual class
that holds most of the text), only that part is left; paragraphs, headings, lists and tables in it are never deleted
for recurring, and no template is deleted that holds more than half of the text. Without a marked part, lists that are
links throughout go too.

Blocks are joined by one space, white space (Unicode's, so that a no-break space is one) becomes one space. Broken markup
is read as far as it goes: open elements end with their parent, an open comment or script with the page.

The number of a host's templates is bounded by elements of a page / ``share``. All hosts' templates are counted first and
broadcast up to BROADCAST of them; more are joined by host, where Spark splits a host that holds many pages. A task counts
its pages' subtrees before they are shuffled. Null html is the empty page, a null url has the empty host, repeated rows give repeated results, extra columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.frames import discard, field, materialise
from heliospark.llm.urls import split_url

#: Element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes head noscript template svg object canvas audio video select button datalist "
    "nav footer aside form dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul "
    "option noscript template".split()
)
#: Blocks that hold running text: in the main part they stay however often they recur.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption caption".split())
#: A start tag ends an open element of these names, unless one of the others was opened since.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select")}
CLOSES |= {"tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
PHRASES = BLOCKS - {"p", "option"}
#: Values of ``role``, and words of ``class`` and ``id``, of parts that are no main text.
ROLES = frozenset("navigation banner contentinfo search complementary dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer colophon copyright sidebar aside rail widget "
    "widgets related recommended notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription alert "
    "paywall ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner share sharing social form "
    "search login signup comment comments disqus respond reply replies".split()
)
ARTICLE_WORDS = frozenset("comment comments reply ad ads advert advertisement sponsored promo teaser related".split())
#: ``class`` or ``id`` of a main part on pages without ``article`` and ``main``.
MAIN_NAMES = frozenset("content main article post entry story article-body post-content post-body entry-content main-content article-content".split())

#: A comment, an end tag or a start tag with its attributes, a declaration, a tag cut off by the end.
TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)"""
    r"""|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)[\s/]*+>"""
    r"""|[!?/][^>]*+>?|[a-zA-Z][^>]*+\Z)""",
    re.S,
)
CLOSING = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Templates of all hosts that are broadcast (8 bytes each).
BROADCAST = 1 << 20
#: Hosts whose templates a task remembers; results do not depend on it.
REMEMBERED = 1000
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(frozen=True)
class TemplateOptions:
    #: Least number of surroundings of a template, and their least share of the host's different pages.
    pages: int = 3
    share: float = 0.1


@dataclass(slots=True)
class Node:
    name: str
    parent: "Node | None"
    dropped: bool = False
    main: bool = False
    named: bool = False  # has a usual name of a main part
    hash: int = 0
    size: int = 0  # characters of text that are not dropped
    links: int = 0  # those in links
    anchors: int = 0
    heading: bool = False
    holds: bool = False  # a marked main part is below, in nothing that is dropped
    lost: bool = False  # a marked main part is below
    inside: bool = False  # in a marked main part
    parts: list = attribute(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return out


def opened(name: str, raw: str, parent: Node | None) -> Node:
    node = Node(name, parent, dropped=name in DROPPED or name == "header")
    node.main = name in ("article", "main")
    low = raw.lower()
    if "class" in low or "id" in low or "role" in low or "itemprop" in low:
        found = attributes(raw)
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in WORD.findall(names)}
        node.named = not MAIN_NAMES.isdisjoint(names.lower().split())
        node.main = node.main or found.get("role", "").lower() in ("main", "article") or found.get("itemprop") == "articleBody"
        if name == "article":
            node.dropped = not ARTICLE_WORDS.isdisjoint(words)
            node.main = not node.dropped
        elif name not in ("html", "body", "main"):
            node.dropped = node.dropped or found.get("role", "").lower() in ROLES or not WORDS.isdisjoint(words)
            if "header" in words:
                node.name = "header"
                node.dropped = True
    return node


class Page:
    """The block elements of a page, in order, and its texts: (element, text), a space where a block starts or ends."""

    def __init__(self, source: str):
        self.root = Node("", None)
        self.nodes = [self.root]
        self.texts: list[tuple[Node, str]] = []
        self.stack: list[tuple[str, Node]] = [("", self.root)]  # inline elements point at their block
        self.open: Counter[str] = Counter()
        self.links = 0
        at = 0
        while found := TAG.search(source, at):
            self.text(source[at : found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            name = name.lower()
            if found[1]:
                self.end(name)
                continue
            self.start(name, found[3])
            if name in RAW:
                close = CLOSING[name].search(source, at)
                at = close.end() if close else len(source)
                self.end(name)
        self.text(source[at:])
        while len(self.stack) > 1:
            self.pop()
        self.seal(self.root)

    def text(self, raw: str) -> None:
        if not raw:
            return
        node = self.stack[-1][1]
        said = html.unescape(raw) if "&" in raw else raw
        self.texts.append((node, said))
        words = " ".join(said.split())
        if words:
            node.parts.append(words)
            if not node.dropped:
                node.size += len(words)
                node.links += len(words) if self.links else 0

    def start(self, name: str, raw: str) -> None:
        if name == "br" or name == "hr":
            self.texts.append((self.stack[-1][1], " "))
        if name in VOID:
            return
        if name in PHRASES or name == "p":
            self.close({"p"}, frozenset("button caption td th table html".split()))
        if name in CLOSES:
            self.close(*CLOSES[name])
        parent = self.stack[-1][1]
        node = opened(name, raw, parent)
        if name in BLOCKS or node.dropped or node.main or node.named:
            self.nodes.append(node)
            if name in BLOCKS:
                self.texts.append((parent, " "))
        else:
            node = parent
        if name == "a":
            self.links += 1
            node.anchors += 1
        self.open[name] += 1
        self.stack.append((name, node))

    def close(self, names: set[str] | frozenset[str], until: frozenset[str]) -> None:
        """Ends the innermost open element of these names, if it is open within ``until``."""
        if not any(self.open[x] for x in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in until:
                return

    def end(self, name: str) -> None:
        # an inline end tag does not reach over a block
        self.close({name}, frozenset() if name in BLOCKS else BLOCKS)

    def pop(self) -> None:
        name, node = self.stack.pop()
        self.open[name] -= 1
        if name == "a":
            self.links -= 1
        if node is not self.stack[-1][1]:
            self.seal(node)
            if name in BLOCKS:
                self.texts.append((node.parent, " "))

    def seal(self, node: Node) -> None:
        node.hash = xxhash.xxh3_64_intdigest("\x00".join((node.name, *node.parts)).encode("utf-8", "surrogatepass"))
        up = node.parent
        if up is None:
            return
        up.parts.append(f"\x01{node.hash:x}")
        up.heading = up.heading or node.heading or node.name in ("h1", "h2")
        up.holds = up.holds or ((node.holds or node.main) and not node.dropped)
        up.lost = up.lost or node.lost or node.main
        if not node.dropped and not up.dropped:
            up.size += node.size
            up.links += node.links
            up.anchors += node.anchors

    def surroundings(self) -> Iterator[tuple[int, int]]:
        """(subtree, parent's subtree) of the elements that may be templates, and (0, page)."""
        yield 0, self.root.hash
        for node in self.nodes[1:]:
            if node.parts and node.name not in ("html", "body", "head", "li", "option", "tr", "td", "th", "dt", "dd", "tbody", "thead", "tfoot", "script", "style", "title"):
                yield node.hash, node.parent.hash

    def main_text(self, templates: frozenset[int]) -> str:
        marked = self.root.lost
        most = max((n.size for n in self.nodes if n.named and not n.dropped), default=0)
        by_name = not marked and 2 * most > self.root.size
        for node in self.nodes[1:]:  # parents come before their children
            up = node.parent
            if node.dropped and ((not self.root.holds and (node.lost or node.main)) or (node.name == "header" and up.inside and node.heading)):
                node.dropped = False
            node.inside = up.inside or (node.main if marked else by_name and node.named and node.size == most)
            if node.hash in templates and node.name not in ("html", "body") and not (node.lost or (node.inside and not up.inside)):
                node.dropped = node.dropped or not (2 * node.size > self.root.size or (node.inside and node.name in RUNNING))
            if not (marked or by_name) and node.anchors > 2 and 5 * node.links >= 4 * node.size and node.size < 50 * node.anchors:
                node.dropped = node.dropped or node.name in ("ul", "ol", "div", "section", "table")
            node.dropped = node.dropped or up.dropped
        out = [said for node, said in self.texts if said == " " or not (node.dropped or ((marked or by_name) and not node.inside))]
        return " ".join("".join(out).split())


def host_templates(rows: DataFrame, options: TemplateOptions) -> DataFrame:
    """``rows``: host, html. The hosts that have templates and the hashes of these: host, templates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], set[int]] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for own, up in Page(source or "").surroundings():
                    found.setdefault((host, own), set()).add(up)
            signed = [np.array([k[1] for k in found], np.uint64).view(np.int64), [np.array(sorted(v), np.uint64).view(np.int64) for v in found.values()]]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, signed[1])]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *signed[1]]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array(signed[0]), lists], ["host", "node", "ups"])

    found = rows.mapInArrow(scan, "host string, node long, ups array<long>").select("host", "node", F.explode("ups").alias("up"))
    counts = found.distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= options.pages)
    counts = materialise(counts, "subtrees")
    sizes = counts.where("node = 0").select("host", F.col("n").alias("pages"))
    often = counts.where("node <> 0").join(sizes, "host").where(F.col("n") >= options.share * F.col("pages"))
    out = materialise(often.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("templates")), "templates")
    discard(counts)
    return out


def extract(pages: DataFrame, options: TemplateOptions = TemplateOptions()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host"))
    found = host_templates(rows.select("host", "html"), options)
    schema = T.StructType([field(pages, "page_id"), field(pages, "url"), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for source, packed in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
                key = np.array(packed or [], np.int64).tobytes()
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = frozenset(np.frombuffer(key, np.uint64).tolist())
                texts.append(Page(source or "").main_text(known[key]))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small = (found.agg(F.sum(F.size("templates"))).first()[0] or 0) <= BROADCAST
    joined = rows.join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(scan, schema)

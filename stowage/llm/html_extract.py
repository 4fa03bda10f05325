"""Main text of web pages by paths that a host's pages agree on.

Every page scores its containers; a container's path is generalised (digits in
classes dropped) and votes for its host. The host's winning path says which
containers hold the article on all its pages, and these are extracted again.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Hosts up to this many are broadcast to the pages; more are joined by a shuffle, which Spark splits for large hosts.
BROADCAST_HOSTS = 20_000
#: A container holds the article if it has this share of the page's usable text.
SHARE = 0.7

# HTML element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template button select option datalist textarea label fieldset dialog menu iframe object svg canvas audio video map head title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body form".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}
IMPLIED = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Class and id tokens of boilerplate. A whole token has to be one of these, or one with a number after it.
SKIPPED_TOKENS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense ad-slot ad-banner ad-container adbox sponsor sponsored promo promotion banner sidebar side-bar menu main-menu nav navbar navigation main-nav "
    "breadcrumb breadcrumbs footer site-footer page-footer header site-header page-header masthead comment comments comment-list comments-area comment-form comments-section disqus disqus_thread replies "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notification notifications alert popup modal newsletter newsletter-signup subscribe signup share sharing share-buttons social social-share "
    "social-links related related-posts related-articles related-links recommended recommendations widget widgets login login-form search search-form pagination pager toolbar skip-link".split()
)
COMMENT_TOKENS = frozenset("comment comments comment-body comment-list user-comment reader-comment".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: A tag up to the > that ends it: a quote counts only where a value begins.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+)>""")
#: The same where a value's quote is never closed: the tag ends at the first >.
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")


@dataclass(slots=True)
class Node:
    """An element that may hold the article: a digest of its path, its own name, its depth, and the blocks of text in it."""

    path: str
    name: str
    depth: int
    start: int
    end: int = -1
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """(generalised name, skipped): tag.class.class without digits; whether its element, role or a whole class or id token marks boilerplate.

    The article, main and body elements themselves are no boilerplate by their
    classes, but for articles that are comments. Of other elements a token must
    be boilerplate as a whole: a share-price or related-work is text.
    """
    if not attributes:
        return tag, tag in SKIPPED
    hidden = tag in SKIPPED
    tokens: list[str] = []
    classes = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
        if name == "class":
            classes = value
        if name in ("class", "id"):
            tokens += value.lower().split()
        elif name == "role":
            hidden |= value.lower() in SKIPPED_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    general = sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})
    if not hidden and tokens:
        plain = [t.rstrip("0123456789").rstrip("-_") for t in tokens]
        if tag in ("article", "main", "body", "html"):
            hidden = tag == "article" and not COMMENT_TOKENS.isdisjoint(plain)
        else:
            hidden = not SKIPPED_TOKENS.isdisjoint(plain)
    return ".".join([tag, *general]), hidden


def _digest(parent: str, name: str) -> str:
    return hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class _Parser:
    """Reads tags in order; keeps the open elements, running totals of text, and a digest of the path instead of the path."""

    def __init__(self, source: str, kept_forms: frozenset[int] = frozenset()):
        self.source, self.kept_forms = source, kept_forms
        self.n_forms, self.forms, self.form_chars = 0, [], Counter()  # forms so far, the skipped ones that are open, text in each that nothing else skips
        self.no_data_end = False
        self.page = Page()
        self.stack: list[tuple[str, str, bool, Node | None]] = []  # tag, path digest, skipped, container
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.skipped = self.links = self.block_links = self.chars = self.linked = 0

    def close_block(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            self.page.blocks.append(line)
            self.chars += len(line)
            self.linked += min(len(line), self.block_links)
        self.block_links = 0

    def pop(self) -> None:
        tag, _, skip, node = self.stack[-1]
        if tag in BLOCKS and not self.skipped:
            self.close_block()
        self.stack.pop()
        self.open[tag] -= 1
        self.skipped -= skip
        if tag == "form" and skip:
            self.forms.pop()
        self.links -= tag == "a"
        if node is not None:
            node.end, node.chars, node.linked = len(self.page.blocks), self.chars - node.chars, self.linked - node.linked

    def pop_through(self, i: int) -> None:
        while len(self.stack) > i:
            self.pop()

    def close(self, tag: str) -> None:
        """An end tag: closes the nearest such element; an inline one doesn't close a block around which it was left open."""
        if not self.open[tag]:
            return
        inline = tag not in BLOCKS and tag not in CONTAINERS
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                return self.pop_through(i)
            if inline and self.stack[i][0] in BLOCKS:
                return

    def close_implied(self, tags: tuple[str, ...], limits) -> None:
        """Closes the nearest open element of tags unless one of limits lies in between."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return self.pop_through(i)
            if self.stack[i][0] in limits:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr" and not self.skipped:
                self.close_block()
            return
        if tag in CLOSES_P:
            self.close_implied(("p",), BLOCKS)
        if tag in IMPLIED:
            self.close_implied(("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else (tag,), IMPLIED[tag])
        if tag in BLOCKS and not self.skipped:
            self.close_block()
        name, skip = _named(tag, attributes)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            return
        if tag == "form":
            self.n_forms += 1
            skip = self.n_forms not in self.kept_forms
        path = _digest(self.stack[-1][1] if self.stack else "", name)
        node = None
        if tag in CONTAINERS and not skip and not self.skipped:
            node = Node(path, name, len(self.stack), len(self.page.blocks), chars=self.chars, linked=self.linked)
            self.page.nodes.append(node)
        self.stack.append((tag, path, skip, node))
        if tag == "form" and skip:
            self.forms.append(self.n_forms)
        self.open[tag] += 1
        self.skipped += skip
        self.links += tag == "a"

    def piece(self, piece: str) -> None:
        if not self.skipped:
            piece = html.unescape(piece)
            self.text.append(piece)
            if self.links:
                self.block_links += len(piece)
        elif self.forms and self.skipped == len(self.forms):
            self.form_chars[self.forms[0]] += len(piece.strip())

    def run(self) -> Page:
        source, n, at = self.source, len(self.source), 0
        while at < n:
            lt = source.find("<", at)
            if lt != at:
                lt = n if lt < 0 else lt
                self.piece(source[at:lt])
                at = lt
                continue
            after = source[at + 1 : at + 3]
            if after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:].isalpha() and len(after) > 1):
                at = self.markup(at)
                continue
            m = _TAG.match(source, at) or _OPEN_TAG.match(source, at)
            if m is None:
                if re.match(r"/?[a-zA-Z]", after):
                    break  # a tag that the end of the page cuts off
                self.piece("<")
                at += 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.begin(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else n
        self.pop_through(0)
        self.close_block()
        return self.page

    def markup(self, at: int) -> int:
        """The end of a comment, declaration or other <! or <? at `at`; character data is text."""
        source = self.source
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):
                return source.index(">", at) + 1
            end = _COMMENT_END.search(source, at + 4)
            return end.end() if end else len(source)
        if source.startswith("<![CDATA[", at) and not self.no_data_end:
            end = source.find("]]>", at)
            if end >= 0:
                self.piece(source[at + 9 : end])
                return end + 3
            self.no_data_end = True
        end = source.find(">", at)
        return end + 1 if end >= 0 else len(source)


def parse(source: str) -> Page:
    """Blocks of text outside boilerplate, and the containers with the range of blocks that each holds.

    Unclosed elements end with their parent. A tag ends as browsers end it: a
    quote matters only where an attribute's value begins with it, and one that
    is never closed doesn't hold back the first >. A tag, comment or script cut
    off by the end of the page has no text. Forms are boilerplate, but one that
    has more than half of the page's text frames it: the page is read again with
    that form as a plain element. Time and memory are in proportion to
    the page however deep its elements are nested.
    """
    first = _Parser(source)
    page = first.run()
    total = first.chars + sum(first.form_chars.values())
    frames = frozenset(k for k, n in first.form_chars.items() if 2 * n > total)
    return _Parser(source, frames).run() if frames else page


_NAMED_ARTICLE = re.compile(r"(?i)article|content|post|entry|story|text|body")


def _bonus(node: Node) -> float:
    """article and main need less of the page's text than others, and so do containers with a class that says so."""
    tag, _, classes = node.name.partition(".")
    if tag in ("article", "main") or re.search("article|main", classes):
        return 1.5
    return 1.25 if node.depth and _NAMED_ARTICLE.search(node.name) else 1.0


def best_container(page: Page) -> Node | None:
    """The deepest container with most of the page's text outside links."""
    usable = lambda x: max(0, x.chars - 2 * x.linked)
    most = max(map(usable, page.nodes), default=0)
    if not most:
        return None
    good = [x for x in page.nodes if usable(x) * 1.5 >= SHARE * most and usable(x) * _bonus(x) >= SHARE * most]
    return max(good, key=lambda x: (x.depth, usable(x)))


def extract(page: Page, path: str | None) -> str:
    """The text of the outermost containers with the host's path, or of the page's own best one where there is none."""
    chosen: list[tuple[int, int]] = []
    for node in page.nodes:
        if node.path == path and (not chosen or node.start >= chosen[-1][1]):
            chosen.append((node.start, node.end))
    lines = [line for a, b in chosen for line in page.blocks[a:b]]
    if not lines:
        best = best_container(page)
        lines = page.blocks[best.start : best.end] if best else page.blocks
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """Lower-case host without port and user; empty for null or a URL without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, scores = [], []
        for source in batch.column("html").to_pylist():
            best = best_container(parse(source or ""))
            paths.append(best.path if best else None)
            scores.append(float(best.chars) if best else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes on each host, ties to the higher score and then the lesser path."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, score double")
    totals = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    best = F.max_by("path", F.struct("n", "score", F.col("path")))
    return totals.groupBy("host").agg(best.alias("path"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(parse(s or ""), p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Blocks of the article are joined by \\n, white space in a block is one
    space, character references are decoded. Null or empty html has empty text.
    Pages without a host vote together; one on which the host's path has no text
    uses its own best container. Repeated rows are extracted each; other columns
    are not read, whatever their names.
    """
    winners = cut(host_paths(pages))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")

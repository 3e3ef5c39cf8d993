"""Main text of web pages by composite text density.

The page becomes a tree. Elements that are no article text by their kind or name (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut off first. A class or id name, or a form, is a hint only: the node
stays if it holds a first-level heading or, on a page without an article element outside such nodes, the main element, the
longest article element or most of the page's characters outside links. Every other node gets its link-adjusted
characters per tag; the densities of a node's children are summed, and the subtree with the largest sum holds the main text. The
smallest density on the path from the body to it is the threshold: outside an article element, a sibling subtree on that path
counts as well if its own density reaches the threshold; inside one, the whole article element is taken.

Blocks are cut at block elements and line breaks; white space inside a block becomes one space; empty blocks are left
out; blocks are joined by a line feed in page order.

Defined results: a null or empty page has an empty text; broken markup is closed as browsers do in the common cases (a new
paragraph or item ends the open one, an end tag closes all inside it, an end tag without a start is ignored); rows are
extracted one by one; extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm.exchange import give_rest, keep_rest, tidy

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
CUT = frozenset(
    "nav header footer aside script style noscript iframe textarea title head select button input template svg canvas "
    "object menu dialog xmp".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adbox sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments commentlist reply replies respond disqus discussion share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar".split())
READER_NAMES = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
ABOUT_OTHERS = frozenset("no not with without has".split())  # no-sidebar and with-sidebar are no sidebars
MOST = 2 / 3  # share of the page's characters outside links that overrules a name
LEAST = 1 / 10  # names that leave less than this share of them cut nothing
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
KEEPS_OPEN = frozenset("ul ol dl table td th div section article main body html blockquote figure".split())
ENDS_P = BLOCKS - {"br", "html", "body"}
MADE = ("text", "n_chars")


def unwanted(tag: str, attributes: str) -> bool:
    """Whether the element is no article text whatever it holds."""
    if tag in CUT:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def hinted(tag: str, attributes: str) -> set[str]:
    """Names of the element that say it is no article text."""
    found = {"form"} if tag == "form" else set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for whole in next((v for v in values if v), "").lower().split():
                for part in re.split(r"[^a-z]+", whole):
                    if part in ABOUT_OTHERS:
                        break
                    if part in CUT_NAMES:
                        found.add(part)
    return found


class Page:
    """Nodes in page order, each with its parent, and the pieces of text and block ends between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["body"], [-1], [False]
        self.hints: dict[int, set[str]] = {}
        self.pieces: list[tuple[int, str | None]] = []  # node and text; None ends a block
        open_, at = [0], 0
        for m in self.tokens(source):
            if m.start() > at:
                self.pieces.append((open_[-1], html.unescape(source[at:m.start()])))
            at = self.end
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCKS:
                self.pieces.append((open_[-1], None))
            if m[1] or m[4]:
                self.close(open_, tag)
            elif tag not in ("html", "body"):
                self.start(open_, tag, m[3] or m[6] or "")
        self.pieces.append((open_[-1], html.unescape(source[at:])))
        if self.hints:
            self.follow_hints()

    def follow_hints(self) -> None:
        """Cuts the nodes with a hint, but for those whose content overrules it."""
        n = len(self.tag)
        chars, linked = [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for node, text in self.pieces:
            if text and not self.cut[node] and not linked[node]:
                chars[node] += len("".join(text.split()))
        own = list(chars)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        under = [False] * n
        for i in range(1, n):
            under[i] = i in self.hints or under[self.parent[i]]
        articles = [i for i in range(n) if self.tag[i] in ("article", "main") and not self.cut[i] and i not in self.hints]
        known = any(not under[i] for i in articles)  # the page marks its article outside such nodes
        most = {i for i, names in self.hints.items() if chars[i] > MOST * chars[0] and not known and not names & READER_NAMES}
        holds = [i in most or self.tag[i] == "h1" and not self.cut[i] for i in range(n)]
        if articles and not known:
            longest = max(articles, key=lambda i: (self.tag[i] == "main", chars[i], -i))
            up = longest
            while up > 0 and up not in most:
                up = self.parent[up]
            holds[longest] |= up in most or not most
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        cut = list(self.cut)
        for i in range(1, n):
            free = i not in self.hints or self.tag[i] in ("article", "main") or holds[i]
            cut[i] = cut[i] or cut[self.parent[i]] or not free
        if known or sum(own[i] for i in range(n) if not cut[i]) >= LEAST * chars[0]:
            self.cut = cut

    def tokens(self, source: str):
        """Tags and comments; the inside of a raw element is skipped up to its end tag."""
        at = 0
        while (m := TOKEN.search(source, at)) is not None:
            self.end = m.end()
            tag = (m[2] or m[5] or "").lower()
            if tag in RAW and not (m[1] or m[4]):
                end = re.compile(rf"</{tag}\b", re.I).search(source, m.end())
                self.end = end.start() if end else len(source)
            at = self.end
            yield m

    def start(self, open_: list[int], tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self.end_open(open_, ("p",))
        if tag in CLOSES and tag != "p":
            self.end_open(open_, CLOSES[tag])
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(open_[-1])
        self.cut.append(self.cut[open_[-1]] or unwanted(tag, attributes))
        if not self.cut[node] and (names := hinted(tag, attributes)):
            self.hints[node] = names
        if tag not in EMPTY and not attributes.rstrip().endswith("/") or tag in RAW:
            open_.append(node)

    def end_open(self, open_: list[int], tags: tuple[str, ...]) -> None:
        """Ends the innermost open element of `tags`, unless a container stands between."""
        for i in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[i]]
            if tag in tags:
                del open_[i:]
                return
            if tag in KEEPS_OPEN:
                return

    def close(self, open_: list[int], tag: str) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if self.tag[open_[i]] == tag:
                del open_[i:]
                return


def densities(page: Page) -> tuple[list[float], list[float]]:
    """Link-adjusted density of each node and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.pieces:
        if text and not page.cut[node]:
            chars[node] += len("".join(text.split()))
    for i in range(n - 1, -1, -1):
        if page.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        up = page.parent[i]
        if up >= 0 and not page.cut[i]:
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
    whole = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if page.cut[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
        base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
        ratio = c / max(lc, 1) * t / max(lt, 1)
        density[i] = c / t * max(math.log(max(ratio, 1.0)), 0.0) / max(math.log(base), 1.0) if lc else c / t * math.log(c * t + math.e)
    for i in range(1, n):
        total[page.parent[i]] += density[i]
    return density, total


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    density, total = densities(page)
    n = len(page.tag)
    best = max(range(n), key=lambda i: (total[i], -i))
    if total[best] == 0:
        best = 0
    path = [best]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    chosen = {best}
    around = [i for i in path if page.tag[i] in ("article", "main")]
    if around:
        chosen.add(next((i for i in around if page.tag[i] == "article"), around[-1]))
    else:
        threshold = min(density[i] for i in path)
        steps = set(path)
        chosen |= {i for i in range(n) if page.parent[i] in steps and not page.cut[i] and i not in steps
                   and density[i] >= threshold > 0}
    inside = [False] * n
    for i in range(n):
        inside[i] = not page.cut[i] and (i in chosen or page.parent[i] >= 0 and inside[page.parent[i]])
    blocks, now = [], []
    for node, text in page.pieces:
        if text is None:
            blocks.append("".join(now))
            now = []
        elif inside[node]:
            now.append(text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (html and any other columns, without html) with text and n_chars."""
    kept = keep_rest(pages, "html")
    rest = kept.schema["_rest"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rest"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["_rest", *MADE])

    return give_rest(kept.mapInArrow(tidy(run), f"_rest {rest}, text string, n_chars long"), *MADE)

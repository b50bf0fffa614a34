"""HTML extraction by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset(
    "script style head noscript iframe object svg canvas template nav aside footer button select textarea input "
    "menu dialog audio video map noembed noframes title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure section".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
SCOPES = frozenset("div td tr table ul ol article section main body html blockquote aside nav header footer form li".split())
#: Words of class and id names (split at case changes and at other characters) that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comments comment commentlist disqus respond reply replies pagination pager widget toolbar skip".split()
)
#: Share of a page's unlinked text that a marked element or form may hold and still be no article.
SMALL = 0.2
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANK = re.compile(r"\s+")


class Node:
    """An element: its own texts and children in page order."""

    __slots__ = (
        "tag", "parent", "parts", "dropped", "marked", "plain", "clean", "covered", "chars", "tags", "link_chars", "link_tags", "density", "total",
    )

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, marked: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped or marked, marked and not dropped
        self.parts: list[str | Node] = []


def _judged(tag: str, attributes: str, parent: Node) -> tuple[bool, bool]:
    """Whether an element is never article text, by its name or for being hidden, and whether its role or class says so."""
    if tag in DROPPED or tag == "header" and parent.tag != "article":
        return True, False
    marked = tag == "form"
    if not attributes.strip():
        return False, marked
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name == "role" and value.lower() in ROLES:
            marked = True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            marked = marked or any(w.lower() in MARKS for w in WORDS.findall(value))
    return False, marked


def parse(page: str) -> Node:
    """The page's tree; unclosed and wrongly nested elements are closed as browsers mostly do."""
    root = Node("#root", None)
    node, at = root, 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            up: Node | None = node
            while up is not None and up.tag != tag:
                # an inline or paragraph end tag does not close the boxes around it
                up = None if up.tag in SCOPES and tag not in SCOPES else up.parent
            if up is not None and up.parent is not None and tag not in ("html", "body"):
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up is not None and up.tag not in SCOPES:
                if up.tag == "p":
                    node = up.parent
                    break
                up = up.parent
        if tag in SIBLINGS:
            ended, scope = SIBLINGS[tag]
            up, last = node, None
            while up is not None and up.tag not in scope:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        child = Node(tag, node, *_judged(tag, m.group(3) or "", node))
        node.parts.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            child.parts.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if not (m.group(3) or "").rstrip().endswith("/"):
            node = child
    return root


def _walk(root: Node, marked: bool = False) -> list[Node]:
    """All elements that are not dropped, or only for their marks where wanted; parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and (not p.dropped or marked and p.marked))
    return out


def _outer_marks(root: Node) -> list[Node]:
    """The marked elements below this one that no other marked one holds."""
    return [p for n in _walk(root) for p in n.parts if isinstance(p, Node) and p.marked]


def keep_wrappers(root: Node) -> None:
    """Take back the marks (form, role, class) of elements that hold the article.

    Marks count where the page has its text elsewhere. If article or main elements lie in marked ones only, the one with
    the most text is kept, should it hold half of the page's unlinked text or the text outside marks be a SMALL share.
    While that share is small, every marked element with more than such a share is kept, from the outermost inwards.
    """
    nodes = _walk(root, marked=True)
    if not any(n.marked for n in nodes):
        return
    for node in nodes:
        node.covered = node.marked or node.parent is not None and node.parent.covered
    for node in reversed(nodes):
        node.plain = node.clean = sum(len(BLANK.sub("", p)) for p in node.parts if isinstance(p, str))
        for p in node.parts:
            if isinstance(p, Node) and p.tag != "a" and (not p.dropped or p.marked):
                node.plain += p.plain
                node.clean += 0 if p.marked else p.clean
    least, clean = SMALL * root.plain, root.clean

    def keep(node: Node) -> int:
        node.dropped = node.marked = False
        return node.clean

    articles = [n for n in nodes if n.tag in ("article", "main")]
    best = max(articles, key=lambda n: n.clean, default=None)
    apart = any(not n.covered and n.clean >= max(least, 1) for n in articles)
    if best is not None and best.covered and not apart and (clean < least or 2 * best.clean > root.plain):
        up: Node | None = best
        while up is not None:
            clean += keep(up) if up.marked else 0
            up = up.parent
    waiting = _outer_marks(root)
    while clean < least and (large := [n for n in waiting if n.plain > least]):
        waiting = []
        for node in large:
            clean += keep(node)
            waiting += _outer_marks(node)


def measure(root: Node) -> list[Node]:
    """Characters, tags and their linked share for every element, its composite density and its children's sum."""
    nodes = _walk(root)
    for node in reversed(nodes):
        node.chars = sum(len(BLANK.sub("", p)) for p in node.parts if isinstance(p, str))
        node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, Node) and not p.dropped:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.chars if p.tag == "a" else p.link_chars
                node.link_tags += p.tags + 1 if p.tag == "a" else p.link_tags
    body = root
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t = node.chars, max(1, node.tags)
        if not c:
            node.density = 0.0
            continue
        lc, lt = node.link_chars, node.link_tags
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        ratio = c / max(1, lc) * t / max(1, lt)
        node.density = c / t * (math.log(max(ratio, 1.0)) / base if lc else 1.0)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.dropped)
    return nodes


def choose(root: Node) -> Node:
    """The subtree with the largest density sum, widened along its path to the body.

    The outermost article element on that path is the article. Without one, the element is widened to a parent while
    the parent holds more of the text: text of its own, a heading or paragraph that is not mostly links, or another
    child whose density reaches the smallest one on the path up to the body.
    """
    keep_wrappers(root)
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        return root
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    articles = [n for n in path if n.tag == "article"]
    if articles:
        return articles[-1]
    threshold = min((n.density for n in path if n.tag not in ("#root", "html")), default=0.0)
    top = best
    for child, parent in zip(path, path[1:]):
        for p in parent.parts:
            if isinstance(p, str):
                more = bool(p.strip())
            else:
                plain = p.tag in PROSE and 2 * p.link_chars < p.chars if not p.dropped else False
                more = not p.dropped and p is not child and p.chars > 0 and (plain or p.density >= threshold)
            if more:
                top = parent
                break
    return top


def blocks(node: Node) -> list[str]:
    """The texts of the element's blocks in page order: references decoded, white space as one space, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = BLANK.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif not item.dropped:
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(item.parts))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article's text, one block a line; empty for a page without any."""
    return "\n".join(blocks(choose(parse(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"],
        )


def extract_articles(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``keys`` of every page with the article's ``text`` and its length in code points.

    Pages are independent: no shuffle, repeated rows stay repeated, null or empty html gives an empty text. Columns
    other than ``keys`` and ``html`` are not read; a key named text or n_chars is refused.
    """
    if {"text", "n_chars"} & set(keys):
        raise ValueError("text and n_chars are names of the result")
    chosen = pages.select(*keys, F.col(html).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(_extract, f"{schema}, text string, n_chars long")

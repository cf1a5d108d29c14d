"""Main-text extraction by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of block tags (with class and id). Per path, text
length per node and punctuation per node are taken; along the page both ratios are smoothed and fused, and paths above a
threshold are content. Their container (the article, or else the common parent, be it the body) supplies its other nodes
too, so headings and short paragraphs around long ones stay. Nodes inside menus, headers, footers, side bars, forms, scripts, styles
(by their elements) and reader comments are never candidates; boxes that only their class, id or role names so (advert, notice,
search, ...) are left out unless their ratios show that they hold the page's main text.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map, texts_of

# A path is content if its fused ratio reaches this share of the page's mean.
THRESHOLD = 0.5
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、！？]")
# Elements whose content is text, not markup, up to their end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript", "template")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
}
# An opening tag of the key ends an open element of the value, if no other block lies between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NEVER = {
    "head", "script", "style", "title", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg",
    "canvas", "video", "audio", "dialog", "menu", "xmp",
}
_ARTICLE = {"article", "main"}
_COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
_HEADER_NAMES = {"header", "masthead", "banner"}
_NEVER_NAMES = _COMMENT_NAMES | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search",
    "pagination", "pager", "toolbar", "copyright", "contentinfo", "complementary", "dialog",
}


class _Element:
    __slots__ = ("tag", "path", "shown", "article", "doubt")

    def __init__(self, tag: str, path: str, shown: bool, article: str | None, doubt: tuple[str, ...] = ()) -> None:
        self.tag, self.path, self.shown, self.article, self.doubt = tag, path, shown, article, doubt


def _opened(parent: _Element, tag: str, attributes: str) -> _Element:
    names: set[str] = set()
    hidden = doubtful = False
    label = tag
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names.update(_NAME.findall(value))
            if key != "role":
                label += "." + re.sub(r"\d+|/", "", value)
        else:
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value) is not None)
    path = parent.path if tag in _INLINE else f"{parent.path}/{label}"
    if tag in ("html", "body"):
        names = set()
    elif tag in _ARTICLE:
        names &= _COMMENT_NAMES
    elif not parent.article and tag == "header":
        hidden = True
    elif not parent.article and names & _HEADER_NAMES:
        doubtful = True
    shown = parent.shown and not hidden and tag not in _NEVER and not names & _COMMENT_NAMES
    doubt = (*parent.doubt, path) if doubtful or names & _NEVER_NAMES else parent.doubt
    return _Element(tag, path, shown, path if tag in _ARTICLE or "main" in names and tag == "div" else parent.article, doubt)


# Path, path of the enclosing article, paths of the enclosing boxes with a suspect name, text.
_Node = tuple[str, str | None, tuple[str, ...], str]


def text_nodes(page: str) -> list[_Node]:
    """The blocks in page order.

    White space is collapsed. Blocks that the markup itself puts aside (menus, forms, scripts, comments, ...) are left out.
    """
    stack = [_Element("", "", True, None)]
    nodes: list[_Node] = []
    pieces: list[str] = []
    owner = stack[0]

    def flush() -> None:
        nonlocal owner
        if pieces:
            text = " ".join(html_module.unescape("".join(pieces)).split())
            if text:
                nodes.append((owner.path, owner.article, owner.doubt, text))
            pieces.clear()
        owner = stack[-1]

    def add(text: str) -> None:
        if text and stack[-1].shown:
            if not pieces:
                nonlocal owner
                owner = stack[-1]
            pieces.append(text)

    def close_implied(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            here = stack[i].tag
            if here == "p" or here in _ENDS.get(tag, ()):
                del stack[i:]
                if here == "p" and tag in _ENDS:
                    continue
                if tag != "tr" or here == "tr":
                    return
            elif here not in _INLINE:
                return

    at = 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or (m[2] is None and not m[0].endswith(">")):  # comment, declaration, or a tag that never ends
            continue
        closing = bool(m[1] or m[4])
        if tag not in _INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            owner = stack[-1] if not pieces else owner
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag not in _INLINE:
            close_implied(tag)
        stack.append(_opened(stack[-1], tag, m[3] or m[6] or ""))
    flush()
    return nodes


def _smooth(x: np.ndarray) -> np.ndarray:
    wide = np.pad(x, 1, mode="edge")
    return 0.25 * wide[:-2] + 0.5 * wide[1:-1] + 0.25 * wide[2:]


def _trusted(nodes: list[_Node]) -> list[tuple[str, str | None, str]]:
    """The blocks (path, article, text) outside boxes whose name alone (class, id, role) suggests boilerplate.

    Such a name is overruled by the box's ratios, unless an article stands outside all such boxes: a box of over half of the
    page's text, whose fused ratio per block is at least the mean of the page, is the main text whatever it is called. Boxes
    inside it are judged in the same way.
    """
    overruled: set[str] = set()
    if any(boxes for _, _, boxes, _ in nodes) and not any(article and not boxes for _, article, boxes, _ in nodes):
        totals: dict[str, np.ndarray] = {}
        page = np.zeros(3)
        for _, _, boxes, text in nodes:
            facts = np.array([1, len(text), len(text) * (1 + len(_MARKS.findall(text)))], float)
            page += facts
            for box in boxes:
                totals[box] = totals.get(box, 0) + facts
        overruled = {b for b, (n, size, fused) in totals.items() if 2 * size > page[1] and fused * page[0] >= page[2] * n}
    return [(path, article, text) for path, article, boxes, text in nodes if all(b in overruled for b in boxes)]


def extract(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of a page; the empty string if there is none."""
    nodes = _trusted(text_nodes(page or ""))
    if not nodes:
        return ""
    names, path = np.unique([p for p, _, _ in nodes], return_inverse=True)
    count = np.bincount(path)
    length = np.bincount(path, weights=[len(t) for _, _, t in nodes]) / count
    marks = np.bincount(path, weights=[len(_MARKS.findall(t)) for _, _, t in nodes]) / count
    fused = _smooth(length[path]) * (1 + _smooth(marks[path]))
    best = np.zeros(len(names))
    np.maximum.at(best, path, fused)
    content = best >= threshold * fused.mean()
    articles = {a for (_, a, _), p in zip(nodes, path, strict=True) if a and content[p]}
    if articles:
        keep = [a in articles for _, a, _ in nodes]
    else:
        parents = {names[p].rpartition("/")[0] for p in np.flatnonzero(content)}
        keep = [bool(content[p]) or any(name == q or name.startswith(f"{q}/") for q in parents) for (name, _, _), p in zip(nodes, path, strict=True)]
    return " ".join(t for (_, _, t), k in zip(nodes, keep, strict=True) if k)


def main_texts(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: page_id, url (null if there is no such column), text, n_chars (code points).

    Null html counts as empty; a page without main text has the empty text. Other columns are ignored; repeated rows give
    repeated rows.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url")
    source = pages.select(F.col(f"`{page_id}`").alias("page_id"), url, F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in texts_of(batch.column(2))]
            cols = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    fields = [*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return arrow_map(source, run, T.StructType(fields))

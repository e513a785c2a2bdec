"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Parts that are never text of an article go first, then those
whose class, id or role says so, unless they hold the article itself. Each
paragraph passes points for its length and its commas to its parent and half of them to its
grandparent; a container's points are discounted by its link density. The container with the
most points (the first among equals) holds the article: within an article or main element it
stands for that element, else its siblings that score well or read like text join it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head script style noscript template nav footer aside form button input select option textarea label "
    "iframe object embed svg math canvas video audio map dialog menu title".split()
)
BLOCK = frozenset(
    "html body main article section div header p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th blockquote pre figure figcaption address details summary hr fieldset center".split()
)
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = "p"  # an open paragraph ends where a block begins
ALIKE = {  # an open element of the first kind ends where one of the second begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
FENCES = frozenset("ul ol dl table article section main body div td th".split())
ASIDE = frozenset(  # words of class, id and role that mark what is not article
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar "
    "footer masthead comment comments commentlist discussion disqus replies reply respond share sharing social "
    "related recommended recommendations teaser teasers outbrain taboola tags toc contentinfo complementary search "
    "login".split()
)
REMARKS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
STATES = frozenset("has no not with without is hide show".split())  # "has-sidebar" is said of what lies beside one
KEPT = frozenset("html body main article".split())  # never dropped for their class
WORDS = re.compile("[a-z]+")
BLANKS = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts", "score", "text", "links", "commas")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Element | str] = []
        self.score, self.text, self.links, self.commas = 0.0, 0, 0, 0


class Tree(HTMLParser):
    """Elements with the usual repairs: unclosed paragraphs and items end where the next begins, a
    stray end tag is ignored, all that is open ends with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("html", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BLOCK:
            self._end_open(CLOSED_BY_BLOCK, FENCES - {"p"})
        if tag in ALIKE:
            for open_tag in ALIKE[tag]:
                self._end_open(open_tag, {"ul", "ol", "dl", "table"} - {open_tag})
        if tag in HEADING and self.here.tag in HEADING:
            self.here = self.here.parent
        child = Element(tag, dict(attrs), self.here)
        self.here.parts.append(child)
        if tag not in VOID:
            self.here = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.here.tag == tag and tag in ("svg", "path", "iframe"):
            self.here = self.here.parent

    def _end_open(self, tag, fences):
        at = self.here
        while at.parent is not None and at.tag not in fences:
            if at.tag == tag:
                self.here = at.parent
                return
            at = at.parent

    def handle_endtag(self, tag):
        at = self.here
        while at.parent is not None and at.tag != tag:
            if at.tag in FENCES and tag not in FENCES:
                return
            at = at.parent
        if at.parent is not None:
            self.here = at.parent

    def handle_data(self, data):
        if data:
            self.here.parts.append(data)


def dropped(element: Element, inside: bool) -> bool:
    """Whether an element is of a kind that is no part of an article; `inside` an article or main element."""
    tag, attrs = element.tag, element.attrs
    if tag in NEVER or (tag == "header" and not inside):
        return True
    return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"


def mark(element: Element) -> str | None:
    """What class, id and role say: "remarks" of readers, "plain" for a name that as a whole marks what is
    not article, "part" for one that does so in a part."""
    if element.tag in KEPT or not element.attrs:
        return None
    found = None
    for name in " ".join(element.attrs.get(a) or "" for a in ("class", "id", "role")).lower().split():
        words = WORDS.findall(name)
        if not words or words[0] in STATES or ASIDE.isdisjoint(words):
            continue
        if not REMARKS.isdisjoint(words):
            return "remarks"
        if len(words) == 1:
            found = "plain"
        elif found is None:
            found = "part"
    return found


def prune(root: Element) -> None:
    """Drop what is of no kind for an article, then what is marked as such and doesn't hold the article.

    A marked element holds it if it has a main element, or all article elements and most of the page's
    points. Without article and main elements outside, either of these is enough for a name marked in a
    part. Remarks are kept only around a main element."""
    stack = [(root, False)]
    while stack:
        element, inside = stack.pop()
        inside = inside or element.tag in ("article", "main")
        element.parts = [p for p in element.parts if isinstance(p, str) or not dropped(p, inside)]
        stack += [(p, inside) for p in element.parts if not isinstance(p, str)]
    elements = in_order(root)
    marks = {id(e): m for e in elements if (m := mark(e))}
    if not marks:
        return
    measure(elements)
    sums = {}  # points, articles, mains below each element; none of remarks
    for e in reversed(elements):
        points, articles, mains = (worth(e) if is_text(e) else 0.0), int(e.tag == "article"), int(e.tag == "main")
        for part in e.parts:
            if not isinstance(part, str):
                below = sums[id(part)]
                points, articles, mains = points + below[0], articles + below[1], mains + below[2]
        sums[id(e)] = (0.0, 0, mains) if marks.get(id(e)) == "remarks" else (points, articles, mains)
    all_points, all_articles, all_mains = sums[id(root)]

    def holds(e: Element) -> bool:
        points, articles, mains = sums[id(e)]
        if mains or marks[id(e)] == "remarks":
            return mains > 0
        if all_mains or articles < all_articles:
            return False
        most = 2 * points > all_points
        return most and articles > 0 if marks[id(e)] == "plain" else most or articles > 0

    for e in elements:
        e.parts = [p for p in e.parts if isinstance(p, str) or id(p) not in marks or holds(p)]


def in_order(root: Element) -> list[Element]:
    """All elements, each before those below it."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        found.append(element)
        stack += [p for p in reversed(element.parts) if not isinstance(p, str)]
    return found


def measure(elements: list[Element]) -> None:
    """Characters, characters in links and commas below each element."""
    for e in reversed(elements):
        e.text = e.links = e.commas = 0
        for part in e.parts:
            if isinstance(part, str):
                e.text += len(part.strip())
                e.commas += part.count(",") + part.count("、") + part.count("，")
            else:
                e.text, e.links, e.commas = e.text + part.text, e.links + part.links, e.commas + part.commas
        if e.tag == "a":
            e.links = e.text


def density(e: Element) -> float:
    return e.links / e.text if e.text else 0.0


def is_text(e: Element) -> bool:
    """Whether an element is a paragraph: made for text, or a division with text of its own."""
    own = e.tag in PARAGRAPH or (e.tag in BLOCK and any(isinstance(p, str) and p.strip() for p in e.parts))
    return own and e.text > 0


def worth(e: Element) -> float:
    """A paragraph's points."""
    return (1 + e.commas + min(e.text / 100, 3.0)) * (1 - density(e))


def give_points(elements: list[Element]) -> list[Element]:
    """Scored containers, in page order."""
    for e in elements:
        if not is_text(e):
            continue
        points = worth(e)
        holder = e.parent or e
        if e.tag not in PARAGRAPH:
            e.score += points
            points /= 2
        holder.score += points
        if holder.parent is not None:
            holder.parent.score += points / 2
    scored = [e for e in elements if e.score > 0]
    for e in scored:
        e.score *= 1 - density(e)
    return scored


def enclosing(element: Element) -> Element | None:
    """The nearest article around an element, else the nearest main element."""
    main, at = None, element
    while at is not None:
        if at.tag == "article":
            return at
        main = main or (at if at.tag == "main" else None)
        at = at.parent
    return main


def chosen(elements: list[Element]) -> list[Element]:
    """The article around the best container, or the main element without its lists of links; where there
    is neither, the best container and the siblings that belong to it, in page order."""
    scored = give_points(elements)
    if not scored:
        return []
    best = max(scored, key=lambda e: e.score)  # the first one among equals
    while best.tag not in BLOCK and best.parent is not None:
        best = best.parent
    around = enclosing(best)
    if around is not None:
        if around.tag == "main":
            around.parts = [
                p for p in around.parts
                if isinstance(p, str) or p.tag not in BLOCK or p.tag in PARAGRAPH or density(p) <= 0.5
            ]
        return [around]
    if best.parent is None:
        return [best]
    bar = max(10.0, best.score * 0.2)
    kept = []
    for part in best.parent.parts:
        if isinstance(part, str):
            continue
        reads = part.tag in PARAGRAPH and part.text > 80 and density(part) < 0.25
        heads = part.tag in HEADING and part.text > 0 and density(part) < 0.25
        if part is best or part.score >= bar or reads or heads:
            kept.append(part)
    return kept


def blocks(elements: Sequence[Element]) -> list[str]:
    """The texts of the blocks, white space made single blanks."""
    found: list[str] = []
    line: list[str] = []

    def end():
        text = BLANKS.sub(" ", "".join(line)).strip()
        if text:
            found.append(text)
        line.clear()

    for top in elements:
        stack: list = [top]
        while stack:
            part = stack.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(part)
            elif part.tag == "br":
                line.append(" ")
            elif part.tag in BLOCK:
                end()
                stack.append(None)
                stack += reversed(part.parts)
            else:
                stack += reversed(part.parts)
        end()
    return found


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by empty lines; empty if there is none."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    prune(tree.root)
    elements = in_order(tree.root)
    measure(elements)
    return "\n\n".join(blocks(chosen(elements)))


def extract(pages: DataFrame, html: str = "html", carry: Sequence[str] = ()) -> DataFrame:
    """Columns text, n_chars and those of `carry`, one row per page. Null or empty html, and pages
    that hold nothing but menus and the like, give an empty text. Pages are parsed one at a time
    and whole; repeated rows are alike, no rows give no rows, and carried columns may have any name."""
    rows = numbered(pages, html, carry).select("text", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["doc", "text"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, text string"
    return mapped(rows, run, schema).select(
        *carried(carry), "text", F.length("text").cast("long").alias("n_chars")
    )


def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])

"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a list of text blocks in page order. Each is described by its number of words, its link density and
those of its neighbours, and what elements and names it lies in. The tree is grown from a small labelled table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from hitloom.llm.common import slices

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Where a tag may end, or a quoted value begin: only after an equals sign does a quote hide an angle bracket.
STOP = re.compile(r">|=\s*([\"'])")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg textarea title".split()}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# Elements that flow within a line of text, and those without an end.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset("article main".split())
ASIDE_TAGS = frozenset("nav footer aside header form menu button select option dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr"
    " header login menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion related replies reply respond share sharing"
    " sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo search".split()
)


# Names that make an advert even of an element within a line.
AD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion".split())


@dataclass
class Block:
    words: int
    link_density: float
    in_article: bool
    in_aside: bool
    text: str


def names_of(rest: str) -> set[str]:
    """The words of an element's class, id and role."""
    return {part for found in NAMES.findall(rest) for part in re.split(r"[^a-z]+", "".join(found).lower())} - {""}


def _marks(tag: str, rest: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element begins main content, and whether it begins something beside it.

    A header that lies in an article, and a name such as article-header on it, is the article's own.
    """
    names = names_of(rest)
    if in_article and (tag == "header" or "header" in names):
        names.discard("header")
        tag = ""
    return tag in CONTENT_TAGS, tag in ASIDE_TAGS or bool(names & ASIDE_NAMES) and tag not in ("html", "body")


def tag_end(page: str, at: int, last: int) -> int:
    """The place of the bracket that ends a tag whose name ends before ``at``, or -1; ``last`` is the page's last one.

    A quoted value that never ends hides nothing: the tag then ends with the first bracket after its beginning.
    """
    if at > last:
        return -1
    while m := STOP.search(page, at):
        if not m[1]:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return page.find(">", m.end())
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Where markup begins and ends, and of a tag its name, whether it closes, and its attributes.

    Comments, declarations and elements with raw content are markup without a name. Every character is passed a fixed
    number of times, however broken the page is. A bracket that begins no tag is text.
    """
    at, last = page.find("<"), page.rfind(">")
    while at >= 0:
        m, end, name, close, rest = None, -1, "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 if at < last else -1
        elif m := TAG.match(page, at):
            end = tag_end(page, m.end(), last) + 1 or -1
            if end > 0:
                name, close, rest = m[2].lower(), bool(m[1]), page[m.end() : end - 1]
                if name in RAW and not close:
                    found = RAW[name].search(page, end)
                    end, name = found.end() if found else len(page), ""
        if end > 0:
            yield at, end, name, close, rest
            at = page.find("<", end)
        else:
            at = page.find("<", at + 1)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page; scripts, styles, titles, comments and other unseen parts are none."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, in an article, in something beside it
    is_open: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    linked, at = False, 0

    def end_block():
        words = html.unescape("".join(text for text, _ in parts)).split()
        if words:
            in_links = sum(len(html.unescape(t).split()) for t, in_link in parts if in_link)
            _, article, aside = stack[-1] if stack else ("", False, False)
            out.append(Block(len(words), min(1.0, in_links / len(words)), article, aside, " ".join(words)))
        parts.clear()

    for start, end, tag, close, rest in tags(page):
        if start > at:
            parts.append((page[at:start], linked))
        at = end
        if not tag:
            continue
        if tag in INLINE and not is_open[tag] and (close or not AD_NAMES & names_of(rest)):
            if tag == "a":
                linked = not close
            continue
        end_block()
        linked = False
        if tag in VOID or rest.endswith("/"):
            continue
        if close:
            while is_open[tag]:
                name = stack.pop()[0]
                is_open[name] -= 1
                if name == tag:
                    break
            continue
        if tag in ("p", "li", "option") and stack and stack[-1][0] == tag:
            stack.pop()
            is_open[tag] -= 1
        _, article, aside = stack[-1] if stack else ("", False, False)
        content, beside = _marks(tag, rest, article)
        stack.append((tag, article or content, aside or beside or tag == "head"))
        is_open[tag] += 1
    if at < len(page):
        parts.append((re.sub(r"<[a-zA-Z/!][^<]*\Z", "", page[at:]), linked))
    end_block()
    return out


#: Columns of the table: words, link density, the same of the block before and of the one after (0 words at an end),
#: whether it lies in an article or main element, whether in an element beside it; last whether it is main text.
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_article", "in_aside")
# Blocks labelled by hand.
TABLE = [
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0), (9, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0),
    (40, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), (8, 0.0, 9, 0.0, 12, 0.0, 1, 0, 1), (12, 0.0, 8, 0.0, 60, 0.0, 1, 0, 1), (60, 0.0, 12, 0.0, 45, 0.0, 1, 0, 1),
    (1, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1), (3, 0.0, 45, 0.0, 0, 0.0, 1, 0, 1), (150, 0.0, 90, 0.0, 14, 0.1, 1, 0, 1), (14, 0.1, 150, 0.0, 0, 0.0, 0, 1, 0),
    (25, 0.0, 150, 0.0, 1, 1.0, 0, 1, 0), (90, 0.0, 70, 0.0, 30, 0.0, 0, 1, 0), (90, 0.0, 70, 0.0, 30, 0.0, 1, 1, 0), (6, 1.0, 70, 0.0, 6, 1.0, 1, 1, 0),
    (6, 1.0, 80, 0.0, 60, 0.0, 1, 0, 1), (30, 0.4, 60, 0.0, 60, 0.0, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (5, 1.0, 5, 1.0, 5, 1.0, 1, 0, 0), (4, 1.0, 60, 0.0, 4, 1.0, 1, 0, 0), (4, 1.0, 4, 1.0, 0, 0.0, 1, 0, 0), (8, 1.0, 7, 1.0, 9, 1.0, 1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (4, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0), (6, 0.5, 50, 0.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (7, 0.2, 40, 0.0, 0, 0.0, 0, 0, 0),
    (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0), (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1), (5, 0.0, 50, 0.0, 70, 0.0, 0, 0, 1), (20, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1),
    (30, 0.0, 8, 0.0, 45, 0.0, 0, 0, 1), (70, 0.05, 30, 0.0, 80, 0.0, 0, 0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (50, 0.1, 60, 0.0, 5, 0.0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (25, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (40, 0.9, 3, 1.0, 3, 1.0, 0, 0, 0), (60, 0.8, 50, 0.0, 4, 1.0, 0, 0, 0),
    (20, 0.6, 3, 1.0, 20, 0.7, 0, 0, 0), (9, 0.0, 25, 0.0, 30, 0.0, 0, 0, 1), (3, 0.0, 30, 0.0, 25, 0.0, 0, 0, 1), (10, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0),
    (200, 0.0, 100, 0.0, 60, 0.0, 0, 0, 1), (200, 0.0, 100, 0.0, 60, 0.0, 0, 1, 0), (2, 0.0, 0, 0.0, 30, 0.0, 1, 0, 1), (12, 1.0, 0, 0.0, 60, 0.0, 1, 0, 1),
    (22, 0.0, 60, 0.0, 1, 1.0, 1, 0, 1), (8, 0.0, 40, 0.0, 2, 1.0, 1, 0, 1), (14, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (50, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1),
    (3, 0.0, 25, 0.0, 1, 1.0, 1, 0, 1), (20, 0.2, 30, 0.0, 4, 1.0, 1, 0, 1), (30, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0), (18, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0),
    (60, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0), (35, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0), (24, 0.0, 1, 1.0, 30, 0.0, 1, 1, 0), (45, 0.0, 3, 1.0, 1, 1.0, 1, 1, 0),
    (12, 0.0, 80, 0.0, 40, 0.0, 1, 1, 0), (28, 0.1, 4, 0.0, 2, 1.0, 0, 1, 0), (40, 0.0, 2, 1.0, 1, 1.0, 0, 0, 1), (30, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1),
]


def grow(rows: list[tuple]) -> tuple | int:
    """A tree by least Gini impurity: (feature, threshold, up to it, above it), or the label of a leaf.

    It splits until a leaf has one label; ties go to the first feature and the lowest threshold.
    """
    labels = [r[-1] for r in rows]
    if len(set(labels)) == 1:
        return labels[0]

    def impurity(part):
        share = sum(part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            left, right = [r[-1] for r in rows if r[f] <= low], [r[-1] for r in rows if r[f] > low]
            cost = impurity(left) + impurity(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (low + high) / 2)
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    _, f, threshold = best
    return f, threshold, grow([r for r in rows if r[f] <= threshold]), grow([r for r in rows if r[f] > threshold])


def is_main(tree: tuple | int, row: tuple) -> bool:
    while not isinstance(tree, int):
        f, threshold, low, high = tree
        tree = low if row[f] <= threshold else high
    return bool(tree)


def main_text(page: str, tree: tuple | int) -> str:
    found = blocks(page)
    ends = [Block(0, 0.0, False, False, "")]
    kept = []
    for before, b, after in zip(ends + found[:-1], found, found[1:] + ends):
        row = (b.words, b.link_density, before.words, before.link_density, after.words, after.link_density, int(b.in_article), int(b.in_aside))
        if is_main(tree, row):
            kept.append(b.text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, one narrow pass.

    A null or empty html, or a page without main text, gives an empty text. A page that ends within a tag loses that
    tag only. Repeated rows give repeated rows; null ids and urls stay null. Other columns play no part.
    """
    tree = grow(TABLE)
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, tree) if h else "" for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)

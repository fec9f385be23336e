"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices

SLICE_BYTES = 2 << 20
#: Share of the largest path score that a path needs to count as content by itself.
THRESHOLD = 0.25
#: Weights of a path's ratios and its two neighbours' in page order.
SMOOTHING = (0.25, 0.5, 0.25)
#: Share of all score that the content's container must hold.
HELD = 0.7
#: What a tag or mark of boilerplate, a doubtful mark, and one of an article multiplies a path's score by.
BARRED_PRIOR, DOUBT_PRIOR, ARTICLE_PRIOR = 0.002, 0.002, 8.0
#: Text that a wider container may add, as a share of what it held.
WIDENING = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_WORDS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
BOILERPLATE = frozenset("nav footer aside form button select option dialog menu head fieldset object canvas audio video map".split())
#: Words in a class, id or role that name what an article does not hold: menus, headers, footers, sidebars, notices, adverts, forms, comments.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer form "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion replies reply respond sidebar signup "
    "sponsor sponsored subscribe subscription topbar".split()
)
#: Words that often stand on such elements and as often on parts of an article; they are a prior, the text decides.
DOUBTS = frozenset("alert banner complementary related search share sharing skip social toolbar widget".split())
#: Words in a class, id or role that mark the article's own element.
ARTICLE_MARKS = frozenset("article articlebody content entry main maincontent post story".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Elements that hold one run of text; a container is wider than they are.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption summary legend center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the left closes an open one of its set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？،؟]")


class Block:
    """A run of text without a block boundary in it, and the elements around it.

    ``path`` has the tags, ``chain`` the numbers of these elements; ``barred`` tells whether one is marked as boilerplate.
    """

    __slots__ = ("path", "chain", "text", "link", "barred", "doubted")

    def __init__(self, path: tuple[str, ...], chain: tuple[int, ...], text: str, link: int, barred: bool, doubted: bool = False) -> None:
        self.path, self.chain, self.text, self.link, self.barred, self.doubted = path, chain, text, link, barred, doubted

    @property
    def kind(self) -> tuple:
        """What its path is counted under."""
        return self.path, self.barred, self.doubted


def _marks(attributes: str) -> set[str]:
    """Words of the element's class, id and role."""
    if not attributes or "=" not in attributes:
        return set()
    return {w for m in _WORDS.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower())}


def blocks(page: str) -> tuple[list[Block], set[int]]:
    """The page's text blocks in page order, and the elements marked as an article."""
    out: list[Block] = []
    hinted: set[int] = set()
    names: list[str] = []  # open block elements
    numbers: list[int] = []
    barred = doubted = 0  # depth, from 1, of the outermost open element of boilerplate and with a doubtful mark; 0 if none is open
    parts: list[str] = []
    link, in_link, made = 0, False, 0

    def close() -> None:
        nonlocal link
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(tuple(names), tuple(numbers), text, link, barred > 0, doubted > 0))
        link = 0

    def pop(depth: int) -> None:
        nonlocal barred, doubted
        del names[depth:], numbers[depth:]
        if barred > depth:
            barred = 0
        if doubted > depth:
            doubted = 0

    def text(raw: str) -> None:
        nonlocal link
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                link += len(raw)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None and m[1].lower() not in ("noscript",):
                close()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[2]
            continue
        close()
        if m[2]:
            in_link = False
            if tag in names:
                pop(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in VOID:
            continue
        in_link = False
        closing = CLOSES.get(tag)
        if closing and names and names[-1] == "p":
            pop(len(names) - 1)
        if closing and names and names[-1] in closing:
            while names and names[-1] in closing:
                pop(len(names) - 1)
        elif names and names[-1] == "p":
            pop(len(names) - 1)
        made += 1
        names.append(tag)
        numbers.append(made)
        if tag in ("article", "main"):
            hinted.add(made)
        elif tag not in ("html", "body") and not barred:
            marks = _marks(m[4])
            if tag in BOILERPLATE or marks & MARKS or (tag == "header" and hinted.isdisjoint(numbers)):
                barred = len(names)
            elif marks & DOUBTS:
                doubted = doubted or len(names)
            elif marks & ARTICLE_MARKS:
                hinted.add(made)
    if at < len(page):
        text(page[at:])
    close()
    return out, hinted


def path_scores(found: list[Block], hinted: set[int]) -> dict[tuple, tuple[float, float]]:
    """The fused score of each tag path, and its ratios alone (paths inside and outside of marked elements count apart).

    Per path: text outside of links, and punctuation marks, each by the number of blocks on the path. The two
    ratios are smoothed over the paths in page order and fused by their product; the score is that times the path's own text and, as a prior, what
    marks of boilerplate, doubtful ones or those of an article say. (Blocks under a mark of boilerplate are left out of the result whatever their
    score, and an element marked as an article is taken where the best path lies in it.)
    """
    paths: dict[tuple, list[float]] = {}
    for b in found:
        entry = paths.setdefault(b.kind, [0.0, 0.0, 0.0, 0.0])
        entry[0] += max(len(b.text) - b.link, 0)
        entry[1] += len(PUNCTUATION.findall(b.text))
        entry[2] += 1
        entry[3] += not hinted.isdisjoint(b.chain)

    def smooth(values: list[float]) -> list[float]:
        side, mid, _ = SMOOTHING
        return [mid * v + side * (values[max(i - 1, 0)] + values[min(i + 1, len(values) - 1)]) for i, v in enumerate(values)]

    lengths = smooth([e[0] / e[2] for e in paths.values()])
    marks = smooth([e[1] / e[2] for e in paths.values()])
    prior = lambda p, e: (BARRED_PRIOR if p[1] else DOUBT_PRIOR if p[2] else 1.0) * (ARTICLE_PRIOR if 2 * e[3] > e[2] else 1.0)
    fused = {p: (1 + x) * (1 + y) for p, x, y in zip(paths, lengths, marks)}
    own = {p: (1 + e[0] / e[2]) * (1 + e[1] / e[2]) for p, e in paths.items()}
    return {p: (prior(p, e) * fused[p] * e[0], own[p]) for p, e in paths.items()}


def content(found: list[Block], hinted: set[int]) -> list[Block]:
    """The blocks of the main text, by the scores of their tag paths.

    The container is the deepest element whose blocks hold most of the score, blocks of one path sharing it by their length.
    It is widened while what that adds is little, is headed or on paths of enough score, and is no
    mere links; up to an element marked as an article at once. What stands in the container is content, its title and
    short lines included, unless it is marked as boilerplate, stands under a doubtful mark and does not read like the best path, or its part of the
    container is mere links.
    """
    scored = path_scores(found, hinted)
    score = {p: x for p, (x, _) in scored.items()}
    top = max(score.values(), default=0.0)
    usual = max((own for p, (x, own) in scored.items() if x == top), default=0.0)
    # under a doubtful mark only what reads like the best path: text and punctuation of its order, and no links
    fits = lambda b: not b.doubted or 2 * b.link <= len(b.text) and scored[b.kind][1] >= THRESHOLD * usual
    size: dict[tuple, int] = {}
    for b in found:
        size[b.kind] = size.get(b.kind, 0) + len(b.text)
    weight = [score[b.kind] * len(b.text) / max(size[b.kind], 1) for b in found]
    if top <= 0:
        return [b for b in found if not b.link and not b.barred and not b.doubted]
    held: dict[int, float] = {}
    for b, w in zip(found, weight):
        for n in b.chain:
            held[n] = held.get(n, 0.0) + w
    container = max((n for n, w in held.items() if w >= HELD * sum(weight)), default=None)
    if container is None:
        return [b for b in found if not b.barred and score[b.kind] >= THRESHOLD * top]
    best = next(b for b in found if container in b.chain)
    depth = best.chain.index(container)
    while depth > 0 and best.path[depth] in LEAVES:
        depth -= 1
    article = next((k for k in range(depth, -1, -1) if best.chain[k] in hinted), None)
    inside = lambda k: [b for b in found if best.chain[k] in b.chain]
    if article is not None:
        depth = article
    else:
        while depth > 0 and best.path[depth] not in ("body", "html"):
            held_now = sum(len(b.text) for b in inside(depth))
            added = [b for b in inside(depth - 1) if best.chain[depth] not in b.chain and not b.barred and not b.doubted]
            good = all(b.path[-1] in HEADINGS or score[b.kind] >= THRESHOLD * top for b in added)
            links = sum(b.link for b in added)
            if not good or 2 * links > sum(len(b.text) for b in added) or sum(len(b.text) for b in added) > WIDENING * held_now and not all(score[b.kind] >= THRESHOLD * top for b in added):
                break
            depth -= 1
    kept = [b for b in inside(depth) if not b.barred and fits(b)]
    parts: dict[int, list[int]] = {}
    for b in kept:
        if len(b.chain) > depth + 1:
            entry = parts.setdefault(b.chain[depth + 1], [0, 0])
            entry[0] += b.link
            entry[1] += len(b.text)
    linked = {n for n, (link, whole) in parts.items() if 2 * link > whole and whole < WIDENING * sum(len(b.text) for b in kept)}
    return [b for b in kept if len(b.chain) <= depth + 1 or b.chain[depth + 1] not in linked]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content(*blocks(page or "")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", SLICE_BYTES):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null or empty page, or one without main text, gives an empty text. Pages are judged one by one,
    whole; ids and urls may be null or repeat. Other columns are not read.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

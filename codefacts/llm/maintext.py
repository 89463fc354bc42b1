"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words have positive scores where labelled pages have words of the article, tags
(and words that stand where menus and footers stand) have negative ones; a linear scan finds the contiguous region with
the largest sum. The scores are log-odds counted on labelled pages, which are pages that mark their article themselves
(exactly one ``article`` or ``main`` element); a bounded sample of them is counted. Inside the region, elements that are
no text of the article (menus, forms, scripts, adverts, notices, reader comments) are left out.

Words of class, id and role leave an element out, but never one that holds ``main`` or all articles of the page, nor one
that holds most of its words (half, or nine tenths if the name says nothing else, and the page marks no article). Words
after has, no, with, without and not say nothing. Names that only contain a word of layout (``x-widget-text``) make what
is inside count half, and leave it out if its words speak against the article.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. Null and
empty pages, and pages without words, have the empty text. Pages of any length are read whole; broken markup is read as
far as it goes; equal pages have equal texts; repeated rows are read each; an empty table gives an empty result; without
labelled pages the scores are those of the lists below. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm import grams
from codefacts.llm.batches import bounded

#: labelled pages that are counted, at most
LABELLED_PAGES = 2000
#: scores lie between these
MOST, LEAST = 4.0, 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: elements whose text is never part of an article
LEFT_OUT = frozenset("nav aside form button select option textarea script style noscript template iframe svg object dialog head title menu footer".split())
#: words of class and id that say the same
MARKS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices alert newsletter subscribe subscription signup sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs comment comments
    respond disqus related recommended share sharing social footer masthead popup modal overlay paywall skip pagination widget""".split()
)
#: of these, words that also stand in names of elements around an article; they leave out on their own only
LAYOUT = frozenset("banner notice notices alert sidebar widget promo promotion social share sharing masthead popup modal overlay paywall skip pagination".split())
#: a word after one of these does not name the element
STATES = frozenset("has no with without not".split())
#: what words count inside an element whose name contains a word of layout
LOWERED = 0.5
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(script|style|textarea|title|noscript|template)\b(?:.*?</\1\s*>|.*)|<(/?)([A-Za-z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'"<>]+)*+)>?|<[!?][^>]*>?""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


def _mark(tag: str, attributes: str) -> int:
    """What class, id and role say: 2 that the element is no text of an article, 1 that it may be none, else 0."""
    if tag in ("article", "main", "body", "html") or not attributes:
        return 0
    out = 0
    for found in _ATTRIBUTE.findall(attributes):
        for name in "".join(found).lower().split():
            parts = _PART.findall(name)
            marks = [p for k, p in enumerate(parts) if p in MARKS and not (k and parts[k - 1] in STATES)]
            if marks:
                out = max(out, 1 if len(marks) < len(parts) and LAYOUT.issuperset(marks) else 2)
    return out


def tokens(page: str) -> list[tuple[str, str, int, bool]]:
    """(key, text, words, left out): keys ``w place`` for text between tags and ``t tag`` for tags; text of tags is a break or empty.

    The place of words is the nearest element around them that is not inline, and whether a link is around them.
    """
    return _read(page)[0]


def _read(page: str) -> tuple[list[tuple[str, str, int, bool]], list[tuple[int, int]]]:
    """``tokens``, and the ranges of them that are in elements whose names may say that they are no text of an article."""
    out: list[tuple[str, str, int, bool]] = []
    stack: list[tuple[str, bool, list[int] | None]] = []  # open elements, whether their text is left out, and their entry in marked
    marked: list[list[int]] = []  # begin, end, mark, articles and mains before and inside
    hidden = links = articles = mains = paragraphs = 0

    def close(to: int) -> None:
        nonlocal hidden, links, paragraphs
        while len(stack) > to:
            tag, gone, entry = stack.pop()
            hidden -= gone
            if entry:
                entry[1] = len(out)
                entry[3:] = articles - entry[3], mains - entry[4]
            links -= tag == "a"
            paragraphs -= tag == "p"

    def words(text: str) -> None:
        n = len(text.split())
        if text:
            place = next((t for t, *_ in reversed(stack) if t not in INLINE), "")
            out.append((f"w {'link ' if links else ''}{place}", text, n, hidden > 0))

    at = 0
    for m in _TOKEN.finditer(page):
        words(page[at : m.start()])
        at = m.end()
        ending, tag = m.group(2), (m.group(3) or "").lower()
        if not tag:
            continue  # comments, declarations, and elements whose inside is no markup
        gap = "" if tag in INLINE else " "
        if ending:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            was_hidden = hidden > 0
            if depth is not None:
                close(depth)
            out.append((f"t /{tag}", gap, 0, was_hidden))
            continue
        if paragraphs and tag not in INLINE and tag not in VOID:
            # a block ends an open paragraph, with what is open inside it, however deep
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
        gone = tag in LEFT_OUT or tag == "header" and not any(t in ("article", "main") for t, *_ in stack)
        mark = 0 if gone or hidden else _mark(tag, m.group(4) or "")
        out.append((f"t {tag}", gap, 0, hidden > 0 or gone))
        if not hidden and not gone:
            articles += tag == "article"
            mains += tag == "main"
        if tag not in VOID and not (m.group(4) or "").endswith("/"):
            entry = [len(out) - 1, 0, mark, articles, mains] if mark else None
            if entry:
                marked.append(entry)
            stack.append((tag, gone, entry))
            hidden += gone
            links += tag == "a"
            paragraphs += tag == "p"
        elif mark:
            out[-1] = (f"t {tag}", gap, 0, True)
    words(page[at:])
    close(0)
    return _judged(out, marked, articles, mains)


def _judged(out: list[tuple[str, str, int, bool]], marked: list[list[int]], articles: int, mains: int) -> tuple[list[tuple[str, str, int, bool]], list[tuple[int, int]]]:
    """The tokens without what marked elements leave out, and the ranges that ``main_text`` judges by scores."""
    if not marked:
        return out, []
    before = [0, *accumulate(0 if gone else n for _, _, n, gone in out)]
    perhaps: list[tuple[int, int]] = []
    hidden_to = 0
    for begin, end, mark, own_articles, own_mains in marked:  # outer elements come first
        if begin < hidden_to:
            continue
        if own_mains or not mains and articles and own_articles == articles:
            continue
        n = before[end] - before[begin]
        if mark == 1:
            if 2 * n < before[-1] or articles or mains:
                perhaps.append((begin, end))
            continue
        if not articles and not mains and n and 10 * n >= 9 * before[-1]:
            continue
        out[begin:end] = [(key, text, n, True) for key, text, n, _ in out[begin:end]]
        hidden_to = end
    return out, perhaps


def default_score(key: str) -> float:
    """For keys that no labelled page has: words count for the article unless they are links or left out, tags against it."""
    kind, _, rest = key.partition(" ")
    if kind == "w":
        return -1.0 if rest.startswith("link") else 1.0
    return -2.0 if rest.strip("/") in LEFT_OUT else -LEAST


def main_text(page: str, scores: dict[str, float]) -> str:
    """The text of the region with the largest sum of scores; the first of several, and the shortest of those."""
    seen, perhaps = _read(page)
    values = []
    for key, _, n, gone in seen:
        score = 0.0 if gone else scores.get(key)
        if score is None:
            score = default_score(key)
        values.append(score * n if key[0] == "w" else score)
    words = [0.0, *accumulate(v if key[0] == "w" else 0.0 for v, (key, *_) in zip(values, seen, strict=True))]
    hidden_to = lowered_to = 0  # ranges may lie in each other; their words are lowered once
    for lo, hi in perhaps:
        if lo < hidden_to:
            continue
        if words[hi] - words[lo] <= 0:
            seen[lo:hi] = [(key, text, n, True) for key, text, n, _ in seen[lo:hi]]
            hidden_to = hi
            continue
        for k in range(max(lo, lowered_to), hi):
            if seen[k][0][0] == "w" and values[k] > 0:
                values[k] *= LOWERED
        lowered_to = max(lowered_to, hi)
    best = total = 0.0
    region, begin = (0, 0), 0
    for k, (_, _, _, gone) in enumerate(seen):
        if gone:
            continue  # what is left out neither joins nor parts what is around it
        total += values[k]
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, region = total, (begin, k + 1)
    raw = "".join(text for _, text, _, gone in seen[slice(*region)] if not gone)
    return " ".join(html.unescape(raw).split())


def label_counts(page: str) -> Counter:
    """(key, inside the article) of a page that marks its article; words count by number, what is left out not at all."""
    counts: Counter = Counter()
    inside = False
    for key, _, n, gone in tokens(page):
        if gone:
            continue
        if key in ("t /article", "t /main"):
            inside = False
        if key[0] == "t" or n:
            counts[key, inside] += n or 1
        if key in ("t article", "t main"):
            inside = True
    return counts


def fit(pages: DataFrame, most: int = LABELLED_PAGES) -> dict[str, float]:
    """Scores by key, counted on at most ``most`` labelled pages."""
    one = (F.regexp_count("html", F.lit("(?i)<(article|main)[\\s>]")) == 1).alias("marked")
    chosen = pages.filter(F.col("page_id").isNotNull()).select("page_id", one).filter("marked").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    ids = [(r.page_id,) for r in chosen.collect()]  # at most ``most`` ids
    if not ids:
        return {}
    sample = pages.select("page_id", "html").join(F.broadcast(pages.sparkSession.createDataFrame(ids, f"page_id {pages.schema['page_id'].dataType.simpleString()}")), "page_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                total.update(label_counts(page or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["key", "inside", "n"]
        )

    counted = bounded(sample.select("html")).mapInArrow(count, "key string, inside boolean, n long").groupBy("key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("outside")
    )
    rows = counted.collect()  # the keys of at most ``most`` pages
    return {r.key: score(r.key, r.inside, r.outside) for r in rows}


def score(key: str, inside: int, outside: int) -> float:
    """Log-odds of standing inside the article; tags never count for it."""
    odds = math.log((inside + 1) / (outside + 1))
    if key[0] == "t":
        return min(-LEAST, max(-MOST, odds))
    return max(-MOST, min(MOST, odds))


def extract(pages: DataFrame, scores: dict[str, float]) -> DataFrame:
    """page_id, url and text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in grams.slices(batch.column("html")):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(page or "", scores) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return bounded(pages.select("page_id", "url", "html")).mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")

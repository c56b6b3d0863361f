"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive, by the element they stand in; tags score negative. The weights
are log odds of being inside the content, learned from pages whose own markup says
where it is. One linear scan finds the best contiguous region.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxlake.session import write_table

# Labelled pages that the weights are fitted on, in expectation.
TRAIN_PAGES = 2_000
# Weights stay within these bounds; kinds never seen get the default.
WORD_LEAST, WORD_MOST, WORD_DEFAULT = 0.05, 4.0, 1.0
TAG_LEAST, TAG_MOST, TAG_DEFAULT = -12.0, -0.02, -1.5

# HTML elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "aside button dialog fieldset footer form head iframe menu nav noscript object option"
    " select svg template title".split()
)
CONTENT = frozenset(["article", "main"])
FORMS = frozenset(["fieldset", "form"])
# Elements that no mark hides, and words of class, id or role that mark
# what is not the article.
NEVER_MARKED = frozenset(["article", "body", "html", "main"])
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary"
    " consent contentinfo cookie cookies footer menu nav navigation newsletter notice pagination"
    " popup promo promos promotion related share sharing sidebar social sponsor sponsored sponsors"
    " subscribe widget".split()
)
# Words that turn a mark into a word about the page or about its topic, and
# words that say little as the end of a name, as builders of pages call every block so.
ABOUT_WORDS = frozenset("category format has is js no not status tag type with without".split())
VAGUE_ENDS = frozenset(["widget"])

_OPENS = re.compile(r"(/?)([a-z][a-z0-9:-]*)", re.I)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea")}
_UNQUOTED = re.compile(r"""[^<>"']*+""")


class Tag(NamedTuple):
    """Markup between two stretches of text; comments and the like have no name."""

    start: int
    end: int
    closing: bool
    name: str
    attributes: str


def markup(page: str) -> Iterator[Tag]:
    """Tags, comments, declarations, and raw elements with what they hold, in page order.

    A tag ends at the first `>` outside quotes. Where a `<` or the end of the page comes
    first, quotes mean nothing in it and in the tags up to there: each ends at its first
    `>`. What no `>` follows is text. So every character is looked at a few times, however
    broken the page.
    """
    at, broken, last = 0, 0, page.rfind(">")

    def quoted_end(place: int) -> tuple[int, bool]:
        """Where the tag whose attributes begin at `place` ends, or where it is broken."""
        while True:
            place = _UNQUOTED.match(page, place).end()
            if place >= len(page) or page[place] == "<":
                return place, False
            if page[place] == ">":
                return place, True
            closes = page.find(page[place], place + 1)
            if closes < 0:
                return len(page), False
            place = closes + 1

    while (start := page.find("<" if at <= last else "<!--", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = len(page) if close < 0 else close + 3
            yield Tag(start, at, False, "", "")
        elif start > last:
            continue
        elif page[at] in "!?":
            at = page.find(">", at) + 1
            yield Tag(start, at, False, "", "")
        elif opens := _OPENS.match(page, at):
            closing, name = bool(opens[1]), opens[2].lower()
            if not closing and name in _RAW:
                close = _RAW[name].search(page, page.find(">", opens.end()) + 1)
                at = close.end() if close else len(page)
                yield Tag(start, at, False, "", "")
                continue
            if start < broken:
                end = page.find(">", opens.end())
            else:
                end, whole = quoted_end(opens.end())
                if not whole:
                    broken, end = end, page.find(">", opens.end())
            at = end + 1
            yield Tag(start, at, closing, name, page[opens.end():end])


_MARKED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# (kind, words or None, text or None, inside content, new block before)
Token = tuple[str, int, str, bool, bool]


_JOINT = re.compile(r"[-_:]+")


def _mark(attributes: str) -> str:
    """What class, id and role say of an element: "whole", "part" or nothing.

    A word of the lists is a whole mark when it stands alone between blanks, or when it
    speaks of comments, and otherwise part of one when it begins or ends a longer name, as
    in `sidebar--left` and `cookie-notice`.
    """
    part = ""
    for name in " ".join("".join(m) for m in _MARKED.findall(attributes)).lower().split():
        if name in OTHER_WORDS or name in COMMENT_WORDS:
            return "whole"
        words = [w for w in _JOINT.split(name) if w]
        if len(words) < 2 or words[0] in ABOUT_WORDS:
            continue
        if words[0] in COMMENT_WORDS or words[-1] in COMMENT_WORDS:
            return "whole"
        if words[0] in OTHER_WORDS or words[-1] in OTHER_WORDS and words[-1] not in VAGUE_ENDS:
            part = "part"
    return part


def _kind(name: str, attributes: str) -> tuple[str, str]:
    """Kind of an element, and how its attributes mark it as not the article."""
    return name, "" if name in NEVER_MARKED or not attributes else _mark(attributes)


_HOLDS = re.compile(r"<(?:article|main|fieldset|form)\b|[-_:](?:%s)\b|\b(?:%s)[-_:]" % (
    "|".join(sorted(OTHER_WORDS)), "|".join(sorted(OTHER_WORDS))
), re.I)


def _plain(page: str, found: list[Tag]) -> set[int]:
    """Start tags, by their place in `found`, of elements that are not hidden for what they hold.

    These are elements that hold an article or main element, unless a longer one stands
    beside them, as with an article and its comments; and forms with most of the words
    that stand outside other boilerplate. A form without end tag ends as in `tokens`.
    """
    if not _HOLDS.search(page):
        return set()
    # [name, place, words before, seen words before, boilerplate, marked in part, most words
    # of an article inside or None], and how often each name is open.
    opened: list[list] = []
    names: Counter[str] = Counter()
    # Place, end, name, marked in part, words, seen words, most words of an article inside.
    spans: list[tuple[int, int, str, bool, int, int, int | None]] = []
    words = seen = hidden = 0

    def close(name: str | None, end: int) -> None:
        nonlocal hidden
        while opened:
            last, place, before, seen_before, boilerplate, part, most = opened.pop()
            names[last] -= 1
            hidden -= boilerplate
            own = words - before
            if boilerplate or part or last in CONTENT or last in FORMS or last == "header":
                spans.append((place, end, last, part, own, seen - seen_before, most))
            if opened and (last in CONTENT or most is not None):
                opened[-1][6] = max(opened[-1][6] or 0, most or 0, own if last in CONTENT else 0)
            if last == name:
                return

    at = 0
    for k, tag in enumerate(found):
        n = len(page[at:tag.start].split())
        words += n
        seen += 0 if hidden else n
        at = tag.end
        if not tag.name:
            continue
        if tag.closing:
            if names[tag.name]:
                close(tag.name, k)
            continue
        if tag.name not in INLINE and names["p"]:
            close("p", k)
        if tag.name in VOID or tag.attributes.rstrip().endswith("/"):
            continue
        mark = _kind(tag.name, tag.attributes)[1]
        boilerplate = mark == "whole" or tag.name in BOILERPLATE and tag.name not in FORMS
        opened.append([tag.name, k, words, seen, boilerplate, mark == "part", None])
        names[tag.name] += 1
        hidden += boilerplate
    n = len(page[at:].split())
    words += n
    seen += 0 if hidden else n
    close(None, len(found))

    longest = sorted(n for _, _, name, _, n, _, _ in spans if name in CONTENT)
    around: list[int] = []  # minus the words of the articles around, the longest first
    ends: list[int] = []
    plain = set()
    for place, end, name, part, n, inside, most in sorted(spans):
        while ends and ends[-1] <= place:
            ends.pop()
            around.pop()
        # Articles longer than those inside stand around, are this one, or stand beside.
        least = most or 0
        longer = len(longest) - bisect_right(longest, least) - bisect_left(around, -least)
        beside = longer > (name in CONTENT and n > least)
        wide = name in FORMS or part and not longest and name not in BOILERPLATE
        if most is not None and not beside or wide and 2 * inside > seen:
            plain.add(place)
        if name in CONTENT:
            ends.append(end)
            around.append(-n)
    return plain


def tokens(page: str) -> Iterator[Token]:
    """Tags and stretches of text, in page order; character references are decoded.

    What stands inside boilerplate elements is left out, their own tags are not. An
    element is no boilerplate when it holds the article, or is a form with most of the
    words. Markup may be broken:
    an end tag without its start is ignored, a block ends an open paragraph, and an
    element that is never closed ends with the one around it.
    """
    # (name, boilerplate, innermost link or block), and how often each name is open.
    opened: list[tuple[str, bool, str]] = []
    names: Counter[str] = Counter()
    content = hidden = 0
    fresh = True

    def close(name: str) -> None:
        nonlocal content, hidden
        while opened:
            last, boilerplate, _ = opened.pop()
            names[last] -= 1
            content -= last in CONTENT
            hidden -= boilerplate
            if last == name:
                return

    def words(text: str) -> Iterator[Token]:
        nonlocal fresh
        text = html.unescape(text)
        if hidden or not text:
            return
        n = len(text.split())
        if n:
            yield opened[-1][2] if opened else "", n, text, content > 0, fresh
            fresh = False
        elif not fresh:
            yield "", 0, " ", content > 0, False

    at = 0
    found = list(markup(page))
    plain = _plain(page, found)
    for k, tag in enumerate(found):
        yield from words(page[at:tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name not in INLINE:
            fresh = True
        elif name == "br" and not hidden:
            yield "", 0, " ", content > 0, False
        if tag.closing:
            if names[name]:
                before = hidden
                close(name)
                if not before or not hidden:
                    yield "/" + name, -1, "", content > 0, fresh
            continue
        kind, marked = _kind(name, tag.attributes)
        marked = bool(marked) and k not in plain
        if name not in INLINE and names["p"]:
            close("p")
        if not hidden:
            yield kind + "!" * marked, -1, "", content > 0, fresh
        if name in VOID or tag.attributes.rstrip().endswith("/"):
            continue
        outside = name == "header" and not content
        boilerplate = marked or (name in BOILERPLATE or outside) and k not in plain
        inline = name in INLINE and name != "a"
        opened.append((name, boilerplate, opened[-1][2] if inline and opened else "" if inline else name))
        names[name] += 1
        content += name in CONTENT
        hidden += boilerplate
    yield from words(page[at:])


def _learned(pages: DataFrame, wanted: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by element and of tags, from about `wanted` labelled pages."""
    labelled = pages.select("page_id", "html").where(F.lower("html").contains("<article"))
    found = labelled.count()
    part = F.pmod(F.xxhash64(F.lit("train"), "page_id"), F.lit(1_000_000)) / 1_000_000

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, bool, bool]] = Counter()
            for page in batch.column(0):
                for kind, words, _, inside, _ in tokens(page.as_py()):
                    if words:
                        seen[kind, words > 0, inside] += max(words, 1)
            columns = list(zip(*[(*k, n) for k, n in seen.items()])) or [()] * 4
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "word", "inside", "n"]
            )

    counted = write_table(
        labelled.where(part < wanted / max(found, 1)).select("html")
        .mapInArrow(count, "kind string, word boolean, inside boolean, n long")
        .groupBy("kind", "word").agg(
            F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
            F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"),
        ).where("inside + outside > 1"), "weights",
    ).collect()
    words, tags = {}, {}
    for r in counted:
        odds = float(np.log((r["inside"] + 0.5) / (r["outside"] + 0.5)))
        if r["word"]:
            words[r["kind"]] = min(max(odds, WORD_LEAST), WORD_MOST)
        else:
            tags[r["kind"]] = min(max(odds, TAG_LEAST), TAG_MOST)
    return words, tags


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, the first of equals; (0, 0) if none is positive."""
    best, bounds = 0.0, (0, 0)
    total, start = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, bounds = total, (start, k + 1)
    return bounds


def main_text(page: str, words: dict[str, float], tags: dict[str, float]) -> str:
    """Blocks of the best region, one a line."""
    found = list(tokens(page))
    scores = [
        tags.get(kind, TAG_DEFAULT) if n < 0 else n * words.get(kind, WORD_DEFAULT)
        for kind, n, *_ in found
    ]
    start, end = best_region(scores)
    blocks: list[list[str]] = []
    for _, n, text, _, fresh in found[start:end]:
        if n < 0:
            continue
        if fresh or not blocks:
            blocks.append([])
        blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, wanted: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages` (page_id, url, html).

    Weights are fitted on about `wanted` pages that have an article element, picked by
    a hash of the id; without such pages defaults hold. A null or wordless page
    gives the empty text. Rows with null or equal ids are treated one by one; an
    empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(_learned(pages, wanted))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tags = shared.value
        for batch in batches:
            texts = [main_text(p.as_py() or "", words, tags) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )

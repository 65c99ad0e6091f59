"""Main text of web pages by line-block distribution.

A page's markup is read once; block-level tags end a line, so that a line is one
block of text.  Lines of elements that are page furniture (navigation, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) have no
weight.  An element that only a word in its class or id calls furniture is judged
by its text first: the heaviest is none if it holds ``HELD`` of the text that is
not yet furniture, more than a window of surges and mostly outside of links; then
the elements in it are judged.  So a wrapper named after what it holds (a layout
with a sidebar) keeps its text, and the sidebar in it goes.  If the page marks its article, lines outside of it have none either, and
if not, lines in runs of pure links have none.  Weights are summed over windows of
``WINDOW`` lines; windows that are not empty make stretches, from a surge to a
dive.  A stretch in which a window rises over the threshold is kept whole; where
none does, the heaviest is taken for one.  Short stretches are kept if they lie
between such ones, next to one, or in the element that holds one.  On pages that
mark their article the threshold is 0: all weighted lines are kept.

Blocks have their character references decoded, white space made one space and
trimmed; they are joined by an empty line.  Defined results: a null or empty
page, and one without weighted lines, gives the empty text; malformed UTF-8
bytes become replacement characters; unclosed elements end with their parent or
the article's start; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html
import os.path
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

WINDOW = 3          # lines of a block
SURGE = 80          # characters of a window that starts the text, where no article is marked
MENU = 3            # consecutive lines of pure links that make a menu, where no article is marked
HELD = 0.75         # share of the text that makes an element with a furniture word the page's text
DEEP = 64           # depth to which the elements that hold a line are told apart

# Element names by what they do here.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object noframes xmp".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
ARTICLE = frozenset("article main".split())
# Words in class, id or role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets related recommended recommendations share "
    "sharing social menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead pagination pager login searchform searchbox search toolbar "
    "complementary contentinfo skip skiplink outbrain taboola paywall".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion reactions".split())
HEADER_WORDS = frozenset("header topbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:@][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if "=" in text or text.strip(" /") else {}


def _named(attributes: dict[str, str]) -> set[str]:
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    return {w.lower() for w in _WORD.findall(names)} | set(names.lower().split())


class Line:
    __slots__ = ("parts", "linked", "article", "furniture", "path", "named")

    def __init__(self, article: bool, furniture: bool, path: tuple[int, ...], named: tuple[int, ...]):
        self.parts, self.linked, self.article, self.furniture, self.path, self.named = [], 0, article, furniture, path, named

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def read_lines(page: str) -> tuple[list[Line], bool]:
    """(lines of a page in order, whether it marks its article)."""
    stack: list[tuple[str, str]] = []  # open elements: name, and why its text is furniture
    path: tuple[int, ...] = ()  # their numbers, up to a depth of DEEP
    opened = 0
    lines, marked, links = [], False, 0
    articles, reasons = 0, 0
    named: list[int] = []  # open elements that only a word calls furniture
    line = Line(False, False, path, ())
    raw_until = None
    at, size = 0, len(page)

    def cut() -> None:
        nonlocal line
        lines.append(line)
        line = Line(articles > 0, reasons > 0, path, tuple(named))

    def close(depth: int) -> None:
        nonlocal articles, reasons, path
        for name, why in stack[depth:]:
            articles -= name in ARTICLE and not why
            reasons -= why in ("furniture", "comments")
            if why == "named":
                named.pop()
        del stack[depth:]
        path = path[:depth]

    while at < size:
        if raw_until:
            m = re.compile(rf"</{raw_until}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw_until = m.end() if m else size, None
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["cdata"]
        if text:
            line.parts.append(text)
            line.linked += len(text.strip()) if links else 0
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                cut()
            continue
        if tag in RAW:
            raw_until = None if m["attrs"].endswith("/") else re.escape(tag)
            continue
        if tag == "a":
            links = 1
        if tag == "br":
            line.parts.append(" ")
        if tag not in BLOCKS and tag not in ("span", "ins", "label"):
            if tag not in VOID:
                line.parts.append("")
            continue
        attributes = _attributes(m["attrs"])
        names = _named(attributes) if attributes else set()
        why = ""
        if tag in ("html", "body"):
            why = ""
        elif names & COMMENT_WORDS or tag == "article" and articles and any(n == "article" and not w for n, w in stack):
            why = "comments"
        elif tag == "header" and articles:
            why = ""
        elif tag in FURNITURE or names and FURNITURE_WORDS & set(attributes.get("role", "").lower().split()) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            why = "furniture"
        elif names & FURNITURE_WORDS or names & HEADER_WORDS and not articles:
            # very deep ones are judged with the element around them
            why = "furniture" if tag not in BLOCKS else "named" if len(named) < DEEP else ""
        if tag not in BLOCKS and not why:
            continue
        if tag in ARTICLE and not why:
            # an article ends furniture that was left open, but for comments and related texts
            for depth, (_, w) in enumerate(stack):
                if w in ("furniture", "named"):
                    close(depth)
                    break
            marked = marked or not reasons and not named
        if tag in BLOCKS and tag not in VOID and tag != "p" or why:
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            stack.append((tag, why))
            opened += 1
            if len(stack) <= DEEP:
                path += (opened,)
            articles += tag in ARTICLE and not why
            reasons += why in ("furniture", "comments")
            if why == "named":
                named.append(opened)
            if tag not in BLOCKS:  # an inline advert or notice: its text goes, the line goes on
                m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = m.end() if m else at
                close(len(stack) - 1)
                continue
        cut()
    cut()
    return lines, marked


def furniture(lines: list[Line], texts: list[str], marked: bool) -> list[bool]:
    """Which lines belong to furniture, after named elements were judged."""
    may_be = [not line.furniture and (line.article or not marked) for line in lines]
    held: dict[int, list[int]] = {}
    free, outer = 0, {}
    for line, t, ok in zip(lines, texts, may_be, strict=True):
        if not ok:
            continue
        free += 0 if line.named else len(t)
        for k, element in enumerate(line.named):
            outer[element] = line.named[k - 1] if k else None
            own = held.setdefault(element, [0, 0])  # characters, those of links
            own[0] += len(t)
            own[1] += min(line.linked, len(t))
    lifted: set[int] = set()
    open_ = [(-held[e][0], e) for e in held if outer[e] is None]
    heapq.heapify(open_)
    while open_:
        heaviest = heapq.heappop(open_)[1]
        chars, linked = held[heaviest]
        if chars < HELD * (chars + free) or chars <= WINDOW * SURGE:
            break  # nor is any of the others heavy enough
        if 2 * linked < chars:
            lifted.add(heaviest)
            for e in held:
                if outer[e] == heaviest:
                    heapq.heappush(open_, (-held[e][0], e))
            free += sum(len(t) for line, t, ok in zip(lines, texts, may_be, strict=True) if ok and line.named and line.named[-1] == heaviest)
    return [line.furniture or not lifted.issuperset(line.named) for line in lines]


def weights(lines: list[Line], texts: list[str], marked: bool) -> np.ndarray:
    """Characters of each line that may be main text."""
    out = np.array([len(t) if not away and (line.article or not marked) else 0 for line, t, away in zip(lines, texts, furniture(lines, texts, marked), strict=True)], np.int64)
    if marked:
        return out
    pure = np.array([line.linked >= 0.8 * len(t.replace(" ", "")) for line, t in zip(lines, texts, strict=True)], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], pure, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= MENU:
            out[a:b] = 0
    return out


def between_surge_and_dive(weight: np.ndarray, threshold: int, paths: list[tuple[int, ...]]) -> np.ndarray:
    """Which lines have weight and lie in a stretch with a surge of the window
    sums, or in a short one beside it."""
    n = len(weight)
    total = np.concatenate([[0], np.cumsum(weight)])
    window = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    full = window > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
    stretches = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    surging = [i for i, (a, b) in enumerate(stretches) if window[a:b].max() > threshold]
    if not surging and stretches:
        surging = [max(range(len(stretches)), key=lambda i: (total[stretches[i][1]] - total[stretches[i][0]], -i))]
    if len(surging) == len(stretches):
        return weight > 0
    held = [[paths[j] for j in range(a, b) if weight[j]] for a, b in stretches]
    inside = Counter(p[:d] for own in held for p in own for d in range(len(p) + 1))
    homes = set()
    for i in surging:
        home = tuple(os.path.commonprefix(held[i]))
        if len(held[i]) == 1 and inside[home] == 1:
            home = home[:-1]  # an element for this line only
        homes.add(home)
    keep = np.zeros(n, bool)
    for i, (a, b) in enumerate(stretches):
        if surging[0] - 1 <= i <= surging[-1] + 1 or any(p[:d] in homes for p in held[i] for d in range(len(p) + 1)):
            keep[a:b] = True
    return keep & (weight > 0)


def main_text(page: str) -> str:
    lines, marked = read_lines(page)
    filled = [(line, t) for line in lines if (t := line.text())]
    lines, texts = [line for line, _ in filled], [t for _, t in filled]
    weight = weights(lines, texts, marked)
    if marked and not weight.any():
        weight = weights(lines, texts, False)
        marked = False
    keep = between_surge_and_dive(weight, 0 if marked else SURGE, [line.path for line in lines])
    return "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (all columns of ``pages`` but the markup) and text."""
    rows = pages.select(K.others(pages, html_col), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.text_chunks(batch, "html"):
                data, offsets = K.utf8(part.column("html"))
                raw, cut = data.tobytes(), offsets.tolist()
                texts = [main_text(raw[a:b].decode("utf-8", "replace")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                texts = [t.encode("utf-8", "replace").decode() for t in texts]  # references to lone surrogates
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return rows.mapInArrow(K.tidy(run), K.schema(rows.select("row"), "text string"))

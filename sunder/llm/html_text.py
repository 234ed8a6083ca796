"""HTML extraction from parser events by smoothed text-to-tag ratios.

Weninger et al., "CETR: Content Extraction via Tag Ratios" (2010).  The standard
library's streaming parser turns a page into lines, one per block element.
Each line has a ratio, the logarithm of its text outside links to its tags.  A Gaussian smooths
the ratios, which lifts short lines among long ones, and those of lines that can be content
are clustered about a threshold (two means), which marks lines of content.

Elements and classes are evidence.  Scripts, styles, drawings and hidden elements
have no text at all.  Lines in menus, headers, footers, asides, adverts, notices,
reader comments and forms have the ratio 0 and are never kept, but for those that only
a class, an id or a form tells apart, where nothing else on the page is left.  Where a
page has ``article`` or ``main`` elements, ratios outside them are a quarter.

Marked lines then select the regions, which are all kept, in page order.  A region is
a box (``div``, ``section``, ``ul``, ``table``, ...) with the lines directly in it: it is content
if at least half of its text is marked, or if at most half of it is links and it lies in a box
that is, or in an article that has marked text or stands beside one.  So the short lines of an article
stay, and long lists of links, and boxes of lines with little text outside articles, go.

Defined cases: a null or empty page, and one without content, give an empty
text; a page that breaks off or leaves elements open is read to its end; equal ratios
are one cluster, all content; rows are extracted one by one, repeated ones alike; further columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that end a line, that have no text of the page, that are boilerplate, that have no end.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
SILENT = frozenset("audio canvas datalist embed head iframe math noscript object script style svg template title video".split())
NEVER = frozenset("aside button dialog footer input menu nav option select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
BARRIERS = frozenset("button caption object table td template th".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words of a class or id that mark boilerplate, and words that may stand beside them.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment "
    "comments commentlist consent cookie cookies copyright discussion disqus feedback footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promotion recommended related replies reply "
    "respond rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar "
    "widget widgets".split()
)
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons card container content top left right main inner outer item items label "
    "link links list message page panel policy post posts primary secondary section site slot stories story text title unit user wrap wrapper".split()
)
HEADERS = frozenset("header pageheader page-header site-header siteheader top-header".split())
CONTENT = frozenset(("article", "main"))
BOXES = frozenset("article aside blockquote body details dl div fieldset figure footer form header main menu nav ol section table td ul".split())
HARD, SOFT = 2, 1
OUTSIDE = math.log(4)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects lines (text, tags, characters in links, how surely boilerplate, box) and boxes (parent, nearest article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.boxes: list[tuple[int, int]] = [(-1, 0)]
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, boilerplate, box, silent
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def state(self) -> tuple[int, int, bool]:
        return self.stack[-1][1:] if self.stack else (0, 0, False)

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            bad, box, _ = self.state()
            self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), bad, box))
        self.parts.clear()
        self.tags = self.linked = 0

    def boilerplate(self, tag: str, attrs: list, article: int) -> int:
        """How surely an element is not content."""
        if tag in NEVER or (tag == "header" and not article):
            return HARD
        if tag in ("html", "body"):
            return 0
        found = SOFT if tag == "form" else 0
        for name, value in attrs:
            low = (value or "").lower()
            if name == "role" and low in ROLES:
                return HARD
            if name in ("class", "id"):
                for token in low.split():
                    words = set(_WORD.findall(token))
                    # All words of a token must agree: "cookie-notice" is one, "has-sidebar" or "post-with-ads" says nothing.
                    if (words & MARKS and words <= MARKS | BESIDE) or (not article and token in HEADERS):
                        found = SOFT
        return found

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.flush()
        self.tags += not self.state()[2]
        if tag in VOID:
            return
        if tag in CLOSE_P and self.open["p"]:
            self.close_to("p", BARRIERS)
        elif tag == "li":
            self.close_to("li", frozenset(("ul", "ol", "menu", "dir")))
        elif tag in ("dt", "dd"):
            self.close_to("dd", frozenset(("dl",)))
            self.close_to("dt", frozenset(("dl",)))
        elif tag in ("td", "th", "tr"):
            for other in ("td", "th") if tag != "tr" else ("tr",):
                self.close_to(other, frozenset(("table",)))
        bad, box, silent = self.state()
        article = self.boxes[box][1]
        if tag in CONTENT and bad and any(t in ("nav", "form", "header") and b == bad for t, b, *_ in self.stack):
            bad = 0  # a menu or header that was left open, or a form around the whole page
        own = self.boilerplate(tag, attrs, article)
        if tag in SILENT or any(
            n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and "display:none" in (v or "").replace(" ", "").lower()) for n, v in attrs
        ):
            silent = True
        elif own and not block:
            silent = True  # a part of a line cannot be judged as a line
        if tag in BOXES:
            self.boxes.append((box, len(self.boxes) if tag in CONTENT and not article and not max(bad, own) else article))
            box = len(self.boxes) - 1
        self.stack.append((tag, max(bad, own) if block else bad, box, silent))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += not self.state()[2]

    def close_to(self, tag, barriers=frozenset()):
        """Close the innermost open ``tag`` and what is open in it, unless a barrier is in between."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                for name, *_ in self.stack[k:]:
                    self.open[name] -= 1
                del self.stack[k:]
                return
            if self.stack[k][0] in barriers:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += not self.state()[2]
        # An inline end tag does not close the blocks around it.
        self.close_to(tag, frozenset() if tag in BLOCKS or tag in SILENT else BLOCKS)

    def handle_data(self, data):
        if self.stack and self.stack[-1][3]:
            return
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing, normalised at the borders."""
    reach = max(1, round(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(x * y for x, y in zip(values[lo:hi], w, strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Two means in one dimension: the midpoint between the clusters."""
    cut = (min(values) + max(values)) / 2
    for _ in range(20):
        low = [x for x in values if x < cut]
        high = [x for x in values if x >= cut]
        if not low or not high:
            break
        after = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(after - cut) < 1e-9:
            break
        cut = after
    return cut


def line_ratios(lines: list, boxes: list, worst: int) -> list[float]:
    """Logarithms of text to tags, lifted to their smoothed values; 0 for lines that are boilerplate by more than ``worst``."""
    inside = any(bad <= worst and boxes[box][1] for *_, bad, box in lines)
    out = []
    for text, tags, linked, bad, box in lines:
        ratio = math.log1p(max(0, len(text) - linked) / tags)
        if inside and not boxes[box][1]:
            ratio = max(0.0, ratio - OUTSIDE)
        out.append(ratio if bad <= worst else 0.0)
    # Short lines among long ones rise; a long one does not fall because it stands alone.
    return [max(x, y) for x, y in zip(out, smooth(out), strict=True)]


def regions(lines: list, boxes: list, marked: list[bool], worst: int) -> set[int]:
    """The boxes whose lines are content."""
    chars, good, linked = Counter(), Counter(), Counter()
    for mark, (text, _, link, bad, box) in zip(marked, lines, strict=True):
        if bad <= worst:
            chars[box] += len(text)
            linked[box] += link
            good[box] += len(text) * mark
    own = {box for box, n in chars.items() if 2 * good[box] >= n}
    # Where the articles that have marked text stand.
    article = {boxes[boxes[box][1]][0] for box, n in good.items() if n and boxes[box][1]}
    near = lambda box: boxes[box][0] in own or (boxes[box][1] and boxes[boxes[box][1]][0] in article)
    return own | {box for box, n in chars.items() if 2 * linked[box] <= n and near(box)}


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, boxes = parser.lines, parser.boxes
    for worst in (0, SOFT):
        at = [k for k, x in enumerate(lines) if x[3] <= worst]
        if not at:
            continue
        ratios = line_ratios(lines, boxes, worst)
        own = [ratios[k] for k in at]
        cut = threshold(own)
        if max(own) - min(own) < OUTSIDE / 2:
            cut = min(own)  # one cluster: nothing tells the lines apart
        kept = regions(lines, boxes, [r >= cut and x[3] <= worst for r, x in zip(ratios, lines, strict=True)], worst)
        text = " ".join(lines[k][0] for k in at if lines[k][4] in kept)
        if text:
            return text
    return ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A few pages at a time, so that memory follows the pages.
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [extract(part.column("html")[i].as_py()) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_pydict(
                {c: part.column(c) for c in ("page_id", "url")}
                | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")

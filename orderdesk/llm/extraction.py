"""Main text of web pages by composite text density.

Every element of a page gets a density: its characters per tag, lowered by the
share of them that stands in links (``density``). The densities of an
element's children add up to its sum; a run of text directly inside an element
is a child of its own. The element with the largest sum holds the main text.
The lowest density on the path from it to the body is the threshold: every
element at or above it hands in its own element with the largest sum, so an
article in several parts is found whole.

What is handed in is widened to whole blocks: a paragraph, heading or list
stands for the element that contains it, and parts of an ``article`` or
``main`` element for that element; then nothing outside of it is text.

Not rendered or no part of an article, whatever its density: the elements in
``DROPPED``, elements named (class, id or role) by a word of ``NAMES``, hidden
ones, and a ``header`` outside an article. Menus, notices, adverts, sidebars,
forms and reader comments go by these.

Text comes out as blocks in page order joined by a blank line: character
references decoded, white space (line breaks included) turned into one space,
trimmed, empty blocks left out. Nothing else is dropped or shortened.

The page is read once, without recursion, so neither depth nor length of a
page matters. Rows are independent; there is no shuffle.

Edge cases: a null or empty page has the text ''; so has one with nothing but
markup. Unclosed and stray tags are read as browsers read them; a page without
a body is one body. Repeated rows are read alike, an empty table gives an
empty table, other columns are kept whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold an article's text; none is ended by a start tag within it.
DROPPED = frozenset("""head script style noscript template iframe object embed svg canvas audio video
    nav footer aside form button select option textarea input label menu dialog""".split())
BLOCKS = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption
    thead tbody tfoot tr td th ul""".split())
# Blocks that are parts of a text, not containers of one.
PARTS = frozenset("""blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre summary
    table caption thead tbody tfoot tr td th ul""".split())
# A start tag on the left ends an open element of the first set, unless one of the second set or of DROPPED is between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "option": (("option",), ("select",)), "a": (("a",), ("#block",))}
IN_HEAD = frozenset("title meta link style script base noscript template".split())
CELLS = frozenset("table caption thead tbody tfoot tr td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
    sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer copyright comment comments commentlist
    reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay disclaimer
    newsletter subscribe subscription signup login share sharing social related recommended recommendations widget
    widgets toolbar pagination pager masthead side topbar subnav promoted teaser teasers trending discussion feedback""".split())
# A name with one of these says what a container has, not what it is.
ABOUT = frozenset("with has no without".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boilerplate(attrs: dict[str, str | None]) -> bool:
    """Whether an element's attributes hide it or name it as no part of an article."""
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in re.sub(r"\s", "", attrs.get("style") or "").lower():
        return True
    if (attrs.get("role") or "").strip().lower() in ROLES:
        return True
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and not ABOUT.intersection(words) and (words[0] in NAMES or words[-1] in NAMES):
            return True
    return False


class _Page(HTMLParser):
    """A page as flat lists in page order: elements with parent and dropped mark, and runs of text (None: a block's edge)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.dropped = ["body"], [-1], [False]
        self.runs: list[tuple[int, str | None]] = []
        self.open = [0]
        # Places in ``open`` of each tag, and of blocks, table parts and dropped elements.
        self.places: dict[str, list[int]] = defaultdict(list)

    def _kinds(self, tag: str) -> list[str]:
        sets = (("#block", BLOCKS), ("#cell", CELLS), ("#dropped", DROPPED))
        return [tag, *(kind for kind, tags in sets if tag in tags)]

    def _last(self, *kinds: str) -> int:
        """The innermost open element of some kinds; 0 if none is open."""
        return max((self.places[k][-1] for k in kinds if self.places[k]), default=0)

    def _end(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        if self._last("#block") >= k:
            self.runs.append((self.open[k], None))
        while len(self.open) > k:
            for kind in self._kinds(self.tags[self.open.pop()]):
                self.places[kind].pop()

    def _out_of_head(self) -> None:
        if self.places["head"]:
            self._end(self.places["head"][0])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._out_of_head()
        if tag in ("html", "body"):
            return
        ended, until = ENDS.get(tag) or ((("p",), ("#cell", "button")) if tag in BLOCKS else ((), ()))
        k = self._last(*ended)
        if k and k > self._last(*until, "#dropped"):
            self._end(k)
        parent = self.open[-1]
        named = tag not in ("article", "main") and _boilerplate(dict(attrs))
        if tag == "header":
            named |= not self._last("article", "main")
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(named or tag in DROPPED or self.dropped[parent])
        if tag in BLOCKS:
            self.runs.append((parent, None))
        if tag == "br":
            self.runs.append((parent, " "))
        if tag not in VOID:
            for kind in self._kinds(tag):
                self.places[kind].append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        k = self._last(tag)
        between = 0 if tag in CELLS else self._last("#cell" if tag in BLOCKS else "#block")
        if k and k >= between:  # else a stray end tag
            self._end(k)

    def handle_data(self, data: str) -> None:
        if len(self.open) == 2 and data.strip():  # text in the head itself
            self._out_of_head()
        self.runs.append((self.open[-1], data))


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """Composite text density: characters per tag, adjusted by how much of them stands in links.

    C/T times the logarithm of (C/LC)(T/LT) to the base ln(C/(C-LC) LC + (LCb/Cb) C + e), where a zero counts as one."""
    if not chars:
        return 0.0
    tags, links, own, link_tags = max(1, tags), max(1, link_chars), max(1, chars - link_chars), max(1, link_tags)
    base = math.log(chars / own * links + body_link_chars / max(1, body_chars) * chars + math.e)
    return chars / tags * math.log(chars / links * tags / link_tags) / math.log(base)


def _selected(page: _Page) -> list[bool]:
    """Which elements are main text."""
    tags, parents, dropped, n = page.tags, page.parents, page.dropped, len(page.tags)
    own = [0] * n
    for node, text in page.runs:
        if text and not dropped[node]:
            own[node] += len("".join(text.split()))
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = tags[k] == "a" or in_link[parents[k]]
    chars, links = own[:], [own[k] if in_link[k] else 0 for k in range(n)]
    count, link_count = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):  # children stand after their parents
        p = parents[k]
        chars[p] += chars[k]
        links[p] += links[k]
        if not dropped[k]:
            count[p] += count[k] + 1
            link_count[p] += link_count[k] + (tags[k] == "a")
    of_node = [density(chars[k], count[k], links[k], link_count[k], chars[0], links[0]) for k in range(n)]
    sums = [density(own[k], 1, own[k] if in_link[k] else 0, int(in_link[k]), chars[0], links[0]) for k in range(n)]
    for k in range(n - 1, 0, -1):
        if not dropped[k]:
            sums[parents[k]] += of_node[k]
    best = list(range(n))  # of each subtree, the element with the largest sum; the outermost, first one if equal
    for k in range(n - 1, 0, -1):
        p = parents[k]
        if not dropped[k] and chars[k] and (sums[best[k]], -best[k]) > (sums[best[p]], -best[p]):
            best[p] = best[k]

    # The container each element stands for: its article or main element, else the nearest that is no part of a text.
    nearest = {"article": [0] * n, "main": [0] * n, "": [0] * n}
    for k in range(1, n):
        for kind, held in nearest.items():
            own_kind = tags[k] == kind if kind else tags[k] in BLOCKS and tags[k] not in PARTS
            held[k] = k if own_kind else held[parents[k]]
    whole = [a or m or c for a, m, c in zip(*nearest.values(), strict=True)]

    top, threshold = best[0], math.inf
    at = top
    while at >= 0:
        threshold = min(threshold, of_node[at])
        at = parents[at]
    main = whole[top]
    chosen = [False] * n
    chosen[main] = True
    if tags[main] not in ("article", "main"):
        for k in range(n):
            if not dropped[k] and chars[k] and of_node[k] >= threshold:
                part = best[k]
                # A text part of its own (a heading above the container, say) comes alone; a container comes whole.
                chosen[part if tags[part] in PARTS else whole[part]] = True
    for k in range(1, n):
        chosen[k] = (chosen[k] or chosen[parents[k]]) and not dropped[k]
    return chosen


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    chosen = _selected(page)
    out: list[str] = []
    block: list[str] = []
    for node, text in [*page.runs, (0, None)]:
        if text is None:
            out.append(" ".join("".join(block).split()))
            block = []
        elif chosen[node]:
            block.append(text)
    return "\n\n".join(x for x in out if x)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``__text``, the main text of the whole page."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.withColumn("__text", F.arrow_udf(run, "string")(F.col(html)))

"""Op 3, main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; a line's weight is the length of its text outside links. The
weights are summed over windows of neighbouring lines of one container (a body, div, section or the like). Where the
sums surge to SURGE characters a run of text begins, and it dives where they fall below. The container of the heaviest
run is the article's; it widens to an outer one as long as that adds more text in runs than beside them, and to a whole
body only if that adds half as much again. What lies in it is the text, so a short heading or last paragraph stays; lone
short containers before the first surge and after the last dive of a whole body don't.

Tags and names are signals beside the windows: text in elements that never hold the article (nav, footer, aside, form
and so on) weighs nothing, nor does text in elements named as adverts, sidebars, comments and the like, unless the page
has no run elsewhere; an article or main widens only to what at least doubles it. The parser is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import rows_of
from voxmill.session import read_table

#: Lines that a window sums, and characters in a window at which a run begins; less where a page has no such window.
WINDOW, SURGE = 3, 80

#: A comment, a declaration, or a tag with its quoted values; each try ends where it fails, without another way.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
#: A tag whose quotes don't close before the page's end.
_BARE = re.compile(r"</?[a-zA-Z][^>]*>")
_ODD = re.compile(r"<[!?]")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_CONTAINER = set("article aside body center details dialog div fieldset footer form header html main menu nav search section".split())
_OUT = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "search"}
_IN = {"article", "main"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Whole class or id names of what isn't the article.
_HINT = re.compile(
    r"(?:(?:top|main|site|page|left|right|bottom|primary|secondary|mobile|global|post|google)[-_]?)?"
    r"(?:ads?|adverts?|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|promotion|cookies?|consent|notice|notification|popup|modal|newsletter|subscribe|subscription"
    r"|comments?|respond|responses|replies|disqus|sidebar|side|widget|related|recommended|recommendations|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation"
    r"|footer|header|masthead|pagination|pager|login|signup|search|complementary|contentinfo|alert|toc)"
    r"(?:[-_]?(?:left|right|top|bottom|box|bar|block|area|list|container|wrapper|wrap|section|banner|notice|posts?|articles?|stories|links?|menu|items?|form|widget|buttons?|icons?|inner|thread|[0-9]+))*",
    re.I,
)
_HINTED = {"div", "section", "ul", "ol", "p", "span", "table", "details", "figure", "li", "dl"}
_SPLIT = re.compile(r"[\s\"']+")
#: In HTML white space is these characters; a no-break space from a reference is white space too once decoded.
_WHITE = re.compile(r"\s+")


class _Lines:
    """Lines of text, and for each its characters in links, its place and its container."""

    def __init__(self):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.shut: list[bool] = []  # in an element that never holds the article
        self.hints: list[int] = []  # elements around it that are named as something else
        self.marked: list[bool] = []  # in an article or main
        self.heading: list[bool] = []
        self.at: list[int] = []  # container
        #: Containers in the order of their begin: the one around, whether an article or main, the number after the last inner one.
        self.parent, self.is_in, self.whole, self.last = [0], [False], [True], [1]
        self.parts: list[tuple[str, bool, tuple]] = []

    def end(self) -> None:
        """A line ends; what lies in elements of different kinds makes lines of its own."""
        run: list[tuple[str, bool, tuple]] = []
        for part in [*self.parts, None]:
            if run and (part is None or part[2] != run[-1][2]):
                raw = html.unescape("".join(x[0] for x in run))
                if text := _WHITE.sub(" ", raw).strip():
                    self.texts.append(text)
                    self.linked.append(sum(len(x[0]) for x in run if x[1]))
                    for held, value in zip((self.shut, self.hints, self.marked, self.heading, self.at), run[-1][2], strict=True):
                        held.append(value)
                run = []
            if part is not None:
                run.append(part)
        self.parts = []


def lines_of(page: str) -> _Lines:
    """The page's lines of text; unclosed and stray tags are tolerated. Linear: a closing tag without an open one is passed
    over by a count of names, and every tag that another one closes leaves the stack."""
    out, at = _Lines(), 0
    stack: list[tuple[str, str, int]] = []  # open elements: name, kind, container around
    names: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    now = links = 0
    final, quotes = page.rfind(">"), True

    def state() -> tuple:
        return kinds["out"] > 0, kinds["hint"], kinds["in"] > 0, kinds["heading"] > 0, now

    def close() -> str:
        nonlocal now
        name, kind, now_before = stack.pop()
        names[name] -= 1
        kinds[kind] -= 1
        if now_before != now:
            out.last[now] = len(out.parent)
            now = now_before
        return name

    while (start := page.find("<", at)) >= 0:
        token = None
        if start < final or page[start + 1 : start + 2] in ("!", "?"):
            token = (_TOKEN if quotes or page[start + 1] in "!?" else _BARE).match(page, start)
            if token is None and quotes and (token := _BARE.match(page, start)):
                quotes = False  # some quote is never closed: from here on quotes are ordinary
        if token is None:
            following = _ODD.search(page, start) if start > final else None
            ending = page.find("<", start + 1) if start < final else following.start() if following else -1
            ending = len(page) if ending < 0 else ending
            out.parts.append((page[at:ending], links > 0, state()))
            at = ending
            continue
        if start > at:
            out.parts.append((page[at:start], links > 0, state()))
        at, mark = token.end(), token.group()
        if mark[1] in "!?":
            continue
        name = _NAME.match(mark)[1].lower()
        if name in _BLOCK:
            out.end()
        if mark[1] == "/":
            if name == "a":
                links = 0
            if names[name]:
                while close() != name:
                    pass
            continue
        if name in _RAW:
            if not mark.endswith("/>"):
                ending = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = ending.end() if ending else len(page)
            continue
        if name == "a":
            links = 1
        if name in _VOID or mark.endswith("/>"):
            continue
        if name in _BLOCK or name in _HINTED:
            hinted = name in _HINTED and any(_HINT.fullmatch(x) for marks in _MARKS.findall(mark) for x in _SPLIT.split(marks))
            kind = "out" if name in _OUT and not (name == "header" and kinds["in"]) else "hint" if hinted else "in" if name in _IN else "heading" if name in _HEADING else ""
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                close()  # closed by its like
            stack.append((name, kind, now))
            names[name] += 1
            kinds[kind] += 1
            if name in _CONTAINER:
                out.parent.append(now)
                out.is_in.append(name in _IN)
                out.whole.append(name in ("body", "html"))
                out.last.append(0)
                now = len(out.parent) - 1
    if at < len(page):
        out.parts.append((page[at:], links > 0, state()))
    out.end()
    while stack:
        close()
    out.last[0] = len(out.parent)
    return out


def window_sums(weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over WINDOW neighbouring lines of the same container, centred on each line."""
    order = np.argsort(at, kind="stable")
    w, c = weight[order], at[order]
    sums = w.copy()
    for step in range(1, WINDOW // 2 + 1):
        same = c[step:] == c[:-step]
        sums[step:] += np.where(same, w[:-step], 0)
        sums[:-step] += np.where(same, w[step:], 0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, in page order, joined by blanks; empty if the page has none."""
    lines = lines_of(page or "")
    if not lines.texts:
        return ""
    lengths = np.array([len(x) for x in lines.texts])
    hints, marked, at = np.array(lines.hints), np.array(lines.marked), np.array(lines.at)
    free = np.where(marked, lengths, lengths - np.minimum(lines.linked, lengths))
    free[np.array(lines.shut)] = 0
    for level in np.unique(hints[free > 0]):  # the fewest hints at which there is a run, a marked article or a quarter of the text
        weight = np.where(hints <= level, free, 0)
        windows = window_sums(weight, at)
        if windows.max() >= SURGE or 4 * weight.sum() >= free.sum() or (weight[marked] > 0).any():
            break
    else:
        return ""
    surge = (windows >= min(SURGE, windows.max() / 2)) & (weight > 0)
    n = len(lines.parent)
    core, rest = (np.bincount(at, np.where(x, weight, 0), n) for x in (surge, ~surge))
    best = int(core.argmax())
    for inner in range(n - 1, 0, -1):  # an inner container has the larger number
        core[lines.parent[inner]] += core[inner]
        rest[lines.parent[inner]] += rest[inner]
    chosen = outer = best
    bound = lines.is_in[best]
    while outer:
        outer = lines.parent[outer]
        more = core[outer] - core[chosen]
        if more > max(rest[outer] - rest[chosen], core[chosen] if bound else core[chosen] / 2 if lines.whole[outer] else 0):
            chosen, bound = outer, False
        bound = bound or lines.is_in[outer]
    inside = (at >= chosen) & (at < lines.last[chosen])
    keep = inside & (weight > 0)
    # links alone stay where text goes on within a window of them; elsewhere they are a menu
    own = np.flatnonzero(inside & (hints <= level) & ~np.array(lines.shut))
    texts = np.flatnonzero(keep[own])
    for k in range(len(own)):
        if not keep[own[k]]:
            after = np.searchsorted(texts, k)
            if 0 < after < len(texts) and texts[after] - texts[after - 1] <= WINDOW:
                keep[own[k]] = True
    if lines.whole[chosen]:  # a whole body: its short containers outside the runs are something else
        first, last = (np.flatnonzero(surge & inside)[k] for k in (0, -1))
        place = np.arange(len(at))
        headed = np.bincount(at, np.array(lines.heading), n) > 0
        busy = np.bincount(at, surge, n) > 0
        keep &= ((place >= first) & (place <= last)) | (at == chosen) | busy[at] | headed[at]
    return " ".join(x for x, k in zip(lines.texts, keep, strict=True) if k)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each page, from its whole html.

    A null or empty html has an empty text. Rows stay apart, repeated ones too, null ids and urls stay null; other columns are left
    out; n_chars counts code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 64):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; null and empty html give an empty text, repeated rows stay."""
    return extract(read_table(spark, sf_dir, "pages"))

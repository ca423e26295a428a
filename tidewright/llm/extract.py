"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a block element begins a new line. Lines inside elements that
hold no article text (menus, notices, forms ...) are left out, and the edges of sectioning
elements leave a gap of empty lines. A line weighs its length; inside a marked article it
weighs ``MARK`` times that, and an empty line there weighs 1, which joins what a mark holds.

On every page, sums of these weights over windows of lines surge from nothing where a stretch
of text begins and dive to nothing where it ends, and the peak in between tells text from
labels. Marks do no more than weigh. Without them the main text reaches from the surge of the
first stretch whose peak is a paragraph's to the dive of the last one; with them it is every
marked stretch, and the others only if they are more than a line and together hold at least
1 / ``MARK`` of the heaviest marked one's text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window. A stretch ends where a whole window weighs nothing.
WINDOW = 3
#: How much more a character of a marked article counts than one outside marks.
MARK = 4
#: Characters of a window that surely holds more than a label.
PARAGRAPH = 80

# Elements by role, and class or id words of parts that aren't the article.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
OUTSIDE = frozenset("nav header footer aside form button select menu dialog fieldset option textarea label".split())
BLOCKS = frozenset(
    "address article blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article main section nav header footer aside body form div".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE = frozenset("article".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")
_WORDS = re.compile(r"[a-z]+")


def set_aside(name: str, attrs: str) -> bool:
    """Does the element hold something other than the article?"""
    if name in OUTSIDE:
        return True
    if not attrs or name in ("html", "body", "main", "article"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and any(w in OUTSIDE_WORDS for w in _WORDS.findall(value)):
            return True
        if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, number of the outermost marked article or 0) of every line of the stripped page,
    in order. The time is linear in the page, however its elements are nested."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, set aside, marked
    opened: Counter[str] = Counter()  # elements of the stack by name
    held: list[str] = []
    asides, marked, marks = 0, 0, 0

    def end_line():
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, marked))

    def gap(name: str):
        if name in SECTIONS:
            out.extend([("", marked)] * WINDOW)

    def close(name: str):
        nonlocal asides, marked
        while opened[name]:
            top, aside, _ = stack.pop()
            if top in BLOCKS:
                end_line()
            opened[top] -= 1
            asides -= aside
            marked = stack[-1][2] if stack else 0
            gap(top)
            if top == name:
                break

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if not (m[0].startswith("<!") or m[0].startswith("<?")) and not asides:
                held.append(m[0])
            continue
        if m[1]:
            if name == "p" and not opened["p"]:
                end_line()
            close(name)
            continue
        if name in SILENT:
            if name == "head":
                continue
            if not m[0].endswith("/>"):
                shut = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = shut.end() if shut else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in CLOSES_P and opened["p"]:
            close("p")
        if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(name)
        if name in BLOCKS:
            end_line()
            gap(name)
        if name in VOID or m[0].endswith("/>"):
            continue
        if not marked and (name in ARTICLE or "articlebody" in m[3].lower()):
            marked = marks = marks + 1
        aside = set_aside(name, m[3])
        stack.append((name, aside, marked))
        opened[name] += 1
        asides += aside
    end_line()
    return out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first, end, peak): the lines from each surge of the window sums from nothing to the next
    dive to nothing, and the largest sum in between."""
    out, first, total, peak = [], 0, 0, 0
    for i in range(len(weights) + window):
        before, total = total, total + (weights[i] if i < len(weights) else 0) - (weights[i - window] if i >= window else 0)
        if total and not before:
            first, peak = i, 0
        elif before and not total:
            out.append((first, i - window + 1, peak))
        peak = max(peak, total)
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by two line ends; empty if there is none."""
    lines = lines_of(page or "")
    found = stretches([MARK * len(t) + 1 if m else len(t) for t, m in lines])
    if not found:
        return ""
    marked = [x for x in found if any(m for _, m in lines[x[0] : x[1]])]
    others = [x for x in found if x not in marked]
    least = min(PARAGRAPH, max(peak for _, _, peak in found) / 4)
    others = [x for x in others if x[2] >= least]
    if not marked:
        # an article may lie in several sections: everything from its first stretch to its last
        return "\n\n".join(t for t, _ in lines[others[0][0] : others[-1][1]] if t)

    def texts(some):
        return [t for first, end, _ in some for t, _ in lines[first:end] if t]

    heaviest = max(sum(map(len, texts([x]))) for x in marked)
    if len(texts(others)) <= 1 or MARK * sum(map(len, texts(others))) < heaviest:
        others = []
    return "\n\n".join(texts(sorted(marked + others)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null or empty page has an empty text, a
    page of one long line that line. Repeated rows, null ids and null urls stay as they are;
    other columns, whatever their names, are left out. An empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

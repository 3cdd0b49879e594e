"""HTML main text by line-block distribution.

Markup is stripped into lines, one per block element. Each line weighs the length of its own text, or
nothing where the text is a link or sits in a part of the page that is never the article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments). Weights are summed over sliding
windows of lines; a surge point is where the sum rises to a level, a dive point where it falls below, and
the text between them is kept. A page that marks its article (``article`` or ``main``) is read inside that
mark, where any text is a surge. On other pages the level follows the page: a ``SHARE``-th of the sum that
half of its text reaches, ``MOST`` at most, and it must be held by the windows before and behind a line, so
that short lines above and below the article are left out. Headings right above kept text
stay.

The pass over a page is a single scan, so cost and memory follow the page's length; rows are worked on a
batch at a time and never grouped.

Edge cases: null html is the empty page; a page without text gives an empty string; truncated markup and
character references are read as browsers do; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Element names as HTML defines them.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
NEVER = frozenset("nav footer aside form button select dialog menu head object canvas audio video".split())
#: Class and id words of page parts that are not the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notification popup promo related respond reply replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: HTML's white space, and the no-break space that references give.
SPACE = re.compile(r"\s+")

WINDOW = 3
SURGE = 1
#: Without a mark: the part of the page's usual window sum that is text enough, and the most that is asked for.
SHARE, MOST = 4, 86


def _is_part(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        words.update(WORD.findall((m[2] or m[3] or m[4] or "").lower()))
    return not PARTS.isdisjoint(words)


def lines(page: str) -> Iterator[tuple[str, int, bool, bool, bool]]:
    """(text, weight, may be kept, inside the article mark, a heading) of each block of a page, in order."""
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, never the article, the article's mark
    shut = marked = links = 0

    def line():
        nonlocal linked
        raw = SPACE.sub(" ", entities.unescape("".join(text))).strip()
        out = (raw, 0 if shut or (linked * 2 > len(raw) and not marked) else len(raw), not shut, marked > 0, any(name in HEADINGS for name, _, _ in stack))
        text.clear()
        linked = 0
        return out

    def pop():
        nonlocal shut, marked, links
        name, never, mark = stack.pop()
        shut -= never
        marked -= mark
        links -= name == "a"

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if name in BLOCKS or name in RAW or name in NEVER:
            if text:
                yield line()
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif closing:
            if any(n == name for n, _, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            if name == "p" or name == "li":  # a new one ends the last
                inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
                if inner is not None and stack[inner][0] == name:
                    while len(stack) > inner:
                        pop()
            never = name in NEVER or (name == "header" and not marked) or (name not in ("html", "body", "article", "main") and _is_part(m[3] or ""))
            mark = name in ("article", "main")
            stack.append((name, never, mark))
            shut += never
            marked += mark
            links += name == "a"
    if text:
        yield line()


def _dense(rows: list[tuple[str, int, bool, bool, bool]], window: int) -> list[int]:
    """The lines between surge and dive points of a page without a mark."""
    n = len(rows)
    sums = [0, *accumulate(x[1] for x in rows)]
    ahead = [sums[min(n, i + window)] - sums[i] for i in range(n)]
    behind = [sums[i + 1] - sums[max(0, i + 1 - window)] for i in range(n)]
    usual, passed = 0, 0
    for total, weight in sorted(zip(map(max, ahead, behind), (x[1] for x in rows), strict=True)):
        usual, passed = total, passed + weight
        if 2 * passed >= sums[-1]:
            break
    level = max(SURGE, min(MOST, usual / SHARE))
    kept = [rows[i][2] and rows[i][1] > 0 and min(ahead[i], behind[i]) >= level for i in range(n)]
    for i in range(n - 2, -1, -1):
        kept[i] = kept[i] or (rows[i][4] and rows[i][1] > 0 and rows[i][2] and kept[i + 1])
    return [i for i in range(n) if kept[i]]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of the article; see the module's text."""
    rows = [x for x in lines(page or "") if x[0]]
    if not any(mark and weight for _, weight, _, mark, _ in rows):
        return "\n".join(rows[i][0] for i in _dense(rows, window))
    rows = [(t, w if mark else 0, open_ and mark) for t, w, open_, mark, _ in rows]
    weights = [x[1] for x in rows]
    kept: list[str] = []
    running, since = 0, None  # since: the surge point of the span that is open
    for i in range(len(rows) + window):
        running += (weights[i] if i < len(rows) else 0) - (weights[i - window] if 0 <= i - window < len(rows) else 0)
        if since is None and running >= surge:
            since = i
            while since > 0 and i - since < window - 1 and weights[since - 1]:  # the window's own first lines
                since -= 1
        elif since is not None and running == 0:
            kept += [rows[k][0] for k in range(since, max(k for k in range(since, i) if k < len(rows) and weights[k]) + 1) if rows[k][2]]
            since = None
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """The rows with ``text`` (main text) and ``n_chars`` (its code points) added; both replace columns of those names."""
    small_batches(pages.sparkSession)
    source = pages.drop(*[c for c in ("text", "n_chars") if c in pages.columns and c != html_col])
    keep = [c for c in source.columns if c != html_col or html_col not in ("text", "n_chars")]
    rows = source.select(*[f"`{c}`" for c in keep if c != html_col], F.col(html_col).cast("string").alias("__html"))
    schema = pages.sparkSession.createDataFrame([], rows.drop("__html").schema).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(x, window, surge) for x in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)

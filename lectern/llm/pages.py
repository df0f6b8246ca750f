"""Main text of web pages by line-block distribution.

Markup is stripped so that every block is a line. A line counts by its characters outside links less those in links, so that
a line of a menu counts against the text around it; lines in elements of menus, adverts, forms and the like count nothing, and
where a page marks its article, so do lines outside it. The counts are summed over windows of ``WINDOW`` lines: where
the sum surges above nothing a stretch of text begins, where it dives to nothing or below the stretch ends. So a list of links that
no element names is left out, in a marked article too, while a linked heading or one linked line within text stays. All stretches are
kept, boilerplate lines in them left out.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 3

# Element names of HTML, and words that name boilerplate in class and id attributes.
BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form head title script style noscript template iframe object svg button select textarea menu dialog".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
QUALIFIERS = frozenset("has no with without is not open closed enabled disabled active allowed".split())
#: Classes of an article that is a comment on another.
COMMENTS = frozenset("comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: A block that opens closes an open element of these names.
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_ITSELF = frozenset("li dt dd tr td th option p".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _named(value: str) -> bool:
    """Whether a class or id names boilerplate; a name with a qualifier tells of the page instead."""
    for name in value.split():
        parts = {part.lower() for part in PARTS.split(name) if part}
        if parts & NAMES and not parts & QUALIFIERS:
            return True
    return False


def _boilerplate(name: str, attributes: str) -> bool:
    if name in LEFT_OUT:
        return True
    if not attributes or name in ("body", "html", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if name == "article":
            if key == "class" and any(word in COMMENTS for word in value.lower().split()):
                return True
            continue
        if key == "hidden" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id") and _named(value):
            return True
    return False


class _Lines:
    """Lines of a page: text, count outside links, whether boilerplate, whether in an article."""

    def __init__(self):
        self.done: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.plain = 0

    def text(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if not in_link:
            self.plain += len(text.strip())

    def end(self, left_out: bool, in_article: bool) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.done.append((line, min(self.plain, len(line)), left_out, in_article))
            self.parts, self.plain = [], 0


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's lines in order."""
    lines, open_, at = _Lines(), [], 0
    left_out = links = articles = 0  # open elements of each kind

    def close(upto: int) -> None:
        nonlocal left_out, links, articles
        while len(open_) > upto:
            _, out, link, article = open_.pop()
            left_out, links, articles = left_out - out, links - link, articles - article

    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            lines.text(references.unescape(text) if "&" in text else text, links > 0)
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name, attributes = found[2].lower(), found[3]
        block = name in BLOCKS
        if block:
            lines.end(left_out > 0, articles > 0)
        if found[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    if name not in BLOCKS and any(o[0] in BLOCKS for o in open_[i:]):
                        break  # an inline element's end doesn't close blocks
                    close(i)
                    break
            continue
        if name in RAW_END and not attributes.rstrip().endswith("/"):
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if block and open_ and open_[-1][0] in CLOSED_BY_BLOCK:
            close(len(open_) - 1)
        elif name in CLOSED_BY_ITSELF and open_ and open_[-1][0] == name:
            close(len(open_) - 1)
        entry = name, _boilerplate(name, attributes), name == "a", name in ("article", "main")
        open_.append(entry)
        left_out, links, articles = left_out + entry[1], links + entry[2], articles + entry[3]
    lines.end(left_out > 0, articles > 0)
    return lines.done


def main_text(page: str | None) -> str:
    """The text between the surges and dives of the page's line blocks; empty if there is none.

    >>> main_text("<nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One\\n two<p>Three</article>")
    'A & B\\nOne two\\nThree'
    """
    lines = page_lines(page or "")
    if not lines:
        return ""
    marked = any(inside and not out for _, _, out, inside in lines)
    counted = [not out and (inside or not marked) for _, _, out, inside in lines]
    weight = np.array([(2 * n - len(t)) * c for (t, n, _, _), c in zip(lines, counted)])
    # the sum over a line and its neighbours; beyond the ends there is nothing
    padded = np.concatenate([np.zeros(WINDOW // 2, np.int64), weight, np.zeros(WINDOW // 2, np.int64)])
    blocks = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")
    live = np.concatenate([[False], blocks > 0, [False]])
    surges, dives = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(live[:-1] & ~live[1:])
    return "\n".join(lines[i][0] for a, b in zip(surges.tolist(), dives.tolist()) for i in range(a, b) if counted[i])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text, give the empty text. Repeated rows come out repeated; other columns
    aren't read; an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h).encode("utf-8", "replace").decode() for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_texts(pages, "html", "page_id long, url string, text string, n_chars long", work)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))

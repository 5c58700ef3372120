"""Main text of web pages: block structure, then differencing against the page with the nearest URL.

A page is read as lines, one per block, each in a zone: boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, by element, role, class or id), article (inside
an article or main element) or plain. Pages are ordered by host, path and id; each is compared with
the neighbour of its host whose path shares more leading characters, by a longest common
subsequence of line hashes, and shared lines are deleted, on every page. A neighbour that is a copy of
the page is passed over for the one on the other side. A check against the page's own structure follows:
deleted lines that the page marks as article are restored (articles of one host have sentences in common,
and near copies most of them), and a page that has marked lines consists of them. Each row tells how many
lines were deleted and restored.

Only line hashes move between tasks, not pages: order and neighbours come from ranges of the key
order (see order.py), and what is to be deleted joins the pages again by id and content hash.

Defined cases: null html has no text; a null url has an empty host and path; repeated rows get equal
results; a page alone on its host, or between copies of itself, is only read by structure; pages of any length are compared whole; unclosed elements end with what
contains them, an unclosed comment, script or style with the page; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import os.path
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stored
from tarn.llm.order import cuts, with_successors

# Names that mark boilerplate.
DROPPED = set("nav footer aside form script style noscript template svg iframe button select textarea dialog menu head object canvas audio video math".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent banner notice notices gdpr popup "
    "modal newsletter subscribe nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead comment comments "
    "reply replies discussion disqus social share sharing related recommended widget login signup search pagination pager".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
RAW = ("script", "style", "textarea", "title")
BLOCKS = set(
    "html head body title main article section nav aside header footer address div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th blockquote pre figure figcaption hr form fieldset legend details summary dialog menu template noscript".split()
)
NESTING = (BLOCKS | DROPPED) - set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th hr html body".split()) | {"span", "li", "td", "p"}
VOID = {"hr", "br", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
TAG = re.compile(r"""<!--|<(/?)([A-Za-z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))|(\bhidden\b)""")
BOILER, PLAIN, ARTICLE = 0, 1, 2
#: A page that has this percentage of its lines in common with a neighbour is a copy of it, and is not compared with it.
COPY = 90


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and WORDS.intersection(re.findall("[a-z]+", value)) and not (name[0] == "h" and name[1:].isdigit()):
            return True
    return False


def lines(html: str | None) -> list[tuple[str, int]]:
    """The page's text blocks in order, each with its zone."""
    html = html or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, inside boilerplate, inside an article
    boiler = article = False
    at, lower = 0, None

    def close() -> None:
        if text:
            joined = "".join(text)
            if line := " ".join((html_lib.unescape(joined) if "&" in joined else joined).split()):
                out.append((line, BOILER if boiler else ARTICLE if article else PLAIN))
            text.clear()

    while found := TAG.search(html, at):
        begin, end = found.span()
        if begin > at:
            text.append(html[at:begin])
        at = end
        name = found[2]
        if name is None:
            if html.startswith("<!--", begin):
                stop = html.find("-->", begin + 2)
                at = len(html) if stop < 0 else stop + 3
            continue
        name = name.lower()
        if name in BLOCKS or name in RAW:
            close()
        elif name == "br":
            text.append(" ")
        if found[1]:
            if any(x[0] == name for x in stack):
                while stack:
                    top = stack.pop()
                    if top[0] == name:
                        break
                inner = stack[-1] if stack else ("", False, False)
                if (boiler, article) != inner[1:]:
                    close()
                boiler, article = inner[1:]
            continue
        if name in RAW:
            lower = lower or html.lower()
            stop = lower.find(f"</{name}", at)
            at = len(html) if stop < 0 else stop
            continue
        if name in VOID or found[3].endswith("/") and name not in BLOCKS:
            continue
        marked = _marked(name, found[3], article)
        if name in NESTING or marked:
            if name in ("p", "li", "td", "span") and not marked:
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            now = (boiler or marked, (article or name in ("article", "main")) and not marked)
            if (boiler, article) != now:
                close()
            boiler, article = now
            stack.append((name, boiler, article))
    if at < len(html):
        text.append(html[at:])
    close()
    return out


#: Bits of the table that a longest common subsequence is traced back in; larger ones are halved first.
TRACED = 1 << 27


def _columns(a: list[int], b: list[int], keep: list[int] | None = None) -> int:
    """A bit for each place of b, 0 where the common subsequence of a and b up to there grows: all of a row's table at once.

    keep: gets that of each line of a.
    """
    masks: dict[int, int] = defaultdict(int)
    for j, line in enumerate(b):
        masks[line] |= 1 << j
    full = row = (1 << len(b)) - 1
    for line in a:
        both = row & masks.get(line, 0)
        row = (row + both | row - both) & full
        if keep is not None:
            keep.append(row)
    return row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the common subsequence of a and b[:j], for each j."""
    bits = np.frombuffer(_columns(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)] == 0)])


def _common(a: list[int], b: list[int], first: int) -> Iterator[int]:
    """Places in a, counted from first, of a longest common subsequence of a and b."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > TRACED:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        yield from _common(a[:half], b[:cut], first)
        yield from _common(a[half:], b[cut:], first + half)
        return
    rows: list[int] = []
    _columns(a, b, rows)
    i, j, found = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(first + i)
    yield from reversed(found)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, in len(a) steps over len(b) bits, however often lines repeat."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    here, there = set(a), set(b)
    own = [i for i in range(head, len(a) - tail) if a[i] in there]  # only lines of both can be shared
    other = [x for x in b[head : len(b) - tail] if x in here]
    middle = [own[k] for k in _common([a[i] for i in own], other, 0)]
    return [*range(head), *middle, *range(len(a) - tail, len(a))]


def restored(found: list[tuple[str, int]], deleted: set[int]) -> set[int]:
    """The check on what differencing deleted: places that the page itself marks as article, which it may not lose."""
    return {i for i in deleted if found[i][1] == ARTICLE}


def main_text(found: list[tuple[str, int]], deleted: set[int] = frozenset()) -> str:
    """The text of a page whose lines are known; deleted: places of lines shared with the nearest page."""
    gone = deleted - restored(found, deleted)
    least = max((zone for _, zone in found), default=PLAIN)  # a page that marks an article consists of it
    return "\n".join(line for i, (line, zone) in enumerate(found) if zone >= max(least, PLAIN) and i not in gone)


#: Host (A-Z lower-cased) and path of a URL, as in the URL filters.
URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")


def place(url: str | None, page_id) -> str:
    """The key of the order: host, path, then id."""
    m = URL.match(url or "")
    host, path = (m[1].lower() if m[1].isascii() else m[1], m[2]) if m else ("", "")
    return f"{host}\x00{path}\x00{'' if pd.isna(page_id) else f'{int(page_id):020d}'}"


HASHES = "page_id long, content long, place string, hashes array<long>"
SHARED = "page_id long, content long, prefix int, deleted array<int>"
TEXTS = "page_id long, url string, text string, n_chars long, n_shared int, n_restored int"


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_id, content, url, html in batch[["page_id", "content", "url", "html"]].itertuples(index=False):
            found = lines(html)
            rows.append((page_id, content, place(url, page_id), [xxhash.xxh64_intdigest(x) - (1 << 63) for x, _ in found]))
        yield pd.DataFrame(rows, columns=["page_id", "content", "place", "hashes"]).astype({"page_id": "Int64"})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page and each neighbour on its host that this range knows: the shared lines' places."""
    last = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            here, host = row[0], row.place.split("\x00")[0]
            if last and last[0] == here and last[1] == host and not last[3]:
                prefix = len(os.path.commonprefix([last[2].place, row.place]))
                # the row that begins the next range gets this side from here, its other side from there
                for one, other in ((last[2], row), (row, last[2])):
                    places = shared_lines(list(one.hashes), list(other.hashes))
                    if places and 100 * len(places) < COPY * len(one.hashes):
                        out.append((one.page_id, one.content, prefix, places))
            last = (here, host, row, row[1])
        yield pd.DataFrame(out, columns=["page_id", "content", "prefix", "deleted"]).astype({"page_id": "Int64", "content": "int64", "prefix": "int32"})


def shared_with_nearest(pages: DataFrame) -> DataFrame:
    """page_id, content, deleted: places of the lines that a page shares with its nearest one; a row per page that has any."""
    hashes = stored(pages.mapInPandas(_hashed, HASHES), "html-lines")
    ordered = with_successors(hashes, "place", None, cuts(hashes, "place"))
    columns = ["_range", "_after", "page_id", "content", "place", "hashes"]
    found = ordered.select(columns).mapInPandas(_compared, SHARED)
    best = F.max(F.struct("prefix", "deleted")).alias("best")
    return found.groupBy("page_id", "content").agg(best).select("page_id", "content", F.col("best.deleted").alias("deleted"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_restored for every row of pages (page_id, url, html).

    n_shared: lines that differencing deleted; n_restored: those of them that the check gave back.
    """
    pages = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("content"))
    deleted = stored(shared_with_nearest(pages), "html-deleted")
    deleted = deleted.select(F.col("page_id").alias("_id"), F.col("content").alias("_content"), "deleted")
    joined = pages.join(deleted, pages["page_id"].eqNullSafe(deleted["_id"]) & (pages["content"] == deleted["_content"]), "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, html, deleted in batch[["page_id", "url", "html", "deleted"]].itertuples(index=False):
                found, places = lines(html), set() if deleted is None else set(map(int, deleted))
                text = main_text(found, places)
                out.append((page_id, url, text, len(text), len(places), len(restored(found, places))))
            yield pd.DataFrame(out, columns=TEXTS.split()[::2]).astype({"page_id": "Int64"})

    return joined.select("page_id", "url", "html", "deleted").mapInPandas(texts, TEXTS)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

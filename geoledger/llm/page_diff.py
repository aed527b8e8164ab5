"""Main text of web pages by differencing each page with the page of its host whose URL path is nearest.

Pages are sorted by host and path; neighbours in that order are paired, their lines (block texts) aligned by longest common
subsequence, and lines that both share are deleted: what a site repeats on neighbouring pages is not an article. Markup
decides first: the contents of scripts, forms, navigation and the like are never text, and lines that a page itself marks
as its article are never deleted, so passages that two articles share survive. A neighbour that shares nearly all its text
is a copy and is passed over for the neighbour on the other side; between two copies nothing is deleted.

Work and memory: pages are dealt over tasks by ranges of (host, path, id), so a host of any size is spread over many tasks;
a page is compared with neighbours inside its range. Defined results: null html gives the empty text; a page without host
has no neighbour; repeated rows are neighbours and copies of each other; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy

COPY_SHARE = 0.8

# Element names of HTML by what their contents mean for a reader.
RAW = frozenset("script style noscript template textarea iframe object svg canvas math head title select option audio video".split())
CHROME = frozenset("nav footer aside form button dialog menu fieldset label input".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
                   " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
                   " tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
CHROME_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|sidebar|side-?bar|comments?|disqus|respond"
                          r"|share|sharing|social|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|masthead|newsletter"
                          r"|subscribe|subscription|popup|modal|widget|pagination|pager|toolbar|skip-?link)(?:$|[\s_-])", re.I)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME or name == "header" and not in_article:
        return True
    if not attributes.strip(" /"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = next((v for v in values if v), ""), key.lower()
        if (key in ("class", "id") and CHROME_NAMES.search(value) or key == "role" and value.lower() in _CHROME_ROLES
                or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value)):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, bool]]:
    """Block texts in page order outside elements that are no text for readers, and whether an article element holds them."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, article
    chrome = article = 0

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text and not chrome:
            out.append((text, article > 0))

    def pop(down_to: int) -> None:
        nonlocal chrome, article
        while len(stack) > down_to:
            _, c, a = stack.pop()
            chrome, article = chrome - c, article - a

    def close(name: str, stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                pop(k)
                return
            if stack[k][0] in stop:
                return

    at, lowered = 0, None
    while match := _TOKEN.match(html, at):
        at = match.end()
        closing, name, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)  # the latter: a quote is left open
        if name is None:
            if match.group()[:2] not in ("<!", "<?", "</"):
                parts.append(match.group())
            continue
        name = name.lower()
        if name in RAW:
            if not closing:
                lowered = lowered if lowered is not None else html.lower()
                end = lowered.find(f"</{name}", at)
                at = len(html) if end < 0 else end
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            close(name, frozenset())
            continue
        if name in BLOCKS:
            close("p", BLOCKS - {"p"})
            if name in ("li", "dt", "dd", "tr", "td", "th"):
                close(name, frozenset(("ul", "ol", "dl", "table")))
        if name not in VOID and not attributes.endswith("/"):
            is_article = name in ARTICLE
            flags = (name, _is_chrome(name, attributes, article > 0), is_article)
            stack.append(flags)
            chrome, article = chrome + flags[1], article + flags[2]
    flush()
    if any(marked for _, marked in out):
        return [line for line in out if line[1]]
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Indices of ``mine`` on a longest common subsequence with ``other`` (matches are tried from the right, ties stay left)."""
    low = 0
    while low < min(len(mine), len(other)) and mine[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(mine), len(other)) - low and mine[-1 - high] == other[-1 - high]:
        high += 1
    found = set(range(low)) | set(range(len(mine) - high, len(mine)))
    places: dict[str, list[int]] = {}
    for j in range(low, len(other) - high):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(low, len(mine) - high):
        for j in reversed(places.get(mine[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _difference(page: dict, neighbours: list[dict | None]) -> str:
    """The page's text after deleting lines shared with its first neighbour that is not a copy."""
    texts, marked = page["lines"], page["marked"]
    total = sum(map(len, texts)) or 1
    gone: set[int] = set()
    for other in neighbours:
        if other is None or other["host"] != page["host"] or not page["host"]:
            continue
        shared = shared_lines(texts, other["lines"])
        if sum(len(texts[i]) for i in shared) < COPY_SHARE * total:
            gone = {i for i in shared if not marked[i]}
            break
    return "\n\n".join(t for i, t in enumerate(texts) if i not in gone)


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lines = [lines_of(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), part.column("host"), part.column("path"),
                     pa.array([[t for t, _ in page] for page in lines], pa.list_(pa.string())),
                     pa.array([[m for _, m in page] for page in lines], pa.list_(pa.bool_()))],
                    names=["page_id", "url", "host", "path", "lines", "marked"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    yield from batch.slice(low, 256).to_pylist()

        done: list[tuple] = []
        source = rows()
        before, page, after = None, next(source, None), next(source, None)
        while page is not None:
            text = _difference(page, [before, after])
            done.append((page["page_id"], page["url"], text, len(text)))
            before, page, after = page, after, next(source, None) if after is not None else None
            if len(done) == 256 or page is None:
                columns = list(zip(*done))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa_kind), pa.array(columns[1], pa.string()),
                                                  pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])
                done = []

    pa_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    keyed = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"),
                         F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*|[?#].*$", "").alias("path"))
    parsed = keyed.mapInArrow(tidy(parse), f"page_id {kind}, url string, host string, path string, lines array<string>, marked array<boolean>")
    ordered = parsed.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return ordered.mapInArrow(tidy(compare), f"page_id {kind}, url string, text string, n_chars long")

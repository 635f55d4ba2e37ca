"""Main text of web pages: structure, and the runs of words that the pages of a host repeat.

Each page becomes a stream of blocks, marked as content (inside ``article`` or ``main``), open (the
page has neither) or furniture, which goes (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, by tag, role, class or id). The words of a host's pages are searched for long
substrings that stand on many of its distinct pages. A suffix array of a whole host would be one task's
work, so it is kept distributed and sorted to ``RUN`` words: as the table of the host's runs of that
many words with the number of distinct pages of each, a maximal repeat being a stretch of runs that
repeat. That table holds what may repeat alone: of every ``WINDOW`` runs that follow each other, and
of every block, the run with the smallest hash is an anchor, so that a repeated substring of
``RUN + WINDOW - 1`` words, or a repeated block of ``RUN``, has an anchor; anchors are counted first,
then all runs near those that stand on enough pages. Counts are sums over the whole host, combined in
each task before the shuffle, and do not depend on how pages are dealt to tasks.

In open blocks the words of runs on at least ``OPEN_SHARE`` of the host's distinct pages, and on
``OPEN_PAGES``, are removed. In content a repeated passage may be the article's own (quotations,
copies), so only whole blocks go, and only with runs on ``SHARE`` of at least ``CONTENT_PAGES`` pages.
An article's page that would lose more than ``MOST`` of its words keeps all, and so does an open one that would
keep less than ``RUN`` words of its own: it is a near copy of others, not an article among boilerplate. Pages with
equal html count as one.

Defined cases: a null html is an empty page, with an empty text; a page without a host groups under
the empty host; end tags that HTML lets one omit are implied, and unclosed elements end with their
parent or page; text behind an unclosed ``<`` is text; a page with an article that class names would
leave without text is read without them; repeated rows give a row each; an empty table gives no rows;
very long pages are handled whole; other columns are left aside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import BROADCAST_ROWS, claim, lean, settled, small
from criterium.llm.shingles import run_hashes, spaced_hashes

RUN, WINDOW = 8, 8
OPEN_PAGES, OPEN_SHARE = 3, 0.5
CONTENT_PAGES, SHARE = 10, 0.8
MOST = 0.8
#: Runs that a task gathers before it hands their counts on.
GATHERED = 500_000

# Elements of the HTML standard, by what they do to the text around them.
RAW = "script|style|textarea|iframe|noframes|noembed|xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("head nav footer aside form menu dialog search noscript template svg object select button canvas math video audio".split())
CONTAINERS = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CELLS = frozenset("td th caption".split())
SCOPE = CELLS | {"table", "html"}
#: What a start tag closes, and where the search for it ends.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split()) | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset("select optgroup".split()) | SCOPE),
    "td": (CELLS, frozenset("tr table".split())),
    "th": (CELLS, frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset("tbody thead tfoot table".split())),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
}
PARAGRAPH = (frozenset(["p"]), SCOPE)
KEEPS_PARAGRAPH = frozenset("body head html title caption tbody thead tfoot tr td th option optgroup legend summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Names of furniture in class and id; such a name may stand among other names and ``AROUND``.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored banner banners promo promos promotion promotions cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus replies reply respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login footer masthead pagination pager skip toolbar widget widgets".split()
)
AROUND = frozenset(
    "a area article articles bar block blog bottom box button buttons column container content desktop entry fixed form global google group head header icon icons inline inner item items js left "
    "link links list main media mobile more news outer page pane panel post posts primary reader reading region right row secondary section site slot space sticky stories story text the title to top "
    "unit user wrap wrapper".split()
)
#: Names that mean the same behind any other word but ``STATES``, which tell how the rest of a page is laid out.
STRONG = frozenset("advert advertisement advertisements sidebar navbar navigation breadcrumb breadcrumbs comments disqus newsletter footer pagination pager cookies gdpr".split())
STATES = frozenset("no not non has have with without is hide hides show shows layout two three cols columns grid full wide below above beside".split())
#: Of these names an article may be made: reader comments, adverts and teasers.
ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended".split())

PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+(?:x\d+)?|[^\W\d_]+")
CONTENT, OPEN = 1, 0


def names_furniture(name: str, known: frozenset = NAMES) -> bool:
    """Whether one class or id names furniture: all its parts are such names or go with them, or a strong name ends it."""
    parts = [p.lower() for p in PART.findall(name)]
    if not any(p in known for p in parts):
        return False
    rest = [p for p in parts if p not in known and p not in AROUND and not p[0].isdigit() and len(p) > 1]
    if not rest:
        return True
    last = max(k for k, p in enumerate(parts) if p in known)
    behind = [p for p in parts[last + 1 :] if p not in AROUND and not p[0].isdigit()]
    return parts[last] in STRONG and not behind and not STATES.intersection(parts[:last])


def is_furniture(tag: str, attributes: str, inside: bool, hints: bool = True) -> bool:
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not hints or not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES and tag != "article":
                return True
        elif any(names_furniture(v, ARTICLES if tag == "article" else NAMES) for v in value.split()):
            return True
    return False


def blocks_of(page: str, hints: bool = True) -> list[tuple[int, str]]:
    """(mark, text) of a page's blocks in order; furniture is left out. Open blocks stay only where the page has no content."""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # (tag, furniture) of open elements; in line ones only as furniture or inside of it
    inside = skip = at = 0
    articles = False

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            found.append((CONTENT if inside else OPEN, joined))

    def close(k: int) -> None:
        nonlocal inside, skip
        while len(stack) > k:
            tag, furniture = stack.pop()
            skip -= furniture
            inside -= tag in CONTAINERS and not furniture

    def close_one(tags: frozenset, until: frozenset) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return close(k)
            if stack[k][0] in until:
                return None
        return None

    for m in PIECE.finditer(page):
        if not skip:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS
        if not skip:
            if block:
                flush()
            elif tag == "br":
                text.append(" ")
        if m[2]:
            if block or skip:
                close_one(frozenset([tag]), (SCOPE if tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot") else frozenset(["table"])) if block else BLOCKS)
            continue
        if stack and tag not in IN_HEAD and any(t == "head" for t, _ in stack[:3]):
            close_one(frozenset(["head"]), frozenset())
        if block and stack:
            if tag not in KEEPS_PARAGRAPH:
                close_one(*PARAGRAPH)
            if tag in IMPLIED:
                close_one(*IMPLIED[tag])
        if tag in VOID or m[4].endswith("/"):
            continue
        furniture = is_furniture(tag, m[4], inside > 0, hints)
        if block or furniture or skip:
            stack.append((tag, furniture))
            skip += furniture
            if tag in CONTAINERS:
                articles = True
                inside += not furniture
    if not skip:
        text.append(page[at:])
        flush()
    marked = [b for b in found if b[0] == CONTENT]
    if hints and articles and not marked:
        again = blocks_of(page, False)
        if again and again[0][0] == CONTENT:
            return again
    return marked or found


def runs_of(blocks: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of ``RUN`` words of a page, by their first word; the first word of each block and the number of words)."""
    bounds = np.cumsum([0, *(t.count(" ") + 1 for _, t in blocks)])
    if bounds[-1] < RUN:
        return np.empty(0, np.uint64), bounds
    return run_hashes(spaced_hashes(" ".join(t for _, t in blocks)), RUN), bounds


def anchors_of(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the runs with the smallest hash among each ``WINDOW`` runs of the page, and of each block."""

    def smallest(begin: int, end: int) -> np.ndarray:
        if end - begin <= WINDOW:
            return np.array([begin + int(runs[begin:end].argmin())])
        return np.unique(np.lib.stride_tricks.sliding_window_view(runs[begin:end], WINDOW).argmin(axis=1) + np.arange(begin, end - WINDOW + 1))

    if not len(runs):
        return np.empty(0, np.int64)
    inner = [smallest(b, e - RUN + 1) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if e - b >= RUN]
    return np.unique(np.concatenate([smallest(0, len(runs)), *inner]))


def covered(runs: np.ndarray, words: int, frequent: np.ndarray) -> np.ndarray:
    """Which words lie in a frequent run."""
    out = np.zeros(words + 1, np.int64)
    begins = np.flatnonzero(np.isin(runs, frequent)) if len(frequent) else []
    if len(begins):
        np.add.at(out, begins, 1)
        np.add.at(out, begins + RUN, -1)
    return np.cumsum(out)[:-1] > 0


def cleaned(blocks: list[tuple[int, str]], open_runs: np.ndarray, content_runs: np.ndarray) -> str:
    """The text of a page without what its host repeats."""
    texts = [t for _, t in blocks]
    if not blocks or not (len(open_runs) or len(content_runs)):
        return "\n\n".join(texts)
    runs, bounds = runs_of(blocks)
    content = blocks[0][0] == CONTENT  # a page's blocks are of one kind
    gone = covered(runs, int(bounds[-1]), content_runs if content else open_runs)
    if content:
        for b, e in zip(bounds[:-1], bounds[1:]):
            gone[b:e] = gone[b:e].all()
    if gone.sum() > MOST * len(gone) if content else len(gone) - gone.sum() < RUN:
        return "\n\n".join(texts)
    kept = []
    for text, b, e in zip(texts, bounds[:-1], bounds[1:]):
        if gone[b:e].any():
            text = " ".join(w for w, g in zip(text.split(" "), gone[b:e]) if not g)
        if text:
            kept.append(text)
    return "\n\n".join(kept)


def _counted(pages: DataFrame, places) -> DataFrame:
    """pages (html, host, share, ..) -> host, run, n: on how many distinct pages of the host each run stands that ``places(runs, bounds, row)`` names."""
    names = pages.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html", lambda: None)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def combined() -> list[np.ndarray]:
            host, run, share = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((run, host))
            host, run, share = host[order], run[order], share[order]
            first = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (run[1:] != run[:-1])]))
            return [host[first], run[first], np.add.reduceat(share, first)]

        for batch in batches:
            for row in batch.to_pylist():
                runs, bounds = runs_of(blocks_of(row["html"]))
                own = np.unique(runs[places(runs, bounds, row)]).view(np.int64)
                if len(own):
                    held.append((np.full(len(own), row["host"]), own, np.full(len(own), row["share"])))
                    size += len(own)
                if size > GATHERED:
                    held = [tuple(combined())]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield pa.record_batch(list(held[0]), names=["host", "run", "n"])
                        held, size = [], 0
        if held:
            yield pa.record_batch(combined(), names=["host", "run", "n"])

    counts = pages.select(*names).mapInArrow(lean(count), "host long, run long, n double").groupBy("host", "run").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > OPEN_PAGES - 0.01)


def _by_host(rows: DataFrame, n: int, **columns) -> DataFrame:
    """One row of arrays for each host, to be broadcast if ``rows`` are few; a host has no more frequent runs than a few of its pages have words."""
    lists = rows.groupBy("host").agg(*(F.collect_list(c).alias(name) for name, c in columns.items()))
    return F.broadcast(lists) if n <= BROADCAST_ROWS else lists


def _array(values) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    same = settled(rows.groupBy("host", F.xxhash64("html").alias("page")).agg(F.count(F.lit(1)).alias("copies")))
    hosts = settled(same.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= OPEN_PAGES))
    repeated = settled(same.where("copies > 1"))
    # what a page counts: copies of one page count as one together
    shared = rows.withColumn("page", F.xxhash64("html")).join(small(repeated), ["host", "page"], "left").select("html", "host", (1 / F.coalesce("copies", F.lit(1))).alias("share"))

    def frequent(counts: DataFrame) -> DataFrame:
        return settled(counts.join(small(hosts), "host").where(F.col("n") > OPEN_SHARE * F.col("pages") - 0.01))

    anchors = frequent(_counted(shared, lambda runs, bounds, row: anchors_of(runs, bounds)))
    n = anchors.count()
    if n:
        near = np.arange(1 - RUN - WINDOW, RUN + WINDOW)

        def places(runs: np.ndarray, bounds: np.ndarray, row: dict) -> np.ndarray:
            at = np.flatnonzero(np.isin(runs, _array(row["anchors"])))
            at = (at[:, None] + near).ravel()
            return np.unique(at[(at >= 0) & (at < len(runs))])

        runs = frequent(_counted(shared.join(_by_host(anchors, n, anchors=F.col("run")), "host"), places))
        in_content = (F.col("pages") >= CONTENT_PAGES) & (F.col("n") > SHARE * F.col("pages") - 0.01)
        rows = rows.join(_by_host(runs, runs.count(), open_runs=F.col("run"), content_runs=F.when(in_content, F.col("run"))), "host", "left")
    else:
        rows = rows.withColumn("open_runs", F.array().cast("array<long>")).withColumn("content_runs", F.array().cast("array<long>"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html", lambda: None)
        for batch in batches:
            texts = [cleaned(blocks_of(page.as_py()), _array(a.as_py()), _array(b.as_py())) for page, a, b in zip(*(batch.column(k) for k in range(2, 5)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "open_runs", "content_runs").mapInArrow(lean(clean), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))

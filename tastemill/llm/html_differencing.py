"""Main text of pages, by differencing each page against its nearest neighbours in url order.

Within a host, pages are ordered by url path; each page is paired with the one
before and the one after it.  Their text lines (blocks) are aligned by longest
common subsequence, and lines that a neighbour shares are taken for the site's
template and deleted.

A copy of a page is no template for it.  Where what two pages share is at least
``COPY`` of the larger one's characters outside surrounding markup, the
neighbour is passed over for the nearest one on that side that differs; a page
beside copies only keeps its text.  Pages of one template whose own text is less
than a tenth of them count as copies too, and keep the template.

Differencing alone can't give the wanted text here: a copied article shares all
its lines with its neighbour, and a footer or advert that differs from page to
page is shared with none.  So markup is evidence beside it.  Blocks inside nav,
header, footer, aside, form and the like, or in an element whose class, id or
role says that it is an advert, menu, notice, sidebar or comments, are never
text; inside an article only whole class names of those kinds count, and of
headings and paragraphs the id doesn't.  An article whose class says that it is a
reader's comment is one.  Of several article or main elements on a page,
differencing decides: one of which a neighbour has every block belongs to the
site, unless all do.  What lies outside them is not text.  A single such element is
the text if it has a block that no neighbour shares, and then it stays whole; one
that is shared altogether is the site's where the unshared blocks outside of it
are longer, and these are the text.  On a page without one the unshared blocks
are text.

A host may hold a third of all pages: rows are dealt by range on (host, path,
page_id), which splits a host where it must, and a task reads its range in order.
Each range also gets the ``EDGE`` pages before and after it, so that a page finds
the same neighbours wherever ranges are cut; only in runs of more copies than
that can the cut be seen.  The bounds of ranges are found from addresses alone,
and the driver holds ``EDGE`` of them for either end of a range.  A task holds a
few pages before the current one, of which the nearest that differs counts, and
those that wait for a page that differs: a run of copies, equal blocks and equal
pages once.  The sole page of a host has no neighbour and loses no line.

Character references are decoded, white space in a block becomes one space,
blocks are joined in page order by a newline.  Defined results: null html gives
the empty text; a null url counts as empty (host and path empty).  Rows that
repeat a page are copies, with or without an article, and have the same text.
Very long pages are read in one pass: a tag that never ends is text, quotes that
are never closed are ignored from there on, a comment that is never closed hides
the rest, and elements nested deeper than ``DEPTH`` count as part of the one at
that depth.  Lines are aligned in time of their product divided by a machine
word's bits, and memory of their sum.
Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

# Element names of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - frozenset("body caption dd dt head html legend li optgroup option select td th tr tbody thead tfoot title".split())
_AROUND = frozenset("nav footer aside form head button select option optgroup label dialog menu search object canvas audio video map".split())
_MAIN = frozenset("article main".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
_HOLDS = frozenset("ul ol dl table select menu div section article main nav".split())
#: What a class or id says of an element, inside an article too; a comment's article is named by the last of these.
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
_KINDS = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar footer notice notices cookie cookies consent gdpr "
    "newsletter subscribe signup login".split()
)
#: And outside of one.
_SITE = _KINDS | frozenset("header masthead topbar banner alert popup modal overlay share sharing social related recommended widget skip copyright legal disclaimer".split())
#: Parts of a name that only say what shape it has.
_SHAPES = frozenset("box slot list item items bar block container wrapper wrap section area panel unit left right top bottom links link inner title body content group row main".split())
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
_TEXT, _OTHER, _NEVER = 2, 1, 0
COPY = 0.9  # share of the larger page from which two pages are copies
DEPTH = 512
EDGE = 16  # pages that a range has of its neighbours
BACK = 8  # pages before a run of copies that are looked through for one that differs
BATCH_ROWS, BATCH_CHARS = 1000, 1 << 23  # of a batch of results


def _says(value: str, kinds: frozenset) -> bool:
    """Whether a class or id names one of the kinds: as a whole name, or as what a name of several parts ends in."""
    for name in value.split():
        parts = [x.lower() for x in _PARTS.split(name) if x]
        while len(parts) > 1 and (parts[-1] in _SHAPES or parts[-1].isdecimal()):
            if "".join(parts[-2:]) in kinds:  # side-bar, nav-bar
                return True
            parts.pop()
        if parts and (parts[-1] in kinds or "".join(parts[-2:]) in kinds):
            return True
    return False


def _around(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in _AROUND or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    kinds = _COMMENTS if tag in _MAIN else _KINDS if in_main else _SITE
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if (name == "class" or name == "id" and not (in_main and (tag == "p" or tag in _HEADINGS))) and _says(value, kinds):
            return True
        if tag in _MAIN:
            continue
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return tag not in _MAIN and bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)|display\s*:\s*none", attrs))


class _Page:
    """A page that is read from left to right, each place a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'", "]]>")}
        self.quotes = True
        self.low: str | None = None

    def tag_end(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``; -1 where none ends any more."""
        begin = at
        if self.last[">"] < begin:
            return -1
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.end()
            if self.quotes and m.end() <= self.last[m[0]] and self.page[at : m.start()].rstrip()[-1:] == "=":
                at = self.page.index(m[0], m.end()) + 1
            else:
                at = m.end()
        self.quotes = False  # some quote hides every end
        return self.page.index(">", begin) + 1

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the closing tag of an element that holds no markup."""
        if self.low is None:
            low = self.page.lower()
            self.low = low if len(low) == len(self.page) else self.page
        end = self.low.find("</" + tag, at)
        return len(self.page) if end < 0 else self.page.find(">", end) + 1 or len(self.page)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Text blocks in page order with their kind: 0 in what surrounds the text, 2 and up inside the first and later article or main elements, 1 elsewhere."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, around from here on, number of the article or main element from here on
    opened: Counter = Counter()
    passed: Counter = Counter()  # elements that are too deep for the stack
    page = page or ""
    reader = _Page(page)
    at = mains = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                around, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                out.append((_NEVER if around else _OTHER + main, text))

    def cut(k: int) -> None:
        opened.subtract(t for t, _, _ in stack[k:])
        del stack[k:]

    def within(tag: str, stop: frozenset) -> int:
        """The place of the nearest open ``tag`` that no element of ``stop`` encloses; -1 without one."""
        if opened[tag] > 0:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    return k
                if stack[k][0] in stop:
                    break
        return -1

    while True:
        start = page.find("<", at)
        if start < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:start])
        if page.startswith(("<!", "<?"), start):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", start) and reader.last["]]>"] > start:
                end = page.index("]]>", start)
                parts.append(page[start + 9 : end])
                at = end + 3
            else:
                at = page.find(">", start) + 1 or len(page)
            continue
        m = _TAG.match(page, start)
        at = reader.tag_end(m.end()) if m else -1
        if at < 0:
            parts.append("<")
            at = start + 1
            continue
        tag, attrs = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif passed[tag]:
                passed[tag] -= 1
                if tag in _BLOCK:
                    flush()
            elif tag in _BLOCK or tag in _AROUND:
                k = within(tag, frozenset())
                if k >= 0 or tag in _BLOCK:
                    flush()
                if k >= 0:
                    cut(k)
            else:
                k = within(tag, _BLOCK)
                if k >= 0:
                    if stack[k][1] and not (k and stack[k - 1][1]):
                        flush()
                    cut(k)
            continue
        if tag in _RAW:
            if not attrs.endswith("/") or tag != "svg":
                at = reader.raw_end(tag, at)
            if tag == "title":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            k = within("p", _BLOCK) if tag in _CLOSES_P else within(tag, _HOLDS) if tag in _ITEMS else -1
            if k >= 0:
                cut(k)
        if tag in _VOID:
            continue
        if len(stack) >= DEPTH:
            passed[tag] += 1
            continue
        around, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        own = around or _around(tag, attrs, main > 0)
        if own and not around:
            flush()
        if tag in _MAIN and not own and not main:
            mains += 1
            main = mains
        stack.append((tag, own, main))
        opened[tag] += 1
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> np.ndarray:
    """Which lines of ``a`` a longest common subsequence with ``b`` has."""
    n = len(a)
    out = np.zeros(n, bool)
    names: dict[str, int] = {}
    x = np.array([names.setdefault(s, len(names)) for s in a], np.int64)
    y = np.array([names.setdefault(s, len(names)) for s in b], np.int64)
    # Equal ends belong to some longest common subsequence.
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    e = 0
    while e < min(len(x), len(y)) - k and x[len(x) - 1 - e] == y[len(y) - 1 - e]:
        e += 1
    out[:k] = True
    out[n - e :] = True
    x, y = x[k : n - e], y[k : len(y) - e]
    both = np.intersect1d(x, y)
    at = np.flatnonzero(np.isin(x, both))
    x, y = x[at], y[np.isin(y, both)]
    if len(x):
        out[k + at[_lcs(x, y)]] = True
    return out


def _lcs(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence, by halving x: memory stays linear."""
    if len(x) == 0 or len(y) == 0:
        return []
    if len(x) == 1:
        return [0] if (y == x[0]).any() else []
    half = len(x) // 2
    cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
    return _lcs(x[:half], y[:cut]) + [half + k for k in _lcs(x[half:], y[cut:])]


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x and each prefix of y: bits of one number, a step for each line of x."""
    m = len(y)
    full = (1 << m) - 1
    spots: dict[int, list[int]] = {}
    for j, s in enumerate(y.tolist()):
        spots.setdefault(s, []).append(j)
    masks: dict[int, int] = {}

    def mask(s: int) -> int:
        own, places = masks.get(s), spots.get(s, ())
        if own is None:
            if len(places) > 8:  # only lines that occur often have theirs kept
                bits = np.zeros(m, np.uint8)
                bits[places] = 1
                own = masks[s] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                own = sum(1 << j for j in places)
        return own

    v = full
    for s in x.tolist():
        u = v & mask(s)
        if u:
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _against(own: list[tuple[int, str]], other: list[tuple[int, str]]) -> np.ndarray | None:
    """Which blocks of a page another one shares; None where the other is a copy."""
    shared = shared_lines([s for _, s in own], [s for _, s in other])
    same = sum(len(s) for (kind, s), k in zip(own, shared, strict=True) if k and kind != _NEVER)
    size = max(sum(len(s) for kind, s in own if kind != _NEVER), sum(len(s) for kind, s in other if kind != _NEVER))
    return None if size and same >= COPY * size else shared


def _mains(own: list[tuple[int, str]]) -> set[int]:
    return {kind for kind, _ in own if kind >= _TEXT}


def _text(own: list[tuple[int, str]], masks: list[np.ndarray]) -> str:
    shared = np.zeros(len(own), bool)
    for mask in masks:
        shared |= mask
    mains = _mains(own)
    rest = "\n".join(s for (kind, s), gone in zip(own, shared, strict=True) if kind == _OTHER and not gone)
    if mains:
        # An element of which nothing is the page's own is the site's, unless all are.
        unlike = {kind for (kind, _), gone in zip(own, shared, strict=True) if kind >= _TEXT and not gone}
        whole = "\n".join(s for kind, s in own if kind in (unlike or mains))
        # A single one is the site's where the page's own text outside of it is longer.
        return rest if not unlike and len(mains) == 1 and len(rest) > len(whole) else whole
    return rest


def main_text(own: list[tuple[int, str]], neighbours: list[list[tuple[int, str]]]) -> str:
    """The text of a page's blocks, given its neighbours'; copies among them delete nothing."""
    masks = [_against(own, other) for other in neighbours if other]
    return _text(own, [m for m in masks if m is not None])


def differenced(pages: Iterable[tuple]) -> Iterator[tuple]:
    """(page_id, url, text) of (page_id, url, host, blocks) in url order; rows come out in the order they are settled.

    A run is pages in a row that are copies of its first.  Its pages wait for the
    first page of a later run that differs from them.
    """
    host = first = last = None
    trail: deque = deque(maxlen=BACK)  # blocks of pages before the run, the nearest at the right
    waiting: dict = {}  # blocks: [masks of the page before, rows]
    names: dict = {}  # the run's blocks, each held once

    def settle(own, masks, rows):
        text = _text(own, masks)
        for i, url in rows:
            yield i, url, text

    for i, url, own_host, page in pages:
        own = tuple(page)
        if first is not None and own_host != host:
            for key, (masks, rows) in waiting.items():
                yield from settle(key, masks, rows)
            trail.clear()
            waiting, names, first, last = {}, {}, None, None
        host = own_host
        mask = None
        if first is not None and own != first and own not in waiting:  # what waits is a copy of the first
            mask = _against(own, first)
        passed = first  # the first page of the run before, where a run begins here
        if first is None:
            first = own
        elif mask is not None:  # a new run
            trail.append(first)
            if last != first:
                trail.append(last)
            still = {}
            for key, (masks, rows) in waiting.items():
                after = _against(key, own)
                if after is None:
                    still[key] = [masks, rows]
                else:
                    yield from settle(key, [*masks, after], rows)
            waiting, names, first = still, {}, own
        held = waiting.get(own)
        if held is None:
            own = tuple(names.setdefault(b, b) for b in own)
            before = []
            for other in reversed(trail):
                near = mask if mask is not None and other is passed else _against(own, other)
                if near is not None:
                    before = [near]
                    break
            held = waiting[own] = [before, []]
        held[1].append((i, url))
        last = own
    for key, (masks, rows) in waiting.items():
        yield from settle(key, masks, rows)


def _ranges(keys: DataFrame, n: int) -> list[tuple[bytes, bytes, bytes | None]]:
    """Of each range of the sorted keys: its first key, and the first and last one that it has with its edges (None: no last)."""

    def run(batches):
        first: list[str] = []
        last: deque = deque(maxlen=EDGE)
        for batch in batches:
            own = batch.column(0).to_pylist()
            first += own[: EDGE - len(first)]
            last.extend(own[-EDGE:])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.string())) for x in (first, list(last))], ["first", "last"])

    ends = keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, "first array<string>, last array<string>")
    rows = sorted(([k.encode() for k in r["first"]], [k.encode() for k in r["last"]]) for r in ends.collect())  # a row for each range
    out = []
    for q, (first, _) in enumerate(rows):
        before = [k for _, last in rows[max(0, q - EDGE) : q] for k in last][-EDGE:]
        after = [k for own, _ in rows[q + 1 : q + 1 + EDGE] for k in own][:EDGE]
        out.append((first[0], before[0] if before else b"", after[-1] if after else None))
    return out


def _dealt(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (with the range before it), own: pages of each range in order, and those of its edges, which are not its own."""
    address = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(address, r"(?s)^[^:/?#]*://([^/?#]*)", 1))
    path = F.regexp_extract(address, r"(?s)^(?:[^:/?#]*://[^/?#]*)?(.*)$", 1)
    key = F.concat_ws("\0", host, path, F.col("page_id").cast("string"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(pages.select(key.alias("key")), n)
    starts = [s for s, _, _ in ranges]
    lows = [low for _, low, _ in ranges]
    highs = [high for _, _, high in ranges if high is not None]

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            k = k.encode()
            own = max(0, bisect_right(starts, k) - 1)
            out.append([2 * q + (q == own) for q in range(bisect_left(highs, k), max(1, bisect_right(lows, k)))])
        return pd.Series(out)

    rows = pages.select("page_id", "url", "html", host.alias("host"), key.alias("key")).withColumn("place", F.explode(places("key")))
    rows = rows.withColumn("range", F.floor(F.col("place") / 2).cast("int"))
    rows = rows.repartitionById(max(1, len(ranges)), "range").sortWithinPartitions("range", "key", F.xxhash64("html"))
    return rows.select("page_id", "url", "html", F.concat_ws("\0", F.col("range").cast("string"), "host").alias("host"), (F.col("place") % 2 == 1).alias("own"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``."""
    dealt = _dealt(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        id_type = None

        def parsed():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                for i, url, page, own_host, own in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    yield (i, own), url, own_host, blocks(page)

        def emit(out):
            cols = [pa.array([r[k] for r in out], t) for k, t in ((0, id_type), (1, pa.string()), (2, pa.string()))]
            size = pa.array([len(r[2]) for r in out], pa.int64())
            return pa.RecordBatch.from_arrays([*cols, size], ["page_id", "url", "text", "n_chars"])

        out, chars = [], 0
        for (i, own), url, text in differenced(parsed()):
            if not own:
                continue
            out.append((i, url, text))
            chars += len(text)
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield emit(out)
                out, chars = [], 0
        if out:
            yield emit(out)

    return dealt.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_differencing": op2_html_differencing}
ORACLES: dict[str, str] = {}

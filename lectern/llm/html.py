"""Main-text extraction by wrapper induction.

Pages of one host are aligned in bounded groups: every page's DOM tree is matched to a
pivot page's by simple tree matching (the most nodes in order-preserving pairs of equal
tags), pages that match badly to a pivot of their own layout.  A node whose own text is
the same on all pages that have it is template; nodes that vary are content slots.  The
slots' text, less link text, elects the page's main region, whose blocks are the result.

Markup comes second: elements that are furniture by their nature (nav, form, script, ...)
hold no content; a class, id or role that names furniture removes a subtree of the
region only while that holds the smaller part of what varies.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shared

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Element names by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "html", "body"}
FURNITURE = set("head script style title noscript template nav footer aside form button select iframe svg math object dialog menu textarea canvas audio video datalist".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "main", "body", "html"}
#: Words in class or id that name furniture wherever they stand, words that do
#: where every word of the name is furniture or neutral ("site-header", not "post-header"), and
#: the neutral ones.
SURE = set("sidebar newsletter navbar masthead breadcrumb breadcrumbs pagination pager popup modal disqus comments advert adverts advertisement advertisements advertising adsense gdpr".split())
LIKELY = set(
    "ad ads banner sponsor sponsored promo promotion promoted cookie cookies consent notice notices alert alerts overlay subscribe signup subscription widget widgets nav navigation menu menus header "
    "topbar footer comment respond reply replies share sharing social related recommended recommendations toolbar skip".split()
)
NEUTRAL = set(
    "site page main top bottom left right box block list container wrapper wrap inner outer area section item items posts articles stories link links bar bars button buttons icon icons global primary "
    "secondary content slot unit zone row col group panel bottom fixed sticky thread tree form text to for by the a js id".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: Cells of a table of child lists; longer lists are halved until they fit.
CELLS = 250_000
#: Different pages that must agree on a text; the share of a page's prose beyond which what
#: agrees is one article on several pages and no template; the share of its elements that
#: a page must match to have a pivot's layout.
LEAST, COPIES, LAYOUT = 3, 0.8, 0.5


@dataclass
class Page:
    """Elements in page order: tag, attributes, parent, end of the subtree; and texts
    with the element they stand in (an element boundary of a block is a text of None)."""

    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    texts: list[tuple[int, str | None]] = field(default_factory=list)


def parse(source: str) -> Page:
    """A lenient DOM of any depth: unclosed and stray tags never fail."""
    page = Page()
    stack: list[int] = []
    # Places in the stack, in order, of each tag and of all that end a search for implied ends.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []

    def open_(tag: str, attrs: str) -> int:
        page.tag.append(tag)
        page.attrs.append(attrs)
        page.parent.append(stack[-1] if stack else -1)
        page.end.append(0)
        return len(page.tag) - 1

    def close() -> None:
        i = stack.pop()
        places[page.tag[i]].pop()
        if page.tag[i] in SCOPE:
            scopes.pop()
        page.end[i] = len(page.tag)
        if page.tag[i] in BLOCK:
            page.texts.append((i, None))

    def push(i: int) -> None:
        places.setdefault(page.tag[i], []).append(len(stack))
        if page.tag[i] in SCOPE:
            scopes.append(len(stack))
        stack.append(i)

    push(open_("html", ""))
    at, size = 0, len(source)
    while at < size:
        m = TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at:
            page.texts.append((stack[-1], source[at:stop]))
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            k = (places.get(tag) or [0])[-1]
            while k and len(stack) > k:
                close()
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                page.texts.append((stack[-1], entities.escape(m[0][9:].removesuffix("]]>"))))
            continue
        attrs = m[3] if m[2] else m[5]
        if tag in CLOSES_P or tag in IMPLIED:
            goal = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            above = [at[k] for at in (places.get(g, []) for g in goal) if (k := bisect_right(at, scopes[-1])) < len(at)]
            while above and len(stack) > min(above):
                close()
        if tag == "html" or tag == "body" and "body" in page.tag:
            continue
        i = open_(tag, attrs or "")
        page.texts.append((i, None if tag in BLOCK else " " if tag == "br" else ""))
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            stop = found.start() if found else size
            page.texts.append((i, source[at:stop]))
            at = stop
            if found:
                closing = source.find(">", stop)
                at = closing + 1 if closing >= 0 else size
            page.end[i] = len(page.tag)
        elif tag in VOID or (attrs or "").endswith("/"):
            page.end[i] = len(page.tag)
        else:
            push(i)
    while stack:
        close()
    return page


def equal_ends(a: list[int] | tuple[int, ...], b: list[int] | tuple[int, ...]) -> tuple[int, int]:
    """Lengths of the equal heads and, of the rest, of the equal tails."""
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


class Matcher:
    """Simple tree matching with interned shapes: equal shapes have equal numbers."""

    def __init__(self) -> None:
        self.names: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...], int]] = []
        self.known: dict[tuple[int, int], int] = {}

    def shape(self, page: Page) -> tuple[list[int], list[list[int]]]:
        """Shape number and children of every element."""
        n = len(page.tag)
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[page.parent[i]].append(i)
        out = [0] * n
        for i in range(n - 1, -1, -1):
            key = (page.tag[i], *(out[c] for c in children[i]))
            got = self.names.get(key)
            if got is None:
                got = self.names[key] = len(self.shapes)
                self.shapes.append((page.tag[i], key[1:], 1 + sum(self.shapes[out[c]][2] for c in children[i])))
            out[i] = got
        return out, children

    def weight(self, a: int, b: int) -> int:
        """Pairs of the best matching of two shapes; children go before their parents,
        without recursion, so that depth is no limit."""
        todo = [] if a == b or (a, b) in self.known else [(a, b)]
        while todo:
            x, y = todo[-1]
            (ta, ca, _), (tb, cb, _) = self.shapes[x], self.shapes[y]
            if (x, y) not in self.known and ta == tb:
                head, tail = equal_ends(ca, cb)
                left, right = set(ca[head : len(ca) - tail]), set(cb[head : len(cb) - tail])
                wanted = [(u, v) for u in left for v in right if u != v and (u, v) not in self.known]
                if wanted:
                    todo += wanted
                    continue
            if (x, y) not in self.known:
                self.known[x, y] = 0 if ta != tb else 1 + sum(self.weight(ca[i], cb[j]) for i, j in self.pairs(ca, cb))
            todo.pop()
        return self.shapes[a][2] if a == b else self.known[a, b]

    def pairs(self, a: list[int] | tuple[int, ...], b: list[int] | tuple[int, ...]) -> list[tuple[int, int]]:
        """Positions paired by the best order-preserving matching of child shapes.  Equal
        heads and tails pair at once, which loses nothing; a rest of over ``CELLS``
        cells is halved where the best matchings of its halves add up to the most."""
        head, tail = equal_ends(a, b)
        out = [(i, i) for i in range(head)] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
        m, n = len(a) - head - tail, len(b) - head - tail
        if not m or not n:
            return out
        if m * n > CELLS:
            return out + [(head + i, head + j) for i, j in self.halved(a[head : head + m], b[head : head + n])]
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            row, above, x = best[i + 1], best[i], a[head + i]
            for j in range(n):
                w = self.weight(x, b[head + j])
                row[j + 1] = max(row[j], above[j + 1], above[j] + w)
        i, j = m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((head + i, head + j))
        return out

    def halved(self, a: list[int] | tuple[int, ...], b: list[int] | tuple[int, ...]) -> list[tuple[int, int]]:
        """``pairs`` by Hirschberg's division: one row of the table at a time."""
        kinds, at = np.unique(np.array(b), return_inverse=True)
        rows: dict[int, np.ndarray] = {}

        def last(xs, at: np.ndarray) -> np.ndarray:
            row = np.zeros(len(at) + 1, dtype=np.int64)
            for x in xs:
                if x not in rows:
                    rows[x] = np.array([self.weight(x, int(k)) for k in kinds], dtype=np.int64)
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[x][at]))
            return row

        if len(a) == 1:
            last(a, at)
            w = rows[a[0]][at]
            return [(0, int(w.argmax()))] if w.max() else []
        mid = len(a) // 2
        cut = int((last(a[:mid], at) + last(a[mid:][::-1], at[::-1])[::-1]).argmax())
        return self.pairs(a[:mid], b[:cut]) + [(mid + i, cut + j) for i, j in self.pairs(a[mid:], b[cut:])]

    def align(self, a: tuple[list[int], list[list[int]]], b: tuple[list[int], list[list[int]]]) -> dict[int, int]:
        """Element of ``a`` for each paired element of ``b``; the roots are a pair."""
        (sa, ca), (sb, cb) = a, b
        out, todo = {}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[y] = x
            for i, j in self.pairs([sa[c] for c in ca[x]], [sb[c] for c in cb[y]]):
                u, v = ca[x][i], cb[y][j]
                if self.shapes[sa[u]][0] == self.shapes[sb[v]][0]:
                    todo.append((u, v))
        return out


def own_texts(page: Page) -> dict[int, str]:
    """Text that stands directly in each element, white space made one."""
    parts: dict[int, list[str]] = {}
    for i, text in page.texts:
        if text and not text.isspace():
            parts.setdefault(i, []).append(text)
    return {i: SPACE.sub(" ", " ".join(x)).strip() for i, x in parts.items()}


def texts_hash(texts: dict[int, str]) -> int:
    """Equal for pages of equal texts."""
    return hash(tuple(sorted(texts.items())))


def templates(pages: list[Page], least: int = LEAST) -> list[set[int]]:
    """For each page the elements that are template: their own text is equal on all
    pages, ``least`` or more with different texts and half of those of a layout, that
    align with the layout's pivot."""
    matcher = Matcher()
    shapes = [matcher.shape(p) for p in pages]
    texts = [own_texts(p) for p in pages]
    wholes = [texts_hash(t) for t in texts]
    out: list[set[int]] = [set() for _ in pages]
    left = list(range(len(pages)))
    while len({wholes[k] for k in left}) >= least:
        pivot = max(left, key=lambda k: (len(pages[k].tag), -k))
        maps = {k: matcher.align(shapes[pivot], shapes[k]) for k in left}
        like = [k for k in left if k == pivot or len(maps[k]) >= LAYOUT * len(pages[k].tag)]
        left = [k for k in left if k not in like]
        seen: dict[int, dict[int, str]] = {}
        for k in like:
            for y, x in maps[k].items():
                seen.setdefault(x, {})[wholes[k]] = texts[k].get(y, "")
        enough = max(least, len({wholes[k] for k in like}) // 2)
        fixed = {x for x, by in seen.items() if len(by) >= enough and len(set(by.values())) == 1 and next(iter(by.values()))}
        for k in like:
            out[k] = {y for y, x in maps[k].items() if x in fixed}
    return [t if copied(p, t) <= COPIES else set() for p, t in zip(pages, out)]


def copied(page: Page, template: set[int]) -> float:
    """The share of a page's prose that is template: text outside furniture and links."""
    n = len(page.tag)
    aside = [False] * n
    for i in range(n):
        aside[i] = page.tag[i] in FURNITURE or page.tag[i] == "a" or page.parent[i] >= 0 and aside[page.parent[i]]
    sizes = [(i in template, len(t)) for i, t in page.texts if t and not aside[i] and not t.isspace()]
    return sum(n for fixed, n in sizes if fixed) / max(1, sum(n for _, n in sizes))


def names_furniture(value: str) -> bool:
    """Whether a class or id names furniture."""
    for name in value.split():
        parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if x]
        words = {x.lower() for x in parts if not x.isdigit()}
        if words & SURE or words & LIKELY and words <= LIKELY | NEUTRAL:
            return True
    return False


def named(attrs: str) -> bool:
    """Whether attributes name furniture."""
    return any(m[1].lower() in ("class", "id") and names_furniture(m[2] or m[3] or m[4] or "") or m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ROLES for m in NAME.finditer(attrs))


def hidden(attrs: str) -> bool:
    for m in NAME.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def sums(page: Page, counts) -> list[int]:
    """Running totals of the sizes of texts for which ``counts(element)`` holds, by element."""
    own = [0] * (len(page.tag) + 1)
    for i, text in page.texts:
        if text and counts(i):
            own[i + 1] += len(text.strip())
    return list(accumulate(own))


def main_text(page: Page, template: set[int]) -> str:
    """The blocks of the main region, each in one line."""
    n = len(page.tag)
    linked, never, literal = [False] * n, [False] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        linked[i] = page.tag[i] == "a" or p >= 0 and linked[p]
        literal[i] = page.tag[i] in ("pre", "code") or p >= 0 and literal[p]
        never[i] = p >= 0 and never[p] or page.tag[i] in FURNITURE or hidden(page.attrs[i])
    mains = [i for i in range(n) if page.tag[i] in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", page.attrs[i])]
    # Furniture by nature that holds a main element is a wrapper (a form around a whole page).
    for i in range(n):
        if page.tag[i] in FURNITURE and page.tag[i] not in RAW and any(i < k < page.end[i] for k in mains):
            outer = page.parent[i] >= 0 and never[page.parent[i]]
            for k in range(i, page.end[i]):
                p = page.parent[k]
                never[k] = outer or p > i and never[p] or k > i and (page.tag[k] in FURNITURE or hidden(page.attrs[k]))
    slots = sums(page, lambda i: not never[i] and not linked[i] and i not in template)
    varying = lambda i: slots[page.end[i]] - slots[i]
    out = never[:]
    for i in range(n):
        p = page.parent[i]
        holds = any(i < k < page.end[i] for k in mains)
        if p >= 0 and out[p]:
            out[i] = True
        elif not out[i] and not literal[i] and page.attrs[i] and named(page.attrs[i]):
            # Names break ties: they remove the smaller part of what varies where they stand,
            # and on a page with a main element all of what stands outside it.
            around = next((k for k in reversed(mains) if k < i < page.end[k]), None)
            out[i] = not holds and (around is None and bool(mains) or 2 * varying(i) <= varying(around or 0))
        elif page.tag[i] == "header":
            out[i] = not holds
    # a header of an article keeps its headings
    for i in range(n):
        if page.tag[i] in HEADINGS and out[i] and not never[i]:
            p = page.parent[i]
            while p >= 0 and out[p] and page.tag[p] in ("div", "hgroup", "a", "span"):
                p = page.parent[p]
            if p >= 0 and page.tag[p] == "header" and any(k < p < page.end[k] for k in mains) and not out[page.parent[p]]:
                for k in range(i, page.end[i]):
                    out[k] = False
    kept = sums(page, lambda i: not out[i] and not linked[i] and i not in template)
    prose = lambda i: kept[page.end[i]] - kept[i]
    live = [i for i in mains if not out[i]]
    articles = [i for i in live if page.tag[i] == "article"] or live
    best = max(articles, key=lambda i: (prose(i), i), default=None)
    # An article or main element is the region unless what varies stands elsewhere.
    if best is not None and 2 * prose(best) >= prose(0):
        region = best
    else:
        region = 0
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[page.parent[i]].append(i)
        while True:
            below = [i for i in children[region] if page.tag[i] in BLOCK and page.tag[i] not in ("p", "pre", "li", "blockquote", *HEADINGS)]
            largest = max(below, key=prose, default=None)
            if largest is None or prose(largest) * 10 < prose(region) * 7 or not prose(largest):
                break
            region = largest
    blocks: list[tuple[bool, bool, str]] = []
    now: list[tuple[int, str]] = []

    def close():
        # A constant heading goes with what follows it; other constant text is template.
        heading = any(page.tag[i] in HEADINGS for i, _ in now)
        fixed = bool(now) and heading and all(i in template for i, t in now if t.strip())
        some = [t for i, t in now if fixed or i not in template]
        text = SPACE.sub(" ", entities.unescape("".join(some))).strip()
        if text:
            blocks.append((fixed, heading, text))
        now.clear()

    for i, text in page.texts:
        if text is None:
            close()
        elif region <= i < page.end[region] and not out[i]:
            now.append((i, text))
    close()
    lines: list[str] = []
    for k, (fixed, _, text) in enumerate(blocks):
        follows = next((not f and not h for f, h, _ in blocks[k + 1 :]), False) if fixed else True
        if follows:
            lines.append(text)
    return "\n".join(lines)


def extract_group(sources: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    pages = [parse(s or "") for s in sources]
    return [main_text(p, t) for p, t in zip(pages, templates(pages))]


def extract_host(sources: list[str | None], guests: list[str | None], group: int) -> list[str]:
    """Main texts of different pages of one host, aligned in groups of up to ``group``, to
    each of which the ``guests`` come."""
    parsed = {s: parse(s or "") for s in dict.fromkeys([*sources, *guests])}
    out: list[str] = []
    rounds = -(-len(sources) // group)
    at = 0
    for left in range(rounds, 0, -1):
        some = sources[at : at - (-(len(sources) - at) // left)]
        at += len(some)
        held = set(some)
        pages = [parsed[s] for s in [*some, *(g for g in guests if g not in held)]]
        out += [main_text(p, t) for p, t in zip(pages[: len(some)], templates(pages))]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, group: int = 32, salt_over: int = 64, guests: int = 8, broadcast_hosts: int = 50_000) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page.

    A host of over ``salt_over`` pages is dealt out by a hash of id and url, and ``guests``
    of its different pages go to every part, so that parts full of copies have pages to
    compare with and all parts some in common.  In a part, different pages are aligned in
    groups of up to ``group``, the guests in each; equal html is extracted once.  Only a
    host with fewer than three different pages has no template and goes by markup alone.

    Null html gives an empty text; a null or odd url belongs to the host "".  Repeated rows
    are extracted one by one; null ids are allowed.  An empty table gives an empty result;
    other columns are not used.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    rows = rows.withColumns({"h": F.xxhash64("html"), "own": F.xxhash64("id", "url")})
    # One page for each class of hashes; the sizes of the classes add up to the host's.
    picked = rows.groupBy("host", F.pmod("h", F.lit(guests)).alias("k")).agg(F.count("*").alias("n"), F.min(F.struct("h", "own")).alias("guest"))
    large = picked.groupBy("host").agg(F.sum("n").alias("n"), F.collect_list("guest").alias("guests")).where(F.col("n") > salt_over)
    large = shared.cut(large.select("host", F.ceil(F.col("n") / salt_over).cast("int").alias("n"), "guests"), "hosts")
    # Up to broadcast_hosts large hosts are sent to all tasks, which saves a shuffle of the pages; more are joined.
    large = F.broadcast(large) if large.count() <= broadcast_hosts else large
    told = rows.join(large, "host", "left").withColumn("salt", F.pmod("own", F.coalesce("n", F.lit(1))).cast("int"))
    visits = F.when(F.array_contains("guests", F.struct("h", "own")), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("salt"))
    dealt = told.withColumn("to", F.explode(visits)).select("host", "to", (F.col("to") != F.col("salt")).alias("visits"), F.coalesce(F.array_contains("guests", F.struct("h", "own")), F.lit(False)).alias("guest"), "id", "url", "html")
    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        key, kind = None, pa.int64()
        # By html: the ids and urls that have it.
        held: dict[str | None, list[tuple]] = {}
        invited: dict[str | None, None] = {}

        def done():
            sources = list(held)
            for source, text in zip(sources, extract_host(sources, list(invited)[: 2 * guests], group)):
                own = held[source]
                for at in range(0, len(own), 1024):
                    ids, urls = zip(*own[at : at + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array([text] * len(ids), pa.string()), pa.array([len(text)] * len(ids), pa.int64())], ["id", "url", "text", "n_chars"])
            held.clear()
            invited.clear()

        for batch in batches:
            kind = batch.column(4).type
            for host, to, visits, guest, id_, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (host, to):
                    yield from done()
                    key = (host, to)
                if guest:
                    invited[source] = None
                if not visits:
                    held.setdefault(source, []).append((id_, url))
        yield from done()

    return dealt.repartition("host", "to").sortWithinPartitions("host", "to", "id").mapInArrow(run, f"id {id_kind}, url string, text string, n_chars long")

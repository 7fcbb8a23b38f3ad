"""Main text of web pages by site template removal.

A first pass hashes the element subtrees of every page, once as its place (the names and classes from the root down) and
once as its content.  Spark counts per host on how many pages of different main text a place and a content occur, so that
copies of one page count once.  A second pass deletes what recurs across many pages of the host: a content that recurs,
or a place that is filled from a stock, so that pages of different text share contents there more often than texts do by
chance.  Class words decide where a place recurs with contents of which hardly two are equal; only on hosts of too few
pages to tell do they decide alone, and a page's ``article`` with them.  Headings and paragraphs beside an article are its
own unless they recur or are marked.  Elements that are no text of a page by their kind (scripts, forms, menus, footers,
...) go always, as do reader comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limited, map_rows, scratch, staged

MIN_PAGES = 4
MIN_SHARE = 0.2
MANY_PAGES = 50
SHARED = 0.1
MOST_TEXT_INSIDE = 0.2
BROADCAST_MARKS = 200_000  # pages whose marks are broadcast

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas textarea title xmp".split())
DROPPED = frozenset("nav footer aside form button select dialog menu object audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = frozenset("br td th wbr img input button select".split())
CLOSES_P = BLOCKS - frozenset("body head html option optgroup legend caption tr tbody tfoot thead".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
MAIN = frozenset(("article", "main"))
CORES = frozenset("div section td body center details".split())
CONTAINERS = frozenset("div section ul ol dl table aside form nav footer header figure fieldset menu details address center".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended comment comments disqus respond reply replies login signin search widget widgets toolbar pagination pager masthead topbar skip header top".split()
)
INSIDE_WORDS = BOILER_WORDS - frozenset("notice notices alert header top skip".split())
AD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
LINK_WORDS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs related recommended pagination pager toolbar widget widgets".split())
OWN = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
BESIDE_WORDS = frozenset("bar box list container wrapper wrap block area section links link item items inner left right bottom main site page post global primary secondary thread posts articles".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSING = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
TO_THE_END = frozenset("script style title textarea xmp".split())


def says(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id is one of ``words``, alone or beside words that mean nothing else (``share-bar``)."""
    parts = PART.findall(CAMEL.sub(" ", token).lower())
    return any(p in words for p in parts) and all(p in words or p in BOILER_WORDS or p in BESIDE_WORDS for p in parts)


def digest(*parts: str) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """Elements and texts of a page in flat lists; element 0 is the document."""

    def __init__(self, source: str):
        self.tag: list[str] = [""]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [0]
        self.events: list[tuple[int, str | None]] = []  # (element, text); None for a block's border
        self._read(source)

    def _read(self, source: str) -> None:
        tag, attrs, parent, events = self.tag, self.attrs, self.parent, self.events
        stack, at, end = [0], 0, len(source)
        text_of = entities.unescape
        standing: Counter = Counter()  # how many of each name are open, so that no stack is searched in vain
        unclosed = set()

        def cut(i: int) -> None:
            for node in stack[i:]:
                standing[tag[node]] -= 1
            del stack[i:]

        def close(names: tuple, stops: tuple | frozenset) -> None:
            if not any(standing[n] for n in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if tag[stack[i]] in names:
                    return cut(i)
                if tag[stack[i]] in stops:
                    return

        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                events.append((stack[-1], text_of(source[at:stop])))
            if not m:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                if m.group().startswith("<![CDATA["):
                    events.append((stack[-1], m.group()[9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                if name in BLOCKS:
                    events.append((stack[-1], None))
                elif name in SPACED:
                    events.append((stack[-1], " "))
                close((name,), CONTAINERS if name == "p" else ())
                continue
            attributes = (m.group(3) or m.group(6) or "").strip()
            if name in RAW:
                if attributes.endswith("/") and name not in TO_THE_END or name in unclosed:
                    continue
                closed = CLOSING[name].search(source, at)
                if closed:
                    at = closed.end()
                elif name in TO_THE_END:
                    at = end
                else:
                    unclosed.add(name)
                continue
            if name in CLOSES_P and len(stack) > 1:
                close(("p",), CONTAINERS)
            if name in IMPLIED:
                close(tuple(IMPLIED[name][0].split()), IMPLIED[name][1])
            if name in BLOCKS:
                events.append((stack[-1], None))
            elif name in SPACED:
                events.append((stack[-1], " "))
            if name in VOID:
                continue
            tag.append(name)
            attrs.append(attributes)
            parent.append(stack[-1])
            stack.append(len(tag) - 1)
            standing[name] += 1

    def survey(self) -> None:
        """For each element: dead (no text of a page by its kind), inner (within the page's own text), holds (is or has it),
        its size, and the runs of text that stand directly in it."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        self.dead, self.named, self.tokens = [False] * n, [{}] * n, [()] * n
        inside, comment = [False] * n, [False] * n
        for i in range(1, n):
            p = parent[i]
            if self.attrs[i]:
                self.named[i] = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(self.attrs[i])}
                self.tokens[i] = tuple(f"{self.named[i].get('class', '')} {self.named[i].get('id', '')}".split())
            inside[i] = inside[p] or tag[i] in MAIN
            self.dead[i] = self.dead[p] or self._is_no_text(i, inside[p])
            comment[i] = comment[p] or (tag[i] not in ("html", "body") and any(says(t, COMMENT_WORDS) for t in self.tokens[i]))
        self.has_main = any(t in MAIN and not d and not c for t, d, c in zip(tag, self.dead, comment, strict=True))
        lengths, runs = [0] * n, [[] for _ in range(n)]
        for node, text in self.events:
            if text and not self.dead[node] and (t := " ".join(text.split())):
                runs[node].append(t)
                lengths[node] += len(t)
        self.size = self._sizes(lengths)
        # comments go, unless the page has no article and they are the greater part of it
        for i in range(1, n):
            if comment[i] and (self.has_main or 2 * self.size[i] <= self.size[0] or self.dead[parent[i]]):
                self.dead[i] = True
            self.dead[i] = self.dead[i] or self.dead[parent[i]]
        self.size = self._sizes([0 if d else x for x, d in zip(lengths, self.dead, strict=True)])
        link = [False] * n
        for i in range(1, n):
            link[i] = tag[i] == "a" or link[parent[i]]
        self.linked = self._sizes([x if k and not d else 0 for x, k, d in zip(lengths, link, self.dead, strict=True)])
        core = self._core()
        self.holds, self.inner = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            self.holds[i] = self.holds[i] or (tag[i] in MAIN and not self.dead[i]) or i == core
            self.holds[parent[i]] = self.holds[parent[i]] or self.holds[i]
        self.holds[0], self.inner[0] = True, core == 0
        for i in range(1, n):
            p = parent[i]
            self.inner[i] = self.inner[p] or i == core or (tag[i] in MAIN and not self.dead[i])
        self.runs = runs

    def _sizes(self, lengths: list[int]) -> list[int]:
        """Characters of each subtree from those that stand directly in each element."""
        size = list(lengths)
        for i in range(len(size) - 1, 0, -1):  # children come after their parent
            size[self.parent[i]] += size[i]
        return size

    def _is_no_text(self, i: int, inside: bool) -> bool:
        name, named = self.tag[i], self.named[i]
        if name in DROPPED or (name == "header" and not inside):
            return True
        if not named or name in ("html", "body"):
            return False
        if "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", "")):
            return True
        return named.get("role", "").lower() in BOILER_ROLES

    def _core(self) -> int:
        """Without an article: the innermost container that has over half of the page's text."""
        if self.has_main:
            return -1
        core = 0
        for i in range(1, len(self.tag)):
            if self.parent[i] == core and 2 * self.size[i] > self.size[0] and (self.tag[i] in CORES or self.tag[i] == "html"):
                core = i
        return core

    def marked(self, i: int, alone: bool = False) -> bool:
        """Whether class words mark a part as boilerplate, or on a host of which nothing is known (``alone``) its standing
        beside an article does.

        Within the page's own text an advert may be any element, other boilerplate containers only, and what is named
        like a list of links has to be one.
        """
        tokens = self.tokens[i]
        if not self.inner[i]:
            return (alone and self.has_main and self.tag[i] not in OWN) or any(says(t, BOILER_WORDS) for t in tokens)
        if any(says(t, AD_WORDS) for t in tokens):
            return True
        if self.tag[i] not in CONTAINERS:
            return False
        return any(says(t, INSIDE_WORDS - LINK_WORDS) for t in tokens) or (any(says(t, LINK_WORDS) for t in tokens) and 2 * self.linked[i] >= self.size[i])

    def _small(self, i: int) -> bool:
        return self.size[i] <= MOST_TEXT_INSIDE * self.size[0]

    def parts(self) -> list[tuple[int, bool]]:
        """(element, whether its own runs of text alone) of whatever may be a template's.

        Beside the page's own text any element with text; within it containers that have at most a fifth of the text or
        class words' marks.  The runs of text that stand directly in an element around the page's own text are a part.
        """
        out = []
        for i in range(len(self.tag)):
            if self.dead[i] or not self.size[i]:
                continue
            if self.holds[i]:
                if self.runs[i] and not self.inner[i]:
                    out.append((i, True))
            elif not self.inner[i] or (self.tag[i] in CONTAINERS and self._small(i)) or self.marked(i):
                out.append((i, False))
        return out

    def hashes(self, parts: list[tuple[int, bool]]) -> list[tuple[int, int]]:
        """Place and content of each part; content 0 for one that is too large to be a template's by its content."""
        within = [False] * len(self.tag)
        for i, alone in parts:
            within[i] = not alone
        for i in range(1, len(self.tag)):
            within[i] = within[i] or within[self.parent[i]]
        pieces, content = {i: list(self.runs[i]) for i, w in enumerate(within) if w}, {}
        for i in sorted(pieces, reverse=True):  # children come after their parent
            content[i] = digest(self.tag[i], *pieces[i])
            if self.size[i] and self.parent[i] in pieces:
                pieces[self.parent[i]].append(f"{content[i]:x}")
        place = {0: 0}

        def place_of(i: int) -> int:
            way = []
            while i not in place:
                way.append(i)
                i = self.parent[i]
            for k in reversed(way):
                kind = " ".join(sorted(re.sub(r"\d+", "#", t.lower()) for t in self.tokens[k]))
                place[k] = digest(str(place[self.parent[k]]), self.tag[k], kind)
            return place[way[0]] if way else place[i]

        out = []
        for i, alone in parts:
            if alone:
                out.append((digest(str(place_of(i)), "#"), digest(*self.runs[i])))
            else:
                out.append((place_of(i), content[i] if not self.inner[i] or self._small(i) else 0))
        return out

    def text(self, gone: frozenset[int] | None = None, often: frozenset[int] = frozenset()) -> str:
        """The blocks that stay, joined by two line feeds.

        ``gone`` has the parts (numbers of ``parts``) that go, ``often`` those whose place recurs, of which the marked
        ones go.  With None for ``gone`` nothing is known of the host, and all marked parts go.
        """
        dead, silent = list(self.dead), set()
        for k, (i, alone) in enumerate(self.parts()):
            if (gone is not None and k in gone) or ((gone is None or k in often) and self.marked(i, gone is None)):
                if alone:
                    silent.add(i)
                else:
                    dead[i] = True
        for i in range(1, len(dead)):
            dead[i] = dead[i] or dead[self.parent[i]]
        blocks, now = [], []
        for node, text in self.events:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif not dead[node] and node not in silent:
                now.append(text)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)


def read(source: str | None) -> Page:
    page = Page(source or "")
    page.survey()
    return page


def host(url):
    """Lower-case host (and port) of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def recurring_parts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """page_key, gone and often of every page: the numbers of its parts that go, and of those whose place recurs.

    A content or place recurs if it is on ``min_pages`` and on ``min_share`` of the host's pages, or on ``many`` of them.
    A part goes if its content recurs, or if it stands beside the page's own text in a place that recurs and whose
    contents are a stock: at least ``SHARED`` of them are on two pages or more.  Pages of a host with equal main text count as one page,
    whatever their urls.  On hosts of fewer than ``min_pages`` pages both are null.
    """

    def make():
        def apply(c):
            got = [read(t) for t in c["html"]]
            main = [digest(p.text()) for p in got]
            told = [[{"no": k, "beside": not p.inner[i], "place": place, "content": content} for k, ((i, _), (place, content)) in enumerate(zip(parts, p.hashes(parts), strict=True))] for p in got for parts in [p.parts()]]
            return {"page_key": c["page_key"], "host": c["host"], "main": main, "parts": told}

        return apply

    keyed = pages.select(F.xxhash64("url", "html").alias("page_key"), host("url").alias("host"), "html")
    schema = "page_key long, host string, main long, parts array<struct<no: int, beside: boolean, place: long, content: long>>"
    found = map_rows(keyed, make, schema, raw=("page_key", "host"))
    # one row for equal pages; a page has as many parts as elements at most
    found = staged(found.groupBy("page_key").agg(*[F.any_value(c).alias(c) for c in ("host", "main", "parts")]), "parts")
    sites = found.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    each = found.select("page_key", "host", "main", F.explode("parts").alias("p")).select("page_key", "host", "main", "p.*")
    contents = each.select("host", "place", "content", "main").distinct().groupBy("host", "place", "content").agg(F.count("*").alias("n"))
    places = each.select("host", "place", "main").distinct().groupBy("host", "place").agg(F.count("*").alias("on"))
    shared = contents.groupBy("host", "place").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("shared"))
    recurs = lambda n: (F.col(n) >= min_pages) & ((F.col(n) >= F.col("pages") * min_share) | (F.col(n) >= many))
    places = places.join(sites, "host").filter(recurs("on")).join(shared, ["host", "place"])
    judged = contents.join(places, ["host", "place"]).select("host", "place", "content", (recurs("n") & (F.col("content") != 0)).alias("same"), (F.col("shared") >= SHARED).alias("stock"))
    goes = F.col("same") | (F.col("stock") & F.col("beside"))
    marks = each.join(judged, ["host", "place", "content"]).groupBy("page_key").agg(F.collect_set(F.when(goes, F.col("no"))).alias("gone"), F.collect_set("no").alias("often"))
    known = found.join(sites.filter(F.col("pages") >= min_pages), "host").select("page_key")
    none = F.array().cast("array<int>")
    return known.join(marks, "page_key", "left").select("page_key", F.coalesce("gone", none).alias("gone"), F.coalesce("often", none).alias("often"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null or empty html gives an empty text; a null url is a host of its own; repeated rows and copies at other urls stay
    and count as one page; an empty table gives an empty result; other columns are ignored.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"))
    with scratch(pages.sparkSession):
        marks = staged(recurring_parts(pages, min_pages, min_share).withColumnRenamed("page_key", "key"), "marks", kept=True)
    # the html isn't dealt out as long as the marks are few enough to be sent to it
    rows = keyed.join(limited(marks, BROADCAST_MARKS), "key", "left").select("page_id", "url", "html", "gone", "often")

    def make():
        def apply(c):
            texts = [read(t).text(None if g is None else frozenset(g), frozenset(o or ())) for t, g, o in zip(c["html"], c["gone"], c["often"], strict=True)]
            return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(rows, make, f"page_id {kind}, url string, text string, n_chars long", raw=("page_id", "url"))

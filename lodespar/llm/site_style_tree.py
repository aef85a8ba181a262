"""Main text of web pages by site style trees.

A page is read into blocks of text, each under a path of elements (tag and
class). The pages of one host are merged into a style tree: for each path how
many pages have it, in which styles its children come (presentation: the row of
their tags and classes, where equal neighbours count once), and on how many
pages each block below it stands (content; blocks whose letters all belong to
links are one feature, whatever they say). A node's presentation importance is
the entropy of its children's styles, to the base of the number of pages; a
block's content importance is one less the entropy of its spread over pages, so
what stands on every page has none. A node's importance weighs both by depth.
On paths of at least ``MIN_PAGES`` pages, a branch all of whose nodes are below
``LEAST`` is removed from each page of the host, and so is a block of text whose
own content importance is, whatever stands beside it. The tree holds all nodes,
those of the lists below too, and its verdict comes first. It never empties a
page: where all blocks would go, they stay.

What the tree can't tell, as where each page has other words in its footer or
advert, or a host has few pages, is left to marks that hold on every page.
Elements that by their tag, role or class are menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts or styles are removed,
and where a page marks an article or main part, text outside of it
is removed. Words of class or id that tell a state (has-sidebar, no-ads) don't
count, nor do any on a main part, on an element around it, or, where all
articles stand in elements of such words, on those around the least enclosed.

Edge cases: null and empty pages give an empty text. Pages without a host in
their url are judged by their own marks only. Repeated pages count as often as
they stand. Elements below a depth of ``DEEP`` have the path of the one at that
depth around them; their text is read like any other, and a page of any length
is read whole. Unclosed tags, comments and scripts end with the page. Other
columns of the input don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib
from collections.abc import Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

LEAST = 0.1
MIN_PAGES = 4
GAMMA = 0.9
#: Depth below which elements have no paths of their own.
DEEP = 64
#: Most marks, and bytes of their hosts' names, that are sent to every executor; more join by a shuffle, with the same result.
BROADCAST_MARKS, BROADCAST_BYTES = 500_000, 8 << 20

#: The feature of blocks that are links from end to end.
LINKS = 0

#: Elements without an end, elements of raw text, elements that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements, roles and words of class or id that hold no main text.
NOISE_TAGS = frozenset("head script style noscript template textarea title iframe nav aside footer form button select option datalist label input object embed svg canvas video audio dialog menu map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer colophon related recommended recommendations share sharing social comment comments respond reply replies disqus discussion pagination pager toolbar search searchbox skip".split()
)
_MAIN_WORDS = frozenset(("main", "article"))

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
#: A whole attribute, so that no name is found inside another's name or value.
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[-_]\S*")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: A start of one of these ends an open p; a start of a key ends an open one of its values.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = frozenset("article aside body div footer form header main nav section table ul ol dl".split())
_P_ENDS = BLOCK - frozenset(("br", "html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"))
_MASK = (1 << 62) - 1


def _step(parent: int, name: str) -> int:
    return (parent * 1_000_003 + zlib.crc32(name.encode("utf-8", "replace")) * 2_654_435_761 + 12_345) & _MASK


def _line(parts) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip()


class Node:
    """named: the node itself and those around it that only words of class or id mark as noise, by number."""

    __slots__ = ("depth", "kids", "last", "link", "main", "named", "noise", "path", "tag")

    def __init__(self, tag: str, path: int, depth: int, noise: bool, main: bool, named: frozenset[int] = frozenset(), link: bool = False):
        self.tag, self.path, self.depth, self.noise, self.main, self.named, self.link = tag, path, depth, noise, main, named, link
        self.kids, self.last = 0, ""


class Page:
    """blocks: (text, path hashes from the root, whether inside a main part); styles: (path, hash of children's styles)."""

    def __init__(self, html: str | None):
        #: (text, paths around it, whether inside a main part, feature)
        self.blocks: list[tuple[str, tuple[int, ...], bool, int]] = []
        #: All blocks with the paths around them, those that the lists remove too; and their features.
        self.all: list[tuple[str, tuple[int, ...]]] = []
        self.features: list[int] = []
        self.styles: list[tuple[int, int]] = []
        self._parts: list[tuple[str, frozenset[int], bool]] = []
        self._dark: list[tuple[str, bool]] = []
        self._stack = [Node("", 1, 0, False, False)]
        self._open_tags: dict[str, int] = {}
        self._pieces: list[list[tuple[str, frozenset[int], bool]]] = []
        self._count = 0
        self._mains: list[frozenset[int]] = []
        self._articles: list[frozenset[int]] = []
        self._read(html or "")
        self._unname()

    def _unname(self) -> None:
        """Drops what stands in elements that their words mark as noise, but for those that are or hold the main part."""
        clear = frozenset().union(*self._mains)
        parts = [x - clear for x in self._mains + self._articles]
        least = min(map(len, parts), default=0)
        clear = clear.union(*(x for x in parts if len(x) == least))
        kept = []
        for (_, paths, main, _), pieces in zip(self.blocks, self._pieces):
            gone = [x for x in pieces if not x[1] <= clear] if any(x[1] for x in pieces) else []
            if gone:
                pieces = [x for x in pieces if x[1] <= clear]
                if text := _line(x[0] for x in gone):
                    self._note(text, paths, _feature(text, gone))
            if text := _line(x[0] for x in pieces):
                kept.append((text, paths, main, _feature(text, pieces)))
                self._note(text, paths, kept[-1][3])
        self.blocks = kept

    def _note(self, text: str, paths: tuple[int, ...], feature: int) -> None:
        self.all.append((text, paths))
        self.features.append(feature)

    def _paths(self) -> tuple[int, ...]:
        return tuple(n.path for n in self._stack[1 : DEEP + 1])

    def _flush(self) -> None:
        self._flush_dark()
        if self._parts:
            pieces, self._parts = self._parts, []
            top = self._stack[-1]
            if not top.noise and any(not x[0].isspace() for x in pieces):
                self.blocks.append(("", self._paths(), top.main, LINKS))
                self._pieces.append(pieces)

    def _flush_dark(self) -> None:
        """Text that the lists remove, for the tree only."""
        if self._dark:
            pieces, self._dark = self._dark, []
            if text := _line(x[0] for x in pieces):
                self._note(text, self._paths(), _feature(text, pieces))

    def _text(self, raw: str) -> None:
        if raw:
            top, raw = self._stack[-1], _html.unescape(raw) if "&" in raw else raw
            if top.noise:
                self._dark.append((raw, top.link))
            else:
                self._parts.append((raw, top.named, top.link))

    def _pop(self) -> None:
        if len(self._stack) > 1 and self._stack[-1].noise != self._stack[-2].noise:
            self._flush_dark()
        node = self._stack.pop()
        if node.tag:
            self._open_tags[node.tag] -= 1
        if node.kids:
            self.styles.append((node.path, node.kids))

    def _close(self, names, fence=_FENCES) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i].tag
            if tag in names:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag in fence:
                return

    def _open(self, tag: str, attrs: str) -> None:
        if tag in _P_ENDS:
            self._close(("p",))
        elif tag in _ENDS:
            self._close(_ENDS[tag])
        if tag in VOID:
            return
        top = self._stack[-1]
        words: set[str] = set()
        role, label, hidden = "", tag, False
        if attrs:
            known: set[str] = set()
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in known:  # the first of equal names counts
                    continue
                known.add(name)
                if name == "role":
                    role = value.strip()
                elif name in ("class", "id"):
                    words.update(w for w in _SPLIT.split(_STATE.sub("", value)) if w)
                    if name == "class":
                        label = f"{tag}.{value}"
                elif name == "hidden" or (name == "aria-hidden" and value.strip() == "true"):
                    hidden = True
        inside = tag in ("article", "main") or role in ("main", "article")
        noise = top.noise or hidden or tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not top.main)
        named = top.named
        if not noise and tag not in ("html", "body") and words & NOISE_WORDS:
            self._count += 1
            named = named | {self._count}
        if inside and not noise:
            (self._mains if "main" in (tag, role) else self._articles).append(named)
        path = _step(top.path, label) if top.depth < DEEP else top.path
        if top.last != label:
            top.kids, top.last = _step(top.kids or 7, label), label
        self._stack.append(Node(tag, path, top.depth + 1, noise, top.main or (inside and not noise), named, top.link or tag == "a"))
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if not m:
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in BLOCK:
                    self._flush()
                if tag not in VOID and self._open_tags.get(tag):
                    self._close((tag,), () if tag in _FENCES or tag == "html" else _FENCES)
                continue
            if tag in BLOCK:
                self._flush()
            attrs = m[3] or m[6] or ""
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            self._open(tag, attrs)
            if attrs.endswith("/") and tag in ("svg", "path", "math"):
                self._pop()
        self._flush()
        while self._stack:
            self._pop()

    def text(self, removed: Set[int] = frozenset(), repeated: Set[tuple[int, int]] = frozenset()) -> str:
        """removed: paths whose own blocks go; repeated: path and feature of single blocks that go."""
        blocks = self.blocks
        if any(b[2] for b in blocks):
            blocks = [b for b in blocks if b[2]]
        if removed or repeated:
            blocks = [b for b in blocks if not b[1] or (b[1][-1] not in removed and (b[1][-1], b[3]) not in repeated)] or blocks
        return "\n".join(b[0] for b in blocks)


def _feature(text: str, pieces) -> int:
    """Of a block's text and its pieces, the last item of which tells whether it is a link."""
    if all(x[-1] or x[0].isspace() for x in pieces):
        return LINKS
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: Kinds of rows that a page adds to its host's tree.
_PAGES, _STYLE, _CONTENT = 0, 1, 2


def _observe(batches):
    for batch in _util.steps(batches, "html"):
        cols: list[list] = [[], [], [], [], [], []]
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            seen: set[tuple[int, int, int, int, int]] = set()
            own = {(paths[-1], f) for f, (_, paths) in zip(page.features, page.all) if paths}
            for f, (_, paths) in zip(page.features, page.all):
                for depth, p in enumerate(paths, 1):
                    seen.add((p, _PAGES, 0, depth, 0))
                    seen.add((p, _CONTENT, f, depth, int((p, f) in own)))
            known = {x[0] for x in seen}
            seen.update((p, _STYLE, s, 0, 0) for p, s in page.styles if p in known)
            for row in seen:
                cols[0].append(host)
                for c, v in zip(cols[1:], row):
                    c.append(v)
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32())], names=["host", "path", "kind", "feature", "depth", "own"])


def style_tree(pages: DataFrame) -> DataFrame:
    """pages: host, html. Returns per host and path: n_pages, depth, presentation, content, importance."""
    return _importance(_counts(pages))


def _counts(pages: DataFrame) -> DataFrame:
    _util.ship(pages.sparkSession)
    rows = pages.where("host is not null and html is not null").select("host", "html").mapInArrow(_observe, "host string, path bigint, kind int, feature bigint, depth int, own int")
    return rows.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.max("own").alias("own"))


def _importance(counts: DataFrame) -> DataFrame:
    # sums that don't need the number of pages: with m pages, log_m(x) is ln(x) / ln(m)
    n, kind = F.col("n").cast("double"), F.col("kind")
    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(kind == _PAGES, F.col("n"))).alias("n_pages"), F.max("depth").alias("depth"),
        F.sum(F.when(kind == _STYLE, n * F.log(n))).alias("s_log"), F.sum(F.when(kind == _STYLE, n)).alias("s_n"),
        F.sum(F.when(kind == _CONTENT, n * F.log(n))).alias("c_log"), F.sum(F.when(kind == _CONTENT, n)).alias("c_n"),
    )
    base = F.greatest(F.log(F.col("n_pages").cast("double")), F.lit(1e-9))
    one = F.col("n_pages") <= 1
    presentation = F.when(one, 1.0).when(F.col("s_n").isNull(), 0.0).otherwise((F.log("s_n") - F.col("s_log") / F.col("s_n")) / base)
    content = F.when(one, 1.0).otherwise(1 - F.col("c_log") / F.col("c_n") / base)
    nodes = nodes.where("n_pages is not null").select("host", "path", "n_pages", "depth", presentation.alias("presentation"), content.alias("content"), F.col("s_n").isNull().alias("leaf"))
    fade = F.pow(F.lit(GAMMA), F.col("depth"))
    return nodes.withColumn("importance", F.when(F.col("leaf"), F.col("content")).otherwise((1 - fade) * F.col("presentation") + fade * F.col("content")))


def host_of(url):
    """The host of a url column, in lower case; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: page_id, url, text (its blocks in page order, joined by one newline) and n_chars."""
    spark = pages.sparkSession
    _util.ship(spark)
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    counts = _util.cut(_counts(named.select("host", "html")))
    nodes = _importance(counts).where(F.col("n_pages") >= min_pages).select("host", "path", "n_pages", "importance")
    # a removed branch is one without a node that counts, so its blocks go by their own nodes; a block that stands on n of m pages has an importance of 1 - log_m(n)
    paths = nodes.where(F.col("importance") < least).select("host", "path", F.lit(None).cast("bigint").alias("feature"))
    often = counts.where((F.col("kind") == _CONTENT) & (F.col("own") == 1) & (F.col("feature") != LINKS) & (F.col("n") >= 2)).select("host", "path", "feature", "n").join(nodes.where(F.col("importance") >= least), ["host", "path"])
    often = often.where((F.col("n_pages") > 1) & (1 - F.log("n") / F.log("n_pages") < least)).select("host", "path", "feature")
    marks = _util.cut(paths.unionAll(often))
    many, wide = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    kind = pages.schema[id_col].dataType.simpleString()
    rows = named.select("page_id", "url", "html", "host")
    sent = None
    if many <= BROADCAST_MARKS and wide <= BROADCAST_BYTES:
        known: dict[str, tuple[set[int], set[tuple[int, int]]]] = {}
        for host, path, feature in zip(*(c.to_pylist() for c in marks.toArrow().columns)):
            removed, repeated = known.setdefault(host, (set(), set()))
            removed.add(path) if feature is None else repeated.add((path, feature))
        sent = spark.sparkContext.broadcast(known)
    else:
        by_host = marks.groupBy("host").agg(F.collect_set(F.when(F.col("feature").isNull(), F.col("path"))).alias("low"), F.collect_set(F.when(F.col("feature").isNotNull(), F.struct("path", "feature"))).alias("often"))
        rows = rows.join(by_host, "host", "left")

    def run(batches):
        none: tuple[set, set] = (set(), set())
        for batch in _util.steps(batches, "html"):
            pages_ = [Page(h) for h in batch.column("html").to_pylist()]
            if sent is not None:
                texts = [p.text(*sent.value.get(h, none)) for p, h in zip(pages_, batch.column("host").to_pylist())]
            else:
                texts = [p.text(set(x or ()), {(e["path"], e["feature"]) for e in y or ()}) for p, x, y in zip(pages_, batch.column("low").to_pylist(), batch.column("often").to_pylist())]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")

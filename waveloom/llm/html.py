"""Main text of web pages by removal of site templates.

Each page is parsed into elements and blocks of text.  Every element subtree is hashed, Spark counts on
how many pages of a host each hash stands, and subtrees that recur on many of them go.  What HTML itself
or a class name calls furniture (menus, footers, forms, notices, comments ...) needs fewer pages to count
as recurring, and goes without recurring where nothing else can be meant, as on small sites.

Counting: a page is a witness of a subtree by the longest block of it outside the subtree.  A subtree is
a template if it has enough different witnesses (LEAST_PAGES; LEAST_MARKED if it is marked as furniture)
and none of them stands for more than half of its pages; so neither copies nor near copies of an article
make its own paragraphs a template.  Single paragraphs, headings and list items inside an explicit
article or main must also stand on LEAST_SHARE of all pages of the host: a passage that articles quote
stays.

Defined results: a null or empty page has the empty text; pages whose url is null share the host ''; all
outermost articles and mains of a page are kept, in page order; a page without any is taken whole, less
its furniture and templates.  Repeated rows each get the same text; other columns are not passed on, so
none can clash; an empty table gives an empty one.  An aside is a sidebar and goes, whatever it is called; inside an
article a fieldset, an element inside a line, and a name that has other words than furniture's go only if they recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_CHARS, arrow_schema, slices, store

#: Different pages of a host on which a subtree is a template; the same for one that is marked as furniture.
LEAST_PAGES, LEAST_MARKED = 5, 2
#: Share of a host's pages on which a single paragraph inside an article is a template.
LEAST_SHARE = 0.5

# Fixed values of HTML: element kinds by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements whose text is never a page's prose.
EMBEDDED = frozenset(
    "head style script noscript template iframe svg math canvas object audio video button select option textarea title input label xmp noembed noframes".split()
)
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Words in class or id names that mark furniture everywhere.
MARKS = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs sidebar ad ads adbox advert adverts advertisement sponsor sponsored cookie cookies consent gdpr"
    " newsletter subscribe subscription signup login comment comments commentlist disqus replies widget pagination pager toolbar adsense adslot"
    " advertising cookiebar cookiebanner cookieconsent sidenav topnav subnav".split()
)
#: The same outside of articles; inside one (as in story-header or related-work) such a part must recur, unless the name has no other word.
LOOSE = frozenset(
    "menu footer header masthead topbar promo banner notice notices popup modal overlay respond related recommended share sharing social skip"
    " copyright notification".split()
)
#: Of MARKS, words that have other meanings inside articles too: there they count as LOOSE ones in a longer name.
OPEN = frozenset("widget login signup comment subscribe subscription".split())
#: A name that ends with one of these is that of reader comments.
COMMENTS = frozenset("comments commentlist disqus replies".split())
#: Elements inside a line of text, which are furniture inside an article only if they recur.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time u var".split())
#: A class such as has-sidebar or no-comments speaks of the page, not of the element.
MODIFIERS = frozenset("has no with without is not".split())
ROOTS = ("article", "main")
CONTAINER = frozenset("article main div section ul ol dl table figure details center menu".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

#: How sure it is that an element is furniture: not marked, if it recurs, in any case.
PLAIN, LIKELY, SURE = 0, 1, 2
#: Kinds of subtrees, in the two low bits of their keys: any, a single paragraph inside an article, marked.
ANY, PROSE, MARKED = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _named(name: str, inside: bool) -> int:
    """What a class or id name says of an element."""
    parts = [p.lower() for p in _NAME.findall(name)] if name.lower() not in MARKS | LOOSE else [name.lower()]
    if not parts or parts[0] in MODIFIERS:
        return PLAIN
    marked, loose = not MARKS.isdisjoint(parts), not LOOSE.isdisjoint(parts)
    if not inside:
        return SURE if marked or loose else PLAIN
    # inside an article a name with other words, such as ad-hoc or signup-fee, may be that of a subject
    if (MARKS - OPEN | LOOSE).issuperset(parts) or parts[-1] in COMMENTS:
        return SURE
    return LIKELY if marked or loose else PLAIN


def _furniture(tag: str, attrs: str, inside: bool) -> int:
    """PLAIN, LIKELY or SURE; inside: the element stands in an article or main."""
    if tag == "fieldset" and inside:
        return LIKELY  # without a form around it, a group of anything
    if tag in FURNITURE or tag in EMBEDDED:
        return SURE
    if not attrs or tag in ("html", "body", *ROOTS) or not _TELLING.search(attrs):
        return PLAIN
    sure = PLAIN
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named = max([PLAIN, *(_named(c, inside) for c in value.split())])
            sure = max(sure, min(named, LIKELY) if inside and tag in INLINE else named)
        value = value.lower()
        if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return SURE
    return SURE if re.search(r"(?:^|\s)hidden(?:\s|$)", attrs) else sure


def _hash(*parts: bytes) -> bytes:
    return xxhash.xxh3_64_digest(b"\0".join(parts))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


class Page:
    """One parsed page: blocks of text (text, element), and the elements that they stand in.

    For each element: tag, parent, mark, the outermost article or main around it (0: none), parts of its hash, hash."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marks, self.roots = ["#"], [-1], [PLAIN], [0]
        self.parts: list[list[bytes]] = [[]]
        self.hashes = [b""]
        self.blocks: list[tuple[str, int]] = []
        self._open, self._text = [0], []
        self._parse(html)
        for at in range(1, len(self.tags)):  # what stands in furniture is furniture
            if self.marks[self.parents[at]] == SURE:
                self.marks[at] = SURE

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            self._text = []
            if text:
                at = self._open[-1]
                self.blocks.append((text, at))
                self.parts[at].append(_hash(text.encode("utf-8", "replace")))

    def _close(self, depth: int) -> None:
        """Close open elements until `depth` of them are left."""
        self._flush()
        while len(self._open) > depth:
            at = self._open.pop()
            parts = self.parts[at]
            if parts:
                self.hashes[at] = _hash(self.tags[at].encode("utf-8", "replace"), *parts)
                if at:
                    self.parts[self.parents[at]].append(self.hashes[at])

    def _depth(self, tag: str) -> int:
        """Place of the innermost open element of that name; 0: none."""
        return next((i for i in range(len(self._open) - 1, 0, -1) if self.tags[self._open[i]] == tag), 0)

    def _parse(self, html: str) -> None:
        search, pos = _TAG.search, 0
        skipped: list[str] = []  # open elements from one on whose text is no prose, or that is inline furniture
        while m := search(html, pos):
            if not skipped and m.start() > pos:
                self._text.append(html[pos : m.start()])
            pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            end, tag, attrs = m[1] or m[4], tag.lower(), m[3] or m[6] or ""
            if skipped:
                if end:
                    if tag in skipped:
                        while skipped.pop() != tag:
                            pass
                    elif tag in ("body", "html") or self._depth(tag):
                        # the end of an element around it: its own end tag was left out
                        skipped.clear()
                        pos = m.start()
                elif skipped == ["head"] and tag not in HEAD:
                    skipped.clear()
                    pos = m.start()
                elif tag in RAW:
                    pos = self._raw_end(html, tag, pos)
                elif (tag == skipped[0] or tag in BLOCK and tag != "p" and tag not in _CLOSED_BY) and not attrs.endswith("/") and tag not in VOID:
                    skipped.append(tag)
                continue
            if end:
                if tag in BLOCK:
                    if depth := self._depth(tag):
                        self._close(depth)
                    else:
                        self._flush()
                continue
            if tag in RAW:
                pos = self._raw_end(html, tag, pos)
                continue
            if tag in VOID:
                if tag == "br":
                    self._text.append(" ")
                elif tag == "hr":
                    self._flush()
                continue
            if tag in BLOCK:
                self._start(tag, attrs)
                if attrs.endswith("/") and self.marks[-1] == SURE:
                    self._close(len(self._open) - 1)
            elif _furniture(tag, attrs, self.roots[self._open[-1]] > 0) == SURE:
                self._text.append(" ")
                if not attrs.endswith("/"):
                    skipped.append(tag)
        if not skipped and pos < len(html):
            self._text.append(html[pos:])
        self._close(0)

    @staticmethod
    def _raw_end(html: str, tag: str, pos: int) -> int:
        m = re.compile(rf"</{tag}[^>]*>", re.I).search(html, pos)
        return m.end() if m else len(html)

    def _start(self, tag: str, attrs: str) -> None:
        self._flush()
        if self.tags[self._open[-1]] == "p":
            self._close(len(self._open) - 1)
        elif tag == "p" and (depth := self._depth("p")):
            self._close(depth)
        if tag in _CLOSED_BY:
            names = [self.tags[i] for i in self._open]
            for i in range(len(names) - 1, 0, -1):
                if names[i] in _SCOPE[tag]:
                    break
                if names[i] in _CLOSED_BY[tag]:
                    self._close(i)
                    break
        at, above = len(self.tags), self._open[-1]
        root = self.roots[above]
        mark = _furniture(tag, attrs, root > 0)
        if tag in HEADINGS and root and mark == PLAIN:
            # the header of an article with its title belongs to it
            for i in self._open:
                if i > root and self.tags[i] == "header":
                    self.marks[i] = PLAIN
        if tag in ROOTS and not root and not any(self.marks[i] == SURE for i in self._open):
            root = at
        self.tags.append(tag)
        self.parents.append(above)
        self.marks.append(mark)
        self.roots.append(root)
        self.parts.append([])
        self.hashes.append(b"")
        self._open.append(at)

    def _above(self, at: int) -> Iterator[int]:
        while at > 0:
            yield at
            at = self.parents[at]

    def subtrees(self, host: str) -> dict[int, int]:
        """Key by element of every subtree that may be a template, of marked ones the outermost.  The key holds host and kind."""
        found, salt = {}, host.encode("utf-8", "replace")
        for at in range(1, len(self.tags)):
            tag, above = self.tags[at], self.parents[at]
            if not self.hashes[at] or tag in ("html", "body") or self.roots[at] == at or self.marks[above] == SURE:
                continue
            kind = MARKED if self.marks[at] else PROSE if self.roots[at] and tag not in CONTAINER else ANY
            found[at] = _number(_hash(salt, self.hashes[at])) & ~3 | kind
        return found

    def kept(self) -> list[tuple[str, int]]:
        """The blocks that no mark removes: of all articles and mains, or of the page if it has none."""
        some = [(text, at) for text, at in self.blocks if self.marks[at] != SURE]
        inside = [(text, at) for text, at in some if self.roots[at]]
        return inside or some

    def main(self) -> list[str]:
        """The texts of the kept blocks."""
        return [text for text, _ in self.kept()]

    def witnessed(self, host: str) -> dict[int, tuple[int, bool, list[int]]]:
        """For each subtree's key: the hash of the longest block outside of it (0: there is none), whether it
        goes in any case, and the first and last place of its kept blocks (of each of equal subtrees)."""
        keys = self.subtrees(host)
        longest = sorted((-len(text), k) for k, (text, _) in enumerate(self.blocks))
        around = [set(self._above(self.blocks[k][1])) for _, k in longest[:8]]
        places: dict[int, list[int]] = {}
        for k, (_, block) in enumerate(self.kept()):
            for at in self._above(block):
                places.setdefault(at, [k, k])[1] = k
        out: dict[int, tuple[int, bool, list[int]]] = {}
        for at, key in keys.items():
            if key in out:
                out[key][2].extend(places.get(at, []))
                continue
            place = next((p for p, above in enumerate(around) if at not in above), None)
            if place is None:  # it holds the longest blocks: look at all others
                place = next((p for p in range(len(around), len(longest)) if at not in self._above(self.blocks[longest[p][1]][1])), None)
            witness = 0 if place is None else _number(_hash(self.blocks[longest[place][1]][0].encode("utf-8", "replace")))
            out[key] = witness, self.marks[at] == SURE, list(places.get(at, []))
        return out


ROWS = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("page", "host", "subtree", "around")),
        T.StructField("sure", T.BooleanType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ]
)


def _key(url: str | None, html: str) -> int:
    """A page's number: rows with the same url and html are one page."""
    return _number(_hash((url or "").encode("utf-8", "replace"), html.encode("utf-8", "replace")))


def subtrees(pages: DataFrame) -> DataFrame:
    """page, host (hashed), subtree, around, sure, places: one row for each element subtree of a page that may be
    a template, with what :meth:`Page.witnessed` tells of it."""
    arrow = arrow_schema(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, htmls in slices(batch, "html"):
                rows: dict[str, list] = {f.name: [] for f in arrow}
                for url, html in zip(part.column("url").to_pylist(), htmls, strict=True):
                    host = host_of(url)
                    found = Page(html).witnessed(host) if html else {}
                    rows["page"] += [_key(url, html)] * len(found)
                    rows["host"] += [_number(_hash(host.encode("utf-8", "replace")))] * len(found)
                    rows["subtree"] += found.keys()
                    for name, values in zip(("around", "sure", "places"), zip(*found.values(), strict=True)):
                        rows[name] += values
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], names=arrow.names)

    return pages.select("url", "html").mapInArrow(run, ROWS)


def kept_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, page, whole (the kept blocks joined by line breaks, as a zstandard frame), marked (how many
    different subtrees are furniture in any case)."""
    added = T.StructType([T.StructField("page", T.LongType()), T.StructField("whole", T.BinaryType()), T.StructField("marked", T.LongType())])
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(write_checksum=False).compress
        for batch in batches:
            for part, htmls in slices(batch, "html"):
                keys, texts, marked = [], [], []
                for url, html in zip(part.column("url").to_pylist(), htmls, strict=True):
                    page = Page(html)
                    keys.append(_key(url, html))
                    texts.append(packed("\n".join(page.main()).encode()))
                    marked.append(len({key for at, key in page.subtrees("").items() if page.marks[at] == SURE}))
                columns = [pa.array(keys, pa.int64()), pa.array(texts, pa.binary()), pa.array(marked, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def unpacked(joined: DataFrame) -> DataFrame:
    """`joined` with text in place of whole and places: the blocks of `whole` outside of all ranges of `places`."""
    kept = [f for f in joined.schema.fields if f.name not in ("whole", "places")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts: list[str] = []
            begin = size = 0
            for k, (whole, places) in enumerate(zip(batch.column("whole"), batch.column("places"), strict=True), 1):
                text = unpack(whole.as_py()).decode()
                if places := places.as_py():
                    blocks: list[str | None] = text.split("\n")
                    for first, last in zip(places[::2], places[1::2], strict=True):
                        blocks[first : last + 1] = [None] * (last + 1 - first)
                    text = "\n".join(b for b in blocks if b is not None)
                texts.append(text)
                size += len(text)
                if size >= SLICE_CHARS or k == batch.num_rows:  # few texts are unpacked at a time
                    columns = [batch.column(f.name).slice(begin, k - begin) for f in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)
                    texts, begin, size = [], k, 0

    return joined.mapInArrow(run, schema)


def templates(rows: DataFrame, least_pages: int = LEAST_PAGES, least_marked: int = LEAST_MARKED, least_share: float = LEAST_SHARE) -> DataFrame:
    """subtree: the keys of those that recur on many pages of their host.  `rows` as :func:`subtrees` gives them."""
    kind = F.col("subtree").bitwiseAND(3)
    counted = rows.groupBy("subtree", "around").agg(F.min("host").alias("host"), F.count("*").alias("pages"))
    counted = counted.groupBy("subtree").agg(F.min("host").alias("host"), F.count("*").alias("witnesses"), F.sum("pages").alias("pages"), F.max("pages").alias("most"))
    least = F.when(kind == MARKED, least_marked).otherwise(least_pages)
    counted = counted.filter((F.col("witnesses") >= least) & (2 * F.col("most") <= F.col("pages")))
    sizes = rows.groupBy("host").agg(F.count_distinct("page").alias("all"))
    prose = counted.filter(kind == PROSE).join(sizes, "host").filter(F.col("pages") >= least_share * F.col("all")).select("subtree")
    return counted.filter(kind != PROSE).select("subtree").unionByName(prose)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by line breaks), n_templates (subtrees of the page that recur on its
    host), n_marked (others that only their marks remove).

    Pages are parsed twice, once for the counts and once for the texts, which then move once, each packed for
    itself (Spark packs blocks of rows with a quicker codec that leaves half as much again); what stays on disk
    in between are a few numbers for each subtree.
    """
    rows = store(subtrees(pages), "pages-subtrees")
    # a set, as rows of a page that stands twice are equal
    found = rows.join(templates(rows), "subtree").groupBy("page").agg(F.collect_set(F.struct("subtree", "sure", "places")).alias("gone"))
    found = found.select(
        "page",
        F.flatten(F.transform("gone", lambda g: g["places"])).alias("places"),
        F.size("gone").alias("n_templates"),
        F.size(F.filter("gone", lambda g: g["sure"])).alias("n_sure"),
    )
    joined = kept_texts(pages).join(found, "page", "left").select(
        "page_id",
        "url",
        "whole",
        "places",
        F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"),
        (F.col("marked") - F.coalesce("n_sure", F.lit(0))).alias("n_marked"),
    )
    return unpacked(joined).select("page_id", "url", "text", "n_templates", "n_marked")


def contract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_templates, n_marked."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))

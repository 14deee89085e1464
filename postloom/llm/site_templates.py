"""Main text of pages by removal of site templates: element subtrees that recur across a host's pages are deleted.

1. Each page is read once into its blocks (runs of text between the borders of block elements, in page order) and the
   block elements over them. Every such element is a subtree with a hash of its tags and texts, and the range of blocks it covers.
2. Spark counts, per host, in how many different pages a subtree occurs. Pages whose whole body is the same count as one, so copies of a page do
   not make it a template.
3. Subtrees that many pages of the host share are templates; their blocks are deleted.

What counts as many depends on where the subtree stands, because paragraphs recur too (copied passages) and are text all the same:

    outside the article of a page that marks one        `LEAST_PAGES` pages
    anywhere in a page that marks none                  `SITE_SHARE` of the host's pages, `SITE_PAGES` at least
    inside the article, holding other block elements    `SITE_SHARE` as well
    inside the article, a plain paragraph or heading    never

Elements that say what they are go without a count, because a menu on a host's only page recurs nowhere: `nav`, `footer`, `aside`, forms, scripts and
styles by name; adverts, notices, sidebars, comments and the like by role or by a word of `class` or `id`, unless they hold the article.
Of what is left the text in `article` elements counts, in a page without one that in `main`, otherwise all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import kept, map_text
from postloom.operators.joins import MAX_BROADCAST_ROWS

LEAST_PAGES = 3
SITE_PAGES = 5
SITE_SHARE = 0.5
SALTS = 16

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr
ul""".split())
SPACED = frozenset("br td th img input button select".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
DROPPED = frozenset("nav footer aside menu dialog search".split())
UNREAD = frozenset("script style head template noscript iframe object svg canvas audio video button select textarea title map xmp noembed noframes math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd tr figcaption address caption".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",), "optgroup": ("optgroup", "option"),
               "body": ("head",), "tbody": ("tr", "tbody", "thead"), "thead": ("tr", "tbody", "thead"), "tfoot": ("tr", "tbody", "thead")}
SCOPES = frozenset("ul ol dl table select article section div main aside nav td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
notices notification alert popup modal overlay newsletter subscribe subscription signup paywall sidebar widget widgets menu submenu nav navbar
navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar comments comment commentlist disqus respond reply replies share
sharing social skip""".split())

OTHERS = frozenset("ad ads advert advertisement sponsored promo comment comments reply".split())  # an article that is one of these isn't the page's

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?][^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|/[^>]*(?:>|\Z)|
(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?P<close>>|\Z))""", re.S | re.X)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")


class _Open:
    """An open element: what it is, the blocks before it, the hashes below it, and whether the article lies in it."""

    __slots__ = ("tag", "first", "digest", "marked", "main", "holds", "block", "inner")

    def __init__(self, tag: str, first: int, marked: int, main: int, block: bool):
        self.tag, self.first, self.marked, self.main, self.block = tag, first, marked, main, block
        self.digest, self.holds, self.inner = [], False, False


def _marks(tag: str, attrs: str) -> tuple[int, int]:
    """(3 not read, 2 dropped by name, 1 dropped unless it holds the article, 0 neither; 2 article, 1 main, 0 neither)."""
    main = 2 if tag == "article" else 1 if tag == "main" else 0
    if tag in UNREAD or tag in DROPPED:
        return 3 if tag in UNREAD else 2, main
    marked = 1 if tag in ("form", "header") else 0
    if attrs and tag not in ("html", "body") and tag not in HEADINGS:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "role":
                marked = max(marked, 1 if value.strip() in ROLES else 0)
                main = max(main, 2 if value.strip() == "article" else 1 if value.strip() == "main" else 0)
            elif name in ("class", "id") and not MARKS.isdisjoint(said := _WORD.findall(value)):
                if tag == "article" and not OTHERS.isdisjoint(said):
                    return 2, 0
                marked = 1
            elif name == "itemprop" and value.strip() == "articlebody":
                main = 2
            elif name == "hidden":
                marked = 1
    return marked, main


class Page:
    """blocks: (text, in an article, in main, dropped); nodes: (hash, first block, behind the last, plain, in the article)."""

    def __init__(self, html: str):
        import xxhash

        self.hash = xxhash.xxh64_intdigest
        self.texts: list[str] = []
        self.spot: list[list[int]] = []  # per block: 2 in an article, 1 in main, 0 neither; dropped by a mark
        self.nodes: list[tuple[int, int, int, bool, int]] = []
        self.held: list[str] = []
        self.open = [_Open("", 0, 0, 0, True)]
        self.main = [0]    # the strongest article mark over the present place
        self.drop = [False]  # whether the present place lies in an element that is not read
        self.count: Counter[str] = Counter()  # open elements by name
        self._read(html)

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self.held)).split()) if self.held else ""
        self.held = []
        if text:
            self.texts.append(text)
            self.spot.append([self.main[-1], 0])
            self.open[-1].digest.append(text)

    def _close(self) -> None:
        node = self.open.pop()
        self.main.pop()
        self.drop.pop()
        self.count[node.tag] -= 1
        over = self.open[-1]
        if node.block and node.first < len(self.texts):
            digest = self.hash("\0".join([node.tag, *map(str, node.digest)]).encode("utf-8", "surrogatepass"))
            digest -= 1 << 63  # a long
            plain = node.tag in PLAIN and not node.inner
            if not (node.main or node.holds):  # what holds the article or its title is no template
                self.nodes.append((digest, node.first, len(self.texts), plain, self.main[-1]))
            over.digest.append(digest)
            over.inner = True
        else:
            over.digest += node.digest
        if node.marked == 2 or node.marked == 1 and not (node.holds or node.main):
            for at in range(node.first, len(self.texts)):
                self.spot[at][1] = 1
        if node.marked < 2:
            over.holds = over.holds or node.holds or node.main > 0 or node.tag == "h1"

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            cut = html.find("<", at)
            if cut < 0 or cut == size - 1:
                self._text(html[at:])
                break
            if cut > at:
                self._text(html[at:cut])
            m = _TAG.match(html, cut)
            if not m:
                self._text("<")
                at = cut + 1
                continue
            at = m.end()
            if m["start"]:
                at = self._start(m["start"].lower(), m["attrs"], html, at)
            elif m["end"]:
                self._end(m["end"].lower())
        self._flush()
        while len(self.open) > 1:
            self._close()

    def _text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self._close()
        if not self.drop[-1]:
            self.held.append(text)

    def _start(self, tag: str, attrs: str, html: str, at: int) -> int:
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close()
        if tag in BLOCK:
            self._flush()
            if tag in CLOSES_P:
                self._end_within(("p",))
            if tag in SAME_CLOSES:
                self._end_within(SAME_CLOSES[tag])
        elif tag in SPACED:
            self._text(" ")
        if tag in VOID:
            return at
        marked, main = _marks(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            return end.start() if end else len(html)  # its end tag is ignored
        if tag in BLOCK or marked or main:
            if tag not in BLOCK and 0 < marked + main < 3:
                self._flush()  # the mark begins here, inside a block
            self.open.append(_Open(tag, len(self.texts), marked, main, tag in BLOCK or bool(main)))
            self.main.append(max(self.main[-1], main))
            self.drop.append(self.drop[-1] or marked == 3)
            self.count[tag] += 1
        return at

    def _end_within(self, tags: tuple[str, ...]) -> None:
        """Close the nearest open element of `tags`, if no element that bounds it was opened since."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                self._flush()
                while len(self.open) > depth:
                    self._close()
                return
            if tag in SCOPES:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag in SPACED:
            self._text(" ")
        if self.count[tag]:
            self._flush()
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def kept_spots(self) -> list[int]:
        """Per block 1 if it may stay: not dropped, and in the strongest region that has such text."""
        live = [s[0] for s in self.spot if not s[1]]
        region = max(live, default=0)
        return [int(not s[1] and s[0] == region) for s in self.spot]


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; null where the url has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def read_pages(pages: DataFrame, keys: list[str], url: str, html: str) -> DataFrame:
    """keys, _host and body (hashes), blocks: array<struct<text, stays>>, nodes: array<struct<hash, a, b, plain, inside>>."""
    rows = pages.select(*keys, F.xxhash64(F.coalesce(host_of(F.col(url)), F.lit(""))).alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + (
        ", _host long, body long, blocks array<struct<text: string, stays: boolean>>, "
        "nodes array<struct<hash: long, a: int, b: int, plain: boolean, inside: boolean, marked: boolean>>")

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            body, blocks, nodes = [], [], []
            for value in piece.column("_html"):
                page = Page(value.as_py())
                stays, marked = page.kept_spots(), any(s[0] for s in page.spot)
                body.append(page.hash("\0".join(page.texts).encode("utf-8", "surrogatepass")) - (1 << 63))
                blocks.append([{"text": t, "stays": bool(s)} for t, s in zip(page.texts, stays)])
                nodes.append([{"hash": h, "a": a, "b": b, "plain": plain, "inside": bool(main), "marked": marked} for h, a, b, plain, main in page.nodes])
            return {**{k: piece.column(k) for k in keys}, "_host": piece.column("_host"), "body": body, "blocks": blocks, "nodes": nodes}
        return work

    return map_text(rows, "_html", ddl, make)


def templates(read: DataFrame, *, least: int = LEAST_PAGES, pages: int = SITE_PAGES, share: float = SITE_SHARE) -> DataFrame:
    """_host, hash of the subtrees on at least `least` different pages; usual: on `share` of the host's pages, and on `pages` at least."""
    seen = read.select("_host", "body", F.explode(F.array_distinct(F.transform("nodes", lambda n: n["hash"]))).alias("hash"))
    counts = seen.distinct().groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    sizes = read.select("_host", "body").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("of"))
    return counts.join(sizes, "_host").select("_host", "hash", ((F.col("n") >= pages) & (F.col("n") >= share * F.col("of"))).alias("usual"))


class Known:
    """Templates as sorted arrays: which (host, subtree) pairs are among them, by both values in full, and which of those are usual."""

    def __init__(self, hosts: np.ndarray, hashes: np.ndarray, usual: np.ndarray):
        order = np.lexsort((hosts, hashes))
        self.hosts, self.hashes, self.usual = hosts[order], hashes[order], usual[order]

    def find(self, hosts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, usual) per pair."""
        out, usual = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        todo = np.arange(len(hashes))
        while len(todo):  # a subtree's hosts stand side by side
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == hashes[todo]]
            same = self.hosts[at[todo]] == hosts[todo]
            out[todo[same]], usual[todo[same]] = True, self.usual[at[todo[same]]]
            todo = todo[~same]
            at[todo] += 1
        return out, usual


def _cut(batch: pa.RecordBatch, gone: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts of the blocks that stay, joined, and how many went: nodes `gone` cover the blocks first..last of their row."""
    blocks = batch.column("blocks")
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(blocks).to_numpy(zero_copy_only=False))))
    flat = blocks.flatten()
    stays, hit = flat.field("stays").to_numpy(zero_copy_only=False).copy(), np.zeros(len(flat), bool)
    for i in np.flatnonzero(gone).tolist():
        at = bounds[rows[i]]
        hit[at + first[i]:at + last[i]] = True
    stays &= ~hit
    counts = np.add.reduceat(np.append(stays, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if batch.num_rows else np.zeros(0, np.int64)
    lost = np.add.reduceat(np.append(hit, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if batch.num_rows else counts
    left = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))), flat.field("text").filter(pa.array(stays)))
    return pc.binary_join(left, "\n\n"), lost


def main_text(pages: DataFrame, *, keys: list[str] = ("page_id", "url"), url: str = "url", html: str = "html", least: int = LEAST_PAGES,
              site_pages: int = SITE_PAGES, share: float = SITE_SHARE) -> DataFrame:
    """keys, text, n_chars, n_template (blocks that a template covers) per page.

    Blocks are joined by two line feeds, white space inside one is one space, character references are decoded. Null or empty html, and
    a page without main text: empty. Pages without a host form a host. Equal pages are rows of their own. No pages: no rows. Unclosed
    elements end with what holds them, a page cut short with its last character; hidden elements count as notices. Other columns, whatever
    their names, are not read.

    Up to MAX_BROADCAST_ROWS templates (24 bytes each) travel to the tasks; more are joined, a hot one on SALTS keys.
    """
    spark, keys = pages.sparkSession, list(keys)
    read = kept(read_pages(pages, keys, url, html).withColumn("_row", F.monotonically_increasing_id()), "pages")
    found = kept(templates(read, least=least, pages=site_pages, share=share), "templates")
    kinds = ", ".join(f"`{k}` {read.schema[k].dataType.simpleString()}" for k in keys) + ", text string, n_template long"
    if found.count() <= MAX_BROADCAST_ROWS:
        table = found.toPandas()
        known = spark.sparkContext.broadcast(Known(*(table[c].to_numpy(t) for c, t in (("_host", np.int64), ("hash", np.int64), ("usual", bool)))))
        source = read.select(*keys, "_host", "blocks", "nodes")
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        nodes = read.select("_row", "_host", F.posexplode("nodes").alias("at", "n")).withColumns(
            {"hash": F.col("n.hash"), "_salt": F.pmod("_row", F.lit(SALTS))})
        hits = nodes.join(salted, ["_host", "hash", "_salt"]).groupBy("_row").agg(F.collect_list(F.struct("at", "usual")).alias("hits"))
        known, source = None, read.join(hits, "_row", "left").select(*keys, "_host", "blocks", "nodes", "hits")  # a page's own subtrees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("nodes")
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            value = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("hash", "a", "b", "plain", "inside", "marked")}
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            if known is not None:
                template, usual = known.value.find(batch.column("_host").to_numpy()[rows], value["hash"])
            else:
                template, usual, first = np.zeros(len(rows), bool), np.zeros(len(rows), bool), np.cumsum(sizes) - sizes
                for i, own in enumerate(batch.column("hits").to_pylist()):
                    for h in own or ():
                        template[first[i] + h["at"]], usual[first[i] + h["at"]] = True, h["usual"]
            gone = template & ~(value["inside"] & value["plain"]) & (usual | (value["marked"] & ~value["inside"]))
            text, lost = _cut(batch, gone, rows, value["a"], value["b"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), text, pa.array(lost)], [*keys, "text", "n_template"])

    return source.mapInArrow(run, kinds).withColumn("n_chars", F.length("text").cast("long"))

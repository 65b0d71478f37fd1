"""Main text of web pages: per-host template removal by hashes of element subtrees, within the pages' structure.

A page is read as a stack of elements; end tags that fit nothing are ignored and open elements end with their parents,
so broken pages are read to their end. Every element's subtree is hashed (tags and text): menus, headers and footers,
whatever stands outside articles, and inside articles and main elements the CONTAINERS (paragraphs are copied between
pages). Spark counts on how many pages of one host with different main blocks a hash occurs, and subtrees found on at
least TEMPLATE_PAGES are deleted, wherever they stand. Counts are by (host, hash), never by host alone. An element that
holds a page's longest block, or half of an article's text, is never deleted, so copies of a page or of its body don't
delete each other.

Recurrence can't tell of what is on one page alone, such as reader comments. So elements that are never article text by
tag or role are left out as well, and those whose class or id has a word of WORDS outside articles; inside, only
containers with such a word as a whole class. If the page has an article or a main element, only their text counts.

Null and empty pages, and pages of markup alone, have the text ''. Null urls count as the host ''. Repeated rows give a
row each and count as one page. Empty tables give empty ones; other columns are not read. Character references are
decoded, white space in a block becomes one space, and blocks are joined by a space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64

from vanefold.llm.common import limit_batches, scratch, small, steps, written

TEMPLATE_PAGES = 3
#: Tags whose text is never article text, tags that hold raw text, tags that part blocks, and tags that are empty.
NEVER = frozenset("head title nav header footer aside form script style noscript template iframe svg math button select option textarea dialog menu object embed canvas audio video map fieldset label input".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hgroup search center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("div section ul ol dl table details address figure center search hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments respond disqus cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar skip".split()
)
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",  # a quote that never ends
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAME_PARTS = re.compile(r"[a-z]+")


def dropped(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is left out by its tag, role, class or id."""
    if tag in NEVER:
        return not (tag == "header" and in_main)
    if not attributes:
        return False
    low = attributes.lower()
    if tag not in ("html", "body", "main") and ("class" in low or "id" in low or "role" in low):
        for name, a, b, c in ATTRIBUTE.findall(low):
            value = a or b or c
            if name == "role" and value in ROLES:
                return True
            if in_main:
                if name == "class" and tag in CONTAINERS and not WORDS.isdisjoint(value.split()):
                    return True
            elif name in ("class", "id") and not WORDS.isdisjoint(NAME_PARTS.findall(value)):
                return True
    return "hidden" in low and re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", low) is not None


class Page:
    """The blocks of one page, and the hashes of the subtrees that its host's other pages are asked about."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, bool, list]] = []  # text, in main, open elements; without what rules leave out
        self.text: list[str] = []
        self.elements: list[list] = []  # hash, may not be deleted, characters inside
        stack: list[tuple[str, bool, bool, list | None]] = []  # tag, left out, in main, element
        at, n = 0, len(source)
        out = main = False
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.text.append(source[at:])
                break
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            closes, name, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
            if name is None:
                continue
            tag = name.lower()
            if not closes:
                if tag == "br" or tag == "hr" or tag == "wbr":
                    if tag != "wbr":
                        self.text.append(" ")
                    continue
                if tag in VOID:
                    continue
                drop = dropped(tag, attributes, main)
                if tag not in BLOCKS and not drop:
                    continue
                self._flush(stack)
                ends = ("p",) if tag in BLOCKS else ()
                ends = IMPLIED.get(tag, ends)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] not in ("p", "li", "td", "th", "dt", "dd", "tr"):
                        break
                out, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else n
                    continue
                if not attributes.endswith("/"):
                    main = main or tag in MAIN
                    out = out or drop
                    element = None
                    if drop or (tag in CONTAINERS if main else tag not in ("html", "body")):
                        element = [xxh3_64(tag.encode()), False, 0]
                        self.elements.append(element)
                    stack.append((tag, out, main, element))
            else:
                if tag not in BLOCKS and not any(s[0] == tag for s in stack):
                    continue
                self._flush(stack)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                out, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        self._flush(stack)

    def _flush(self, stack: list) -> None:
        if not self.text:
            return
        raw = "".join(self.text)
        self.text = []
        made = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if made:
            around = [s[3] for s in stack if s[3] is not None]
            tag, out, main, _ = stack[-1] if stack else ("", False, False, None)
            told = b"\0" + tag.encode() + b"\0" + made.encode("utf-8", "surrogatepass")
            for e in around:
                e[2] += len(made)
                e[0].update(told)
            if not out:
                self.blocks.append((made, main, around))

    def found(self) -> tuple[list[str], list[list[int]], list[int], int]:
        """(blocks, hashes of the subtrees around each that may be deleted, hashes of all subtrees with text, hash of the longest block)."""
        signed = lambda e: (e[0].intdigest() & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        inside = [b for b in self.blocks if b[1]]
        blocks = inside or self.blocks
        longest = max(blocks, key=lambda b: len(b[0]), default=("", False, []))
        for e in longest[2]:
            e[1] = True
        if inside:
            half = sum(len(b[0]) for b in inside) / 2
            for _, _, around in inside:
                for e in around:
                    e[1] = e[1] or e[2] >= half
        every = list(dict.fromkeys(signed(e) for e in self.elements if e[2] and not e[1]))
        return [b[0] for b in blocks], [[signed(e) for e in b[2] if not e[1]] for b in blocks], every, xxh3_64(longest[0].encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


SUBTREES = "page long, host string, main_key long, hash long, around boolean"
TEXTS = "page_id long, url string, page long, blocks array<string>, around array<array<bigint>>"


def _clean(pages: DataFrame) -> DataFrame:
    """page_id, url, html and page, a hash that names the row (repeated rows have one)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return own.withColumn("page", F.xxhash64("page_id", "url", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(page, host, main_key, hash, around) of every subtree that may be deleted; around: whether some block of the text lies in it."""
    limit_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html"):
            rows = []
            for page, url, source in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                _, around, every, key = Page(source).found()
                held = set().union(*around)
                rows += [(page, host_of(url), key, h, h in held) for h in every]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SUBTREES.split(", ")])

    return _clean(pages).mapInArrow(run, SUBTREES)


def templates(rows: DataFrame, template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, hash, n_pages) of the subtrees on that many pages of a host with different main blocks."""
    # distinct keys first, so that no group of copies counts twice and no host meets in one task
    each = rows.groupBy("host", "hash", "main_key").agg(F.lit(1).alias("one"))
    return each.groupBy("host", "hash").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= template_pages)


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's blocks, with the hashes of the subtrees around each."""
    limit_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html"):
            found = [Page(h).found() for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), b.column("page"), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int64())))],
                names=[x.split()[0] for x in TEXTS.split(", ")],
            )

    return _clean(pages).mapInArrow(run, TEXTS)


def main_text(pages: DataFrame, template_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_template): n_template counts the blocks that template removal alone deletes.

    Pages are parsed twice: for the counts, of which narrow rows are written, and for the texts, which stay where they
    are unless very many pages lose a block.
    """
    spark = pages.sparkSession
    with scratch(spark) as out:
        rows = written(subtrees(pages), spark)
        found = written(templates(rows, template_pages), spark).select("host", "hash")
        # what stands around no block of the text, such as a menu, is left out anyway
        gone = out(rows.filter("around").join(found, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("gone")))
    every = parsed(pages).join(small(gone, 50_000), "page", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    kept = F.filter("blocks", lambda b, i: ~F.arrays_overlap(F.element_at("around", i + 1), F.col("gone")))
    text = F.when(F.size("gone") == 0, F.array_join("blocks", " ")).otherwise(F.array_join(kept, " "))
    lost = F.when(F.size("gone") == 0, 0).otherwise(F.size("blocks") - F.size(kept))
    return every.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), lost.alias("n_template"))

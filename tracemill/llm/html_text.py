"""Main text of web pages, with the templates of each site removed.

A page is parsed to elements; each element gets a hash of its subtree (tag, class and text). Spark counts on how
many different pages of a host each hash occurs, copies of a page (same text) being one page. A subtree that
recurs on many pages of its host is template and is deleted, whatever its size, and with it what its tag or class
already names as menu, notice, form, comments and the like. What is left is the article: the text of the article
or main elements, or of the body where a page has none. Running text (paragraphs, headings, quotations, single
items and cells, words marked in them) inside an article is deleted for recurring only where most pages of the host
have it: a passage that many articles quote belongs to each of them; a whole list or table goes by its count. Outside
an article running text goes if it is also on a share of the host's pages; all else goes by the count of pages alone,
however large the host. An element that holds an article is never a template. What an element is called never removes
the only article of a page, nor its only text; inside an article paragraphs and headings have no such names, nor
have sections by their ids, nor what holds the title.

Cases: null or empty html gives an empty text; pages without a host in their url have no templates; unclosed tags,
comments and scripts run to the end; what is nested deeper than DEPTH is hashed with the element at that depth, menus and the like there still go;
repeated rows give a row each; an empty table gives an empty result; columns named text or n_chars are replaced,
others stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, packed, schema_of, slices, unpacked

#: A template is on so many pages of its host at least; running text outside an article also on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.05
#: Running text inside an article is template if it is on more than this share of the host's pages.
INSIDE_SHARE = 0.5
#: Templates that are broadcast at most (16 bytes each, about 100 MB as Python sets); beyond, they are joined.
BROADCAST_TEMPLATES = 500_000
HELD, SALTS = 200_000, 64
#: Elements open at a time at most.
DEPTH = 512

#: A whole tag without oddities; possessive throughout, so a failure costs no more than the tag's length.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>=`]++))?+)*+)\s*+/?>")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|[\s/]++")

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article.
DROPPED = frozenset("script style noscript template iframe head nav footer aside form button select option textarea input dialog svg canvas object embed audio video menu noembed noframes title".split())
#: Words of a class, id or role that name a part beside the article: alone, as the last of a compound
#: (site-footer) or, but for those that other things begin with too, as its first (comment-list).
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "disclaimer footer gdpr menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related "
    "reply replies respond responses share sharing sidebar sidebars social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
NOT_FIRST = frozenset("banner consent disclaimer modal notice notices promotion related reply respond responses share sharing social subscription".split())
WITH_RELATED = frozenset("articles bar buttons content icons items links list news posts stories".split())
#: First words of classes that tell how a page is laid out.
LAYOUT = frozenset("has hide is js no not on show toggle with without".split())
#: Never named away; an article only by one of the second.
WHOLE = frozenset("html body main".split())
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted reply sponsored".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt b i em strong span a u code figcaption tbody tr".split())
MAIN = frozenset(("article", "main"))
#: Inside an article never named away.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong code figcaption".split())
#: An id that names the readers' part even of a section inside an article.
READERS = frozenset("comment comments commentlist disqus respond".split())
#: An open element of the second group ends when one of the first starts.
_ENDS = [(BLOCKS - {"br"} - frozenset("body html td th tr li dd dt tbody thead tfoot".split()), frozenset("p")), (frozenset(["li"]), frozenset(["li"])), (frozenset(("dd", "dt")), frozenset(("dd", "dt"))), (frozenset(("td", "th", "tr", "tbody")), frozenset(("td", "th"))), (frozenset(("tr", "tbody")), frozenset(["tr"])), (frozenset(["option"]), frozenset(["option"]))]
_CLOSES = {t: frozenset().union(*(b for a, b in _ENDS if t in a)) for t in frozenset().union(*(a for a, _ in _ENDS))}
_HOLDS = frozenset("table ul ol dl button td th article main section div body html select".split())


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        if m[1]:
            v = m[2] or ""
            out.setdefault(m[1].lower(), unescape(v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v))
    return out


def _names_beside(token: str) -> bool:
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
    if not words or (len(words) > 1 and words[0] in LAYOUT):
        return False
    if words[-1] in BESIDE or (words[0] in BESIDE and words[0] not in NOT_FIRST):
        return True
    return len(words) > 1 and words[0] in ("related", "share", "social") and words[1] in WITH_RELATED


@lru_cache(20_000)
def nature(tag: str, raw: str, inside: bool = False) -> tuple[str, bool, bool, bool]:
    """(names, beside, soft, main) of a start tag: its class, id and role; whether it stands beside the article by what it
    is called; whether that is only so by a word, or by being a form, which may also go around all of a page; whether
    it says that it is the main part. Inside an article running text has no such names, and a section's id may be
    its subject."""
    found = attributes(raw) if raw else {}
    tokens = [t for k in ("class", "id", "role") for t in found.get(k, "").split()]
    hard = tag in DROPPED and tag != "form"
    soft = tag == "form"
    if tag == "article":
        hard = any(t.lower() in NO_ARTICLE for t in tokens)
    elif tag not in WHOLE and not (inside and tag in RUNNING):
        subject = found.get("id", "").split() if inside and tag == "section" else []
        soft = soft or any(_names_beside(t) and (t not in subject or t.lower() in READERS) for t in tokens)
    if tag not in ("html", "body") and (found.get("hidden", "false").lower() != "false" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)):
        hard = True
    names = " ".join(tokens).lower()
    return names, hard or soft, soft and not hard, not hard and not soft and (tag in MAIN or "main" in names.split())


class Element:
    __slots__ = ("tag", "beside", "soft", "main", "holds_main", "holds_whole", "holds_title", "parts", "hash", "size", "clear", "level", "under", "first", "last", "inside")

    def __init__(self, tag: str, raw: str, up: Element | None):
        self.inside = up is not None and (up.inside or up.main)  # in an article already
        names, beside, self.soft, self.main = nature(tag, raw, self.inside)
        self.tag = tag
        self.beside = beside or (tag == "header" and not self.inside)
        self.main &= not self.beside
        self.holds_main = self.main
        self.holds_whole = tag == "main"
        self.holds_title = tag == "h1"
        self.level = 0 if up is None else up.level + up.beside  # elements beside the article around it
        self.under = up is not None and (up.under or (up.beside and not up.soft))  # one of them is no mere word
        self.parts = [tag, names]
        self.hash = None
        self.size = self.clear = 0  # lines of text, and those in no element beside the article

    @property
    def key(self) -> int:
        """What its copies on other pages have in common; running text of articles is counted apart."""
        return self.hash ^ 1 if self.kind == 2 else self.hash

    @property
    def kind(self) -> int:
        """0, or for running text 1 outside an article and 2 inside."""
        return 0 if self.tag not in TEXT else 2 if self.inside else 1


def markup(html: str, skip: list[int]):
    """(start, end, closing, tag, attributes) of each tag in order, tag being "" for comments and declarations.
    Each character is looked at a fixed number of times: what does not end runs to the end of the page. The caller
    may have it go on from ``skip[0]``."""
    at = 0
    while (k := html.find("<", max(at, skip[0]))) >= 0:
        if m := _PLAIN.match(html, k):
            at = m.end()
            yield k, at, m[1] == "/", m[2].lower(), m[3]
        elif m := _START.match(html, k):
            at = m.end()
            while (a := _ATTRIBUTE.match(html, at)) and a.end() > at:
                at = a.end()
            raw, at = html[m.end() : at], html.find(">", at) + 1 or len(html)
            yield k, at, m[1] == "/", m[2].lower(), raw
        elif html.startswith("<!--", k):
            at = html.find("-->", k + 4) + 3
            at = at if at > 2 else len(html)
            yield k, at, False, "", ""
        elif html[k + 1 : k + 2] in ("!", "?", "/") and html[k + 1 : k + 2]:
            at = html.find(">", k) + 1 or len(html)
            yield k, at, False, "", ""
        else:
            at = k + 1  # a mere sign


def parse(html: str) -> tuple[list[Element], list[str | None]]:
    """Closed elements, and the page's text pieces in order; None where a block begins or ends. An element's
    pieces are first to last (exclusive)."""
    root = Element("#page", "", None)
    root.first = 0
    stack, done, pieces, at, skip = [root], [], [], 0, [0]
    unopened: dict[str, int] = {}  # tags beyond DEPTH
    deep: list = []  # of these, what stands beside the article: tag, how often it is open, first piece

    def text(raw: str) -> None:
        if raw:
            pieces.append(unescape(raw))
            line = " ".join(raw.split())
            if line:
                stack[-1].parts.append(line)
                stack[-1].size += 1
                stack[-1].clear += not deep

    def close() -> None:
        e = stack.pop()
        if e.tag in BLOCKS:
            pieces.append(None)
        e.last = len(pieces)
        e.hash = int.from_bytes(blake2b("\x1f".join(e.parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        up = stack[-1]
        up.parts.append(str(e.hash))
        up.size += e.size
        if e.beside and e.soft and e.inside and e.holds_title:
            e.beside = False  # the article's own title stands in it
        up.clear += 0 if e.beside else e.clear
        up.holds_main |= e.holds_main
        up.holds_whole |= e.holds_whole
        up.holds_title |= e.holds_title
        done.append(e)

    def set_apart() -> None:
        e = Element("nav", "", stack[-1])
        e.first, e.last, e.hash = deep[2], len(pieces), 0
        done.append(e)
        deep.clear()

    for start, end, closing, tag, raw in markup(html, skip):
        text(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if unopened.get(tag):
                unopened[tag] -= 1
                if tag in BLOCKS:
                    pieces.append(None)
                if deep and deep[0] == tag:
                    deep[1] -= 1
                    if not deep[1]:
                        set_apart()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in _HOLDS and tag not in BLOCKS:
                    break  # an end tag of inline text does not close the block around it
            continue
        if ends := _CLOSES.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                elif stack[k].tag in _HOLDS:
                    break
        if tag in BLOCKS:
            pieces.append(None)
        if tag in VOID:
            stack[-1].parts.append(tag)
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = skip[0] = (html.find(">", found.start()) + 1 or len(html)) if found else len(html)
            stack[-1].parts.append(f"{tag} {nature(tag, raw)[0]}")
            continue
        if len(stack) >= DEPTH:
            unopened[tag] = unopened.get(tag, 0) + 1
            if deep:
                deep[1] += tag == deep[0]
            elif nature(tag, raw, stack[-1].inside or stack[-1].main)[1]:
                deep += [tag, 1, len(pieces)]
            continue
        e = Element(tag, raw, stack[-1])
        e.first = len(pieces)
        stack.append(e)
        if html[end - 2 : end - 1] == "/" and tag in ("svg", "path", "use"):
            close()
    text(html[at:])
    if deep:
        set_apart()
    while len(stack) > 1:
        close()
    root.last = len(pieces)
    return [*done, root], pieces


def templates_of(elements: list[Element]) -> dict[int, int]:
    """Keys of the elements that may be template, and their kinds."""
    return {e.key: e.kind for e in elements[:-1] if e.size and e.tag not in WHOLE and not e.holds_main}


def named_away(elements: list[Element]) -> list[Element]:
    """The elements that go by what they are called: all that stand beside the article, but for those around the only
    article or, where a page has none, around its only text."""
    beside = [e for e in elements if e.beside and not e.holds_whole]
    if any(e.main and not e.level and e.size for e in elements):
        return beside
    bare = not elements[-1].clear  # no text but in elements beside the article
    beside = [e for e in beside if not (e.soft and not e.under and e.holds_main and (bare or e.tag == "form"))]
    if not bare or any(e.main and e.size and not e.under for e in elements):
        return beside
    around = [e for e in beside if e.soft and not e.under and e.clear]
    if not around:
        return beside
    level = min(e.level for e in around)
    spans = [(e.first, e.last) for e in around if e.level == level]
    spared, k = [], 0
    spans.sort()
    firsts = [a for a, _ in spans]
    for e in beside:  # those just found, and what is around one of them
        k = bisect_left(firsts, e.first)
        if e.soft and e.level <= level and k < len(spans) and spans[k][1] <= e.last:
            spared.append(id(e))
    spared = frozenset(spared)
    return [e for e in beside if id(e) not in spared]


def article(elements: list[Element], pieces: list[str | None], known: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a parsed page: blocks joined by one line feed."""
    gone = bytearray(len(pieces))
    for e in named_away(elements):
        gone[e.first : e.last] = b"\1" * (e.last - e.first)
    for e in elements[:-1] if known else ():
        if e.size and e.key in known and e.tag not in WHOLE and not e.holds_main:
            gone[e.first : e.last] = b"\1" * (e.last - e.first)
    mains = [e for e in elements if e.main and not e.inside and any(not gone[k] and pieces[k] and not pieces[k].isspace() for k in range(e.first, e.last))]
    if mains:
        kept = bytearray(len(pieces))
        for e in mains:
            kept[e.first : e.last] = b"\1" * (e.last - e.first)
    else:
        kept = b"\1" * len(pieces)
    blocks, now = [], []
    for k, p in enumerate([*pieces, None]):
        if p is None:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now = []
        elif kept[k] and not gone[k]:
            now.append(p)
    return "\n".join(blocks)


def extract(html: str | None, known: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text, ``known`` being the template hashes of the page's host."""
    return article(*parse(html), known) if html else ""


def host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees on at least ``min_pages`` different pages of their host; those of running text
    are also on ``min_share`` of its pages, in an article on more than INSIDE_SHARE of them."""

    def subtrees(batches):
        seen: set = set()
        for b in slices(batches):
            hosts, hashes, running, ids = [], [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                elements, pieces = parse(t)
                page = int.from_bytes(blake2b(article(elements, pieces).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                found = {None: 0} if (h, page) not in seen else {}
                if len(seen) < HELD:
                    seen.add((h, page))
                found |= templates_of(elements)
                hosts += [h] * len(found)
                hashes += found
                running += found.values()
                ids += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(running, pa.int32()), pa.array(ids, pa.int64())], names=["host", "hash", "running", "page"])

    rows = pages.select(host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("t")).where("host != ''")
    once = rows.mapInArrow(subtrees, "host string, hash long, running int, page long").distinct()
    counts = cut(once.groupBy("host", "hash", "running").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= min_pages)))
    share = F.col("n") / F.col("pages")
    enough = F.when(F.col("running") == 1, share >= min_share).when(F.col("running") == 2, share > INSIDE_SHARE).otherwise(True)
    totals = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    return counts.where("hash IS NOT NULL").join(totals, "host").where(enough).select("host", "hash")


def page_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_most: int = BROADCAST_TEMPLATES, **options) -> DataFrame:
    """``pages`` with text and n_chars instead of its html."""
    spark = pages.sparkSession
    found = cut(site_templates(pages, url_col, html_col, **options))
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = packed(pages, kept, _host=host(url_col), _html=F.col(html_col))
    if found.count() <= broadcast_most:
        by_host: dict[str, set[int]] = {}
        for r in found.toArrow().to_pylist():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = spark.sparkContext.broadcast(by_host)
        rows = rows.withColumn("_known", F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        per_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("hash").alias("_known")).withColumn("_salt", salt)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int")).join(per_host, ["_host", "_salt"], "left").drop("_salt")

    def texts(batches):
        for b in slices(batches):
            known = b.column("_known").to_pylist()
            if shared is not None:
                known = [shared.value.get(h) for h in b.column("_host").to_pylist()]
            out = [extract(t, set(k or ())) for t, k in zip(b.column("_html").to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(out, pa.string())], names=["_doc", "text"])

    found = rows.select("_doc", "_host", "_html", "_known").mapInArrow(texts, schema_of(rows, ["_doc"], "text string"))
    return found.select(*unpacked(kept), "text", F.char_length("text").cast("long").alias("n_chars"))

"""Main-text extraction by page counts of element paths over the pages of a host, and by keyword lists.

The equivalence classes below are formed, but decide nothing: every member is judged alone (open, see README).

Tokens. A page is read as a sequence of block elements; a token is an element's path (tag names with classes), or a text
block's content in its path. The occurrence vector of a token is its count in each page of the host.

Method. Tokens of one host with the same occurrence vector form an equivalence class: the template wrote them
together. Vectors are compared by count, total and two sums of page-and-count hashes, so they combine map-side
and a host with a third of all pages is no special case. A class is valid if it occurs in at least half
of the host's pages; the class of once-a-page tokens is the template's skeleton. Valid classes nest by path: the
container of the main text is the deepest skeleton element (an article or main element before others) that still
holds ``HOLD`` of the text and of the main headings that are left after menus and the like, over all pages. Template text, that is content blocks found in ``CONSTANT`` of the pages and in ``ENOUGH`` pages of different texts at least,
and slots that are mostly link text over the host are taken out; what remains in the container's slots is the main text.
Elements that are never main text by their meaning (navigation, forms, scripts, comments and so on: ``SKIP_TAGS``,
``SKIP_WORDS``, ``SKIP_ROLES``) are no slots at all. A page without its host's container is extracted from its own skeleton.

Text. Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed in page order. A block ends at every block element's start or end; inline elements and line breaks only part words
as written (a line break is a space).

Scale. Pages are parsed twice, each time alone in Arrow batches: once for the tokens, once to extract. Templates are one
narrow row per host (at most 1 / ``CONSTANT`` pages' worth of blocks); the join of pages and templates is left to
Spark, which measures the template side before it broadcasts and splits hot hosts otherwise.

Edge cases. Null or empty html gives the empty text; unclosed, misnested and cut-off tags are closed as they stand; a null
url is the host ''. Repeated rows count as pages of their own; an empty table gives an empty result; further columns are
ignored.
"""
from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HOLD, CONSTANT, ENOUGH, LINKS = 0.8, 0.8, 3, 0.7
MAIN_RANK = 1000
#: Elements whose content is no main text.
SKIP_TAGS = frozenset("head title script style noscript template nav header footer aside form button select option textarea "
                      "iframe object embed svg canvas menu dialog video audio map datalist".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a block that do not end it.
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math meter "
                        "nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Words of class and id names, and roles, that mark no main text.
SKIP_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo "
                       "promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets footer masthead "
                       "header comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr "
                       "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
                       "related recommended recommendations pagination pager toolbar search form skip tags copyright legal".split())
SKIP_STEMS = ("advert", "adsby", "sponsor", "comment", "cookie", "sidebar", "newsletter", "breadcrumb", "disqus")
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text themselves and are no containers of a main text; elements that name it.
LEAVES = HEADINGS | frozenset("p li pre blockquote dt dd figcaption caption address summary legend td th tr".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that a start tag closes: the open one, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}

TAG = re.compile(r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[([\s\S]*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


class Element:
    """An open block element: its path and whether its text counts."""

    __slots__ = ("tag", "path", "skip", "article")

    def __init__(self, tag: str, path: int, skip: bool, article: bool):
        self.tag, self.path, self.skip, self.article = tag, path, skip, article


def skipped(tag: str, attributes: dict, in_article: bool) -> bool:
    if tag in SKIP_TAGS and not (tag == "header" and in_article):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in SKIP_ROLES:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    names = (attributes.get("class") or "") + " " + (attributes.get("id") or "")
    if names == " " or in_article and tag == "header":
        return False
    words = [w.lower() for w in WORD.findall(names)]
    # an article's own header holds its headline
    return any((w in SKIP_WORDS or w.startswith(SKIP_STEMS)) and not (w == "header" and in_article) for w in words)


class Parser:
    """Splits a page into text blocks. Paths are hashes of tag names and classes, from the root down."""

    def __init__(self):
        import xxhash
        self.h = xxhash.xxh3_64_intdigest
        self.kinds: dict[tuple, tuple] = {}

    def blocks(self, page: str) -> tuple[list, list]:
        """(blocks, elements). A block: (text, letters in links, paths of its elements from the root, skipped, in an h1).
        An element: its path and tag; one entry per block element's start."""
        out, starts = [], []
        stack = [Element("", 0, False, False)]
        buffer: list[str] = []
        link = 0
        link_letters = 0

        def flush():
            nonlocal link_letters
            if buffer:
                text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
                if text:
                    out.append((text, link_letters, tuple(e.path for e in stack), stack[-1].skip, stack[-1].tag == "h1"))
                buffer.clear()
            link_letters = 0

        def write(text: str):
            nonlocal link_letters
            if text:
                buffer.append(text)
                if link:
                    link_letters += len(text.strip())

        def close(level: int):
            nonlocal link
            flush()
            link = 0
            del stack[level:]

        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            if m is None:
                write(page[at:])
                break
            write(page[at:m.start()])
            at = m.end()
            if m[1] is not None:
                write(entities.escape(m[1]))
                continue
            tag = m[3] or m[6]
            if tag is None:
                continue
            end, tag, raw = (m[2] or m[5]), tag.lower(), m[4] if m[3] else m[7]
            if tag in INLINE_TAGS:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "a":
                    link = 0 if end else 1
                continue
            if end:
                for level in range(len(stack) - 1, 0, -1):
                    if stack[level].tag == tag:
                        close(level)
                        break
                else:
                    flush()
                continue
            # a block start ends an open paragraph, and what its kind closes
            for level in range(len(stack) - 1, 0, -1):
                if stack[level].tag == "p":
                    close(level)
                    break
                if stack[level].tag not in HEADINGS:
                    break
            if tag in CLOSES:
                these, stop = CLOSES[tag]
                found = 0
                for level in range(len(stack) - 1, 0, -1):
                    if stack[level].tag in stop:
                        break
                    if stack[level].tag in these:
                        found = level
                if found:
                    close(found)
            flush()
            if tag in VOID_TAGS:
                continue
            top = stack[-1]
            key = (tag, raw, top.article)
            kind = self.kinds.get(key)
            if kind is None:
                attributes = {}
                for a in ATTRIBUTE.finditer(raw):
                    attributes[(a[1] or a[5]).lower()] = entities.unescape(a[2] or a[3] or a[4] or "")
                kind = (self.h(tag + "." + " ".join(sorted((attributes.get("class") or "").split()))), skipped(tag, attributes, top.article))
                if len(self.kinds) > 50_000:  # bounded: start again
                    self.kinds.clear()
                self.kinds[key] = kind
            path = self.h(f"{top.path}/{kind[0]}")
            starts.append((path, tag))
            stack.append(Element(tag, path, top.skip or kind[1], top.article or tag in ("article", "main")))
            if tag in RAW_TAGS and not raw.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, at)
                write(page[at:stop.start()])
                at = stop.end()
                close(len(stack) - 1)
        flush()
        return out, starts


def signed64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: kind 0: an element (path; depth: its rank as a container, -1 for none; heads: letters of main headings); 1: a text block (path and content); 2: a slot (path, letters of its text and links).
TOKENS = "host string, kind int, token long, page long, copy long, n int, depth int, letters long, links long, heads long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per page and distinct token."""

    def run(batches):
        parser = Parser()
        names = [c.split(" ")[0] for c in TOKENS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for host, page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                blocks, starts = parser.blocks(text.as_py())
                # a path's count, rank, letters and letters of main headings
                element: dict[int, list] = {0: [1, 0, 0, 0]}
                for p, tag in starts:
                    element.setdefault(p, [0, -1 if tag in LEAVES else MAIN_RANK * (tag in MAIN_TAGS), 0, 0])[0] += 1
                slot: dict[int, list] = {}
                constant: dict[int, int] = {}
                deep: dict[int, int] = {}
                for content, links, paths, skip, head in blocks:
                    if skip:
                        continue
                    for depth, p in enumerate(paths):
                        e = element[p]
                        deep[p] = depth
                        e[2] += len(content)
                        e[3] += len(content) * head
                    s = slot.setdefault(paths[-1], [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + 1, s[1] + len(content), s[2] + min(links, len(content))
                    key = parser.h(f"{paths[-1]}:{content}")
                    constant[key] = constant.get(key, 0) + 1
                rows = [(0, signed64(p), n, r if r < 0 else r + deep.get(p, 0), c, 0, h) for p, (n, r, c, h) in element.items()]
                rows += [(1, signed64(k), n, 0, 0, 0, 0) for k, n in constant.items()]
                rows += [(2, signed64(p), n, 0, c, x, 0) for p, (n, c, x) in slot.items()]
                # pages of one text have one copy hash
                copy = signed64(parser.h("\n".join(b[0] for b in blocks if not b[3])))
                for row in rows:
                    for c, v in zip(out, (host, row[0], row[1], page, copy, *row[2:])):
                        c.append(v)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return parts(pages).select("host", "page", "html").mapInArrow(run, TOKENS)


def parts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[^:/?#]*://([^/?#]*)", 1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
                        F.xxhash64("page_id", "url").alias("page"), html.alias("html"))


def templates(tokens: DataFrame) -> DataFrame:
    """(host, container, constant, menus): the deduced template of every host."""
    mark = F.xxhash64("page", "n")
    of_text = tokens.groupBy("host", "kind", "token", "copy").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v1"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("v2"), F.max("depth").alias("depth"), F.sum("letters").alias("letters"),
        F.sum("links").alias("links"), F.sum("heads").alias("heads"))
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2", "letters", "links", "heads")]
    seen = stored(of_text.groupBy("host", "kind", "token").agg(F.count("*").alias("texts"), F.max("depth").alias("depth"), *sums), "html-tokens")
    hosts = seen.filter("kind = 0 and token = 0").select("host", F.col("pages").alias("all_pages"), F.col("letters").alias("all_letters"), F.col("heads").alias("all_heads"))
    # equivalence classes of elements; the once-a-page classes in at least half of the pages are the skeleton
    element = seen.filter("kind = 0").join(hosts, "host").filter(2 * F.col("pages") >= F.col("all_pages"))
    classes = element.groupBy("host", "pages", "total", "v1", "v2").agg(F.collect_list(F.struct("depth", "letters", "heads", "token")).alias("members"))
    skeleton = (classes.filter(F.col("total") == F.col("pages")).select("host", F.explode("members").alias("m"))
                .join(hosts, "host").filter((F.col("m.depth") >= 0) & (F.col("m.letters") >= HOLD * F.col("all_letters"))
                        & (F.col("m.heads") >= HOLD * F.col("all_heads"))))
    container = skeleton.groupBy("host").agg(F.max(F.struct("m.depth", "m.letters", "m.token"))["token"].alias("container"))
    constant = (seen.filter("kind = 1").join(hosts, "host")
                .filter((F.col("pages") >= CONSTANT * F.col("all_pages")) & (F.col("texts") >= ENOUGH))
                .groupBy("host").agg(F.collect_list("token").alias("constant")))
    menus = (seen.filter((F.col("kind") == 2) & (F.col("links") > LINKS * F.col("letters")) & (F.col("texts") >= ENOUGH))
             .join(hosts, "host").filter(2 * F.col("pages") >= F.col("all_pages"))
             .groupBy("host").agg(F.collect_list("token").alias("menus")))
    return container.join(constant, "host", "left").join(menus, "host", "left")


RESULT = "page_id long, url string, text string, n_chars long, templated boolean"


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and whether the host's container was found in the page."""
    template = stored(templates(page_tokens(pages)), "html-templates")
    rows = parts(pages).join(template, "host", "left").select("page_id", "url", "html", "container", "constant", "menus")

    def run(batches):
        parser = Parser()
        for batch in batches:
            texts, sizes, found = [], [], []
            columns = [batch.column(i) for i in range(2, 6)]
            for html, container, constant, menus in zip(*columns):
                blocks, _ = parser.blocks(html.as_py())
                container = container.as_py()
                root = None if container is None else container % (1 << 64)
                gone = {t % (1 << 64) for t in constant.as_py() or ()}
                links = {t % (1 << 64) for t in menus.as_py() or ()}
                inside = [b for b in blocks if not b[3] and root in b[2]]
                found.append(bool(inside))
                if not inside:
                    inside = [b for b in blocks if not b[3]]
                kept = [b[0] for b in inside if b[2][-1] not in links and not (gone and parser.h(f"{b[2][-1]}:{b[0]}") in gone)]
                texts.append("\n".join(kept))
                sizes.append(len(texts[-1]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.bool_())],
                                  names=["page_id", "url", "text", "n_chars", "templated"])

    return rows.mapInArrow(run, RESULT)

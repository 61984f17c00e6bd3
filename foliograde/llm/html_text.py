"""Main text of web pages: named boilerplate goes, and so do subtrees that many pages of a host share.

A page is read into a list of nodes, each with its parent, so that depth costs no recursion.  Every block subtree has a
hash of its tags and words.  Spark counts on how many different pages of a host a subtree occurs; those on many pages
are its template and are deleted.  Paragraphs, list items and quotes go by themselves only if half of the host's pages
have them; headings and table cells only with a block around them.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograde.llm.common import saved

#: A subtree on so many different pages of a host is a template.  On fewer it is one from LEAST_PAGES and that share of
#: the host's pages on, and on a host of less than LEAST_PAGES pages if more than half of them have it.
MANY_PAGES, LEAST_PAGES, LEAST_SHARE = 20, 5, 0.2
#: The same for a paragraph or another block of text alone, at any number of pages.
TEXT_SHARE = 0.5
#: Most template subtrees that every executor gets (8 bytes each, and their hosts); more are joined.
BROADCAST_SUBTREES = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
DROPPED = frozenset(
    "head script style noscript template svg math iframe object embed applet canvas audio video map nav footer aside form "
    "button select option optgroup input textarea label fieldset datalist dialog menu title".split())
BLOCK = frozenset(
    "html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
    "tfoot tr td th blockquote pre figure figcaption address details summary hr br form fieldset center hgroup".split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead figcaption summary caption".split())
ALONE = frozenset("p blockquote pre li dd figcaption summary".split())
KEPT = frozenset(("html", "body", "main", "article"))
#: Start tags that end an open element of the first kind, up to one of the second.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - {"br", "html", "body"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|rail|menu|navbar|navigation|nav|"
    r"breadcrumbs?|comments?|commentlist|disqus|repl(?:y|ies)|respond|footer|header|masthead|topbar|social|share|sharing|related|recommended|"
    r"newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|pager|skip|search|copyright)(?:$|[\s_-])", re.I)
ROLES = re.compile(r"""\brole\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)\b""", re.I)
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
#: ``hidden`` as an attribute of its own, or a style that hides; what other attributes say does not count.
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|style\s*=\s*(?:"[^"]*display\s*:\s*none[^"]*"|'[^']*display\s*:\s*none[^']*'|[^\s"'>]*display:none))""", re.I)
QUOTED = re.compile(r"""(?<![^\s=])((?!style\b)[^\s="'>]+\s*=\s*)(?:"[^"]*"|'[^']*')""", re.I)
NAMES = re.compile(r"""(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|repl(?:y|ies))(?:$|[\s_-])", re.I)
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Page:
    """Nodes of a page: tag, attributes, parent and end; ``items`` holds texts and nodes in page order."""

    def __init__(self, source: str):
        self.tags, self.attributes, self.parents, self.ends = ["#root"], [""], [-1], [0]
        self.items: list[tuple[int, str | int]] = []  # (parent, text) or (parent, node)
        self._read(source)
        self._mark()

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.parents.append(stack[-1])
        self.ends.append(0)
        self.items.append((stack[-1], node))
        return node

    def _read(self, source: str) -> None:
        stack, open_tags, at, size = [0], {}, 0, len(source)

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                open_tags[self.tags[node]] -= 1
                self.ends[node] = len(self.tags)

        def close_nearest(tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
            if any(open_tags.get(tag) for tag in tags):
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[depth]] in tags:
                        close_to(depth)
                        return
                    if self.tags[stack[depth]] in limits:
                        return

        while at < size:
            found = MARKUP.search(source, at)
            if not found:
                self.items.append((stack[-1], source[at:]))
                break
            if found.start() > at:
                self.items.append((stack[-1], source[at:found.start()]))
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                if open_tags.get(tag):
                    close_nearest((tag,), ())
                continue
            if tag in ENDS_P and open_tags.get("p"):
                close_nearest(("p",), ("button", "td", "th", "table", "caption"))
            if tag in CLOSES:
                close_nearest(*CLOSES[tag])
            attributes = found[3] or ""
            node = self._open(tag, attributes, stack)
            if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "use"):
                self.ends[node] = len(self.tags)
            elif tag in RAW:
                self.ends[node] = len(self.tags)
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else size
            else:
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        while stack:
            self.ends[stack.pop()] = len(self.tags)

    def _mark(self) -> None:
        """Which nodes are named boilerplate, and which hold the article."""
        self.dropped = [False] * len(self.tags)
        self.inside = [False] * len(self.tags)  # of an article or main part
        mains = []
        for node in range(1, len(self.tags)):
            tag, attributes, parent = self.tags[node], self.attributes[node], self.parents[node]
            self.inside[node] = self.inside[parent]
            drop = self.dropped[parent] or tag in DROPPED or tag == "header" and not self.inside[parent]
            if attributes and not drop:
                names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
                named = COMMENTS if tag in KEPT else NAMED
                drop = bool(tag not in ("html", "body") and (names and named.search(names) or HIDDEN.search(QUOTED.sub(r"\1", attributes)) or tag not in KEPT and ROLES.search(attributes)))
            self.dropped[node] = drop
            if not drop and not self.inside[node] and (tag in ("article", "main") or attributes and MAIN_ROLE.search(attributes)):
                self.inside[node] = True
                mains.append(node)
        self.has_main = bool(mains)

    def subtrees(self) -> dict[int, int]:
        """Hash of every block subtree that could be a template; odd for blocks of text."""
        digests = [xxhash.xxh64() for _ in self.tags]
        order: list[list] = [[] for _ in self.tags]
        for parent, item in self.items:
            order[parent].append(item)
        hashes = [0] * len(self.tags)
        for node in range(len(self.tags) - 1, 0, -1):
            digest = digests[node]
            digest.update(self.tags[node])
            for item in order[node]:
                digest.update(hashes[item].to_bytes(8, "little") if isinstance(item, int) else " ".join(item.split()).encode("utf-8", "replace"))
            hashes[node] = digest.intdigest()
        return {
            node: (hashes[node] - (1 << 64 if hashes[node] >> 63 else 0)) & ~1 | (self.tags[node] in TEXT_BLOCK) for node in range(1, len(self.tags))
            if not self.dropped[node] and self.tags[node] in BLOCK and self.tags[node] not in KEPT and self.tags[node] not in VOID
            and self.inside[node] == self.has_main and (self.tags[node] not in TEXT_BLOCK or self.tags[node] in ALONE)
        }

    def text(self, template: frozenset[int]) -> str:
        gone = list(self.dropped)
        if template:
            for node, key in self.subtrees().items():
                gone[node] = gone[node] or key in template
            for node in range(1, len(gone)):
                gone[node] = gone[node] or gone[self.parents[node]]
        parts: list = []
        for parent, item in self.items:
            if isinstance(item, int):
                if self.tags[item] in BLOCK:
                    parts.append(" ")
            elif not gone[parent] and self.inside[parent] == self.has_main:
                parts.append((parent, item))
        return _joined(parts, self.tags, self.parents)


def _joined(parts: list, tags: list[str], parents: list[int]) -> str:
    """Texts put together; a change of block is white space, inline tags are nothing."""
    def block(node: int) -> int:
        while node > 0 and tags[node] not in BLOCK:
            node = parents[node]
        return node

    blocks: dict[int, int] = {}
    out, last = [], None
    for part in parts:
        if part == " ":
            out.append(" ")
            continue
        parent, text = part
        if parent not in blocks:
            blocks[parent] = block(parent)
        if blocks[parent] != last:
            out.append(" ")
            last = blocks[parent]
        out.append(text)
    return " ".join(entities.unescape("".join(out)).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _subtrees(sources: pa.Array) -> pa.Array:
    return pa.array([sorted(set(Page(source).subtrees().values())) if source else [] for source in sources.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.StringType())
def _texts(sources: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([Page(source).text(frozenset(template or ())) if source else "" for source, template in zip(sources.to_pylist(), templates.to_pylist())], pa.string())


def _texts_by(shared):
    """Texts by the templates of each host, which every executor has."""
    def texts(sources: pa.Array, hosts: pa.Array) -> pa.Array:
        of, none = shared.value, frozenset()
        return pa.array([Page(source).text(of.get(host, none)) if source else "" for source, host in zip(sources.to_pylist(), hosts.to_pylist())], pa.string())

    return F.arrow_udf(T.StringType())(texts)


def _each(pages: DataFrame) -> DataFrame:
    seen = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), _subtrees(F.coalesce("html", F.lit(""))).alias("subtrees"))
    return seen.select("host", "page", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "subtrees")).alias("subtree")).distinct()


def templates(pages: DataFrame) -> DataFrame:
    """The subtrees of each host that recur on many of its pages: host, template (a hash).

    Pages with equal html count once.
    """
    counts = saved(_each(pages).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("subtree").isNull() | (F.col("n") > 1)), "subtrees")
    totals = counts.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
    n, many = F.col("n"), F.col("pages")
    block = F.when(many < LEAST_PAGES, n * 2 > many).otherwise((n >= MANY_PAGES) | (n >= LEAST_PAGES) & (n >= many * LEAST_SHARE))
    text = (n >= LEAST_PAGES) & (n >= many * TEXT_SHARE)
    often = counts.where("subtree IS NOT NULL").join(F.broadcast(totals) if totals.count() <= BROADCAST_SUBTREES else totals, "host")
    return saved(often.where(F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, text).otherwise(block)).select("host", F.col("subtree").alias("template")), "templates")


def main_text(pages: DataFrame) -> DataFrame:
    """Text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html gives empty text; a null url belongs to the host without a name; rows that are repeated are
    worked out each; other columns are not read.  White space of any kind becomes one space.
    """
    found = templates(pages)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if found.count() <= BROADCAST_SUBTREES:
        of: dict[str, set[int]] = {}
        for host, template in zip(*(column.to_pylist() for column in found.toArrow().columns)):  # BROADCAST_SUBTREES rows at most
            of.setdefault(host, set()).add(template)
        text = _texts_by(pages.sparkSession.sparkContext.broadcast({host: frozenset(x) for host, x in of.items()}))(html, F.col("host"))
    else:
        own = _each(pages).withColumnRenamed("subtree", "template").join(found, ["host", "template"]).groupBy("host", "page").agg(F.collect_set("template").alias("templates"))
        rows = rows.withColumn("page", F.xxhash64("html")).join(own, ["host", "page"], "left")
        text = _texts(html, F.coalesce("templates", F.array().cast("array<bigint>")))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages by consensus of a host's pages.

1. Each page is parsed once; its containers are scored by the text of their
   blocks, links counting against them, and the best container's generalised
   path (tags and classes from the root, numbers made equal) is the page's vote.
2. Spark adds up the votes for each path of each host, combined before the
   shuffle, and keeps the paths which hold a twentieth of the host's votes (20
   at most, by counting), best first.
3. Each page whose own best container is no winner is extracted again from its
   host's first winning path that holds a fair part of the page's text and more
   than a part of that container, together with what its own container has under
   the same parent; a page without one uses its own.

Elements with telling class names are left out, and so are blocks outside an
article that are rows of links.  Inside an article a name must be
made up of such words altogether: related-posts goes, related-work stays.  A page
is parsed once for its vote and once for its text: parsing is most of the work,
but keeping the blocks in between would write the corpus out once more.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scratch import Batches, lean, packed, sliced, table, with_row

#: Share of a host's votes that makes a path a winner.
SHARE = 0.05
#: Part of the page's own best text that a winning path must hold.
FAIR = 0.5
#: So many links, with next to nothing between them, make a block outside an article a menu.
MENU = 3

# Kinds of tags.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template", "svg", "object", "canvas", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "head", "frameset"}
CONTAINER = {"html", "body", "div", "article", "section", "main", "td", "center", "blockquote", "header", "details", "hgroup"}
BLOCK = CONTAINER | CHROME | set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table caption thead tbody tfoot tr th figure figcaption address summary hr br".split()
)
CLOSES_P = BLOCK - {"br", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
# The tags that a new one ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Parts of class names and ids of what surrounds an article, and roles.
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adsbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert warning popup modal overlay sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist disqus reply replies respond responses share sharing social related recommended newsletter subscribe subscription signup login "
    "search pagination pager widget widgets toolbar skip copyright".split()
)
# Words that say nothing of their own beside those, in class names inside an article.
PLAIN_WORDS = set(
    "area article articles bar block body bottom box btn button buttons c container content count form foot group head header heading icon icons "
    "inner item items js left link links list main module more of post posts right row section slot stories story thread title top unit wrap "
    "wrapper wrapping".split()
)
# First parts of class names that say what stands next to an element, not what it is.
BESIDE = {"has", "with", "no", "without", "is", "js", "layout"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/\"']|$)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NUMBER = re.compile(r"\d+")
PART = re.compile(r"[a-z]+")


class Page:
    """Blocks of clean text and the containers above them."""

    def __init__(self, source: str, by_class: bool = True):
        self.by_class = by_class
        #: (path, parent, whether the element is an article or main)
        self.containers: list[tuple[int, int, bool]] = []
        #: (text, characters in links, container)
        self.blocks: list[tuple[str, int, int]] = []
        self._parse(source)

    @staticmethod
    def _attributes(raw: str) -> dict[str, str]:
        found = {}
        for name, value in ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), references.unescape(value.strip("\"'")))
        return found

    def _is_chrome(self, tag: str, a: dict[str, str], inside_article: bool) -> bool:
        if tag in CHROME or (tag in ("header", "noscript") and not inside_article):
            return True
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
            return True
        if a.get("role", "").lower() in CHROME_ROLES:
            return True
        if tag in ("html", "body", "article", "main") or not self.by_class:
            return False
        for name in (*a.get("class", "").lower().split(), *a.get("id", "").lower().split()):
            parts = PART.findall(name)
            if parts and parts[0] in BESIDE or CHROME_WORDS.isdisjoint(parts):
                if not inside_article and parts in (["header"], ["site", "header"], ["page", "header"]):
                    return True
                continue
            if not inside_article or all(x in CHROME_WORDS or x in PLAIN_WORDS for x in parts):
                return True
        return False

    def _parse(self, source: str) -> None:
        containers, blocks, search = self.containers, self.blocks, TAG.search
        containers.append((0, -1, False))
        # open elements that matter: (tag, path, chrome, container, inside an article)
        stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]
        open_tags: Counter[str] = Counter()
        text: list[str] = []
        linked = links = depth_a = at = 0

        def flush() -> None:
            nonlocal linked, links
            if text:
                joined = "".join(text)
                if "&" in joined:
                    joined = references.unescape(joined)
                clean = " ".join(joined.split())
                menu = links >= MENU and not stack[-1][4] and 10 * linked >= 9 * sum(map(str.isalnum, clean))
                if clean and not menu:
                    blocks.append((clean, linked, stack[-1][3]))
                text.clear()
            linked = links = 0

        def push(*element) -> None:
            stack.append(element)
            open_tags[element[0]] += 1

        def pop_to(n: int) -> None:
            for element in stack[n:]:
                open_tags[element[0]] -= 1
            del stack[n:]

        def take(piece: str) -> None:
            nonlocal linked
            if piece and not stack[-1][2]:
                text.append(piece)
                if depth_a:
                    linked += len(piece)

        while (m := search(source, at)) is not None:
            take(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    take(references.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if m[1]:  # an end tag
                if tag == "a":
                    depth_a = 0
                elif open_tags[tag]:
                    if tag in BLOCK:
                        flush()
                    n = len(stack) - 1
                    while stack[n][0] != tag:
                        n -= 1
                    pop_to(n)
                elif tag in BLOCK:
                    flush()
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                if not m[3].endswith("/"):
                    at = end.end() if end else len(source)
                continue
            if tag == "a":
                depth_a = 1
                links += not stack[-1][2]
                continue
            if tag in VOID:
                if tag in BLOCK:
                    flush()
                continue
            attributes = self._attributes(m[3]) if m[3] and not m[3].isspace() else {}
            _, path, chrome, container, inside = stack[-1]
            if tag not in BLOCK:
                if not chrome and attributes and not m[3].endswith("/") and self._is_chrome(tag, attributes, inside):
                    push(tag, path, True, container, inside)
                elif open_tags[tag]:
                    push(tag, path, chrome, container, inside)  # so that its end tag does not end the outer one
                continue
            flush()
            if tag in CLOSES_P and open_tags["p"]:
                n = len(stack) - 1
                while stack[n][0] not in ("p", "td", "th", "button") and n:
                    n -= 1
                if stack[n][0] == "p":
                    pop_to(n)
            if tag in ENDS:
                ended, stop = ENDS[tag]
                n = len(stack) - 1
                low = None
                while n and stack[n][0] not in stop:
                    low = n if stack[n][0] in ended else low
                    n -= 1
                if low is not None:
                    pop_to(low)
            _, path, chrome, container, inside = stack[-1]
            chrome = chrome or self._is_chrome(tag, attributes, inside)
            inside = inside or tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
            if tag in CONTAINER and not chrome:
                name = tag + "".join("." + x for x in sorted({NUMBER.sub("N", c) for c in attributes.get("class", "").lower().split()}))
                path = xxhash.xxh3_64_intdigest(name, path & 0xFFFFFFFFFFFFFFFF)
                containers.append((path, container, inside and not stack[-1][4]))
                container = len(containers) - 1
            push(tag, path, chrome, container, inside)
        take(source[at:])
        flush()

    def sizes(self) -> list[float]:
        """Of each container, the weight of all blocks below it."""
        total = [0.0] * len(self.containers)
        for text, linked, container in self.blocks:
            total[container] += len(text) - min(linked, len(text))
        for n in range(len(total) - 1, 0, -1):
            total[self.containers[n][1]] += total[n]
        return total

    def best(self) -> int | None:
        """The path that holds the page's main text, 0 being the page itself; None without text."""
        if not self.blocks:
            return None
        total = self.sizes()
        by_path: dict[int, float] = {}
        for n, (path, parent, main) in enumerate(self.containers):
            if main:
                by_path[path] = by_path.get(path, 0) + total[n]
        if by_path:
            path = max(by_path, key=by_path.get)
            if by_path[path] >= 0.4 * total[0]:
                return path
        own = [0.0] * len(self.containers)
        for text, linked, container in self.blocks:
            own[container] += len(text) - min(linked, len(text))
        here = max(range(len(own)), key=lambda n: (own[n], -n))
        # go up as long as that gathers blocks which are not mostly links, however few they are
        plain = [0] * len(self.containers)
        for text, linked, container in self.blocks:
            plain[container] += 2 * linked < len(text)
        for n in range(len(plain) - 1, 0, -1):
            plain[self.containers[n][1]] += plain[n]
        up = self.containers[here][1]
        while up >= 0:
            if plain[up] > plain[here]:
                here = up
            up = self.containers[up][1]
        return self.containers[here][0]

    def inside(self, path: int) -> list[int]:
        """Numbers of the blocks below the containers with this path, in page order."""
        inside = [False] * len(self.containers)
        for n, (own, parent, _) in enumerate(self.containers):
            inside[n] = own == path or (parent >= 0 and inside[parent])
        return [n for n, (_, _, container) in enumerate(self.blocks) if inside[container]]

    def beside(self, path: int) -> list[int]:
        """Numbers of the blocks below the parents of the containers with this path."""
        parents = {parent for own, parent, _ in self.containers if own == path}
        below = [False] * len(self.containers)
        for n, (_, parent, _) in enumerate(self.containers):
            below[n] = n in parents or (parent >= 0 and below[parent])
        return [n for n, (_, _, container) in enumerate(self.blocks) if below[container]]

    def text_of(self, path: int) -> str:
        """Blocks below the containers with this path, in page order."""
        return "\n".join(self.blocks[n][0] for n in self.inside(path))


def parsed(source: str) -> Page:
    """The page; where class names and ids would leave nothing of it, without their help."""
    page = Page(source)
    return page if page.blocks else Page(source, by_class=False)


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _vote(batches: Batches) -> Batches:
    for batch in sliced(batches, "html"):
        hosts, paths, sizes = [], [], []
        for host, source in zip(batch.column("host"), batch.column("html"), strict=True):
            page = parsed(source.as_py())
            path = page.best()
            if path is not None:
                hosts.append(host.as_py())
                paths.append(_signed(path))
                sizes.append(len(page.text_of(path)))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(sizes, pa.int64())], ["host", "path", "size"])


def main_text(source: str, winners: list[int] | None = None) -> str:
    """Main text of one page, from the first fair winning path or the page's own best container.

    The page's own path stays where it is a winner itself, and where a winning
    path lies wholly inside it and so could only take text away.  What it has
    under the winning path's parent stays in any case.
    """
    page = parsed(source)
    own = page.best()
    if own is None:
        return ""
    winning = [path & 0xFFFFFFFFFFFFFFFF for path in winners or ()]
    held = set(page.inside(own))
    blocks = held
    if own not in winning:
        size = sum(len(page.blocks[n][0]) for n in held)
        for path in winning:
            other = set(page.inside(path))
            if not held.issuperset(other) and sum(len(page.blocks[n][0]) for n in other) >= FAIR * size:
                blocks = other | held.intersection(page.beside(path))
                break
    return "\n".join(page.blocks[n][0] for n in sorted(blocks))


def _extract(batches: Batches) -> Batches:
    for batch in sliced(batches, "_html"):
        pairs = zip(batch.column("_html"), batch.column("winners"), strict=True)
        texts = [main_text(source.as_py(), winners.as_py()) for source, winners in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def host_of(url):
    """Lower-case host of a URL; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(host != "", host)


def consensus(pages: DataFrame) -> DataFrame:
    """(host, winners): the winning paths of each host, best first.  ``pages(host, html)``."""
    votes = pages.where("host is not null").mapInArrow(lean(_vote), "host string, path long, size long")
    counted = table(votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "host-paths")
    hosts = counted.groupBy("host").agg(F.sum("n").alias("all"))
    ranked = counted.join(hosts, "host").where(F.col("n") >= SHARE * F.col("all"))
    order = F.sort_array(F.collect_list(F.struct("n", "size", "path")), asc=False)
    return ranked.groupBy("host").agg(order.alias("o")).select("host", F.transform("o", lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` with a column text: the main text of each page.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and reader comments are left out; character references are decoded, white
    space inside a block becomes one space, blocks are joined by one newline.
    A null or empty html, or one without text, gives an empty text.  A url that
    is null or has no host gets no consensus and is extracted by itself.
    Repeated rows count and come back each time.  A column called text is
    replaced, others come back as they are.
    """
    source = F.coalesce(pages["html"], F.lit(""))
    winners = table(consensus(pages.select(host_of(pages["url"]).alias("host"), source.alias("html"))), "host-winners")
    rest = [c for c in pages.columns if c != "text"]
    own = pages.select(packed(pages, rest), host_of(pages["url"]).alias("_host"), source.alias("_html"))
    joined = own.join(winners, own["_host"] == winners["host"], "left").select("row", "_html", "winners")
    out = joined.mapInArrow(lean(_extract), with_row(joined, text=StringType()))
    column = lambda c: F.col("text") if c == "text" else F.col("row")[c].alias(c)
    return out.select(*(column(c) for c in dict.fromkeys([*pages.columns, "text"])))

"""Main text of web pages by a style tree per site.

The DOM trees of all pages of a host are merged: nodes with the same path of tags, classes and ids are one node of the site's
tree. Its importance joins two entropies over the host's pages, that of the presentation (sequences of child elements) and
that of the content (texts below it): what looks and reads the same everywhere is part of the template. Copies of a page count
once. A branch is removed from every page if its node and all nodes below it in the site's tree are of low importance, with the
element kinds that never hold an article; what is left of the page's article, or of the whole page if none is marked, is its text.
"""

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from logloom.llm import hash_arrays
from logloom.session import shared_folder

GAMMA = 0.9
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 4
# fixed values: HTML elements by kind
RAW = frozenset("script style noscript template iframe svg head annotation annotation-xml".split())
FOREIGN = frozenset("svg annotation annotation-xml".split())  # a slash at the end of their start tag closes them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr object "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced maction msub "
    "msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table article section div body main nav aside footer header form select".split())
TEMPLATE_TAGS = frozenset("nav header footer aside form button select textarea input dialog menu fieldset".split())
TEMPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# fixed values: words in classes and ids of page parts other than the article
TEMPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer "
    "header masthead breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "widget toolbar skip copyright".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>", re.S
)
_ENCLOSED = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\b[^>]*>|\Z)"
    r"|(/?)(noscript|template|iframe|svg|annotation-xml|annotation)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)", re.S | re.I
)
_HEAD_END = re.compile(r"</head\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _enclosed(markup: str) -> dict[int, int]:
    """Start of every RAW element that may hold its like, and the end of its own end tag; those without one are left out."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for match in _ENCLOSED.finditer(markup):
        if match[2] is None:
            continue
        own = opened.setdefault(match[2].lower(), [])
        if not match[1]:
            if not (match[2].lower() in FOREIGN and match[3].endswith("/")):
                own.append(match.start())
        elif own:
            ends[own.pop()] = match.end()
    return ends


class Page:
    """The tree of one page: parallel lists by node, and the blocks of text in page order."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.path = ["#root"], [-1], [0]
        self.template, self.styled, self.main = [False], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self._mixed: set[int] | None = None
        self._parse(markup)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        style, words, template, main = tag, "", tag in TEMPLATE_TAGS, int(tag == "article") * 2 + int(tag == "main")
        if attributes.strip():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id"):
                    words += " " + value
                    style += f" {name}={re.sub('[0-9]+', '0', value)}"
                elif name == "role":
                    template = template or value in TEMPLATE_ROLES
                    main = main or int(value == "main")
                elif name == "itemprop":
                    main = main or 2 * int(value == "articlebody")
                elif name == "hidden" or value == "true":
                    template = True
            template = template or not TEMPLATE_WORDS.isdisjoint(_WORD.findall(words))
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(xxhash.xxh64_intdigest(style, self.path[parent]))
        self.template.append(template)
        self.styled.append(bool(words) or template)
        self.main.append(main)
        return len(self.tag) - 1

    def _parse(self, markup: str) -> None:
        stack, text, at = [0], [], 0
        block = 0
        enclosed: dict[int, int] | None = None

        def flush() -> None:
            if text:
                whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                if whole:
                    self.blocks.append((block, whole))
                text.clear()

        def close(tags: tuple[str, ...] | frozenset[str], scope: frozenset[str] | None) -> bool:
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if tag in tags:
                    del stack[i:]
                    return True
                if scope is not None and tag in scope:
                    return False
            return False

        position = 0
        while match := _TOKEN.search(markup, position):
            if match.start() > at:
                if not text:
                    block = stack[-1]
                text.append(markup[at : match.start()])
            at = position = match.end()
            name = match[2]
            if name is None:
                continue
            name = name.lower()
            if match[1]:
                if name not in INLINE:
                    flush()
                if name == "p" and not any(self.tag[n] == "p" for n in stack):
                    continue
                close((name,), None)
                continue
            if name in RAW:
                if not name.startswith("annotation"):
                    flush()
                if name in FOREIGN and match[3].endswith("/"):
                    continue
                if name in ("script", "style"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(markup, position)
                    at = position = end.end() if end else len(markup)
                elif name == "head":
                    end = _HEAD_END.search(markup, position)
                    at = position = end.end() if end else position
                else:
                    enclosed = _enclosed(markup) if enclosed is None else enclosed
                    at = position = enclosed.get(match.start(), position)  # without an end only the tag goes
                continue
            if name == "br":
                text.append(" ")
                continue
            if name == "title":
                end = re.compile(r"</title\b[^>]*>", re.I).search(markup, position)
                at = position = end.end() if end else position
                continue
            if name not in INLINE:
                flush()
                if name in CLOSES_P:
                    close(("p",), SCOPES)
                if name in SIBLINGS:
                    close(SIBLINGS[name], SCOPES)
            if name in ("html", "body") and name in (self.tag[n] for n in stack):
                continue
            node = self._open(name, match[3], stack[-1])
            if name not in VOID and not match[3].endswith("/"):
                stack.append(node)
        if at < len(markup) and not markup.startswith("<", at):
            if not text:
                block = stack[-1]
            text.append(markup[at:])
        flush()

    def chain(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.parent[node]

    def statistics(self) -> Iterator[tuple[int, int, int, int]]:
        """(path, hash of the child elements' styles, hash of the text below, number of children) of every node.

        Text beside child elements is a leaf of its own.
        """
        n = len(self.tag)
        below = [xxhash.xxh64() for _ in range(n)]
        for node, text in self.blocks:
            for k in self.chain(node):
                below[k].update(text)
        beside: dict[int, xxhash.xxh64] = {}
        for node, text in self.blocks:
            beside.setdefault(self.holder(node), xxhash.xxh64()).update(text)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            if self.tag[k] not in INLINE:
                own = children[self.parent[k]]
                if not own or own[-1] != self.path[k]:
                    own.append(self.path[k])
        for k in range(1, n):
            if self.tag[k] not in INLINE:
                yield self.path[k], xxhash.xxh64_intdigest(repr(children[k])), below[k].intdigest(), len(children[k])
                if children[k] and k in beside:
                    yield _beside(self.path[k]), 0, beside[k].intdigest(), 0

    def holder(self, node: int) -> int:
        """The nearest element around a text that is not an inline one."""
        while node > 0 and self.tag[node] in INLINE:
            node = self.parent[node]
        return node

    def holds_important(self, low: set[int] | frozenset[int]) -> set[int]:
        """Paths of ``low`` that have a node of this page below them that is not low."""
        n = len(self.tag)
        kept = [self.tag[k] not in INLINE and self.path[k] not in low for k in range(n)]
        for node in {self.holder(node) for node, _ in self.blocks}:
            if node in self.mixed() and _beside(self.path[node]) not in low:
                kept[node] = True
        for k in range(n - 1, 0, -1):
            if kept[k]:
                kept[self.parent[k]] = True
        return {self.path[k] for k in range(1, n) if kept[k] and self.path[k] in low}

    def mixed(self) -> set[int]:
        """Nodes with child elements and text beside them."""
        if self._mixed is None:
            parents = {self.parent[k] for k in range(1, len(self.tag)) if self.tag[k] not in INLINE}
            self._mixed = parents & {self.holder(node) for node, _ in self.blocks}
        return self._mixed

    def text(self, low: set[int] | frozenset[int]) -> str:
        """The article's blocks without branches of the template and of low importance (a set of paths)."""
        n = len(self.tag)
        size = [0] * n
        for node, text in self.blocks:
            for k in self.chain(node):
                size[k] += len(text)
        holds_main = [False] * n
        for k in range(n - 1, 0, -1):
            if self.main[k]:
                for j in self.chain(self.parent[k]):
                    holds_main[j] = True
        removed = [False] * n
        for k in range(1, n):
            part = self.template[k] and not (holds_main[k] and not self.main[k]) and self.tag[k] not in ("html", "body")
            low_here = self.path[k] in low and not holds_main[k] and not self.main[k]
            inside = any(self.main[j] for j in self.chain(self.parent[k]))
            if part and self.tag[k] == "header" and inside and "h1" in self._tags_below(k):
                part = False  # the headline of the article
            removed[k] = removed[self.parent[k]] or part or (low_here and (self.styled[k] or not inside))
        roots = [k for k in range(1, n) if self.main[k] == 2 and not removed[k]]
        roots = roots or [k for k in range(1, n) if self.main[k] == 1 and not removed[k]]
        kept = None
        if roots:
            outer = [k for k in roots if not any(j in roots for j in self.chain(self.parent[k]))]
            kept = max(outer, key=lambda k: (size[k], -k))
        # text beside the elements of a branch that stays
        idle = set()
        for k in self.mixed():
            inside = any(self.main[j] for j in self.chain(k))
            if _beside(self.path[k]) in low and (not inside or (self.styled[k] and not self.main[k] and not holds_main[k])):
                idle.add(k)
        return "\n".join(
            t for node, t in self.blocks
            if not removed[node] and self.holder(node) not in idle and (kept is None or kept in self.chain(node))
        )

    def _tags_below(self, node: int) -> set[str]:
        return {self.tag[k] for k in range(node + 1, len(self.tag)) if node in self.chain(k)}


def _beside(path: int) -> int:
    """Path of the text beside the child elements of a node."""
    return xxhash.xxh64_intdigest("#text", path)


def host_of(url: str | None) -> str:
    """Lower-case host of a URL; everything without one counts as one host."""
    match = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return match[1].rpartition("@")[2].lower() if match else ""


def _digest(url: str | None, markup: str | None) -> int:
    return xxhash.xxh64_intdigest(markup or "", xxhash.xxh64_intdigest(host_of(url)))


def _copies(pages: DataFrame, folder: str, bits: int) -> hash_arrays.HashSetFiles:
    """Pages (hash of host and html) that occur more than once, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_digest(u, m) for u, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], names=["key"])

    found = pages.select("url", "html").mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = hash_arrays.sum_by_key(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy())
        return pa.table({
            "bucket": pa.array([key[0].as_py()], pa.int32()), "keys": [hash_arrays.write_array(folder, "copies", keys)],
            "counts": [hash_arrays.write_array(folder, "copy-counts", counts)],
        })

    bucketed = found.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket"), "key", "n")
    rows = bucketed.groupBy("bucket").applyInArrow(write, "bucket int, keys string, counts string").collect()  # one row per bucket
    return hash_arrays.HashSetFiles(folder, bits, {r.bucket: (r.keys, r.counts) for r in rows}, ("<u8", "<i8"))


def _unimportant(pages: DataFrame, folder: str, bits: int) -> hash_arrays.HashSetFiles:
    """Nodes (hash of host and path) of low composite importance."""
    copies = _copies(pages, folder, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            weight, first = [], []
            urls, markups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests = np.array([_digest(u, m) for u, m in zip(urls, markups)], np.uint64)
            order, share = np.argsort(digests), np.ones(len(digests))
            for part, arrays, at, there in copies.find(digests[order]):
                share[order[part]] = np.where(there, 1 / arrays[1][at], 1.0)
            for url, markup, own in zip(urls, markups, share.tolist()):
                seed = xxhash.xxh64_intdigest(host_of(url))
                seen = set()
                for p, c, t, n in Page(markup or "").statistics():
                    rows.append((p ^ seed, c, t, n))
                    weight.append(own)
                    first.append(0.0 if p in seen else own)
                    seen.add(p)
            table = np.array(rows, np.uint64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(table[:, i].view(np.int64) if i < 3 else table[:, 3].astype(np.int64)) for i in range(4)),
                 pa.array(weight, pa.float64()), pa.array(first, pa.float64())],
                names=["key", "look", "content", "children", "weight", "first"],
            )

    # the copies of a page weigh as much as one page
    nodes = pages.select("url", "html").mapInArrow(
        run, "key bigint, look bigint, content bigint, children bigint, weight double, first double"
    )

    def entropy(value: str) -> DataFrame:
        """Entropy of the values over a node's occurrences, to the base of their number: 0 all alike, 1 all different."""
        counts = nodes.groupBy("key", value).agg(
            F.round(F.sum("weight")).alias("c"), F.round(F.sum(F.col("children") * F.col("weight"))).alias("children"),
            F.round(F.sum("first"), 6).alias("pages"),
        )
        total = F.sum("c")
        return counts.groupBy("key").agg(
            F.round(F.sum("pages")).alias("m"), (F.sum("children") / total).alias("l"),
            (1 - F.sum(F.col("c") * F.log("c")) / total / F.log(F.greatest(total, F.lit(2)))).alias(f"{value}_entropy"),
        )

    looks, contents = entropy("look"), entropy("content").drop("m", "l")
    own = 1 - F.pow(F.lit(GAMMA), F.col("l"))
    importance = own * F.col("look_entropy") + (1 - own) * F.col("content_entropy")
    low = looks.join(contents, "key").where((F.col("m") >= LEAST_PAGES) & (importance < LEAST_IMPORTANCE))
    return hash_arrays.hash_set(low.select("key"), folder, bits)


def _low_paths(page: Page, url: str | None, *sets: hash_arrays.HashSetFiles) -> list[set[int]]:
    """The page's paths, also of texts beside elements, that are in each of the sets."""
    paths = [*page.path, *(_beside(page.path[k]) for k in page.mixed())]
    keys = np.array(paths, np.uint64) ^ np.uint64(xxhash.xxh64_intdigest(host_of(url)))
    return [{p for p, f in zip(paths, s.contains(keys)) if f} for s in sets]


def _above_important(pages: DataFrame, low: hash_arrays.HashSetFiles, folder: str, bits: int) -> hash_arrays.HashSetFiles:
    """Nodes of low importance with a node below them, on any page, that is not of low importance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[int] = set()
            for url, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(markup or "")
                seed = xxhash.xxh64_intdigest(host_of(url))
                found |= {p ^ seed for p in page.holds_important(_low_paths(page, url, low)[0])}
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).view(np.int64))], names=["key"])

    return hash_arrays.hash_set(pages.select("url", "html").mapInArrow(run, "key bigint"), folder, bits)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with text, the main text of the page.

    Blocks stand in page order with one newline between them; inside a block all white space is one space and character
    references are decoded. A null html is an empty page and gives an empty text; a null url belongs to a host of its own kind.
    A column text is replaced, all others are kept; pages of equal host and html count as one. Nodes on fewer than
    ``LEAST_PAGES`` different pages have no statistics: only the kinds of elements decide.
    """
    pages = pages.drop("text")
    folder = f"{shared_folder(pages.sparkSession)}/sites-{uuid.uuid4().hex}"
    size = pages.agg(F.sum(F.octet_length("html")).alias("n")).first().n or 0
    bits = hash_arrays.bucket_bits(size)
    low = _unimportant(pages, folder, bits)
    above = _above_important(pages, low, folder, bits)
    url_at, html_at, names_out = pages.columns.index("url"), pages.columns.index("html"), [*pages.columns, "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for url, markup in zip(batch.column(url_at).to_pylist(), batch.column(html_at).to_pylist()):
                page = Page(markup or "")
                unimportant, holding = _low_paths(page, url, low, above)
                texts.append(page.text(unimportant - holding))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names_out)

    return pages.mapInArrow(run, f"{schema}, text string")
